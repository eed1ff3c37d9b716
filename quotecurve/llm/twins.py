"""DuckDB twins of the training-data queries whose rules SQL can state."""

from quotecurve.llm import conversations as conv
from quotecurve.llm import hnsw, sharding, suffix, vptree

_SPACE = r"[^\x20\x09-\x0D]"

# Remainders of a byte by the reversed polynomial of crc32, by the rule.
_CRC_TABLE = (
    "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
)


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, with the table in `crc.t`."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "lambda c, b: xor(crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


def _path(cost: str, edits: str, lines: str) -> str:
    return f"struct_pack(c := {cost}, a := {edits}, r := {lines})"


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _put(edits: str, roles: list[str], then: str) -> str:
    """The path `then` behind turns put in."""
    lines = " || ".join(f"'{r}:' || chr(10)" for r in roles)
    return _path(f"{conv.INSERT * len(roles)} + {then}.c", f"'{edits}' || {then}.a", f"{lines} || {then}.r")


def _row_paths(state: int) -> str:
    """Least path over a row: all of its edits, those not allowed at a cost that no path has."""
    after, role = (2, "user") if state != 2 else (3, "assistant")
    stays = "fault NOT IN ('blank', 'duplicate')"
    extra = f"CASE WHEN fault = 'truncated' THEN {conv.CUT_OFF} ELSE 0 END"
    named = f"CASE WHEN {stays} THEN {conv.REROLE} + {extra} ELSE 1000000000 END"
    paths = [
        _path(f"v{state}.c + {conv.DELETE}", f"'D' || v{state}.a", f"v{state}.r"),
        _path(f"v{after}.c + {named}", f"'R' || v{after}.a", f"'{role}:' || text || chr(10) || v{after}.r"),
    ]
    for initial, to in {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]:
        kept = f"CASE WHEN {stays} AND left(role, 1) = '{initial}' THEN {extra} ELSE 1000000000 END"
        paths.append(_path(f"v{to}.c + {kept}", f"'K' || v{to}.a", f"role || ':' || text || chr(10) || v{to}.r"))
    return f"{_least(*paths)} AS b{state}"


OP13 = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_SPACE}') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
path AS (
  SELECT conv_id, n + 1 AS i, {_path("0", "''", "''")} AS v0,
    {_path(str(2 * conv.INSERT), "'II'", "'user:' || chr(10) || 'assistant:' || chr(10)")} AS v1,
    {_path(str(conv.INSERT), "'I'", "'assistant:' || chr(10)")} AS v2, {_path("0", "''", "''")} AS v3
  FROM judged WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {_least("b0", _put("I", ["user"], "b2"), _put("II", ["user", "assistant"], "b3"))},
    {_least("b1", _put("I", ["user"], "b2"), _put("II", ["user", "assistant"], "b3"))},
    {_least("b2", _put("I", ["assistant"], "b3"))}, {_least("b3", _put("I", ["user"], "b2"))}
  FROM (SELECT j.conv_id, j.i, {", ".join(_row_paths(s) for s in range(4))}
    FROM path JOIN judged j ON path.conv_id IS NOT DISTINCT FROM j.conv_id AND path.i = j.i + 1)),
summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
best AS (SELECT conv_id, v0 FROM path WHERE i = 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit,
  sha256(CASE WHEN length(coalesce(v0.r, '')) > 0 THEN left(v0.r, length(v0.r) - 1) ELSE '' END) AS repaired_sha256
FROM ids LEFT JOIN summed ON ids.conv_id IS NOT DISTINCT FROM summed.conv_id
LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""

OP12 = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON len(q.v) = len(c.v) AND q.r <> c.r WHERE q.vec_id % {vptree.QUERIES} = 0),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST, other) AS place FROM pairs)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= {vptree.NEAREST}
"""

_MODULUS = "CAST('18446744073709551616' AS HUGEINT)"
_BYTES = "list_transform(range(strlen(body)), lambda i: CAST('0x' || substr(hex(encode(body)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"

OP7 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
sums AS (
  SELECT body, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}),
    lambda c, b: xor(crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT body FROM d), crc),
jumps AS (
  SELECT id, n, (id + {_MODULUS}) % {_MODULUS} AS key, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS hop
  FROM (SELECT DISTINCT CAST(coalesce(doc_id, 0) AS HUGEINT) AS id FROM d) AS k, (VALUES ({sharding.SHARDS}), ({sharding.SHARDS + 1})) AS s(n)
  UNION ALL
  SELECT id, n, nxt, hop, CAST(floor((hop + 1) * (2147483648.0::DOUBLE / CAST((nxt // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (key * CAST('2862933555777941757' AS HUGEINT) + 1) % {_MODULUS} AS nxt FROM jumps WHERE hop < n)),
places AS (SELECT id, CAST(max(shard) FILTER (WHERE n = {sharding.SHARDS}) AS INTEGER) AS shard,
  CAST(max(shard) FILTER (WHERE n > {sharding.SHARDS}) AS INTEGER) AS grown_shard FROM jumps WHERE hop >= n GROUP BY id)
SELECT doc_id, CAST(strlen(body) + 8 AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, strlen(body)) - 1 AS slot, grown_shard
FROM d JOIN sums USING (body) JOIN places ON id = coalesce(doc_id, 0)
"""

OP8 = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
fine AS (
  SELECT r, label, v, sqrt(list_inner_product(v, v)) AS size FROM e
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= CAST({hnsw.COSINE} AS DOUBLE)),
reach AS (SELECT r, r AS node FROM e UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.node),
least AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.node GROUP BY reach.r),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM e JOIN least USING (r) LEFT JOIN counts ON counts.a = e.r
"""

_W = suffix.WIDTH

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
starts AS (
  SELECT r, doc_id, i, h[i + 1:i + {_W}] AS w
  FROM (SELECT r, doc_id, h, unnest(range(octet_length(h) - {_W - 1})) AS i FROM d WHERE doc_id IS NOT NULL AND octet_length(h) >= {_W})),
firsts AS (SELECT w, min(doc_id) AS least FROM starts GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT r, i FROM starts JOIN firsts USING (w) WHERE least < doc_id),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {_W}, true) AS fresh FROM hits),
runs AS (
  SELECT r, min(i) AS a, max(i) + {_W} AS b FROM (SELECT r, i, count(*) FILTER (WHERE fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM marked)
  GROUP BY r, k),
pieces AS (
  SELECT r, a, CASE WHEN a > coalesce(lag(b) OVER w, 0) THEN hex(h[coalesce(lag(b) OVER w, 0) + 1:a]) ELSE '' END AS p
  FROM runs JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY a)),
cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS b FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(p, '' ORDER BY a) AS p FROM pieces GROUP BY r)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(p, '') || CASE WHEN octet_length(h) > coalesce(b, 0) THEN hex(h[coalesce(b, 0) + 1:octet_length(h)]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
