"""Repair of conversation structure by a square-root checkpointed dynamic program.

A repaired conversation reads `(s?(ua)+)?` in the initials of its roles. Positions carry a vector of four
costs, one for each state of that pattern: nothing yet, after the system turn, after a user turn, after an
assistant turn. Walking backward over the rows of a piece, the vector is kept only at every square root of
the rows; walking forward, each block's vectors are computed again from its checkpoint while the least edit
that stays on a cheapest path is taken.

Rows are sorted by range, so a conversation of any size is cut into pieces of bounded size. Each piece of a
conversation that spans several parts gives a 4 x 4 matrix of least costs, products of which give the cost
vector at its end, and then a map from entry to exit state, which gives the state it starts in.
"""

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import materialise

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
PART_BYTES = 64 << 20  # texts of a part, about, where the cores do not ask for smaller ones
LEAST_BYTES = 1 << 20
_PREFIX = 64  # characters of a text that order rows of one turn before its hash does
_FAR = 1 << 50
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3  # faults; 0 is none
_OTHER = 3  # index of roles that begin with none of s, u and a
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_TURN = (2, 2, 3, 2)  # state after the one turn that may be put or renamed in a state
_ROLE = ("user", "user", "assistant", "user")
_LAWFUL = {(0, 1), (1, 2), (2, 1)}
_END = (0, 2 * INSERT, INSERT, 0)
_SPACES = " \t\n\x0b\f\r"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with faults put in by crc32(`conv:turn`) modulo 20.

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its role user. Nulls
    are one space in that key, in roles and in texts; conversation and turn keep theirs.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")), F.lit(20))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    named = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fate.alias("fate")
    ).where("fate <> 0")
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return named.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).select(
        "conv", "turn", "role", "text", F.explode("copy")
    ).drop("col")


def _key(column: Column) -> Column:
    """A text that stands for a conversation id, null too."""
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("v"), column.cast("string")))


# --- costs -----------------------------------------------------------------------------------------------


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Least costs where turns may be inserted first; more than two in a row come back to a state."""
    n, s, u, a = costs
    return (min(n, INSERT + u, 2 * INSERT + a), min(s, INSERT + u, 2 * INSERT + a), min(u, INSERT + a), min(a, INSERT + u))


class Steps:
    """Steps over one row, remembered by its code and the cost vector after it (up to a constant).

    A code is 4 * fault + role. There are few vectors, since costs of two states differ by a few edits.
    """

    def __init__(self):
        self.back: dict = {}
        self.forth: dict = {}

    def before(self, after: tuple[int, ...], code: int) -> tuple[int, ...]:
        low = min(after)
        key = (*(min(c - low, _FAR) for c in after), code)
        if key not in self.back:
            fault, role = divmod(code, 4)
            costs = [c + DELETE for c in key[:4]]
            if fault not in (_BLANK, _DUPLICATE):
                extra = CUT_OFF if fault == _TRUNCATED else 0
                for s in range(4):
                    costs[s] = min(costs[s], REROLE + extra + key[_TURN[s]])
                    if (s, role) in _KEEP:
                        costs[s] = min(costs[s], extra + key[_KEEP[s, role]])
            self.back[key] = tuple(min(c, _FAR) for c in _closed(costs))
        return tuple(c + low for c in self.back[key])

    def edits(self, after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
        """Edits up to and with this row's own, the ASCII-least on a cheapest path, and the state after it."""
        low = min(after)
        key = (*(c - low for c in after), code, state)
        if key not in self.forth:
            fault, role = divmod(code, 4)
            extra = CUT_OFF if fault == _TRUNCATED else 0
            costs, made, s = self.before(key[:4], code), "", state
            while True:
                if key[s] + DELETE == costs[s]:
                    made += "D"
                    break
                if costs[_TURN[s]] + INSERT == costs[s]:
                    made, s = made + "I", _TURN[s]
                    continue
                if (s, role) in _KEEP and extra + key[_KEEP[s, role]] == costs[s]:
                    made, s = made + "K", _KEEP[s, role]
                else:
                    made, s = made + "R", _TURN[s]
                break
            self.forth[key] = (made, s)
        return self.forth[key]


def checkpoints(codes: bytes, end: tuple[int, ...], steps: Steps) -> tuple[int, list[tuple[int, ...]]]:
    """(block length, cost vectors at the start of every block and at the end)."""
    length = isqrt(max(len(codes) - 1, 0)) + 1
    marks, now = [end], end
    for at in range(len(codes) - 1, -1, -1):
        now = steps.before(now, codes[at])
        if at % length == 0:
            marks.append(now)
    return length, marks[::-1]


def walk(codes: bytes, end: tuple[int, ...], state: int, steps: Steps) -> Iterator[tuple[str, int, int]]:
    """(edits, state before, state after) of each row, given the cost vector at the end and the entry state."""
    length, marks = checkpoints(codes, end, steps)
    for block in range(len(marks) - 1):
        rows = codes[block * length : (block + 1) * length]
        vectors = [marks[block + 1]]
        for code in rows[:0:-1]:
            vectors.append(steps.before(vectors[-1], code))
        for code in rows:
            made, after = steps.edits(vectors.pop(), code, state)
            yield made, state, after
            state = after


def _closing(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (_END[state] // INSERT)


def _matrix(codes: bytes, steps: Steps) -> list[int]:
    """Least cost from each state at the start of a piece to each state at its end, row by row."""
    columns = []
    for target in range(4):
        now = tuple(0 if s == target else _FAR for s in range(4))
        for code in reversed(codes):
            now = steps.before(now, code)
        columns.append(now)
    return [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]


# --- pieces ----------------------------------------------------------------------------------------------


def _codes(table: pa.Table) -> bytes:
    return bytes(table.sort_by("pos").column("code").to_pylist())


def _piece_matrix(table: pa.Table) -> pa.Table:
    return pa.table({"key": table.column("key")[:1], "part": table.column("part")[:1], "costs": pa.array([_matrix(_codes(table), Steps())], pa.list_(pa.int64()))})


def _end_vectors(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    now, ends = _END, []
    for costs in reversed(table.column("costs").to_pylist()):
        ends.append(now)
        now = tuple(min(costs[4 * s + t] + now[t] for t in range(4)) for s in range(4))
    return table.select(["key", "part"]).append_column("ends", pa.array([[*e] for e in ends[::-1]], pa.list_(pa.int64())))


def _exit_states(table: pa.Table) -> pa.Table:
    steps, exits = Steps(), []
    ends, codes = tuple(table.column("ends")[0].as_py()), _codes(table)
    for state in range(4):
        last = state
        for _, _, last in walk(codes, ends, state, steps):
            pass
        exits.append(last)
    return pa.table(
        {"key": table.column("key")[:1], "part": table.column("part")[:1], "ends": table.column("ends")[:1], "exits": pa.array([exits], pa.list_(pa.int32()))}
    )


def _entry_states(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    state, entries = 0, []
    for exits in table.column("exits").to_pylist():
        entries.append(state)
        state = exits[state]
    last = [False] * (len(table) - 1) + [True]
    return (
        table.select(["key", "part", "ends"]).append_column("entry", pa.array(entries, pa.int32())).append_column("last", pa.array(last)).append_column("first", pa.array([k == 0 for k in range(len(table))]))
    )


_MESSAGE = pa.struct([("role", pa.string()), ("text", pa.string())])
_PIECE = pa.schema(
    [
        ("key", pa.string()),
        ("part", pa.int64()),
        ("first", pa.bool_()),
        ("last", pa.bool_()),
        ("head", pa.int32()),
        ("tail", pa.int32()),
        ("blank", pa.int64()),
        ("duplicate", pa.int64()),
        ("truncated", pa.int64()),
        ("illegal", pa.int64()),
        ("cost", pa.int64()),
        ("audit", pa.string()),
        ("messages", pa.list_(_MESSAGE)),
    ]
)
_PIECES = (
    "key string, part long, first boolean, last boolean, head int, tail int, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string, messages array<struct<role:string,text:string>>"
)
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def _solved(part: int, key: str, rows: list[tuple], place: tuple | None, steps: Steps) -> dict:
    """One piece: `rows` of (role, text, code) in order, `place` = (ends, entry, first, last) if there are others."""
    ends, state, first, last = place or (_END, 0, True, True)
    codes = bytes(r[2] for r in rows)
    audit, messages, cost = [], [], 0
    for (role, text, code), (made, now, _) in zip(rows, walk(codes, ends, state, steps), strict=True):
        for edit in made:
            if edit == "I":
                messages.append({"role": _ROLE[now], "text": ""})
                now = _TURN[now]
            elif edit != "D":
                messages.append({"role": role if edit == "K" else _ROLE[now], "text": text})
                now = _KEEP[now, code % 4] if edit == "K" else _TURN[now]
                cost += CUT_OFF * (code // 4 == _TRUNCATED)
            cost += _COST[edit]
        audit.append(made)
        state = now
    if last:
        for edit in _closing(state):
            messages.append({"role": _ROLE[state], "text": ""})
            state = _TURN[state]
            cost += _COST[edit]
            audit.append(edit)
    faults, roles = [c // 4 for c in codes], [c % 4 for c in codes]
    return {
        "key": key,
        "part": part,
        "first": first,
        "last": last,
        "head": roles[0],
        "tail": roles[-1],
        "blank": faults.count(_BLANK),
        "duplicate": faults.count(_DUPLICATE),
        "truncated": faults.count(_TRUNCATED),
        "illegal": sum(pair not in _LAWFUL for pair in zip(roles, roles[1:], strict=False)),
        "cost": cost,
        "audit": "".join(audit),
        "messages": messages,
    }


def _solve_part(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """All pieces of a part: its texts, with the faults and places found apart."""
    texts, steps, out = texts.sort_by("pos"), Steps(), []
    fault, places = {}, {}
    for mark in marks.to_pylist():
        if mark["pos"] is not None:
            fault[mark["pos"]] = True
        else:
            places[mark["key"]] = (tuple(mark["ends"]), mark["entry"], mark["first"], mark["last"])
    columns = [texts.column(c).to_pylist() for c in ("key", "role", "text", "code", "pos")]
    rows: list[tuple] = []
    held = None
    for key, role, text, code, pos in zip(*columns, strict=True):
        if key != held and rows:
            out.append(_solved(texts.column("part")[0].as_py(), held, rows, places.get(held), steps))
            rows = []
        held = key
        rows.append((role, text, 4 * _DUPLICATE + code % 4 if pos in fault else code))
    if rows:
        out.append(_solved(texts.column("part")[0].as_py(), held, rows, places.get(held), steps))
    return pa.Table.from_pylist(out, schema=_PIECE)


def _parts(df: DataFrame, size: int) -> int:
    """Parts that give every core work, none of much more than PART_BYTES."""
    busy = min(2 * df.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    return max(1, busy, -(-size // PART_BYTES))


def pieces(
    rows: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Repaired pieces of conversations: `messages` (role, text) and the edits `audit` that made them.

    Rows (key, part, first, last, head, tail, blank, duplicate, truncated, illegal, cost, audit, messages);
    the pieces of a conversation follow one another by `part`, nearly all conversations are one piece.
    `key` is n for the null conversation, else v and the id. Rows go by turn (nulls first), then role, then
    the first 64 characters of the text, then its hash. The first fault of a row counts: blank (a null text
    is blank), a role and text seen earlier, or a last character that is not one of `.!?`. `illegal` counts
    neighbours within the piece. An empty table gives no pieces; other columns are ignored.
    """
    space = F.lit(" ")
    body = F.coalesce(F.col(text_col).cast("string"), space)
    named = rows.select(_key(F.col(conv_col)).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), body.alias("text"))
    size = named.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    trimmed = F.rtrim("text", F.lit(_SPACES))
    role = F.coalesce(F.when(F.left("role", F.lit(1)) == "s", 0).when(F.left("role", F.lit(1)) == "u", 1).when(F.left("role", F.lit(1)) == "a", 2), F.lit(_OTHER))
    fault = F.when(trimmed == "", _BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    sort_by = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(_PREFIX)), F.col("hash"), F.col("salt")]
    ordered = materialise(
        named.withColumns({"hash": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), "code": (4 * fault + role).cast("int"), "salt": F.monotonically_increasing_id()})
        .repartitionByRange(parts or _parts(rows, size), *sort_by)
        .sortWithinPartitions(*sort_by)
        .select("key", "role", "text", "code", "hash", F.monotonically_increasing_id().alias("pos"))
        .withColumn("part", F.shiftrightunsigned("pos", 33)),
        "ordered",
    )
    seen = ordered.where(f"code div 4 <> {_BLANK}").select("key", "hash", "pos", "part")
    first = seen.groupBy("key", "hash").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = materialise(seen.join(first, ["key", "hash"]).where("pos > start").select("pos", "part"), "repeats")
    spanning = ordered.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    small = ordered.select("key", "part", "pos", "code").join(spanning, "key")
    again = repeats.select("pos", F.lit(4 * _DUPLICATE).alias("worse"))
    codes = materialise(
        small.join(again, "pos", "left").select("key", "part", "pos", F.coalesce(F.col("worse") + F.col("code") % 4, F.col("code")).cast("int").alias("code")), "codes"
    )
    # Written one after another, so that a task never runs more than one of these functions.
    matrices = materialise(codes.groupBy("key", "part").applyInArrow(_piece_matrix, "key string, part long, costs array<long>"), "matrices")
    ends = materialise(matrices.groupBy("key").applyInArrow(_end_vectors, "key string, part long, ends array<long>"), "ends")
    exits = codes.join(ends, ["key", "part"]).groupBy("key", "part").applyInArrow(_exit_states, "key string, part long, ends array<long>, exits array<int>")
    found = materialise(exits, "exits").groupBy("key").applyInArrow(_entry_states, "key string, part long, ends array<long>, entry int, last boolean, first boolean")
    places = materialise(found, "places")
    marks = repeats.select("part", "pos", *(F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("ends", "array<long>"), ("entry", "int"), ("first", "boolean"), ("last", "boolean")))).unionByName(
        places.withColumn("pos", F.lit(None).cast("long"))
    )
    return ordered.select("part", "pos", "key", "role", "text", "code").groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_solve_part, _PIECES)


def repaired(found: DataFrame) -> DataFrame:
    """Rows (key, part, at, role, text) of the repaired conversations in `pieces`."""
    return found.select("key", "part", F.posexplode("messages").alias("at", "message")).select("key", "part", "at", "message.role", "message.text")


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal keys; a conversation passes through a batch at a time."""
    held, state, blank = None, None, True
    for batch in batches:
        keys, lines = [], []
        for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if key != held:
                if held is not None:
                    keys.append(held)
                    lines.append(state.hexdigest())
                held, state, blank = key, hashlib.sha256(), True
            if line is not None:
                state.update(line.encode() if blank else b"\n" + line.encode())
                blank = False
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "digest"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "digest"])


def repair(found: DataFrame) -> DataFrame:
    """Rows (key, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per conversation.

    `found` holds `pieces`. The digest is that of the lines `role:text`; one of several pieces is read in
    order, a batch at a time, as such a digest can only be taken in order.
    """
    found = materialise(found, "pieces")
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    one = found.where("first and last").select(
        "key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256")
    )
    many = found.where("not (first and last)")
    lines = many.select("key", "part", F.posexplode_outer(line).alias("at", "line"))
    # A run of one key stays in one task: the digest of its lines has an order.
    digests = lines.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "line").mapInArrow(_hash_chunks, "key string, digest string")
    sums = many.groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_sort(F.collect_list(F.struct("part", "head", "tail", "audit"))).alias("parts"),
    )
    seams = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.col("parts")[k - 1]["tail"] * 4 + F.col("parts")[k]["head"])
    bad = F.size(F.filter(seams, lambda c: ~c.isin([4 * a + b for a, b in sorted(_LAWFUL)])))
    rest = sums.join(digests, "key").select(
        "key", "blank", "duplicate", "truncated", (F.col("illegal") + bad).alias("illegal"), "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), F.col("digest").alias("repaired_sha256")
    )
    return one.unionByName(rest)


def damaged_and_repaired(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Rows (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per conversation.

    The conversations are damaged by `damage` and repaired by `pieces`. One that lost all its rows has
    zeros, no edits and the digest of an empty text; a null id is a conversation of its own.
    """
    rows = damage(conversations, conv_col, turn_col, role_col, text_col)
    keyed = rows.select(_key(F.col("conv")).alias("key"), "turn")
    turns = keyed.where("turn is not null").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    ids = conversations.select(F.col(conv_col).alias("conv")).distinct().withColumn("key", _key(F.col("conv")))
    mended = repair(pieces(rows, parts=parts))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(turns, "key", "left").join(mended, "key", "left").select(
        "conv",
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
