"""Operators over documents against brute force, on rows with every oddity."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotecurve.llm import bpe, ctw, mixing, quality, sharding, simhash, suffix, toxicity

def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def pairs(messy):
    return [(r["doc_id"], r["text"]) for r in messy.collect()]


# ---------------------------------------------------------------- simhash


def fingerprint(text):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def test_simhash(messy):
    docs = pairs(messy)
    prints = [fingerprint(t) for _, t in docs]
    roots = grouped(prints)
    least = {}
    for (doc, _), r in zip(docs, roots):
        least[r] = min((x for x in (doc, least.get(r)) if x is not None), default=None)
    want = [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(docs, prints, roots)]
    assert ordered(collected(simhash.near_duplicates(messy))) == ordered(want)


@pytest.mark.parametrize("size", [40, 4096])
def test_cells_join_all_near_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "CELL", size)
    rng = np.random.default_rng(2)
    values = set()
    for base in rng.integers(0, 2**63, 60).tolist():
        for _ in range(8):
            values.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 63, 2).tolist())))
    values = sorted(values)
    links = collected(simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long")))
    at = {v: i for i, v in enumerate(values)}
    root = np.arange(len(values))
    assert all((a ^ b).bit_count() <= 12 for a, b in links)
    simhash._join(root, np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert root.tolist() == grouped(values)


def test_one_of_each_group_stays(messy):
    groups = {r[0]: r[2] for r in collected(simhash.near_duplicates(messy)) if r[0] is not None}
    stay = [r["doc_id"] for r in simhash.keep_first(messy).collect()]
    assert {d for d in stay if d is not None} == {d for d, c in groups.items() if d == c}
    assert stay.count(None) == 2


# ---------------------------------------------------------------- quality


def test_quality_figures(messy):
    got = sorted((r[:1] + r[2:8] for r in collected(quality.assess(messy))), key=str)
    want = []
    for doc, text in pairs(messy):
        found = WORD.findall(text or "")
        grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
        want.append((doc, len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    assert got == sorted(want, key=str)


def test_frequent_lines_deplete_documents(spark):
    body = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    banner = " ".join(f"menu{k}" for k in range(60))
    rows = [(i, f"{b}\n{banner.upper() if i % 2 else banner}", "h") for i, b in enumerate(body)]
    rows += [(100 + i, b + " " + " ".join(f"more{i}y{k}" for k in range(30)), "h") for i, b in enumerate(body)]
    rows += [(200 + i, rows[30][1], "h") for i in range(40)]  # copies are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["id"]: r["kept"] for r in quality.assess(docs, max_docs=5, max_share=0.1).collect()}
    assert {d for d, k in kept.items() if not k} == set(range(30))
    assert quality.keep_good(docs, max_docs=5, max_share=0.1).count() == 70


def test_frequent_lines_leave_the_texts(spark):
    body = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    rows = [(i if i else None, f"Read  MORE here\n\n{b}\n read more\there\nend{i}", "h", i) for i, b in enumerate(body)]
    rows += [(3, rows[3][1], "h", 103), (3, rows[3][1], "other", 203), (3, rows[3][1], None, 303)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    limits = {"max_docs": 5, "max_share": 0.1}
    named = {(r["id"], len(r["removed_lines"]), r["n_removed_words"]) for r in quality.assess(docs, **limits).collect()}
    assert named == {(i or None, 1, 6) for i in range(12)} | {(3, 0, 0)}
    got = quality.keep_good(docs, **limits)
    assert got.columns == docs.columns
    sizes = docs.withColumn("n_chars", F.when(F.col("source") == "h", F.lit(0).cast("long")))
    counted = collected(quality.keep_good(sizes, length_col="n_chars", **limits).select("source", "n_chars", F.length("text")))
    assert len(counted) == 15 and all(n == (length if h == "h" else None) for h, n, length in counted)
    want = [(d, f"\n{body[n % 100]}\nend{n % 100}" if h == "h" else t, h, n) for d, t, h, n in rows]
    assert sorted(collected(got), key=lambda r: r[3]) == want


# ---------------------------------------------------------------- suffixes


def passages(docs, width=50):
    first = {}
    bodies = [(doc, (text or "").encode()) for doc, text in docs]
    for doc, b in bodies:
        for p in range(len(b) - width + 1 if doc is not None else 0):
            first[b[p : p + width]] = min(doc, first.get(b[p : p + width], doc))
    out = []
    for doc, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1 if doc is not None else 0):
            if first[b[p : p + width]] < doc:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block,part", [(4 << 20, 32 << 20), (3000, 5000)])
def test_removed_passages(messy, monkeypatch, block, part):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "PART_BYTES", part)
    assert ordered(collected(suffix.removed_passages(messy))) == ordered(passages(pairs(messy)))


def test_removed_passages_with_hot_leading_tokens(spark, monkeypatch):
    """A phrase that most documents share among other surroundings, copies in one document, a passage of all."""
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 2500)
    rng = random.Random(9)
    phrase, passage = "0 aaaa thank you for reading this! ", "all documents of this site hold this very passage, word for word. "
    docs = []
    for k in range(160):
        body = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60)))
        docs.append((k * 3 % 160, body + phrase * rng.randint(1, 2) + rng.choice("xyz") * 20 + (passage if k % 2 else "") + body[:25]))
    docs += [(200, "q" * 500), (201, "q" * 130), (7, passage), (202, passage + passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tables = {t.name for t in spark.catalog.listTables()}
    assert ordered(collected(suffix.removed_passages(frame))) == ordered(passages(docs))
    assert {t.name for t in spark.catalog.listTables()} == tables


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_multikey_quicksort_against_sets(letters):
    rng = np.random.default_rng(letters)
    buffer = rng.integers(97, 97 + letters, 4000).astype(np.uint8)
    buffer[2000:2400] = buffer[100:500]
    places = rng.permutation(3900)[:3000]
    group = np.sort(rng.integers(0, 5, len(places)))
    ids = rng.integers(0, 40, len(places))
    least: dict = {}
    keys = [(int(g), buffer[p : p + 50].tobytes()) for g, p in zip(group, places)]
    for key, number in zip(keys, ids):
        least[key] = min(int(number), least.get(key, int(number)))
    got = suffix._least_by_window(buffer, places, group, ids, 50)
    assert got.tolist() == [least[key] for key in keys]
    none = np.empty(0, np.int64)
    assert not len(suffix._least_by_window(buffer, none, none, none, 50))


def test_cut_texts_are_whole_characters(messy):
    want = {r[0]: r[1] - r[2] for r in passages(pairs(messy)) if r[0] is not None}
    got = suffix.cut_texts(messy)
    assert got.columns == messy.columns
    for row in got.where("doc_id is not null").collect():
        size = len((row["text"] or "").encode())
        assert want[row["doc_id"]] - 8 <= size <= want[row["doc_id"]]


# ---------------------------------------------------------------- mixing


def _goals(tokens, targets, wanted):
    """Goals in proportion to the targets, none above the tokens, by bisection of the scale."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(tokens, targets * mid).sum() < wanted else (low, mid)
    return np.minimum(tokens, targets * high)


def _raked(tokens, goals):
    """Kept tokens of a dense table: every value's scale by bisection, in turn, until nothing moves."""
    base = tokens.astype(float)
    for _ in range(60):
        for axis, goal in enumerate(goals):
            for k, want in enumerate(goal):
                at = [slice(None)] * tokens.ndim
                at[axis] = k
                at = tuple(at)
                low, high = 0.0, 1e9
                for _ in range(60):
                    mid = math.sqrt(max(low, 1e-9) * high)
                    low, high = (mid, high) if np.minimum(tokens[at], base[at] * mid).sum() < want else (low, mid)
                base[at] = base[at] * high
    return np.minimum(tokens, base)


def test_mixture_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        lang = rng.choice(["en", "en", "de", None])
        rows.append((k if k % 50 else None, words(rng, rng.randint(0, 60)) + rng.choice(["", " harbour" * 3, " mountain" * 3, " valley" * 4]), lang, rng.choice(["a", "a", "a", "b", None]), 3))
    rows += [rows[4], rows[4]]
    frame = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, lang string, source string, told int, mix string")
    found = mixing.mixture(frame, topics=4).collect()
    assert len(found) == len(rows)
    values = [sorted({r[d] for r in found}, key=str) for d in ("source", "lang", "topic")]
    tokens = np.zeros([len(v) for v in values], int)
    place = lambda r: tuple(v.index(r[d]) for v, d in zip(values, ("source", "lang", "topic")))
    for r in found:
        tokens[place(r)] += r["n_tokens"]
    wanted = mixing.KEEP * tokens.sum()
    sums = [tokens.sum(axis=tuple({0, 1, 2} - {axis})).astype(float) for axis in range(3)]
    kept = _raked(tokens, [_goals(s, s**mixing.POWER, wanted) for s in sums])
    for r in found:
        at = place(r)
        assert r["probability"] == pytest.approx(kept[at] / tokens[at], rel=1e-3)
        assert r["weight"] == pytest.approx(kept[at] / wanted, rel=1e-3)
        seed = 42 if r["id"] is None else xxhash.xxh64_intdigest(struct.pack("<q", r["id"]), seed=42)
        number = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), seed=seed) >> 11
        assert r["sampled"] == (number * 2.0**-53 < r["probability"])
    counts = Counter()
    for text in (r[1] for r in rows):
        counts.update({zlib.crc32(w.encode()) % mixing.TERMS for w in mixing._terms(text)[1]})
    for r, text in {(r["id"], r["n_tokens"], r["topic"]): t for r in found for i, t, *_ in rows if r["id"] == i and i is not None}.items():
        strongest = max(((n * math.log((len(rows) + 1) / (counts[zlib.crc32(w.encode()) % mixing.TERMS] + 0.5)), w) for w, n in mixing._terms(text)[1].items()), default=None)
        want = 1 + zlib.crc32(strongest[1].encode()) % mixing.TERMS % 3 if strongest and strongest[0] > 0 else 0
        assert r[1:] == (len(text.split()) + 1, want)


def test_a_rare_cell_does_not_thin_out_the_others(spark):
    rows = [(k, "word " * 20, "en", "a") for k in range(2000)] + [(5000, "word", "en", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixture(frame).collect()
    share = {r["source"]: r["probability"] for r in found}
    assert share["a"] == pytest.approx(mixing.KEEP, rel=1e-3) and share["b"] <= 1


def test_own_targets_and_marginals_that_contradict(spark):
    rows = [(k, "word word", ["en", "de"][k % 2], ["a", "b"][k % 2]) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    named = frame.selectExpr("doc_id id", "text t", "source s", "lang l")
    cells = mixing.with_cells(named, "t", "s", "l")
    targets = {
        "source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 1.0), ("de", 3.0), ("fr", 9.0)], "lang string, target double"),
        "topic": spark.createDataFrame([(r[0], 1.0) for r in cells.select("mix.topic").distinct().collect()], "topic int, target double"),
    }
    share = {r["source"]: r["probability"] for r in mixing.mixture(frame, targets=targets, keep=0.5).collect()}
    assert share == {"a": pytest.approx(0.25, rel=1e-4), "b": pytest.approx(0.75, rel=1e-4)}
    targets["lang"] = spark.createDataFrame([("en", 3.0), ("de", 1.0)], "lang string, target double")
    with pytest.warns(UserWarning, match="met within"):
        assert mixing.mixture(frame, targets=targets, keep=0.5).count() == 40
    with pytest.raises(ValueError, match="MAX_MATRIX"):
        before, mixing.MAX_MATRIX = mixing.MAX_MATRIX, 1
        try:
            mixing.mixture(frame, targets=targets)
        finally:
            mixing.MAX_MATRIX = before


def test_sampled_rows_are_those_of_the_mixture(messy):
    drawn = sorted(str(r["id"]) for r in mixing.mixture(messy, topics=3).where("sampled").collect())
    sample = mixing.sample(messy, topics=3)
    assert sample.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in sample.collect()) == drawn


# ---------------------------------------------------------------- language model


def test_base_score(messy):
    docs = pairs(messy)
    lists = [[*WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")), None] for _, t in docs]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in docs]
    count = Counter(w for ws, o in zip(lists, out) if not o for w in ws)
    total, kinds = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws) for ws in lists]
    want = [(d, o, len(ws), sum(count[w] > 0 for w in ws), total, round(b, 6)) for (d, _), o, ws, b in zip(docs, out, lists, base)]
    got = [(*r[:5], round(r[5], 6)) for r in collected(ctw.score(messy))]
    assert ordered(got) == ordered(want)


def weighted(texts, depth, context=b""):
    """Log weighted probability of the symbols after `context`, decision by decision, by the plain recursion."""
    split = {}
    for line in texts:
        padded = bytes([ctw.END]) * ctw.DEPTH + line + bytes([ctw.END])
        for i in range(ctw.DEPTH, len(padded)):
            split.setdefault(padded[i - depth : i], Counter())[padded[i]] += 1
    return split


def test_tree_mixes_all_depths(spark):
    def rows(out, texts):
        fold = [i for i in range(1000) if (zlib.crc32(str(i).encode()) % 5 == 1) == out]
        return [(i, t.decode()) for i, t in zip(fold, texts)]

    lines = [b"abab abba", b"ab", b"", b"baba abab ab"] * 3 + [b"zzz a"]
    grams, counts = np.unique(ctw._grams(lines), return_counts=True)
    path = ctw.levels(grams, counts, 0, ctw.DEPTH)
    for context in (0, int.from_bytes(b" abab", "big"), int.from_bytes(b"abzab", "big")):
        following = np.arange(256, dtype=np.uint64) | np.uint64(context << 8)
        assert (10.0 ** ctw.log10_of(following, path)).sum() == pytest.approx(1)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    tables = [weighted(lines, d) for d in range(ctw.DEPTH + 1)]

    def counts(context, prefix):
        held = [0, 0]
        for symbol, n in tables[len(context)].get(context, {}).items():
            bits = f"{symbol:08b}"
            if bits.startswith(prefix):
                held[int(bits[len(prefix)])] += n
        return held

    def log_weighted(context, prefix):
        own = kt(*counts(context, prefix))
        if len(context) == ctw.DEPTH:
            return own
        below = sum(log_weighted(c, prefix) for c in tables[len(context) + 1] if c.endswith(context))
        return np.logaddexp(own, below) - math.log(2)

    def chance(history, prefix, depth=0):
        context = history[len(history) - depth :]
        a, b = counts(context, prefix)
        own = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH:
            return own
        child = history[len(history) - depth - 1 :]
        below = chance(history, prefix, depth + 1) if child in tables[depth + 1] else 0.5
        share = math.exp(kt(a, b) - math.log(2) - log_weighted(context, prefix))
        return share * own + (1 - share) * below

    def log10(line):
        padded, total = bytes([ctw.END]) * ctw.DEPTH + line + bytes([ctw.END]), 0.0
        for i in range(ctw.DEPTH, len(padded)):
            bits = f"{padded[i]:08b}"
            for k in range(8):
                one = chance(padded[i - ctw.DEPTH : i], bits[:k])
                total += math.log10(one if bits[k] == "1" else 1 - one)
        return total

    texts = [b"abab", b"b a", b"", b"zab abz"]
    docs = spark.createDataFrame(rows(False, lines) + rows(True, texts), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["score"] for r in ctw.score(docs).collect()}
    want = {i: log10(t.encode()) for i, t in rows(False, lines) + rows(True, texts)}
    assert got == pytest.approx(want, rel=1e-5)


# ---------------------------------------------------------------- toxicity


def test_segments_are_maximal():
    def brute(s, a, b):
        sums = [(sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        best = max(sums, key=lambda t: (t[0], -t[1]), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        return [*brute(s, a, best[1]), best[1:], *brute(s, best[2], b)]

    rng = np.random.default_rng(4)
    for _ in range(100):
        scores = rng.normal(-0.3, 1, rng.integers(0, 20))
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute(scores.tolist(), 0, len(scores))


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect() if r["held_out"] and r["id"] in truth]
    right = sum(r["predicted"] == truth[r["id"]] for r in rows)
    assert right / len(rows) > 0.92
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(messy, none).collect()
    assert len(rows) == messy.count() and not any(r["predicted"] for r in rows)


# ---------------------------------------------------------------- tokens


def test_bpe_equals_the_public_library(messy):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    model = bpe.Bpe.read(bpe.default_vocabulary())
    texts = [t or "" for _, t in pairs(messy)]
    texts += ["<|endoftext|> a  <|endoftext|>\n\n", "don't I'LL \x1c\x85 漢字 ٣² \x00", "  leading", "trail  "]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:50]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = model.encode(text)
        assert ids == np.array(coded.ids, "<u4").tobytes()
        assert model.decode(ids).decode() == library.decode(coded.ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "place,option,value",
    [("model", "dropout", 0.1), ("model", "ignore_merges", True), ("model", "end_of_word_suffix", "</w>"), ("model", "continuing_subword_prefix", "##"),
     ("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "use_regex", False), ("pre_tokenizer", "type", "Whitespace")],
)
def test_vocabularies_of_another_kind_are_refused(tmp_path, place, option, value):
    told = json.loads(Path(bpe.default_vocabulary()).read_text(encoding="utf-8"))
    told["model"] |= {"vocab": {}, "merges": []}
    told[place][option] = value
    file = tmp_path / "vocabulary.json"
    file.write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Bpe.read(str(file))


def test_null_ids_decode_to_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray()), (None, None)], "id long, ids binary")
    assert ordered((r["id"], r["text"]) for r in bpe.decode(rows).collect()) == [(None, ""), (1, ""), (2, "")]


def test_bpe_round_trip(messy):
    back = bpe.decode(bpe.encode(messy))
    assert ordered((r["id"], r["text"]) for r in back.collect()) == ordered((d, t or "") for d, t in pairs(messy))
    for doc, n, ids_sha, text_sha, ids in collected(bpe.digests(messy)):
        assert n == len(ids) // 4 and ids_sha == hashlib.sha256(ids).hexdigest()


# ---------------------------------------------------------------- shards


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(messy):
    rows = sharding.shards(messy).collect()
    want = []
    for doc, text in pairs(messy):
        body = (text or "").encode()
        want.append((doc, len(body) + 8, zlib.crc32(body), jump(doc or 0, 24), jump(doc or 0, 25)))
    assert ordered((r["id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == ordered(want)
    for shard in {r["shard"] for r in rows}:
        held = sorted((r["slot"], r["id"] is not None, r["id"] or 0) for r in rows if r["shard"] == shard)
        assert [h[0] for h in held] == list(range(len(held)))
        assert [h[1:] for h in held] == sorted(h[1:] for h in held)


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        simhash.near_duplicates(no_docs),
        simhash.keep_first(no_docs),
        quality.assess(no_docs),
        quality.keep_good(no_docs),
        suffix.removed_passages(no_docs),
        suffix.cut_texts(no_docs),
        mixing.mixture(no_docs),
        mixing.sample(no_docs),
        ctw.score(no_docs),
        toxicity.score(no_docs, none),
        bpe.digests(no_docs),
        sharding.shards(no_docs),
    ):
        assert df.count() == 0
