"""Code length of texts by context-tree weighting, next to a unigram base.

A text is its words in lower case, one space apart, and an end symbol. Each byte is eight binary decisions;
each decision has a Krichevsky-Trofimov estimate in every context of zero to DEPTH preceding bytes, and
the estimates of all depths are mixed by the weights of context-tree weighting. A context or decision
that no training text holds predicts one half.

The tree keeps every context of the training texts, so it grows with the corpus and is never in one place.
Documents are read in chunks; a chunk is written with its distinct strings of DEPTH + 1 bytes and their
training counts. Counts are summed by string, and subtrees below contexts of two bytes are computed where
the strings of such a context meet. Only the tree above them, at most 2^16 contexts of two bytes, is
put together by the driver and sent to the workers. The probability of each distinct string then goes
back to the chunks that hold it.
"""

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import materialise, text_bytes

DEPTH = 5
TOP = 2  # bytes of the contexts whose subtrees are computed apart
WORD_SHARE = 2.0**-20  # a word with this share of the training tokens is looked up in the worker
PART = 1 << 16  # distinct strings of a part, about
END = 255  # no byte of UTF-8; ends a text, and stands before its start
_FLUSH = 4 << 20  # symbols of a chunk
_HELD = 2 << 20  # summed strings that a task holds before it hands them on
_PIECE = 1 << 18
_ROWS = 256
_LN2, _LN10 = np.log(2.0), np.log(10.0)


def plain(text: bytes) -> list[bytes]:
    return text.lower().split()


def held_out(id_col: Column, fold: int = 1) -> Column:
    """Whether an id is in the given fold of five; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == fold


# ---------------------------------------------------------------- counting


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths): each text after DEPTH end symbols and before one."""
    lines = [b" ".join(plain(t)) for t in texts]
    pad, stop = bytes([END]) * DEPTH, bytes([END])
    whole = b"".join([x for line in lines for x in (pad, line, stop)])
    return np.frombuffer(whole + bytes(8), np.uint8), np.array([len(line) + 1 for line in lines], np.int64)


def _grams(texts: list[bytes]) -> np.ndarray:
    """DEPTH + 1 bytes up to each symbol as a number, the symbol in the lowest byte."""
    buffer, lengths = _symbols(texts)
    ends = np.cumsum(lengths + DEPTH)
    owner = np.repeat(ends - lengths - DEPTH, lengths)
    place = owner + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = np.ndarray(len(buffer) - 7, ">u8", buffer=buffer.data, strides=(1,))
    return words[place].astype(np.uint64) >> np.uint64(8 * (8 - DEPTH - 1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _squeeze(plain_bytes: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(plain_bytes)


def _expand(squeezed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(squeezed)


def _pack(grams: np.ndarray) -> bytes:
    """Byte planes of the numbers, highest byte first; sorted numbers so compress well."""
    return _squeeze(np.ascontiguousarray(grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DEPTH - 1 :].T).tobytes())


def _pack_values(values: np.ndarray) -> bytes:
    """Byte planes of single-precision numbers."""
    return _squeeze(np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(planes), np.uint8).reshape(4, -1).T).view("<f4").ravel()


def _unpack(planes: bytes) -> np.ndarray:
    planes = _expand(planes)
    n = len(planes) // (DEPTH + 1)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - DEPTH - 1 :] = np.frombuffer(planes, np.uint8).reshape(DEPTH + 1, n).T
    return wide.view(">u8").ravel().astype(np.uint64)


def _part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """Part of a string by the context of TOP bytes before its symbol."""
    context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1)
    return (((context * np.uint64(40503)) & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def chunks(rows: DataFrame) -> DataFrame:
    """The rows (id, text, held_out), texts compressed, with the chunk they are in, and a row for each chunk with only its strings.

    Such a row holds the distinct strings of all texts of the chunk and how often the training texts hold them.
    """
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = uuid4().int >> 65, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                out = np.array(part.column(2).to_pylist(), bool)
                texts = text_bytes(part.column(1))
                held.append((_grams([t for t, o in zip(texts, out, strict=True) if not o]), True))
                held.append((_grams([t for t, o in zip(texts, out, strict=True) if o]), False))
                size += len(held[-1][0]) + len(held[-2][0])
                nothing = pa.nulls(part.num_rows, pa.binary())
                squeezed = pa.array([_squeeze(t) for t in texts], pa.binary())
                columns = [pa.array([chunk] * part.num_rows, pa.int64()), part.column(0), squeezed, part.column(2), nothing, nothing]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if size >= _FLUSH:
                    yield packed(chunk, held, part.column(0).type)
                    chunk, held, size = uuid4().int >> 65, [], 0
        if size:
            yield packed(chunk, held, part.column(0).type)

    def packed(chunk: int, held: list, id_type: pa.DataType) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate([g for g, _ in held]), return_counts=True)
        unseen = np.concatenate([g for g, learnt in held if not learnt])
        keys, times = np.unique(unseen, return_counts=True)
        counts[np.searchsorted(grams, keys)] -= times
        columns = [pa.array([chunk], pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_())]
        columns += [pa.array([_pack(grams)], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["chunk", "id", "text", "held_out", "grams", "counts"]
    return rows.mapInArrow(work, f"chunk long, id {kind}, text binary, held_out boolean, grams binary, counts binary")


def gram_counts(strings: DataFrame) -> DataFrame:
    """Rows (gram, c): training count of each distinct string of the chunks' (grams, counts), those of none included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for planes, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(packed, "<u4").astype(np.int64)
                keys, counts = _summed(np.concatenate([keys, _unpack(planes)]), np.concatenate([counts, more]))
                if len(keys) >= _HELD:
                    yield rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield rows(keys, counts)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "c"])

    return strings.mapInArrow(work, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- the tree


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after six steps up)."""
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of so many zeros and ones under the Krichevsky-Trofimov estimate."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


def _decisions(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bits): context and first k bits of the symbol (after a leading one), and the symbol's next bit."""
    symbol = gram & np.uint64(255)
    node = (gram & ~np.uint64(255)) | ((symbol | np.uint64(256)) >> np.uint64(8 - k))
    return node, (symbol >> np.uint64(7 - k)) & np.uint64(1)


class Level:
    """Estimates at one depth: for each of the eight decisions its nodes, chances of a one, and shares of the own estimate.

    `weighted` holds the log weighted probability of each node for the depth above.
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, below: "Level | None"):
        """`gram` are sorted distinct (context << 8 | symbol) with counts; `below` is None at the greatest depth."""
        self.depth, self.nodes, self.one, self.own, self.share, self.weighted = depth, [], [], [], [], []
        mask = np.uint64((1 << 8 * (depth + 1)) - 1)
        for k in range(8):
            node, bit = _decisions(gram, k)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
            node = node[first]
            ones = np.add.reduceat(count * bit.astype(float), first) if len(first) else np.empty(0)
            zeros = np.add.reduceat(count.astype(float), first) - ones if len(first) else np.empty(0)
            own = _kt(zeros, ones)
            if below is None:
                weighted, share = own, np.ones(len(own))
            else:
                parent = np.searchsorted(node, below.nodes[k] & mask)
                children = np.bincount(parent, below.weighted[k], len(node)) if len(node) else own
                weighted = np.logaddexp(own, children) - _LN2
                share = np.exp(own - _LN2 - weighted)
            self.nodes.append(node)
            self.one.append((ones + 0.5) / (zeros + ones + 1))
            self.own.append(own)
            self.share.append(share)
            self.weighted.append(weighted)


def levels(gram: np.ndarray, count: np.ndarray, low: int, high: int, below: Level | None = None) -> list[Level]:
    """Levels of depth `low` to `high` from sorted distinct strings of `high` bytes of context and a symbol."""
    found: list[Level] = []
    for depth in range(high, low - 1, -1):
        gram, count = _summed(gram & np.uint64((1 << 8 * (depth + 1)) - 1), count)
        below = Level(gram, count, depth, below)
        found.append(below)
    return found[::-1]


def log10_of(gram: np.ndarray, path: list[Level]) -> np.ndarray:
    """Log10 probability of each string's symbol, mixed over the levels (depth 0 to DEPTH)."""
    total = np.zeros(len(gram))
    for k in range(8):
        one, free, live = np.zeros(len(gram)), np.ones(len(gram)), np.arange(len(gram))
        asked, bit = _decisions(gram, k)
        for level in path:
            node = asked[live] & np.uint64((1 << 8 * (level.depth + 1)) - 1)
            at = np.searchsorted(level.nodes[k], node)
            hit = at < len(level.nodes[k])
            hit[hit] = level.nodes[k][at[hit]] == node[hit]
            live, at = live[hit], at[hit]
            one[live] += free[live] * level.share[k][at] * level.one[k][at]
            free[live] *= 1 - level.share[k][at]
        one += 0.5 * free
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


def top_levels(grams: DataFrame) -> list[Level]:
    """Levels of depth 0 to TOP from rows (part, gram, c): at most 2^16 contexts of TOP bytes reach the driver."""

    def work(table: pa.Table) -> pa.Table:
        gram, count = _learnt(table)
        if not len(gram):
            return pa.table([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 2], names=["k", "nodes", "weighted"])
        root = levels(gram, count, TOP, DEPTH)[0]
        string, times = _summed(gram & np.uint64((1 << 8 * (TOP + 1)) - 1), count)
        rows = [(k, n.tobytes(), w.tobytes()) for k, (n, w) in enumerate(zip(root.nodes, root.weighted, strict=True))]
        rows.append((8, string.tobytes(), times.tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.table(columns, names=["k", "nodes", "weighted"])

    nodes: list[list] = [[np.empty(0, np.uint64)] for _ in range(9)]
    weights: list[list] = [[np.empty(0)] for _ in range(8)] + [[np.empty(0, np.int64)]]
    for row in grams.groupBy("part").applyInArrow(work, "k int, nodes binary, weighted binary").toLocalIterator():
        nodes[row["k"]].append(np.frombuffer(row["nodes"], np.uint64))
        weights[row["k"]].append(np.frombuffer(row["weighted"], np.int64 if row["k"] == 8 else np.float64))
    gram, count = _summed(np.concatenate(nodes[8]), np.concatenate(weights[8]))
    last = Level(gram, count, TOP, None)
    for k in range(8):
        node, weighted = np.concatenate(nodes[k]), np.concatenate(weights[k])
        last.weighted[k] = weighted[np.argsort(node)]
        last.share[k] = np.exp(last.own[k] - _LN2 - last.weighted[k])
    return [*levels(gram, count, 0, TOP - 1, last), last]


def _learnt(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of a part that training texts hold, with counts."""
    gram = table.column("gram").to_numpy().view(np.uint64)
    count = table.column("c").to_numpy()
    return _summed(gram[count > 0], count[count > 0])


def answers(grams: DataFrame, top: list[Level]) -> DataFrame:
    """Rows (part, grams, log10): the probability of every string of the rows (part, gram, c), sorted, packed by part."""
    sent = grams.sparkSession.sparkContext.broadcast(top)

    def work(table: pa.Table) -> pa.Table:
        lower = levels(*_learnt(table), TOP + 1, DEPTH)
        asked = np.sort(table.column("gram").to_numpy().view(np.uint64))
        value = log10_of(asked, [*sent.value, *lower])
        columns = [table.column("part")[:1], pa.array([_pack(asked)], pa.binary()), pa.array([_pack_values(value)], pa.binary())]
        return pa.table(columns, names=["part", "grams", "log10"])

    return grams.groupBy("part").applyInArrow(work, "part int, grams binary, log10 binary")


def chunk_answers(strings: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Rows (chunk, grams, log10) for rows (chunk, grams) and the packed answers of all parts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gram = _unpack(planes)
                part = _part_of(gram, parts)
                gram = gram[np.argsort(part, kind="stable")]
                sizes = np.bincount(part, minlength=parts)
                at = np.cumsum(sizes) - sizes
                on = np.flatnonzero(sizes)
                packs = [_pack(gram[at[p] : at[p] + sizes[p]]) for p in on.tolist()]
                columns = [pa.array(on, pa.int32()), pa.array([chunk] * len(on), pa.int64()), pa.array(packs, pa.binary()), pa.nulls(len(on), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "grams", "log10"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.uint64), np.empty(0, "<f4")
        for batch in batches:
            rows = []
            for _, chunk, planes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed is not None:  # the part's answers stand before its questions
                    keys, values = _unpack(planes), _unpack_values(packed)
                else:
                    rows.append((chunk, planes, _pack_values(values[np.searchsorted(keys, _unpack(planes))])))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["chunk", "grams", "log10"])

    asked = strings.mapInArrow(split, "part int, chunk long, grams binary, log10 binary")
    given = known.select("part", F.lit(None).cast("long").alias("chunk"), "grams", "log10")
    met = given.union(asked).repartition("part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first())
    return met.mapInArrow(answer, "chunk long, grams binary, log10 binary")


def text_log10(texts: list[bytes], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, symbols) of each text, given those of all its strings."""
    gram, lengths = _grams(texts), np.array([len(b" ".join(plain(t))) + 1 for t in texts], np.int64)
    value = np.empty(len(gram), np.float32)
    for at in range(0, len(gram), _PIECE):
        value[at : at + _PIECE] = values[np.searchsorted(keys, gram[at : at + _PIECE])]
    ends = np.cumsum(lengths)
    return np.array([float(value[e - n : e].sum(dtype=np.float64)) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]), lengths


# ---------------------------------------------------------------- words and scores


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over all texts of a one-column frame, counted in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for text in text_bytes(batch.column(0).slice(at, _ROWS)):
                    held.update(plain(text))
                    held[b"\n"] += 1  # the end; no word holds a line feed
                if len(held) > _ROWS << 10:
                    yield packed(held)
                    held = Counter()
        if held:
            yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])

    return texts.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one per input row.

    Learns from the rows that are not held out. A null text is empty: one token, its end. A null id counts
    as the empty string for the fold. Repeated rows are learnt from again and scored each. An empty table
    gives an empty result; without training rows all estimates are those of no data. Other columns are
    ignored. Words with a share of WORD_SHARE or more of the training tokens (a bounded number) are looked up
    in the worker, all others are joined.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    words = materialise(word_counts(rows.where(~F.col("held_out")).select("text")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = sums["n"], sums["v"]
    limit = max(1, int(tokens * WORD_SHARE))
    common = {bytes(r["word"]): r["c"] for r in words.where(F.col("c") > limit).toLocalIterator()}
    sent = docs.sparkSession.sparkContext.broadcast(common)

    dealt = materialise(chunks(rows), "chunks")
    strings = dealt.where("grams is not null")
    counted = materialise(gram_counts(strings.select("grams", "counts")), "grams")
    parts = min(1 << 8 * TOP, max(64, counted.count() // PART))
    context = F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 8 * TOP) - 1)
    placed = counted.withColumn("part", F.shiftrightunsigned((context * 40503).bitwiseAND(0xFFFF) * parts, 16).cast("int"))
    known = answers(placed, top_levels(placed))
    told = chunk_answers(strings.select("chunk", "grams"), known, parts)
    nothing = F.lit(None)
    rows = told.select("chunk", nothing.cast(dict(rows.dtypes)["id"]).alias("id"), nothing.cast("binary").alias("text"), nothing.cast("boolean").alias("held_out"), "grams", "log10").union(
        dealt.where("grams is null").select("chunk", "id", "text", "held_out", nothing.cast("binary"), nothing.cast("binary"))
    )
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("grams").isNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, values = None, [], np.empty(0, np.uint64), np.empty(0, "<f4")
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            question = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            turn = np.flatnonzero((chunk[1:] != chunk[:-1]) | (question[1:] != question[:-1])) + 1
            for at, to in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
                part = batch.slice(at, to - at)
                if at < to and not question[at]:
                    if chunk[at] != now:
                        now, held = chunk[at], []
                    packs = zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)
                    held += [(_unpack(planes), _unpack_values(packed)) for planes, packed in packs]
                    continue
                if held:
                    keys = np.concatenate([k for k, _ in held])
                    order = np.argsort(keys)
                    keys, values, held = keys[order], np.concatenate([v for _, v in held])[order], []
                for row in range(0, part.num_rows, _ROWS):
                    yield scored(part.slice(row, _ROWS), sent.value, keys, values)

    def scored(batch: pa.RecordBatch, known: dict[bytes, int], keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        texts = [_expand(t) for t in batch.column(2).to_pylist()]
        value, symbols = text_log10(texts, keys, values)
        n_tokens, n_common, log_common, rare, times = [], [], [], [], []
        for text in texts:
            held = Counter(plain(text))
            held[b"\n"] = 1
            n_tokens.append(held.total())
            found = [(known[w], n) for w, n in held.items() if w in known]
            n_common.append(sum(n for _, n in found))
            log_common.append(float(np.dot(np.log10(np.array([c for c, _ in found]) + 0.5), [n for _, n in found])) if found else 0.0)
            rest = [(w, n) for w, n in held.items() if w not in known]
            rare.append([w for w, _ in rest])
            times.append([n for _, n in rest])
        columns = [
            batch.column(1),
            batch.column(3),
            pa.array(n_tokens, pa.int64()),
            pa.array(n_common, pa.int64()),
            pa.array(log_common, pa.float64()),
            pa.array(value, pa.float64()),
            pa.array(symbols, pa.int64()),
            pa.array(rare, pa.list_(pa.binary())),
            pa.array(times, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "held_out", "n_tokens", "n_common", "log_common", "score", "symbols", "rare", "times"]
    kind = f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_common long, log_common double, score double, symbols long, rare array<binary>, times array<long>"
    found = materialise(rows.mapInArrow(work, kind).withColumn("row", F.monotonically_increasing_id()), "scored")
    loose = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    seen = words.where(F.col("c") <= limit)
    summed = (
        loose.join(seen, "word", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    )
    scale = float(np.log10(tokens + 0.5 * (kinds + 1)))
    return found.drop("rare", "times").join(summed, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_common") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2.0))) / F.col("symbols")).alias("bits_per_byte"),
    )
