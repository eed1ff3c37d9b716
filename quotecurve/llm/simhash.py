"""SimHash fingerprints, and near duplicates by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree on at least `keep` of `radius + keep` bit
fields, so each fingerprint is filed once under every choice of `keep` fields. Inside a file entry
("cell") the fingerprints are laid out as vertical bit planes, 64 members to a word. A query adds the
planes of its difference to carry-save counters, 64 distances at a time, and a block is abandoned as
soon as all its distances exceed the radius.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import components, materialise, text_bytes

SEED = 42
SHINGLE = 3
RADIUS = 3
KEEP = 2  # bit fields a pair must share to meet in a cell
CELL = 4096  # fingerprints of one side of a cell; larger ones are cut into pairs of parts
_BITS = 64
_STEP = 8  # planes between two looks for blocks to abandon
_PAIRS = 1 << 16  # query-block pairs handled at once
_ROWS = 256
_ONES = np.array([(1 << k) - 1 for k in range(_BITS + 1)], dtype=np.uint64)


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingle hashes."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    counts = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _PAIRS):
        part = slice(at, at + _PAIRS)
        spans = zip(starts[part].tolist(), ends[part].tolist(), strict=True)
        hashes = np.array([digest(line[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp), one per input row; fp is the 64 bits as a signed long, 0 for null or wordless texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.column(1).slice(at, _ROWS) for at in range(0, batch.num_rows, _ROWS))
            values = [text_fingerprint(text, shingle) for part in parts for text in text_bytes(part)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: planes[block, bit] holds bit of 64 members."""
    blocks = -(-len(fp) // _BITS)
    padded = np.zeros(blocks * _BITS, dtype="<u8")
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, _BITS, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(blocks, _BITS)


def _near(fp: np.ndarray, planes: np.ndarray, row: np.ndarray, block: np.ndarray, last: np.ndarray, radius: int):
    """Pairs (row, later row of the same cell) within the radius, for the given query-block pairs."""
    base = block * _BITS
    alive = _ONES[np.clip(last[row] + 1 - base, 0, _BITS)] & ~_ONES[np.clip(row + 1 - base, 0, _BITS)]
    width = radius.bit_length()
    start = (1 << width) - 1 - radius  # so that the counter runs over exactly beyond the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(len(row), full if start >> c & 1 else np.uint64(0), np.uint64) for c in range(width)]
    for bit in range(_BITS):
        asked = np.uint64(0) - ((fp[row] >> np.uint64(bit)) & np.uint64(1))
        carry = planes[block, bit] ^ asked
        for c in range(width):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        alive &= ~carry
        if bit % _STEP == _STEP - 1:
            on = alive != 0
            if not on.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if not on.all():
                row, block, alive = row[on], block[on], alive[on]
                counters = [c[on] for c in counters]
    members = alive.astype("<u8").view(np.uint8).reshape(-1, 8)
    hit, member = np.nonzero(np.unpackbits(members, axis=1, bitorder="little"))
    return row[hit], block[hit] * _BITS + member


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the sets of a[i] and b[i]; root[] points straight at the smallest row of each set."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, in each cell, all fingerprints within the radius of each other, directly or in steps.

    `cell` is sorted. At most one link per row is returned, never all pairs.
    """
    n = len(fp)
    change = np.flatnonzero(cell[1:] != cell[:-1])
    ends = np.append(change, n - 1)
    last = np.repeat(ends, np.diff(np.append(-1, ends)))
    planes = _planes(fp)
    rows = np.flatnonzero(last > np.arange(n))
    spans = last[rows] // _BITS - (rows + 1) // _BITS + 1
    done = np.cumsum(spans)
    root = np.arange(n)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _PAIRS)))
        row, span = rows[at:to], spans[at:to]
        query = np.repeat(row, span)
        step = np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
        a, b = _near(fp, planes, query, (query + 1) // _BITS + step, last, radius)
        _join(root, a, b)
        at = to
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def _fields(count: int) -> list[tuple[int, int]]:
    """(shift, width) of `count` fields that cut 64 bits as evenly as possible."""
    edges = [_BITS * k // count for k in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose closure joins all pairs within the radius.

    `fps` has a column fp without repeats. Cells with more than CELL members are dealt as pairs of parts,
    so no task gets an unbounded cell and no pair is left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([held_cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            held_cell, held_fp = cell[cut:], fp[cut:]
            yield links(cell[:cut], fp[:cut])
        yield links(held_cell, held_fp)

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = cell_links(cell, fp, radius) if len(fp) > 1 else (fp[:0], fp[:0])
        arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    fields = _fields(radius + keep)

    def key(choice: tuple[int, ...]):
        parts = [F.shiftrightunsigned("fp", fields[f][0]).bitwiseAND((1 << fields[f][1]) - 1) for f in choice]
        return F.xxhash64(F.lit(sum(1 << f for f in choice)), *parts)

    filed = fps.select("fp", F.explode(F.array(*[key(c) for c in combinations(range(radius + keep), keep)])).alias("entry"))
    sizes = filed.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    cells = (
        filed.join(sizes, "entry")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .where("parts = 1 or own <> other")
        .select(F.xxhash64("entry", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
        .repartition("cell")
        .sortWithinPartitions("cell")
    )
    return cells.mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per input row.

    Texts are linked when their fingerprints differ in at most `radius` bits; component_id is the smallest
    id reachable by links, the row's own included. Null and wordless texts have fingerprint zero and are
    linked like any other. A null id is never a component_id unless all ids of the component are null.
    Rows repeated in the input are repeated in the output; an empty table gives an empty one; other
    columns are ignored. Equal fingerprints are one node, so a group of copies costs one comparison.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("fp", "component_id")
    return found.join(answer, "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay when one document of each near-duplicate group stays: that with the least id.

    Rows with a null id belong to no group that could be named, so they stay. All columns are kept.
    """
    gone = near_duplicates(docs, id_col, text_col).where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
