"""Removal of passages that start in a document with a smaller id, by a distributed sparse suffix array.

A passage is a string of `width` bytes. Every window of that width is led by its leading token: the
k-byte string of least hash inside it, which equal windows share. So suffixes need to be compared only
from their leading tokens on, about one suffix in fourteen.

1. Texts are dealt into blocks; copies of a text are one entry with the least id. The blocks are written
   once as a bucketed table, so that later steps read them without a shuffle.
2. Each block sends the hashes of its leading tokens, once each, to parts by hash. A part answers which
   of them stand in two or more documents. All others cannot hold a repeated passage.
3. For the rest, a block folds equal stretches of windows led by one token: those of its least document go
   on, the others are lost whatever stands elsewhere. Sampled splitters cut the leading tokens into ranges,
   a bucket each; windows whose leading bytes fill whole ranges are shared out one by one, by their own
   hash. A bucket joins equal stretches, then sorts the windows of the different ones by multikey
   quicksort (three-way partitions on characters of eight bytes), leaving out groups that can no longer
   meet in two documents. Suffixes in two ranges differ in their first eight bytes, so the neighbours at
   a boundary share no window and there is nothing to hand over.
4. Each block gets back the windows to remove and cuts them out.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotecurve.llm.common import ensure_checkpoint_dir, materialise, total_text_bytes
from quotecurve.session import discard

WIDTH = 50
TOKEN = 24  # bytes of a leading token
BLOCK_BYTES = 4 << 20  # text of a block
PART_BYTES = 32 << 20  # text whose leading tokens one part compares
MAX_FILES = 50_000  # buckets of the table of blocks; one bucket holds several blocks beyond that
_STRETCH = 64  # windows of a stretch, one bit each
_PIECE = 1 << 17  # windows hashed at once
_SAMPLES = 256  # leading tokens that a block adds to the sample
RANGES = 4096  # ranges of leading tokens, at most; beyond that a range is several buckets
_KEY_BYTES = 7  # 48 bits of a token's hash, and whether the block holds it twice
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(buffer: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from each place of a byte array as one number."""
    return np.ndarray(len(buffer) - 7, dtype, buffer=buffer.data, strides=(1,))


def _token_hashes(buffer: np.ndarray) -> np.ndarray:
    words = _words(buffer).astype(np.uint64)
    n = len(buffer) - TOKEN + 1
    value = words[:n] * _MULTIPLIERS[0]
    for k in range(1, TOKEN // 8):
        value += words[8 * k : 8 * k + n] * _MULTIPLIERS[k]
        value ^= value >> np.uint64(29)
    value *= _MULTIPLIERS[3]
    value ^= value >> np.uint64(32)
    return value


def _window_keys(buffer: np.ndarray, width: int) -> np.ndarray:
    """Hash of the leading token of each window."""
    n = len(buffer) - width + 1
    keys = np.empty(max(n, 0), np.uint64)
    span = width - TOKEN + 1
    for at in range(0, n, _PIECE):
        low = _token_hashes(buffer[at : min(at + _PIECE, n) + width - 1])
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = span - reach
        keys[at : at + _PIECE] = np.minimum(low[: len(low) - rest], low[rest:])
    return keys


class _Block:
    """The different texts of a block in the order of their digests, joined into one byte array."""

    def __init__(self, table: pa.Table, width: int):
        texts: dict[bytes, bytes] = {}
        least: dict[bytes, int] = {}
        rows = zip(*(table.column(c).to_pylist() for c in ("sha", "id", "body")), strict=True)
        for sha, number, body in rows:
            least[sha] = min(number, least.get(sha, number))
            if body is not None:
                texts[sha] = body
        self.width = width
        self.shas = sorted(texts)
        self.ids = np.array([least[sha] for sha in self.shas], np.int64)
        self.sizes = np.array([len(texts[sha]) for sha in self.shas], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buffer = np.frombuffer(b"".join(texts[sha] for sha in self.shas), np.uint8)

    def stretches(self) -> tuple[np.ndarray, ...]:
        """(first window, windows, document, key): runs of at most 64 windows led by one token."""
        keys = _window_keys(self.buffer, self.width)
        n = len(keys)
        begins = self.ends - self.sizes
        fresh = np.empty(n, bool)
        fresh[:1] = True
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[begins] = True
        crossing = (self.ends - self.width + 1)[:-1]  # windows from here on reach into the next text
        fresh[crossing] = True
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, n))
        owner = np.searchsorted(self.ends, start, side="right")
        inside = start + self.width <= self.ends[owner]
        start, count, owner = start[inside], count[inside], owner[inside]
        pieces = -(-count // _STRETCH)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, owner = np.repeat(start, pieces) + step * _STRETCH, np.repeat(owner, pieces)
        count = np.minimum(np.repeat(count, pieces) - step * _STRETCH, _STRETCH)
        return start, count, owner, keys[start]

    def leading(self, start: np.ndarray, key: np.ndarray) -> np.ndarray:
        """First eight bytes of the token that leads each window, as a number in the order of the bytes."""
        words = _words(self.buffer, ">u8")
        out = np.empty(len(start), np.int64)
        for at in range(0, len(start), _PIECE // 8):
            part = slice(at, at + _PIECE // 8)
            window = start[part, None] + np.arange(self.width)
            place = _row_token_hashes(self.buffer[window]) == key[part, None]
            out[part] = (words[start[part] + place.argmax(axis=1)] >> np.uint64(1)).astype(np.int64)
        return out


def _row_token_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of all tokens of each row of bytes."""
    flat = _token_hashes(np.ascontiguousarray(rows).reshape(-1))
    width = rows.shape[1]
    padded = np.append(flat, np.zeros(TOKEN - 1, np.uint64))
    return padded.reshape(-1, width)[:, : width - TOKEN + 1]


def _spread(key: np.ndarray) -> np.ndarray:
    """A second mixing: least hashes are small, these are even."""
    value = key * _MULTIPLIERS[1]
    value ^= value >> np.uint64(31)
    return value * _MULTIPLIERS[2]


def _part(spread: np.ndarray, parts: int) -> np.ndarray:
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _short(spread: np.ndarray) -> np.ndarray:
    return spread & np.uint64((1 << 48) - 1)


def _pack(values: np.ndarray, width: int = _KEY_BYTES) -> bytes:
    """Sorted numbers as planes of bytes, which compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int = _KEY_BYTES) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _window_hashes(buffer: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hash of the whole window at each place."""
    words, value = _words(buffer), np.zeros(len(start), np.uint64)
    for step in _steps(width):
        value = (value ^ words[start + step]) * _MULTIPLIERS[1]
        value ^= value >> np.uint64(31)
    return value * _MULTIPLIERS[2]


def _steps(width: int) -> list[int]:
    """Places of the eight-byte characters of a window; the last may overlap the one before."""
    return [*range(0, width - 8, 8), width - 8]


def _slices(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(group, slice) of the runs of a sorted array."""
    if not len(groups):
        return
    edges = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    for low, high in zip(edges.tolist(), np.append(edges[1:], len(groups)).tolist(), strict=True):
        yield int(groups[low]), slice(low, high)


def _tokens_of_block(width: int, parts: int):
    def work(table: pa.Table) -> pa.Table:
        block = _Block(table, width)
        number = table.column("block")[0].as_py()
        start, _, owner, key = block.stretches()
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_owner = key[order], owner[order]
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        several = np.maximum.reduceat(sorted_owner, first) != np.minimum.reduceat(sorted_owner, first)
        spread = _spread(sorted_key[first])
        code = (_short(spread) << np.uint64(1)) | several.astype(np.uint64)
        part = _part(spread, parts)
        order = np.lexsort((code, part))
        code, part = code[order], part[order]
        rows = [(p, number, _pack(code[s]), None) for p, s in _slices(part)]
        some = np.linspace(0, len(start) - 1, _SAMPLES).astype(np.int64)
        rows.append((-1, number, b"", block.leading(start[some], key[some]).tolist()))
        return _table(rows, _TOKENS)

    return work


_TOKENS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("sample", pa.list_(pa.int64()))])
_SHARED = pa.schema([("block", pa.int32()), ("keys", pa.binary())])
_CONTEXTS = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int32()), ("bytes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())]
)
_CUTS = pa.schema([("block", pa.int32()), ("places", pa.binary()), ("masks", pa.binary())])
_CLEAN = pa.schema(
    [("sha", pa.binary()), ("first_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _shared_tokens(table: pa.Table) -> pa.Table:
    """Of one part: for each block its tokens that stand in two or more documents."""
    codes = [_unpack(k) for k in table.column("keys").to_pylist()]
    block = np.repeat(table.column("block").to_numpy(), [len(c) for c in codes])
    code = np.concatenate(codes)
    order = np.argsort(code >> np.uint64(1), kind="stable")
    key, several, block = code[order] >> np.uint64(1), (code[order] & np.uint64(1)) == 1, block[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    shared = (size > 1) | np.logical_or.reduceat(several, first)
    keep = np.repeat(shared, size)
    key, block = key[keep], block[keep]
    order = np.argsort(block, kind="stable")
    key, block = key[order], block[order]
    return _table([(b, _pack(key[s], 6)) for b, s in _slices(block)], _SHARED)


def _first_of_each(texts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Which entries belong to the least id among those of equal text."""
    seen: dict[bytes, int] = {}
    same = np.array([seen.setdefault(text, len(seen)) for text in texts], np.int64)
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    return ids == least[same]


def _full_masks(count: np.ndarray) -> np.ndarray:
    return ~np.uint64(0) >> (np.uint64(_STRETCH) - count.astype(np.uint64))


def _contexts_of_block(width: int, splitters: np.ndarray, buckets: int):
    """Stretches by bucket; under a bucket of its own, below zero, what a block's copies lose by themselves."""
    per_range = -(-buckets // (len(splitters) + 1))

    def work(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(shared) or not len(texts):
            return _table([], _CONTEXTS)
        block = _Block(texts, width)
        number = texts.column("block")[0].as_py()
        wanted = np.sort(np.concatenate([_unpack(k, 6) for k in shared.column("keys").to_pylist()]))
        start, count, owner, key = block.stretches()
        spread = _spread(key)
        short = _short(spread)
        at = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
        on = wanted[at] == short
        start, count, ids, key, spread = start[on], count[on], block.ids[owner[on]], key[on], spread[on]
        whole = block.buffer.tobytes()
        ends = (start + count + width - 1).tolist()
        first = _first_of_each([whole[x:y] for x, y in zip(start.tolist(), ends, strict=True)], ids)
        rows = []
        if not first.all():
            lost = start[~first].astype("<u4").tobytes()
            rows.append((-1 - number, number, b"", _full_masks(count[~first]).astype("<u8").tobytes(), b"", lost))
        start, count, ids, key, spread = start[first], count[first], ids[first], key[first], spread[first]
        lead = block.leading(start, key)
        low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
        bucket = low * per_range + ((spread >> np.uint64(8)) % np.uint64(per_range)).astype(np.int64)
        hot = high - low > 1  # these leading bytes fill a range of their own
        times = np.where(hot, count, 1)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(hot, times)
        start, ids = np.repeat(start, times) + inner, np.repeat(ids, times)
        count, bucket = np.where(single, 1, np.repeat(count, times)), np.repeat(bucket, times)
        bucket[single] = (_window_hashes(block.buffer, start[single], width) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, s in _slices(bucket[order]):
            take = order[s]
            begin, end = start[take].tolist(), (start[take] + count[take] + width - 1).tolist()
            text = b"".join([whole[x:y] for x, y in zip(begin, end, strict=True)])
            rows.append(
                (b, number, text, count[take].astype(np.uint8).tobytes(), ids[take].tobytes(), start[take].astype("<u4").tobytes())
            )
        return _table(rows, _CONTEXTS)

    return work


def _least_by_window(buffer: np.ndarray, places: np.ndarray, group: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Least id over all equal windows, for each window: multikey quicksort on eight-byte characters.

    `group` is sorted and tells windows apart that cannot be equal. All groups go through a partition at
    once: windows whose character is below, at or above that of the group's pivot. The middle part goes on
    with the next character, the outer ones with the same. Groups that hold one id only drop out.
    """
    best = ids.copy()
    words, steps = _words(buffer, ">u8"), np.array(_steps(width))
    active, depth = np.arange(len(places)), np.zeros(len(places), np.int64)
    fresh = np.append(True, group[1:] != group[:-1])[: len(places)]
    turn = 0
    while len(active):
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(active)))
        low, high = np.minimum.reduceat(ids[active], first), np.maximum.reduceat(ids[active], first)
        sorted_out = depth[first] == len(steps)
        done = np.repeat(sorted_out, size)
        best[active[done]] = np.repeat(low, size)[done]
        going = np.repeat((low != high) & ~sorted_out, size)
        active, depth, fresh = active[going], depth[going], fresh[going]
        if not len(active):
            break
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(active)))
        char = words[places[active] + steps[depth]].astype(np.uint64)
        turn += 1
        pivot = np.repeat(char[first + _draws(first, turn) % size], size)
        side = (char >= pivot).astype(np.int8) + (char > pivot)
        # stable places of the three parts of each group
        home, place, filled = np.repeat(first, size), np.empty(len(active), np.int64), np.zeros(len(first), np.int64)
        opens = np.zeros(len(active) + 1, bool)
        for part in range(3):
            mine = side == part
            before = np.cumsum(mine) - mine
            rank = before - before[home]
            place[mine] = (home + np.repeat(filled, size) + rank)[mine]
            opens[first + filled] = True
            filled = filled + np.add.reduceat(mine.astype(np.int64), first)
        moved = np.empty_like(active)
        moved[place] = active
        deeper = np.empty_like(depth)
        deeper[place] = depth + (side == 1)
        active, depth, fresh = moved, deeper, opens[:-1]
    return best


def _draws(places: np.ndarray, turn: int) -> np.ndarray:
    """Numbers that pick pivots, other ones each turn."""
    value = (places.astype(np.uint64) + np.uint64(turn)) * _MULTIPLIERS[0]
    return ((value ^ (value >> np.uint64(29))) >> np.uint64(8)).astype(np.int64) & 0x7FFFFFFF


def _compare_bucket(width: int):
    def work(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["block", "places", "counts"]).rename_columns(["block", "places", "masks"])
        data = b"".join(table.column("bytes").to_pylist())
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), "<u4")
        per_row = [len(c) for c in table.column("counts").to_pylist()]
        block = np.repeat(table.column("block").to_numpy(), per_row)
        ends = np.cumsum(count + width - 1)
        begins = ends - (count + width - 1)
        seen: dict[bytes, int] = {}
        same = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids)
        _, example = np.unique(same, return_index=True)
        # windows of different stretches with one leading token
        buffer = np.frombuffer(data, np.uint8)
        key = _window_keys(buffer, width)[begins[example]]
        _, token, tally = np.unique(key, return_inverse=True, return_counts=True)
        varied = np.flatnonzero(tally[token] > 1)
        varied = varied[np.argsort(token[varied], kind="stable")]
        n_windows = count[example[varied]]
        offset = np.zeros(len(seen), np.int64)
        offset[varied] = np.cumsum(n_windows) - n_windows
        inner = np.arange(n_windows.sum()) - np.repeat(offset[varied], n_windows)
        places = np.repeat(begins[example[varied]], n_windows) + inner
        by_window = _least_by_window(buffer, places, np.repeat(token[varied], n_windows), np.repeat(least[varied], n_windows), width)
        # what each stretch loses
        mask = np.where(least[same] < ids, _full_masks(count), np.uint64(0))
        partly = np.zeros(len(seen), bool)
        partly[varied] = True
        open_rows = np.flatnonzero(partly[same] & (mask == 0))
        reps = count[open_rows]
        bit = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        lost = by_window[np.repeat(offset[same[open_rows]], reps) + bit] < np.repeat(ids[open_rows], reps)
        bits = np.where(lost, np.uint64(1) << bit.astype(np.uint64), np.uint64(0))
        if len(open_rows):
            mask[open_rows] = np.bitwise_or.reduceat(bits, np.cumsum(reps) - reps)
        hit = np.flatnonzero(mask)
        hit = hit[np.argsort(block[hit], kind="stable")]
        rows = [(b, place[hit[s]].tobytes(), mask[hit[s]].tobytes()) for b, s in _slices(block[hit])]
        return _table(rows, _CUTS)

    return work


def _cut_block(width: int, whole_characters: bool):
    def work(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        if not len(texts):
            return _table([], _CLEAN)
        block = _Block(texts, width)
        gone = np.zeros(len(block.buffer) + 1, np.int32)
        if len(cuts):
            place = np.frombuffer(b"".join(cuts.column("places").to_pylist()), "<u4").astype(np.int64)
            mask = np.frombuffer(b"".join(cuts.column("masks").to_pylist()), "<u8")
            for bit in range(_STRETCH):
                at = place[(mask >> np.uint64(bit)) & np.uint64(1) == 1] + bit
                gone[at] += 1  # each window is in one stretch, so no place comes twice
                gone[at + width] -= 1
        removed = np.cumsum(gone[:-1]) > 0
        begins = block.ends - block.sizes
        opening = removed.copy()
        opening[1:] &= ~removed[:-1]
        opening[begins] = removed[begins]
        total, spans = np.append(0, np.cumsum(removed)), np.append(0, np.cumsum(opening))
        rows = []
        for k, (low, high) in enumerate(zip(begins.tolist(), block.ends.tolist(), strict=True)):
            n = int(total[high] - total[low])
            kept = block.buffer[low:high] if not n else block.buffer[low:high][~removed[low:high]]
            left = kept.tobytes()
            if whole_characters and n:
                left = left.decode("utf-8", "ignore").encode()
            rows.append((block.shas[k], int(block.ids[k]), n, int(spans[high] - spans[low]), left))
        return _table(rows, _CLEAN)

    return work


def _fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first copy of each text with its body; at the end, without body, lower ids that came later."""
    shown: dict[bytes, tuple[int, int]] = {}
    lower: dict[bytes, tuple[int, int]] = {}
    names = ["block", "sha", "id", "body"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.binary()]
    for batch in batches:
        keep = []
        columns = (batch.column(k).to_pylist() for k in range(3))
        for row, (block, sha, number) in enumerate(zip(*columns, strict=True)):
            if sha not in shown:
                shown[sha] = (number, block)
                keep.append(row)
            elif number < lower.get(sha, shown[sha])[0]:
                lower[sha] = (number, block)
        taken = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column(k).cast(t) for k, t in enumerate(types)], names=names)
    rows = [(block, sha, number, None) for sha, (number, block) in lower.items()]
    yield from _table(rows, pa.schema(list(zip(names, types, strict=True)))).to_batches()


def _blocks(keyed: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """The different texts, dealt into blocks, as a bucketed table in the shared folder."""
    spark: SparkSession = keyed.sparkSession
    block = F.pmod(F.xxhash64("sha"), F.lit(n_blocks)).cast("int")
    folded = keyed.select(block.alias("block"), "sha", "id", F.col("body").cast("binary").alias("body"))
    folded = folded.mapInArrow(_fold_copies, "block int, sha binary, id long, body binary")
    n_files = min(n_blocks, MAX_FILES)
    (
        folded.repartition(n_files, "block")
        .write.bucketBy(n_files, "block")
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return spark.table(name)


def repeats_cut(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, whole_characters: bool = False
) -> DataFrame:
    """Rows (sha, first_id, n_removed, n_spans, kept), one for each different text of at least `width` bytes.

    `sha` is the SHA-256 of the text, `first_id` the least id that has it, `kept` the bytes that stay;
    with `whole_characters` the rest of a character that was cut in two goes too.
    Copies of the text with a greater id lose all their bytes. Rows with a null id or a shorter text are
    not in the result: nothing is removed from them, and they remove nothing elsewhere.
    """
    return _repeats_cut(docs, id_col, text_col, width, whole_characters, f"suffix_blocks_{uuid.uuid4().hex}")


def _repeats_cut(docs: DataFrame, id_col: str, text_col: str, width: int, whole_characters: bool, name: str) -> DataFrame:
    if width < TOKEN + 8:
        raise ValueError(f"width must be at least {TOKEN + 8}")
    keyed = _keyed(docs, id_col, text_col).where((F.col("n_bytes") >= width) & F.col("id").isNotNull())
    total = total_text_bytes(keyed, "body")
    n_blocks, n_parts = -(-total // BLOCK_BYTES) or 1, -(-total // PART_BYTES) or 1
    blocks = _blocks(keyed, n_blocks, name)
    tokens = materialise(blocks.groupBy("block").applyInArrow(_tokens_of_block(width, n_parts), _ddl(_TOKENS)), "tokens")
    n_ranges = min(n_blocks, RANGES)
    cuts = [k / n_ranges for k in range(1, n_ranges)]
    sample = tokens.where("part < 0").select(F.explode("sample").alias("lead"))
    # finer than the ranges, so that splitters differ; at most RANGES numbers come to the driver
    sketch = F.percentile_approx("lead", cuts, F.lit(20 * RANGES))
    splitters = sample.agg(sketch.alias("s")).first()["s"] if cuts else []
    splitters = np.array(splitters or [], np.int64)
    shared = tokens.where("part >= 0").groupBy("part").applyInArrow(_shared_tokens, _ddl(_SHARED))
    by_block = blocks.groupBy("block")
    contexts = by_block.cogroup(shared.groupBy("block")).applyInArrow(_contexts_of_block(width, splitters, n_blocks), _ddl(_CONTEXTS))
    cut = contexts.groupBy("bucket").applyInArrow(_compare_bucket(width), _ddl(_CUTS))
    return by_block.cogroup(cut.groupBy("block")).applyInArrow(_cut_block(width, whole_characters), _ddl(_CLEAN))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes")
    )


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), one per input row.

    Removed is each byte covered by a string of `width` bytes that also starts in a document with a smaller
    id, judged on the input. A null text is empty; nothing is removed from a row with a null id, and it
    removes nothing elsewhere. Rows with equal ids do not touch each other; repeated rows are returned
    each. Ids are integers. An empty table gives an empty result; other columns are ignored.
    """
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    clean = _repeats_cut(docs, id_col, text_col, width, False, name).select(
        "sha", "first_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
    clean = materialise(clean, "clean")
    spark = docs.sparkSession
    spark.sql(f"DROP TABLE {name}")  # an external table: its files go by themselves
    discard(spark, f"{ensure_checkpoint_dir(spark)}/{name}")
    rows = _keyed(docs, id_col, text_col).drop("body").join(clean, "sha", "left")
    first, copy = F.col("id") == F.col("first_id"), F.col("id") > F.col("first_id")
    return rows.select(
        "id",
        "n_bytes",
        F.when(first, F.col("n_removed")).when(copy, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(first, F.col("n_spans")).when(copy, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(first, F.col("kept_sha256")).when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """`docs` with removed passages cut out of the text; rows whose whole text went are dropped.

    Bytes of a character that was cut in two are dropped with it. All other columns are kept.
    """
    clean = repeats_cut(docs, id_col, text_col, width, whole_characters=True)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out_of_reach = F.col(id_col).isNull() | (F.octet_length(body) < width)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    reached = docs.where(~out_of_reach).select(F.struct(*rest).alias("doc"), F.unhex(F.sha2(body, 256)).alias("sha"))
    cut = reached.join(clean.select("sha", "first_id", "kept"), "sha").where(
        (F.col("doc").getField(id_col) == F.col("first_id")) & (F.octet_length("kept") > 0)
    )
    columns = [F.col("kept").cast("string") if c == text_col else F.col("doc").getField(c) for c in docs.columns]
    return docs.where(out_of_reach).union(cut.select(*[x.alias(c) for x, c in zip(columns, docs.columns, strict=True)]))
