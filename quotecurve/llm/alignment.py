"""Alignment of the tokens of two tokenizers by merge paths over their end offsets.

The texts of a chunk lie end to end, so their A ends and B ends are two sorted lists over the same bytes.
Diagonals of the merge grid, found by binary searches all at once, cut the merging of the two lists into
pieces of equal work that need nothing of one another. A piece emits an overlap for each distinct end (the A
and the B token that cover the bytes before it) and a cut where both lists end. A group that reaches over
pieces is stitched from the cuts around it.

Document counts of id pairs are summed by Spark over the chunks' own counts, and the counts go back to the
chunks that hold a pair. Chunks keep their documents as packed indexes into their list of pairs.
"""

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.bpe import byte_letters
from quotecurve.llm.common import materialise, text_bytes

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20  # texts of a chunk, about; a longer text is a chunk of its own
WORK = 1 << 16  # ends that a piece merges
_SPACE = "▁"  # U+2581, which stands for a space in pieces


def default_path(name: str) -> str:
    """Place of a public vocabulary installed on the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- tokenizers ------------------------------------------------------------------------------------------


class Pair:
    """Tokenizer A (byte-level BPE in JSON) and B (a sentencepiece model), built from their files' bytes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.files = (a_file, b_file)
        self.opened = False

    def __getstate__(self) -> tuple:
        return self.files

    def __setstate__(self, files: tuple) -> None:
        self.files = files
        self.opened = False

    def open(self) -> None:
        """Tables of token bytes and the encoders; once in a worker."""
        if self.opened:
            return
        import sentencepiece
        import tiktoken
        import tokenizers

        data = json.loads(self.files[0])
        vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
        bytes_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        special = {t["content"] for t in data["added_tokens"]}
        token = {t: b"".join(map(bytes_of.get, t)) for t in vocabulary if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        found = [vocabulary[a + b] for a, b in pairs]
        plain = data["normalizer"] is None and data["pre_tokenizer"]["type"] == "ByteLevel" and not data["pre_tokenizer"]["add_prefix_space"]
        if data["model"]["type"] != "BPE" or not plain or found != sorted(found):
            raise ValueError("tokenizer A is not a byte-level BPE vocabulary whose ids follow its merges")
        self.a_bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for t, value in token.items():
            self.a_bytes[vocabulary[t]] = value
        import public_tokenizers

        self.a = tiktoken.Encoding(
            "a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: vocabulary[t] for t, v in token.items()}, special_tokens={}
        )
        self.slow = tokenizers.Tokenizer.from_str(self.files[0].decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.files[1])
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(_SPACE, " ").encode()
            for k, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]
        self.a_length = np.array([*map(len, self.a_bytes)], np.int64)
        self.b_length = np.array([*map(len, self.b_bytes)], np.int64)
        self.opened = True

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B, both empty where the joined bytes are not a space and the text."""
        if not text:
            return [], []
        whole = " " + text
        try:
            a = self.a.encode_ordinary(whole)
        except Exception:  # the fast encoder gives up on some very long runs of one kind of character
            a = self.slow.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = whole.encode()
        if b"".join([self.b_bytes[k] for k in b]) != want or b"".join([self.a_bytes[k] for k in a]) != want:
            return [], []
        return a, b


# --- merge path ------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """Rows (i, j): the ends of A and B merged before each cut, one cut every `work` ends; A goes first on ties."""
    total = len(a) + len(b)
    at = np.unique(np.append(np.arange(0, total, work), total))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (low < high).any():
        i = (low + high) // 2
        j = at - i
        # A's end number i belongs before the cut if it is at most B's end number j - 1.
        before = (i < len(a)) & (j > 0)
        before[before] = a[i[before]] <= b[j[before] - 1]
        open_ = low < high
        low = np.where(open_ & before, i + 1, low)
        high = np.where(open_ & ~before, i, high)
    return np.stack([low, at - low], axis=1)


def merged_piece(a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens, A cuts, B cuts) of one piece: its overlaps, and the tokens up to each common end.

    Common ends are told by B's end, which comes second; the A end before it may lie in the piece before.
    """
    (i0, j0), (i1, j1) = start, stop
    mine_a, mine_b = a[i0:i1], b[j0:j1]
    over_a, with_b = np.arange(i0, i1), j0 + np.searchsorted(mine_b, mine_a, "left")
    before_b = i0 + np.searchsorted(mine_a, mine_b, "right")  # ends of A up to each end of B
    tied = (before_b > 0) & (a[np.maximum(before_b - 1, 0)] == mine_b)
    tied_b = np.arange(j0, j1)[tied]
    single_b, single_a = np.arange(j0, j1)[~tied], before_b[~tied]
    place = np.argsort(np.concatenate([over_a + with_b, single_a + single_b]), kind="stable")
    return np.concatenate([over_a, single_a])[place], np.concatenate([with_b, single_b])[place], before_b[tied], tied_b + 1


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping (A, B) token numbers in order, and the tokens of A and B up to each common end.

    `a` and `b` are strictly growing ends over the same bytes, so their last ends are equal.
    """
    marks = diagonals(a, b, work)
    pieces = [merged_piece(a, b, marks[k], marks[k + 1]) for k in range(len(marks) - 1)]
    if not pieces:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


# --- chunks ----------------------------------------------------------------------------------------------


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of each id with room for a sign behind them, and how many bytes that takes."""
    width = len(str(max(size - 1, 0))) + 1
    table, lengths = np.zeros((size, width), np.uint8), np.zeros(size, np.int64)
    for k in range(size):
        digits = str(k).encode()
        table[k, : len(digits)] = list(digits)
        lengths[k] = len(digits) + 1
    return table, lengths


class Writer:
    """Renders groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, size: int):
        self.table, self.lengths = _decimals(size)

    def render(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups end to end, each with a sign behind it, and the offset after each group."""
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        group = np.arange(len(cut_a))
        slot_a = np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)
        slot_b = np.arange(len(b)) + np.repeat(cut_a, size_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[slot_a], ids[slot_b] = a, b
        signs = np.full(len(ids), ord(","), np.uint8)
        signs[slot_a[cut_a - 1]], signs[slot_b[cut_b - 1]] = ord("|"), ord(";")
        lengths = self.lengths[ids]
        digits = self.table[ids]
        digits[np.arange(len(ids)), lengths - 1] = signs
        held = np.arange(digits.shape[1]) < lengths[:, None]
        ends = np.cumsum(lengths)
        return digits[held].tobytes(), ends[slot_b[cut_b[group] - 1]]


def _packed(values: np.ndarray, kind) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype(kind)).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _chunk(texts: list[bytes], pair: Pair, writer: Writer) -> dict:
    """Tokens, groups and links of some texts; everything that does not need the corpus."""
    pair.open()
    coded = [pair.encode(t.decode("utf-8", "replace")) for t in texts]
    n_a, n_b = (np.array([len(c[side]) for c in coded], np.int64) for side in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(c[side] for c in coded), np.int64) for side in (0, 1))
    end_a, end_b = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
    link_a, link_b, cut_a, cut_b = overlaps(end_a, end_b)
    doc_of_a = np.repeat(np.arange(len(texts)), n_a)
    doc_of_cut = doc_of_a[cut_a - 1]
    n_groups = np.bincount(doc_of_cut, minlength=len(texts))
    doc = doc_of_a[link_a]
    n_links = np.bincount(doc, minlength=len(texts))
    if len(a):
        written, offsets = writer.render(a, b, cut_a, cut_b)
        last = np.cumsum(n_groups)
        stops = np.append(0, offsets)[last]
        starts = np.append(0, stops[:-1])
        shas = [hashlib.sha256(written[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
    else:
        shas = [""] * len(texts)
    names, which = np.unique(a[link_a] * (1 << 32) + b[link_b], return_inverse=True)
    held, times = np.unique(doc * max(len(names), 1) + which, return_counts=True)
    holder, index = held // max(len(names), 1), held % max(len(names), 1)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": n_links,
        "shas": shas,
        "names": names,
        "documents": np.bincount(index, minlength=len(names)),
        "index": _packed(np.diff(index, prepend=0), np.int32),
        "times": _packed(times, np.int32),
        "kept": np.bincount(holder, minlength=len(texts)),
    }


_CHUNKS = "chunk long, row array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, kept array<long>, size int, names binary, documents binary, index binary, times binary"


def _align(pair) -> object:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair.value.open()
        writer = Writer(max(len(pair.value.a_bytes), len(pair.value.b_bytes)))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, rows = text_bytes(batch.column("text")), batch.column("row").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) <= CHUNK_BYTES:
                    size += len(texts[stop])
                    stop += 1
                made = _chunk(texts[at:stop], pair.value, writer)
                lists = [pa.array([made[c]], pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([rows[at:stop]], pa.list_(pa.int64())),
                        *lists,
                        pa.array([made["shas"]], pa.list_(pa.string())),
                        pa.array([made["kept"]], pa.list_(pa.int64())),
                        pa.array([len(made["names"])], pa.int32()),
                        pa.array([_packed(np.diff(made["names"], prepend=0), np.int64)], pa.binary()),
                        pa.array([_packed(made["documents"], np.int32)], pa.binary()),
                        pa.array([made["index"]], pa.binary()),
                        pa.array([made["times"]], pa.binary()),
                    ],
                    names=[part.split()[0] for part in _CHUNKS.split(", ")],
                )
                number += 1
                at = stop

    return work


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (chunk, at, pair, documents) for each pair of a chunk."""
    for batch in batches:
        for chunk, names, documents in zip(*(batch.column(c).to_pylist() for c in ("chunk", "names", "documents")), strict=True):
            pairs = np.cumsum(_unpacked(names, np.int64))
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs), chunk, np.int64)),
                        pa.array(np.arange(len(pairs), dtype=np.int32)),
                        pa.array(pairs, pa.int64()),
                        pa.array(_unpacked(documents, np.int32)),
                    ],
                    names=["chunk", "at", "pair", "documents"],
                )


_RESULT = "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answer(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk, from the corpus-wide counts of its pairs."""
    one = {c: chunks.column(c)[0].as_py() for c in chunks.column_names}
    counts, best = np.zeros(one["size"], np.int64), np.zeros(one["size"], np.int64)
    at = answers.column("at").to_numpy()
    counts[at], best[at] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    times = _unpacked(one["times"], np.int32).astype(np.int64)
    # Steps between indexes run on from one document to the next.
    index = np.cumsum(_unpacked(one["index"], np.int32).astype(np.int64))
    stops = np.append(0, np.cumsum(one["kept"]))
    total = lambda v: np.diff(np.append(0, np.cumsum(v * times))[stops])
    values = [one["row"], one["n_a"], one["n_b"], one["n_groups"], one["n_links"], total(best[index]), total(counts[index])]
    return pa.table([*(pa.array(v, pa.int64()) for v in values), pa.array(one["shas"], pa.string())], names=[p.split()[0] for p in _RESULT.split(", ")])


_sent: dict = {}


def _model(df: DataFrame, a_path: str | None, b_path: str | None):
    """Both vocabularies, sent to the workers once for each context and files."""
    context = df.sparkSession.sparkContext
    key = (context.applicationId, a_path or default_path(A_FILE), b_path or default_path(B_FILE))
    if key not in _sent:
        files = []
        for path in key[1:]:
            with open(path, "rb") as file:
                files.append(file.read())
        _sent[key] = context.broadcast(Pair(*files))
    return _sent[key]


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per input row.

    A encodes a space and the text, B the text (it adds the space itself), both without special tokens. A
    text that is null, empty or not given back by the tokens of both has no tokens: zeros and an empty
    digest. A pair counts once for each row that holds it, so repeated rows count each; ties for an A id's
    best pair are all best. Ids may be null or repeat. An empty table gives an empty result; other columns
    are ignored. Vocabularies are local files of the driver, sent to the workers; their size does not
    depend on the data.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pair = _model(docs, a_path, b_path)
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    chunks = materialise(numbered.select("row", "text").mapInArrow(_align(pair), _CHUNKS), "chunks")
    asked = chunks.select("chunk", "names", "documents").mapInArrow(_ask, "chunk long, at int, pair long, documents int")
    totals = materialise(asked.groupBy("pair").agg(F.sum("documents").alias("total")), "totals")
    most = totals.groupBy(F.shiftrightunsigned("pair", 32).alias("a")).agg(F.max("total").alias("most"))
    counts = totals.withColumn("a", F.shiftrightunsigned("pair", 32)).join(most, "a").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))
    answers = asked.select("chunk", "at", "pair").join(counts, "pair").select("chunk", "at", "total", "best")
    found = chunks.drop("names", "documents").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_answer, _RESULT)
    return found.join(numbered.select("row", "id"), "row").drop("row").select("id", *[p.split()[0] for p in _RESULT.split(", ")[1:]])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows (id, groups, a_ids, b_ids, links): the groups as text, the ids and the (A, B) token numbers that overlap."""
    pair = _model(docs, a_path, b_path)
    id_type = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair.value.open()
        writer = Writer(max(len(pair.value.a_bytes), len(pair.value.b_bytes)))
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column("text")):
                a, b = (np.array(x, np.int64) for x in pair.value.encode(text.decode("utf-8", "replace")))
                link_a, link_b, cut_a, cut_b = overlaps(np.cumsum(pair.value.a_length[a]), np.cumsum(pair.value.b_length[b]))
                written = writer.render(a, b, cut_a, cut_b)[0][:-1].decode() if len(a) else ""
                rows.append((written, a, b, [{"a": x, "b": y} for x, y in zip(link_a.tolist(), link_b.tolist(), strict=True)]))
            link = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), link)
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "groups", "a_ids", "b_ids", "links"])

    return base.mapInArrow(work, f"id {id_type}, groups string, a_ids array<long>, b_ids array<long>, links array<struct<a:long,b:long>>")
