"""Byte-level BPE: encoding by a priority queue of merges over a linked list, decoding by concatenation."""

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import text_bytes

VOCABULARY = "byte_bpe_50k.json"
CACHE = 200_000  # words a worker remembers before it starts anew; only speed depends on it
_ROWS = 256
# options of a vocabulary under which texts would be encoded otherwise
_ODD = ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")
# How byte-level vocabularies split text before merging (fixed).
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    """Place of the public vocabulary installed on the machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others take the code points from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Packed ids of words met before."""

    def __init__(self, model: "Bpe"):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = b"".join(i.to_bytes(4, "little") for i in self.model.merge(word.encode()))
        return found


class Bpe:
    """A vocabulary with its merges. `specials` are strings that stand for one id wherever they occur."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        letters = byte_letters()
        bytes_of = {letter: bytes([b]) for b, letter in enumerate(letters)}
        self.size = max([*vocabulary.values(), *specials.values()]) + 1
        self.first = [vocabulary[letter] for letter in letters]
        self.rank = {vocabulary[a] * self.size + vocabulary[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocabulary[a + b] for a, b in merges]
        self.specials = specials
        self.strings: list[bytes] = [b""] * self.size
        for token, i in {**vocabulary, **specials}.items():
            known = all(letter in bytes_of for letter in token)
            self.strings[i] = b"".join(map(bytes_of.get, token)) if known else token.encode()
        self._open()

    def _open(self) -> None:
        self.split = regex.compile(_SPLIT)
        names = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = _Words(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("split", "cut", "words")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._open()

    @classmethod
    def read(cls, path: str) -> "Bpe":
        """From a tokenizer file in JSON; only plain byte-level BPE is known here."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, added = data["model"], data["added_tokens"]
        split = data["pre_tokenizer"] or {}
        plain = data["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [name for name in _ODD if model.get(name)] + [name for t in added for name in ("lstrip", "rstrip", "single_word") if t[name]]
        if model["type"] != "BPE" or not plain or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary {odd or ''}".rstrip())
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in added})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. Queue entries whose pair has changed since are skipped."""
        ids = [self.first[b] for b in word]
        n, size, rank = len(ids), self.size, self.rank
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r * n + i for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            best, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0 or rank.get(ids[i] * size + ids[j]) != best:
                continue
            ids[i], ids[j] = self.merged[best], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(queue, r * n + i)
            if h >= 0 and (r := rank.get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(queue, r * n + h)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        word = self.words.__getitem__
        if self.cut is None:
            return b"".join(map(word, self.split.findall(text)))
        out = []
        for piece in self.cut.split(text):
            if piece in self.specials:
                out.append(self.specials[piece].to_bytes(4, "little"))
            else:
                out.extend(map(word, self.split.findall(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of packed ids; bytes that are no UTF-8 become replacement characters."""
        joined = b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))
        return joined.decode("utf-8", "replace").encode()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few hundred rows at a time, so that a worker holds little besides its batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _mapped(df: DataFrame, column: str, adds: dict[str, str], step) -> DataFrame:
    """`df` without the column, but with the columns that step(bytes of it) gives."""
    kinds = {"string": pa.string(), "binary": pa.binary()}
    kept = [c for c in df.columns if c != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [step(v) for v in text_bytes(batch.column(column))]
            new = [pa.array([r[k] for r in rows], pa.binary()).cast(kinds[t]) for k, t in enumerate(adds.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *adds])

    fields = [f"`{n}` {t}" for n, t in df.dtypes if n != column] + [f"`{n}` {t}" for n, t in adds.items()]
    return df.mapInArrow(work, ", ".join(fields))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


_sent: dict = {}


def _model(df: DataFrame, path: str | None):
    """The vocabulary, sent to the workers once for each context and file."""
    context = df.sparkSession.sparkContext
    key = (context.applicationId, path or default_vocabulary())
    if key not in _sent:
        _sent[key] = context.broadcast(Bpe.read(key[1]))
    return _sent[key]


def _counted(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id, ids, n_tokens), one per input row; ids are packed as little-endian unsigned 32-bit integers.

    The whole text is encoded without special tokens added; a special token's string inside the text is
    that token. A null text is empty and has no ids. Rows are handled alone: ties, repeats, null ids and an
    empty table need no rule; other columns are ignored. The vocabulary is read once on the driver from
    `path` (a local file) and sent to the workers; its size does not depend on the data.
    """
    model = _model(docs, path)
    found = _mapped(_texts(docs, id_col, text_col), "text", {"ids": "binary"}, lambda t: (model.value.encode(t.decode("utf-8", "replace")),))
    return _counted(found)


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """`encoded` with its packed ids replaced by the text they stand for; null ids give an empty text."""
    model = _model(encoded, path)
    return _mapped(encoded, ids_col, {out: "string"}, lambda ids: (model.value.decode(ids),))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id, ids, decoded, n_tokens): `encode` and `decode` of its ids by one worker."""
    model = _model(docs, path)

    def both(text: bytes) -> tuple[bytes, bytes]:
        ids = model.value.encode(text.decode("utf-8", "replace"))
        return ids, model.value.decode(ids)

    found = _mapped(_texts(docs, id_col, text_col), "text", {"ids": "binary", "decoded": "string"}, both)
    return _counted(found)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256, ids): texts encoded and decoded again."""
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return round_trip(docs, id_col, text_col, path).select("id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded, "ids")
