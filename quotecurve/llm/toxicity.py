"""Toxic passages by maximum-scoring segment search, and a calibrated score for each document.

A token scores its log odds of standing in toxic against other texts, shrunk by a Dirichlet prior that is
centred on the odds of the token's stem, less a fixed drift that makes ordinary text lose. A linear-time
scan finds every maximal segment of positive score. The scores of the best segments of non-toxic texts fit
an extreme-value law, which tells the significance of a segment in a text of given length; a document's
score comes from its significances by a logistic curve.

Tokens are hashed to tables of fixed size, so the model does not grow with the vocabulary.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import text_bytes

SAMPLE = 50_000  # labelled documents that the classifier is fitted on, at most; chosen by hash
TOKEN_BITS, STEM_BITS = 20, 16  # sizes of the two tables
STEM = 5  # letters of a stem
TOKEN_WEIGHT, STEM_WEIGHT = 4.0, 20.0  # prior counts of a token and of a stem
DRIFT = 1.0
SIGNIFICANT = 0.05  # chance of so good a segment in a non-toxic text
_CALIBRATION = 4  # one labelled document of so many is kept for the calibration
_CACHE = 200_000
_ROWS = 256
_TOKEN = re.compile(r"[^\W\d_]+")
_EULER = 0.5772156649015329


def tokens(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _TOKEN.findall(text.lower())


def _place(token: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(token, 7) >> (64 - bits)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in order, in linear time.

    Each run of positive scores is joined with earlier segments as long as that makes a better one; the
    nearest earlier segment with a lower sum before it is found along kept links, never by a search.
    """
    sums = np.append(0.0, np.cumsum(scores))
    good = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False]))))
    starts, ends = edge[::2], edge[1::2]
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, link
    rows = zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist(), strict=True)
    for first, end, before, after in rows:
        link = len(held) - 1
        while True:
            while link >= 0 and held[link][2] >= before:
                link = held[link][4]
            if link < 0 or held[link][3] >= after:
                held.append((first, end, before, after, link))
                break
            first, _, before, _, below = held[link]
            del held[link:]
            link = below
    return [(first, end, after - before) for first, end, before, after, _ in held]


class Model:
    """Token counts by class, stem log odds, the extreme-value law and the logistic curve."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, stem_odds: np.ndarray, base: float):
        self.toxic, self.clean, self.stem_odds, self.base = toxic, clean, stem_odds, base
        self.rate, self.log_k = 1.0, 0.0
        self.curve = np.array([-30.0, 0.0, 0.0])
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return vars(self) | {"cache": {}}

    def token_scores(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        for token in tokens(text):
            value = cache.get(token)
            if value is None:
                place, stem = _place(token, TOKEN_BITS), _place(token[:STEM], STEM_BITS)
                odds = _odds(self.toxic[place], self.clean[place], TOKEN_WEIGHT, self.stem_odds[stem], self.base)
                if len(cache) >= _CACHE:
                    cache.clear()
                value = cache[token] = float(odds) - DRIFT
            out.append(value)
        return np.array(out)

    def significance(self, score: np.ndarray, length: int) -> np.ndarray:
        """Minus log of the chance that a non-toxic text of this length has so good a segment."""
        expected = np.exp(np.clip(self.log_k + np.log(max(length, 1)) - self.rate * score, -700, 700))
        return -np.log(np.maximum(-np.expm1(-expected), 1e-300))

    def features(self, scores: np.ndarray, length: int) -> tuple[float, float]:
        """(best significance, sum over the significant segments), each as log(1 + x)."""
        if not len(scores):
            return 0.0, 0.0
        value = self.significance(scores, length)
        return float(np.log1p(value.max())), float(np.log1p(value[value > -np.log(SIGNIFICANT)].sum()))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments as (first token, end token, chance)."""
        scores = self.token_scores(text)
        told = [(a, b, float(np.exp(-self.significance(np.array([v]), len(scores))[0]))) for a, b, v in segments(scores)]
        return [t for t in told if t[2] < SIGNIFICANT]

    def probability(self, text: str) -> tuple[float, int]:
        """(chance that the text is toxic, number of its significant passages)."""
        scores = self.token_scores(text)
        found = np.array([v for _, _, v in segments(scores)])
        x = float(self.curve[0] + np.dot(self.curve[1:], self.features(found, len(scores))))
        many = int((self.significance(found, len(scores)) > -np.log(SIGNIFICANT)).sum()) if len(found) else 0
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), many


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (text, toxic, fold) of the sample: fold 0 is for the calibration.

    The sample is at most SAMPLE rows of two numbers, so it may be sent to all tasks. The highest of
    contradicting labels counts.
    """
    learnt = F.crc32(F.col("id").cast("string")) % 5 != 0
    told = labels.select(F.col("doc_id").alias("id"), "toxic").where("id is not null and toxic in (0, 1)").where(learnt)
    chosen = told.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(_CALIBRATION)).cast("int")
    return rows.join(F.broadcast(chosen), "id").select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"))


def _counts(texts: DataFrame) -> DataFrame:
    """Rows (place, clean, toxic): token counts by table place; stems have places from 2^TOKEN_BITS on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << TOKEN_BITS) + (1 << STEM_BITS)
        table = np.zeros((2, size), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for text, toxic in zip(text_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    for token, n in Counter(tokens(text.decode("utf-8", "replace"))).items():
                        table[toxic, _place(token, TOKEN_BITS)] += n
                        table[toxic, (1 << TOKEN_BITS) + _place(token[:STEM], STEM_BITS)] += n
        place = np.flatnonzero(table.any(axis=0))
        arrays = [pa.array(place, pa.int32()), pa.array(table[0, place], pa.int64()), pa.array(table[1, place], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["place", "clean", "toxic"])

    found = texts.select("text", "toxic").mapInArrow(work, "place int, clean long, toxic long")
    return found.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _odds(toxic: np.ndarray, clean: np.ndarray, weight: float, centre: np.ndarray, base: float) -> np.ndarray:
    """Log odds by class against the odds of all tokens, with `weight` prior counts of log odds `centre`."""
    share = 1 / (1 + np.exp(-(base + centre)))
    return np.log((toxic + weight * share) / (clean + weight * (1 - share))) - base


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve with a small ridge, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * beta
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(beta))
        move = np.linalg.solve(curve, slope)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    return beta


def _told(texts: DataFrame, model: Model, kinds: str, tell) -> pd.DataFrame:
    """A few numbers for each text of the sample: `tell` turns segment scores and the length into them."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    names = ["toxic", *(kind.split()[0] for kind in kinds.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                scored = [sent.value.token_scores(t.decode("utf-8", "replace")) for t in text_bytes(part.column(0))]
                rows = [tell(sent.value, np.array([v for _, _, v in segments(x)]), len(x)) for x in scored]
                columns = [pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=names)

    found = texts.select("text", "toxic").mapInArrow(work, f"toxic int, {kinds}").toPandas()
    sent.destroy()
    return found


def _gumbel(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """(rate, log K) of the law exp(-K length exp(-rate best)) by the method of moments."""
    log_length, rate = np.log(np.maximum(length, 1)), 1.0
    for _ in range(100):
        spread = max(float(np.std(best - log_length / rate)), 1e-6)
        rate = float(0.5 * rate + 0.5 * np.pi / (np.sqrt(6) * spread))
    return rate, float(np.mean(rate * best - log_length) - _EULER)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a sample of labelled documents; without labels of both kinds it calls nothing toxic.

    To the driver come the two count tables (of fixed size) and, for the calibration, four numbers for each of
    the sample's texts that the counts did not see: best segment and length, then both features.
    """
    sample = _labelled(docs, labels, id_col, text_col)
    table = np.zeros((2, (1 << TOKEN_BITS) + (1 << STEM_BITS)), np.float64)
    got = _counts(sample.where("fold <> 0")).toPandas()
    for kind, name in enumerate(("clean", "toxic")):
        table[kind, got["place"].to_numpy()] = got[name].to_numpy()
    del got
    (clean, toxic), (stem_clean, stem_toxic) = table[:, : 1 << TOKEN_BITS], table[:, 1 << TOKEN_BITS :]
    base = float(np.log((toxic.sum() + 1) / (clean.sum() + 1)))
    stem_odds = _odds(stem_toxic, stem_clean, STEM_WEIGHT, np.zeros(1), base)
    model = Model(toxic, clean, stem_odds, base)
    apart = sample.where("fold = 0")
    best = _told(apart, model, "best double, length double", lambda model, scores, n: (scores.max(initial=0.0), n))
    if best["toxic"].nunique() < 2 or not toxic.sum():
        return model
    plain = best["toxic"].to_numpy() == 0
    model.rate, model.log_k = _gumbel(best["best"].to_numpy()[plain], best["length"].to_numpy()[plain])
    pairs = _told(apart, model, "first double, second double", lambda model, scores, n: model.features(scores, n))
    model.curve = _logistic(pairs[["first", "second"]].to_numpy(), pairs["toxic"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Rows (id, held_out, score, predicted, n_passages), one per input row.

    `labels` has doc_id (an integer) and toxic (0 or 1; other values and null ids are not learnt from), of which only rows
    whose crc32(doc_id) mod 5 is not 0 are used. Scores depend on the text alone: null texts are empty, repeated
    rows score alike, null ids are no label and not held out unless crc32 of the empty string says so. Very
    long texts are scored whole. An empty table gives an empty result; other columns are ignored.
    """
    model = model or fit(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [sent.value.probability(t.decode("utf-8", "replace")) for t in text_bytes(part.column(1))]
                arrays = [part.column(0), pa.array([p for p, _ in rows], pa.float64()), pa.array([n for _, n in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "score", "n_passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, score double, n_passages int")
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
