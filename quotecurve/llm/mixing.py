"""Mixing sources to target weights by iterative proportional fitting, and calibrated sampling.

Tokens are summed by (source, language, topic). Cells of one source are one row, so a round of raking reads
that table once: each source's factor is found inside its row, and only the sums by language and topic, a
table of checked size, go to the driver, which moves the other two factors. No cell may give more tokens
than it has; what a full cell cannot give is spread over the others. Documents are then drawn with the
share of its tokens that their cell is to keep as their probability.
"""

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import materialise

TOPICS = 64
POWER = 0.85  # target share of a value, in proportion to its tokens to this power
KEEP = 0.7  # share of all tokens that the mix keeps
TOLERANCE = 1e-6  # largest move of a factor in the last round
MAX_ROUNDS = 200
PATIENCE = 20  # rounds without headway after which marginals are taken to contradict each other
MAX_MATRIX = 1 << 20  # pairs of a language and a topic that the driver holds
SEED = 7
TERMS = 1 << 16  # classes of words whose documents are counted for the topics
_LETTERS = 4  # letters of a word that can name a topic
_DIMS = ("source", "lang", "topic")


# --- cells -----------------------------------------------------------------------------------------------


def _terms(text: str | None) -> tuple[int, Counter]:
    """Words of a text and how often each word that can name a topic occurs."""
    words = (text or "").lower().split()
    return len(words), Counter(w for w in words if len(w) >= _LETTERS and w.isalpha())


def term_documents(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many rows each class of words occurs, and the number of rows behind that; TERMS + 1 numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[[*{zlib.crc32(w.encode()) % TERMS for w in _terms(text)[1]}]] += 1
                held[-1] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = texts.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(TERMS + 1, np.int64)
    found[sums["term"].to_numpy(np.int64)] = sums["n"]
    return found


def _sizes(documents: np.ndarray, topics: int):
    """Column function: text -> (n_tokens, topic)."""
    rarity = np.log((documents[-1] + 1) / (documents[:-1] + 0.5)).tolist()

    @F.pandas_udf("n_tokens long, topic int")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n, held = _terms(text)
            best, topic = (0.0, ""), 0
            for word, times in held.items():
                term = zlib.crc32(word.encode()) % TERMS
                weight = (times * rarity[term], word)
                if weight > best:
                    best, topic = weight, 1 + term % (topics - 1)
            rows.append((n + 1, topic))
        return pd.DataFrame(rows, columns=["n_tokens", "topic"])

    return sizes


def with_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topics: int = TOPICS, topic_col: str | None = None) -> DataFrame:
    """`docs` with a column `mix` = (source, lang, topic, n_tokens).

    Topics are those of `topic_col`, or the class of the text's strongest word: the one that occurs most
    often for the number of documents that hold words of its class (the last in order on ties; topic 0 of a
    text without such words). Tokens are words and one end, so no text weighs nothing.
    """
    told, topic = F.col("told"), F.col(topic_col).cast("int") if topic_col else F.col("told")["topic"]
    sizes = _sizes(term_documents(docs, text_col), topics)
    return docs.withColumn("told", sizes(F.col(text_col).cast("string"))).withColumn(
        "mix",
        F.struct(
            F.col(source_col).cast("string").alias("source"),
            F.col(lang_col).cast("string").alias("lang"),
            topic.alias("topic"),
            told["n_tokens"].alias("n_tokens"),
        ),
    ).drop("told")


def power_targets(cells: DataFrame, dim: str, power: float = POWER) -> DataFrame:
    """Rows (dim, target): shares in proportion to the tokens of each value to a power."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


# --- raking ----------------------------------------------------------------------------------------------


def reachable(values: DataFrame, wanted: float) -> DataFrame:
    """`values` (tokens, target) with `goal`: tokens in proportion to the targets, none above what there is.

    The goals add up to `wanted`, or to all tokens with a target if there are fewer. One scale is raised
    until the goals, each cut at its tokens, add up; each step adds two sums.
    """
    scale, full = None, -1
    while True:
        cut = F.lit(False) if scale is None else F.col("target") * scale >= F.col("tokens")
        sums = values.where("target > 0").agg(
            F.coalesce(F.sum(F.when(cut, F.col("tokens"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~cut, F.col("target"))), F.lit(0.0)).alias("open"),
            F.count_if(cut).alias("full"),
        ).first()
        if sums["full"] == full or not sums["open"]:
            break
        full, scale = sums["full"], max(wanted - sums["given"], 0.0) / sums["open"]
    goal = F.least("tokens", F.col("target") * F.lit(scale or 0.0))
    return values.withColumn("goal", F.when(F.col("target") > 0, goal if sums["open"] else F.col("tokens")).otherwise(0.0))


def _filled(tokens: np.ndarray, weight: np.ndarray, starts: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights of each run of cells, scaled to add up to its goal, none above the cell's tokens."""
    runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
    full = np.zeros(len(tokens), bool)
    while True:
        given = np.bincount(runs[full], tokens[full], len(starts))
        free = np.bincount(runs[~full], weight[~full], len(starts))
        scale = np.divide(np.maximum(goal - given, 0), free, out=np.zeros(len(starts)), where=free > 0)
        now = np.where(full, tokens, weight * scale[runs])
        over = ~full & (now > tokens)
        if not over.any():
            return now
        full |= over


_PACKED = "array<struct<lang:int,topic:int,tokens:double>>"


def _weights(factors: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch):
    """(row of the batch, lang, topic, tokens, weight) of all cells of some sources."""
    cells = batch.column("cells")
    lang, topic, tokens = (c.to_numpy(zero_copy_only=False) for c in cells.flatten().flatten())
    lengths = np.diff(cells.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    weight = tokens * factors[0][lang] * factors[1][topic]
    return np.repeat(np.arange(len(lengths)), lengths), lang, topic, tokens, _filled(tokens, weight, starts, batch.column("goal").to_numpy())


def _held(factors: tuple[np.ndarray, np.ndarray]):
    """Sums of the weights by language and topic, one table for each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(factors[0]), len(factors[1])))
        for batch in batches:
            if batch.num_rows:
                _, lang, topic, _, weight = _weights(factors, batch)
                np.add.at(sums, (lang, topic), weight)
        lang, topic = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(topic), pa.array(sums[lang, topic])], names=["lang", "topic", "held"])

    return work


def _shared(factors: tuple[np.ndarray, np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, lang, topic, tokens, weight = _weights(factors, batch)
                sources = batch.column("source").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([sources, pa.array(lang), pa.array(topic), pa.array(tokens), pa.array(weight)], names=["source", "l", "t", "tokens", "kept"])

    return work


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with `kept` tokens and `weight`, their share, that meet the marginals.

    `targets[dim]` has rows (dim, target), scaled to a share `keep` of the tokens; values without a target
    get nothing. No cell keeps more than it has. A target that its value cannot reach is cut and the rest
    spread over the other values of its kind. Marginals that contradict each other are met as far as the
    rounds bring them, with a warning that says how far that is.
    """
    wanted = keep * float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).first()[0])
    goals = {}
    for dim in _DIMS:
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
        given = targets[dim].select(F.col(dim).alias("value"), F.col("target").cast("double").alias("target"))
        known = sums.join(given, sums[dim].eqNullSafe(given["value"]), "left").select(dim, "tokens", F.coalesce("target", F.lit(0.0)).alias("target"))
        goals[dim] = reachable(materialise(known, f"values-{dim}"), wanted).select(dim, "goal")
    counts = [goals[d].count() for d in _DIMS[1:]]
    if counts[0] * counts[1] > MAX_MATRIX:
        raise ValueError(f"{counts[0]} languages and {counts[1]} topics are more than MAX_MATRIX pairs")
    names = [goals[d].toPandas() for d in _DIMS[1:]]  # checked above
    place = {d: cells.sparkSession.createDataFrame([(None if pd.isna(v) else v, k) for k, v in enumerate(t[d])], f"value {kind}, {d}_at int")
             for d, t, kind in zip(_DIMS[1:], names, ("string", "int"), strict=True)}
    numbered = cells
    for d in _DIMS[1:]:
        numbered = numbered.join(F.broadcast(place[d]), numbered[d].eqNullSafe(F.col("value"))).drop("value")
    packed = numbered.groupBy("source").agg(F.collect_list(F.struct(F.col("lang_at").alias("lang"), F.col("topic_at").alias("topic"), F.col("tokens").cast("double").alias("tokens"))).alias("cells"))
    other = goals["source"].withColumnRenamed("source", "value")
    packed = materialise(packed.join(other, packed["source"].eqNullSafe(other["value"])).select("source", "goal", F.col("cells").cast(_PACKED)), "packed")
    goal = [t["goal"].to_numpy(np.float64) for t in names]
    factors = tuple((g > 0).astype(np.float64) for g in goal)
    past, none = [], [np.zeros(len(g)) for g in goal]
    for _ in range(MAX_ROUNDS):
        found = packed.mapInArrow(_held(factors), "lang long, topic long, held double").groupBy("lang", "topic").agg(F.sum("held").alias("held")).toPandas()
        held = np.zeros((len(goal[0]), len(goal[1])))
        held[found["lang"].to_numpy(int), found["topic"].to_numpy(int)] = found["held"]
        by_lang = np.divide(goal[0], held.sum(axis=1), out=none[0].copy(), where=held.sum(axis=1) > 0)
        by_topic = by_lang @ held
        by_topic = np.divide(goal[1], by_topic, out=none[1].copy(), where=by_topic > 0)
        moves = np.concatenate([np.abs(f - 1)[g > 0] for f, g in zip((by_lang, by_topic), goal, strict=True)])
        move = float(moves.max(initial=0.0))
        past.append(move)
        if move <= tolerance:
            break
        if len(past) > PATIENCE and min(past[-PATIENCE:]) > 0.9 * min(past[:-PATIENCE]):
            warnings.warn(f"the marginals contradict each other and are met within a share of {move:.2g} only", stacklevel=2)
            break
        factors = (factors[0] * by_lang, factors[1] * by_topic)
        factors = tuple(f / max(f.max(initial=0.0), 1e-300) for f in factors)
    else:
        warnings.warn(f"the marginals are met within a share of {past[-1]:.2g} only", stacklevel=2)
    spread = packed.mapInArrow(_shared(factors), "source string, l int, t int, tokens double, kept double")
    whole = F.lit(wanted or 1.0)
    for d, short in (("lang", "l"), ("topic", "t")):
        back = place[d].withColumnRenamed("value", d)
        spread = spread.join(F.broadcast(back), F.col(short) == F.col(f"{d}_at")).drop(f"{d}_at")
    return materialise(spread.select(*_DIMS, F.col("tokens").cast("long").alias("tokens"), "kept", (F.col("kept") / whole).alias("weight")), "raked")


def calibrated(features: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """Cells (source, lang, topic, tokens, kept, weight, probability) for rows with a column `mix`.

    The probability of a document is the share of its cell's tokens that the mix keeps, at most one, so the
    expected tokens of every cell are those of the raked table.
    """
    cells = materialise(
        features.groupBy(*(F.col(f"mix.{d}").alias(d) for d in _DIMS)).agg(F.sum("mix.n_tokens").alias("tokens")), "cells"
    )
    raked = rake(cells, targets or {d: power_targets(cells, d) for d in _DIMS}, keep)
    return raked.withColumn("probability", F.col("kept") / F.col("tokens"))


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) * F.lit(2.0**-53)


def _decided(rows: DataFrame, id_col: str, targets, seed: int, keep: float) -> DataFrame:
    cells = calibrated(rows, targets, keep)
    keys = [F.col(f"mix.{d}").eqNullSafe(cells[d]) for d in _DIMS]
    joined = rows.join(cells.select(*_DIMS, "weight", "probability"), keys[0] & keys[1] & keys[2]).drop(*_DIMS)
    return joined.withColumn("drawn", draw(F.col(id_col), seed) < F.col("probability"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: dict[str, DataFrame] | None = None,
    seed: int = SEED,
    keep: float = KEEP,
    topics: int = TOPICS,
) -> DataFrame:
    """Rows (id, source, lang, topic, n_tokens, weight, probability, sampled), one per input row.

    `weight` is the share of the cell in the mix. A null text is empty, null sources and languages are
    values of their own, a null id is drawn like any other id. Rows with equal ids and cells are drawn
    alike. An empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"))
    rows = materialise(with_cells(named, "t", "s", "l", topics).select("id", "mix"), "mix")
    return _decided(rows, "id", targets, seed, keep).select(
        "id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", "weight", "probability", F.col("drawn").alias("sampled")
    )


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: dict[str, DataFrame] | None = None,
    seed: int = SEED,
    keep: float = KEEP,
    topics: int = TOPICS,
) -> DataFrame:
    """The drawn rows of `docs` with all their columns, under the rules of `mixture`.

    Nulls, empty texts, repeated rows and clashing column names are as there; an empty table gives no rows.
    """
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    named = docs.select(body, F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"))
    rows = with_cells(named, "t", "s", "l", topics)
    return _decided(rows, "id", targets, seed, keep).where("drawn").select("doc.*")
