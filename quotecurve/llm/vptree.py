"""Nearest neighbours by vantage-point trees, one for each shard.

Nearness is the inner product. A shard's vectors get one more component that brings them all to the length
of its longest one, a query gets a zero there: then a larger inner product is a smaller distance, so the
triangle inequality prunes. Inner nodes split the vectors at the median distance from a vantage point and
keep the range of distances on both sides; a leaf's bound is the largest gap on its path. Every query visits
the leaves in the order of their bounds until the bound times `factor` exceeds its k-th distance. Factor one
is exact; a larger one skips leaves that the triangle inequality alone would not.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotecurve.llm.common import materialise

NEAREST = 20
QUERIES = 20  # every row whose id this divides is a query
FACTOR = 1.5
SHARD = 16384  # vectors of a shard, about; a shard is what a task holds at once
BLOCK = 8192  # queries of a block, about
LEAF = 256
_SLACK = 1e-9  # of squared lengths, for rounding
_ROWS = 4096  # distances are taken in blocks of so many rows


class Tree:
    """A vantage-point tree over rows of `vectors` that all take part."""

    def __init__(self, vectors: np.ndarray, arrays: tuple | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        lengths = np.einsum("nd,nd->n", self.vectors, self.vectors)
        self.reach = float(lengths.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.reach - lengths, 0.0))
        if arrays is None:
            arrays = self._build()
        # points: vantage rows; paths: (leaf, node, low, high); order, starts: rows of the leaves
        self.points, self.path_node, self.path_low, self.path_high, self.order, self.starts = arrays

    def arrays(self) -> tuple:
        return self.points, self.path_node, self.path_low, self.path_high, self.order, self.starts

    def _apart(self, row: int, rows: np.ndarray) -> np.ndarray:
        inner = self.vectors[rows] @ self.vectors[row] + self.lift[rows] * self.lift[row]
        return np.sqrt(np.maximum(2 * self.reach - 2 * inner, 0.0))

    def _build(self) -> tuple:
        rng = np.random.default_rng(len(self.vectors))
        points, leaves, paths = [], [], []
        todo = [(np.arange(len(self.vectors)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                paths.append(path)
                continue
            tried = rng.choice(rows, min(8, len(rows)), replace=False)
            seen = rng.choice(rows, min(128, len(rows)), replace=False)
            row = max(tried, key=lambda r: float(self._apart(r, seen).var()))
            far = self._apart(row, rows)
            by = np.argsort(far, kind="stable")
            half = len(rows) // 2
            node = len(points)
            points.append(row)
            for side in (by[:half], by[half:]):
                todo.append((rows[side], [*path, (node, far[side[0]], far[side[-1]])]))
        depth = max(map(len, paths), default=0)
        shape = (len(leaves), depth)
        node, low, high = np.full(shape, -1, np.int32), np.zeros(shape), np.full(shape, np.inf)
        for k, path in enumerate(paths):
            for j, step in enumerate(path):
                node[k, j], low[k, j], high[k, j] = step
        starts = np.cumsum([0, *map(len, leaves)])
        return np.array(points, np.int64), node, low, high, np.concatenate([*leaves, np.empty(0, np.int64)]).astype(np.int64), starts.astype(np.int64)

    def _bounds(self, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Least possible distance from each query to each leaf."""
        inner = queries @ self.vectors[self.points].T
        away = np.sqrt(np.maximum(lengths[:, None] + self.reach - 2 * inner, 0.0))
        bound = np.zeros((len(queries), len(self.starts) - 1))
        for j in range(self.path_node.shape[1]):
            held = self.path_node[:, j] >= 0
            here = away[:, self.path_node[held, j]]
            gap = np.maximum(self.path_low[held, j] - here, here - self.path_high[held, j])
            bound[:, held] = np.maximum(bound[:, held], gap)
        return bound

    def search(self, queries: np.ndarray, k: int, factor: float, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, inner products, leaves visited): the k best rows of each query, -1 where there are fewer.

        `ids` order rows of equal inner product; `own` is the query's own row here, or -1.
        """
        lengths = np.einsum("nd,nd->n", queries, queries)
        best = np.full((len(queries), k), -1, np.int64)
        score = np.full((len(queries), k), -np.inf)
        bound = self._bounds(queries, lengths)
        turn = np.argsort(bound, axis=1, kind="stable")
        slack = _SLACK * (lengths + self.reach)
        going, visited = np.arange(len(queries)), 0
        for r in range(bound.shape[1]):
            leaf = turn[going, r]
            # A leaf can still matter while its bound, times the factor, is at most the k-th distance.
            kth = lengths[going] + self.reach - 2 * score[going, -1]
            on = np.square(factor * bound[going, leaf]) <= kth + slack[going]
            going, leaf = going[on], leaf[on]
            if not len(going):
                break
            visited += len(going)
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for part in np.split(by, cuts):
                a, b = self.starts[leaf[part[0]]], self.starts[leaf[part[0]] + 1]
                rows = self.order[a:b]
                for at in range(0, len(part), _ROWS):
                    self._visit(queries, going[part[at : at + _ROWS]], rows, ids, own, best, score)
        return best, score, visited

    def _visit(self, queries, who, rows, ids, own, best, score) -> None:
        """Merge the rows of a leaf into the best of some queries."""
        k = best.shape[1]
        inner = queries[who] @ self.vectors[rows].T
        inner[rows[None, :] == own[who, None]] = -np.inf
        sure = inner >= (score[who, -1] - _SLACK * (self.reach + 1))[:, None]
        some = np.flatnonzero((sure & (inner > -np.inf)).any(axis=1))
        if not len(some):
            return
        who, inner = who[some], inner[some]
        if inner.shape[1] > 2 * k:  # those that tie with the k-th one stay
            edge = np.partition(inner, inner.shape[1] - k, axis=1)[:, -k] - _SLACK * (self.reach + 1)
            width = max(k, int((inner >= edge[:, None]).sum(axis=1).max()))
            pick = np.argpartition(-inner, min(width, inner.shape[1]) - 1, axis=1)[:, :width]
        else:
            pick = np.broadcast_to(np.arange(inner.shape[1]), inner.shape)
        found = rows[pick]
        lost = np.take_along_axis(inner, pick, axis=1) == -np.inf
        exact = _inner(queries[who], self.vectors, found)
        exact[lost] = -np.inf
        both = np.concatenate([best[who], np.where(lost, -1, found)], axis=1)
        values = np.concatenate([score[who], exact], axis=1)
        order = np.lexsort((np.where(both >= 0, ids[both], np.iinfo(np.int64).max), -values), axis=1)[:, :k]
        best[who] = np.take_along_axis(both, order, axis=1)
        score[who] = np.take_along_axis(values, order, axis=1)


def _inner(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of queries with some rows each, added up component by component."""
    total = np.zeros(rows.shape)
    for j in range(queries.shape[1]):
        total += queries[:, j, None] * vectors[:, j][rows]
    return total


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(table), dim)


def _ranks(table: pa.Table) -> np.ndarray:
    """The order of ids among ties: nulls last, then by row."""
    return np.array([v if v is not None else np.iinfo(np.int64).max for v in table.column("id").to_pylist()], np.int64)


_TREES = "dim int, shard int, shards int, blocks int, rows binary, ids binary, vectors binary, arrays array<binary>"
_BLOCKS = "dim int, block int, shards int, rows binary, vectors binary"


def _plant(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    dim, shard, shards, blocks = (table.column(c)[0].as_py() for c in ("dim", "shard", "shards", "blocks"))
    tree = Tree(_matrix(table, dim))
    rows = table.column("row").to_numpy()
    values = [dim, shard, shards, blocks, rows.tobytes(), _ranks(table).tobytes(), tree.vectors.tobytes(), [x.tobytes() for x in tree.arrays()]]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
    names = [part.split()[0] for part in _TREES.split(", ")]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def _bundle(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    dim, block, shards = (table.column(c)[0].as_py() for c in ("dim", "block", "shards"))
    values = [dim, block, shards, table.column("row").to_numpy().tobytes(), _matrix(table, dim).tobytes()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[p.split()[0] for p in _BLOCKS.split(", ")])


def _opened(trees: pa.Table) -> tuple[np.ndarray, np.ndarray, Tree]:
    row = {c: trees.column(c)[0].as_py() for c in ("dim", "rows", "ids", "vectors", "arrays")}
    rows, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(rows), row["dim"])
    points, node, low, high, order, starts = row["arrays"]
    starts = np.frombuffer(starts, np.int64)
    node = np.frombuffer(node, np.int32)
    shape = (len(starts) - 1, len(node) // max(len(starts) - 1, 1))
    arrays = (
        np.frombuffer(points, np.int64),
        node.reshape(shape),
        np.frombuffer(low, np.float64).reshape(shape),
        np.frombuffer(high, np.float64).reshape(shape),
        np.frombuffer(order, np.int64),
        starts,
    )
    return rows, ids, Tree(vectors, arrays)


def _ask(k: int, factor: float):
    def work(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        names = ["query", "row", "score"]
        if not len(trees) or not len(blocks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        rows, ids, tree = _opened(trees)
        asked = np.frombuffer(blocks.column("rows")[0].as_py(), np.int64)
        queries = np.frombuffer(blocks.column("vectors")[0].as_py(), np.float64).reshape(len(asked), -1)
        place = np.searchsorted(rows, asked)
        own = np.where(rows[np.minimum(place, len(rows) - 1)] == asked, place, -1)
        best, score, _ = tree.search(queries, k, factor, ids, own)
        query, at = np.nonzero(best >= 0)
        return pa.table([pa.array(asked[query]), pa.array(rows[best[query, at]]), pa.array(score[query, at])], names=names)

    return work


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEAREST,
    every: int = QUERIES,
    factor: float = FACTOR,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (query_id, rank, id, score): for every row whose id `every` divides, its k nearest other rows.

    Largest inner product first, ties to the smaller id, null ids last; all candidates where there are fewer
    than k. Vectors that are null, empty, zero or hold null or non-finite components take no part, and
    vectors of different lengths do not meet. Repeated rows are vectors of their own, as queries too. An
    empty table gives an empty result; other columns are ignored.

    Shards and query blocks have a size that a task can hold; their number grows with the table. A task
    takes one block to one tree, and hands on at most k rows for each query.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    base = materialise(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(fine)
        .withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}),
        "vectors",
    )
    asks = F.col("id") % every == 0
    sizes = base.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.ceil(F.count_if(asks) / block).cast("int").alias("blocks")
    )
    dealt = base.join(sizes, "dim").where("blocks > 0")
    spread = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    trees = dealt.withColumn("shard", spread("shards")).groupBy("dim", "shard").applyInArrow(_plant, _TREES)
    asked = dealt.where(asks).withColumn("block", spread("blocks")).groupBy("dim", "block").applyInArrow(_bundle, _BLOCKS)
    trees = materialise(trees, "trees").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = materialise(asked, "queries").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    cell = ("dim", "shard", "block")
    found = trees.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_ask(k, factor), "query long, row long, score double")
    ids = base.select("row", "id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = found.join(ids, "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = base.where(asks).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "id", "score")
