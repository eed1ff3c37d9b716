"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors of a label are one node with a count. Each shard gets a graph, and a beam width at which an
audit against brute force reaches the wanted recall; the vectors of another shard that query it audit it
again. Every shard's vectors query every shard of their label. A query whose beam is filled with links is
asked again with a wider one, so large groups are found whole. Links are verified in double precision;
a task hands on only link counts and the links of a spanning forest, never all pairs of a group.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import components, materialise

COSINE = 0.93
SHARD = 4096  # vectors of a shard, about
LINKS = 12  # neighbours on the upper layers; twice as many on the lowest
BUILD_BEAM = 48
BEAM = 32  # first width tried
AUDITS = 256  # queries of an audit
RECALL = 0.99
_BATCH = 512
_WIDE = 8  # a beam of this part of a shard, or a larger one, reads the whole shard
_EXPAND = 4  # beam members expanded in one step
_NEAR = 1e-6  # slack of single precision before the check in double


def _top(ids: np.ndarray, sims: np.ndarray, open_: np.ndarray, width: int):
    """The best `width` entries of each row."""
    if sims.shape[1] <= width:
        return ids, sims, open_
    at = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    return tuple(np.take_along_axis(x, at, axis=1) for x in (ids, sims, open_))


class Graph:
    """Layers of neighbour lists over unit vectors; -1 fills a list that is not full."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.unit = np.ascontiguousarray(unit, np.float32)
        self.entry = entry
        self.layers = layers if layers is not None else []
        if layers is None:
            self._build()

    def _build(self) -> None:
        n = len(self.unit)
        draws = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(1 - draws) / np.log(LINKS)).astype(np.int64), 8)
        order = np.argsort(-level, kind="stable")
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else 0
        done = 1
        while done < n:
            batch = order[done : done + min(_BATCH, done)]
            self._insert(batch, level[batch])
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        query = self.unit[batch]
        start = np.full((len(batch), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level >= k
            ids, sims = self._search(k, query, start, BUILD_BEAM if here.any() else 1)
            if here.any():
                among = query[here] @ query[here].T
                np.fill_diagonal(among, -np.inf)
                near = np.argsort(-among, axis=1)[:, :LINKS]
                mine = batch[here]
                ids_here = np.concatenate([ids[here], mine[near]], axis=1)
                sims_here = np.concatenate([sims[here], np.take_along_axis(among, near, axis=1)], axis=1)
                chosen = self._spread(mine, ids_here, sims_here, LINKS)
                self.layers[k][mine, : chosen.shape[1]] = chosen
                self._back(k, mine, chosen)
            start = ids[:, : max(1, min(8, ids.shape[1]))]

    def _spread(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to `width` neighbours for each node: nearer to it than to one another, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        good = (ids >= 0) & np.isfinite(sims)
        vectors = self.unit[np.maximum(ids, 0)]
        mutual = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            closest = np.where(taken, mutual[:, c, :], -np.inf).max(axis=1)
            taken[:, c] = good[:, c] & (sims[:, c] > closest) & (taken.sum(axis=1) < width)
        rank = np.argsort(np.where(taken, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :width]
        return np.where(np.take_along_axis(good, rank, axis=1), np.take_along_axis(ids, rank, axis=1), -1)

    def _back(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """The reverse of new links; a list that overflows is chosen anew."""
        target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, many = np.unique(target, return_index=True, return_counts=True)
        width = self.layers[k].shape[1]
        for at in range(0, len(who), _BATCH):
            part = slice(at, at + _BATCH)
            reach = min(int(many[part].max()), 4 * LINKS)
            pick = first[part, None] + np.arange(reach)
            fresh = np.where(np.arange(reach) < many[part, None], source[np.minimum(pick, len(source) - 1)], -1)
            ids = np.concatenate([self.layers[k][who[part]], fresh], axis=1)
            sims = np.einsum("bmd,bd->bm", self.unit[np.maximum(ids, 0)], self.unit[who[part]])
            sims[ids < 0] = -np.inf
            self.layers[k][who[part]] = self._spread(who[part], ids, sims, width)

    def _search(self, k: int, query: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once on one layer: (ids, similarities), -1 where the beam is not full."""
        rows = np.arange(len(query))[:, None]
        seen = np.zeros((len(query), len(self.unit) + 1), bool)  # the last column takes the -1
        seen[:, -1] = True
        ids = start.astype(np.int64)
        first = np.ones(ids.shape, bool)
        for c in range(1, ids.shape[1]):
            first[:, c] = (ids[:, c : c + 1] != ids[:, :c]).all(axis=1)
        ids = np.where(first, ids, -1)
        sims = np.einsum("bmd,bd->bm", self.unit[np.maximum(ids, 0)], query)
        sims[ids < 0] = -np.inf
        seen[rows, ids] = True
        open_ = ids >= 0
        ids, sims, open_ = _top(ids, sims, open_, width)
        active = np.arange(len(query))
        out_ids, out_sims = np.full((len(query), width), -1, np.int64), np.full((len(query), width), -np.inf, np.float32)
        while len(active):
            rank = np.where(open_, sims, -np.inf)
            take = min(_EXPAND, rank.shape[1])
            best = np.argpartition(-rank, take - 1, axis=1)[:, :take]
            going = np.take_along_axis(open_, best, axis=1)
            stop = ~going.any(axis=1)
            if stop.any():
                out_ids[active[stop], : ids.shape[1]], out_sims[active[stop], : ids.shape[1]] = ids[stop], sims[stop]
                on = ~stop
                active, ids, sims, open_, best, going = (x[on] for x in (active, ids, sims, open_, best, going))
                if not len(active):
                    break
            np.put_along_axis(open_, best, False, axis=1)
            nodes = np.where(going, np.take_along_axis(ids, best, axis=1), -1)
            found = self.layers[k][nodes].reshape(len(active), -1).astype(np.int64)
            found[np.repeat(nodes < 0, self.layers[k].shape[1], axis=1)] = -1
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[active[:, None], found]] = -1
            seen[active[:, None], found] = True
            near = np.einsum("bmd,bd->bm", self.unit[np.maximum(found, 0)], query[active])
            near[found < 0] = -np.inf
            ids, sims, open_ = _top(
                np.concatenate([ids, found], axis=1),
                np.concatenate([sims, near], axis=1),
                np.concatenate([open_, found >= 0], axis=1),
                width,
            )
        return out_ids, out_sims

    def within(self, query: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, node) with a similarity of `cosine` or more, the beam widened where it is full of them."""
        query = np.ascontiguousarray(query, np.float32)
        waiting, width, found = np.arange(len(query)), beam, []
        while len(waiting):
            if width * _WIDE >= len(self.unit):  # so wide a beam is the shard itself
                for at in range(0, len(waiting), _BATCH):
                    part = waiting[at : at + _BATCH]
                    row, node = np.nonzero(query[part] @ self.unit.T >= cosine - _NEAR)
                    found.append((part[row], node))
                break
            again = []
            step = max(16, _BATCH * BEAM // width)
            for at in range(0, len(waiting), step):
                part = waiting[at : at + step]
                start = np.full((len(part), 1), self.entry, np.int64)
                for k in range(len(self.layers) - 1, 0, -1):
                    start = self._search(k, query[part], start, 4)[0]
                ids, sims = self._search(0, query[part], start, min(width, len(self.unit)))
                hit = sims >= cosine - _NEAR
                full = hit.all(axis=1)
                again.append(part[full])
                row, column = np.nonzero(hit & ~full[:, None])
                found.append((part[row], ids[row, column]))
            waiting, width = np.concatenate(again), width * 4
        rows, nodes = zip(*found, strict=True) if found else ((), ())
        return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(nodes or [np.empty(0, np.int64)])

    def audited_beam(self, cosine: float, queries: np.ndarray, width: int = BEAM) -> int:
        """The least width from `width` on at which an audit finds RECALL of the links, at most the whole shard."""
        n = len(self.unit)
        some = np.random.default_rng(n + 1).permutation(len(queries))[:AUDITS]
        asked = queries[some].astype(np.float32)
        truth = asked @ self.unit.T >= cosine
        want = int(truth.sum())
        while width < n:
            row, node = self.within(asked, cosine, width)
            if truth[row, node].sum() >= RECALL * want:
                break
            width *= 2
        return width


def _unit(table: np.ndarray) -> np.ndarray:
    scaled = table / np.abs(table).max(axis=1, keepdims=True)  # so that squares stay in range
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


_SHARDS = "label string, dim int, shard int, shards int, rows binary, counts binary, vectors binary, layers array<binary>, entry int, beam int"


def _build_shard(cosine: float):
    def work(table: pa.Table) -> pa.Table:
        label, dim, shard, shards = (table.column(c)[0].as_py() for c in ("label", "dim", "shard", "shards"))
        rows = table.column("row").to_numpy()
        order = np.argsort(rows)
        counts = table.column("count").to_numpy()[order]
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(flat.reshape(len(rows), dim))[order]
        graph = Graph(unit)
        beam = graph.audited_beam(cosine, unit)
        values = [label, dim, shard, shards, rows[order].tobytes(), counts.tobytes(), unit.tobytes(), [x.tobytes() for x in graph.layers], graph.entry, beam]
        kinds = (pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 3, pa.list_(pa.binary()), pa.int32(), pa.int32())
        names = [part.split()[0] for part in _SHARDS.split(", ")]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    return work


def _opened(table: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph, int]:
    row = {c: table.column(c)[at].as_py() for c in table.column_names}
    rows = np.frombuffer(row["rows"], np.int64)
    unit = np.frombuffer(row["vectors"], np.float64).reshape(len(rows), -1)
    layers = [np.frombuffer(x, np.int32).reshape(len(rows), -1) for x in row["layers"]]
    return rows, np.frombuffer(row["counts"], np.int64), unit, Graph(unit, layers, row["entry"]), row["beam"]


def _compare_cell(cosine: float):
    def work(table: pa.Table) -> pa.Table:
        shards = [_opened(table, at) for at in range(len(table))]
        if len(shards) == 1:
            rows, times, unit, graph, beam = shards[0]
            a, b = graph.within(unit, cosine, beam)
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        else:
            (rows_a, times_a, unit_a, graph_a, beam_a), (rows_b, times_b, unit_b, graph_b, beam_b) = shards
            q, node = graph_b.within(unit_a, cosine, graph_b.audited_beam(cosine, unit_a, beam_b))
            r, back = graph_a.within(unit_b, cosine, graph_a.audited_beam(cosine, unit_b, beam_a))
            a, b = np.append(q, back), np.append(node, r) + len(rows_a)
            rows, times, unit = np.append(rows_a, rows_b), np.append(times_a, times_b), np.concatenate([unit_a, unit_b])
        pair = np.unique(a * len(rows) + b)
        a, b = pair // len(rows), pair % len(rows)
        real = np.concatenate([_cosines(unit, a[s], b[s]) >= cosine for s in _parts(len(a))] or [np.empty(0, bool)])
        a, b = a[real], b[real]
        count = (np.bincount(a, times[b], len(rows)) + np.bincount(b, times[a], len(rows))).astype(np.int64)
        root = _roots(len(rows), a, b)
        linked = np.flatnonzero(count)
        return pa.table(
            [pa.array(rows[linked], pa.int64()), pa.array(rows[root[linked]], pa.int64()), pa.array(count[linked], pa.int64())],
            names=["row", "root", "n"],
        )

    return work


def _cosines(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair in double precision, `a` in order; rows with many partners by one product."""
    low, high = int(a[0]), int(a[-1]) + 1
    if (high - low) * len(unit) <= 8 * len(a):
        return (unit[low:high] @ unit.T)[a - low, b]
    return np.einsum("nd,nd->n", unit[a], unit[b])


def _parts(n: int) -> list[slice]:
    return [slice(at, at + (1 << 16)) for at in range(0, n, 1 << 16)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the linked set of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a].copy(), low)
        np.minimum.at(root, root[b].copy(), low)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per input row.

    Vectors are linked when their labels are equal and not null and their cosine is `cosine` or more.
    Vectors of other lengths, null ones, zero ones and those with null or non-finite components link with
    nothing and are components of their own. component_id is the least id reachable; a null id never is
    one unless the whole component has none, and is not kept then. Each row is a vector: repeated rows are
    linked with each other and share an id. An empty table gives an empty result; other columns are ignored.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    base = materialise(
        vectors.select(
            F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
        )
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("dim", F.size("vector"))
        .withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
        .withColumn("equal", F.sha2(F.concat_ws("|", F.array_join("vector", ","), "label"), 256)),
        "vectors",
    )
    same = base.where("fine").groupBy("equal").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("count"))
    same = materialise(same, "nodes")
    used = base.where("fine").join(same.select("row", "count"), "row")
    sizes = used.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = used.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    graphs = materialise(
        dealt.select("label", "dim", "shard", "shards", "row", "count", "vector").groupBy("label", "dim", "shard").applyInArrow(_build_shard(cosine), _SHARDS),
        "graphs",
    )
    cells = graphs.withColumn("other", F.explode(F.expr("sequence(0, shards - 1)"))).withColumns(
        {"low": F.least("shard", "other"), "high": F.greatest("shard", "other")}
    )
    found = materialise(
        cells.groupBy("label", "dim", "low", "high").applyInArrow(_compare_cell(cosine), "row long, root long, n long"), "neighbours"
    )
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("row"), "root")
    nodes = same.join(roots, "row", "left").join(counts, "row", "left")
    nodes = nodes.select("equal", F.coalesce("root", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    alone = base.where("not fine").select("id", F.col("row").alias("root"), F.lit(0).cast("long").alias("n_links"))
    named = base.where("fine").join(nodes, "equal").select("id", "root", "n_links").union(alone)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return (
        named.join(least, "root").select(
            "id",
            F.col("n_links").cast("long").alias("n_links"),
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )
