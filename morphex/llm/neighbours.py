"""The k most similar vectors of every vector, by cosine.

1. Directions are cut into cells by centroids fitted on a bounded sample. A cell with more rows than SHARD_ROWS is split
   by a hash into several shards, so no shard depends on how the data cluster.
2. One task per shard builds a navigable small-world graph of its rows (see ``hnsw``), whose candidate lists give each row
   its best neighbours within the shard. The graph is stored as flat arrays, one table row per shard.
3. Every vector is searched in the shards of the cells whose border is within reach of it. The reach is measured on exact
   lists of hashed queries, so that ROUTE_RECALL of the true neighbours meet. A pair found from either side serves both.
   Where only pairs of a least cosine are wanted, it is measured on those, and nothing less similar is searched or kept;
   lists and searches then begin with the rows below the nearest vectors of the graph's next layer, as many as such pairs need.
4. Results of all shards are merged per vector; reported cosines are computed in double precision.

Large groups of exact copies never enter a shard: any k + 1 of them are indexed, the others' neighbours are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_threshold
from ..runtime import materialise, release
from . import hnsw
from .vectors import matrix, unit, unit32

#: Rows, drawn by a hash, that the centroids are fitted on, in all or for every cell, whichever is more (twice as many in small tables); every row is indexed and searched.
SAMPLE_ROWS = 20_000
SAMPLE_CELL_ROWS = 64
#: Wanted rows of a cell, and the most rows of a shard.
CELL_ROWS = 131_072
SHARD_ROWS = 163_840
#: Cells and shards are so many times smaller where a least cosine is given: searches cost little then, and tasks need less memory.
SIMILAR_PARTS = 2
LEAST_CELLS, MOST_CELLS = 3, 4096
#: Share of the true neighbours that must meet in the searched cells.
ROUTE_RECALL = 0.97
#: Queries whose exact lists over all rows tell how far from a cell's border rows are searched there.
ROUTE_QUERIES = 2048
#: Where a least cosine is given, the reach is ROUTE_MARGIN times the longest needed by its pairs; with fewer than
#: ROUTE_PAIRS of them it is half the distance of two just similar vectors, beyond which none can be.
ROUTE_MARGIN = 1.25
ROUTE_PAIRS = 100
#: Queries that one task answers, and how many of them at once.
QUERY_ROWS = 131_072
SEARCH_ROWS = 32_768
#: The searched shards are taken in turns, so that about this many copies of every vector are under way at once.
COPIES_AT_ONCE = 1
#: Length of the candidate list of a search, and candidates besides the k best whose cosines are computed exactly.
EF = 48
SPARE = 4
#: Up to so many rows are one cell.
SMALL_ROWS = 4096
#: Size of the vectors from which the files of finished phases are worth waiting for; it changes no result.
RELEASE_BYTES = 32 << 20
#: A vector with more copies than this is represented in the index by a few of them.
COPIES = 64

#: Parts of a cell that a shard number has room for.
_PARTS = 1 << 20
_SHARD_SCHEMA = "shard long, rows binary, row_ids binary, links array<binary>, below array<binary>, starts binary, visits int, near binary, cosine binary, target_ends binary, targets binary"
_PAIR_SCHEMA = "a long, b long, cosine double"


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on the unit rows of the sample."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total**2).sum(axis=1))
        lost = size < 1e-9
        total[lost] = x[rng.choice(len(x), int(lost.sum()))]
        c = total / np.sqrt((total**2).sum(axis=1))[:, None]
    return c.astype(np.float32)


def fit_probes(x: np.ndarray, centroids: np.ndarray, k: int, queries: int = 1500, seed: int = 12) -> int:
    """Cells to search per vector if all were searched in equally many (``fit_reach`` needs fewer), so that ROUTE_RECALL of the sample's true neighbour pairs meet in one of them; all cells if need be."""
    cells = len(centroids)
    if cells == 1 or len(x) < 3:
        return 1
    own = np.concatenate([(x[a : a + 4096] @ centroids.T).argmax(axis=1) for a in range(0, len(x), 4096)])
    chosen = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    k, meet = min(k, len(x) - 1), []
    for a in range(0, len(chosen), 256):
        q = chosen[a : a + 256]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -3
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        # how many cells are nearer to a row than that of its neighbour, from either side
        one, two = x[q] @ centroids.T, (x[near.ravel()] @ centroids.T).reshape(len(q), k, cells)
        there = (one[:, None, :] > np.take_along_axis(one, own[near], axis=1)[:, :, None]).sum(axis=2)
        back = (two > np.take_along_axis(two, own[q][:, None, None].repeat(k, 1), axis=2)).sum(axis=2)
        meet.append(np.minimum(there, back).ravel())
    needed = np.sort(np.concatenate(meet))
    return int(needed[int(np.ceil(ROUTE_RECALL * len(needed))) - 1]) + 1


def _apart(centroids: np.ndarray) -> np.ndarray:
    """Distances of the centroids from one another."""
    return np.maximum(np.sqrt(np.maximum(0, 2 - 2 * centroids.astype(np.float64) @ centroids.T.astype(np.float64))), 1e-6).astype(np.float32)


def _route_gaps(q: np.ndarray, ids: np.ndarray, centroids: np.ndarray, k: int, least: float | None):
    """(query, cosine, gap): of every task the k best rows of each query, with how far the nearer one of the pair is from the border to the other's cell."""
    apart = _apart(centroids)
    sort = np.argsort(ids)
    q_s = q @ centroids.T
    q_own = q_s.argmax(axis=1)

    def run(batches):
        best, gap = np.full((len(q), k), -2 if least is None else least - 1e-5, np.float32), np.full((len(q), k), -1, np.float32)
        for batch in batches:
            x, rows = unit32(matrix(batch.column("v"))), batch.column("row_id").to_numpy()
            for a in range(0, len(x), 4096):
                y, at = x[a : a + 4096], rows[a : a + 4096]
                s = q @ y.T
                place = sort[np.minimum(np.searchsorted(ids[sort], at), len(ids) - 1)]
                same = np.flatnonzero(ids[place] == at)
                s[place[same], same] = -3
                bound = best.min(axis=1)
                if bound.min() < -1 and len(y) > k:
                    bound = np.maximum(bound, np.partition(s, len(y) - k, axis=1)[:, len(y) - k] - 1e-6)
                r, c = np.nonzero(s > bound[:, None])
                if not len(r):
                    continue
                of = np.unique(c)
                y_s = np.zeros((len(y), len(centroids)), np.float32)
                y_s[of] = y[of] @ centroids.T
                y_own = y_s.argmax(axis=1)
                d = apart[q_own[r], y_own[c]]
                g = np.minimum(q_s[r, q_own[r]] - q_s[r, y_own[c]], y_s[c, y_own[c]] - y_s[c, q_own[r]]) / d
                n = np.arange(len(r)) - np.searchsorted(r, r)
                for more in range(0, n.max() + 1, k):  # k new ones of each query at a time
                    now = (n >= more) & (n < more + k)
                    new, new_gap = np.full((len(q), k), -3, np.float32), np.zeros((len(q), k), np.float32)
                    new[r[now], n[now] - more], new_gap[r[now], n[now] - more] = s[r[now], c[now]], g[now]
                    both, both_gap = np.concatenate([best, new], axis=1), np.concatenate([gap, new_gap], axis=1)
                    keep = np.argpartition(-both, k - 1, axis=1)[:, :k]
                    best, gap = np.take_along_axis(both, keep, axis=1), np.take_along_axis(both_gap, keep, axis=1)
        query, at = np.nonzero(gap >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, at].astype(np.float64)), pa.array(gap[query, at].astype(np.float64))], names=["query", "cosine", "gap"])

    return run


def fit_reach(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, centroids: np.ndarray, k: int, least_cosine: float | None = None) -> float:
    """How far from a cell's border rows of another are searched in it, from the exact lists of ``queries`` (unit rows, with ``ids`` their row_id) over all ``rows``."""
    if len(centroids) == 1:
        return 0.0
    if not len(queries):
        return 2.0
    lists = rows.select("row_id", "v").mapInArrow(_route_gaps(queries, ids, centroids, k, least_cosine), "query long, cosine double, gap double")
    # at most k numbers a query come to the driver
    best = lists.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "gap")), asc=False), 1, k).alias("best"))
    needed = np.sort([x.gap for r in best.collect() for x in r.best])
    if least_cosine is not None:
        most = float(np.sqrt(max(0.0, 2 - 2 * least_cosine))) / 2
        return most if len(needed) < ROUTE_PAIRS else min(most, ROUTE_MARGIN * float(needed[-1]))
    return float(needed[int(np.ceil(ROUTE_RECALL * len(needed))) - 1]) if len(needed) else 2.0


def _cell_sizes(centroids: np.ndarray):
    """(cell, n) of every batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique((unit32(matrix(batch.column("v"))) @ centroids.T).argmax(axis=1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n)], names=["cell", "n"])

    return run


def _placer(centroids: np.ndarray, reach: float, parts: np.ndarray):
    """Rows with the shard that they live in and the other shards that they are searched in. ``parts``: shards of each cell."""
    apart = _apart(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = unit32(matrix(batch.column("v"))) @ centroids.T
            home = s.argmax(axis=1)
            own = home * _PARTS + batch.column("row_id").to_numpy() % parts[home]
            row, cell = np.nonzero(s[np.arange(len(s)), home][:, None] - s <= reach * apart[home] + 1e-6)
            many = parts[cell]
            first = np.cumsum(many) - many
            target = np.repeat(cell * _PARTS - first, many) + np.arange(many.sum())
            row = np.repeat(row, many)
            other = target != own[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[other], minlength=len(s)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("row_id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(target[other]))], names=["shard", "row_id", "v", "targets"])

    return run


def _pairs_table(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.Table:
    return pa.table({"a": a, "b": b, "cosine": cosine})


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of x[i] and y[j] (stored values), in double precision, a bounded piece at a time."""
    out = np.empty(len(i))
    for a in range(0, len(i), 65_536):
        p, q = x[i[a : a + 65_536]].astype(np.float64), y[j[a : a + 65_536]].astype(np.float64)
        out[a : a + 65_536] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return np.clip(out, -1, 1)


def _index_shard(k: int, least: float | None = None):
    """One shard: its index as flat arrays, and the rows' best neighbours within it (as row numbers and cosines)."""

    def run(table: pa.Table) -> pa.Table:
        raw, ids = matrix(table.column("v")), table.column("row_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        raw = raw[order]
        graph, near, _, placed = hnsw.build(unit32(raw), least=least)
        order = order[placed]
        raw, ids = raw[placed], ids[order]
        near = near[:, : k + SPARE]  # best first; exact cosines decide among a few more than are wanted
        n, width = near.shape
        a, b = np.repeat(np.arange(n), width), near.ravel()
        keep = b >= 0
        cosine = np.full(n * width, -2.0)
        cosine[keep] = _exact(raw, a[keep], raw, b[keep])
        cosine = cosine.reshape(n, width)
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        targets = table.column("targets").combine_chunks().take(pa.array(order))
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "rows": [raw.tobytes()],
                "row_ids": [ids.tobytes()],
                                "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
                "below": pa.array([[x.astype(np.int64).tobytes() for x in graph.below]], pa.list_(pa.binary())),
                "starts": [b"" if graph.starts is None else graph.starts.astype(np.int64).tobytes()],
                "visits": pa.array([graph.visits], pa.int32()),
                "near": [np.take_along_axis(near, best, axis=1).tobytes()],
                "cosine": [np.take_along_axis(cosine, best, axis=1).tobytes()],
                "target_ends": [np.cumsum(targets.value_lengths().to_numpy()).astype(np.int64).tobytes()],
                "targets": [targets.flatten().to_numpy().astype(np.int64).tobytes()],
            }
        )

    return run


def _last_cosines(row: dict) -> np.ndarray:
    """Of every row of a shard the cosine of its k-th neighbour there."""
    return np.frombuffer(row["cosine"], np.float64).reshape(len(row["row_ids"]) // 8, -1)[:, -1]


def _load(row: dict, dims: int) -> tuple[hnsw.Graph, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(row["rows"], np.float32).reshape(-1, dims)
    graph = hnsw.Graph(unit32(raw), [np.frombuffer(x, np.int32).reshape(-1, hnsw.LINKS + hnsw.REVERSE) for x in row["links"]], [np.frombuffer(x, np.int64) for x in row["below"]], np.frombuffer(row["starts"], np.int64), row["visits"])
    return graph, raw, np.frombuffer(row["row_ids"], np.int64), _last_cosines(row)


def _own_results(least: float):
    """Pairs within a shard, from its stored lists, of a cosine of at least ``least``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["row_ids"], np.int64)
                near = np.frombuffer(row["near"], np.int32).reshape(len(ids), -1)
                a, b = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
                cosine = np.frombuffer(row["cosine"], np.float64)
                keep = (b >= 0) & (cosine >= least)
                yield from _pairs_table(ids[a[keep]], ids[b[keep]], cosine[keep]).to_batches(max_chunksize=50_000)

    return run


def _best_of(group: np.ndarray, value: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """True for the k greatest values of each group among the entries ``of``."""
    at = np.flatnonzero(of)
    order = at[np.lexsort((-value[at], group[at]))]
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    out = np.zeros(len(group), bool)
    out[order[rank < k]] = True
    return out


def _turn(shard, turns: int):
    """Turn in which a shard is searched, of a column as of an array."""
    cell = F.shiftright(shard, 20) if isinstance(shard, Column) else shard >> 20
    return (cell + shard % _PARTS) % turns


def _queries(dims: int, turn: int, turns: int):
    """(shard, row_id, v, kth): the rows of a shard as queries to the other shards that they are searched in and that are in turn."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, ids, kth = np.frombuffer(row["rows"], np.float32).reshape(-1, dims), np.frombuffer(row["row_ids"], np.int64), _last_cosines(row)
                ends, targets = np.frombuffer(row["target_ends"], np.int64), np.frombuffer(row["targets"], np.int64)
                due = np.flatnonzero(_turn(targets, turns) == turn)
                of, targets = np.searchsorted(ends, due, side="right"), targets[due]
                for a in range(0, len(targets), 20_000):
                    r = of[a : a + 20_000]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(r) * dims + 1, dims, dtype=np.int32)), pa.array(raw[r].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(targets[a : a + 20_000]), pa.array(ids[r]), v, pa.array(kth[r])], names=["shard", "row_id", "v", "kth"])

    return run


def _search_shard(k: int, dims: int, ef: int, least: float):
    """Queries from other shards against one shard: pairs of a cosine of at least ``least`` that improve either side's list."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _pairs_table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        graph, raw, ids, kth = _load(index.to_pylist()[0], dims)
        parts = [_search_rows(graph, raw, ids, kth, queries.slice(a, SEARCH_ROWS), k, ef, least) for a in range(0, queries.num_rows, SEARCH_ROWS)]
        a, b, cosine = (np.concatenate([p[i] for p in parts]) for i in range(3))
        best = _best_of(a, cosine, np.ones(len(a), bool), k)
        return _pairs_table(a[best], b[best], cosine[best])

    return run


def _search_rows(graph: hnsw.Graph, raw: np.ndarray, ids: np.ndarray, kth: np.ndarray, queries: pa.Table, k: int, ef: int, least: float = -2.0) -> tuple[np.ndarray, ...]:
    """(a, b, cosine): b is near a; a is a query that b improves, or a row of the shard that the query b improves."""
    q, q_ids, q_kth = matrix(queries.column("v")), queries.column("row_id").to_numpy(), np.maximum(queries.column("kth").to_numpy(), least)
    kth = np.maximum(kth, least)
    if least > -2:  # also what doesn't improve the query's own list may improve that of a row of the shard
        found, sim = graph.search_similar(unit32(q), ef, np.full(len(q), least))
    else:
        found, sim = graph.search(unit32(q), ef, q_kth)
    near, slack = found >= 0, 1e-5
    better = near & (sim >= q_kth[:, None] - slack)
    serves = near & (sim >= kth[np.maximum(found, 0)] - slack)
    r, c = np.nonzero(better | serves)
    j = found[r, c]
    cosine = _exact(q, r, raw, j)
    wanted = cosine >= least
    one, two = (of & _best_of(side, cosine, of, k) for side, of in ((r, better[r, c] & wanted), (j, serves[r, c] & wanted)))
    return np.concatenate([q_ids[r][one], ids[j][two]]), np.concatenate([ids[j][one], q_ids[r][two]]), np.concatenate([cosine[one], cosine[two]])


def _target_counts(batches):
    """(shard, n): queries to each shard, per batch."""
    for batch in batches:
        for row in batch.to_pylist():
            shard, n = np.unique(np.frombuffer(row["targets"], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(n)], names=["shard", "n"])


def copy_groups(rows: DataFrame, k: int) -> DataFrame | None:
    """(v, ids, n) of vectors with more than COPIES copies: their least k + 1 ids; None if there are none."""
    heavy = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES).select("h")
    heavy = materialise(heavy)  # at most rows / COPIES hashes
    if heavy.isEmpty():
        return None
    same = rows.withColumn("h", F.xxhash64("v")).join(heavy, "h")
    # least ids first within hashed parts of a group, then over its parts: no task holds a whole group
    part = same.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    few = part.withColumn("at", F.row_number().over(Window.partitionBy("v", "part").orderBy("id")))
    few = few.groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("at") <= k + 1, F.col("id"))).alias("ids"))
    return few.groupBy("v").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).where(F.col("n") > COPIES)


def members_of_copies(rows: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``copies`` (v, n, ...) on v. Rows of the largest groups, at most a bounded number, meet theirs by broadcast."""
    hot = F.broadcast(copies.where(F.col("n") > hot_threshold(total)))
    cold = copies.where(F.col("n") <= hot_threshold(total))
    return rows.join(hot, "v").unionByName(rows.join(hot.select("v"), "v", "left_anti").join(cold, "v"))


def nearest_neighbours(vectors: DataFrame, k: int = 5, ef: int = EF, least_cosine: float | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): of every row of ``vectors`` (id, v) its ``k`` most similar others, best first.

    ids must be unique, vectors usable (see ``usable_vectors``). Every vector is indexed and every vector is a query.
    A member of a group of more than COPIES exact copies gets the least other ids of its group; other ties go to the
    row that comes first in the materialised input. With fewer than k + 1 rows all others are given; one row or none gives no rows.
    ``least_cosine`` leaves out less similar neighbours: the ranks of the others don't depend on them, so they aren't looked for.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select("id", "v").withColumn("row_id", F.monotonically_increasing_id()))
    del vectors
    total = rows.count()
    first = rows.select("v").first()
    if first is None:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    dims = len(first.v)
    drop_files = (lambda: release(spark)) if total * dims * 4 > RELEASE_BYTES else (lambda: None)
    drop_files()
    copies = copy_groups(rows, k)
    indexed, copied = rows, None
    if copies is not None:
        copies = materialise(copies)
        member = members_of_copies(rows, copies, total)
        drop = member.where(~F.array_contains("ids", F.col("id"))).select("row_id")
        indexed = rows.join(drop, "row_id", "left_anti")
        own = F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)
        copied = member.select("id", F.posexplode(own).alias("rank", "neighbour")).select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("rank") + 1).alias("rank"))
        copied_ids = member.select("row_id")

    smaller = 1 if least_cosine is None else SIMILAR_PARTS
    cells = int(min(MOST_CELLS, max(LEAST_CELLS, -(-total * smaller // CELL_ROWS)))) if total > SMALL_ROWS else 1
    every = max(1, total // max(SAMPLE_ROWS, SAMPLE_CELL_ROWS * cells))  # so at most twice as many come
    in_sample = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(every)) == 0
    drawn = rows.where(in_sample).select("row_id", "v").collect()
    sample = unit32(np.array([r.v for r in drawn], np.float32).reshape(-1, dims))
    centroids = fit_centroids(sample, cells)
    ids = np.array([r.row_id for r in drawn], np.int64)
    asking = np.arange(len(ids)) if copies is None else np.flatnonzero(np.isin(ids, [r.row_id for r in indexed.where(in_sample).select("row_id").collect()]))
    asking = np.sort(np.random.default_rng(12).choice(asking, min(ROUTE_QUERIES, len(asking)), replace=False))
    reach = fit_reach(indexed, sample[asking], ids[asking], centroids, min(k, total - 1), least_cosine)
    del drawn, sample
    least = -2.0 if least_cosine is None else least_cosine
    # counts of cells decide into how many shards each is split; at most MOST_CELLS numbers
    sizes = {r.cell: r.n for r in indexed.select("v").mapInArrow(_cell_sizes(centroids), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    parts = np.array([max(1, -(-sizes.get(c, 0) * smaller // SHARD_ROWS)) for c in range(len(centroids))])
    placed = indexed.select("row_id", "v").mapInArrow(_placer(centroids, reach, parts), "shard long, row_id long, v array<float>, targets array<long>")
    index = materialise(placed.groupBy("shard").applyInArrow(_index_shard(k, least_cosine), _SHARD_SCHEMA))
    names = materialise(rows.select("row_id", "id"))
    del placed, indexed, rows
    drop_files()

    pairs = index.select("row_ids", "near", "cosine").mapInArrow(_own_results(least), _PAIR_SCHEMA)
    if len(parts) > 1 or parts.max() > 1:
        # a shard that most rows are searched in is searched by several tasks; at most one number a shard
        asked = {r.shard: r.n for r in index.select("targets").mapInArrow(_target_counts, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        # of a cell that is searched by more than QUERY_ROWS, every shard is searched by several tasks
        most = np.ones(len(parts), np.int64)
        for x, n in asked.items():
            most[x // _PARTS] = max(most[x // _PARTS], -(-n // QUERY_ROWS))
        tasks = F.array(*(F.lit(int(x)).cast("long") for x in most))[F.shiftright("shard", 20).cast("int")]  # at most MOST_CELLS numbers
        turns = max(1, -(-sum(asked.values()) // (COPIES_AT_ONCE * total)))
        for turn in range(turns):
            now = _turn(F.col("shard"), turns) == turn
            queries = index.select("rows", "row_ids", "cosine", "target_ends", "targets").mapInArrow(_queries(dims, turn, turns), "shard long, row_id long, v array<float>, kth double")
            queries = queries.withColumn("task", F.pmod(F.xxhash64("row_id"), tasks))
            part = index.where(now).select("shard", "rows", "row_ids", "cosine", "links", "below", "starts", "visits", F.explode(F.sequence(F.lit(0).cast("long"), tasks.cast("long") - 1)).alias("task"))
            found = materialise(part.groupBy("shard", "task").cogroup(queries.groupBy("shard", "task")).applyInArrow(_search_shard(k, dims, ef, least), _PAIR_SCHEMA))
            pairs = pairs.unionByName(found)
            del queries, part, found
            drop_files()
    if copied is not None:
        pairs = pairs.join(copied_ids.withColumnRenamed("row_id", "a"), "a", "left_anti")
    # a pair found from both sides has one rank and is kept once, still within the partitioning by a
    ranked = pairs.withColumn("rank", F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k).dropDuplicates(["a", "b"])
    named = ranked.join(names.select(F.col("row_id").alias("b"), F.col("id").alias("neighbour")), "b").join(names.select(F.col("row_id").alias("a"), "id"), "a").select("id", "neighbour", "cosine", "rank")
    return named if copied is None else named.unionByName(copied)


def _exact_lists(ids: list[str], q: np.ndarray, k: int):
    """(query, cosine): the k greatest cosines of each query's other rows, of every task."""

    def run(batches):
        best = np.full((len(q), k), -2.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, names = unit(matrix(batch.column("v"))), np.array(batch.column("id").to_pylist(), object)
            s = q @ x.T
            s[np.array(ids, object)[:, None] == names[None, :]] = -3
            best = -np.sort(-np.concatenate([best, s], axis=1), axis=1)[:, :k]
        row, at = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best[row, at])], names=["query", "cosine"])

    return run


def measured_recall(vectors: DataFrame, neighbours: DataFrame, k: int = 5, queries: int = 500) -> DataFrame:
    """(n_queries, n_wanted, n_found, recall) of ``neighbours`` against all rows of ``vectors``, for about ``queries`` hashed rows.

    A given neighbour counts as found if it is at least as similar as the k-th of the exact list. Exact lists come from blocks of all
    rows against the queries, whose number is bounded; one row or none gives no queries and a null recall.
    """
    rows = vectors.select("id", "v")
    every = max(1, rows.count() // queries)
    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(8 * queries).collect()  # a bounded query set, as documented
    if not asked:
        return vectors.sparkSession.createDataFrame([(0, 0, 0, None)], "n_queries long, n_wanted long, n_found long, recall double")
    ids = [r.id for r in asked]
    exact = rows.mapInArrow(_exact_lists(ids, unit(np.array([r.v for r in asked], np.float32)), k), "query long, cosine double")
    exact = exact.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("cosine"), asc=False), 1, k).alias("best"))  # at most k numbers a task
    names = vectors.sparkSession.createDataFrame(list(enumerate(ids)), "query long, id string")
    wanted = names.join(exact, "query").select("id", F.size("best").alias("wanted"), F.element_at("best", -1).alias("kth"))
    hits = neighbours.join(F.broadcast(wanted), "id").groupBy("id").agg(F.count_if(F.col("cosine") >= F.col("kth") - 1e-9).alias("hits"))
    both = wanted.join(hits, "id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("wanted").alias("n_wanted"), F.sum(F.least("wanted", F.coalesce("hits", F.lit(0)))).alias("n_found"))
    return both.withColumn("recall", F.col("n_found") / F.col("n_wanted"))
