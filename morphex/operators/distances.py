"""All-pairs distances of a bounded cohort in blocks, and what is derived from them.

The number of pairs is quadratic, so every entry point checks a budget of pairs first. Within it, rows are hashed
into blocks; one task takes one pair of blocks and computes it as a matrix product. Nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import doubles, unit_vector

#: Pairs that a cohort may have; above it the operators refuse.
PAIR_BUDGET = 50_000_000
BLOCK_ROWS = 512
METRICS = ("cosine", "euclidean")


def check_pair_budget(n: int, budget: int = PAIR_BUDGET) -> int:
    pairs = n * (n - 1) // 2
    if pairs > budget:
        raise ValueError(f"{n} rows make {pairs} pairs; the budget is {budget}")
    return pairs


def _values(table: pa.Table, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the first block, rows of the second, their distances): every pair of two blocks once, as places in the task's table."""
    one, two = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
    block = table.column("block").to_numpy()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
    dots = v[a] @ v[b].T
    if metric == "cosine":
        d = np.clip(1 - dots, 0, 2)
    else:
        d = np.sqrt(np.maximum(((v[a] ** 2).sum(axis=1))[:, None] + (v[b] ** 2).sum(axis=1)[None, :] - 2 * dots, 0))
    if "scale" in table.column_names:
        s = table.column("scale").to_numpy()
        d = d / np.maximum(np.sqrt(s[a][:, None] * s[b][None, :]), LEAST_SCALE)
    return a, b, d


def _each_once(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(len(a), 1) if same else tuple(x.ravel() for x in np.indices((len(a), len(b))))


def id_order(ids: pa.Array) -> np.ndarray:
    """Rank of each id, in the order in which Spark sorts them."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _met(vectors: DataFrame, metric: str, budget: int, unit: bool, more: list[str] | None = None) -> DataFrame:
    """Rows (id, v, block and ``more``) with the pair of blocks (b1, b2) for which they are needed; every task takes one pair."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    n = vectors.count()
    check_pair_budget(n, budget)
    blocks = max(1, -(-n // BLOCK_ROWS))
    x = unit_vector("v") if unit else doubles("v")
    rows = vectors.select("id", x.alias("v"), *(more or [])).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other")


def pair_distances(vectors: DataFrame, metric: str = "cosine", budget: int = PAIR_BUDGET, unit: bool = True) -> DataFrame:
    """(i, j, d) with i < j for all pairs of rows of ``vectors`` (id, v).

    Vectors are scaled to length one first (a zero vector stays zero, at cosine distance 1 from all), for both metrics
    unless ``unit`` is false. Fewer than two rows give no pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, d = _values(table, metric)
        r, c = _each_once(a, b, table.column("b1")[0].as_py() == table.column("b2")[0].as_py())
        left, right = a[r], b[c]
        ids = table.column("id").combine_chunks()
        order = id_order(ids)
        swap = order[left] > order[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        return pa.table([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(d[r, c])], names=["i", "j", "d"])

    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("d", T.DoubleType())])
    return _met(vectors, metric, budget, unit).groupBy("b1", "b2").applyInArrow(run, schema)


#: Bits of a distance that a first count drops (so 1 024 bins for every doubling), and values that may come to the driver.
DROPPED_BITS = 42
FEW_VALUES = 500_000
LEAST_SCALE = 1e-10
PERCENTILES = {"median": 0.5, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _bits(d: np.ndarray) -> np.ndarray:
    """Integers in the order of the distances, none of which is negative."""
    return np.ascontiguousarray(d + 0.0).view(np.int64)


def cohort_summary(vectors: DataFrame, metric: str = "cosine", unit: bool = True, scale: str | None = None, budget: int = PAIR_BUDGET) -> DataFrame:
    """``distance_summary`` of all pairs of ``vectors`` (id, v), without a pair leaving its task.

    Tasks send sums and counts of bins, which hold the leading bits of the distances; the bins that hold the wanted ranks are refined by
    further bits until few enough values are left to be read. ``scale``: a column of local scales by which distances are divided
    (see ``local_scales``).
    """
    spark = vectors.sparkSession
    rows = vectors.withColumnRenamed(scale, "scale") if scale else vectors
    met = _met(rows, metric, budget, unit, ["scale"] if scale else None)

    def each(table: pa.Table) -> np.ndarray:
        a, b, d = _values(table, metric)
        return d[_each_once(a, b, table.column("b1")[0].as_py() == table.column("b2")[0].as_py())]

    def count(table: pa.Table) -> pa.Table:
        d = each(table)
        if not len(d):
            return pa.table({"bin": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64()), "s": pa.array([], pa.float64()), "ss": pa.array([], pa.float64())})
        code = _bits(d) >> DROPPED_BITS
        bins, at = np.unique(code, return_inverse=True)
        low, high = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(low, at, d)
        np.maximum.at(high, at, d)
        return pa.table({"bin": bins, "n": np.bincount(at), "low": low, "high": high, "s": np.bincount(at, d), "ss": np.bincount(at, d * d)})

    counted = met.groupBy("b1", "b2").applyInArrow(count, "bin long, n long, low double, high double, s double, ss double")
    found = sorted(counted.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")), F.min("low").alias("low"), F.max("high").alias("high")).collect())  # a row a bin
    n = sum(r.n for r in found)
    names = ["n_pairs", "min", "max", "mean", "std", *PERCENTILES]
    schema = T.StructType([T.StructField("n_pairs", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])])
    if not n:
        return spark.createDataFrame([(0, *([None] * (len(names) - 1)))], schema)
    mean = sum(r.s for r in found) / n
    std = float(np.sqrt(max(0.0, sum(r.ss for r in found) / n - mean * mean)))
    places = {p: (n - 1) * p for p in PERCENTILES.values()}
    ranks = sorted({int(f(x)) for x in places.values() for f in (np.floor, np.ceil)})
    values = _at_ranks(met, each, [(r.bin, r.n) for r in found], ranks, DROPPED_BITS)
    at = lambda x: values[int(np.floor(x))] + (values[int(np.ceil(x))] - values[int(np.floor(x))]) * (x - np.floor(x))
    row = (n, min(r.low for r in found), max(r.high for r in found), float(mean), std, *(float(at(places[p])) for p in PERCENTILES.values()))
    return spark.createDataFrame([row], schema)


def _at_ranks(met: DataFrame, each, bins: list[tuple[int, int]], ranks: list[int], dropped: int) -> dict[int, float]:
    """Exact values at the ranks (from 0): ``bins`` (leading bits, count) in order, ``dropped`` bits left open."""
    ends = np.cumsum([n for _, n in bins])
    hit = {r: int(np.searchsorted(ends, r, side="right")) for r in ranks}
    wanted = sorted(set(hit.values()))
    codes = np.array([bins[i][0] for i in wanted])
    inside = sum(bins[i][1] for i in wanted)
    finer = dropped if inside > FEW_VALUES and dropped else 0
    left = max(0, dropped - 16) if finer else 0

    def run(table: pa.Table) -> pa.Table:
        d = _bits(each(table))
        d = d[np.isin(d >> dropped, codes)] >> left
        code, n = np.unique(d, return_counts=True)
        return pa.table({"code": code, "n": n})

    got = sorted((r.code, r.n) for r in met.groupBy("b1", "b2").applyInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect())
    out: dict[int, float] = {}
    for i in wanted:
        own = [(c, n) for c, n in got if c >> (dropped - left) == bins[i][0]]
        before = int(ends[i - 1]) if i else 0
        local = {r: r - before for r in ranks if hit[r] == i}
        if left:
            exact = _at_ranks(met, each, own, sorted(local.values()), left)
            out |= {r: exact[x] for r, x in local.items()}
        else:
            stops = np.cumsum([n for _, n in own])
            out |= {r: float(np.array([own[int(np.searchsorted(stops, x, side="right"))][0]], np.int64).view(np.float64)[0]) for r, x in local.items()}
    return out


def local_scales(vectors: DataFrame, k: int, metric: str = "cosine", unit: bool = True, budget: int = PAIR_BUDGET) -> DataFrame:
    """``vectors`` + ``scale``, the distance to the k-th nearest other row; rows with fewer than k others are left out.

    Every task sends the k least distances of each row that it meets: at most k numbers for each block.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, d = _values(table, metric)
        same = table.column("b1")[0].as_py() == table.column("b2")[0].as_py()
        if same:
            np.fill_diagonal(d, np.inf)
        rows, best = [], []
        for at, m in ((a, d), *(() if same else ((b, d.T),))):
            few = min(k, m.shape[1])
            if few and len(at):
                rows.append(np.repeat(at, few))
                best.append(np.partition(m, few - 1, axis=1)[:, :few].ravel())
        rows, best = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, int), (best, float)))
        keep = np.isfinite(best)
        return pa.table({"id": table.column("id").combine_chunks().take(pa.array(rows[keep])), "d": best[keep]})

    near = _met(vectors, metric, budget, unit).groupBy("b1", "b2").applyInArrow(run, T.StructType([vectors.schema["id"], T.StructField("d", T.DoubleType())]))
    scale = near.groupBy("id").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1)).alias("scale")).where(F.col("scale").isNotNull())
    return vectors.join(scale, "id")


def distance_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, min, max, mean, population std, median and outer percentiles of all distances; nulls without pairs."""
    q = F.percentile("d", F.array(*(F.lit(p) for p in (0.5, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99))))
    one = pairs.agg(F.count("d").alias("n_pairs"), F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), q.alias("q"))
    return one.select("n_pairs", "min", "max", "mean", "std", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p01", "p05", "p25", "p75", "p95", "p99"))))


def within_class_summary(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label of ``labels`` (id, label): n_samples and the statistics of the distances within it.

    A label with one row has no pairs and null statistics. Null labels are left out.
    """
    known = labels.where(F.col("label").isNotNull()).select("id", "label")
    both = pairs.join(known.select(F.col("id").alias("i"), "label"), "i").join(known.select(F.col("id").alias("j"), F.col("label").alias("label_j")), "j").where(F.col("label") == F.col("label_j"))
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    stats = both.groupBy("label").agg(F.count("d").alias("n_pairs"), F.avg("d").alias("mean"), q.alias("q"), F.stddev_pop("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"))
    out = known.groupBy("label").agg(F.count(F.lit(1)).alias("n_samples")).join(stats, "label", "left")
    return out.select("label", "n_samples", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean", F.col("q")[0].alias("median"), "std", "min", "max", F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair: (i, j, d)."""
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def local_scaling(pairs: DataFrame, k: int) -> DataFrame:
    """d / sqrt(s_i * s_j), s the distance to the k-th neighbour; the divisor is 1e-10 at least."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    scale = symmetric(pairs).withColumn("r", rank).where(F.col("r") == k).select("i", F.col("d").alias("s"))
    joined = pairs.join(scale.select("i", F.col("s").alias("s_i")), "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("s_j")), "j")
    return joined.select("i", "j", (F.col("d") / F.greatest(F.sqrt(F.col("s_i") * F.col("s_j")), F.lit(1e-10))).alias("d"))


def histogram(pairs: DataFrame, bins: int = 60, low: float | None = None, high: float | None = None, logarithmic: bool = False) -> DataFrame:
    """(bin, low, high, n) of the distances, empty bins included; ``logarithmic`` bins the logarithms of the positive ones."""
    rows = pairs.where(F.col("d") > 0).select(F.log10("d").alias("d")) if logarithmic else pairs.select("d")
    if low is None or high is None:
        r = rows.agg(F.min("d"), F.max("d")).first()
        low, high = (r[0] if low is None else low), (r[1] if high is None else high)
    spark = pairs.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col("d") - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col("d").between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative(pairs: DataFrame, points: int = 100) -> DataFrame:
    """(share, d): exact quantiles at ``points`` + 1 equal steps, the data of a cumulative curve."""
    probs = [i / points for i in range(points + 1)]
    q = pairs.agg(F.percentile("d", F.array(*(F.lit(p) for p in probs))).alias("q"))
    return q.select(F.posexplode("q").alias("step", "d")).select((F.col("step") / points).alias("share"), "d")


def paired_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, median, p10 and min of the cosines of rows of equal id in two vector tables."""
    cosine = a.select("id", unit_vector("v").alias("a")).join(b.select("id", unit_vector("v").alias("b")), "id")
    c = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.1)))
    return cosine.agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.min(c).alias("min")).select("n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), "min")


def different_similarity(pairs: DataFrame, most: int = 100_000, seed: int = 0) -> DataFrame:
    """One row: n, median and p90 of the cosines of different rows; more than ``most`` pairs are sampled by a seeded hash."""
    n = pairs.count()
    chosen = pairs if n <= most else pairs.where(F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(n)) < most)
    s = 1 - F.col("d")
    q = F.percentile(s, F.array(F.lit(0.5), F.lit(0.9)))
    return chosen.agg(F.count(F.lit(1)).alias("pair_count"), q.alias("q")).select("pair_count", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, n) of the rows: dims x dims numbers per task reach the driver, never rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([x.sum(axis=0)]), pa.array([(x.T @ x).ravel()])], names=["n", "s", "ss"])

    parts = vectors.select("v").mapInArrow(run, "n long, s array<double>, ss array<double>")
    summed = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("at", "x"), F.size("s").alias("dims")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("dims").alias("dims")).collect()
    if not summed:
        raise ValueError("no rows")
    dims, n = summed[0].dims, summed[0].n
    x = np.zeros(dims + dims * dims)
    for r in summed:
        x[r["at"]] = r.x
    mean = x[:dims] / n
    return mean, (x[dims:].reshape(dims, dims) - n * np.outer(mean, mean)) / max(1, n - 1), n


def whitened(vectors: DataFrame, components: int = 256, least_variance: float = 1e-12) -> DataFrame:
    """(id, v): centred, projected on the leading principal components, each divided by its standard deviation.

    min(components, dims, rows) components, without those whose variance is below ``least_variance``. One pass sums the
    moments, a second projects; the projection is dims x components numbers.
    """
    mean, cov, n = covariance(vectors)
    value, vector = np.linalg.eigh(cov)
    keep = np.argsort(-value)[: min(components, len(mean), n)]
    keep = keep[value[keep] > least_variance]
    basis = vector[:, keep] / np.sqrt(value[keep])
    return _projected(vectors, mean, basis)


def _projected(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(id, v): (v - mean) @ basis, where the rows lie."""

    def run(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(mean)))
            y = (x - mean) @ basis
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: len(y) + 1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), out], names=["id", "v"])

    return vectors.select("id", "v").mapInArrow(run, T.StructType([vectors.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType()))]))


#: Components kept for a number of tokens per image; other numbers keep DEFAULT_COMPONENTS.
TOKEN_COMPONENTS = {10: 256, 20: 512, 30: 1024}
DEFAULT_COMPONENTS = 512


def scaled_components(vectors: DataFrame, tokens: int) -> DataFrame:
    """(id, v): dimensions scaled to mean 0 and population variance 1, projected on their principal components.

    As many components as TOKEN_COMPONENTS says, at most rows - 1 and dims; under three rows the vectors are cut short instead.
    """
    mean, cov, n = covariance(vectors)
    wanted = min(TOKEN_COMPONENTS.get(tokens, DEFAULT_COMPONENTS), len(mean))
    if n < 3:
        return vectors.select("id", F.slice("v", 1, wanted).alias("v"))
    spread = np.sqrt(np.diag(cov) * (n - 1) / n)
    spread[spread < 1e-12] = 1.0
    value, vector = np.linalg.eigh(cov / np.outer(spread, spread))
    return _projected(vectors, mean, vector[:, np.argsort(-value)[: min(wanted, n - 1)]] / spread[:, None])


def distances_for_ids(vectors: DataFrame, ids: DataFrame, metric: str = "cosine", components: int | None = None, k: int | None = None, budget: int = PAIR_BUDGET) -> DataFrame:
    """The pair table of the rows named in ``ids`` (id), by the same steps as a whole run: whitening, distance, scaling."""
    rows = vectors.join(ids.select("id").distinct(), "id", "left_semi")
    pairs = pair_distances(whitened(rows, components) if components else rows, metric, budget)
    return local_scaling(pairs, k) if k else pairs

