"""Cluster quality against labels, reduced to the contingency table, and quality in vector space from group sums."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import doubles, unit_vector


def contingency(rows: DataFrame, true: str = "label", pred: str = "cluster") -> DataFrame:
    """(true, pred, n_ij); rows with a null on either side are left out."""
    return rows.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log(n / total))


def external_metrics(table: DataFrame) -> DataFrame:
    """One row with every label-based metric of a contingency table: pair counting, information, BCubed, purity, counts.

    Only sums over the table and its margins are used, never pairs of rows. Without rows all are null and the counts 0.
    """
    a = table.groupBy("true").agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("k"))
    b = table.groupBy("pred").agg(F.sum("n").alias("b"), F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))
    total = table.agg(F.sum("n").cast("double").alias("_N"))
    cells = table.join(a.select("true", "a"), "true").join(b.select("pred", "b"), "pred").crossJoin(F.broadcast(total))
    inner = cells.agg(
        F.sum(_pairs(F.col("n"))).alias("s"), F.sum(F.col("n") / F.col("_N") * F.log(F.col("_N") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
        (F.sum(F.col("n") * F.col("n") / F.col("b")) / F.first("_N")).alias("bp"), (F.sum(F.col("n") * F.col("n") / F.col("a")) / F.first("_N")).alias("br"),
    )
    rows = a.crossJoin(F.broadcast(total)).agg(F.sum(_pairs(F.col("a"))).alias("sa"), _entropy(F.col("a"), F.col("_N")).alias("ht"), F.count(F.lit(1)).alias("n_true"), F.avg("k").alias("splitting"))
    columns = b.crossJoin(F.broadcast(total)).agg(F.sum(_pairs(F.col("b"))).alias("sb"), _entropy(F.col("b"), F.col("_N")).alias("hp"), F.count(F.lit(1)).alias("n_pred"), F.avg("k").alias("lumping"), (F.sum("top") / F.first("_N")).alias("purity"))
    x = inner.crossJoin(rows).crossJoin(columns).crossJoin(total)
    tiny = 1e-15
    expected = F.col("sa") * F.col("sb") / F.greatest(_pairs(F.col("_N")), F.lit(1.0))
    middle = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.abs(middle - expected) < 1e-12, 1.0).otherwise((F.col("s") - expected) / (middle - expected))
    hom = F.when(F.col("ht") < tiny, 1.0).otherwise(F.col("mi") / F.col("ht"))
    com = F.when(F.col("hp") < tiny, 1.0).otherwise(F.col("mi") / F.col("hp"))
    nmi = F.when((F.col("ht") < tiny) & (F.col("hp") < tiny), 1.0).otherwise(F.col("mi") / ((F.col("ht") + F.col("hp")) / 2))
    x = x.select("*", ari.alias("ARI"), nmi.alias("NMI"), hom.alias("homogeneity"), com.alias("completeness"))
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    f = 2 * F.col("bp") * F.col("br") / (F.col("bp") + F.col("br"))
    known = lambda c: F.when(F.col("_N") > 0, c)
    return x.select(
        known(F.col("NMI")).alias("NMI"), known(F.col("ARI")).alias("ARI"), known(F.col("homogeneity")).alias("homogeneity"), known(F.col("completeness")).alias("completeness"), known(v).alias("V_measure"),
        F.col("bp").alias("BCubed_precision"), F.col("br").alias("BCubed_recall"), f.alias("BCubed_F"), f.alias("BCubed_fscore"), "purity", "splitting", "lumping",
        F.col("n_pred").alias("n_OTUs"), F.col("n_true").alias("n_true_species"), (F.col("n_pred") / F.greatest(F.lit(1), F.col("n_true"))).alias("OTU_species_ratio"),
    )


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by a table up to 32 and the asymptotic series above."""
    n = np.asarray(n, float)
    z = np.maximum(n, 32.0)
    series = z * np.log(z) - z + 0.5 * np.log(2 * np.pi * z) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(n < 32, np.array([math.lgamma(i + 1) for i in range(32)])[np.minimum(n, 31).astype(int)], series)


#: Different class sizes of one side that go to every task: as many as the root of twice the rows at most.
MOST_SIZES = 2_000_000
#: Overlaps summed at once.
OVERLAPS = 1_000_000


def _expected_terms(n: int, sizes: np.ndarray, counts: np.ndarray):
    """Expected mutual information under the hypergeometric model that classes of equal size add, for rows (size, classes) of the other side."""

    def one(x: int, y: int) -> float:
        total = 0.0
        for low in range(max(1, x + y - n), min(x, y) + 1, OVERLAPS):
            k = np.arange(low, min(low + OVERLAPS, min(x, y) + 1))
            log = _log_factorial(x) + _log_factorial(y) + _log_factorial(n - x) + _log_factorial(n - y) - _log_factorial(n) - _log_factorial(k) - _log_factorial(x - k) - _log_factorial(y - k) - _log_factorial(n - x - y + k)
            total += float((k / n * (np.log(n) + np.log(k) - np.log(x) - np.log(y)) * np.exp(log)).sum())
        return total

    def run(batches):
        for batch in batches:
            out = [c * sum(k * one(x, int(y)) for y, k in zip(sizes, counts)) for x, c in zip(batch.column("size").to_pylist(), batch.column("classes").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["e"])

    return run


def adjusted_mutual_information(table: DataFrame) -> float | None:
    """AMI (arithmetic mean) of a contingency table. Classes of equal size are counted together; tasks share the sizes of one side and sum their terms."""
    sizes = lambda side: table.groupBy(side).agg(F.sum("n").alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("classes"))
    a, b = sizes("true"), sizes("pred").limit(MOST_SIZES + 1).collect()
    if len(b) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} different class sizes")
    if not b:
        return None
    n = sum(r["size"] * r.classes for r in b)
    share = F.col("size") / F.lit(float(n))
    true = a.agg(F.sum(-F.col("classes") * share * F.log(share)).alias("h"), F.sum("classes").alias("k")).first()
    hp, kp = -sum(r.classes * r["size"] / n * math.log(r["size"] / n) for r in b), sum(r.classes for r in b)
    if true.k == kp == 1 or true.k == kp == n:
        return 1.0
    mi = external_metrics(table).first().NMI * (true.h + hp) / 2
    terms = _expected_terms(n, np.array([r["size"] for r in b]), np.array([r.classes for r in b]))
    e = a.repartition(max(1, min(64, a.count()))).mapInArrow(terms, "e double").agg(F.sum("e")).first()[0]
    divisor = (true.h + hp) / 2 - e
    return float((mi - e) / (divisor if abs(divisor) > np.finfo(float).eps else math.copysign(np.finfo(float).eps, divisor)))


def group_sums(rows: DataFrame, key: str, v: str = "v", unit: bool = True) -> DataFrame:
    """(key, n, total array): element-wise sum of the (unit) vectors of each group, one partial sum per task and group shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = array_to_vector(unit_vector(v) if unit else doubles(v))
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(x).alias("s"))
    return sums.select(key, "n", vector_to_array("s").alias("total"))


def centroids(rows: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, n, centroid): mean of the stored vectors, scaled to length one unless shorter than 1e-12."""
    s = group_sums(rows, key, v, unit=False)
    return s.select(key, "n", unit_vector(F.transform("total", lambda x: x / F.col("n")), keep_short=True).alias("centroid"))


def within_sum_of_squares(rows: DataFrame, key: str, v: str = "v") -> DataFrame:
    """One row WSS: squared distances from the group means of the stored vectors, as sum |x|^2 - sum |sum x|^2 / n."""
    x = doubles(v)
    squares = rows.where(F.col(key).isNotNull()).agg(F.sum(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)).alias("q"))
    means = group_sums(rows, key, v, unit=False).agg(F.sum(F.aggregate("total", F.lit(0.0), lambda s, e: s + e * e) / F.col("n")).alias("m"))
    return squares.crossJoin(means).select((F.col("q") - F.col("m")).alias("WSS"))


#: Groups whose sums may be broadcast to the rows for the silhouette.
MOST_GROUPS = 20_000


def silhouette(rows: DataFrame, key: str, v: str = "v") -> DataFrame:
    """One row: exact mean cosine silhouette of the groups of ``key``; 0 with fewer than two groups, null without rows.

    Mean cosine distances are linear in a group's sum of unit vectors, so each row needs the sums only, never pairs. A row
    alone in its group counts 0. More than MOST_GROUPS groups are refused, as every row is compared with every sum.
    """
    sums = group_sums(rows, key, v)
    listed = sums.limit(MOST_GROUPS + 1).collect()
    if len(listed) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    n = rows.where(F.col(key).isNotNull())
    if len(listed) < 2:
        return n.agg(F.when(F.count(F.lit(1)) > 0, F.lit(0.0)).alias("silhouette"))
    place = {r[key]: i for i, r in enumerate(listed)}
    total, size = np.array([r.total for r in listed]), np.array([r.n for r in listed], float)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            u = np.stack(pdf["u"].to_numpy())
            own = pdf[key].map(place).to_numpy()
            at = np.arange(len(u))
            dots = u @ total.T
            d = 1 - dots / size
            inner = np.where(size[own] > 1, 1 - (dots[at, own] - np.einsum("ij,ij->i", u, u)) / np.maximum(size[own] - 1, 1), 0)
            d[at, own] = np.inf
            other = d.min(axis=1)
            s = np.where(size[own] > 1, (other - inner) / np.maximum(np.maximum(inner, other), 1e-300), 0)
            yield pd.DataFrame({"n": [len(s)], "s": [s.sum()]})

    parts = n.select(key, unit_vector(v).alias("u")).mapInPandas(run, "n long, s double")
    return parts.agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def label_diagnostics(rows: DataFrame, key: str = "label", v: str = "v") -> DataFrame:
    """One row: mean within-class cosine distance, mean distance of class means, mean and population std of the norms.

    Within a class of n unit vectors the mean over pairs is 1 - (|sum|^2 - sum |u|^2) / (n (n - 1)); class means aren't rescaled.
    """
    sums = group_sums(rows, key, v)
    u = unit_vector(v)
    selfs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.aggregate(u, F.lit(0.0), lambda s, e: s + e * e)).alias("q"))
    square = F.aggregate("total", F.lit(0.0), lambda s, e: s + e * e)
    intra = sums.join(selfs, key).where(F.col("n") > 1).agg(F.avg(1 - (square - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("intra_class_distance"))
    # sum over pairs of class means = (|sum of means|^2 - sum |mean|^2) / 2
    mean = sums.select(key, F.transform("total", lambda x: x / F.col("n")).alias("m"))
    whole = mean.select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    inter = mean.agg(F.count(F.lit(1)).alias("k"), F.sum(F.aggregate("m", F.lit(0.0), lambda s, e: s + e * e)).alias("own")).crossJoin(whole)
    inter = inter.select(F.when(F.col("k") > 1, 1 - (F.col("all") - F.col("own")) / (F.col("k") * (F.col("k") - 1))).alias("inter_class_distance"))
    size = F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, e: s + e * e))
    norms = rows.agg(F.avg(size).alias("norm_mean"), F.stddev_pop(size).alias("norm_std"))
    return intra.crossJoin(inter).crossJoin(norms)


def dimension_spread(rows: DataFrame, v: str = "v") -> DataFrame:
    """One row: the mean over dimensions of the sample standard deviation."""
    return rows.select(F.posexplode(doubles(v)).alias("at", "x")).groupBy("at").agg(F.stddev_samp("x").alias("s")).agg(F.avg("s").alias("feature_std"))


def splitting_optima(metrics: DataFrame, names: list[str], cutoff: str = "cutoff") -> DataFrame:
    """(metric, cutoff, value): the first cutoff at which each metric is greatest; the coarse stage of a two-stage scan."""
    long = metrics.unpivot([cutoff], names, "metric", "value").where(F.col("value").isNotNull())
    best = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), cutoff))
    return long.withColumn("r", best).where(F.col("r") == 1).select("metric", cutoff, "value")


def fine_cutoffs(optima: DataFrame, reach: float = 0.15, step: float = 0.01, least: float = 0.05, most: float = 1.0, cutoff: str = "cutoff") -> DataFrame:
    """(cutoff): the fine grid around the optima of the coarse stage, from the least less ``reach`` to the greatest plus it, within [least, most]."""
    low, high = F.greatest(F.lit(least), F.min(cutoff) - reach), F.least(F.lit(most), F.max(cutoff) + reach)
    grid = optima.agg(low.alias("low"), F.floor((high - low) / step + 1e-6).cast("long").alias("steps"), F.count(cutoff).alias("n")).where(F.col("n") > 0)
    return grid.select("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("at")).select(F.round(F.col("low") + F.col("at") * step, 6).alias("cutoff"))
