"""How well neighbours share labels: recall, average precision, cross-validated nearest-neighbour and linear accuracy.

Rankings need all pairs of a cohort, so they start from the budgeted pair table of ``distances``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import unit_vector
from ..runtime import materialise
from .distances import BLOCK_ROWS, PAIR_BUDGET, check_pair_budget, id_order, symmetric


def ranked_neighbours(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, d, rank, same): every other row of the labelled cohort by distance, ties to the lesser id; same label or not."""
    known = labels.where(F.col("label").isNotNull()).select("id", "label")
    both = symmetric(pairs).join(known.select(F.col("id").alias("i"), F.col("label").alias("label_i")), "i").join(known.select(F.col("id").alias("j"), F.col("label").alias("label_j")), "j")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return both.select("i", "j", "d", rank.alias("rank"), (F.col("label_i") == F.col("label_j")).alias("same"), "label_i", "label_j")


def query_ranks(vectors: DataFrame, budget: int = PAIR_BUDGET) -> DataFrame:
    """(i, first, ap) of every labelled row of ``vectors`` (id, v, label): rank of the nearest row of its label, and its average precision.

    Nulls where no other row has the label. A task ranks the rows of one block against the whole cohort, which the pair budget
    bounds, and sends one row a query; ties in distance go to the lesser id.
    """
    rows = vectors.where(F.col("label").isNotNull())
    n = rows.count()
    check_pair_budget(n, budget)
    blocks = max(1, -(-n // BLOCK_ROWS))
    rows = rows.select("id", unit_vector("v").alias("v"), F.xxhash64("label").alias("label"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        table = table.take(pa.array(np.argsort(id_order(ids))))
        ids, label = table.column("id").combine_chunks(), table.column("label").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        own = np.flatnonzero(table.column("block").to_numpy() == table.column("task")[0].as_py())
        first, ap = np.zeros(len(own), np.int64), np.zeros(len(own))
        for a in range(0, len(own), 128):
            q = own[a : a + 128]
            d = np.clip(1 - v[q] @ v.T, 0, 2)
            d[np.arange(len(q)), q] = np.inf  # last, and cut off
            same = (label[np.argsort(d, axis=1, kind="stable")] == label[q][:, None])[:, :-1]
            rank = np.arange(1, same.shape[1] + 1)
            hits = same.sum(axis=1)
            first[a : a + 128] = np.where(hits > 0, same.argmax(axis=1) + 1, 0)
            ap[a : a + 128] = (np.cumsum(same, axis=1) / rank * same).sum(axis=1) / np.maximum(hits, 1)
        none = first == 0
        return pa.table({"i": ids.take(pa.array(own)), "first": pa.array(first, mask=none), "ap": pa.array(ap, mask=none)})

    everywhere = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return everywhere.groupBy("task").applyInArrow(run, T.StructType([T.StructField("i", vectors.schema["id"].dataType), T.StructField("first", T.LongType()), T.StructField("ap", T.DoubleType())]))


def recall_of(ranks: DataFrame, ks: list[int], n: int) -> DataFrame:
    """``recall_at`` from ``query_ranks``."""
    one = ranks.select(F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"), "first").groupBy("k").agg(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))
    return one.select("k", F.when((F.col("k") >= 1) & (F.col("k") <= n - 1), F.col("recall")).alias("recall"))


def recall_at(ranked: DataFrame, ks: list[int], n: int) -> DataFrame:
    """(k, recall): share of queries with an equal label among their k nearest; null unless 1 <= k <= n - 1."""
    best = ranked.groupBy("i").agg(F.min(F.when(F.col("same"), F.col("rank"))).alias("first"))
    one = best.select(F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"), "first").groupBy("k").agg(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))
    return one.select("k", F.when((F.col("k") >= 1) & (F.col("k") <= n - 1), F.col("recall")).alias("recall"))


def mean_average_precision(ranked: DataFrame) -> DataFrame:
    """One row mAP over the queries with a relevant row; null if there is none."""
    w = Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranked.withColumn("hits", F.sum(F.col("same").cast("long")).over(w)).where("same")
    return hits.groupBy("i").agg(F.avg(F.col("hits") / F.col("rank")).alias("ap")).agg(F.avg("ap").alias("mAP"))


def stratified_folds(labels: list, splits: int = 5, seed: int = 42) -> np.ndarray | None:
    """Fold of each row (labels in row order) by the published shuffled stratified scheme; null if it can't be done.

    splits is cut to the smallest class; fewer than two classes or a class of one row has no folds.
    """
    first: dict = {}
    y = np.array([first.setdefault(x, len(first)) for x in labels])
    if len(first) < 2:
        return None
    counts = np.bincount(y)
    splits = min(splits, int(counts.min()))
    if splits < 2:
        return None
    ordered = np.sort(y)
    allocation = np.array([np.bincount(ordered[i::splits], minlength=len(counts)) for i in range(splits)])
    rng, out = np.random.RandomState(seed), np.empty(len(y), int)
    for k in range(len(counts)):
        folds = np.arange(splits).repeat(allocation[:, k])
        rng.shuffle(folds)
        out[y == k] = folds
    return out


#: Rows of a cohort whose labels may come to the driver to be folded.
MOST_COHORT = 200_000


def with_folds(rows: DataFrame, splits: int = 5, seed: int = 42) -> DataFrame | None:
    """(id, label, fold) of the labelled cohort in id order, or null."""
    listed = rows.where(F.col("label").isNotNull()).select("id", "label").orderBy("id").limit(MOST_COHORT + 1).collect()
    if len(listed) > MOST_COHORT:
        raise ValueError(f"more than {MOST_COHORT} labelled rows; sample the cohort first")
    folds = stratified_folds([r.label for r in listed], splits, seed)
    if folds is None:
        return None
    return rows.sparkSession.createDataFrame([(r.id, r.label, int(f)) for r, f in zip(listed, folds)], rows.select("id", "label").schema.add("fold", T.IntegerType()))


def knn_accuracy(pairs: DataFrame, folded: DataFrame, ks: list[int]) -> DataFrame:
    """(k, accuracy): mean over folds of the accuracy of the majority of the k nearest rows of the other folds.

    Ties in the vote go to the lesser label. Null where k exceeds the smallest training fold.
    """
    a, b = folded.select(F.col("id").alias("i"), F.col("label").alias("true"), F.col("fold").alias("f")), folded.select(F.col("id").alias("j"), "label", F.col("fold").alias("g"))
    met = symmetric(pairs).join(a, "i").join(b, "j").where(F.col("f") != F.col("g"))
    near = met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= max(ks))
    votes = near.select("i", "true", "f", "label", "rank", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).where(F.col("rank") <= F.col("k"))
    counted = votes.groupBy("k", "f", "i", "true", "label").agg(F.count(F.lit(1)).alias("n"))
    winner = counted.withColumn("r", F.row_number().over(Window.partitionBy("k", "i").orderBy(F.desc("n"), "label"))).where(F.col("r") == 1)
    per_fold = winner.groupBy("k", "f").agg(F.avg((F.col("label") == F.col("true")).cast("double")).alias("a"))
    least = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") - F.max("n")).alias("train"))
    return per_fold.groupBy("k").agg(F.avg("a").alias("a")).crossJoin(least).select("k", F.when(F.col("k") <= F.col("train"), F.col("a")).alias("accuracy"))


def finite_mean(scores: DataFrame, value: str) -> DataFrame:
    """One row: the mean, null if any score is null or not finite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    return scores.agg(F.when(~F.coalesce(F.bool_or(bad), F.lit(True)), F.avg(value)).alias("mean"))


def linear_probe(vectors: DataFrame, folded: DataFrame, c: float = 1.0, steps: int = 1000) -> DataFrame:
    """One row: accuracy and balanced accuracy (mean recall of classes) of multinomial logistic regression over the folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.join(folded, "id").withColumn("features", array_to_vector(F.col("v").cast("array<double>"))).withColumn("name", F.col("label").cast("string"))
    rows = materialise(StringIndexer(inputCol="name", outputCol="target", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("id", "features", "target", "fold"))
    scores = None
    for k in [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]:
        train = rows.where(F.col("fold") != k)
        n = train.count()
        model = LogisticRegression(labelCol="target", family="multinomial", standardization=False, regParam=1 / (c * n), elasticNetParam=0, maxIter=steps).fit(train)
        out = model.transform(rows.where(F.col("fold") == k)).select("target", (F.col("prediction") == F.col("target")).cast("double").alias("hit"))
        by = out.groupBy("target").agg(F.avg("hit").alias("recall"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
        one = by.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))
        scores = one if scores is None else scores.unionByName(one)
    return scores.agg(F.avg("accuracy").alias("accuracy"), F.avg("balanced_accuracy").alias("balanced_accuracy"))


def kmeans_clusters(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.scalars import unit_vector

    rows = vectors.select("id", array_to_vector(unit_vector("v")).alias("features"))
    return KMeans(k=k, seed=seed, initSteps=5, maxIter=50).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def cohort_sample(ids: list, most: int, seed: int = 42) -> list:
    """Sorted seeded draw without replacement, the same as numpy's; all ids if ``most`` is not positive or not less."""
    if most <= 0 or most >= len(ids):
        return list(ids)
    return [ids[i] for i in np.sort(np.random.default_rng(seed).choice(len(ids), most, replace=False))]
