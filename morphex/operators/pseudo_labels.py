"""Pseudo-labels for unlabelled rows from a few labelled seeds, as one relational plan.

Candidates are compared with all seeds. Seeds are few by nature (experts label them); their number is checked, and
each task compares its candidates with the broadcast seed matrix, so no pair leaves a task that isn't needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NEAR_DUPLICATE, SEED_BINS, invalid_vector, quantile_triple, seed_bin, unit_vector

#: Seeds whose vectors may be broadcast.
MOST_SEEDS = 50_000
LEAST_CLASS_SEEDS = 3
#: Seeds compared with everything else at once.
SEED_BLOCK = 512
BEST_OF = 3


@dataclass(frozen=True)
class Rules:
    floor: float = 0.75
    gap: float = 0.10
    neighbours: int = 15
    cap_per_seed: int = 3
    cap: int = 50


def _seed_rows(seeds: DataFrame) -> list:
    rows = seeds.where(F.col("label").isNotNull()).select("ref", F.col("label").cast("string").alias("label"), unit_vector("v").alias("u"), invalid_vector("v").alias("bad")).orderBy("ref").limit(MOST_SEEDS + 1).collect()
    if len(rows) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    if any(r.bad for r in rows):
        raise ValueError("a seed has an unusable vector")
    return rows


class _Seeds:
    def __init__(self, rows: list) -> None:
        self.refs = [r.ref for r in rows]
        self.labels = sorted({r.label for r in rows})
        self.of = np.array([self.labels.index(r.label) for r in rows], int) if len(rows) < 500 else np.searchsorted(np.array(self.labels, object), np.array([r.label for r in rows], object)).astype(int)
        self.count = np.bincount(self.of, minlength=len(self.labels))
        self.eligible = self.count >= LEAST_CLASS_SEEDS
        self.x = np.array([r.u for r in rows]).reshape(len(rows), -1)

    def class_scores(self, s: np.ndarray) -> np.ndarray:
        """Mean of the three best seeds of an eligible class, the best seed of another."""
        out = np.empty((len(s), len(self.labels)))
        for k in range(len(self.labels)):
            own = s[:, self.of == k]
            out[:, k] = -np.sort(-own, axis=1)[:, :BEST_OF].mean(axis=1) if self.eligible[k] else own.max(axis=1)
        return out

    def nearest(self, s: np.ndarray, k: int) -> np.ndarray:
        """Seeds (in order of reference) of greatest similarity, ties to the lesser reference."""
        return np.argsort(-s, axis=1, kind="stable")[:, :k]


def _score(seeds: _Seeds, rules: Rules, kind):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = x @ seeds.x.T
            scores = seeds.class_scores(s)
            at = np.arange(len(s))
            best = np.where(seeds.eligible, scores, -np.inf).argmax(axis=1)
            others = scores.copy()
            others[at, best] = -np.inf
            runner = others.argmax(axis=1)
            alone = len(seeds.labels) < 2
            top = s.argmax(axis=1)
            near = seeds.nearest(s, rules.neighbours)
            refs = np.array(seeds.refs, object)
            lists = [[refs[j] for j in row if seeds.of[j] == b] for row, b in zip(near, best)]
            names = np.array(seeds.labels, object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ref"), pa.array(names[best].tolist(), pa.string()), pa.array(scores[at, best]),
                    pa.array([None] * len(s) if alone else names[runner].tolist(), pa.string()), pa.array([None] * len(s) if alone else scores[at, runner].tolist(), pa.float64()),
                    pa.array([None] * len(s) if alone else seeds.eligible[runner].tolist(), pa.bool_()), pa.array(s[at, top]), pa.array(refs[top].tolist(), kind), pa.array(lists, pa.list_(kind)),
                ],
                names=["ref", "label", "score", "runner_up", "runner_score", "runner_eligible", "top_similarity", "top_seed", "near_seeds"],
            )

    return run


def _seed_pools(seeds: _Seeds, rules: Rules, kind):
    """Per task and seed of an eligible class: its best candidates of this task (a partial top-k)."""

    def run(batches):
        k = rules.neighbours
        held_r, held_s = np.full((len(seeds.refs), 0), None, object), np.zeros((len(seeds.refs), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            refs = np.array(batch.column("ref").to_pylist(), object)
            order = np.argsort(refs, kind="stable")
            refs, x = refs[order], x[order]
            rank = {r: i for i, r in enumerate(sorted({*refs.tolist(), *held_r.ravel().tolist()}))}
            new_r, new_s = [], []
            for a in range(0, len(seeds.refs), SEED_BLOCK):  # all seeds of a block at once
                s = seeds.x[a : a + SEED_BLOCK] @ x.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                r, v = np.concatenate([held_r[a : a + SEED_BLOCK], refs[top]], axis=1), np.concatenate([held_s[a : a + SEED_BLOCK], np.take_along_axis(s, top, axis=1)], axis=1)
                best = np.lexsort((np.vectorize(rank.__getitem__, otypes=[np.int64])(r), -v), axis=1)[:, :k]
                new_r.append(np.take_along_axis(r, best, axis=1))
                new_s.append(np.take_along_axis(v, best, axis=1))
            held_r, held_s = np.concatenate(new_r), np.concatenate(new_s)
        seed = [r for r in seeds.refs for _ in range(held_s.shape[1])]
        if seed:
            yield pa.RecordBatch.from_arrays([pa.array(seed, kind), pa.array(held_r.ravel().tolist(), kind), pa.array(held_s.ravel())], names=["seed", "ref", "similarity"])

    return run


def decide(candidates: DataFrame, seeds: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per candidate: its winner and runner-up classes, scores, mutual neighbours, and why it was rejected if it was.

    ``candidates``: (ref, v[, sha]), ``seeds``: (ref, label, v[, sha]). Columns: ref, label, score, runner_up, runner_score, gap,
    seed_count, mutual_seeds, near_duplicate, reasons (array), accepted, pre_cap (would be accepted without the caps),
    rank. Ties go to the lesser reference or label. Unusable candidates have the reason invalid_feature; without an
    eligible class every usable one has no_eligible_class. References must be unique.
    """
    spark = candidates.sparkSession
    listed = _seed_rows(seeds)
    kind = pa.int64() if isinstance(candidates.schema["ref"].dataType, T.LongType) else pa.string()
    sql_kind = candidates.schema["ref"].dataType
    sha = "sha" in candidates.columns and "sha" in seeds.columns
    base = candidates.select("ref", *(["sha"] if sha else []), invalid_vector("v").alias("bad"), unit_vector("v").alias("u"))
    bad = base.where("bad").select("ref")
    good = base.where(~F.col("bad"))
    out = ["ref", "label", "score", "runner_up", "runner_score", "gap", "seed_count", "mutual_seeds", "near_duplicate", "reasons", "pre_cap", "accepted", "rank"]
    # schema of a candidate that was not scored
    empty = lambda df, why: df.select("ref", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("runner_up"), F.lit(None).cast("double").alias("runner_score"), F.lit(None).cast("double").alias("gap"), F.lit(None).cast("int").alias("seed_count"), F.lit(None).cast("int").alias("mutual_seeds"), F.lit(False).alias("near_duplicate"), F.array(F.lit(why)).alias("reasons"), F.lit(False).alias("pre_cap"), F.lit(False).alias("accepted"), F.lit(None).cast("int").alias("rank"))
    s = _Seeds(listed) if listed else None
    if s is None or not s.eligible.any():
        return empty(bad, "invalid_feature").unionByName(empty(good.select("ref"), "no_eligible_class"))
    schema = T.StructType([T.StructField("ref", sql_kind), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runner_up", T.StringType()), T.StructField("runner_score", T.DoubleType()), T.StructField("runner_eligible", T.BooleanType()), T.StructField("top_similarity", T.DoubleType()), T.StructField("top_seed", sql_kind), T.StructField("near_seeds", T.ArrayType(sql_kind))])
    scored = good.select("ref", "u").mapInArrow(_score(s, rules, kind), schema)

    # the pool of a seed: candidates and seeds of other classes
    pools = good.select("ref", "u").mapInArrow(_seed_pools(s, rules, kind), T.StructType([T.StructField("seed", sql_kind), T.StructField("ref", sql_kind), T.StructField("similarity", T.DoubleType())]))
    rivals = []
    for a in range(0, len(s.refs), SEED_BLOCK):  # seeds of other classes, a block of seeds at a time
        own = s.x[a : a + SEED_BLOCK] @ s.x.T
        own[s.of[a : a + SEED_BLOCK, None] == s.of[None, :]] = -np.inf
        for i, top in enumerate(np.argsort(-own, axis=1, kind="stable")[:, : rules.neighbours]):
            rivals += [(s.refs[a + i], s.refs[j], float(own[i, j])) for j in top if own[i, j] > -np.inf]
    if rivals:
        pools = pools.withColumn("rival", F.lit(False)).unionByName(spark.createDataFrame([(*r, True) for r in rivals], pools.withColumn("rival", F.lit(False)).schema))
    else:
        pools = pools.withColumn("rival", F.lit(False))
    best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("similarity"), "ref"))
    backs = pools.withColumn("r", best).where((F.col("r") <= rules.neighbours) & ~F.col("rival")).select("seed", "ref")
    mutual = scored.select("ref", F.explode("near_seeds").alias("seed")).join(backs, ["ref", "seed"]).groupBy("ref").agg(F.count(F.lit(1)).cast("int").alias("mutual_seeds"))

    counts = F.create_map(*(F.lit(x) for k, n in zip(s.labels, s.count) for x in (k, int(n))))
    rows = scored.join(mutual, "ref", "left").withColumn("mutual_seeds", F.coalesce("mutual_seeds", F.lit(0))).withColumn("seed_count", counts[F.col("label")])
    if sha:
        content = seeds.select(F.col("ref").alias("top_seed"), F.col("sha").alias("seed_sha"))
        rows = rows.join(good.select("ref", "sha"), "ref").join(content, "top_seed", "left")
        duplicate = (F.col("top_similarity") > NEAR_DUPLICATE) & (F.col("sha") == F.col("seed_sha"))
    else:
        duplicate = F.lit(False)
    gap = F.col("score") - F.col("runner_score")
    fails = [
        F.when(~(F.col("score") > rules.floor), "floor"),
        F.when(F.col("runner_score").isNull(), "no_runner_up").when(~(gap > rules.gap), F.when(F.col("runner_eligible"), "gap_eligible").otherwise("gap_undersupported")),
        F.when(F.col("mutual_seeds") == 0, "not_mutual"),
    ]
    reasons = F.when(F.coalesce(duplicate, F.lit(False)), F.array(F.lit("expert_content_duplicate"))).otherwise(F.array_compact(F.array(*fails)))
    rows = rows.select("ref", "label", "score", "runner_up", "runner_score", gap.alias("gap"), "seed_count", "mutual_seeds", F.coalesce(duplicate, F.lit(False)).alias("near_duplicate"), reasons.alias("reasons"), *(["sha"] if sha else []))
    rows = rows.withColumn("pre_cap", F.size("reasons") == 0)
    ranks = rows.where("pre_cap").select("ref", (F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "ref")) - 1).alias("rank"))
    rows = rows.join(ranks, "ref", "left")
    capped = F.col("pre_cap") & (F.col("rank") >= F.least(F.lit(rules.cap_per_seed) * F.col("seed_count"), F.lit(rules.cap)))
    rows = rows.withColumn("reasons", F.when(capped, F.array(F.lit("class_cap"))).otherwise(F.col("reasons"))).withColumn("accepted", F.size("reasons") == 0)
    if sha:  # of equal contents the least reference stays; the caps are not filled up again
        first = rows.where("accepted").groupBy("sha").agg(F.min("ref").alias("ref")).select("ref", F.lit(True).alias("first"))
        rows = rows.join(first, "ref", "left")
        again = F.col("accepted") & F.col("first").isNull() & F.col("sha").isNotNull()
        rows = rows.withColumn("reasons", F.when(again, F.array(F.lit("accepted_content_duplicate"))).otherwise(F.col("reasons"))).withColumn("accepted", F.size("reasons") == 0)
    return rows.select(*out).unionByName(empty(bad, "invalid_feature"))


def rejection_counts(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def bin_summary(decisions: DataFrame) -> DataFrame:
    """(bin, candidates, accepted, rate) for every bin of seed counts, empty ones too."""
    got = decisions.groupBy(seed_bin(F.col("seed_count")).alias("bin")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("accepted").alias("accepted"))
    bins = decisions.sparkSession.createDataFrame([(b,) for b in SEED_BINS], "bin string")
    out = bins.join(got, "bin", "left").select("bin", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("accepted", F.lit(0)).alias("accepted"))
    return out.withColumn("rate", F.when(F.col("candidates") > 0, F.col("accepted") / F.col("candidates")))


def counterfactuals(decisions: DataFrame) -> DataFrame:
    """One row: candidates that would pass if exactly one rule were dropped, before the caps."""
    only = lambda *names: F.count_if((F.size("reasons") == 1) & F.get("reasons", F.lit(0)).isin(*names))
    return decisions.agg(only("floor").alias("without_floor"), only("gap_eligible", "gap_undersupported", "no_runner_up").alias("without_gap"), only("not_mutual").alias("without_mutual"))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: candidates, accepted, rate, and the p50/p90/p99 of score and gap of the accepted."""
    return decisions.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("accepted").alias("accepted"), (F.count_if("accepted") / F.count(F.lit(1))).alias("rate"),
        quantile_triple(F.when(F.col("accepted"), F.col("score"))).alias("score_quantiles"), quantile_triple(F.when(F.col("accepted"), F.col("gap"))).alias("gap_quantiles"),
    )


def leave_one_out(seeds: DataFrame) -> DataFrame:
    """(ref, label, within, other, gap) of seeds of classes with four or more: scored by the other seeds."""
    s = _Seeds(_seed_rows(seeds))
    rows = []
    for i in np.flatnonzero(s.count[s.of] > LEAST_CLASS_SEEDS):
        own = (s.of == s.of[i]) & (np.arange(len(s.of)) != i)
        sim = s.x[i : i + 1] @ s.x.T
        within = float(-np.sort(-sim[0, own])[:BEST_OF].mean())
        others = s.class_scores(sim)[0]
        others[s.of[i]] = -np.inf
        other = float(others.max()) if len(s.labels) > 1 else None
        rows.append((s.refs[i], s.labels[s.of[i]], within, other, None if other is None else within - other))
    return seeds.sparkSession.createDataFrame(rows, T.StructType([seeds.schema["ref"], T.StructField("label", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("within", "other", "gap"))]))


def pseudo_round(decisions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref, label, source): the expert rows and the accepted candidates."""
    return seeds.where(F.col("label").isNotNull()).select("ref", F.col("label").cast("string").alias("label"), F.lit("expert").alias("source")).unionByName(decisions.where("accepted").select("ref", "label", F.lit("pseudo").alias("source")))
