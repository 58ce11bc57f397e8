"""Expert corrections laid over assignments, and what they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import term
from .ranks import with_positions
from .skew import join_by_key


def canonical_corrections(rows: DataFrame) -> DataFrame:
    """(id, cluster[, sample, reviewed_at]): ``image`` for id and ``corrected_cluster`` for cluster, without case; padding taken off."""
    names = {c.lower(): c for c in rows.columns}
    key, value = names.get("id") or names.get("image"), names.get("corrected_cluster") or names.get("cluster")
    if not key or not value:
        raise ValueError("corrections need id or image, and cluster or corrected_cluster")
    more = [F.col(names[c]).alias(c) for c in ("sample", "reviewed_at") if c in names]
    return rows.select(F.col(key).alias("id"), term(value).alias("cluster"), *more)


def invalid_corrections(corrections: DataFrame) -> DataFrame:
    """(id, reason): ids that are null or blank, corrections without a cluster, ids with several different clusters."""
    missing = corrections.where(F.col("id").isNull() | (F.trim("id") == "")).select("id", F.lit("missing_id").alias("reason"))
    blank = corrections.where(F.col("id").isNotNull() & F.col("cluster").isNull()).select("id", F.lit("blank_cluster").alias("reason"))
    known = corrections.where(F.col("id").isNotNull() & F.col("cluster").isNotNull())
    conflict = known.groupBy("id").agg(F.countDistinct("cluster").alias("n")).where(F.col("n") > 1).select("id", F.lit("conflict").alias("reason"))
    return missing.unionByName(blank).unionByName(conflict).distinct()


def unknown_corrections(corrections: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id): corrected ids that no assignment has."""
    return corrections.where(F.col("id").isNotNull()).select("id").distinct().join(assignments.select("id"), "id", "left_anti")


def apply_corrections(assignments: DataFrame, corrections: DataFrame, order: str | None = "reviewed_at") -> DataFrame:
    """``assignments`` with ``cluster`` replaced where a correction exists; of several the last by ``order`` counts.

    Corrections without id or cluster change nothing. Every assignment row is kept. The corrections are the small side,
    but nothing is assumed of their number: the join strategy follows measured sizes.
    """
    known = corrections.where(F.col("id").isNotNull() & F.col("cluster").isNotNull())
    last = F.max_by("cluster", F.struct(order, "cluster")) if order else F.max("cluster")
    new = known.groupBy("id").agg(last.alias("_new"))
    return assignments.join(new, "id", "left").withColumn("cluster", F.coalesce("_new", "cluster")).drop("_new").select(*assignments.columns)


def changed_assignments(assignments: DataFrame, corrections: DataFrame, order: str | None = "reviewed_at") -> DataFrame:
    """(id, sample, old_cluster, new_cluster) of the assignment rows that a correction changes."""
    new = apply_corrections(assignments.withColumn("_old", F.col("cluster")), corrections, order)
    return new.where(~F.col("_old").eqNullSafe(F.col("cluster"))).select("id", *(c for c in ("sample",) if c in assignments.columns), F.col("_old").alias("old_cluster"), F.col("cluster").alias("new_cluster"))


def annotation_summary(assignments: DataFrame, corrections: DataFrame, order: str | None = "reviewed_at") -> DataFrame:
    """(cluster, n_before, n_after, n_left, n_entered): the clusters with their rows before and after the corrections."""
    moved = apply_corrections(assignments.withColumn("_old", F.col("cluster")), corrections, order)
    pair = moved.groupBy(F.col("_old").alias("old"), F.col("cluster").alias("new")).agg(F.count(F.lit(1)).alias("n"))
    both = pair.select(F.explode(F.array(F.struct(F.col("old").alias("cluster"), F.lit(0).alias("side")), F.struct(F.col("new").alias("cluster"), F.lit(1).alias("side")))).alias("x"), "n", (~F.col("old").eqNullSafe(F.col("new"))).alias("moved"))
    part = lambda side, moved_only: F.coalesce(F.sum(F.when((F.col("x.side") == side) & (F.col("moved") if moved_only else F.lit(True)), F.col("n"))), F.lit(0))
    return both.where(F.col("x.cluster").isNotNull()).groupBy(F.col("x.cluster").alias("cluster")).agg(part(0, False).alias("n_before"), part(1, False).alias("n_after"), part(0, True).alias("n_left"), part(1, True).alias("n_entered"))


def rename_clusters(assignments: DataFrame, prefix: str = "OTU", member: str = "id") -> DataFrame:
    """``assignments`` + ``name``: prefix_1, prefix_2, ... by falling size, ties by the least member.

    Sizes and least members are one row a cluster; only those are ranked, by range partitions. Rows of clusters that hold very
    many get their name by broadcast, the others by a join. Rows without a cluster have no name.
    """
    sizes = assignments.where(F.col("cluster").isNotNull()).groupBy("cluster").agg((-F.count(F.lit(1))).alias("_n"), F.min(member).alias("_first"))
    ranked = with_positions(sizes.withColumn("_none", F.col("_first").isNull()), [], ["_n", "_none", "_first", "cluster"])
    named = ranked.select("cluster", F.concat(F.lit(f"{prefix}_"), (F.col("position") + 1).cast("string")).alias("name"), (-F.col("_n")).alias("_size"))
    return join_by_key(assignments, named, "cluster", "_size")


#: Members that one row of a summary lists.
ROW_MEMBERS = 1_000


def cluster_summary(assignments: DataFrame, by_sample: bool = False, row_members: int = ROW_MEMBERS) -> DataFrame:
    """(cluster[, sample], n, part, members): row counts, and all distinct members in order, joined with ;.

    A cluster of more than ``row_members`` members goes on in further rows (part 0, 1, ...), so the list is whole
    and no row or task grows with a cluster. Rows without a cluster count nowhere, null members aren't listed; a cluster
    without any member has one row with null members.
    """
    by = ["cluster", *(["sample"] if by_sample else [])]
    known = assignments.where(F.col("cluster").isNotNull())
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = with_positions(known.where(F.col("id").isNotNull()).select(*by, "id").distinct(), by, ["id"])
    part = F.floor(F.col("position") / row_members).cast("int").alias("part")
    listed = placed.groupBy(*by, part).agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("members"))
    listed = listed.select(*(F.col(c).alias(f"_{c}") for c in by), "part", "members")
    match = F.lit(True)
    for c in by:
        match &= counts[c].eqNullSafe(listed[f"_{c}"])
    return counts.join(listed, match, "left").select(*by, "n", F.coalesce("part", F.lit(0)).alias("part"), "members")


def label_conflicts(labels: DataFrame, key: str = "image", label: str = "label") -> DataFrame:
    """(key, n_labels): images with several different labels; blank labels are none."""
    known = labels.select(key, term(label).alias("_t")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    return known.groupBy(key).agg(F.countDistinct("_t").alias("n_labels")).where(F.col("n_labels") > 1)


def labelled_cohort(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the ids with exactly one label: an inner join on the left side's ids."""
    known = labels.select("id", term("label").alias("label")).where(F.col("label").isNotNull())
    single = known.groupBy("id").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n")).where(F.col("n") == 1).select("id", "label")
    return ids.join(single, "id")


def source_counts(labels: DataFrame, source: str = "source") -> DataFrame:
    """(label, n, <source counts>): rows of each label by source, conditional sums in one pass."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(source) == "expert").alias("n_expert"), F.count_if(F.col(source) == "pseudo").alias("n_pseudo"))
