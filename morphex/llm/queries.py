"""Queries of the training-data problems, each with its SQL where SQL can state it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, read_table, term
from .clusters import assign_clusters, describe_clusters, isolated_groups
from .digest import DELTA, certify, digest_percentiles, digests, merge_digests
from .mixing import mix
from .neighbours import measured_recall, nearest_neighbours
from .packing import pack, pack_report
from .residue import judged_messages, residue_documents, without_residue
from .terms import term_frequencies
from .tokens import with_tokens
from .vectors import usable_vectors


def usable(spark: SparkSession, d: str) -> DataFrame:
    return usable_vectors(read_table(spark, d, "specimen_vectors"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other specimens of every usable vector."""
    return nearest_neighbours(usable(spark, d), k=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_neighbours(usable(spark, d), k=5, least_cosine=0.90)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p2_neighbours against exact lists of about 500 hashed queries."""
    rows = materialise(usable(spark, d).select("id", "v"))
    return measured_recall(rows, nearest_neighbours(rows, k=5), k=5)


PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    """(label, day, dim_0): one row for every usable vector and every label its image has."""
    vectors = usable(spark, d).select("id", F.to_date("at").alias("day"), F.col("v")[0].alias("dim_0"))
    labels = read_table(spark, d, "figs").select(F.col("image").alias("id"), term("label").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).distinct()
    return vectors.join(labels, "id").select("label", "day", "dim_0")


def _certified(rows: DataFrame, key: str) -> DataFrame:
    rows = materialise(rows)
    found = digest_percentiles(digests(rows, [key], "dim_0"), [key], PERCENTILES)
    return certify(rows, [key], "dim_0", found)


def p3_label_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _certified(labelled_values(spark, d), "label")


def p3_label_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the certified rank error of every label's percentile keeps the digest's bound."""
    found = p3_label_percentiles(spark, d)
    bound = F.lit(math.pi / DELTA) * F.sqrt(F.col("prob") * (1 - F.col("prob"))) + 1 / F.col("n")
    return found.select("label", "n", "prob", (F.col("rank_error") <= bound).alias("within_bound"))


def p3_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _certified(labelled_values(spark, d), "day")


def p3_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each label from its daily digests, as if each day had been digested on its own."""
    rows = materialise(labelled_values(spark, d))
    daily = digests(rows, ["label", "day"], "dim_0")
    return certify(rows, ["label"], "dim_0", digest_percentiles(merge_digests(daily.drop("day"), ["label"]), ["label"], PERCENTILES))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return isolated_groups(usable(spark, d))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every similarity cluster with its size and its most typical members."""
    return describe_clusters(assign_clusters(usable(spark, d)))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """The assigned cluster values found in every similarity cluster, with the number of specimens."""
    assigned = assign_clusters(usable(spark, d))
    values = read_table(spark, d, "assignments").select("id", term("cluster").alias("value")).where(F.col("id").isNotNull() & F.col("value").isNotNull()).distinct()
    return assigned.join(values, "id").groupBy("cluster", "value").agg(F.count(F.lit(1)).alias("n_specimens"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies([(read_table(spark, d, "figs"), "label", "image", "sample", "label"), (read_table(spark, d, "assignments"), "cluster", "id", "sample", "cluster")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    return with_tokens(read_table(spark, d, "documents").select("doc_id", "source", "text"))


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    limits = read_table(spark, d, "pack_limits").select("pack_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(limits) > 1000:
        raise ValueError("more than 1000 pack limits")
    counts = materialise(token_counts(spark, d))
    return [(r.pack_name, r.capacity_tokens, pack(counts, r.capacity_tokens)) for r in sorted(limits)]


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each capacity."""
    return reduce(DataFrame.unionByName, (p.select(F.lit(name).alias("pack_name"), "*") for name, _, p in _packed(spark, d)))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (pack_report(p, capacity).select(F.lit(name).alias("pack_name"), "*") for name, capacity, p in _packed(spark, d)))


def p8_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix, in the order they are to be read."""
    return mix(materialise(token_counts(spark, d)), read_table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(materialise(token_counts(spark, d)), read_table(spark, d, "mix_targets"))[1]


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """The shares where each mix is to be as large as all its sources together: small sources fall short, the report says by how much."""
    return mix(materialise(token_counts(spark, d)), read_table(spark, d, "mix_targets"), total="available")[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(read_table(spark, d, "documents")).select("doc_id")


def p9_messages(spark: SparkSession, d: str) -> DataFrame:
    return judged_messages(read_table(spark, d, "documents"))[0]


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(read_table(spark, d, "documents")).select("doc_id", "source", "n_chars")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_recall": p2_recall, "p3_label_percentiles": p3_label_percentiles, "p3_label_bounds": p3_label_bounds, "p3_day_percentiles": p3_day_percentiles, "p3_merged_days": p3_merged_days, "p4_found": p4_found, "p4_clusters": p4_clusters, "p4_values": p4_values, "p6_found": p6_found, "p6_terms": p6_terms, "p7_packed": p7_packed, "p7_report": p7_report, "p8_chosen": p8_chosen, "p8_shares": p8_shares, "p8_whole": p8_whole, "p9_found": p9_found, "p9_messages": p9_messages, "p9_clean": p9_clean}

_FREQUENCIES = r"""
WITH rows_ AS (
  SELECT 'label' AS field_name, label AS value, image, sample FROM figs UNION ALL SELECT 'cluster', cluster, id, sample FROM assignments
), terms AS (
  SELECT field_name, regexp_replace(value, '^[ \t]+|[ \t]+$', '', 'g') AS term, image, CASE WHEN regexp_matches(sample, '\S') THEN sample END AS sample
  FROM rows_ WHERE regexp_matches(value, '\S')
), totals AS (
  SELECT field_name, count(DISTINCT sample) AS all_samples FROM rows_ WHERE regexp_matches(sample, '\S') GROUP BY 1
), counted AS (
  SELECT field_name, term, count(*) AS n_rows, count(DISTINCT image) AS n_images, count(DISTINCT sample) AS n_samples FROM terms GROUP BY ALL
), marked AS (
  SELECT c.*, CASE WHEN n_images < 3 THEN 'rare' WHEN n_samples > all_samples * 0.5 THEN 'common' END AS mark FROM counted c LEFT JOIN totals USING (field_name)
)
"""

_USABLE = """
WITH latest AS (SELECT id, arg_max(v, (coalesce(epoch_us(seen), -9223372036854775807), v)) AS v FROM (SELECT id, extracted_at AS seen, [{dims}] AS v FROM specimen_vectors WHERE regexp_matches(id, '\\S')) GROUP BY id),
usable AS (SELECT id, v, list_transform(v::DOUBLE[], lambda y: y / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS u FROM latest
  WHERE len(list_filter(v, lambda y: y IS NOT NULL AND isfinite(y))) = {n} AND len(list_filter(v, lambda y: y <> 0)) > 0),
pairs AS (SELECT a.id AS id, b.id AS neighbour, list_dot_product(a.u, b.u) AS c FROM usable a JOIN usable b ON a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS r FROM pairs)
""".format(dims=", ".join(f"dim_{i}" for i in range(64)), n=64)
_LABELLED = _USABLE + r""", labels AS (SELECT DISTINCT image AS id, regexp_replace(label, '^[ \t]+|[ \t]+$', '', 'g') AS label FROM figs WHERE image IS NOT NULL AND regexp_matches(label, '\S'))
"""

SQL = {
    "p2_found": _USABLE + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM ranked WHERE r <= 5 AND c >= 0.9",
    "p4_found": _USABLE + """, near AS (SELECT id, list(neighbour) AS others FROM pairs WHERE c >= 0.9 GROUP BY 1), sets AS (SELECT id, list_sort(list_append(others, id)) AS members FROM near)
SELECT members[1] AS group_id, id FROM (SELECT *, count(*) OVER (PARTITION BY members) AS alike FROM sets) WHERE len(members) >= 3 AND alike = len(members)""",
    "p3_label_bounds": _LABELLED + "SELECT label, count(*) AS n, prob, true AS within_bound FROM usable JOIN labels USING (id), (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) p(prob) GROUP BY label, prob",
    "p6_terms": _FREQUENCIES + "SELECT field_name, term, n_rows, n_images, n_samples, mark FROM marked",
    "p6_found": _FREQUENCIES + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
}
