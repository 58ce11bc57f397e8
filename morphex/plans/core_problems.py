"""Queries of the general data problems: p1 (rows that fail to parse) and p5 (keys that hold most rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import classify_records, failed_records, read_layouts, valid_records
from ..operators.skew import dominant, key_quantiles
from ..runtime import read_table, term

#: A term is dominant from this share of the rows that have a term.
DOMINANT_SHARE = 0.04
ARRIVAL_PROBS = (0.1, 0.5, 0.9)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return classify_records(read_table(spark, d, "figs_raw"), read_layouts(read_table(spark, d, "sheet_layouts")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_records(_classified(spark, d)).select("rec_id")


def p1_failed(spark: SparkSession, d: str) -> DataFrame:
    return failed_records(_classified(spark, d))


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_records(_classified(spark, d))


def term_rows(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, term, arrived) of both term columns; arrived in microseconds."""
    figs = read_table(spark, d, "figs").select(F.lit("label").alias("field_name"), term("label").alias("term"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("arrived"))
    assigned = read_table(spark, d, "assignments").select(F.lit("cluster").alias("field_name"), term("cluster").alias("term"), F.unix_micros(F.col("assigned_at").cast("timestamp")).alias("arrived"))
    return figs.unionByName(assigned)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per label and per cluster: rows, share, and when a tenth, half and nine tenths of its rows had arrived."""
    profile = key_quantiles(term_rows(spark, d), ["field_name", "term"], "arrived", list(ARRIVAL_PROBS), share_of=["field_name"])
    return profile.select("field_name", "term", "n_rows", (F.col("share") >= DOMINANT_SHARE).alias("dominant"), *(F.col("quantiles")[i].alias(f"arrived_p{round(p * 100)}") for i, p in enumerate(ARRIVAL_PROBS)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    profile = key_quantiles(term_rows(spark, d), ["field_name", "term"], "arrived", list(ARRIVAL_PROBS), share_of=["field_name"])
    return dominant(profile, DOMINANT_SHARE).select("field_name", "term")


QUERIES = {"p1_found": p1_found, "p1_failed": p1_failed, "p1_valid": p1_valid, "p5_found": p5_found, "p5_profile": p5_profile}

_TERMS = r"""
WITH rows_ AS (
  SELECT 'label' AS field_name, regexp_replace(label, '^[ \t]+|[ \t]+$', '', 'g') AS term, epoch_us(received_at) AS arrived
  FROM figs WHERE regexp_matches(label, '\S')
  UNION ALL
  SELECT 'cluster', regexp_replace(cluster, '^[ \t]+|[ \t]+$', '', 'g'), epoch_us(assigned_at)
  FROM assignments WHERE regexp_matches(cluster, '\S')
), counted AS (
  SELECT field_name, term, count(*) AS n_rows, quantile_disc(arrived, 0.1) AS arrived_p10, quantile_disc(arrived, 0.5) AS arrived_p50, quantile_disc(arrived, 0.9) AS arrived_p90
  FROM rows_ GROUP BY ALL
), shared AS (
  SELECT *, n_rows / sum(n_rows) OVER (PARTITION BY field_name) >= 0.04 AS dominant FROM counted
)
"""

# The strict grammar of a record as one pattern per delimiter, and the checks of its values.
_RECORDS = r"""
WITH lines AS (
  SELECT r.rec_id, r.layout, r.raw, regexp_replace(r.raw, '\r$', '') AS line, l.n_fields,
         CASE l.delim WHEN '	' THEN '\t' ELSE l.delim END AS dl,
         list_position(string_split(l.header_line, l.delim), 'image') AS at_image,
         list_position(string_split(l.header_line, l.delim), 'label') AS at_label
  FROM figs_raw r LEFT JOIN sheet_layouts l ON r.layout = l.layout
  WHERE regexp_matches(r.raw, '\S')
), split_ AS (
  SELECT *, CASE
      WHEN dl = ',' THEN regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's')
      WHEN dl = ';' THEN regexp_full_match(line, '("([^"]|"")*"|[^";]*)(;("([^"]|"")*"|[^";]*))*', 's')
      ELSE regexp_full_match(line, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*', 's') END AS quoted_well,
    CASE
      WHEN dl = ',' THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)
      WHEN dl = ';' THEN regexp_extract_all(';' || line, ';("(?:[^"]|"")*"|[^";]*)', 1)
      ELSE regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) END AS fields
  FROM lines
), vals AS (
  SELECT *, regexp_replace(CASE WHEN fields[at_image] LIKE '"%' THEN replace(fields[at_image][2:-2], '""', '"') ELSE fields[at_image] END, '^\s+|\s+$', '', 'g') AS image_,
            regexp_replace(CASE WHEN fields[at_label] LIKE '"%' THEN replace(fields[at_label][2:-2], '""', '"') ELSE fields[at_label] END, '^\s+|\s+$', '', 'g') AS label_
  FROM split_
), judged AS (
  SELECT rec_id, layout, raw, image_, label_, CASE
    WHEN n_fields IS NULL THEN 'unknown_layout'
    WHEN NOT quoted_well THEN 'bad_quoting'
    WHEN len(fields) <> n_fields THEN 'field_count'
    WHEN regexp_matches(image_, '[\x00-\x1f\x7f]') OR contains(image_, chr(65533)) OR regexp_matches(image_, '^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)')
      OR NOT regexp_matches(image_, '(?i)\.(jpg|jpeg|png|bmp|webp|tif|tiff)$') THEN 'bad_image'
    WHEN label_ <> '' AND (NOT regexp_matches(label_, '^\pL') OR regexp_matches(label_, '[\x00-\x1f\x7f]') OR contains(label_, chr(65533))) THEN 'bad_label'
  END AS reason FROM vals
)
"""

SQL = {
    "p1_found": _RECORDS + "SELECT rec_id FROM judged WHERE reason IS NOT NULL",
    "p1_failed": _RECORDS + "SELECT rec_id, layout, reason, raw FROM judged WHERE reason IS NOT NULL",
    "p1_valid": _RECORDS + "SELECT rec_id, image_ AS image, nullif(label_, '') AS label FROM judged WHERE reason IS NULL",
    "p5_found": _TERMS + "SELECT field_name, term FROM shared WHERE dominant",
    "p5_profile": _TERMS + "SELECT field_name, term, n_rows, dominant, arrived_p10, arrived_p50, arrived_p90 FROM shared",
}
