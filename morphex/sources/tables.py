"""Readers. Every schema is explicit, ids are text, and what breaks a rule comes back as rows instead of being guessed at."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_number, sample_of_reference
from ..operators.ranks import with_positions
from ..runtime import is_blank, term

#: Permitted endings of image files.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def header_of(spark: SparkSession, path: str, delim: str = ",") -> list[str]:
    """Column names of a delimited file, byte-order mark taken off; only the first line is read."""
    first = spark.read.text(path).limit(1).first()
    if first is None or not first.value.strip():
        raise ValueError(f"{path} is empty")
    return [c.strip().strip('"') for c in first.value.lstrip("﻿").split(delim)]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, delim: str = ",") -> DataFrame:
    """Delimited text with a header, all columns text unless ``schema`` says otherwise; an empty field is null. gzip, bzip2 and zstd go by suffix."""
    fields = schema or T.StructType([T.StructField(c, T.StringType()) for c in header_of(spark, path, delim)])
    return spark.read.schema(fields).option("header", True).option("enforceSchema", True).option("sep", delim).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)


def read_rectangular(spark: SparkSession, path: str, delim: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, ragged): records with as many fields as the header, and the raw text of the others. Blank lines are skipped."""
    names = header_of(spark, path, delim)
    first = spark.read.text(path).limit(1).first().value
    lines = spark.read.text(path).where(~is_blank("value") & (F.col("value") != first))
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", _raw string"
    parsed = F.from_csv("value", schema, {"sep": delim, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"})
    rows = lines.select("value", parsed.alias("r"))
    good = rows.where(F.col("r._raw").isNull()).select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))
    return good, rows.where(F.col("r._raw").isNotNull()).select(F.col("value").alias("raw"))


def vectors_from_wide(df: DataFrame, prefix: str = "dim_") -> DataFrame:
    """(id[, sample][, label], v) from one column per dimension."""
    found = sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c)))
    if not found:
        raise ValueError(f"no columns {prefix}0, {prefix}1, ...")
    return df.select("id", *(c for c in ("sample", "label") if c in df.columns), F.array(*(F.col(c).try_cast("double") for _, c in found)).alias("v"))


def invalid_embeddings(vectors: DataFrame) -> DataFrame:
    """(id, reason): blank ids, ids that come again, and vectors that aren't numbers throughout."""
    blank = vectors.where(is_blank(F.col("id").cast("string"))).select(F.col("id").cast("string").alias("id"), F.lit("blank_id").alias("reason"))
    again = vectors.groupBy(F.col("id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("id").isNotNull()).select("id", F.lit("repeated_id").alias("reason"))
    bad = vectors.where(F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(F.col("id").cast("string").alias("id"), F.lit("invalid_dimension").alias("reason"))
    return blank.unionByName(again).unionByName(bad)


def label_table(df: DataFrame) -> DataFrame:
    """(id, label): the key is ``id``, else ``image``, else the first column that isn't ``label``; blanks dropped, equal rows once."""
    key = next((c for c in ("id", "image") if c in df.columns), None) or next(c for c in df.columns if c != "label")
    return df.select(F.col(key).cast("string").alias("id"), term("label").alias("label")).where(F.col("label").isNotNull() & ~is_blank("id")).distinct()


def rewritten_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """(id): ids that a numeric reading would change (leading zeros, signs, exponents); as text they are safe."""
    number = as_number(key)
    plain = F.when(number == F.floor(number), F.format_string("%d", number.cast("long"))).otherwise(number.cast("string"))
    return df.where(number.isNotNull() & (F.col(key) != plain)).select(key)


def assignment_table(df: DataFrame) -> DataFrame:
    """(id, cluster[, sample]) whatever the case of the names; exactly one of ``id`` and ``image`` must be there."""
    names = {c.lower(): c for c in df.columns}
    if ("id" in names) == ("image" in names) or "cluster" not in names:
        raise ValueError("assignments need cluster and exactly one of id and image")
    more = [F.col(names["sample"]).cast("string").alias("sample")] if "sample" in names else []
    return df.select(F.col(names.get("id") or names["image"]).cast("string").alias("id"), F.col(names["cluster"]).cast("string").alias("cluster"), *more)


def samples_are_valid(df: DataFrame) -> DataFrame:
    """One row valid: no sample is null or blank (true for an empty table)."""
    return df.agg(F.coalesce(F.bool_and(~is_blank("sample")), F.lit(True)).alias("valid"))


def read_otu_table(spark: SparkSession, path: str, header: bool | None = None, delim: str = ",") -> DataFrame:
    """(sample, cluster, n) of a samples x clusters file. Unless told, a first row with any text beyond its first cell is a header."""
    first = header_of(spark, path, delim)
    header = any(re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", c) is None for c in first[1:]) if header is None else header
    names = first if header else ["sample", *(f"OTU_{i}" for i in range(1, len(first)))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).option("header", header).option("sep", delim).csv(path)
    long = rows.unpivot(["c0"], [f"c{i}" for i in range(1, len(names))], "at", "raw")
    title = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)))
    return long.select(F.col("c0").alias("sample"), title[F.col("at")].alias("cluster"), F.coalesce(as_number("raw"), F.lit(0.0)).cast("long").alias("n"))


def read_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """(cutoff, id, cluster) of all files partition_<cutoff>_assignments.csv in a folder."""
    rows = spark.read.schema("id string, cluster string").option("header", True).csv(f"{folder}/partition_*_assignments.csv")
    return rows.select(F.regexp_extract(F.input_file_name(), r"partition_([0-9.]+)_assignments\.csv", 1).cast("double").alias("cutoff"), "id", "cluster")


def read_distance_matrix(spark: SparkSession, path: str, delim: str = ",") -> DataFrame:
    """(i, j, d), i < j, from a square file with ids in the first column and the header."""
    names = header_of(spark, path, delim)
    rows = read_csv(spark, path, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]), delim)
    title = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)))
    long = rows.unpivot(["c0"], [f"c{i}" for i in range(1, len(names))], "at", "d")
    return long.select(F.col("c0").alias("i"), title[F.col("at")].alias("j"), as_number("d").alias("d")).where(F.col("i") < F.col("j"))


def parameters_of_log(spark: SparkSession, path: str) -> dict:
    """The JSON object after ``Parameters:`` in a run log whose lines may begin with [time stamps]. Lines before it are skipped; logs are small files."""
    import itertools
    import json

    lines = (re.sub(r"^\[[^\]]*\] ?", "", r.value) for r in spark.read.text(path, wholetext=False).toLocalIterator())
    text = "\n".join(itertools.dropwhile(lambda line: "Parameters:" not in line, lines))
    at = text.find("Parameters:")
    if at < 0 or (start := text.find("{", at)) < 0:
        return {}
    return json.JSONDecoder().raw_decode(text[start:])[0]


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(ref, identity, sample, length, content) of all images below a folder; ref is relative to it, identity the whole path, sample its first step."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(x for e in IMAGE_ENDINGS for x in (e[1:], e[1:].upper())) + "}").load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace("path", r"^file:/+", "/")
    ref = F.regexp_replace(path, "^" + re.escape(base) + "/", "")
    return files.select(ref.alias("ref"), path.alias("identity"), sample_of_reference(ref).alias("sample"), "length", "content")


def content_hashes(images: DataFrame) -> DataFrame:
    """(ref, sha256) of the files' contents."""
    return images.select("ref", F.sha2("content", 256).alias("sha256"))


def discover_candidates(entries: DataFrame, experts: DataFrame, root: str, skip: list[str] | None = None) -> DataFrame:
    """(ref, identity, reason) of the files of a scan that no expert file is: candidates have a null reason, rejections theirs.

    ``entries``, ``experts``: (ref, identity); the identity is the resolved path of a file, whatever names lead to it. Entries below a ``skip``
    folder (by ref) are no part of the scan. ``escapes_image_root``: the file lies outside ``root``;
    ``duplicate_file_identity``: another name of a file that a lesser ref already gave. A copy of an expert's content under an
    identity of its own stays a candidate; the decision tells it apart by content. Null identities escape.
    """
    rows = entries.select("ref", "identity").distinct()
    for prefix in skip or []:
        rows = rows.where(~F.col("ref").startswith(prefix.rstrip("/") + "/"))
    base = root.rstrip("/")
    inside = F.coalesce((F.col("identity") == base) | F.startswith("identity", F.lit(base + "/")), F.lit(False))
    known = rows.where(inside).join(experts.select("identity").distinct(), "identity", "left_anti")
    first = known.groupBy("identity").agg(F.min("ref").alias("_first"))
    own = known.join(first, "identity").select("ref", "identity", F.when(F.col("ref") != F.col("_first"), "duplicate_file_identity").alias("reason"))
    return own.unionByName(rows.where(~inside).select("ref", "identity", F.lit("escapes_image_root").alias("reason")))


def run_context(files: DataFrame) -> DataFrame:
    """(path, run, cutoff, reason) of the raw assignment files among ``files`` (path): the run folder and cutoff that the standard layout implies.

    Standard is run/UPGMA/partitions/tables/partition_cutoff_assignments.csv with run/logs/cluster.log beside it; else reason is
    ``name``, ``layout`` or ``no_log`` and run and cutoff are null.
    """
    name = F.element_at(F.split("path", "/"), -1)
    cutoff = F.regexp_extract(name, r"^partition_([0-9]+(?:\.[0-9]+)?)_assignments\.csv$", 1)
    run = F.regexp_extract("path", r"^(.+)/UPGMA/partitions/tables/[^/]+$", 1)
    logs = files.where(F.endswith("path", F.lit("/logs/cluster.log"))).select(F.regexp_replace("path", r"/logs/cluster\.log$", "").alias("_run")).distinct().withColumn("_log", F.lit(True))
    raw = files.where(F.endswith("path", F.lit("_assignments.csv"))).select("path", cutoff.alias("cutoff"), run.alias("run")).distinct()
    met = raw.join(logs, F.col("run") == F.col("_run"), "left")
    reason = F.when(F.col("cutoff") == "", "name").when(F.col("run") == "", "layout").when(F.col("_log").isNull(), "no_log")
    return met.select("path", F.when(reason.isNull(), F.col("run")).alias("run"), F.when(reason.isNull(), F.col("cutoff")).alias("cutoff"), reason.alias("reason"))


def resolve_references(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """(ref, resolved, how): by whole relative path, else by a file name that only one image has; else ``ambiguous`` or ``missing``."""
    refs = wanted.select(F.col("ref")).distinct()
    name = F.element_at(F.split("ref", "/"), -1)
    exact = images.select("ref", F.col("ref").alias("_path"))
    base = images.groupBy(name.alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("ref").alias("_one"))
    met = refs.join(exact, "ref", "left").withColumn("_name", name).join(base, "_name", "left")
    how = F.when(F.col("_path").isNotNull(), "path").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return met.select("ref", F.coalesce("_path", F.when(F.col("_n") == 1, F.col("_one"))).alias("resolved"), how.alias("how"))


def is_batch(images: DataFrame) -> DataFrame:
    """One row batch: some image lies in a folder of its own sample."""
    return images.agg(F.coalesce(F.bool_or(F.col("sample") != ""), F.lit(False)).alias("batch"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-k report."""
    return df.orderBy(*order).limit(n)


def unique_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position) of the distinct keys, by their first place in ``order``."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_at"))
    return with_positions(first, [], ["_at", key]).select(key, "position")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal ``key`` the last by ``order``, all columns; rows without ``order`` count only where a key has no others."""
    best = df.groupBy(key).agg(F.max(F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_order"), F.struct(*(F.col(c).alias(c) for c in df.columns)).alias("_all"))).alias("_row"))  # combines before the shuffle, so a repeated key is no hot one
    return best.select("_row._all.*")
