"""Writers. A folder that holds an input is never overwritten, and files are written by the executors."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sanitised_name


def _path(p: str) -> PurePosixPath:
    return PurePosixPath(p.removeprefix("file://").removeprefix("file:"))


def check_output(out: str, inputs: list[str]) -> None:
    """Refuse an output folder that is, holds, or lies in an input."""
    o = _path(out)
    for i in map(_path, inputs):
        if o == i or o in i.parents or i in o.parents:
            raise ValueError(f"{out} overlaps the input {i}")


def write_table(df: DataFrame, out: str, form: str = "parquet", overwrite: bool = False, partition_by: list[str] | None = None, inputs: list[str] | None = None) -> None:
    """Parquet, CSV (with header) or JSON lines; an existing folder is an error unless ``overwrite``."""
    if form not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {form}")
    check_output(out, inputs or [])
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    # text is written as it is: padding stays
    w = w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) if form == "csv" else w
    (w.partitionBy(*partition_by) if partition_by else w).format(form).save(out)


def wide_vectors(vectors: DataFrame, dims: int, prefix: str = "dim_") -> DataFrame:
    """One column per dimension, the interchange form of a vector table."""
    return vectors.select(*(c for c in vectors.columns if c != "v"), *(F.col("v")[i].alias(f"{prefix}{i}") for i in range(dims)))


def square_matrix(pairs: DataFrame, ids: list) -> DataFrame:
    """Rows x columns of a pair table, zero diagonal; for the bounded cohorts that a pair table has."""
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    own = pairs.sparkSession.createDataFrame([(x, x, 0.0) for x in ids], both.schema)
    return both.unionByName(own).groupBy("i").pivot("j", ids).agg(F.first("d"))


def cutoff_tag(cutoff: float) -> str:
    """Four places without trailing zeros; the file name's form of a cutoff, not a key."""
    return f"{cutoff:.4f}".rstrip("0").rstrip(".")


def write_partitions(assignments: DataFrame, out: str, overwrite: bool = False) -> None:
    """(cutoff, id, cluster) by full-precision cutoff; files of different cutoffs never meet."""
    write_table(assignments, out, "parquet", overwrite, ["cutoff"])


def scan_of(assignments: DataFrame) -> DataFrame:
    """(cutoff, clusters)."""
    return assignments.groupBy("cutoff").agg(F.countDistinct("cluster").alias("clusters"))


def write_by_sample(df: DataFrame, out: str, overwrite: bool = False) -> None:
    """One folder per sanitised sample name; the raw name stays a column, so names that sanitise alike stay apart in it."""
    write_table(df.withColumn("sample_dir", F.coalesce(sanitised_name("sample"), F.lit("all_samples"))), out, "csv", overwrite, ["sample_dir"])


def write_newick(lines: DataFrame, out: str) -> None:
    """One tree per line (column newick); replicate trees."""
    lines.select("newick").write.mode("errorifexists").text(out)


def append_metrics(df: DataFrame, out: str) -> None:
    """Append rows to a metric log; columns may come and go between runs, a column may not change its type."""
    spark = df.sparkSession
    try:
        old = spark.read.option("mergeSchema", True).parquet(out).schema
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        known = {f.name: f.dataType for f in old}
        for f in df.schema:
            if f.name in known and known[f.name] != f.dataType:
                raise ValueError(f"column {f.name} was {known[f.name].simpleString()}, is {f.dataType.simpleString()}")
    df.write.mode("append").parquet(out)


def append_json(df: DataFrame, out: str) -> None:
    df.write.mode("append").json(out)
