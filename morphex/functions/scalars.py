"""Column expressions of the data model: names, predicates, hashes, vector arithmetic. All of them stay in the JVM."""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import bind, is_blank

#: A norm below this doesn't scale a vector.
LEAST_NORM = 1e-12
NEAR_DUPLICATE = 0.999


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit_vector(v: Column | str, keep_short: bool = False) -> Column:
    """v / max(|v|, LEAST_NORM): a zero vector stays zero. ``keep_short`` leaves a vector under LEAST_NORM unscaled."""
    x = doubles(v)
    size = F.transform(F.array(norm(x)), lambda n: F.when(n < LEAST_NORM, F.lit(1.0)).otherwise(n) if keep_short else F.greatest(n, F.lit(LEAST_NORM)))
    return F.transform(size, lambda n: F.transform(x, lambda e: e / n))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors, clipped to [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b)))


def invalid_vector(v: Column | str) -> Column:
    """Null, empty, not finite anywhere, or of norm zero."""
    x = doubles(v)
    return x.isNull() | (F.size(x) < 1) | F.coalesce(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True)) | (norm(x) == 0)


def sanitised_name(name: Column | str) -> Column:
    """Trimmed, each run of white space and each slash an underscore."""
    c = F.col(name) if isinstance(name, str) else name
    return F.translate(F.regexp_replace(F.trim(c), r"\s+", "_"), "/\\", "__")


def with_unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """k-th repeat of a name (in ``order``) gets the suffix _k, counted from 2."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_k", k).withColumn(out, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_k").cast("string")))).drop("_k")


def as_number(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(c).try_cast("double")


def is_number(text: Column | str) -> Column:
    return as_number(text).isNotNull()


def boolean_literal(text: Column | str) -> Column:
    """true/1/yes/y and false/0/no/n in any case; anything else is null."""
    c = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.when(c.isin("true", "1", "yes", "y"), True).when(c.isin("false", "0", "no", "n"), False)


def cutoff_list(spark: SparkSession, low: float, high: float, step: float, custom: list[float] | None = None) -> DataFrame:
    """(cutoff): ``custom`` sorted and distinct, or low, low + step, ... up to high, rounded to six places."""
    if custom is not None:
        if not custom or not all(math.isfinite(x) for x in custom):
            raise ValueError("cutoffs must be finite numbers")
        return spark.createDataFrame([(float(x),) for x in sorted(set(custom))], "cutoff double")
    if step <= 0:
        raise ValueError("the step must be positive")
    return spark.range(int(math.floor((high + 1e-9 - low) / step)) + 1).select(F.round(F.lit(low) + F.col("id") * F.lit(step), 6).alias("cutoff"))


def neighbour_count(n: Column, strategy: str = "adaptive") -> Column:
    """k of local scaling: 7, the root, five times the binary logarithm, or by size; n - 1 at most."""
    root, logarithm = F.floor(F.sqrt(n)), F.greatest(F.lit(5), F.floor(5 * F.log2(n)))
    by_size = F.when(n < 100, F.lit(7)).when(n < 500, root).otherwise(logarithm)
    k = {"fixed": F.lit(7), "sqrt": root, "log": logarithm, "adaptive": F.greatest(F.lit(5), F.least(F.lit(100), by_size))}[strategy]
    return F.least(k.cast("long"), n.cast("long") - 1)


def seed_bin(n: Column) -> Column:
    return F.when(n.isNull() | (n < 1), "none").when(n <= 3, "3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise(">10")


#: The bins of ``seed_bin`` in order.
SEED_BINS = ("none", "3", "4-5", "6-10", ">10")


def sample_of_reference(ref: Column | str) -> Column:
    """First step of a path of at least two steps, else empty."""
    steps = F.split(F.col(ref) if isinstance(ref, str) else ref, "/")
    return F.when(F.size(steps) >= 2, steps[0]).otherwise("")


def manifest_hash(rows: DataFrame, ref: str, label: str) -> DataFrame:
    """(n, sha256) of the compact JSON of the sorted [ref, label] rows, repeated rows kept.

    Rows are hashed where they lie and only 64-character digests are gathered by range, so the manifest of any size is
    hashed as a tree: the digest of the sorted digests of hash-partitioned thousands of rows.
    """
    row = rows.select(F.sha2(F.to_json(F.array(ref, label)), 256).alias("row"))
    leaf = row.groupBy(F.substring("row", 1, 3).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("row"))), 256).alias("leaf"))
    return leaf.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda x: x["leaf"])), 256).alias("sha256"))


def small_manifest_hash(rows: DataFrame, ref: str, label: str, bound: int = 1_000_000) -> DataFrame:
    """(n, sha256) of the compact JSON of all sorted [ref, label] rows, the interchange form; refused beyond ``bound`` rows."""
    pairs = rows.select(ref, label)
    if pairs.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} rows; use manifest_hash")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.array(ref, label)))), 256).alias("sha256"))


def pool_hash(rows: DataFrame, ref: str, bound: int = 1_000_000) -> DataFrame:
    """sha256 of the distinct sorted references, one a line; refused beyond ``bound`` references."""
    distinct = rows.select(ref).where(F.col(ref).isNotNull()).distinct()
    if distinct.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} references")
    return distinct.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(ref)), "\n"), 256).alias("sha256"))


def feature_hash(ref: Column, v: Column, domain: str = "features/1") -> Column:
    """sha256 over a domain tag, the reference, the length and the little-endian float32 bytes of the vector."""

    @F.pandas_udf("string")
    def run(refs: pd.Series, vectors: pd.Series) -> pd.Series:
        def one(r, x):
            if r is None or x is None:
                return None
            x = np.asarray(x, "<f4")
            return hashlib.sha256(b"\0".join([domain.encode(), r.encode(), str(len(x)).encode(), x.tobytes()])).hexdigest()

        return pd.Series([one(r, x) for r, x in zip(refs, vectors)])

    return run(ref, v)


def min_max_scaled(v: Column) -> Column:
    """(v - min) / max of what remains; all zero for a flat vector."""
    low = F.array_min(v)
    span = F.array_max(v) - low
    return F.transform(F.array(F.struct(low.alias("low"), span.alias("span"))), lambda s: F.transform(v, lambda e: F.when(s["span"] > 0, (e - s["low"]) / s["span"]).otherwise(0.0)))[0]


def quantile_triple(value: Column) -> Column:
    """Exact p50, p90 and p99 as an array; null without values."""
    return F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))


def canonical_reference(ref: Column, root: str = "") -> Column:
    """Lexically normal POSIX reference relative to ``root``; null if it leaves the root, is blank or names a drive."""
    text = F.replace(ref, F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")
    absolute = F.startswith(text, F.lit("/"))

    def step(done: Column, s: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when((s == "") | (s == "."), done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    steps = F.aggregate(F.split(text, "/"), none, step)
    base = [x for x in os.path.normpath(root).split("/") if x] if root else []
    below = F.array(*(F.lit(x) for x in base)) if base else none

    def finish(x: Column) -> Column:
        inside = F.slice(x, 1, len(base)) == below if base else F.lit(False)
        rest = F.when(absolute, F.when(inside, F.slice(x, len(base) + 1, F.greatest(F.size(x), F.lit(1))))).otherwise(x)
        path = F.when(F.size(rest) == 0, F.lit(".")).otherwise(F.array_join(rest, "/"))
        return F.when(F.coalesce(F.get(rest, F.lit(0)), F.lit("")) != "..", F.when(~F.rlike(path, F.lit("^[A-Za-z]:")), path))

    return F.when(~is_blank(ref), bind(steps, finish))


def edge_median(pixels: Column, fallback: tuple[int, int, int] = (124, 116, 104)) -> Column:
    """Median colour of the four borders of an image (array of rows of [r, g, b]); ``fallback`` for an empty one."""

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        def one(rows):
            if rows is None or len(rows) == 0 or len(rows[0]) == 0:
                return [float(x) for x in fallback]
            a = np.array([[list(p) for p in r] for r in rows], float)
            border = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
            return np.median(border, axis=0).tolist()

        return images.map(one, na_action=None)

    return run(pixels)


def top_tokens(tokens: Column, k: int, prefix: int = 0) -> Column:
    """The ``k`` token vectors of greatest norm after ``prefix`` special ones, end to end, greatest first; ties to the earlier token."""
    rest = F.slice(tokens, prefix + 1, F.greatest(F.size(tokens) - prefix, F.lit(0)))
    ranked = F.array_sort(F.transform(rest, lambda t, i: F.struct((-norm(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.flatten(F.transform(F.slice(ranked, 1, k), lambda x: x["t"]))


def luma(r: Column, g: Column, b: Column, factor: float = 1.0) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) * factor


def near_duplicate(similarity: Column, a_sha: Column, b_sha: Column) -> Column:
    """Nearly equal features and equal content."""
    return (similarity > NEAR_DUPLICATE) & (a_sha == b_sha)


def register(spark: SparkSession) -> None:
    """The scalar functions that SQL users need, under the prefix ``mx_``."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mx_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mx_seed_bin(n BIGINT) RETURNS STRING RETURN CASE WHEN n IS NULL OR n < 1 THEN 'none' WHEN n <= 3 THEN '3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mx_sample_of(ref STRING) RETURNS STRING RETURN CASE WHEN size(split(ref, '/')) >= 2 THEN split(ref, '/')[0] ELSE '' END")


VECTOR = T.ArrayType(T.DoubleType())
