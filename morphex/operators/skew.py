"""Exact per-key quantiles when a few keys hold most rows.

No key's values are ever brought together unless they are few. Keys are split by their counts: a key with
more than ``max(MIN_HOT, rows / MAX_HOT)`` rows is hot, so there are at most MAX_HOT hot keys at any input
size and their state may be broadcast and planned on the driver. For hot keys the value range is cut into
equal bins, rows are counted by bin (counts combine before the shuffle), the bin that holds the wanted rank
becomes the new range, and this is repeated until one value is left or the range holds few enough rows to
be read. All other keys are small by definition and take one grouped pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise

#: Keys with fewer rows are never hot; no more than MAX_HOT keys can be.
MIN_HOT = 20_000
MAX_HOT = 1_000
#: Bins of one refinement, and the rows a range may hold to be read instead of refined further.
BINS = 128
FEW = 256


def key_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` + (n_rows, n_values, lo, hi): rows, rows with a value, least and greatest value. Combines map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def hot_threshold(rows: int) -> int:
    return max(MIN_HOT, math.ceil(rows / MAX_HOT))


@dataclass
class _Range:
    """Rank ``rank`` (from 1, within the range) of key ``key`` lies in [lo, hi]; the range holds ``n`` rows."""

    key: tuple
    prob: int
    rank: int
    lo: int
    hi: int
    n: int

    @property
    def width(self) -> int:
        """Of a bin; a range of few rows is counted value by value."""
        return 1 if self.n <= FEW else (self.hi - self.lo) // BINS + 1


def _wanted_rank(prob: float, n: int) -> int:
    """The least rank r with r / n >= prob, 1 at least; the same value as discrete SQL percentiles."""
    return min(n, max(1, math.ceil(prob * n - 1e-9)))


def _ranges_frame(df: DataFrame, keys: list[str], open_: list[_Range]) -> DataFrame:
    """(keys, _ranges) with all open ranges of a key in one array; bounded by MAX_HOT keys, so broadcast."""
    by: dict[tuple, list] = {}
    for r in open_:
        by.setdefault(r.key, []).append((r.prob, r.lo, r.hi, r.width))
    item = T.StructType([T.StructField("prob", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("width", T.LongType())])
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("_ranges", T.ArrayType(item))])
    return F.broadcast(df.sparkSession.createDataFrame([(*k, v) for k, v in by.items()], schema))


def _resolve_hot(df: DataFrame, keys: list[str], value: str, hot: list, probs: list[float]) -> dict[tuple, dict[int, int]]:
    """Exact values of hot keys by refining histograms; the driver sees counts of bins, never rows of a key."""
    done: dict[tuple, dict[int, int]] = {}
    open_ = [_Range(tuple(r[k] for k in keys), i, _wanted_rank(p, r.n_values), r.lo, r.hi, r.n_values) for r in hot for i, p in enumerate(probs)]
    while open_:
        for r in (x for x in open_ if x.lo == x.hi):
            done.setdefault(r.key, {})[r.prob] = r.lo
        open_ = [r for r in open_ if r.lo < r.hi]
        if not open_:
            break
        hit = (
            df.where(F.col(value).isNotNull())
            .join(_ranges_frame(df, keys, open_), keys)
            .select(*keys, F.col(value).alias("_v"), F.explode(F.filter("_ranges", lambda x: F.col(value).between(x["lo"], x["hi"]))).alias("_r"))
        )
        bins = hit.groupBy(*keys, F.col("_r.prob").alias("_p"), F.expr("_v div _r.width").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counted: dict[tuple, list] = {}
        for x in bins.collect():  # at most MAX_HOT * len(probs) * (BINS + 2) rows
            counted.setdefault((tuple(x[k] for k in keys), x["_p"]), []).append((x["_lo"], x["_hi"], x["_n"]))
        narrowed = []
        for r in open_:
            before = 0
            for lo, hi, n in sorted(counted[r.key, r.prob]):
                if before + n >= r.rank:
                    narrowed.append(_Range(r.key, r.prob, r.rank - before, lo, hi, n))
                    break
                before += n
        open_ = narrowed
    return done


def key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], share_of: list[str] | None = None) -> DataFrame:
    """Exact quantiles of the integer column ``value`` for every combination of ``keys``.

    One row per key: ``keys``, n_rows (rows as delivered), n_values (rows whose value is not null), share (of the
    rows with equal ``share_of`` columns, of all rows by default), and ``quantiles``: for each probability the value
    at the least rank r with r / n_values >= probability, null for a key without values. Rows with a null in any
    key form no key and don't count. Ties and repeated rows count each time. An empty table gives no rows.
    Columns other than ``keys`` and ``value`` are not read; integer types only (cast timestamps to microseconds).
    """
    data = df.select(*keys, F.col(value).cast("long").alias(value)).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    counts = materialise(key_counts(data, keys, value))
    rows = counts.agg(F.sum("n_rows")).first()[0] or 0
    limit = hot_threshold(rows)
    spark = df.sparkSession
    hot = counts.where(F.col("n_values") > limit).collect()  # at most MAX_HOT rows
    resolved = _resolve_hot(data, keys, value, hot, probs) if hot else {}
    schema = T.StructType([*(T.StructField(k, data.schema[k].dataType) for k in keys), T.StructField("quantiles", T.ArrayType(T.LongType()))])
    hot_q = spark.createDataFrame([(*k, [v[i] for i in range(len(probs))]) for k, v in resolved.items()], schema)
    cold = data.where(F.col(value).isNotNull())
    if hot:
        cold = cold.join(F.broadcast(hot_q.select(*keys)), keys, "left_anti")
    # row_number streams over an external sort, so even the largest cold key needs no memory of its own
    ranks = counts.where(F.col("n_values").between(1, limit)).select(*keys, *(F.greatest(F.lit(1), F.ceil(F.col("n_values") * p - 1e-9)).cast("long").alias(f"_r{i}") for i, p in enumerate(probs)))
    ranked = cold.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).join(ranks, keys)
    at = [F.max(F.when(F.col("_rank") == F.col(f"_r{i}"), F.col(value))) for i in range(len(probs))]
    cold_q = ranked.groupBy(*keys).agg(F.array(*at).alias("quantiles"))
    total = (counts.groupBy(*share_of) if share_of else counts).agg(F.sum("n_rows").alias("_total"))
    joined = counts.join(hot_q.unionByName(cold_q), keys, "left")
    joined = joined.join(total, share_of) if share_of else joined.crossJoin(F.broadcast(total))
    return joined.select(*keys, "n_rows", "n_values", (F.col("n_rows") / F.col("_total")).alias("share"), "quantiles")


def join_by_key(rows: DataFrame, side: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row for each ``key`` and in ``size`` how many rows have it.

    Rows of the hot keys (at most MAX_HOT) meet theirs by broadcast and stay where they are; the others go by key, and no key
    among them has more rows than ``hot_threshold``. ``size`` isn't kept; a null key meets nothing, its rows are kept.
    """
    side = materialise(side)
    limit = hot_threshold(side.agg(F.sum(size)).first()[0] or 0)
    hot, cold = side.where(F.col(size) > limit).drop(size), side.where(F.col(size) <= limit).drop(size)
    if hot.isEmpty():
        return rows.join(cold, key, "left")
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far)


def dominant(profile: DataFrame, least_share: float) -> DataFrame:
    """Keys of ``key_quantiles`` that hold at least ``least_share`` of the rows."""
    return profile.where(F.col("share") >= least_share)
