"""Mergeable percentile digests per group, with a certified rank error.

A digest is a list of (mean, weight) centroids of sorted values. Sorted values are cut where the arcsine size
function k(q) = DELTA / 2pi * asin(2q - 1) passes an integer, so centroids are small at both ends and no centroid spans
more than a unit of k. Digests of portions or days merge by sorting their centroids together and cutting again. A
second pass counts the rows below and at every estimate and so certifies its true rank error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import hot_threshold
from ..runtime import materialise

#: Size parameter: a digest has at most DELTA / 2 + 2 centroids; ranks are off by about pi / DELTA * sqrt(q (1 - q)) at most.
DELTA = 400
#: Values buffered by a task before they are cut into digests.
BUFFER_ROWS = 400_000
#: Partial digests of one key are merged in this many parts first.
PARTS = 32


def cut(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, ...]:
    """Re-cluster centroids of many groups at once; ``group`` are small integers. Gives sorted (group, mean, weight, low, high)."""
    order = np.lexsort((mean, group))
    group, mean, weight, low, high = group[order], mean[order], weight[order], low[order], high[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    lengths = np.diff(np.append(starts, len(group)))
    total = np.repeat(np.add.reduceat(weight, starts), lengths) if len(group) else weight
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[starts], lengths)
    k = lambda q: delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))
    place = np.floor(k((before + weight / 2) / total)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (place[1:] != place[:-1])])) if len(group) else starts
    if not len(first):
        return group, mean, weight, low, high
    w = np.add.reduceat(weight, first)
    return group[first], np.add.reduceat(mean * weight, first) / w, w, np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def estimate(mean: np.ndarray, weight: np.ndarray, low: float, high: float, probs: np.ndarray) -> np.ndarray:
    """Values at ``probs``: linear between the middles of the centroids, exact least and greatest value at the ends."""
    middle = np.cumsum(weight) - weight / 2
    return np.interp(probs * weight.sum(), np.concatenate([[0], middle, [weight.sum()]]), np.concatenate([[low], mean, [high]]))


def _schema(df: DataFrame, keys: list[str], part: bool) -> T.StructType:
    numbers = [T.StructField(c, T.DoubleType()) for c in ("mean", "weight", "low", "high")]
    return T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), *([T.StructField("part", T.IntegerType())] if part else []), *numbers])


def _coded(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every row's combined key, a row that has each code)."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        index = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (index.max(initial=0) + 1) + index, return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _reduce(keys: list[str], raw: bool, delta: float):
    """Batches of values (raw) or centroids to digests, buffering a bounded number of rows."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        code, example = _coded([table.column(k) for k in keys])
        if raw:
            mean = low = high = table.column("value").to_numpy().astype(np.float64)
            weight = np.ones(len(mean))
        else:
            mean, weight, low, high = (table.column(c).to_numpy() for c in ("mean", "weight", "low", "high"))
        group, mean, weight, low, high = cut(code, mean, weight, low, high, delta)
        first = pa.array(example[group])
        out = pa.table([*(table.column(k).take(first) for k in keys), mean, weight, low, high], names=[*keys, "mean", "weight", "low", "high"])
        yield from out.to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return run


def digests(df: DataFrame, keys: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """(keys, mean, weight, low, high): the centroids of every key's digest, one row each.

    Null, NaN and infinite values are left out; a null key is a key of its own. low and high are the least and greatest value
    of a centroid. Rows of one key are reduced where they are stored, so a key that holds most rows sends no more than
    a key that holds few. Empty tables give no rows, and so does a key without values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    partial = rows.withColumn("part", F.spark_partition_id() % PARTS).mapInArrow(_reduce([*keys, "part"], True, delta), _schema(df, keys, True))
    return merge_digests(partial, keys, delta)


def merge_digests(centroids: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """One digest per key from the centroids of any number of digests (of portions, days, other tables).

    Centroids of small keys are cut many keys at a time; ``part``, where given, spreads those of one key over tasks first.
    """
    part = [c for c in centroids.columns if c == "part"]
    if part:
        by = [*keys, "part"]
        centroids = centroids.repartition(*by).mapInArrow(_reduce(by, False, delta), _schema(centroids, keys, True)).drop("part")
    # whole keys per partition, sorted, so that one pass over a partition cuts each key once
    placed = centroids.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(_whole_keys(keys, delta), _schema(centroids, keys, False))


def _whole_keys(keys: list[str], delta: float):
    """Like _reduce over rows sorted by key, but a key never lies in two flushes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduce = _reduce(keys, False, delta)
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = {k: table.column(k)[-1].as_py() for k in keys}
            at = np.ones(table.num_rows, bool)
            for k, v in last.items():
                c = table.column(k)
                at &= (pc.is_null(c) if v is None else pc.fill_null(pc.equal(c, pa.scalar(v, c.type)), False)).to_numpy()
            whole, rest = table.filter(pa.array(~at)), table.filter(pa.array(at))
            if whole.num_rows:
                yield from reduce(iter(whole.combine_chunks().to_batches()))
            else:  # one key fills the buffer: cut what there is, and go on with the result
                rest = pa.Table.from_batches(list(reduce(iter(rest.combine_chunks().to_batches())))).select(rest.column_names)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if held:
            yield from reduce(iter(held))

    return run


def digest_percentiles(centroids: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, n, prob, estimate) from digests with whole keys per partition (as ``digests`` and ``merge_digests`` leave them)."""
    wanted = np.array(probs)

    def run(table: pa.Table) -> pa.Table:
        mean, weight = table.column("mean").to_numpy(), table.column("weight").to_numpy()
        order = np.argsort(mean, kind="stable")
        e = estimate(mean[order], weight[order], table.column("low").to_numpy().min(), table.column("high").to_numpy().max(), wanted)
        first = pa.array(np.zeros(len(wanted), np.int64))
        return pa.table([*(table.column(k).take(first) for k in keys), np.full(len(wanted), int(weight.sum())), wanted, e], names=[*keys, "n", "prob", "estimate"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys; a run that a batch ends with is held for the next."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            code, _ = _coded([held.column(k) for k in keys])
            cutoff = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            yield from several(held.slice(0, cutoff))
            held = held.slice(cutoff)
        if held is not None:
            yield from several(held)

    def several(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            code, _ = _coded([table.column(k) for k in keys])
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            out = pa.concat_tables([run(table.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(code)))])
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    schema = T.StructType([*(T.StructField(k, centroids.schema[k].dataType) for k in keys), T.StructField("n", T.LongType()), T.StructField("prob", T.DoubleType()), T.StructField("estimate", T.DoubleType())])
    return centroids.sortWithinPartitions(*keys).mapInArrow(rows, schema)


def certify(df: DataFrame, keys: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """``estimates`` + rank_error: by a counting pass over ``df``, the distance of prob from the estimate's true ranks.

    An estimate lies at every rank between the share of values below it and the share of values not above it; rank_error is how
    far prob lies outside. Estimates of the keys with most rows (a bounded number) are broadcast to the rows, which stay where
    they are; only the rows of other keys are sent to theirs, at most ``hot_threshold`` rows in a group.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf")))
    per_key = materialise(estimates.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("prob", "estimate"))).alias("_at")))
    limit = hot_threshold(per_key.agg(F.sum("n")).first()[0] or 0)
    null_safe = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    def counted(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.join(right, null_safe(left, right), "inner").select(*(left[k] for k in keys), "_value", "_at", "n")
        at = met.select(*keys, "n", "_value", F.explode("_at").alias("_e"))
        c = at.groupBy(*keys, "n", F.col("_e.prob").alias("prob"), F.col("_e.estimate").alias("estimate")).agg(
            F.sum((F.col("_value") < F.col("_e.estimate")).cast("long")).alias("_below"), F.sum((F.col("_value") <= F.col("_e.estimate")).cast("long")).alias("_upto")
        )
        return c.select(*keys, "n", "prob", "estimate", F.greatest(F.lit(0.0), F.col("_below") / F.col("n") - F.col("prob"), F.col("prob") - F.col("_upto") / F.col("n")).alias("rank_error"))

    hot = F.broadcast(per_key.where(F.col("n") > limit))
    return counted(rows, hot).unionByName(counted(rows.join(hot, null_safe(rows, hot), "left_anti"), per_key.where(F.col("n") <= limit)))
