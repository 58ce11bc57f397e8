"""Positions and running totals within groups of any size, without gathering a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def with_positions(df: DataFrame, keys: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """``df`` + ``position`` (from 0 within equal ``keys``, by ``order``) and, with ``size``, ``offset`` (sum of ``size`` before).

    Rows are range-partitioned by keys and order, so a group spreads over as many tasks as it fills; each task numbers
    its rows, and the totals of a group in earlier tasks are added. Those totals are one row per task and key that
    the task holds, at most rows / group plus tasks in number. ``order`` should be unique within a group.
    """
    names = [*df.columns]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_task", "position", "offset"))])

    def number(batches):
        task, last, at, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            starts = _runs(columns) if keys else np.array([0])
            lengths = np.diff(np.append(starts, batch.num_rows))
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64) if size else np.zeros(batch.num_rows, np.int64)
            position = np.arange(batch.num_rows) - np.repeat(starts, lengths)
            before = np.cumsum(sizes) - sizes
            before -= np.repeat(before[starts], lengths)
            key = tuple(c[0].as_py() for c in columns)
            if key == last:
                position[: lengths[0]] += at
                before[: lengths[0]] += total
            last, at, total = tuple(c[-1].as_py() for c in columns), int(position[-1]) + 1, int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task)), pa.array(position), pa.array(before)], names=[*names, "_task", "position", "offset"])

    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(number, schema)
    placed = materialise(placed)
    last_size = F.col(size) if size else F.lit(0)
    ends = placed.groupBy(*keys, "_task").agg((F.max("position") + 1).alias("_n"), F.max(F.col("offset") + last_size).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_task", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_total"))
    ends = ends.where((F.col("_before") > 0) | (F.col("_total") > 0))
    # only the key that a task begins with can continue from an earlier one: at most a row per task
    ends = ends.select(F.col("_task").alias("_t"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before", "_total")
    on = F.col("_task") == F.col("_t")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = placed.join(F.broadcast(ends), on, "left")
    position = (F.col("position") + F.coalesce(F.col("_before"), F.lit(0))).alias("position")
    offset = (F.col("offset") + F.coalesce(F.col("_total"), F.lit(0))).alias("offset")
    return joined.select(*names, position, *([offset] if size else []))
