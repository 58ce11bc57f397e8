"""Frequency of every term: rows, distinct images and distinct samples, exactly.

(term, record) pairs are sorted externally under range partitioning of both columns, so the pairs of a term that
holds a third of all rows spread over as many tasks as they need and equal pairs still meet in one task. Every
task then scans its sorted rows once and emits, for each run of equal terms, how many rows and how many
different records it saw. No pair lies in two tasks, so the sums of these partial counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import is_blank, term

#: Fewer distinct images than this make a term rare; more than this share of all samples makes it common.
RARE_IMAGES = 3
COMMON_SHARE = 0.5


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a value differs from the one before; the first is True. Nulls equal nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], unequal | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))])


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows (field_name, kind, term, record, weight) sorted by the first four columns.

    Gives (field_name, kind, term, rows, records) for every run within a batch; a record that a batch ends with and the
    next begins with is counted once, since the last key is carried over.
    """
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in range(3)]
        record = batch.column(3)
        new_term = np.logical_or.reduce([_changes(k) for k in keys])
        new_record = new_term | _changes(record)
        counted = new_record & ~pc.is_null(record).to_numpy(zero_copy_only=False)
        first = tuple(c[0].as_py() for c in (*keys, record))
        if first == last:
            counted[0] = False
        last = tuple(c[-1].as_py() for c in (*keys, record))
        starts = np.flatnonzero(new_term)
        weight = batch.column(4).to_numpy(zero_copy_only=False)
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [*(k.take(at) for k in keys), pa.array(np.add.reduceat(weight, starts)), pa.array(np.add.reduceat(counted.astype(np.int64), starts))],
            names=["field_name", "kind", "term", "rows", "records"],
        )


def _pairs(df: DataFrame, field: str, image: str, sample: str, name: str) -> DataFrame:
    """(field_name, kind, term, record, weight). Few samples repeat often, so those pairs combine before the sort; all rows of a term
    count there, so rows without an image need no pair of their own.
    """
    rows = df.select(F.lit(name).alias("field_name"), term(field).alias("term"), F.col(image).alias("image"), F.when(~is_blank(sample), F.col(sample)).alias("sample"))
    termed = rows.where(F.col("term").isNotNull())
    images = termed.where(F.col("image").isNotNull()).select("field_name", F.lit("image").alias("kind"), "term", F.col("image").alias("record"), F.lit(1).cast("long").alias("weight"))
    samples = termed.groupBy("field_name", F.lit("sample").alias("kind"), "term", F.col("sample").alias("record")).agg(F.count(F.lit(1)).alias("weight"))
    return images.unionByName(samples)


def _sample_totals(tables: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(field_name, all_samples): distinct samples of each table; one row a table."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("field_name"), F.col(sample).alias("sample")).where(~is_blank("sample")) for df, _, _, sample, name in tables))
    return rows.distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("all_samples"))


def term_frequencies(tables: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(field_name, term, n_rows, n_images, n_samples, mark) of every term of every table.

    ``tables``: (frame, term column, image column, sample column, field name). A term is a value without
    surrounding spaces and tabs; null and blank values are no terms. Null images and null or blank samples don't count
    as records, their rows do. mark is ``rare`` (fewer than RARE_IMAGES images), ``common`` (more than COMMON_SHARE
    of the table's distinct samples) or null; a term that is both is rare. Strings compare by code point. Empty
    tables give no rows; further columns aren't read.
    """
    pairs = reduce(DataFrame.unionByName, (_pairs(*t) for t in tables))
    by = ["field_name", "kind", "term", "record"]
    ordered = pairs.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "weight")
    runs = ordered.mapInArrow(scan_runs, "field_name string, kind string, term string, rows long, records long")
    pick = lambda kind, what: F.sum(F.when(F.col("kind") == kind, F.col(what)))
    counted = runs.groupBy("field_name", "term").agg(
        pick("sample", "rows").alias("n_rows"), F.coalesce(pick("image", "records"), F.lit(0)).alias("n_images"), pick("sample", "records").alias("n_samples")
    )
    terms = counted.join(F.broadcast(_sample_totals(tables)), "field_name", "left")
    mark = F.when(F.col("n_images") < RARE_IMAGES, "rare").when(F.col("n_samples") > F.col("all_samples") * COMMON_SHARE, "common")
    return terms.select("field_name", "term", "n_rows", "n_images", "n_samples", mark.alias("mark"))
