"""Usable vectors of a wide embedding table."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import is_blank


def dimension_columns(df: DataFrame, prefix: str = "dim_") -> list[str]:
    """The columns ``prefix`` + number, in numeric order."""
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))]
    return [c for _, c in sorted(found)]


def usable_vectors(df: DataFrame, id_column: str = "id", at: str = "extracted_at", prefix: str = "dim_") -> DataFrame:
    """(id, v, at): of every id that is neither null nor blank the latest row, if its vector is usable.

    A vector is usable if all its dimensions are finite and not null and one at least isn't zero. Of rows with equal
    times the one with the greater vector counts; a null time is the earliest. The latest row decides: an older
    usable one doesn't step in. Other columns are not read; no dimension columns is an error.
    """
    dims = dimension_columns(df, prefix)
    if not dims:
        raise ValueError(f"no columns {prefix}0, {prefix}1, ...")
    rows = df.where(~is_blank(id_column)).select(F.col(id_column).alias("id"), F.struct(F.col(at).alias("at"), F.array(*(F.col(c).cast("float") for c in dims)).alias("v")).alias("row"))
    latest = rows.groupBy("id").agg(F.max("row").alias("row"))  # combines map-side, so a repeated id is no hot key
    finite = F.forall("row.v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return latest.where(finite & F.exists("row.v", lambda x: x != 0)).select("id", "row.v", "row.at")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as a float32 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, computed in double precision."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def unit32(x: np.ndarray) -> np.ndarray:
    """``unit`` in single precision, a bounded piece at a time."""
    out = np.empty(x.shape, np.float32)
    for a in range(0, len(x), 16_384):
        out[a : a + 16_384] = unit(x[a : a + 16_384])
    return out
