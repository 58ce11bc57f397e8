"""Extension: new specimens as a stream, assigned to the nearest centroid of a finished clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import invalid_vector, unit_vector

#: Centroids that every task may hold.
MOST_CENTROIDS = 50_000


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` (id, v, ...) + (cluster, cosine): the nearest of the unit ``centroids`` (cluster, centroid); works on streams.

    Unusable vectors have null results. Ties go to the lesser cluster.
    """
    rows = centroids.select("cluster", "centroid").orderBy("cluster").limit(MOST_CENTROIDS + 1).collect()
    if not rows or len(rows) > MOST_CENTROIDS:
        raise ValueError(f"there must be between 1 and {MOST_CENTROIDS} centroids")
    names, c = pa.array([str(r.cluster) for r in rows]), np.array([r.centroid for r in rows])
    kept = vectors.columns

    def run(batches):
        for batch in batches:
            good = batch.column("_ok").to_numpy(zero_copy_only=False)
            best, value = np.zeros(batch.num_rows, int), np.full(batch.num_rows, np.nan)
            if good.any():
                u = np.stack([np.asarray(x) for x, ok in zip(batch.column("_u").to_pylist(), good) if ok])
                s = u @ c.T
                best[good], value[good] = s.argmax(axis=1), s.max(axis=1)
            cluster = pa.array([names[int(b)].as_py() if ok else None for b, ok in zip(best, good)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), cluster, pa.array(value, mask=~good)], names=[*kept, "cluster", "cosine"])

    schema = vectors.schema.add("cluster", "string").add("cosine", "double") if not {"cluster", "cosine"} & set(kept) else None
    if schema is None:
        raise ValueError("the vectors have a column cluster or cosine")
    return vectors.withColumn("_ok", ~invalid_vector("v")).withColumn("_u", unit_vector("v")).mapInArrow(run, schema)


def assign_stream(spark: SparkSession, source: str, schema: str, centroids: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Assign the vectors of new parquet files in ``source`` as they come; results are appended to ``out`` exactly once."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = nearest_centroid(stream, centroids).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str = "assigned_at", lateness: str = "30 days", window: str = "1 day") -> DataFrame:
    """(window, cluster, n) of a stream of assignments, rows later than ``lateness`` left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), "cluster").agg(F.count(F.lit(1)).alias("n"))
