"""Session, shared-storage and broadcast helpers used by every operator."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("morphex")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    ``spark.checkpoint.dir`` of the session is used where set. Only on one machine (tests) a temporary folder is chosen
    where neither it nor a checkpoint folder is set; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="morphex-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder, for files that are written and read again."""
    return f"{spark.sparkContext.getCheckpointDir() or _shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    Spark does so when the driver's JVM collects garbage, which a large driver heap may put off until the disks are full.
    A remote session has no such JVM at hand and is left alone.
    """
    if is_remote():
        return
    for _ in range(6):  # the JVM learns of dropped Python references only after the first round
        gc.collect()
        spark.range(1).collect()  # schedulers and listeners hold what ran last until something else has run
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def term(column: Column | str) -> Column:
    """Value without surrounding spaces and tabs; null when blank."""
    c = F.col(column) if isinstance(column, str) else column
    stripped = F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    return F.when(~is_blank(c), stripped)


def is_blank(column: Column | str) -> Column:
    """True for null and for text of nothing but (Unicode) white space."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | ~c.rlike(r"\P{IsWhite_Space}")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def free_name(df: DataFrame, stem: str) -> str:
    """Column name not used in ``df`` (compared as Spark does, without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
