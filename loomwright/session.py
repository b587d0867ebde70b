"""Session helpers: configuration, shared scratch space, code shipping, row order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parent

_shipped: set[str] = set()

#: Rows of an Arrow batch. Rows hold whole texts, and a batch stands in the memory of both the JVM and its worker.
BATCH_ROWS = "1000"
BATCH_BYTES = "16m"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine is tested with; an existing one is reused."""
    builder = SparkSession.builder.appName("loomwright")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package when they cannot import it from PYTHONPATH."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the setting is absent (tests)."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwright-"))
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread_small(df: DataFrame, *by: str, mb_a_core: int = 24) -> DataFrame:
    """df dealt out by ranges of the columns if Spark puts it at less than so much for each core, when a row group or two may hold it all; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * (mb_a_core << 20):
        return df
    return df.repartitionByRange(4 * cores, *by)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL: one notion of a missing value."""
    def clean(field: T.StructField):
        c = F.col(f"`{field.name}`")
        return F.when(~F.isnan(c), c).alias(field.name) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c

    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema):
        return df
    return df.select(*map(clean, df.schema))


def with_rid(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A dense 0-based position: rows of earlier partitions come first.

    One small job counts the rows of each partition; the offsets are one row per partition. Adaptive
    execution may cut a shuffled frame otherwise in each job, so such a frame is written with its places first."""
    part, local = F.spark_partition_id(), F.monotonically_increasing_id()
    tagged = df.withColumn("__part", part).withColumn("__local", local - F.shiftleft(part.cast("long"), 33))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        tagged = written(tagged, "places")
    counts = tagged.groupBy("__part").count().orderBy("__part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["__part"], total))
        total += row["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __offset long")
    out = tagged.join(F.broadcast(table), "__part", "left")
    return out.withColumn(name, F.col("__local") + F.col("__offset")).drop("__part", "__local", "__offset")
