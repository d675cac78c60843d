"""Session factory and the shared scratch folder.

Intermediate tables are written to the folder that the cluster names in
``spark.checkpoint.dir``; it is set here only where the session has none, as in
tests.  Nothing is written to a machine-local folder on a cluster.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType, StringType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _scopes = threading.Lock(), {}, threading.local()


def get_spark(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator here assumes: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set only where none is, in local mode.

    A cluster without one is an error: executors don't see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared root; it is removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/weftline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    place, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(place)
    for made in getattr(_scopes, "open", []):
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove, at the end, the scratch tables made within; those that the caller takes out of the list stay."""
    made, opened = [], getattr(_scopes, "open", [])
    _scopes.open = [*opened, made]
    try:
        yield made
    finally:
        _scopes.open = opened
        for path in made:
            place, fs = _hadoop_path(spark, path)
            fs.delete(place, True)


@contextmanager
def _shuffles_go_with_their_write(spark: SparkSession) -> Iterator[None]:
    """The session's setting is on while any write of it is under way, however many threads write, and then as before."""
    with _lock:
        count, before = _writing.get(id(spark), (0, spark.conf.get(_CLEANUP, "false")))
        _writing[id(spark)] = (count + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(id(spark))
            if count > 1:
                _writing[id(spark)] = (count - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Unlike a local checkpoint the written table survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_go_with_their_write(spark):  # the table replaces the shuffles that made it
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a materialized frame that no later plan reads."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/weftline/" in folder:
            place, fs = _hadoop_path(spark, folder)
            fs.delete(place, True)


#: Bytes a core up to which an input is dealt anew before costly work on its rows.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it is small by the planner's estimate, else as it is.

    A small table is often one file of one row group, which one task reads, however
    many cores there are; a large one has tasks enough and isn't moved.  The estimate
    of a join is the product of its sides, so what it reads is asked too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    bytes_of = lambda p: int(str(p.stats().sizeInBytes()))
    size = min(bytes_of(plan), sum(bytes_of(leaves.apply(i)) for i in range(leaves.size())))
    return df.repartition(cores) if size < SMALL * cores else df


#: Rows that a task writes of one bucket, about.
DEALT = 1 << 19


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with their column ``bucket``, dealt by it; where buckets hold many rows, each goes to several tasks.

    So a task's rows don't grow with the table, nor with the rows of one key.
    """
    held = rows.groupBy("bucket").count().agg(F.max("count"), F.sum("count")).first()
    parts, tasks = -(-(held[0] or 1) // DEALT), -(-(held[1] or 1) // DEALT)
    if parts == 1:
        return rows.repartition(buckets, "bucket")
    plain = [f.name for f in rows.schema if isinstance(f.dataType, (StringType, NumericType, DatetimeType))]
    return rows.repartition(buckets + tasks, "bucket", F.pmod(F.xxhash64(F.lit(parts), *plain), F.lit(parts)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
