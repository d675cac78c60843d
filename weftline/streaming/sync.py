"""Live application of changes and live transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from weftline.functions.text import DISPLAYABLE
from weftline.operators import store


def apply_changes(nodes: DataFrame, edges: DataFrame, deltas: DataFrame, parsed_nodes: DataFrame, parsed_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables after a changeset: removed and changed files go with their edges, renamed ones move, new rows keep their file's community.

    ``parsed_*`` hold the rows of created and modified files.
    """
    keys = ["workspace", "file_path"]
    gone = deltas.where("kind in ('Deleted', 'Modified', 'Created')").select(*keys).distinct()
    doomed = nodes.join(gone, keys, "left_semi").select("id")
    left_nodes, left_edges = store.cascade(nodes, edges, doomed)
    moves = deltas.where("kind = 'Renamed'").select("workspace", F.col("old_path").alias("file_path"), F.col("file_path").alias("_to"))
    moved = left_nodes.join(moves, keys, "left").withColumn("file_path", F.coalesce("_to", "file_path")).select(*nodes.columns)
    before = nodes.groupBy(*keys).agg(F.min("community").alias("_c"))
    fresh = parsed_nodes.join(before, keys, "left").withColumn("community", F.col("_c")).drop("_c")
    return moved.unionByName(fresh, allowMissingColumns=True), left_edges.unionByName(parsed_edges, allowMissingColumns=True)


def start_sync(deltas: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``apply`` on every batch of a stream of deltas."""
    return deltas.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def tail(steps: DataFrame, last_step: int = -1, lateness: str | None = None) -> DataFrame:
    """The displayable steps behind ``last_step``, each (session, step, status) once."""
    shown = steps.where(F.col("type").isin(*DISPLAYABLE) & (F.col("step_index") > last_step))
    if steps.isStreaming and lateness:
        shown = shown.withWatermark("created_at", lateness)
        return shown.dropDuplicatesWithinWatermark(["session_id", "step_index", "status"])
    return shown.dropDuplicates(["session_id", "step_index", "status"])


def latest(steps: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last arrived row of each (session, step): a running step is replaced by its done form."""
    fields = F.struct(*[c for c in steps.columns if c not in ("session_id", "step_index")])
    return steps.groupBy("session_id", "step_index").agg(F.max_by(fields, F.col(arrival)).alias("_s")).select("session_id", "step_index", "_s.*")


def read_steps(spark, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON-lines steps; files seen before are not read again."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def new_lines(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(session_id, lines, offset): the whole lines of each text (session_id, content) behind the byte where it was read last, and the byte behind them.

    What a poll of growing files needs: a line without its end waits for the next one,
    and a text shorter than its offset was cut and is read from its beginning.
    """
    at = F.coalesce("_at", F.lit(0))
    data = F.encode("content", "utf-8")
    start = F.when(at > F.octet_length("content"), F.lit(0)).otherwise(at)
    rest = F.decode(F.substring(data, start + 1, F.octet_length("content")), "utf-8")
    whole = F.regexp_extract(rest, r"(?s)^(.*)\n", 0)
    joined = files.join(offsets.select("session_id", F.col("offset").alias("_at")), "session_id", "left")
    cut = joined.select("session_id", start.cast("long").alias("_s"), whole.alias("_w")).where("_w <> ''")
    return cut.select("session_id", F.filter(F.split("_w", "\n"), lambda x: x != "").alias("lines"), (F.col("_s") + F.octet_length("_w")).alias("offset"))


def push(deltas: DataFrame, sink: Callable[[list], None], checkpoint: str, most: int = 1024, trigger: dict | None = None) -> StreamingQuery:
    """Hand the rows of a stream to ``sink`` on the driver, ``most`` at a time and never a whole batch at once, in the order of each partition."""

    def send(batch: DataFrame, _: int) -> None:
        rows = []
        for row in batch.toLocalIterator():
            rows.append(row)
            if len(rows) >= most:
                sink(rows)
                rows = []
        if rows:
            sink(rows)

    return start_sync(deltas, send, checkpoint, trigger)


def push_from_tasks(deltas: DataFrame, sink: Callable[[pd.DataFrame], pd.DataFrame], receipts: str, path: str, checkpoint: str, most: int = 1024, trigger: dict | None = None) -> StreamingQuery:
    """``push`` to a sink that each task calls itself, so no row passes the driver; what it gives back (of the schema ``receipts``) is kept below ``path``.

    A batch that runs again hands over its rows again, and its receipts replace those of before.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), most):
                yield sink(rows.iloc[at : at + most])

    def keep(batch: DataFrame, number: int) -> None:
        batch.mapInPandas(send, receipts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return start_sync(deltas, keep, checkpoint, trigger)


def progress(jobs: DataFrame) -> DataFrame:
    """The last phase of every ingestion job (job, phase, done, total, at), newest start first."""
    order = Window.partitionBy("job").orderBy(F.desc("at"))
    first = jobs.groupBy("job").agg(F.min("at").alias("started_at"))
    return jobs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").join(first, "job").orderBy(F.desc("started_at"), "job")
