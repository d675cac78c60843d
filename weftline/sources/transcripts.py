"""JSON-lines transcripts as step rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import valid_workspace
from weftline.schemas import STEP

#: File names of a session, the preferred first.
SHORT, FULL = "transcript.jsonl", "transcript_full.jsonl"
# Folders that are no projects, besides names that no workspace can have.
SKIPPED = ("brain", "Library", "CloudStorage", "OneDrive-Personal", "src", "tools", "specs", "docs", "scripts", "sdlc", "bin", "dist", "node_modules", "build", "knowledge", "Interviews")


def parse_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Steps of JSON lines in ``value``; ``malformed`` marks lines that are no step.

    A line is malformed if it is no JSON object or has a time that does not parse; a
    step without time is valid.  Tool arguments are kept as JSON text.
    """
    schema = STEP.replace("created_at timestamp", "created_at string") + ", _corrupt string"
    parsed = lines.where(F.trim("value") != "").select(*keep, F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("s"))
    ts = F.try_to_timestamp("s.created_at")
    bad = F.col("s").isNull() | F.col("s._corrupt").isNotNull() | (F.col("s.created_at").isNotNull() & (F.col("s.created_at") != "") & ts.isNull())
    return parsed.select(*keep, "s.step_index", "s.source", "s.type", "s.status", ts.alias("created_at"), "s.content", "s.thinking", "s.tool_calls", "s.is_truncated", bad.alias("malformed"))


def choose(files: DataFrame, prefer_full: bool = False) -> DataFrame:
    """(session_id, file): of each session's files (session_id, file, name) the preferred, of several such the first."""
    first = FULL if prefer_full else SHORT
    return files.groupBy("session_id").agg(F.min_by("file", F.struct(F.when(F.col("name") == first, 0).otherwise(1), "file")).alias("file"))


def read_location(spark: SparkSession, path: str, provider: str, runtime_mode: str, prefer_full: bool = False, priority: int = 0) -> DataFrame:
    """The steps of one location, a folder of sessions; of a session's two files the preferred is read."""
    raw = spark.read.text(f"{path}/*/*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    parts = F.split("file", "/")
    named = raw.withColumn("session_id", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1)).where(F.col("name").isin(SHORT, FULL))
    chosen = choose(named.select("session_id", "file", "name").distinct(), prefer_full)
    lines = named.join(chosen, ["session_id", "file"], "left_semi")
    out = parse_lines(lines, ["session_id", "file", "size"])
    return out.withColumns({"provider": F.lit(provider), "runtime_mode": F.lit(runtime_mode), "priority": F.lit(priority)})


def existing(spark: SparkSession, locations: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The locations whose folder exists, each path once."""
    jvm, out = spark.sparkContext._jvm, {}
    for place in locations:
        path = jvm.org.apache.hadoop.fs.Path(place[0])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out.setdefault(place[0], place)
    return list(out.values())


def read_all(spark: SparkSession, locations: list[tuple[str, str, str]], prefer_full: bool = False) -> DataFrame:
    """Steps of all (path, provider, runtime_mode) locations whose folder exists; a session found in several is taken from the first."""
    seen = existing(spark, list(dict.fromkeys(locations)))
    if not seen:
        raise FileNotFoundError(f"none of {[place[0] for place in locations]} exists")
    return first_location(reduce(DataFrame.unionByName, [read_location(spark, *place, prefer_full, i) for i, place in enumerate(seen)]))


def first_location(steps: DataFrame) -> DataFrame:
    """The steps of each session from the location of the least ``priority`` that has it."""
    best = steps.groupBy("session_id").agg(F.min("priority").alias("priority"))
    return steps.join(best, ["session_id", "priority"], "left_semi")


def changed(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """The files of a listing (file, mtime, size) that a former one did not have so: new, or of another time or size."""
    old = cache.select("file", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    return listing.join(old, "file", "left").where(~same).drop("_m", "_s")


def rescanned(steps: DataFrame, fresh: DataFrame, listing: DataFrame) -> DataFrame:
    """The steps (with ``file``) after a rescan: those of files still listed, with the ``fresh`` ones in place of their files' old ones."""
    kept = steps.join(listing.select("file"), "file", "left_semi").join(fresh.select("file").distinct(), "file", "left_anti")
    return kept.select(*steps.columns).unionByName(fresh.select(*steps.columns))


def known_projects(listing: DataFrame, parents: list[str], skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(name, path): the folders (path) right below the parents that can be projects; of one name that below the first parent."""
    at = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    order = F.array_position(F.array(*[F.lit(p.rstrip("/")) for p in parents]), at)
    own = listing.select(name.alias("name"), "path", order.alias("_o")).where((F.col("_o") > 0) & ~F.col("name").isin(*skip) & valid_workspace(F.col("name")))
    return own.groupBy("name").agg(F.min_by("path", F.struct("_o", "path")).alias("path"))


def with_line_numbers(steps: DataFrame) -> DataFrame:
    """``line_no`` from 0 in each session by step index."""
    return steps.withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("step_index")) - 1)


def follow(spark: SparkSession, path: str, prefer_full: bool = False, **options: str | int) -> DataFrame:
    """A stream of the steps of the sessions below ``path``, as their files gain lines; of a session's two files one kind is read.

    Beside them the session's id, the file and the byte where the line begins.  A file
    that was replaced is read again; ``sync.latest`` keeps one row a step.
    """
    from weftline.sources.live import tail_lines

    name = FULL if prefer_full else SHORT
    lines = tail_lines(spark, path, f"/{name}", **options).where("event = 'line'")
    return parse_lines(lines.withColumn("session_id", F.element_at(F.split("file", "/"), -2)), ["session_id", "file", "at"])
