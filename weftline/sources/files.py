"""Source trees as rows: pruned recursive scan, admission, content hash, incremental change."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import extension

# Folders that a scan does not enter, besides hidden ones.
NOISE_DIRS = (
    "node_modules", "target", "dist", "build", "vendor", "solutions", "data", "datasets", "log", "logs", "output",
    "outputs", "coverage", "tmp", "temp", "cache", ".cache", "bin", "obj", "debug", "release", "testdata",
)
# Files and extensions that are not source text.
SKIPPED_FILES = (".DS_Store", ".gitignore", "Thumbs.db")
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "pdf", "zip", "tar", "gz", "bz2", "xz", "7z", "exe", "bin",
    "dll", "dylib", "so", "a", "o", "obj", "wasm", "pyc", "pyo", "pyd", "class", "jar", "lock", "map", "rlib",
    "rmeta", "timestamp", "out", "parquet", "arrow", "npy", "npz", "h5", "pkl", "pt", "pth",
)
MAX_BYTES, PEEK = 512 * 1024, 512


def clean_folders(path: Column) -> Column:
    """Whether no folder of a relative path is hidden or noise."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*NOISE_DIRS))


def admissible(path: Column, size: Column, content: Column) -> Column:
    """Whether a file is text worth parsing: small, of no binary kind, without zero bytes at its head, valid UTF-8."""
    name = F.element_at(F.split(path, "/"), -1)
    return (size <= MAX_BYTES) & ~name.isin(*SKIPPED_FILES) & ~extension(path).isin(*BINARY_EXTENSIONS) & (F.position(F.lit(b"\x00"), F.substring(content, 1, PEEK)) == 0) & F.is_valid_utf8(content.cast("string"))


def listed(spark: SparkSession, root: str) -> list[str]:
    """The files below ``root`` that may be admitted, by name and size; hidden and noise folders are not entered.

    One tree's folders are listed on the driver, which holds its paths.
    """
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(context._jsc.hadoopConfiguration())
    found, open_ = [], [top]
    while open_:
        for entry in fs.listStatus(open_.pop()):
            name = entry.getPath().getName()
            if entry.isDirectory():
                if not name.startswith(".") and name not in NOISE_DIRS:
                    open_.append(entry.getPath())
            elif entry.getLen() <= MAX_BYTES and name not in SKIPPED_FILES and name.rsplit(".", 1)[-1].lower() not in BINARY_EXTENSIONS:
                found.append(entry.getPath().toString())
    return found


def read_tree(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """workspace, file_path (below the root), content, byte_size and file_hash of every admitted file.

    What the listing leaves out is not opened.
    """
    return _read(spark, root, workspace, listed(spark, root))


def read_files(spark: SparkSession, root: str, workspace: str, paths: list[str]) -> DataFrame:
    """The same of some files below the root; those that are not there any more are left out."""
    return _read(spark, root, workspace, [p for p in paths if _exists(spark, p)])


def _read(spark: SparkSession, root: str, workspace: str, paths: list[str]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    raw = reader.load(paths) if paths else reader.option("recursiveFileLookup", True).option("pathGlobFilter", "/none/").load(root)
    rel = _below(F.col("path"), root)
    kept = raw.withColumn("file_path", rel).where((F.col("length") <= MAX_BYTES) & clean_folders(F.col("file_path"))).where(admissible(F.col("file_path"), F.col("length"), F.col("content")))
    return kept.select(F.lit(workspace).alias("workspace"), "file_path", F.col("content").cast("string").alias("content"), F.col("length").alias("byte_size"), F.sha2(F.col("content"), 256).alias("file_hash"))


def read_listing(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """(workspace, file_path) of the files that may be admitted; none is opened."""
    paths = spark.createDataFrame([(p,) for p in listed(spark, root)], "path string")
    return paths.select(F.lit(workspace).alias("workspace"), _below(F.col("path"), root).alias("file_path"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _below(path: Column, root: str) -> Column:
    """A path without its scheme and the root before it."""
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    full = F.regexp_replace(path, r"^[a-z0-9]+:/*", "")
    return F.substring(full, F.length(base) + 2, F.length(full))


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that are new or whose hash changed, by (workspace, file_path, file_hash)."""
    keys = ["workspace", "file_path"]
    old = known.select(*keys, F.col("file_hash").alias("_old")).distinct()
    return files.join(old, keys, "left").where(~F.col("_old").eqNullSafe(F.col("file_hash"))).drop("_old")


def missing(known: DataFrame, files: DataFrame) -> DataFrame:
    """Known files that are no longer there."""
    return known.join(files.select("workspace", "file_path"), ["workspace", "file_path"], "left_anti")


def below(path: str, roots: list[str]) -> bool:
    """Whether a path, its dots resolved, is one of the roots or lies in one."""
    clean = posixpath.normpath(path)
    return any(clean == r or clean.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots))


def browse(entries: DataFrame, folder: str, roots: list[str] | None = None) -> DataFrame:
    """Sub-folders of ``folder`` in a listing (path, is_dir), those with code markers first.

    With ``roots`` only folders in them may be asked for.
    """
    if roots is not None and not below(folder, roots):
        raise PermissionError(f"{folder} is in none of the folders that may be browsed")
    prefix = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    inside = entries.where(F.startswith("path", F.lit(prefix))).withColumn("rest", rest)
    name = F.get(F.split("rest", "/"), F.lit(0))
    markers = {"rust": "Cargo.toml", "go": "go.mod", "javascript": "package.json", "python": "pyproject.toml"}
    found = F.array_compact(F.array(*[F.when(F.col("rest") == F.concat(name, F.lit("/" + m)), F.lit(lang)) for lang, m in markers.items()]))
    dirs = inside.where(F.col("is_dir") | F.contains("rest", F.lit("/"))).withColumn("name", name).withColumn("lang", F.get(found, F.lit(0)))
    shown = dirs.where(~F.startswith("name", F.lit(".")) | (F.col("name") == ".github")).where(~F.col("name").isin("node_modules", "target", "dist", "build"))
    listed = shown.groupBy("name").agg(F.sort_array(F.collect_set("lang")).alias("languages"))
    return listed.withColumn("is_codebase", F.size("languages") > 0).orderBy(F.desc("is_codebase"), F.lower("name"))


def worktree_meta(pointers: DataFrame) -> DataFrame:
    """Lineage from worktree pointer files (root_path, content, head): parent, name, branch.

    The pointer's one line is ``gitdir: <parent>/.git/worktrees/<name>``.
    """
    place = F.regexp_extract("content", r"gitdir:\s*(\S+)", 1)
    parent_root = F.regexp_extract(place, r"^(.*)/\.git/worktrees/[^/]+/?$", 1)
    own = F.element_at(F.split(F.regexp_replace("root_path", r"/+$", ""), "/"), -1)
    return pointers.select(
        own.alias("workspace"), "root_path", (parent_root != "").alias("is_worktree"),
        F.nullif(F.element_at(F.split(parent_root, "/"), -1), F.lit("")).alias("parent_workspace"),
        F.nullif(F.regexp_extract("head", r"ref:\s*refs/heads/(\S+)", 1), F.lit("")).alias("branch"),
        F.nullif(F.regexp_extract(place, r"/worktrees/([^/]+)/?$", 1), F.lit("")).alias("worktree_name"),
    )


def parent_worktrees(gitdirs: DataFrame, existing: DataFrame) -> DataFrame:
    """(worktree_name, root_path, branch) of a parent's worktree entries (path, gitdir, head) whose root still exists."""
    root = F.regexp_replace("gitdir", r"(/\.git/?)?\s*$", "")
    named = gitdirs.select(F.regexp_extract("path", r"/worktrees/([^/]+)/", 1).alias("worktree_name"), root.alias("root_path"), F.nullif(F.regexp_extract("head", r"ref:\s*refs/heads/(\S+)", 1), F.lit("")).alias("branch"))
    return named.join(existing.select(F.col("path").alias("root_path")), "root_path", "left_semi")


def resolve_root(candidates: DataFrame, samples: DataFrame, existing: DataFrame) -> DataFrame:
    """(workspace, root): the first candidate (workspace, root, preference) under which a sample file exists, else the first existing one."""
    files = existing.select(F.col("path").alias("_p")).distinct()
    probes = candidates.join(samples.select("workspace", "file_path"), "workspace").withColumn("_p", F.concat_ws("/", "root", "file_path"))
    hits = probes.join(files, "_p", "left_semi").select("workspace", "root").distinct().withColumn("hit", F.lit(0))
    there = candidates.join(files.withColumnRenamed("_p", "root"), "root", "left_semi")
    scored = there.join(hits, ["workspace", "root"], "left").select("workspace", "root", F.coalesce("hit", F.lit(1)).alias("hit"), "preference")
    return scored.groupBy("workspace").agg(F.min_by("root", F.struct("hit", "preference")).alias("root"))
