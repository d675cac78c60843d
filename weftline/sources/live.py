"""Live files as streams: the lines that files gain, and what happens to the files of a tree.

Two sources of the Python Data Source API.  A poll lists the folder; a file whose time
and size are as before is not opened.  An offset holds, for each file, how far it was
read, its time, and checksums of its beginning and of the bytes before that place, so
that an offset alone tells growth from replacement, after a restart too.

``weftline_tail``    (file, at, value, event): a row for each whole line, ``at`` its first
                     byte.  A line without its end waits.  A file that was cut or replaced is read
                     from its beginning behind a row ``reset``, one that is gone gives a row
                     ``gone``; with ``heartbeat`` milliseconds a row ``beat`` comes for each
                     such span that has passed.
``weftline_watch``   (workspace, seq, ts, kind, path, new_path): create, modify, remove
                     and rename_both of the files below a folder, against what was there
                     when the stream began; a file that vanishes while one of its size,
                     time and beginning appears was renamed.

Options: ``path``, any folder that pyarrow's file systems open on driver and executors
alike; ``suffix``; ``split``, bytes of a task's share; ``workspace`` for events.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes at a file's beginning, and before the place up to which it was read, that tell whether it is still the same.
PROBE = 4096
#: Bytes that one task reads, of one file or of several; files and rows of events in a task.
SPLIT, FILES, EVENTS = 64 << 20, 500, 10_000
#: Files that the driver looks into at once.
PROBES = 16

LINES = "file string, at long, value string, event string"
EVENT = "workspace string, seq long, ts timestamp, kind string, path string, new_path string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is a local one."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path.split(":", 1)[1]).lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _crc(fs: pafs.FileSystem, file: str, start: int, end: int) -> int:
    if end <= start:
        return 0
    with fs.open_input_file(file) as f:
        return zlib.crc32(f.read_at(end - start, start))


def _last_break(fs: pafs.FileSystem, file: str, size: int) -> int:
    """The byte behind the last line end."""
    with fs.open_input_file(file) as f:
        end, step = size, 1 << 16
        while end > 0:
            start = max(0, end - step)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end, step = start, step * 2
    return 0


def _each(look: Callable, names: list) -> list:
    """``look`` of every name, several at once: most of the time goes into waiting for files."""
    if len(names) < 2:
        return [look(n) for n in names]
    with ThreadPoolExecutor(PROBES) as pool:
        return list(pool.map(look, names))


class _Folder:
    """The files of a folder as offsets; one poll after the other."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.known: dict[str, tuple] = {}

    def files(self) -> tuple[pafs.FileSystem, dict[str, pafs.FileInfo]]:
        fs, root = opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return fs, {f.path: f for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)}

    def offsets(self, whole: bool) -> dict:
        """file -> end, size, time, checksums of the beginning and of the bytes before the end; ``whole``: the end is a file's, not a line's."""
        fs, files = self.files()
        for name in self.known.keys() - files.keys():
            del self.known[name]
        stamps = {name: (info.size, info.mtime_ns) for name, info in files.items()}
        news = [name for name, stamp in stamps.items() if name not in self.known or self.known[name][0] != stamp]

        def look(name: str) -> list | None:
            size, mtime = stamps[name]
            try:
                if size > PROBE or whole:
                    end = size if whole else _last_break(fs, name, size)
                    return [end, size, mtime, _crc(fs, name, 0, min(end, PROBE)), 0 if whole else _crc(fs, name, max(0, end - PROBE), end)]
                with fs.open_input_file(name) as f:  # once for a small file
                    data = f.read_at(size, 0)
                end = data.rfind(b"\n") + 1
                crc = zlib.crc32(data[:end])
                return [end, size, mtime, crc, crc]
            except FileNotFoundError:  # gone since it was listed
                return None

        for name, entry in zip(news, _each(look, news), strict=True):
            if entry is None:
                self.known.pop(name, None)
            else:
                self.known[name] = stamps[name], entry
        return {name: entry for name, (_, entry) in sorted(self.known.items())}


def continues(fs: pafs.FileSystem, file: str, before: list, now: list) -> bool:
    """Whether a file holds what it held before, and perhaps more behind it."""
    end = before[0]
    return now[0] >= end and _crc(fs, file, 0, min(end, PROBE)) == before[3] and _crc(fs, file, max(0, end - PROBE), end) == before[4]


class _Share(InputPartition):
    """What a task reads: pieces of files (file, first, start, stop, end), or rows that are at hand."""

    def __init__(self, pieces: list[tuple[str, int, int, int, int]] | None = None, rows: list[tuple] | None = None):
        self.pieces, self.rows = pieces or [], rows


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)
        self.split, self.heartbeat = int(options.get("split", SPLIT)), int(options.get("heartbeat", 0))

    def initialOffset(self) -> dict:
        return {"files": {}, "beat": self._beat()}

    def latestOffset(self) -> dict:
        return {"files": self.folder.offsets(whole=False), "beat": self._beat()}

    def _beat(self) -> int:
        return int(time.time() * 1000) // self.heartbeat if self.heartbeat else 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, _ = opened(self.folder.path)
        before, now = start["files"], end["files"]
        told = [(file, None, None, "gone") for file in before if file not in now]

        def same(file: str) -> bool | None:
            try:
                return continues(fs, file, before[file], now[file])
            except FileNotFoundError:
                return None

        old = [file for file in now if file in before and now[file] != before[file]]
        kept = dict(zip(old, _each(same, old), strict=True))
        shares, room, files = [], 0, 0
        for file, entry in now.items():
            if file in before and kept.get(file) is None:  # as it was, or gone since
                continue
            at = before[file][0] if kept.get(file) else 0
            if kept.get(file) is False:
                told.append((file, None, None, "reset"))
            while at < entry[0]:
                if room <= 0 or files >= FILES:
                    shares.append(_Share())
                    room, files = self.split, 0
                stop = min(entry[0], at + room)
                shares[-1].pieces.append((file, before[file][0] if kept.get(file) else 0, at, stop, entry[0]))
                room, files, at = room - (stop - at), files + 1, stop
        if self.heartbeat and end["beat"] > start["beat"]:
            told.append((None, end["beat"] * self.heartbeat, None, "beat"))
        events = [_Share(rows=told[i : i + EVENTS]) for i in range(0, len(told), EVENTS)]
        return [*events, *shares] or [_Share(rows=[])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        if partition.rows is not None:
            if partition.rows:
                yield _lines(*map(list, zip(*partition.rows, strict=True)))
            return
        fs, _ = opened(self.folder.path)
        names, places, values, held = [], [], [], 0
        for piece in partition.pieces:
            for at, line in _piece(fs, *piece):
                names.append(piece[0])
                places.append(at)
                values.append(line.decode("utf-8", "replace"))
                held += len(line)
                if held >= 1 << 20 or len(names) >= EVENTS:
                    yield _lines(names, places, values, ["line"] * len(names))
                    names, places, values, held = [], [], [], 0
        if names:
            yield _lines(names, places, values, ["line"] * len(names))

    def commit(self, end: dict) -> None:
        pass


def _piece(fs: pafs.FileSystem, file: str, first: int, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin within [start, stop); the file is read from ``first`` to ``end`` by all its pieces."""
    with fs.open_input_file(file) as f:
        at, held, pos = start, b"", start
        if start > first:  # a line that began before is the former piece's
            pos = at = start - 1
        skip = at < start
        while pos < end:
            part = f.read_at(min(1 << 20, end - pos), pos)
            if not part:
                break  # cut since; the next poll sees it
            pos += len(part)
            held += part
            whole = held.rfind(b"\n") + 1
            for line in held[:whole].split(b"\n")[:-1]:
                if skip:
                    skip = False
                elif at >= stop:
                    break
                elif line:
                    yield at, line
                at += len(line) + 1
            held = held[whole:]
            if at >= stop and not skip:
                break


def _lines(file: list, at: list, value: list, event: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((file, at, value, event), kinds, strict=True)], ["file", "at", "value", "event"])


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tree_events(before: dict, now: dict) -> list[tuple[str, str, str | None]]:
    """(kind, path, new_path) between two states of a tree, by path; a rename stands at its old path."""
    gone, fresh = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
    arrived: dict[tuple, list[str]] = {}
    for path in reversed(fresh):
        arrived.setdefault(tuple(now[path][1:4]), []).append(path)
    events, moved = [], set()
    for path in gone:
        same = arrived.get(tuple(before[path][1:4]))
        if same and before[path][1]:  # empty files are all alike
            moved.add(same[-1])
            events.append(("rename_both", path, same.pop()))
        else:
            events.append(("remove", path, None))
    events += [("create", path, None) for path in fresh if path not in moved]
    events += [("modify", path, None) for path in now.keys() & before.keys() if now[path][1:] != before[path][1:]]
    return sorted(events, key=lambda e: e[1])


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)
        self.root = opened(options["path"])[1].rstrip("/")
        self.workspace = options.get("workspace", self.root.rsplit("/", 1)[-1])

    def initialOffset(self) -> dict:
        return {"files": self.folder.offsets(whole=True), "at": int(time.time() * 1000)}

    def latestOffset(self) -> dict:
        files = self.folder.offsets(whole=True)
        now = int(time.time() * 1000)
        held = getattr(self, "_held", None)  # the same offset where nothing happened
        self._held = held if held and held["files"] == files else {"files": files, "at": now}
        return self._held

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        short = lambda p: p[len(self.root) + 1 :] if p else None
        events = tree_events(start["files"], end["files"])
        rows = [(self.workspace, end["at"] * 1000 + i, end["at"] * 1000, kind, short(path), short(new)) for i, (kind, path, new) in enumerate(events)]
        return [_Share(rows=rows[i : i + EVENTS]) for i in range(0, len(rows), EVENTS)] or [_Share(rows=[])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string())
            names = [c.split()[0] for c in EVENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*partition.rows, strict=True), kinds, strict=True)], names)

    def commit(self, end: dict) -> None:
        pass


class TreeWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_watch"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WatchReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, suffix: str = "", **options: str | int) -> DataFrame:
    """A stream of the lines that the files below ``path`` hold and gain."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("weftline_tail").options(path=path, suffix=suffix, **options).load()


def watch_tree(spark: SparkSession, path: str, suffix: str = "", **options: str | int) -> DataFrame:
    """A stream of the events of the files below ``path``, for ``streaming.events`` and ``streaming.timers``."""
    spark.dataSource.register(TreeWatch)
    return spark.readStream.format("weftline_watch").options(path=path, suffix=suffix, **options).load()


def present(log: DataFrame, order: str = "batch") -> DataFrame:
    """The lines that stand, of all rows of a tail with the number of their batch: those behind a file's last ``reset`` or ``gone``.

    Within a batch a file's lines come behind its reset.
    """
    from pyspark.sql import functions as F

    ends = log.where("event in ('reset', 'gone')").groupBy("file").agg(F.max(order).alias("_from"), F.max_by("event", order).alias("_event"))
    rows = log.where("event = 'line'").join(ends, "file", "left")
    after = F.col("_from").isNull() | (F.col(order) > F.col("_from")) | ((F.col(order) == F.col("_from")) & (F.col("_event") == "reset"))
    return rows.where(after).drop("_from", "_event")
