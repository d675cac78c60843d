"""One watch for each workspace: when its changes are flushed, when it is swept, when it is clustered anew.

All three follow from one state and one clock.  A change is flushed at once if the
last flush is DEBOUNCE_MS or more ago; else it waits for the first change that is, or
for DEBOUNCE_MS without one.  Every SWEEP_MS there is a sweep, and a sweep finds that it
is time to cluster if changes were flushed since the last time and the last of them
QUIET_MS ago or more.

``Watch`` is that logic over any clock.  ``actions`` runs it as a stateful stream: the
pending changes are map state, one entry a path, never gathered as a list of events, and
a timer wakes the state when something is due.  Changes are folded as they come, so
what a flush says of a path is what ``events.coalesce_events`` says of its events.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager
from dataclasses import astuple, dataclass
from datetime import UTC, datetime
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.streaming.events import QUIET_MS, _after, admitted, split_renames

DEBOUNCE_MS, SWEEP_MS = 500, 30_000
#: Time of a watch that has seen nothing.
NEVER = -(1 << 60)


@dataclass(frozen=True)
class Limits:
    """Milliseconds of a watch's three spans."""

    debounce: int = DEBOUNCE_MS
    sweep: int = SWEEP_MS
    quiet: int = QUIET_MS


ACTION = "workspace string, at timestamp, action string, file_path string, kind string, old_path string, changes long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Times:
    """Milliseconds: of the clock, the last flush, event and flushed change and the next sweep; changes since the last clustering, and whether any is pending."""

    now: int = NEVER
    flushed: int = NEVER
    event: int = NEVER
    processed: int = NEVER
    sweep: int = NEVER
    changes: int = 0
    waiting: bool = False


_TIMES = "now long, flushed long, event long, processed long, sweep long, changes long, waiting boolean"


class Watch:
    """The state of a workspace; ``pending`` maps paths to (kind, old path).

    Methods give the actions that have come due, (at, action, path, kind, old path,
    changes), in the order of time.
    """

    def __init__(self, pending: MutableMapping[str, tuple[str, str | None]], times: Times | None = None, every_sweep: bool = True, limits: Limits = Limits()):
        self.pending, self.times, self.every_sweep, self.limits = pending, times or Times(), every_sweep, limits

    def due(self) -> int:
        """When something is due next."""
        t = self.times
        flush = t.event + self.limits.debounce if t.waiting else t.sweep
        return min(flush, t.sweep)

    def advance(self, now: int) -> Iterator[tuple]:
        """Let time pass."""
        t = self.times
        if t.sweep == NEVER:
            t.sweep = now + self.limits.sweep
        while (at := self.due()) <= now:
            if t.waiting and t.event + self.limits.debounce <= t.sweep:
                yield from self._flush(at)
            else:
                yield from self._sweep(at)
                if not t.waiting and not t.changes and t.sweep <= now:  # sweeps that nothing lies between are one
                    t.sweep += (now - t.sweep) // self.limits.sweep * self.limits.sweep
        t.now = max(t.now, now)

    def change(self, now: int, path: str, what: str, old: str | None) -> Iterator[tuple]:
        """A change of a path at a time; one that comes late counts as of now."""
        t = self.times
        now = max(now, t.now)
        yield from self.advance(now)
        kind, before = self.pending.get(path, ("", None))
        kind, before = _after(kind, what), old if what == "renamed" else before
        self.pending[path] = kind, before if kind == "Renamed" else None
        t.event, t.waiting = now, True
        if now - t.flushed >= self.limits.debounce:
            yield from self._flush(now)

    def _flush(self, at: int) -> Iterator[tuple]:
        t, n = self.times, 0
        for path, (kind, old) in sorted(self.pending.items()):
            if kind:
                n += 1
                yield at, "flush", path, kind, old, None
        self.pending.clear()
        t.flushed, t.waiting, t.changes = at, False, t.changes + n
        if n:
            t.processed = at

    def _sweep(self, at: int) -> Iterator[tuple]:
        t = self.times
        t.sweep = at + self.limits.sweep
        if self.every_sweep:
            yield at, "sweep", None, None, None, None
        if t.changes and at - t.processed >= self.limits.quiet:
            yield at, "recluster", None, None, None, t.changes
            t.changes = 0


class WatchProcessor(StatefulProcessor):
    """``Watch`` with its state in the store; ``event_time``: the clock is the rows' ``ts`` and the watermark, else the machine's."""

    def __init__(self, event_time: bool, every_sweep: bool, limits: Limits):
        self.event_time, self.every_sweep, self.limits = event_time, every_sweep, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("times", _TIMES)
        self.pending = handle.getMapState("pending", "path string", "kind string, old_path string")

    def _watch(self) -> Watch:
        times = Times(*self.held.get()) if self.held.exists() else None
        pending = {key[0]: tuple(value) for key, value in self.pending.iterator()}
        self.stored = dict(pending)
        return Watch(pending, times, self.every_sweep, self.limits)

    def _rows(self, key: tuple, actions: Iterator[tuple]) -> Iterator[Row]:
        for at, action, path, kind, old, changes in actions:
            yield Row(workspace=key[0], at=datetime.fromtimestamp(at / 1000, UTC), action=action, file_path=path, kind=kind, old_path=old, changes=changes)

    def _keep(self, watch: Watch) -> None:
        self.held.update(astuple(watch.times))
        for path in self.stored.keys() - watch.pending.keys():
            self.pending.removeKey((path,))
        for path, value in watch.pending.items():
            if self.stored.get(path) != value:
                self.pending.updateValue((path,), value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(watch.due())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watch, now = self._watch(), timerValues.getCurrentProcessingTimeInMs()
        # of one trigger; plain tuples with shared strings, as there may be very many
        known: dict = {}
        found = [(ms, seq, known.setdefault(path, path), known.setdefault(what, what), known.setdefault(old, old)) for _, seq, ms, path, what, old, *_ in rows]
        found.sort(key=itemgetter(0, 1))
        for ms, _, path, what, old in found:
            at = ms if self.event_time else now
            if path is None:
                yield from self._rows(key, watch.advance(max(at, watch.times.now)))
            else:
                yield from self._rows(key, watch.change(at, path, what, old))
        self._keep(watch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watch = self._watch()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        yield from self._rows(key, watch.advance(max(now, watch.times.now)))
        self._keep(watch)

    def close(self) -> None:
        pass


def actions(events: DataFrame, event_time: bool = False, every_sweep: bool = True, lateness: str = "10 seconds", limits: Limits = Limits()) -> DataFrame:
    """(workspace, at, action, file_path, kind, old_path, changes) of a stream of file events (workspace, seq, ts, kind, path, new_path).

    ``action``: ``flush``, a row for each path that changed; ``sweep``, when files that are
    gone without an event are to be looked for; ``recluster``, with the number of changes since
    the last one.  An event of kind ``tick`` tells a workspace the time and nothing else;
    other events that are not admitted are left out.  The stream has to be started within
    ``stateful(spark)``.
    """
    own = events.withWatermark("ts", lateness) if event_time else events
    tick = F.col("kind") == "tick"
    known = own.where(tick | admitted(F.col("kind"), F.col("path")))
    changes = split_renames(known.where(~tick))
    ticks = known.where(tick).select(*[c for c in changes.columns if c not in ("path", "what", "old_path")], *[F.lit(None).cast("string").alias(c) for c in ("path", "what", "old_path")])
    rows = changes.unionByName(ticks).withColumn("ms", F.unix_millis("ts")).select("workspace", "seq", "ms", "path", "what", "old_path", *(["ts"] if event_time else []))
    return rows.groupBy("workspace").transformWithState(WatchProcessor(event_time, every_sweep, limits), ACTION, "append", "EventTime" if event_time else "ProcessingTime")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and map state need is the session's for queries started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
