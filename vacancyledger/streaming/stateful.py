"""Operators that keep state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import STALE_AFTER_SECONDS, scan_intervals

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CHANGES = "source_id string, identity_key string, scan_seq bigint, change string"
_NAMES = {1: "possibly_closed", 2: "closed"}


#: Rows of a frame of changes, and jobs that are closed between two passes over a bucket.
CHUNK = 10_000


class _Lifecycle(StatefulProcessor):
    """State of one bucket of a source's jobs.

    ``jobs``: identities that are open, with the last scan that saw them and the newest completion that
    was applied to them one by one. ``gone``: closed ones, out of the way of later completions.
    ``clock``: the two newest completed scans of the source. A job's absences are the scans of the clock
    after its last sighting, so a completion writes nothing to the jobs that it leaves open. ``arrived``
    holds the sightings of the batch at hand. Maps are walked entry by entry, never held whole.
    """

    def __init__(self, chunk: int) -> None:
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        identity = "identity_key string"
        self.jobs = handle.getMapState("jobs", identity, "last_seq bigint, applied bigint")
        self.gone = handle.getMapState("gone", identity, "last_seq bigint")
        self.arrived = handle.getMapState("arrived", identity, "seqs array<bigint>")
        self.clock = handle.getValueState("clock", "seqs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = list(self.clock.get()[0]) if self.clock.exists() else []
        marked = self._stage(rows)
        # A marker that comes again is no second absence.
        marks = sorted(m for m in marked if not clock or m > clock[-1])
        changes = chain(self._seen(clock, marks), self._missed(clock, marks) if marks else ())
        for part in batched(changes, self.chunk):
            frame = pd.DataFrame(part, columns=["identity_key", "scan_seq", "change"])
            frame.insert(0, "source_id", key[0])
            yield frame
        if marks:
            self.clock.update(((clock + marks)[-2:],))
        self.arrived.clear()

    def _stage(self, rows: Iterator[pd.DataFrame]) -> set[int]:
        """Keep the sightings of the batch by identity; the scans that it says are complete."""
        marks: set[int] = set()
        for number, frame in enumerate(rows):
            marker = frame["marker"].astype(bool)
            marks.update(int(m) for m in frame.loc[marker, "scan_seq"])
            for identity, seqs in frame.loc[~marker].groupby("identity_key")["scan_seq"]:
                seen = {int(n) for n in seqs}
                if number and self.arrived.containsKey((identity,)):
                    seen |= set(self.arrived.getValue((identity,))[0])
                self.arrived.updateValue((identity,), (sorted(seen),))
        return marks

    def _seen(self, clock: list[int], marks: list[int]) -> Iterator[tuple]:
        """Changes of the jobs that the batch saw, sightings of a scan before its completion."""
        newest = (clock + marks)[-1] if clock or marks else -1
        for (identity,), (seqs,) in self.arrived.iterator():
            last, absences, closed = None, 0, False
            if self.jobs.containsKey((identity,)):
                last = self.jobs.getValue((identity,))[0]
                absences = sum(c > last for c in clock)
            elif self.gone.containsKey((identity,)):
                last, absences, closed = self.gone.getValue((identity,))[0], 2, True
            seqs = [n for n in seqs if last is None or n > last]
            if not seqs:
                continue
            # A sighting that came after the completion of later scans meets these as well.
            completed = {c for c in clock if c >= seqs[0]} | set(marks)
            for number in sorted(completed.union(seqs)):
                if number in seqs:
                    if last is None or absences:
                        yield identity, number, "discovered" if last is None else "reopened"
                    last, absences = number, 0
                elif last is not None and absences < 2:
                    absences += 1
                    yield identity, number, _NAMES[absences]
            if absences < 2:
                self.jobs.updateValue((identity,), (last, newest))
                if closed:
                    self.gone.removeKey((identity,))
            elif last is not None:
                self._close(identity, last)

    def _missed(self, clock: list[int], marks: list[int]) -> Iterator[tuple]:
        """Changes of the open jobs that the batch did not see."""
        first, more = True, True
        while more:
            closing, more = [], False
            for (identity,), (last, applied) in self.jobs.iterator():
                if applied >= marks[-1]:
                    continue
                before = sum(c > last for c in clock)
                due = [m for m in marks if m > last][: 2 - before]
                if before + len(due) < 2:
                    if first and due:
                        yield identity, due[0], _NAMES[before + 1]
                elif len(closing) < self.chunk:
                    closing.append((identity, last, before, due))
                else:
                    more = True
            for identity, last, before, due in closing:
                for step, number in enumerate(due, before + 1):
                    yield identity, number, _NAMES[step]
                self._close(identity, last)
            first = False

    def _close(self, identity: str, last: int) -> None:
        self.gone.updateValue((identity,), (last,))
        if self.jobs.containsKey((identity,)):
            self.jobs.removeKey((identity,))

    def close(self) -> None:
        pass


def stream_lifecycle(rows: DataFrame, buckets: int = 64, chunk: int = CHUNK) -> DataFrame:
    """Status changes of jobs as scans arrive.

    ``rows``: source_id, identity_key, scan_seq, marker. A marker row (no identity) says that
    the scan was complete; a scan's marker arrives with or after its observations and scans of
    a source arrive in order. A source's jobs are spread over buckets, so a large source does
    not end in one task; markers, one per scan, are copied to every bucket. A task holds the sightings
    of one Arrow batch and a chunk of changes, however large a bucket or a batch is. Closed jobs leave
    the jobs that completions look at and keep a small entry, so that one that comes back is reopened.
    Needs the RocksDB state store (``STATE_STORE``).
    """
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("identity_key"), F.lit(buckets)).cast("int"))
    spread = rows.select(
        "source_id", "identity_key", F.col("scan_seq").cast("long").alias("scan_seq"), "marker",
        F.explode(F.when(F.col("marker"), every).otherwise(own)).alias("bucket"),
    )
    return spread.groupBy("source_id", "bucket").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(chunk), outputStructType=_CHANGES, outputMode="Append",
        timeMode="None",
    )


def stream_scan_intervals(scans: DataFrame, late: str = "6 hours") -> DataFrame:
    """Scans per source and six-hour interval; an interval is final ``late`` after its end. Rows later
    than that are counted, see ``dropped_as_late``; ``snapshots.fold_scan_intervals`` merges them."""
    return scan_intervals(scans.withWatermark("finished_at", late))


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that the recent batches of a query dropped because they came after its watermark."""
    return sum(
        int(operator["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


_STALE = "scan_run_id string, started_at timestamp, stale_at timestamp"


def stream_stale_runs(
    events: DataFrame, stale_after: int = STALE_AFTER_SECONDS, late: str = "6 hours"
) -> DataFrame:
    """Scans that were started and not finished within the limit, by event time.

    ``events``: scan_run_id, ts, kind (started or finished). A scan is reported once events of its
    limit may be ``late`` no longer, so that a finish that arrives late still counts; rows later than
    that are counted, see ``dropped_as_late``.
    """

    def watch(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (started,) = state.get
            state.remove()
            begun = pd.Timestamp(started, unit="us")
            yield pd.DataFrame(
                {
                    "scan_run_id": [key[0]], "started_at": [begun],
                    "stale_at": [begun + pd.Timedelta(seconds=stale_after)],
                }
            )
            return
        started, finished = (state.get[0] if state.exists else None), False
        for batch in batches:
            finished = finished or bool((batch["kind"] == "finished").any())
            begun = batch.loc[batch["kind"] == "started", "ts"]
            if len(begun):
                started = int(begun.min().value // 1_000)
        if finished:
            if state.exists:
                state.remove()
        elif started is not None:
            state.update((started,))
            due = started // 1_000 + stale_after * 1_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", late)
    return timed.groupBy("scan_run_id").applyInPandasWithState(
        watch, _STALE, "started bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
