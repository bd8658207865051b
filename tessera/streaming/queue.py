"""A work queue as a stateful stream: files wait for a slot, run in batches, may be cancelled, and never take a forbidden step.

Each queue (a key) has so many slots. Its state is held in four variables: the files that run with the chunks they have done, those that
wait in order, those that are to be cancelled, and the last step of each file that the queue knows. An event is a request (a file's
total chunks), a done batch, a cancel or a failure. What it changes is given at once; a step that the life cycle forbids changes nothing
and is given as refused. There are no timers: a stream that has any never ends by itself when it is to read what is there and stop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.status import FOLLOWS

SLOTS, BATCH = 2, 20

OUT = "queue string, seq long, file string, status string, processed long, total long, accepted boolean"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


class Steps:
    """The rules of a queue over plain dictionaries: running and waiting (file: total), done (file: chunks), flagged, last (file: status)."""

    def __init__(self, slots: int, running: dict, waiting: dict, done: dict, flagged: set, last: dict):
        self.slots, self.running, self.waiting, self.done, self.flagged, self.last = slots, running, waiting, done, flagged, last

    def _row(self, file: str, status: str, total: int, accepted: bool = True) -> tuple:
        if accepted:
            self.last[file] = status
        return file, status, self.done.get(file, 0), total, accepted

    def _fill(self) -> list[tuple]:
        """Waiting files take free slots in their order."""
        out = []
        while self.waiting and len(self.running) < self.slots:
            file = next(iter(self.waiting))
            self.running[file] = self.waiting.pop(file)
            self.done[file] = 0
            out.append(self._row(file, "Processing", self.running[file]))
        return out

    def _end(self, file: str, status: str) -> list[tuple]:
        total = self.running.pop(file)
        row = self._row(file, status, total)
        self.done.pop(file, None)
        self.flagged.discard(file)
        return [row, *self._fill()]

    def take(self, kind: str, file: str, total: int) -> list[tuple]:
        """What an event changes."""
        if kind == "request":
            if file in self.running or file in self.waiting:
                return [self._row(file, "New", total, False)]
            again = self.last.get(file)
            steps = [] if again is None else ["Ready to Reprocess"]
            if steps and steps[0] not in FOLLOWS[again]:
                return [self._row(file, steps[0], total, False)]
            self.waiting[file] = total
            return [self._row(file, steps[0] if steps else "New", total), *self._fill()]
        if kind == "cancel":
            if file in self.waiting:
                total = self.waiting.pop(file)
                return [self._row(file, "Cancelled", total)]
            if file in self.running:
                self.flagged.add(file)  # it stops when its batch is done
                return []
            return [self._row(file, "Cancelled", total, False)]
        if file not in self.running:
            return [self._row(file, "Completed" if kind == "batch" else "Failed", total, False)]
        if kind == "fail":
            return self._end(file, "Failed")
        self.done[file] = min(self.done[file] + BATCH, self.running[file])
        if file in self.flagged:
            return self._end(file, "Cancelled")
        if self.done[file] == self.running[file]:
            return self._end(file, "Completed")
        return [self._row(file, "Processing", self.running[file])]


class QueueProcessor(StatefulProcessor):
    """Steps on the state of a stream."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getMapState("running", "file string", "total long, done long")
        self.waiting = handle.getListState("waiting", "file string, total long")
        self.flagged = handle.getMapState("flagged", "file string", "set boolean")
        self.last = handle.getMapState("last", "file string", "status string")

    def _steps(self) -> Steps:
        running = {k[0]: v for k, v in self.running.iterator()}
        waiting = dict(map(tuple, self.waiting.get())) if self.waiting.exists() else {}
        flagged = {k[0] for k, _ in self.flagged.iterator()}
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        return Steps(self.slots, {k: v[0] for k, v in running.items()}, waiting, {k: v[1] for k, v in running.items()}, flagged, last)

    def _keep(self, steps: Steps, before: dict) -> None:
        for state, now in ((self.running, {f: (t, steps.done[f]) for f, t in steps.running.items()}), (self.flagged, {f: (True,) for f in steps.flagged})):
            state.clear()
            for file, value in now.items():
                state.updateValue((file,), value)
        for file, status in steps.last.items():
            if before.get(file) != status:
                self.last.updateValue((file,), (status,))
        self.waiting.put(list(steps.waiting.items())) if steps.waiting else self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = self._steps()
        before, out = dict(steps.last), []
        events = sorted((row for batch in rows for row in batch.itertuples(index=False)), key=lambda r: r.seq)
        for r in events:
            out += [(key[0], r.seq, *x) for x in steps.take(r.kind, r.file, int(r.total))]
        self._keep(steps, before)
        yield pd.DataFrame(out, columns=OUT_NAMES)

    def close(self) -> None:
        pass


def work(events: DataFrame, slots: int = SLOTS) -> DataFrame:
    """On a stream of events (queue, seq, kind, file, total): what each changes, in append mode. Needs the state store that keeps
    several variables (``spark.sql.streaming.stateStore.providerClass``: that of RocksDB)."""
    return events.groupBy("queue").transformWithStateInPandas(QueueProcessor(slots), OUT, "Append", "None")


def work_in_batch(events: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The same over a table: each queue's events in turn, as they come sorted; only a queue's state is held."""

    # One sort by queue and seq serves the grouping; a queue comes in batches.
    own = events.select("queue", "seq", "kind", "file", F.coalesce("total", F.lit(0)).alias("total"))

    def walked(batches):
        steps, queue = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.queue != queue or steps is None:
                    steps, queue = Steps(slots, {}, {}, {}, set(), {}), r.queue
                out += [(queue, r.seq, *x) for x in steps.take(r.kind, r.file, int(r.total))]
            yield pd.DataFrame(out, columns=OUT_NAMES)

    return own.repartition("queue").sortWithinPartitions("queue", "seq").mapInPandas(walked, OUT)
