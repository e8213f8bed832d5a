"""The frontier over a log of pushes: replayed from a table, and as a stream with keyed state.

Each run's pushes come in order of seq, and after every `pop_every` of them the best entry that
waits is popped. A null relevance is 0, null domains are none; pushes without a run are one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.frontier import WEIGHTS, Frontier
from loomgraph.operators.ranks import ranked

POPPED = "run string, step long, kind string, id string, score double"
COLUMNS = ["run", "step", "kind", "id", "score"]


def _plain(pushes: DataFrame) -> DataFrame:
    return pushes.select("run", "seq", "kind", "id", F.coalesce("relevance", F.lit(0)).cast("double").alias("relevance"), F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def replay(pushes: DataFrame, mode: str, pop_every: int = 1, write=None) -> DataFrame:
    """(run, step, kind, id, score) of each run's pops; step: how many pushes came before.

    Pushes are numbered by ranges, and only the first of each kind and id goes on: a run's fold
    reads what can enter its queue, in order and batch by batch, however long its log is.
    """
    steps = ranked(_plain(pushes), ["seq", "kind", "id", "relevance", "domains"], ["run"], "step", write)
    first = steps.groupBy("run", "kind", "id").agg(F.min(F.struct("step", "relevance", "domains")).alias("f")).select("run", "f.step", "kind", "id", "f.relevance", "f.domains", F.lit(False).alias("over"))
    ends = steps.groupBy("run").agg(F.max("step").alias("step")).select("run", "step", *(F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("id", "string"), ("relevance", "double"), ("domains", "array<string>"))), F.lit(True).alias("over"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = ...
        queue, due = Frontier(mode), pop_every
        for batch in batches:
            got = []
            for run, step, kind, ident, relevance, domains, over in batch.itertuples(index=False, name=None):
                if run != now:
                    now, queue, due = run, Frontier(mode), pop_every
                last = step if over else step - 1
                while due <= last and (item := queue.pop()):
                    got.append((run, due, item["kind"], item["id"], item["score"]))
                    due += pop_every
                due = max(due, last // pop_every * pop_every + pop_every)
                if not over:
                    queue.push(kind, ident, relevance, list(domains), "log")
            yield pd.DataFrame(got, columns=COLUMNS)

    log = first.unionByName(ends)
    return log.repartition("run").sortWithinPartitions("run", "step", "over").mapInPandas(fold, POPPED)


class Entries:
    """A map state during one batch: an entry is read once, and those that changed are written at the end."""

    def __init__(self, state):
        self.state, self.rows, self.changed = state, {}, set()

    def __getitem__(self, key: tuple) -> tuple | None:
        if key not in self.rows:
            self.rows[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.rows[key]

    def __setitem__(self, key: tuple, value: tuple | None) -> None:
        self.rows[key] = value
        self.changed.add(key)

    def store(self) -> None:
        for key in self.changed:
            if self.rows[key] is None:
                self.state.removeKey(key)
            else:
                self.state.updateValue(key, self.rows[key])


class Heap:
    """A binary heap whose slots (from 1) are entries: a push or a pop touches as many as it has levels."""

    def __init__(self, slots: Entries, size: int):
        self.slots, self.size = slots, size

    def push(self, item: tuple) -> None:
        self.size += 1
        at = self.size
        while at > 1 and item < self.slots[(at // 2,)]:
            self.slots[(at,)] = self.slots[(at // 2,)]
            at //= 2
        self.slots[(at,)] = item

    def pop(self) -> tuple | None:
        if not self.size:
            return None
        best, item = self.slots[(1,)], self.slots[(self.size,)]
        self.slots[(self.size,)] = None
        self.size -= 1
        at = 1
        while (below := 2 * at) <= self.size:
            if below < self.size and self.slots[(below + 1,)] < self.slots[(below,)]:
                below += 1
            if item <= self.slots[(below,)]:
                break
            self.slots[(at,)] = self.slots[(below,)]
            at = below
        if self.size:
            self.slots[(at,)] = item
        return best


class RunFrontier(StatefulProcessor):
    """A run's frontier in state: one row of counts, and maps of known entries, of the heap and of domains.

    idle_ms: a run without pushes for so long ends, and its state is dropped; what comes later under
    its name is a new run.
    """

    def __init__(self, mode: str, pop_every: int = 1, idle_ms: int | None = None):
        self.mode, self.pop_every, self.idle_ms = mode, pop_every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "pushes long, known long, waiting long, domains long, ends long")
        self.known = handle.getMapState("known", "kind string, id string", "score double, domains array<string>")
        self.slots = handle.getMapState("slots", "slot long", "score double, seq long, kind string, id string")
        self.seen = handle.getMapState("seen", "domain string", "times long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pushes, n, waiting, distinct, ends = map(int, self.run.get()) if self.run.exists() else (0, 0, 0, 0, 0)
        known, seen = Entries(self.known), Entries(self.seen)
        heap = Heap(slots := Entries(self.slots), waiting)
        alpha, beta = WEIGHTS[self.mode]
        got = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            pushes += 1
            if known[(r.kind, r.id)] is None:
                names = [d.lower() for d in r.domains]
                novel = (sum(seen[(d,)] is None for d in names) / len(names) if distinct else 1.0) if names else 0.5
                score = round(alpha * float(r.relevance) + beta * novel, 4)
                known[(r.kind, r.id)] = (score, names)
                heap.push((-score, n, r.kind, r.id))
                n += 1
            if pushes % self.pop_every == 0 and (best := heap.pop()):
                score, names = known[best[2:]]
                for d in names:
                    times = seen[(d,)]
                    distinct += times is None
                    seen[(d,)] = (1 if times is None else times[0] + 1,)
                got.append((key[0], pushes, *best[2:], score))
        for entries in (known, slots, seen):
            entries.store()
        if self.idle_ms is not None:
            if ends:
                self.handle.deleteTimer(ends)
            ends = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(ends)
        self.run.update((pushes, n, heap.size, distinct, ends))
        yield pd.DataFrame(got, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.run, self.known, self.slots, self.seen):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream(pushes: DataFrame, mode: str, pop_every: int = 1, idle_ms: int | None = None) -> DataFrame:
    """The same as replay over a streaming DataFrame whose batches come in order of seq.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass. With idle_ms batches
    without data look for runs that ended, so such a query runs until it is stopped.
    """
    timed = "None" if idle_ms is None else "ProcessingTime"
    return _plain(pushes).groupBy("run").transformWithStateInPandas(RunFrontier(mode, pop_every, idle_ms), POPPED, "append", timed)
