"""Rules over a stream whose events come in any order, with state that ends by time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rules import Rule, fold, lapsed

OUT = "key string, sub string, id long, at double, output string"
#: Groups of keys that share a call, a list of waiting events and a timer.
BUCKETS = 2048
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Folds the events of keys, some to a bucket, by a rule, once the watermark says that nothing earlier will come.

    Events wait in list state until the watermark reaches them and are then taken in
    the order of (at, id), whatever the triggers or files they came with.  What the
    rule remembers is map state by key and ``sub``, so one owner's questions are told apart.
    Calls, state lists and timers are a bucket's, since each costs as much as many events.
    One event-time timer a bucket stands at the first moment that matters: its earliest
    waiting event, or the first state to lapse.  It fires without any further event,
    reports what has lapsed and drops it, so state does not outlive its use.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, sub string, id long, at double, kind string")
        self.live = handle.getMapState("live", "key string, sub string", "state string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            events = list(zip(part["key"], part["sub"], map(int, part["id"]), map(float, part["at"]), part["kind"], strict=True))
            self.waiting.appendList(events)
            first = min([e[3] for e in events] + ([] if first is None else [first]))
        if first is not None:
            self._wake(-int(-first * 1000 // 1))
        return iter(())

    def _wake(self, at: int) -> None:
        """Have the timer at this millisecond, or earlier if it is."""
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or at < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() / 1000
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: (e[3], e[2]))
        ripe = [e for e in events if e[3] <= now]
        rest = events[len(ripe) :]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        held = {tuple(name): json.loads(text) for name, (text,) in self.live.iterator()} if self.live.exists() else {}
        before, out = dict(held), []
        for own, sub, i, at, kind in ripe:
            state, said = fold(self.rule, held.pop((own, sub), None), {"id": i, "at": at, "kind": kind})
            out += [(own, sub, *x) for x in said]
            if state is not None:
                held[own, sub] = state
        for name in [s for s, state in held.items() if self.rule.due(state) < now]:
            out += [(*name, *x) for x in lapsed(self.rule, held.pop(name))]
        for name in before.keys() - held.keys():
            self.live.removeKey(name)
        for name, state in held.items():
            if before.get(name) != state:
                self.live.updateValue(name, (json.dumps(state),))
        # A state lapses behind its last moment, an event is ripe at its own.
        wakes = [int(self.rule.due(s) * 1000 // 1) + 1 for s in held.values()] + [-int(-e[3] * 1000 // 1) for e in rest[:1]]
        if wakes:
            self._wake(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=["key", "sub", "id", "at", "output"]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def stateful(events: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """A rule over the stream (key, sub, id, ts, kind): (key, sub, id, at, output), ``id`` null for what time alone has ended.

    An event has its output once the watermark, ``late`` behind the newest event,
    has reached it; an event that is behind the watermark when it comes is dropped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = events.select("key", "sub", "id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "kind").where("key IS NOT NULL AND sub IS NOT NULL AND ts IS NOT NULL")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(InOrder(rule), OUT, "Append", "EventTime")


def replayed(events: DataFrame, rule: Rule, until: float | None = None) -> DataFrame:
    """Batch twin of ``stateful``: every key's events in order, up to the moment ``until``, streamed through a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        end = float("inf") if until is None else until

        def left() -> list[tuple]:
            return [(*now, *x) for x in lapsed(rule, state)] if state is not None and until is not None and rule.due(state) < end else []

        for rows in batches:
            out = []
            for key, sub, i, at, kind in zip(rows["key"], rows["sub"], rows["id"], rows["at"], rows["kind"], strict=True):
                if (key, sub) != now:
                    out += left()
                    now, state = (key, sub), None
                state, said = fold(rule, state, {"id": int(i), "at": float(at), "kind": kind})
                out += [(key, sub, *x) for x in said]
            yield pd.DataFrame(out, columns=["key", "sub", "id", "at", "output"]).astype({"id": "Int64"})
        yield pd.DataFrame(left(), columns=["key", "sub", "id", "at", "output"]).astype({"id": "Int64"})

    rows = events.select("key", "sub", "id", (F.unix_micros("ts") / 1e6).alias("at"), "kind").where("key IS NOT NULL AND sub IS NOT NULL AND at IS NOT NULL")
    rows = rows if until is None else rows.where(F.col("at") <= until)
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "at", "id").mapInPandas(run, OUT)
