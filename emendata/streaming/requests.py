"""Request queues by worker as a stateful stream: newer drafts supersede, replies may be stale, silence times out.

Each worker (a grouping key) holds at most MOST waiting fields in map state. A row is a draft of a field or a reply to a
request. Rows of a worker are handled in the order of their event time, and what fell due before a row is handled before
it, so that results don't hang on where micro-batches end; event-time timers flush what no later row would.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Waiting fields of one worker; seconds to the retry on the slow path, and to the end of a request.
MOST, RETRY_S, END_S = 32, 30, 90
OUT = "worker long, request long, outcome string, at_ms long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue(StatefulProcessor):
    """K2, K4, K5. Outcomes: superseded, busy, answered, failed, stale, retried, timed_out."""

    def __init__(self, retry_ms: int = RETRY_S * 1000, end_ms: int = END_S * 1000, most: int = MOST):
        self.retry_ms, self.end_ms, self.most = retry_ms, end_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "field long", "request long, at_ms long, retried boolean")

    def _read(self) -> dict[int, list]:
        return {k[0]: [v[0], v[1], v[2]] for k, v in self.waiting.iterator()}

    def _due(self, worker: int, held: dict[int, list], now: int) -> list[Row]:
        """What happens to waiting requests up to a moment, in its order."""
        out = []
        for field, (request, at, retried) in list(held.items()):
            if not retried and at + self.retry_ms <= now:
                out.append((at + self.retry_ms, request, "retried"))
                held[field][2] = True
            if at + self.end_ms <= now:
                out.append((at + self.end_ms, request, "timed_out"))
                del held[field]
        return [Row(worker=worker, request=r, outcome=o, at_ms=t) for t, r, o in sorted(out)]

    def _keep(self, before: dict[int, list], held: dict[int, list]) -> None:
        """State and the next timer: one at the earliest moment that something falls due."""
        for field in before.keys() - held.keys():
            self.waiting.removeKey((field,))
        for field, value in held.items():
            if before.get(field) != value:
                self.waiting.updateValue((field,), tuple(value))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        dues = [at + (self.end_ms if retried else self.retry_ms) for _, at, retried in held.values()]
        if dues:
            self.handle.registerTimer(min(dues))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        worker = key[0]
        before = self._read()
        held, out = {k: list(v) for k, v in before.items()}, []
        # plain tuples while they are sorted, a fraction of a Row's size
        held_rows = sorted(((r.at_ms, r.event, r.field, r.answers, r.good) for r in rows), key=lambda r: r[:2])
        for at_ms, event, field, answers, good in held_rows:
            out += self._due(worker, held, at_ms)
            tell = lambda request, outcome, at=at_ms: out.append(Row(worker=worker, request=request, outcome=outcome, at_ms=at))
            if answers is None:
                if field in held:
                    tell(held[field][0], "superseded")
                if field not in held and len(held) >= self.most:
                    tell(event, "busy")
                else:
                    held[field] = [event, at_ms, False]
            elif field in held and held[field][0] == answers:
                tell(answers, "answered" if good else "failed")
                del held[field]
            else:
                tell(answers, "stale")
        self._keep(before, held)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before = self._read()
        held = {k: list(v) for k, v in before.items()}
        out = self._due(key[0], held, timerValues.getCurrentWatermarkInMs())
        self._keep(before, held)
        yield from out

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, retry_s: int = RETRY_S, end_s: int = END_S, most: int = MOST, late: str = "0 seconds") -> DataFrame:
    """requests: worker, field, event, ts, answers (of a reply: the request it answers; null for a draft) and good, a stream. Needs the RocksDB state store (PROVIDER)."""
    register_pickle_by_value(sys.modules[__name__])  # the state's workers don't have the packages that executors get
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late)
    # one column of the key, so that a worker's rows meet; event time drives the timers
    return rows.groupBy("worker").transformWithState(Queue(retry_s * 1000, end_s * 1000, most), OUT, "append", "eventTime")
