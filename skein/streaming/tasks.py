"""Tasks on a stream: leases that run out, failures that are retried after a while, tasks that are given up. State and timers are Spark's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; set it on the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LEASE_MS, BASE_MS, LONGEST_MS, TRIES = 30 * 60_000, 5 * 60_000, 24 * 3_600_000, 6
OUT = "task long, at_ms long, step string, failures int"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def wait_ms(failures: int) -> int:
    """How long to wait after so many failures: twice as long each time, a day at most."""
    return min(LONGEST_MS, BASE_MS << (min(failures, 20) - 1))


class Machine(StatefulProcessor):
    """A task's rows (at_ms, kind) in the order of time, and a timer for what comes next by itself.

    Rows wait in state until the watermark has passed them, so that they are taken in the order of their times however
    they arrive; rows later than the watermark were dropped before. A claimed task goes back when its lease is over, a
    failed one after a wait, each unless another row of the task comes first; TRIES failures in a row end it. A task
    needs a timer for the first thing that waits only: when it expires, all that the watermark has passed is done at
    once, and the next timer is set.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, kind string")
        self.now = handle.getValueState("now", "failures int, due long, step string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self.waiting.appendList(list(zip(batch["at_ms"].tolist(), batch["kind"].tolist(), strict=True)))
                self.handle.registerTimer(int(batch["at_ms"].min()))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        failures, due, step = self.now.get() if self.now.exists() else (0, None, None)
        if (not rows or rows[0][0] > until) and (due is None or due > until):
            return  # an earlier timer of this batch has seen to it
        out = []

        def rung(before: int | None) -> None:
            nonlocal due, step
            if due is not None and due <= until and (before is None or due <= before):
                out.append((key[0], due, step, failures))
                due = step = None

        for at, kind in rows:
            if at > until:
                break
            rung(at)
            due = step = None
            if kind == "claimed":
                due, step = at + LEASE_MS, "lease over"
            elif kind == "failed":
                failures += 1
                if failures >= TRIES:
                    out.append((key[0], at, "given up", failures))
                    failures = 0
                else:
                    due, step = at + wait_ms(failures), "again"
            elif kind == "done":
                failures = 0
        rung(None)
        left = [r for r in rows if r[0] > until]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.now.update((failures, due, step))
        following = [t for t in (due, left[0][0] if left else None) if t is not None]
        if following:
            self.handle.registerTimer(min(following))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def steps(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """(task, at_ms, step, failures) of a stream of rows(task, ts, kind): `lease over`, `again` and `given up`."""
    timed = rows.where("task is not null and ts is not null").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("task").transformWithStateInPandas(statefulProcessor=Machine(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
