"""A sliding-log rate limiter: a call is accepted if fewer than `most` accepted ones lie within the window before it.

Rejected calls aren't logged, so verdicts depend on verdicts: no window function expresses it. Calls are gone through in
order for each principal. In batches, a principal's calls come to its task sorted by Spark and stream through it; in a
stream, state holds the accepted stamps within the window (at most `most`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def limit(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """calls (principal, ts, event_id) with `accepted`. Rows are dealt by principal and sorted; a task keeps the log of one
    principal at a time, so a principal of any number of calls needs no more memory."""

    def run(batches):
        who, log = None, deque()
        for b in batches:
            ok = []
            for p, us in zip(b.column("principal").to_pylist(), b.column("us").to_pylist(), strict=True):
                if p != who:
                    who, log = p, deque()
                while log and log[0] <= us - seconds * 1_000_000:
                    log.popleft()
                ok.append(len(log) < most)
                if ok[-1]:
                    log.append(us)
            yield pa.RecordBatch.from_arrays([b.column("principal"), b.column("ts"), b.column("event_id"), pa.array(ok)], ["principal", "ts", "event_id", "accepted"])

    c = calls.select("principal", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    dealt = c.repartition("principal").sortWithinPartitions("principal", "us", "event_id")
    kinds = {x: c.schema[x].dataType.simpleString() for x in ("principal", "ts", "event_id")}
    return dealt.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", accepted boolean")


def limit_stream(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """The same over a stream of (principal, ts, event_id), with a watermark on ts; within a batch calls are taken by ts."""
    out = StructType.fromDDL("principal string, ts timestamp, event_id bigint, accepted boolean")
    kept = StructType.fromDDL("log array<bigint>")

    def run(key, frames: Iterator[pd.DataFrame], state):
        log = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ok = []
        for ts in new["ts"]:
            us = int(ts.value // 1000)
            log = [x for x in log if x > us - seconds * 1_000_000]
            ok.append(len(log) < most)
            if ok[-1]:
                log.append(us)
        state.update((log,))
        yield new.assign(accepted=ok)[["principal", "ts", "event_id", "accepted"]]

    return calls.groupBy("principal").applyInPandasWithState(run, out, kept, "append", "NoTimeout")
