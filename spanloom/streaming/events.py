"""Streaming forms: the event log, breaks as they arrive, runs with state, and replay without repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom import constants as C

EVENT = "ts timestamp, run string, event string, episode string, elapsed_sec double, cost double, wall double"


def tail_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON lines of an append-only log as a stream."""
    return spark.readStream.schema(schema).json(path)


def run_costs(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Cost and wall time of each run by window, late events up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "run").agg(F.count(F.lit(1)).alias("events"), F.sum("cost").alias("cost"), F.sum("wall").alias("wall"))


def stream_breaks(creatives: DataFrame, gap_ms: int = C.BREAK_GAP_MS, late: str = "10 minutes") -> DataFrame:
    """Breaks of creatives (episode, ts, duration_ms, slot): sessions whose gap is each creative's length and the break
    gap."""
    gap = F.concat((F.col("duration_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    out = creatives.withWatermark("ts", late).groupBy("episode", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("creatives"), F.array_sort(F.collect_set("slot")).alias("slots"), F.max(F.expr("timestampadd(MILLISECOND, duration_ms, ts)")).alias("end"))
    return out.select("episode", F.col("session_window.start").alias("start"), "end", "creatives", "slots")


def stream_runs(flags: DataFrame) -> DataFrame:
    """Closed runs of equal flags (episode, idx, flag) as the segments of an episode arrive in order; the open run is the
    episode's state, and a row with a null flag (the end of the episode) closes it."""
    out = "episode string, flag string, first_idx int, last_idx int"

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        closed = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for idx, flag in zip(rows.idx.tolist(), rows.flag.tolist(), strict=True):
            if run and run[0] == flag and idx == run[2] + 1:
                run[2] = idx
            elif not run or idx > run[2]:
                if run:
                    closed.append((key[0], *run))
                run = None if flag is None else [flag, idx, idx]
        if run:
            state.update(tuple(run))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=["episode", "flag", "first_idx", "last_idx"])

    return flags.groupBy("episode").applyInPandasWithState(step, out, "flag string, first_idx int, last_idx int", "append", GroupStateTimeout.NoTimeout)


def once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests (key, ts) without repeats of a key within ``late``: a resumed run calls nothing twice."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
