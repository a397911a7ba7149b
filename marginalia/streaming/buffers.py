"""Asynchronous aggregation as a stream: buffers of finished trainings with state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "cohort int, version bigint, events array<bigint>, weight double, v double"


def fed_buffer(stream: DataFrame, size: int, flush: bool = False) -> DataFrame:
    """Steps of a buffered aggregator, per cohort: every ``size`` finished trainings (event_id, cohort,
    end_time, weight, v) make one, their weighted mean. Trainings are taken in the order of end_time,
    then event_id, within a batch; the state between batches is the open buffer and the version, so it
    doesn't grow with the stream. With ``flush`` a batch's rest makes a step of its own, as at the end of
    an epoch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, weights, values = state.get if state.exists else (0, [], [], [])
        ids, weights, values, out = list(ids), list(weights), list(values), []

        def close(n: int) -> None:
            nonlocal version
            total = sum(weights[:n])
            mean = sum(w * v for w, v in zip(weights[:n], values[:n])) / total if total > 0 else 0.0
            out.append((key[0], version, ids[:n], total, mean))
            version += 1
            del ids[:n], weights[:n], values[:n]

        rows = pd.concat(list(parts)).sort_values(["end_time", "event_id"])
        for event_id, weight, value in zip(rows["event_id"], rows["weight"], rows["v"]):
            ids.append(int(event_id))
            weights.append(float(weight))
            values.append(float(value))
            if len(ids) == size:
                close(size)
        if flush and ids:
            close(len(ids))
        state.update((version, ids, weights, values))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    kept = "version bigint, ids array<bigint>, weights array<double>, vals array<double>"
    rows = stream.select("event_id", "cohort", "end_time", "weight", "v")
    return rows.groupBy("cohort").applyInPandasWithState(step, STEPS, kept, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window of event time; events later than
    ``late`` are dropped, and their windows' state with them."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
