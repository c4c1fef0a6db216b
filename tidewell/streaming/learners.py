"""The stateful learners and rollups as Structured Streaming, with the same results as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.packaging import ship
from ..operators.learning import fold

_STATE = "n long, epoch long, hit double, pol double, tau double, frozen long, changes long"


def evolve_stream(signals: DataFrame, tau: float = 0.55) -> DataFrame:
    """The threshold engine over a stream of (key, seq, epoch, name, value): a row per key and micro-batch, with its state.

    Rows of a key are ordered by seq within a micro-batch; state is kept per key, so memory grows with keys alone.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0, 0.0, 0.0, tau, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        now = fold(now, list(zip(rows["epoch"], rows["name"], rows["value"], strict=True)))
        now = (int(now[0]), int(now[1]), float(now[2]), float(now[3]), float(now[4]), int(now[5]), int(now[6]))
        state.update(now)
        yield pd.DataFrame({"key": [key[0]], "samples": [now[0]], "hit_ewma": [now[2]], "pollution_ewma": [now[3]], "tau": [now[4]], "adjustments": [now[6]]})

    ship(signals.sparkSession)
    kind = dict(signals.dtypes)["key"]
    return signals.groupBy("key").applyInPandasWithState(run, f"key {kind}, samples long, hit_ewma double, pollution_ewma double, tau double, adjustments long", _STATE, "update", GroupStateTimeout.NoTimeout)


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calendar-day sums of a stream (ts, source, model, total), final once the watermark has passed."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "source", "model")
    return windowed.agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("requests")).select(F.to_date("window.start").alias("day"), "source", "model", "total", "requests")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream (ts, user): windows that a gap ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user").agg(F.count(F.lit(1)).alias("n")).select("user", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
