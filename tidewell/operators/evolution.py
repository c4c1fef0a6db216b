"""The evolution loop: feedback events move parameters, changes are emitted as versions, and later requests use the version of
their time.

The engine is a fold in the order of events. `ticks` streams it through sorted partitions, `ticks_stream` keeps it as the state
of a streaming query; both call `advance` and give a row only where a parameter changed. `as_of` joins requests with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.folds import fold_in_order
from ..functions.packaging import ship
from . import learning as L

#: The signal that each kind of event is. Fixed values.
SIGNALS = {"prefetch_hit": "prefetch_hit", "prefetch_waste": "prefetch_waste", "slice_reject": "inject_pollution"}
#: Parameters before any change, and the step and bounds of the prefetcher's confidence. Fixed values.
TAU, CONF, CONF_STEP, CONF_LOW, CONF_HIGH = 0.55, 0.5, 0.05, 0.05, 0.95
FIELDS = ("epoch", "hit", "pollution", "prefetch_hit", "prefetch_waste", "tau", "conf", "frozen", "version")


def new_state() -> dict:
    return dict(zip(FIELDS, (0, 0.0, 0.0, 0.0, 0.0, TAU, CONF, 0, 0), strict=True))


def advance(state: dict, signal: str | None) -> bool:
    """Take one signal of value 1, at the next epoch; whether a parameter changed. The averages of prefetch hits and waste pull at
    each other; parameters rest for FREEZE epochs after a change, and until MIN_SAMPLES signals and epoch FIRST."""
    if signal not in ("success", *SIGNALS.values()):
        return False
    a, s = L.ALPHA, state
    s["epoch"] += 1
    up = lambda name: a + (1 - a) * s[name]
    down = lambda name: (1 - a) * s[name]
    if signal == "success":
        s["hit"] = up("hit")
    elif signal == "inject_pollution":
        s["pollution"] = up("pollution")
    elif signal == "prefetch_hit":
        s["prefetch_hit"], s["prefetch_waste"] = up("prefetch_hit"), down("prefetch_waste")
    else:
        s["prefetch_waste"], s["prefetch_hit"] = up("prefetch_waste"), down("prefetch_hit")
    if s["epoch"] < max(L.MIN_SAMPLES, L.FIRST, s["frozen"]):
        return False
    tau, conf = s["tau"], s["conf"]
    if s["pollution"] >= L.POLLUTION_RISE:
        tau += L.STEP
    elif s["hit"] >= L.HIT_TARGET and s["pollution"] <= L.POLLUTION_LOW:
        tau -= L.STEP
    tau = min(max(tau, L.MIN_TAU), L.MAX_TAU)
    if s["prefetch_waste"] != s["prefetch_hit"]:
        conf += CONF_STEP if s["prefetch_waste"] > s["prefetch_hit"] else -CONF_STEP
    conf = min(max(conf, CONF_LOW), CONF_HIGH)
    if (tau, conf) == (s["tau"], s["conf"]):
        return False
    s.update(tau=tau, conf=conf, frozen=s["epoch"] + L.FREEZE, version=s["version"] + 1)
    return True


def _signal(kind: str):
    chain = F.when(F.lit(False), "")
    for k, s in SIGNALS.items():
        chain = chain.when(F.col(kind) == k, s)
    return chain


def ticks(events: DataFrame) -> DataFrame:
    """(key, seq, version, epoch, tau, conf) of each change. `events`: key, seq (unique in a key), kind; kinds without a signal are
    left out before anything is exchanged."""
    kinds = dict(events.dtypes)
    signals = events.select("key", "seq", _signal("kind").alias("signal")).filter("signal is not null")

    def step(state: dict, row: dict) -> tuple:
        changed = advance(state, row["signal"])
        return changed, state["version"], state["epoch"], state["tau"], state["conf"]

    schema = f"key {kinds['key']}, seq {kinds['seq']}, changed boolean, version long, epoch long, tau double, conf double"
    return fold_in_order(signals, "key", "seq", new_state, step, schema).filter("changed").drop("changed")


def as_of(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds version, tau and conf to `requests` (key, seq, ...): those of the last change before the request, the first
    parameters with version 0 where there is none."""
    params = F.struct("version", "tau", "conf")
    columns = requests.columns
    asked = requests.select(F.struct(*columns).alias("r"), "key", "seq", F.lit(1).alias("side"), F.lit(None).cast("struct<version:bigint,tau:double,conf:double>").alias("p"))
    known = changes.select(F.lit(None).cast(asked.schema["r"].dataType).alias("r"), "key", "seq", F.lit(2).alias("side"), params.alias("p"))
    order = Window.partitionBy("key").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = asked.unionByName(known).withColumn("p", F.last("p", ignorenulls=True).over(order)).filter("side = 1")
    first = {"version": F.lit(0).cast("long"), "tau": F.lit(TAU), "conf": F.lit(CONF)}
    return joined.select("r.*", *[F.coalesce(F.col(f"p.{c}"), v).alias(c) for c, v in first.items()])


class _Loop(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "epoch long, hit double, pollution double, prefetch_hit double, prefetch_waste double, tau double, conf double, frozen long, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = dict(zip(FIELDS, self.state.get(), strict=True)) if self.state.exists() else new_state()
        batch = pd.concat(list(rows)).sort_values("seq")
        out = [(key[0], seq, state["version"], state["epoch"], state["tau"], state["conf"]) for seq, signal in zip(batch["seq"], batch["signal"], strict=True) if advance(state, signal)]
        self.state.update(tuple(state[f] for f in FIELDS))
        yield pd.DataFrame(out, columns=["key", "seq", "version", "epoch", "tau", "conf"])

    def close(self) -> None:
        pass


def ticks_stream(events: DataFrame) -> DataFrame:
    """`ticks` over a stream that follows the order of seq from batch to batch. Needs the RocksDB state store."""
    ship(events.sparkSession)
    kinds = dict(events.dtypes)
    signals = events.select("key", "seq", _signal("kind").alias("signal")).filter("signal is not null")
    return signals.groupBy("key").transformWithStateInPandas(_Loop(), f"key {kinds['key']}, seq {kinds['seq']}, version long, epoch long, tau double, conf double", "append", "none")
