"""The online prefetcher: transition counts, feedback and plans that change with every step of a session.

A step is judged, then learned, then followed by a plan: tools that the last plan proposed are hits if this step called them
and waste if not; the transition from the step before is counted; and the likeliest read-only successors of this step are
proposed. Plans feed on the feedback to earlier plans, so a session is a fold in order: `online_plans` streams it through
sorted partitions, `online_plans_stream` keeps it as state of a streaming query. Both call `advance`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.folds import fold_in_order
from ..functions.packaging import ship
from ..functions.numeric import beta_mean, wilson_low


@dataclass(frozen=True)
class Settings:
    """The prefetcher's knobs. Fixed values."""

    top_k: int = 3
    min_conf: float = 0.5
    max_cost: int = 2000
    base_cost: int = 512
    waste_hit_limit: float = 3.0
    decay: float = 0.2
    epsilon: float = 0.0
    probation_interval: int = 10


def new_state() -> dict:
    """What a session knows: counts of transitions, read-only tools, weights of hits and waste, plans made and proposed."""
    return {"last": None, "counts": {}, "read_only": {}, "hits": {}, "waste": {}, "plans": {}, "proposed": []}


def _demoted(state: dict, tool: str, s: Settings) -> bool:
    h, w = state["hits"].get(tool, 0.0), state["waste"].get(tool, 0.0)
    return h + w > 0 and (h + 1) / (h + w + 2) < 1 / (1 + s.waste_hit_limit)


def plan(state: dict, last: str, draw: float, s: Settings) -> list[tuple[str, str]]:
    """(tool, channel) to fetch after `last`. Channels: ``likely`` ones by probability, then name; a demoted one on
    ``probation`` in every probation_interval-th plan after `last`, in turn; or, if there is neither, the best below min_conf
    as a ``probe`` where `draw` is under epsilon."""
    after = state["counts"].get(last, {})
    if not after:
        return []
    state["plans"][last] = state["plans"].get(last, 0) + 1
    total = sum(after.values())
    ranked = sorted((-n / total, tool) for tool, n in after.items() if state["read_only"].get(tool))
    good = [(p, t) for p, t in ranked if not _demoted(state, t, s)]
    bad = [t for _, t in ranked if _demoted(state, t, s)]
    likely = [t for p, t in good if -p >= s.min_conf]
    rest = [t for p, t in good if -p < s.min_conf]
    turn = state["plans"][last]
    on_probation = bad and s.probation_interval > 0 and turn % s.probation_interval == 0
    room = s.max_cost // s.base_cost
    out = [(t, "likely") for t in likely[: min(s.top_k - bool(on_probation), room)]]
    if on_probation and len(out) < room:
        out.append((bad[(turn // s.probation_interval - 1) % len(bad)], "probation"))
    if not out and rest and room and draw < s.epsilon:
        out = [(rest[0], "probe")]
    return out


def advance(state: dict, tool: str | None, read_only: bool | None, draw: float, s: Settings) -> tuple:
    """Take one step; returns what a row of `online_plans` holds. A step without a tool changes nothing and has no plan."""
    if not tool:
        return [], [], False, False, 0, 0
    before, proposed, called = state["last"], state["proposed"], bool(read_only)
    hits = proposed.count(tool)
    for p in proposed:
        hit = p == tool
        state["hits"][p] = (1 - s.decay) * state["hits"].get(p, 0.0) + hit
        state["waste"][p] = (1 - s.decay) * state["waste"].get(p, 0.0) + (not hit)
    follows = before is not None
    if follows:
        after = state["counts"].setdefault(before, {})
        after[tool] = after.get(tool, 0) + 1
        if called:
            state["read_only"][tool] = True
    tasks = plan(state, tool, draw, s)
    state["last"], state["proposed"] = tool, [t for t, _ in tasks]
    return state["proposed"], [c for _, c in tasks], follows and called, follows and called and hits > 0, hits, len(proposed) - hits


COLUMNS = "targets array<string>, channels array<string>, read_only_call boolean, covered boolean, hits long, wastes long"


def draw(*columns: str) -> Column:
    """A number from 0 to 1 that follows from the columns alone, for the probe."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def online_plans(steps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per step (session, seq, name, read_only): the plan that follows it, whether it is a read-only call that the plan before it
    covered, and that plan's hits and wastes. Steps with equal seq are taken by name."""
    rows = steps.select("session", F.struct("seq", "name").alias("at"), "name", "read_only", draw("session", "seq").alias("draw"))
    step = lambda state, r: advance(state, r["name"], r["read_only"], r["draw"], settings)
    kinds = dict(steps.dtypes)
    folded = fold_in_order(rows, "session", "at", new_state, step, f"session {kinds['session']}, at struct<seq:{kinds['seq']},name:string>, {COLUMNS}")
    return folded.select("session", "at.seq", "at.name", *[c.split()[0] for c in COLUMNS.split(", ")])


def summary(plans: DataFrame) -> DataFrame:
    """Per session: read-only calls and how many were covered, hits and wastes of what was proposed, as shares and with a lower
    bound. `plans`: as `online_plans` gives them."""
    sums = plans.groupBy("session").agg(F.count_if("read_only_call").alias("calls"), F.count_if("covered").alias("covered"), F.sum("hits").alias("hits"), F.sum("wastes").alias("wastes"))
    judged = F.col("hits") + F.col("wastes")
    low = wilson_low(beta_mean(F.col("hits"), F.col("wastes")), judged)
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return sums.select("*", share(F.col("covered"), F.col("calls")).alias("coverage"), share(F.col("hits"), judged).alias("accuracy"), F.when(judged > 0, F.round(low, 6)).otherwise(0.0).alias("low"))


class _Session(StatefulProcessor):
    """A session's knowledge as state: transitions, tools and plans as maps, the last step and its proposal as a value."""

    def __init__(self, settings: Settings, session_type: str, seq_type: str):
        self.settings, self.session_type, self.seq_type = settings, session_type, seq_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "last string, tool string", "n long")
        self.tools = handle.getMapState("tools", "tool string", "read_only boolean, hits double, waste double")
        self.plans = handle.getMapState("plans", "last string", "n long")
        self.now = handle.getValueState("now", "last string, proposed array<string>")

    def _load(self) -> dict:
        state = new_state()
        if self.now.exists():
            last, proposed = self.now.get()
            state["last"], state["proposed"] = last, list(proposed or [])
        for (last, tool), (n,) in self.counts.iterator():
            state["counts"].setdefault(last, {})[tool] = n
        for (tool,), (read_only, hits, waste) in self.tools.iterator():
            state["read_only"][tool], state["hits"][tool], state["waste"][tool] = read_only, hits, waste
        state["plans"] = {last: n for (last,), (n,) in self.plans.iterator()}
        return state

    def _save(self, state: dict, touched: set[str]) -> None:
        for last in touched:
            for tool, n in state["counts"].get(last, {}).items():
                self.counts.updateValue((last, tool), (n,))
            if last in state["plans"]:
                self.plans.updateValue((last,), (state["plans"][last],))
        for tool in {*state["read_only"], *state["hits"]}:
            self.tools.updateValue((tool,), (bool(state["read_only"].get(tool)), float(state["hits"].get(tool, 0.0)), float(state["waste"].get(tool, 0.0))))
        self.now.update((state["last"], state["proposed"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = pd.concat(list(rows)).sort_values(["seq", "name"])
        touched, out = {state["last"]} if state["last"] else set(), []
        for seq, name, read_only, d in zip(batch["seq"], batch["name"], batch["read_only"], batch["draw"], strict=True):
            out.append((key[0], seq, name, *advance(state, name, read_only, d, self.settings)))
            touched.add(name)
        self._save(state, touched - {None})
        yield pd.DataFrame(out, columns=["session", "seq", "name", *[c.split()[0] for c in COLUMNS.split(", ")]])

    def close(self) -> None:
        pass


def online_plans_stream(steps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`online_plans` over a stream: a session's steps of one micro-batch are sorted, and batches must follow the sessions' order.
    Needs the RocksDB state store; a session's state grows with its distinct transitions."""
    ship(steps.sparkSession)
    kinds = dict(steps.dtypes)
    rows = steps.select("session", "seq", "name", "read_only", draw("session", "seq").alias("draw"))
    processor = _Session(settings, kinds["session"], kinds["seq"])
    return rows.groupBy("session").transformWithStateInPandas(processor, f"session {kinds['session']}, seq {kinds['seq']}, name string, {COLUMNS}", "append", "none")
