"""The stopping controller of adaptive runs over their trace, as a batch and as a stateful stream.

A run stops at its budget or highest order, or where every metric that has a rule meets
it twice in a row.  That needs a row and the two before it, so a run's state is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haruspex.operators.tracks import blocked

METRICS = ("r2", "mse", "qoi")
CONTINUES, MET, BUDGET, ORDER, LATE, IDLE = "continues", "met", "budget", "order", "late", "idle"


@dataclass(frozen=True)
class Rules:
    """Bounds of a run; ``None`` leaves a rule out.  Metrics without a rule may be null."""

    budget: int
    max_order: int
    min_r2: float | None = None
    abs_mse: float | None = None
    rel_mse: float | None = None
    qoi_below: float | None = None
    abs_qoi: float | None = None
    rel_qoi: float | None = None

    def open(self, now: dict, back: list[dict]) -> bool:
        """Whether any rule isn't met by a row and the rows before it, latest first; what can't be told yet isn't."""
        known = [now, *back]

        def pairs(metric: str, count: int) -> list[float] | None:
            values = [r[metric] for r in known[:count]]
            return None if len(values) < count or any(v is None or v != v for v in values) else values

        def moved(metric: str, bound: float, relative: bool) -> bool:
            v = pairs(metric, 3)
            return v is None or any(not abs(a - b) <= bound * (abs(b) if relative else 1.0) or (relative and b == 0) for a, b in zip(v, v[1:]))

        def beyond(metric: str, count: int, bad) -> bool:
            v = pairs(metric, count)
            return v is None or any(map(bad, v))

        return any((
            self.min_r2 is not None and beyond("r2", 2, lambda x: x < self.min_r2),
            self.abs_mse is not None and beyond("mse", 2, lambda x: x > self.abs_mse),
            self.rel_mse is not None and moved("mse", self.rel_mse, True),
            self.qoi_below is not None and beyond("qoi", 1, lambda x: x > self.qoi_below),
            self.abs_qoi is not None and moved("qoi", self.abs_qoi, False),
            self.rel_qoi is not None and moved("qoi", self.rel_qoi, True),
        ))

    def verdict(self, now: dict, back: list[dict]) -> str:
        if now["calls"] >= self.budget:
            return BUDGET
        if now["order"] > self.max_order:
            return ORDER
        return CONTINUES if self.open(now, back) else MET


def judged(trace: DataFrame, rules: Rules) -> DataFrame:
    """``trace`` (``run, step, calls, order, r2, mse, qoi``) with the ``verdict`` on each row, by expressions over blocks of rows.

    A run of any length is cut into blocks; steps of a run are distinct.
    """
    near = W.partitionBy("__block", "run").orderBy("__rank")
    rows = blocked(trace, ["run"], ["step"], 2, 0)
    rows = rows.withColumns({f"__{m}{k}": F.lag(m, k).over(near) for m in METRICS for k in (1, 2)}).where("__own")
    at = lambda m, k: F.when(~F.isnan(F.col(f"__{m}{k}" if k else m)), F.col(f"__{m}{k}" if k else m))

    def beyond(metric: str, count: int, bad) -> Column:
        out = F.lit(False)
        for k in range(count):
            out = out | F.coalesce(bad(at(metric, k)), F.lit(True))
        return out

    def moved(metric: str, bound: float, relative: bool) -> Column:
        out = F.lit(False)
        for k in range(2):
            a, b = at(metric, k), at(metric, k + 1)
            out = out | F.coalesce((F.abs(a - b) > bound * (F.abs(b) if relative else F.lit(1.0))) | ((b == 0) & F.lit(relative)), F.lit(True))
        return out

    r = rules
    tests = [
        r.min_r2 is not None and beyond("r2", 2, lambda x: x < r.min_r2), r.abs_mse is not None and beyond("mse", 2, lambda x: x > r.abs_mse), r.rel_mse is not None and moved("mse", r.rel_mse, True),
        r.qoi_below is not None and beyond("qoi", 1, lambda x: x > r.qoi_below), r.abs_qoi is not None and moved("qoi", r.abs_qoi, False), r.rel_qoi is not None and moved("qoi", r.rel_qoi, True),
    ]
    open_ = F.lit(False)
    for t in tests:
        open_ = open_ if t is False else open_ | t
    verdict = F.when(F.col("calls") >= r.budget, BUDGET).when(F.col("order") > r.max_order, ORDER).when(open_, CONTINUES).otherwise(MET)
    return rows.withColumn("verdict", verdict).select(*trace.columns, "verdict")


STATE = "step long, at timestamp, r2_1 double, mse_1 double, qoi_1 double, r2_2 double, mse_2 double, qoi_2 double, seen int"


def watched(trace: DataFrame, rules: Rules, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``run, step, verdict`` of a stream of a trace's rows, which also has the event time ``ts``.

    Rows of a run come in the order of steps, in one batch in any order; a row behind the run's
    last step is judged ``late`` and changes nothing.  A run whose last row lies ``idle_ms`` behind the watermark
    ends with a row ``idle`` and is forgotten.  The state of a run is its last two rows' metrics;
    it is kept in the query's checkpoint, so a query started again goes on with it.
    """
    kind = trace.schema["run"].dataType
    out = T.StructType([T.StructField("run", kind), T.StructField("step", T.LongType()), T.StructField("verdict", T.StringType())])

    def rows_of(state: tuple | None) -> list[dict]:
        if state is None:
            return []
        return [dict(zip(METRICS, state[2 + 3 * k : 5 + 3 * k])) for k in range(state[8])]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "step": [last[0]], "verdict": [IDLE]})
            return
        held = state.get if state.exists else None
        back, last, at = rows_of(held), held[0] if held else None, held[1] if held else None
        made = []
        for r in pd.concat(list(frames)).sort_values("step").itertuples(index=False):
            now = {m: None if pd.isna(getattr(r, m)) else float(getattr(r, m)) for m in METRICS} | {"calls": r.calls, "order": r.order}
            if last is not None and r.step <= last:
                made.append((r.step, LATE))
                continue
            made.append((r.step, rules.verdict(now, back)))
            back, last = [now, *back][:2], int(r.step)
            at = r.ts if at is None else max(at, r.ts)
        padded = [*back, *[dict.fromkeys(METRICS)] * (2 - len(back))]
        state.update((last, pd.Timestamp(at).to_pydatetime(), *[x[m] for x in padded for m in METRICS], len(back)))
        due = int(pd.Timestamp(at).timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]] * len(made), "step": [s for s, _ in made], "verdict": [v for _, v in made]})

    picked = trace.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("run", F.col("step").cast("long").alias("step"), "calls", "order", *METRICS, "ts")
    return picked.groupBy("run").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
