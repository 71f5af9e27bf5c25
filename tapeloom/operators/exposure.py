"""Exposure schedules, among them those that look at the book's own drawdown under the exposure they set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.fold import Machine, fold, schema_of

#: The schedules by the volatility index's mean and change over 21 bars and by the market's drawdown.
LOW, TRAIL = 0.5, -0.10


def schedules(mean: Column, change: Column, drawdown: Column) -> dict[str, tuple[Column, bool]]:
    """Schedule -> (exposure by the market alone, whether the book's own drawdown under TRAIL lowers it too)."""
    low = lambda test: F.when(test, LOW).otherwise(1.0)
    gradient = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1.0 - (mean - 20) / 15.0 * 0.70))
    return {
        "baseline": (F.lit(1.0), False), "vix25": (low(mean > 25), False), "vix30": (low(mean > 30), False), "gradient": (gradient, False), "spike": (low(change > 0.40), False),
        "market_dd5": (low(drawdown < -0.05), False), "market_dd10": (low(drawdown < -0.10), False), "port_trail10": (F.lit(1.0), True), "combo": (low(drawdown < -0.08), True),
    }


class Levered(Machine):
    """One book: its equity and peak decide the next exposure; costs go by the change of the levered target weights."""

    def __init__(self, limit: float, low: float, fee: float):
        self.limit, self.low, self.fee = limit, low, fee
        self.equity = self.peak = 1.0
        self.before: dict[str, float] = {}

    def step(self, row: dict) -> list[dict]:
        self.peak = max(self.peak, self.equity)
        fall = (self.equity - self.peak) / self.peak
        exposure = self.low if row["watch"] and fall < self.limit else row["base"]
        now = {w["symbol"]: w["weight"] * exposure for w in row["weights"] or ()}
        turnover = sum(abs(now.get(s, 0.0) - self.before.get(s, 0.0)) for s in sorted({*now, *self.before}))
        net = row["ret"] * exposure - self.fee * turnover
        self.before = now
        self.equity *= 1 + net
        return [{"ts": row["ts"], "exposure": exposure, "turnover": turnover, "net": net, "equity": self.equity, "drawdown": fall}]


def run(rows: DataFrame, by: list[str], *, limit: float = TRAIL, low: float = LOW, fee: float = 0.0) -> DataFrame:
    """(by, ts, exposure, turnover, net, equity, drawdown) of rows (by, ts, ret, base, watch, weights) in order of ts.

    drawdown is the one before the row's exposure is set; weights is an array of (symbol, weight), or null without costs.
    """
    schema = schema_of(rows, [*by, "ts"], "exposure double, turnover double, net double, equity double, drawdown double")
    return fold(rows, by, ["ts"], lambda: Levered(limit, low, fee), schema)
