"""Order blocks: the last opposite candle before a strong break, its strength, and what later bars do to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import features as f
from tapeloom.operators import gaps
from tapeloom.operators.fold import Machine, fold, schema_of

#: What adds to a block's strength.
STRENGTH = {"strong": 0.30, "gap": 0.25, "volume": 0.20, "clean": 0.15, "swing": 0.10}
LEAST = 0.40


class Extremes(Machine):
    """Closes beyond the furthest swing confirmed since the last such close, on either side, with the smoothed true range."""

    def __init__(self, period: int = 14):
        self.high = self.low = self.atr = None
        self.period, self.warm = period, []

    def step(self, row: dict) -> list[dict]:
        out = []
        if self.atr is not None:
            self.atr += (row["tr"] - self.atr) / self.period
        else:
            self.warm.append(row["tr"])
            if len(self.warm) == self.period:
                self.atr = sum(self.warm) / self.period
        if row["up"] is not None:
            self.high = row["up"] if self.high is None else max(self.high, row["up"])
        if row["down"] is not None:
            self.low = row["down"] if self.low is None else min(self.low, row["down"])
        if self.atr is not None:
            if self.high is not None and row["close"] > self.high:
                out.append({"n": row["n"], "direction": "bullish", "broken": self.high, "atr": self.atr})
                self.high = None
            if self.low is not None and row["close"] < self.low:
                out.append({"n": row["n"], "direction": "bearish", "broken": self.low, "atr": self.atr})
                self.low = None
        return out


def marked(bars: DataFrame, *, side: int = 2, lookback: int = 10, mean_bars: int = 14) -> DataFrame:
    """bars with n, tr, the swings that a bar confirms (up, down) and, for a break at the bar, its candle, gap and swing on either side."""
    b = f.true_range(f.pivots(bars, side, side, strict=False)).withColumn("n", F.row_number().over(f.series()))
    gap = lambda c: F.last(F.when(c, F.col("n")), ignorenulls=True).over(f.last(lookback + 1))
    swing, known = F.col("pivot_high") | F.col("pivot_low"), lambda c, mark: f.lag(F.when(F.col(mark), F.col(c)), side)
    b = b.withColumns({"up": known("high", "pivot_high"), "down": known("low", "pivot_low"), "__mean": F.avg("volume").over(f.last(mean_bars, 1))})
    candle = F.struct("n", "ts", "open", "high", "low", "close", (F.col("volume") > F.col("__mean")).alias("heavy"), swing.alias("swing"))
    opposite = lambda c: F.last(F.when(c, candle), ignorenulls=True).over(f.last(lookback, 1))
    upto = f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumns({
        "__bear": opposite(F.col("close") < F.col("open")), "__bull": opposite(F.col("close") > F.col("open")),
        "__up": gap(F.col("low") > f.lag("high", 2)), "__down": gap(F.col("high") < f.lag("low", 2)),
        "__low": F.last("down", ignorenulls=True).over(upto), "__high": F.last("up", ignorenulls=True).over(upto),
    }).drop("pivot_high", "pivot_low", "confirmed_ts", "__mean")


def detect(bars: DataFrame, *, side: int = 2, lookback: int = 10, atr_mult: float = 1.0, body_ratio: float = 0.5, body_only: bool = True, least: float = LEAST, need_gap: bool = False, mean_bars: int = 14) -> DataFrame:
    """(symbol, ts, n, direction, bottom, top, extreme, block_ts, block_n, strength, has_gap, sweep_level), known at ts.

    extreme: the candle's far end, whose loss by a close ends the block; sweep_level: the last swing confirmed by ts on
    that side. Only the pointer to the unbroken swing is a fold, all else are windows.
    """
    b = marked(bars, side=side, lookback=lookback, mean_bars=mean_bars)
    rows = b.select("symbol", "n", "close", "up", "down", "tr")
    breaks = fold(rows, ["symbol"], ["n"], Extremes, schema_of(rows, ["symbol", "n"], "direction string, broken double, atr double"))
    j = breaks.join(b, ["symbol", "n"])
    up = F.col("direction") == "bullish"
    sign, body, span = F.when(up, 1).otherwise(-1), F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    j = j.withColumns({"c": F.when(up, F.col("__bear")).otherwise(F.col("__bull")), "__gap": F.when(up, F.col("__up")).otherwise(F.col("__down"))})
    far = F.when(up, F.col("c.high")).otherwise(F.col("c.low"))
    ratio = body / (span + 1e-12)
    j = j.where((body >= atr_mult * F.col("atr")) & (ratio >= body_ratio) & (sign * (F.col("close") - F.col("open")) > 0) & F.col("c").isNotNull() & (sign * (F.col("close") - far) > 0))
    has_gap = F.coalesce(F.col("__gap") >= F.col("c.n") + 2, F.lit(False))
    told = {"strong": body >= 2 * atr_mult * F.col("atr"), "gap": has_gap, "volume": F.coalesce(F.col("c.heavy"), F.lit(False)), "clean": ratio >= 0.65, "swing": F.coalesce(F.col("c.swing"), F.lit(False)) & (F.col("c.n") + side <= F.col("n"))}
    strength = F.round(sum((F.when(told[k], v).otherwise(0.0) for k, v in STRENGTH.items()), F.lit(0.0)), 6)
    low, high = (F.least("c.open", "c.close"), F.greatest("c.open", "c.close")) if body_only else (F.col("c.low"), F.col("c.high"))
    out = j.select(
        "symbol", "ts", "n", "direction", low.alias("bottom"), high.alias("top"), F.when(up, F.col("c.low")).otherwise(F.col("c.high")).alias("extreme"), F.col("c.ts").alias("block_ts"), F.col("c.n").alias("block_n"),
        strength.alias("strength"), has_gap.alias("has_gap"), F.when(up, F.col("__low")).otherwise(F.col("__high")).alias("sweep_level"),
    )
    return out.where((F.col("strength") >= least) & (F.col("has_gap") | F.lit(not need_gap)))


def candidates(b: DataFrame, *, side: int = 2, atr_mult: float = 1.0, body_ratio: float = 0.5) -> dict[str, Column]:
    """For each direction the block that a break at a bar of marked() would make, or null; strength without its part for a strong bar."""
    out = {}
    for name, sign, candle, gap_n, far, near in (("bullish", 1, "__bear", "__up", "high", "low"), ("bearish", -1, "__bull", "__down", "low", "high")):
        c, body = F.col(candle), F.abs(F.col("close") - F.col("open"))
        ratio = body / (F.col("high") - F.col("low") + 1e-12)
        ok = (ratio >= body_ratio) & (sign * (F.col("close") - F.col("open")) > 0) & c.isNotNull() & (sign * (F.col("close") - c[far]) > 0)
        has_gap = F.coalesce(F.col(gap_n) >= c["n"] + 2, F.lit(False))
        told = {"gap": has_gap, "volume": F.coalesce(c["heavy"], F.lit(False)), "clean": ratio >= 0.65, "swing": F.coalesce(c["swing"], F.lit(False)) & (c["n"] + side <= F.col("n"))}
        strength = sum((F.when(t, STRENGTH[k]).otherwise(0.0) for k, t in told.items()), F.lit(0.0))
        out[name] = F.when(ok, F.struct(F.least(c["open"], c["close"]).alias("bottom"), F.greatest(c["open"], c["close"]).alias("top"), c[near].alias("extreme"), c["n"].alias("place"), strength.alias("strength"), has_gap.alias("has_gap"), (body / atr_mult).alias("body")))
    return out


KEYS = ("direction", "bottom", "top", "extreme", "block_ts", "strength", "has_gap", "sweep_level")


def lifecycle(bars: DataFrame, found: DataFrame) -> DataFrame:
    """found with visited_ts, swept_ts, mitigated_ts, breaker and retest_ts.

    visited: the first later bar that touches the zone; mitigated: the first close beyond the candle's far end; swept:
    the first bar through the swing before it, if not after the mitigation (within a bar the sweep counts first); a
    mitigated block that was swept is a breaker; retest: the first bar from its mitigation on that touches the zone.
    """
    up = F.col("direction") == "bullish"
    hit = gaps.first_hits_by_side(found, bars, up, {
        "visited_ts": ([("low", "<=", F.col("top"))], [("high", ">=", F.col("bottom"))]),
        "swept_ts": ([("low", "<", F.col("sweep_level"))], [("high", ">", F.col("sweep_level"))]),
        "mitigated_ts": ([("close", "<", F.col("extreme"))], [("close", ">", F.col("extreme"))]),
    }, KEYS)
    swept = F.col("swept_ts").isNotNull() & (F.col("mitigated_ts").isNull() | (F.col("swept_ts") <= F.col("mitigated_ts")))
    hit = hit.withColumns({"swept_ts": F.when(swept, F.col("swept_ts")), "breaker": swept & F.col("mitigated_ts").isNotNull()})
    broken = hit.where("breaker").select("symbol", F.date_sub("mitigated_ts", 1).alias("ts"), F.col("ts").alias("__ts"), *KEYS)
    again = gaps.first_hits_by_side(broken, bars, up, {"retest_ts": ([("high", ">=", F.col("bottom"))], [("low", "<=", F.col("top"))])}, ("__ts", *KEYS))
    again = again.select("symbol", F.col("__ts").alias("ts"), *KEYS[:1], "block_ts", "retest_ts")
    return hit.join(again, ["symbol", "ts", "direction", "block_ts"], "left")


def score(found: DataFrame, trend: Column, oi_rose: Column) -> DataFrame:
    """found (of lifecycle) with score, confluence and oi_confirmed: +0.15 along the trend, -0.15 once visited and alive."""
    along = ((trend == "BULLISH") & (F.col("direction") == "bullish")) | ((trend == "BEARISH") & (F.col("direction") == "bearish"))
    s = F.when(along, F.least(F.lit(1.0), F.col("strength") + 0.15)).otherwise(F.col("strength"))
    again = F.col("visited_ts").isNotNull() & F.col("mitigated_ts").isNull()
    return found.withColumns({"score": F.when(again, F.greatest(F.lit(0.0), s - 0.15)).otherwise(s), "confluence": along, "oi_confirmed": F.coalesce(oi_rose, F.lit(False))})
