"""Candle patterns as expressions over a bar and the bars just before it.

geometry() adds a struct of lagged values once; each pattern is then a boolean column, so that a scan of all patterns
costs one window over the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import features as f

#: Pattern names by direction, and how many bars each pattern spans.
BULLISH = ("hammer", "inverted_hammer", "bull_marubozu", "dragonfly_doji", "bullish_engulfing", "bullish_harami", "piercing_line", "tweezer_bottom", "morning_star", "three_white_soldiers")
BEARISH = ("hanging_man", "shooting_star", "bear_marubozu", "gravestone_doji", "bearish_engulfing", "bearish_harami", "dark_cloud_cover", "tweezer_top", "evening_star", "three_black_crows")
TWO_BARS = ("bullish_engulfing", "bearish_engulfing", "bullish_harami", "bearish_harami", "piercing_line", "dark_cloud_cover", "tweezer_bottom", "tweezer_top")
THREE_BARS = ("morning_star", "evening_star", "three_white_soldiers", "three_black_crows")


class Bar:
    """Columns of the bar k bars ago, after geometry()."""

    def __init__(self, k: int = 0):
        c = lambda n: F.col(n if not k else f"__{n}{k}")
        self.open, self.high, self.low, self.close, self.trend = c("open"), c("high"), c("low"), c("close"), c("trend")
        self.body = F.abs(self.close - self.open)
        span = self.high - self.low
        self.range = F.when(span == 0, F.lit(1e-10)).otherwise(span)
        self.upper, self.lower = self.high - F.greatest(self.open, self.close), F.least(self.open, self.close) - self.low
        self.top, self.bottom = F.greatest(self.open, self.close), F.least(self.open, self.close)
        self.part, self.bull, self.bear = self.body / self.range, self.close >= self.open, self.close < self.open
        self.mid = (self.open + self.close) / 2


def geometry(bars: DataFrame) -> DataFrame:
    """bars with the trend before each bar and the two bars before it."""
    out = f.prior_trend(bars)
    return out.withColumns({f"__{c}{k}": f.lag(c, k) for k in (1, 2) for c in ("open", "high", "low", "close", "trend")})


def patterns() -> dict[str, Column]:
    """Pattern name -> condition; those of the first bars, without enough bars before, are null or false."""
    c, p, q = Bar(0), Bar(1), Bar(2)
    down, up = c.trend == "down", c.trend == "up"
    small = (c.body != 0) & (c.part <= 0.35)
    hammer = small & (c.lower >= 2 * c.body) & (c.upper <= 0.10 * c.range) & (c.bottom >= c.low + 0.60 * c.range)
    star = small & (c.upper >= 2 * c.body) & (c.lower <= 0.10 * c.range) & (c.top <= c.low + 0.40 * c.range)
    maru = (c.part >= 0.95) & (c.upper < 0.05 * c.body) & (c.lower < 0.05 * c.body)
    doji = c.part <= 0.05
    dragon, grave = doji & (c.upper <= 0.05 * c.range) & (c.lower >= 0.60 * c.range), doji & (c.lower <= 0.05 * c.range) & (c.upper >= 0.60 * c.range)
    turn_up, turn_down = p.bear & c.bull, p.bull & c.bear
    inside = (c.bottom >= p.bottom) & (c.top <= p.top) & (p.part >= 0.60)
    each = lambda test: test(q) & test(p) & test(c)
    return {
        "bull_marubozu": maru & c.bull,
        "bear_marubozu": maru & c.bear,
        "dragonfly_doji": dragon,
        "gravestone_doji": grave & ~dragon,
        "doji": doji & ~dragon & ~grave,
        "spinning_top": c.part.between(0.05, 0.30) & (c.body > 0) & (c.upper >= 2 * c.body) & (c.lower >= 2 * c.body),
        "hammer": down & hammer,
        "hanging_man": up & hammer,
        "inverted_hammer": down & star,
        "shooting_star": up & star,
        "bullish_engulfing": down & turn_up & (c.open <= p.close) & (c.close >= p.open) & (c.body > p.body),
        "bearish_engulfing": up & turn_down & (c.open >= p.close) & (c.close <= p.open) & (c.body > p.body),
        "bullish_harami": down & turn_up & inside,
        "bearish_harami": up & turn_down & inside,
        "piercing_line": down & turn_up & (c.open < p.close) & (c.close > p.mid) & (c.close < p.open),
        "dark_cloud_cover": up & turn_down & (c.open > p.close) & (c.close < p.mid) & (c.close > p.open),
        "tweezer_bottom": down & turn_up & (F.abs(p.low - c.low) <= 0.003 * p.low),
        "tweezer_top": up & turn_down & (F.abs(p.high - c.high) <= 0.003 * p.high),
        "morning_star": (q.trend == "down") & q.bear & (q.part >= 0.50) & (p.part <= 0.30) & c.bull & (c.close >= q.mid) & (p.top < q.close),
        "evening_star": (q.trend == "up") & q.bull & (q.part >= 0.50) & (p.part <= 0.30) & c.bear & (c.close <= q.mid) & (p.bottom > q.close),
        "three_white_soldiers": each(lambda b: b.bull & (b.part >= 0.50) & (b.upper <= 0.15 * b.range)) & p.open.between(q.open, q.close) & c.open.between(p.open, p.close) & (p.close > q.close) & (c.close > p.close),
        "three_black_crows": each(lambda b: b.bear & (b.part >= 0.50) & (b.lower <= 0.15 * b.range)) & p.open.between(q.close, q.open) & c.open.between(p.close, p.open) & (p.close < q.close) & (c.close < p.close),
    }


def scan(bars: DataFrame, names: tuple[str, ...] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """A row per bar and pattern found: symbol, ts, pattern, direction, and ``also`` of the bar: all from one window."""
    found, also = patterns(), also or {}
    chosen = F.array(*(F.when(F.coalesce(found[n], F.lit(False)), F.lit(n)) for n in names or found))
    out = geometry(bars).withColumns(also).select("symbol", "ts", *also, F.explode(F.filter(chosen, lambda x: x.isNotNull())).alias("pattern"))
    return out.withColumn("direction", F.when(F.col("pattern").isin(*BULLISH), "bullish").when(F.col("pattern").isin(*BEARISH), "bearish").otherwise("neutral"))


def last_pattern(bars: DataFrame) -> DataFrame:
    """bars with candle: the last found pattern, in the order of patterns(), with its direction, strength (as strength()) and bar."""
    found, b = patterns(), Bar(0)
    mean, mean_part = F.coalesce(f.over(F.avg("volume"), 10, 1), F.col("volume")), F.coalesce(f.over(F.avg("__part"), 10, 1), F.col("__part"))
    out = geometry(bars).withColumn("__part", b.part)
    out = out.withColumns({"__name": F.coalesce(*(F.when(found[n], F.lit(n)) for n in reversed(found))), "__ratio": F.when(mean > 0, F.col("volume") / mean).otherwise(1.0), "__mean": mean_part})
    name = F.col("__name")
    score = F.when(F.col("__part") > 1.2 * F.col("__mean"), 1).otherwise(0) + F.when(F.col("__ratio") > 1.5, 1).otherwise(0) + F.when(name.isin(*THREE_BARS), 1).when(name.isin(*TWO_BARS), 0).otherwise(-1)
    size = F.when(F.col("__ratio") < 0.8, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), score + 1)))
    direction = F.when(name.isin(*BULLISH), "bullish").when(name.isin(*BEARISH), "bearish").otherwise("neutral")
    candle = F.when(name.isNotNull(), F.struct(name.alias("pattern"), direction.alias("direction"), size.alias("strength"), "high", "low"))
    lagged = [f"__{c}{k}" for k in (1, 2) for c in ("open", "high", "low", "close", "trend")]
    return out.withColumn("candle", candle).drop("__name", "__ratio", "__mean", "__part", "trend", "trend_score", *lagged)


def strength(bars: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """Pattern rows with strength 1 to 3: a body above 1.2 times the mean of the ten bars before, a volume above 1.5
    times, +1 for three bars and -1 for one; 1 where the volume is under 0.8 of its mean."""
    b = Bar(0)
    mean = F.coalesce(f.over(F.avg("volume"), 10, 1), F.col("volume"))
    measured = {"body_part": b.part, "vol_ratio": F.when(mean > 0, F.col("volume") / mean).otherwise(F.lit(1.0)), "__mean_part": F.coalesce(f.over(F.avg(b.part), 10, 1), b.part)}
    out = scan(bars, also=measured | (also or {}))
    span = F.when(F.col("pattern").isin(*THREE_BARS), 1).when(F.col("pattern").isin(*TWO_BARS), 0).otherwise(-1)
    score = F.when(F.col("body_part") > 1.2 * F.col("__mean_part"), 1).otherwise(0) + F.when(F.col("vol_ratio") > 1.5, 1).otherwise(0) + span
    s = F.greatest(F.lit(1), F.least(F.lit(3), score + 1))
    return out.withColumn("strength", F.when(F.col("vol_ratio") < 0.8, 1).otherwise(s)).drop("__mean_part")


def confirm(bars: DataFrame) -> DataFrame:
    """Pattern rows with the next bar's confirmation: a close beyond the signal bar's extreme in the pattern's direction."""
    nxt = {"__high": F.col("high"), "__low": F.col("low"), "next_close": F.lead("close").over(f.series()), "confirm_ts": F.lead("ts").over(f.series())}
    out = strength(bars, nxt).where("direction <> 'neutral'")
    ok = F.when(F.col("direction") == "bullish", F.col("next_close") > F.col("__high")).otherwise(F.col("next_close") < F.col("__low"))
    return out.withColumn("confirmed", F.coalesce(ok, F.lit(False))).drop("__high", "__low")
