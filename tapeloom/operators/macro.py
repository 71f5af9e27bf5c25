"""Macro series, regimes and forecasts over (series_id, asof_date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def series():
    """The window of one series in time order."""
    return Window.partitionBy("series_id").orderBy("asof_date")


def latest_vintage(macro: DataFrame) -> DataFrame:
    """The newest revision of every date."""
    return macro.groupBy("series_id", "asof_date").agg(F.max_by("value", "revision_n").alias("value"))


def change(series: DataFrame, days: int) -> DataFrame:
    """Per cent, inverse per cent and absolute change against the last value at least ``days`` days before.

    A range frame on the day number finds it, without a join.
    """
    day = F.datediff("asof_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("series_id").orderBy("__day").rangeBetween(Window.unboundedPreceding, -days)
    base = F.last("value").over(w)
    return series.withColumn("__day", day).withColumns({"pct": (F.col("value") / base - 1) * 100, "inverse_pct": (base / F.col("value") - 1) * 100, "change": F.col("value") - base}).drop("__day")


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Change on the month before, only where that is the calendar month before. monthly: (series_id, month, value)."""
    w = Window.partitionBy("series_id").orderBy("month")
    near = F.lag("month").over(w) == F.add_months("month", -1)
    return monthly.withColumn("mom_pct", F.when(near, (F.col("value") / F.lag("value").over(w) - 1) * 100))


def baselines(series: DataFrame, order: str, alpha: float = 0.4, n: int = 6) -> DataFrame:
    """Forecasts of each month from those before it: last, mean of n, exponential mean, the same month a year ago.

    The exponential mean is a recurrence in blocks, taken from the row before; the month a year ago is found by range.
    """
    from tapeloom.operators.states import recurrence

    own = recurrence(series.withColumnsRenamed({"series_id": "symbol", order: "ts"}), "value", alpha, "__e").withColumnsRenamed({"symbol": "series_id", "ts": order})
    w = Window.partitionBy("series_id").orderBy(order)
    month = F.year(order) * 12 + F.month(order)
    back = Window.partitionBy("series_id").orderBy(month).rangeBetween(-12, -12)
    return own.withColumns({"last": F.lag("value").over(w), "mean_n": F.avg("value").over(w.rowsBetween(-n, -1)), "ewma": F.lag("__e").over(w), "year_ago": F.max("value").over(back)}).drop("__e")


def regime(growth: Column, inflation: Column, stress: Column) -> Column:
    """Five labels, the first rule that holds."""
    return F.when(stress >= 2, "crisis").when((growth > 0) & (inflation <= 0), "expansion").when((growth > 0) & (inflation > 0), "reflation").when((growth <= 0) & (inflation > 0), "stagflation").otherwise("slowdown")


def hysteresis(labels: DataFrame, by: str, order: str, raw: str, urgent: tuple[str, ...]) -> DataFrame:
    """Committed label: a new one counts from its second row in a row, an urgent one at once.

    A row confirms its label if it is urgent or equals the row before; the last confirmed label holds.
    """
    w = Window.partitionBy(by).orderBy(order)
    sure = F.when(F.col(raw).isin(*urgent) | (F.col(raw) == F.lag(raw).over(w)) | F.lag(raw).over(w).isNull(), F.col(raw))
    return labels.withColumn("__sure", sure).withColumn("regime", F.last("__sure", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__sure")


def softmax(logits: dict[str, Column]) -> dict[str, Column]:
    total = sum((F.exp(c) for c in logits.values()), F.lit(0.0))
    return {k: F.exp(c) / total for k, c in logits.items()}


#: Fixed values of the rate forecast: basis points of a move, pressure a move, holds, and the rule's parameters.
HOLD_BP, SCALE, HOLD_BASE, STREAK_BONUS, STREAK_CAP = 12.5, 0.8, 1.0, 0.15, 6
GRADUALISM, TAYLOR_CLAMP, MARKET_CLAMP, MEETINGS_PRICED = 0.33, 3.0, 2.0, 2.0
MARKET_WEIGHT, TAYLOR_WEIGHT, NEUTRAL, TARGET = 0.5, 0.3, 1.0, 2.0


def rate_decisions(rates: DataFrame) -> DataFrame:
    """(series_id, month, decision, bp, streak) of every odd month from monthly averages (series_id, month, rate).

    A meeting's month is a mixed reading, so the month behind it is held against the one before it; where either is
    missing there is no decision yet. streak: holds in a row up to the meeting, an island count by two windows.
    """
    w = Window.partitionBy("series_id").orderBy("month")
    whole = (F.lag("month").over(w) == F.add_months("month", -1)) & (F.lead("month").over(w) == F.add_months("month", 1))
    x = rates.withColumns({"__bp": F.round((F.lead("rate").over(w) - F.lag("rate").over(w)) * 100, 6), "__whole": whole}).where((F.col("__whole")) & (F.month("month") % 2 == 1))
    hold = F.abs("__bp") < HOLD_BP
    x = x.withColumns({"decision": F.when(hold, "hold").when(F.col("__bp") > 0, "hike").otherwise("cut"), "bp": F.when(hold, 0.0).otherwise(F.round("__bp", 1))})
    x = x.withColumn("__island", F.sum((~hold).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("series_id", "__island").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("streak", F.sum(hold.cast("long")).over(own)).select("series_id", "month", "decision", "bp", "streak")


def rate_probabilities(rates: DataFrame) -> DataFrame:
    """(series_id, month, pressure, cut, hold, hike): softmax of the blended pressure, with a bonus for holds in a row.

    Market pressure is the spread of the three-month mean to the rate, a rule's pressure the clamped gap of the
    rate to neutral + inflation + half its distance from target, with the rate's own yearly change as inflation. Without a
    year of history the market counts alone.
    """
    w = Window.partitionBy("series_id").orderBy("month")
    clamp = lambda x, k: F.greatest(F.lit(-k), F.least(F.lit(k), x))
    spread = F.round((F.avg("rate").over(w.rowsBetween(-2, 0)) - F.col("rate")) * 100, 9)
    yoy = F.when(F.lag("month", 12).over(w) == F.add_months("month", -12), (F.col("rate") / F.lag("rate", 12).over(w) - 1) * 100)
    x = rates.withColumns({"__market": clamp(spread / 25 / MEETINGS_PRICED, MARKET_CLAMP), "__yoy": yoy})
    rule = NEUTRAL + F.col("__yoy") + 0.5 * (F.col("__yoy") - TARGET)
    x = x.withColumn("__taylor", F.when(F.col("__yoy").isNotNull(), clamp((rule - (F.col("rate") - 0.125)) / 0.25, TAYLOR_CLAMP) * GRADUALISM))
    weight = F.when(F.col("__taylor").isNull(), MARKET_WEIGHT).otherwise(MARKET_WEIGHT + TAYLOR_WEIGHT)
    x = x.withColumn("pressure", (MARKET_WEIGHT * F.col("__market") + F.coalesce(TAYLOR_WEIGHT * F.col("__taylor"), F.lit(0.0))) / weight)
    x = x.join(rate_decisions(rates).select("series_id", "month", "streak"), ["series_id", "month"], "left")
    p = softmax({"cut": -SCALE * F.col("pressure"), "hold": HOLD_BASE + STREAK_BONUS * F.least(F.coalesce("streak", F.lit(0)), F.lit(STREAK_CAP)), "hike": SCALE * F.col("pressure")})
    return x.withColumns(p)
