"""As-of, interval and alignment joins.

A backward as-of join is a union of both sides and one window over the key: ordered by time with the facts first, the
last fact so far is carried to each row. That takes one shuffle on the key and no range join, at any number of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: tuple[str, ...], left_ts: str, right_ts: str, values: tuple[str, ...], tie: tuple[str, ...] = ()) -> DataFrame:
    """left with the struct ``fact`` of the last right row at or before its time (null: none).

    Among right rows of one time the greatest ``tie`` wins.
    """
    keys = [F.col(c) for c in by]
    fact = F.struct(F.col(right_ts).alias("known"), *values)
    facts = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.struct(*(tie or values)).alias("__tie"), fact.alias("__fact"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    rows = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(facts.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(facts.schema["__fact"].dataType).alias("__fact"), F.struct(*left.columns).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = facts.unionByName(rows).withColumn("fact", F.last("__fact", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__row.*", "fact")


def asof_forward(left: DataFrame, right: DataFrame, by: tuple[str, ...], left_ts: str, right_ts: str, values: tuple[str, ...]) -> DataFrame:
    """left with the struct ``fact`` of the first right row at or after its time."""
    keys = [F.col(c) for c in by]
    fact = F.struct(F.col(right_ts).alias("known"), *values)
    facts = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(1).alias("__side"), fact.alias("__fact"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    rows = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(facts.schema["__fact"].dataType).alias("__fact"), F.struct(*left.columns).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = facts.unionByName(rows).withColumn("fact", F.first("__fact", ignorenulls=True).over(w))
    return both.where("__side = 0").select("__row.*", "fact")


def fresh(value: Column, known: Column, now: Column, max_days: int) -> Column:
    """The value unless it is more than max_days older than now."""
    return F.when(F.datediff(now, known) <= max_days, value)


def members_on(dates: DataFrame, members: DataFrame) -> DataFrame:
    """(ts, symbol): distinct members on each date; the membership table is small beside the dates and is joined by range."""
    return dates.join(members, (F.col("start_date") <= F.col("ts")) & (F.col("end_date").isNull() | (F.col("ts") <= F.col("end_date")))).select("ts", "symbol").distinct()


def holding_returns(bars: DataFrame, delistings: DataFrame) -> DataFrame:
    """Return from each bar to the next date of the calendar; where the next bar is missing, the delisting return in between.

    ``problem`` marks rows with neither, except on the last date.
    """
    calendar = bars.select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))
    b = bars.join(calendar, "ts")
    nxt = bars.select(F.col("symbol").alias("__s"), F.col("ts").alias("__t"), F.col("close").alias("next_close"))
    b = b.join(nxt, (F.col("symbol") == F.col("__s")) & (F.col("next_ts") == F.col("__t")), "left")
    d = delistings.select(F.col("symbol").alias("__d"), F.col("ts").alias("exit_ts"), "return_pct")
    b = b.join(d, (F.col("symbol") == F.col("__d")) & (F.col("exit_ts") > F.col("ts")) & (F.col("exit_ts") <= F.col("next_ts")), "left")
    ret = F.coalesce(F.col("next_close") / F.col("close") - 1, F.col("return_pct"))
    return b.withColumn("ret", ret).withColumn("problem", F.col("next_ts").isNotNull() & ret.isNull()).select("symbol", "ts", "next_ts", "ret", "problem")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys of either side whose values differ by more than the tolerance; a missing side counts as 0."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    j = e.join(a, key, "full").select(key, F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
    return j.where(F.abs(F.col("expected") - F.col("actual")) > tolerance).withColumn("diff", F.col("actual") - F.col("expected"))
