"""Cross-sectional ranks, scores and selections: windows over one date's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z(value: str | Column, by: str = "ts", nulls: bool = False) -> Column:
    """Population z in the cross-section: 0 where it is flat or has fewer than two names; a null value gives 0, or null."""
    c = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(by)
    sd = F.stddev_pop(c).over(w)
    score = F.when((F.count(c).over(w) >= 2) & (sd > 0), (c - F.avg(c).over(w)) / sd).otherwise(F.lit(0.0))
    return F.when(c.isNull(), F.lit(None) if nulls else F.lit(0.0)).otherwise(score)


def avg_rank(value: str, by: str = "ts") -> Column:
    """1-based rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(by).orderBy(value)) + (F.count("*").over(Window.partitionBy(by, value)) - 1) / 2


def top(df: DataFrame, n: int, order: list[Column], by: str | list[str] = "ts") -> DataFrame:
    """The first n rows of each group in the given order, with their rank."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def rank_percentile(order: list[Column], by: str = "ts") -> Column:
    """100 * (n - rank) / (n - 1); 50 for a single name."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    return F.when(n <= 1, F.lit(50.0)).otherwise(100.0 * (n - F.row_number().over(w.orderBy(*order))) / (n - 1))


def quantile(value: str, q: int = 5, by: str = "ts") -> Column:
    """Bucket 0 to q - 1 of equal counts, by the value's place: floor(q * place / n)."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(value, "symbol")) - 1
    return F.floor(place * q / F.count("*").over(Window.partitionBy(by)))


def turnover(weights: DataFrame) -> DataFrame:
    """Sum of absolute weight changes between following rebalance dates, names missing on a side counting as 0.

    weights: (ts, symbol, weight). Each row counts on its own date and, with the sign turned, on the next one, so
    the two books meet in one aggregation instead of a full join.
    """
    dates = weights.select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))
    w = weights.join(dates, "ts")
    legs = w.select("ts", "symbol", "weight").unionByName(w.where("next_ts IS NOT NULL").select(F.col("next_ts").alias("ts"), "symbol", (-F.col("weight")).alias("weight")))
    return legs.groupBy("ts", "symbol").agg(F.sum("weight").alias("change")).groupBy("ts").agg(F.sum(F.abs("change")).alias("turnover"))


def spearman(df: DataFrame, x: str, y: str, by: str = "ts", least: int = 3) -> DataFrame:
    """Rank correlation of x and y per group; null with fewer than ``least`` pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": avg_rank(x, by), "__y": avg_rank(y, by)})
    return ok.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("__x", "__y")).alias("ic"))
