"""Market-research tables derived from the given star schema, as DataFrames.

Bars come from line items (price = extended price per unit), intraday bars and flows from events, quarterly facts
from orders. Every table is an aggregate that Spark computes from the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_type", unit: str = "day") -> DataFrame:
    """OHLCV bars (symbol, ts, open, high, low, close, volume) of a part attribute per day or week."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("symbol", F.date_trunc(unit, "l_shipdate").cast("date").alias("ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "p_brand", "week")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, symbol = event type, volume = number of events."""
    order = F.struct("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def benchmark(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """(ts, bench): mean unit price of all line items of a bucket."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy(F.date_trunc(unit, "l_shipdate").cast("date").alias("ts")).agg(F.avg(price).alias("bench"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of a nation's orders; symbol is the brand of the same index, facts are fixed shares of revenue."""
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy(brand.alias("symbol"), F.col("c_nationkey").alias("k"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("q")).agg(F.sum("o_totalprice").alias("revenue"))
    end = F.date_sub(F.add_months("q", 3), 1)
    share = lambda base, step: F.col("revenue") * (base + step * F.col("k"))
    return q.select(
        "symbol", end.alias("period_end"), F.date_add(end, 45).alias("known_date"), "revenue",
        share(0.05, 0.002).alias("net_income"), share(0.08, 0.002).alias("operating_income"), share(0.04, 0.001).alias("free_cash_flow"),
        share(2.0, 0.01).alias("total_assets"), share(0.9, 0.01).alias("total_equity"), share(0.5, 0.02).alias("total_debt"), share(0.35, 0.004).alias("gross_profit"),
        (F.lit(1000.0) + F.col("k")).alias("shares_out"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals per brand: staggered starts, odd brands end a year before the last week."""
    w = weekly(spark, sf_dir).select("symbol", "ts")
    ends = w.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    k = F.substring("symbol", 7, 3).cast("int") - 1
    return w.select("symbol").distinct().crossJoin(F.broadcast(ends)).select("symbol", F.date_add("lo", (28 * k).cast("int")).alias("start_date"), F.when(k % 2 == 1, F.date_sub("hi", 364)).alias("end_date"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintages of the daily mean value per event type: every seventh day is revised by one per cent three days later."""
    d = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("asof_date")).agg(F.avg("value").alias("value"))
    first = d.select("series_id", "asof_date", F.col("asof_date").alias("release_date"), F.lit(0).alias("revision_n"), "value")
    second = d.where(F.dayofyear("asof_date") % 7 == 0).select("series_id", "asof_date", F.date_add("asof_date", 3).alias("release_date"), F.lit(1).alias("revision_n"), (F.col("value") * 1.01).alias("value"))
    return first.unionByName(second)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor flows: a row per event, signed by the parity of its id; one in five is an untrusted estimate."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("date").alias("ts"), F.col("event_type").alias("investor"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("net_value"),
        F.when(F.col("event_id") % 5 == 0, F.lit("estimate")).otherwise(F.lit("reported_value")).alias("value_kind"), F.when(F.col("event_id") % 10 == 5, F.lit("low")).otherwise(F.lit("high")).alias("confidence"),
        F.when(F.col("event_id") % 3 > 0, F.date_add(F.col("ts").cast("date"), 1)).alias("release_date"),
    )


def book(spark: SparkSession, sf_dir: str, levels: int = 10) -> DataFrame:
    """Ten price levels a side around each intraday close, sizes by a fixed formula."""
    b = intraday(spark, sf_dir)
    side = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: F.struct((F.col("close") * (1 + sign * 0.001 * i)).alias("price"), (F.col("volume") * i + F.pmod(F.hour("ts") * 7 + i * (3 if sign > 0 else 5), F.lit(11))).cast("double").alias("size")))
    return b.select("symbol", "ts", "close", side(-1).alias("bids"), side(1).alias("asks"))
