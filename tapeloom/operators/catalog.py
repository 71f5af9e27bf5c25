"""Point-in-time catalog: keyed upserts, scans and vintage reads over DataFrames.

A table is a DataFrame on Parquet. An upsert is a union in which the newest row of a key wins, found by one window
over the key; write_partitions() replaces only the partitions that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Natural keys of the catalog tables.
KEYS = {
    "bars": ("symbol", "market", "freq", "ts"), "universe_members": ("universe", "symbol", "market", "start_date"), "delisting_returns": ("symbol", "market", "ts"),
    "fundamentals_q": ("symbol", "market", "period_end", "asof_ts"), "insider_trades": ("symbol", "market", "txn_date", "asof_ts", "insider_name", "txn_code"), "earnings": ("symbol", "market", "announce_ts", "period_end"),
    "macro_series": ("series_id", "asof_date", "revision_n"), "flows": ("symbol", "market", "ts", "investor"), "crypto_funding": ("exchange", "symbol", "ts"), "option_sentiment": ("date", "market"),
    "valuation_scores": ("symbol", "market", "asof_date"), "entry_plans": ("symbol", "market", "asof_ts"),
}


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], order: Column | None = None) -> DataFrame:
    """Rows of both tables, one a key: new before old, and the greatest ``order`` among new ones."""
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = Window.partitionBy(*keys).orderBy(F.desc("__new"), *([order.desc()] if order is not None else []))
    return tagged.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__new", "__rank")


def write_partitions(table: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write a table, replacing the partitions that it holds and leaving the others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scan(table: DataFrame, *, start=None, end=None, date_col: str = "ts", **equal) -> DataFrame:
    """Equality on key columns and a closed range on the date: partition columns prune folders, the rest reaches the Parquet scan."""
    out = table
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    if start is not None:
        out = out.where(F.col(date_col) >= F.lit(start))
    return out if end is None else out.where(F.col(date_col) <= F.lit(end))


def coverage(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def delete_range(table: DataFrame, key: Column, date_col: str, start, end) -> DataFrame:
    """The table without the rows of a key in a closed date range."""
    return table.where(~F.coalesce(key & F.col(date_col).between(F.lit(start), F.lit(end)), F.lit(False)))


def latest_known(table: DataFrame, keys: tuple[str, ...], known: str, order: tuple[str, ...], asof, k: int = 1) -> DataFrame:
    """Per key the k newest rows known by ``asof``: nothing that became known later is used. k <= 0: all."""
    seen = table.where(F.col(known) <= F.lit(asof))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    ranked = seen.withColumn("__rank", rank)
    return (ranked if k <= 0 else ranked.where(F.col("__rank") <= k)).drop("__rank")


def supersede(trades: DataFrame, asof) -> DataFrame:
    """The newest visible filing of each transaction; both the filing and the transaction must be known by ``asof``."""
    seen = trades.where((F.col("asof_ts") <= F.lit(asof)) & (F.col("txn_date") <= F.lit(asof)))
    w = Window.partitionBy("symbol", "txn_date", "insider_name", "txn_code").orderBy(F.desc("asof_ts"))
    return seen.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def merge_executions(trades: DataFrame) -> DataFrame:
    """Executions that share a key become one: shares and values add up, the price is their quotient.

    Values add up as decimals to a millionth, so no order of the rows moves the sum.
    """
    t = trades.withColumn("value_usd", F.coalesce("value_usd", F.col("shares") * F.col("price")))
    g = t.groupBy("symbol", "txn_date", "asof_ts", "insider_name", "txn_code").agg(F.sum("shares").alias("shares"), F.sum(F.col("value_usd").cast("decimal(28,6)")).cast("double").alias("value_usd"), F.min("price").alias("__price"))
    return g.withColumn("price", F.when(F.col("shares") > 0, F.col("value_usd") / F.col("shares")).otherwise(F.col("__price"))).drop("__price")


def trusted() -> Column:
    return F.coalesce((F.col("value_kind") == "reported_value") & (F.col("confidence") == "high"), F.lit(False))


def route_flows(flows: DataFrame) -> DataFrame:
    """flows with the table each row belongs to: reported values of high confidence, else the estimates."""
    return flows.withColumn("route", F.when(trusted(), "flows").otherwise("flow_estimates"))


def quarantine(flows: DataFrame, estimates: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(flows without untrusted rows, estimates with those whose key it lacks)."""
    moved = flows.where(~trusted()).join(estimates.select(*keys), list(keys), "left_anti")
    return flows.where(trusted()), estimates.unionByName(moved)


def visible_flows(flows: DataFrame, asof) -> DataFrame:
    return flows.where(F.col("release_date").isNull() | (F.col("release_date") <= F.lit(asof)))


def evolve(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns that the table lacks, name -> (type, default)."""
    return table.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in table.columns})
