"""Risk limits, sizing, slippage and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breaches(row: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """A row per limit that a measure exceeds: rule -> (column, limit)."""
    checks = F.array(*(F.when(F.col(c) > limit, F.struct(F.lit(rule).alias("rule"), F.col(c).cast("double").alias("value"), F.lit(float(limit)).alias("limit"))) for rule, (c, limit) in limits.items()))
    return row.withColumn("__b", F.explode(F.filter(checks, lambda x: x.isNotNull()))).select(*row.columns, "__b.*")


def kill_switch(day_dd: Column, peak_dd: Column, gross: Column) -> Column:
    return (day_dd > 0.02) | (peak_dd > 0.25) | (gross > 1.0)


def equity_refs(equity: DataFrame, by: str) -> DataFrame:
    """Running peak and the close before, per account; the first row refers to itself."""
    w = Window.partitionBy(by).orderBy("ts")
    return equity.withColumns({"peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "day_ref": F.coalesce(F.lag("equity").over(w), F.col("equity"))})


def size(equity: Column, price: Column, vol: Column, edge: Column, target_vol: float, risk_cap: float, hard_cap: float) -> dict[str, Column]:
    """Smallest of the volatility target, the risk cap and half Kelly, under a hard cap; whole shares and what binds."""
    by = {"vol_target": target_vol / vol, "risk_cap": F.lit(risk_cap), "half_kelly": F.greatest(F.lit(0.0), edge / (vol * vol) / 2), "hard_cap": F.lit(hard_cap)}
    weight = F.least(*by.values())
    binding = F.lit(None).cast("string")
    for name, c in reversed(by.items()):
        binding = F.when(c == weight, name).otherwise(binding)
    return {"weight": weight, "binding": binding, "shares": F.floor(equity * weight / price)}


def slippage(qty: Column, adv: Column, half_spread: float, coef: float, cap: float) -> Column:
    """Half the spread and a square-root impact, capped, signed by the side (the sign of qty)."""
    return F.signum(qty) * F.least(F.lit(cap), half_spread + coef * F.sqrt(F.abs(qty) / adv))


def net_positions(orders: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Filled quantity per symbol from the last snapshot of each order, buys positive."""
    last = orders.groupBy("symbol", key).agg(F.max_by(F.struct("side", "filled_qty"), F.struct(*order)).alias("s"))
    return last.groupBy("symbol").agg(F.sum(F.when(F.col("s.side") == "buy", F.col("s.filled_qty")).otherwise(-F.col("s.filled_qty"))).alias("net_qty"))


def shortability(rows: DataFrame, *, max_fee: float = 500.0, max_age: int = 2, least: str = "medium", need_row: bool = False) -> DataFrame:
    """rows (symbol, ts, known_date, confidence, shortable, fee) with reasons and passed; without a record it passes unless ``need_row``."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    found = F.col("known_date").isNotNull()
    checks = [(F.datediff("ts", "known_date") > max_age, "age"), (rank(F.col("confidence")) < rank(F.lit(least)), "confidence"), (~F.col("shortable"), "not_shortable"), (F.col("fee") > max_fee, "fee")]
    reasons = F.when(found, F.concat_ws(",", *(F.when(c, F.lit(n)) for c, n in checks))).otherwise("missing" if need_row else "")
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit("missing")), "reasons": reasons}).withColumn("passed", F.col("reasons") == "").drop("shortable")
