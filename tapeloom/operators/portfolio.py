"""Portfolio weights and strategy-return panels over long tables (ts, symbol, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import crosssection as xs
from tapeloom.operators import features as f
from tapeloom.operators.joins import asof_backward

def date():
    """The window of one date's names."""
    return Window.partitionBy("ts")


def equal_weights(names: DataFrame) -> DataFrame:
    return names.withColumn("weight", 1.0 / F.count("*").over(date()))


def inverse_vol(names: DataFrame, vol: str = "vol") -> DataFrame:
    """1 / vol, normalised per date; equal where no name has a positive one."""
    inv = F.when(F.col(vol) > 0, 1 / F.col(vol)).otherwise(F.lit(0.0))
    total = F.sum(inv).over(date())
    return names.withColumn("weight", F.when(total > 0, inv / total).otherwise(1.0 / F.count("*").over(date())))


def capped(weights: DataFrame, cap: float, rounds: int = 10) -> DataFrame:
    """Weights of at most ``cap``: what is above goes to the names below it in proportion, round by round.

    All rounds are windows over one date, so Spark shuffles once.
    """
    out = weights
    for _ in range(rounds):
        over = F.greatest(F.col("weight") - cap, F.lit(0.0))
        room = F.when(F.col("weight") < cap, F.col("weight")).otherwise(F.lit(0.0))
        spill, base = F.sum(over).over(date()), F.sum(room).over(date())
        out = out.withColumn("__next", F.when(F.col("weight") >= cap, F.lit(cap)).otherwise(F.when(base > 0, F.col("weight") + spill * F.col("weight") / base).otherwise(F.col("weight")))).drop("weight").withColumnRenamed("__next", "weight")
    return out


def cap_sector(weights: DataFrame, sector: str, cap: float) -> DataFrame:
    """Sectors above the cap are scaled down to it; the rest stays in cash."""
    total = F.sum("weight").over(Window.partitionBy("ts", sector))
    return weights.withColumn("weight", F.when(total > cap, F.col("weight") * cap / total).otherwise(F.col("weight")))


def rebalance_dates(bars: DataFrame, every: int, start: int) -> DataFrame:
    """(ts, period): calendar dates, period numbering the rebalances that begin every ``every`` dates from ``start``."""
    cal = bars.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")) - 1)
    return cal.where(F.col("n") >= start).withColumn("period", F.floor((F.col("n") - start) / every)).withColumn("is_rebalance", (F.col("n") - start) % every == 0)


def momentum_holdings(bars: DataFrame, lookback: int, top_n: int) -> DataFrame:
    """Per date the top_n names of positive momentum, by score then symbol, both descending."""
    scored = f.momentum(bars, lookback, out="score").where("score > 0").select("ts", "symbol", "score")
    return xs.top(scored, top_n, [F.desc("score"), F.desc("symbol")])


def rotation_panel(bars: DataFrame, *, lookback: int = 12, top_n: int = 5, every: int = 4, fee: float = 0.0005) -> DataFrame:
    """Strategy returns per date: the names chosen at the last rebalance, equal weights, earning the next return.

    The fee is paid on the turnover of a rebalance, on the date after it.
    """
    cal = rebalance_dates(bars, every, lookback)
    held = momentum_holdings(bars, lookback, top_n).join(cal.where("is_rebalance").select("ts", "period"), "ts")
    held = held.withColumn("weight", 1.0 / F.count("*").over(date())).select("period", "symbol", "weight", F.col("ts").alias("rebalance_ts"))
    nxt = f.returns(bars).select("symbol", "ts", "ret")
    dates = cal.withColumn("earn_ts", F.lead("ts").over(Window.orderBy("ts"))).select("period", F.col("earn_ts").alias("ts")).where("ts IS NOT NULL")
    grid = dates.join(held, "period").join(nxt, ["ts", "symbol"], "left")
    gross = grid.groupBy("ts", "period").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.count("*").alias("n_held"))
    first = dates.groupBy("period").agg(F.min("ts").alias("ts"))
    cost = xs.turnover(held.select(F.col("period").alias("ts"), "symbol", "weight")).withColumnRenamed("ts", "period").join(first, "period").select("ts", (F.col("turnover") * fee).alias("cost"))
    return gross.join(cost, "ts", "left").select("ts", "gross", "n_held", (F.col("gross") - F.coalesce("cost", F.lit(0.0))).alias("net"))


def rotation_grid(bars: DataFrame, lookbacks: tuple[int, ...], tops: tuple[int, ...], *, every: int = 4, fee: float = 0.0005) -> DataFrame:
    """rotation_panel() for all pairs of lookback and size in one plan: (lookback, top_n, ts, gross, n_held, net).

    The parameters are columns: scores are exploded once and ranked by lookback, and each size keeps a part of that rank.
    """
    b = bars.withColumns({f"__m{k}": F.col("close") / f.lag("close", k) - 1 for k in lookbacks})
    b = b.withColumn("__m", F.explode(F.array(*(F.struct(F.lit(k).alias("lookback"), F.col(f"__m{k}").alias("score")) for k in lookbacks))))
    scored = b.where("__m.score > 0").select("ts", "symbol", "__m.lookback", "__m.score")
    best = xs.top(scored, max(tops), [F.desc("score"), F.desc("symbol")], ["lookback", "ts"])
    best = best.withColumn("top_n", F.explode(F.array(*map(F.lit, tops)))).where("rank <= top_n")
    cal = bars.select("ts").distinct().withColumns({"n": F.row_number().over(Window.orderBy("ts")) - 1, "earn_ts": F.lead("ts").over(Window.orderBy("ts"))})
    cal = cal.withColumn("lookback", F.explode(F.array(*map(F.lit, lookbacks)))).where("n >= lookback").withColumns({"period": F.floor((F.col("n") - F.col("lookback")) / every), "first": (F.col("n") - F.col("lookback")) % every == 0})
    config = ["lookback", "top_n"]
    held = best.join(cal.where("first").select("lookback", "ts", "period"), ["lookback", "ts"])
    held = held.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(*config, "period"))).select(*config, "period", "symbol", "weight")
    dates = cal.where("earn_ts IS NOT NULL").select("lookback", "period", F.col("earn_ts").alias("ts"))
    ret = f.returns(bars).select("symbol", "ts", "ret")
    gross = dates.join(held, ["lookback", "period"]).join(ret, ["ts", "symbol"], "left").groupBy(*config, "ts", "period").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.count("*").alias("n_held"))
    order = Window.partitionBy(*config).orderBy("period")
    nxt = held.select(*config, "period").distinct().withColumn("next", F.lead("period").over(order))
    legs = held.unionByName(held.join(nxt, [*config, "period"]).where("next IS NOT NULL").select(*config, F.col("next").alias("period"), "symbol", (-F.col("weight")).alias("weight")))
    cost = legs.groupBy(*config, "period", "symbol").agg(F.sum("weight").alias("c")).groupBy(*config, "period").agg((F.sum(F.abs("c")) * fee).alias("cost"))
    start = dates.groupBy("lookback", "period").agg(F.min("ts").alias("ts"))
    due = cost.join(start, ["lookback", "period"]).select(*config, "ts", "cost")
    return gross.join(due, [*config, "ts"], "left").select(*config, "ts", "gross", "n_held", (F.col("gross") - F.coalesce("cost", F.lit(0.0))).alias("net"))


def ts_momentum_panel(bars: DataFrame, *, k: int = 20, fee: float = 0.0005) -> DataFrame:
    """Per series yesterday's signal times today's return, less the fee on a changed position."""
    b = f.returns(f.ts_momentum_signal(bars, k)).withColumn("position", F.coalesce(f.lag("signal"), F.lit(0)))
    return b.withColumn("strat_ret", F.col("position") * F.coalesce("ret", F.lit(0.0)) - fee * F.abs(F.col("position") - F.coalesce(f.lag("position"), F.lit(0))))


def crash_trigger(series: DataFrame, value: str = "close", n: int = 60, threshold: float = 0.1) -> DataFrame:
    """True where both the distance below the n-row peak and the n-row return are at or beyond the threshold; only the
    first is asked for while warming."""
    dd = F.col(value) / f.over(F.max(value), n) - 1
    ret = F.col(value) / f.lag(value, n) - 1
    return series.withColumn("crash", (dd <= -threshold) & F.coalesce(ret <= -threshold, F.lit(True)))


def vol_target_scale(realised: Column, target: float, max_leverage: float) -> Column:
    return F.when(realised > 0, F.least(F.lit(max_leverage), target / realised)).otherwise(F.lit(1.0))


def strategy_health(panel: DataFrame, ret: str, periods: int, by: str) -> DataFrame:
    """Total return, Sharpe (population) and maximal drawdown of return series, compounding in logarithms."""
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nav = panel.withColumn("__nav", F.exp(F.sum(F.log1p(F.col(ret))).over(w)))
    nav = nav.withColumn("__dd", 1 - F.col("__nav") / F.greatest(F.lit(1.0), F.max("__nav").over(w)))
    sd = F.stddev_pop(ret)
    return nav.groupBy(by).agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p(F.col(ret)))) - 1).alias("total"), F.when(sd > 0, F.avg(ret) / sd * periods**0.5).otherwise(0.0).alias("sharpe"), F.max("__dd").alias("max_drawdown"))


def ma_overlay(returns: DataFrame, bench: DataFrame, *, n: int = 200, fee: float = 0.001, per_year: int = 52) -> DataFrame:
    """returns (ts, ret) in cash while the benchmark's last value is not above its mean of n; a change of regime costs ``fee``.

    Both are calendars, a row a date, and so ordered by windows without a partition. Too short a history stays invested.
    """
    w = Window.orderBy("ts")
    ma = F.when(F.count("*").over(w.rowsBetween(1 - n, 0)) == n, F.avg("bench").over(w.rowsBetween(1 - n, 0)))
    regime = bench.withColumn("above", F.round(F.col("bench") - ma, 9) > 0).select(F.lit(1).alias("__k"), F.col("ts").alias("day"), "above")
    x = asof_backward(returns.withColumn("__k", F.lit(1)), regime, ("__k",), "ts", "day", ("above",)).withColumn("invested", F.coalesce("fact.above", F.lit(True)))
    turned = F.col("invested") != F.coalesce(F.lag("invested").over(w), F.lit(True))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("overlaid", F.when(F.col("invested"), F.col("ret")).otherwise(0.0) - F.when(turned, fee).otherwise(0.0)).withColumn("nav", F.exp(F.sum(F.log1p("overlaid")).over(upto)))
    all_ = Window.partitionBy()
    return x.withColumns({"drawdown": 1 - F.col("nav") / F.max("nav").over(upto), "sharpe": F.avg("overlaid").over(all_) / F.stddev_samp("overlaid").over(all_) * per_year**0.5})


def guarded(book: DataFrame, bench: DataFrame, *, target: float = 0.15, n: int = 12, filter_n: int = 100, hedge: float = 0.3, stop: float = 0.2, resume: float = 0.1, per_year: int = 52) -> DataFrame:
    """A book's raw returns (ts, raw) under its guards: a volatility target on the n rows before, a hedge sleeve of cash
    while the benchmark is not above its mean of ``filter_n``, and a latch that leaves the market from a drawdown of ``stop``
    of the scaled book on until it is under ``resume``. A calendar, a row a date, in windows without a partition."""
    w = Window.orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = w.rowsBetween(1 - filter_n, 0)
    trend = bench.withColumn("__calm", F.round(F.col("bench") - F.when(F.count("*").over(last) == filter_n, F.avg("bench").over(last)), 9) > 0).select("ts", "__calm")
    x = book.join(trend, "ts", "left").withColumn("calm", F.coalesce("__calm", F.lit(True)))
    vol = F.stddev_pop("raw").over(w.rowsBetween(-n, -1)) * per_year**0.5
    x = x.withColumn("scale", F.coalesce(vol_target_scale(vol, target, 1.0), F.lit(1.0)) * F.when(F.col("calm"), 1.0).otherwise(1 - hedge)).withColumn("__ret", F.col("raw") * F.col("scale"))
    x = x.withColumn("__nav", F.product(1 + F.col("__ret")).over(upto)).withColumn("__dd", F.round(1 - F.col("__nav") / F.max("__nav").over(upto), 9))
    mark = F.when(F.col("__dd") >= stop, F.lit(False)).when(F.col("__dd") <= resume, F.lit(True))
    x = x.withColumn("invested", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return x.withColumn("ret", F.when(F.col("invested"), F.col("__ret")).otherwise(0.0))


def plan(targets: DataFrame, held: DataFrame, marks: DataFrame, *, dust: float = 0.0) -> DataFrame:
    """(place, symbol, side, held, target, qty, notional): trades from held (symbol, held) to targets (symbol, target).

    What is held but no target is sold whole; trades under ``dust`` at a known mark are left out; sells come before buys.
    """
    j = targets.join(held, "symbol", "full").join(marks, "symbol", "left").withColumns({"held": F.coalesce("held", F.lit(0)), "target": F.coalesce("target", F.lit(0))})
    j = j.withColumn("delta", F.col("target") - F.col("held")).where(F.abs("delta") > 1e-9)
    notional = F.abs("delta") * F.col("mark")
    j = j.where(~F.coalesce((F.col("mark") > 0) & (notional < dust), F.lit(False)))
    place = F.row_number().over(Window.orderBy(F.col("delta") > 0, "symbol"))  # a row a traded name
    return j.select(place.alias("place"), "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), "held", "target", F.abs("delta").alias("qty"), F.round(notional, 4).alias("notional"))
