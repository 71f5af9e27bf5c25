"""Window features over bar tables (symbol, ts, open, high, low, close, volume).

Each function adds columns by windows over (symbol order by ts), so all features of a series share one shuffle and
one sort; none looks past its own bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series():
    """The window of one series in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int, end: int = 0):
    """Frame of n rows that ends ``end`` rows before the current one."""
    return series().rowsBetween(-(n - 1) - end, -end)


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def over(agg: Column, n: int, end: int = 0) -> Column:
    return agg.over(last(n, end))


def full(agg: Column, n: int, counted: str | Column = "close", end: int = 0) -> Column:
    """The aggregate of a frame, null until the frame is full."""
    return F.when(over(F.count(counted), n, end) >= n, over(agg, n, end))


def running(agg: Column) -> Column:
    return agg.over(series().rowsBetween(Window.unboundedPreceding, Window.currentRow))


def returns(bars: DataFrame) -> DataFrame:
    """ret: close to close; log_ret: null where either close isn't positive."""
    before = lag("close")
    return bars.withColumns({"ret": F.col("close") / before - 1, "log_ret": F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))})


def change(c: str) -> Column:
    """Relative change on the bar before; from zero it is infinite, and not a number where it stays zero."""
    before = lag(c)
    from_zero = F.when(F.col(c) == 0, float("nan")).when(F.col(c) > 0, float("inf")).when(F.col(c) < 0, float("-inf"))
    return F.when(before != 0, F.col(c) / before - 1).when(before == 0, from_zero)


def momentum(bars: DataFrame, k: int = 20, skip: int = 0, out: str = "mom") -> DataFrame:
    """Return over k bars that ends ``skip`` bars ago."""
    return bars.withColumn(out, (lag("close", skip) if skip else F.col("close")) / lag("close", k) - 1)


def ts_momentum_signal(bars: DataFrame, k: int = 20, threshold: float = 0.0) -> DataFrame:
    """1 where the k-bar return is above the threshold, else 0; 0 while warming."""
    return momentum(bars, k, out="__m").withColumn("signal", F.when(F.col("__m") > threshold, 1).otherwise(0)).drop("__m")


def realized_vol(bars: DataFrame, k: int = 20, periods: int = 252) -> DataFrame:
    """Deviation of the last k returns, annualised: population and sample form; null until k returns are there."""
    r = bars.withColumn("__r", F.col("close") / lag("close") - 1)
    year = periods**0.5
    return r.withColumns({"vol_pop": full(F.stddev_pop("__r"), k, "__r") * year, "vol_sample": full(F.stddev_samp("__r"), k, "__r") * year}).drop("__r")


def sma_filter(bars: DataFrame, lengths: tuple[int, ...] = (10, 20, 40), threshold: float = 0.5) -> DataFrame:
    """above_n: close at or over its n-bar mean, true while warming; above_vote: share of votes at or over threshold."""
    votes = {f"above_{n}": F.coalesce(F.col("close") >= full(F.avg("close"), n), F.lit(True)) for n in lengths}
    out = bars.withColumns(votes)
    share = sum((F.col(c).cast("int") for c in votes), F.lit(0)) / len(votes)
    return out.withColumn("above_vote", share >= threshold)


def true_range(bars: DataFrame) -> DataFrame:
    before = lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("tr", F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(tr))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: mean of the last n true ranges, null while warming; atr_prefix: mean of those there are."""
    return true_range(bars).withColumns({"atr": full(F.avg("tr"), n, "tr"), "atr_prefix": over(F.avg("tr"), n)})


def ema(values: Column, k: float) -> Column:
    """Recursive mean over an array: e = k * x + (1 - k) * e, seeded with the first value."""
    return F.aggregate(values, F.element_at(values, 1).cast("double"), lambda a, x: k * x + (1 - k) * a)


def avg_body(bars: DataFrame, n: int = 10) -> DataFrame:
    """Mean body of the last n bars, and of the n bars before this one."""
    body = F.abs(F.col("close") - F.col("open"))
    return bars.withColumns({"avg_body": over(F.avg(body), n), "avg_body_prior": over(F.avg(body), n, 1)})


def rvol(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over its n-bar mean (this bar included); null while warming or where the mean isn't positive."""
    mean = full(F.avg("volume"), n, "volume")
    return bars.withColumn("rvol", F.when(mean > 0, F.col("volume") / mean))


def obv(bars: DataFrame) -> DataFrame:
    """Signed cumulative volume that starts at the first bar's volume."""
    before = lag("close")
    step = F.when(before.isNull(), F.col("volume")).when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(F.lit(0.0))
    return bars.withColumn("__step", step).withColumn("obv", running(F.sum("__step"))).drop("__step")


def money_flow(bars: DataFrame, n: int = 20) -> DataFrame:
    """adl: cumulative money-flow volume; cmf: its n-bar sum over the volume's."""
    span = F.col("high") - F.col("low")
    mult = F.when(span > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span).otherwise(F.lit(0.0))
    out = bars.withColumn("__mfv", mult * F.col("volume"))
    total = full(F.sum("volume"), n, "volume")
    return out.withColumns({"adl": running(F.sum("__mfv")), "cmf": F.when(total > 0, over(F.sum("__mfv"), n) / total)}).drop("__mfv")


def range_position(bars: DataFrame, n: int = 50) -> DataFrame:
    lo, hi = over(F.min("low"), n), over(F.max("high"), n)
    return bars.withColumn("range_position", F.when(hi > lo, (F.col("close") - lo) / (hi - lo)).otherwise(F.lit(0.5)))


def prior_trend(bars: DataFrame, n: int = 5) -> DataFrame:
    """Sign counts of the high and low changes over the n bars before this one: up, down or neutral at +-2."""
    step = F.signum(F.col("high") - lag("high")) + F.signum(F.col("low") - lag("low"))
    out = bars.withColumn("__step", step).withColumn("trend_score", F.coalesce(full(F.sum("__step"), n - 1, "__step", 1), F.lit(0.0)))
    return out.withColumn("trend", F.when(F.col("trend_score") >= 2, "up").when(F.col("trend_score") <= -2, "down").otherwise("neutral")).drop("__step")


def pivots(bars: DataFrame, left: int = 3, right: int = 3, strict: bool = True) -> DataFrame:
    """Swing highs and lows with the bar that confirms them, right bars later; needs full windows on both sides."""
    before = series().rowsBetween(-left, -1)
    after = series().rowsBetween(1, right)
    enough = (F.count("close").over(before) >= left) & (F.count("close").over(after) >= right)
    hb, ha, lb, la = F.max("high").over(before), F.max("high").over(after), F.min("low").over(before), F.min("low").over(after)
    up = (F.col("high") > hb) & (F.col("high") > ha) if strict else (F.col("high") >= hb) & (F.col("high") >= ha)
    down = (F.col("low") < lb) & (F.col("low") < la) if strict else (F.col("low") <= lb) & (F.col("low") <= la)
    return bars.withColumns({"pivot_high": enough & up, "pivot_low": enough & down, "confirmed_ts": F.lead("ts", right).over(series())})


def pivot_labels(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Pivot rows with HH, LH, EQH or HL, LL, EQL against the previous pivot of the same side; the first has none."""
    p = pivots(bars, left, right)
    each = p.where("pivot_high").select("symbol", "ts", "confirmed_ts", F.lit("high").alias("side"), F.col("high").alias("price")).unionByName(p.where("pivot_low").select("symbol", "ts", "confirmed_ts", F.lit("low").alias("side"), F.col("low").alias("price")))
    prev = F.lag("price").over(Window.partitionBy("symbol", "side").orderBy("ts"))
    label = F.when(prev.isNull(), None).when(F.col("price") > prev, F.when(F.col("side") == "high", "HH").otherwise("HL")).when(F.col("price") < prev, F.when(F.col("side") == "high", "LH").otherwise("LL")).otherwise(F.when(F.col("side") == "high", "EQH").otherwise("EQL"))
    return each.withColumn("label", label)


def streak(bars: DataFrame, value: str = "volume") -> DataFrame:
    """Rows in a row, this one included, on which the value rose."""
    rose = F.coalesce((F.col(value) > lag(value)).cast("int"), F.lit(0))
    out = bars.withColumn("__rose", rose).withColumn("__run", running(F.sum(1 - F.col("__rose"))))
    run = Window.partitionBy("symbol", "__run").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("streak", F.sum("__rose").over(run)).drop("__rose", "__run")


def zscore(bars: DataFrame, value: str = "volume", n: int = 20, least: int = 10, sample: bool = True) -> DataFrame:
    """z of the value in its last n rows; null with fewer than ``least`` of them, 0 where they don't vary."""
    sd = over(F.stddev_samp(value) if sample else F.stddev_pop(value), n)
    return bars.withColumn("z", F.when(over(F.count(value), n) >= least, F.when(sd > 0, (F.col(value) - over(F.avg(value), n)) / sd).otherwise(F.lit(0.0))))


def high_proximity(bars: DataFrame, n: int = 252) -> DataFrame:
    return bars.withColumn("high_proximity", F.col("close") / over(F.max("close"), n))


def edge_trigger(bars: DataFrame, condition: Column) -> DataFrame:
    """Rows on which the condition turns true; a first row that is true counts."""
    return bars.withColumn("__on", F.coalesce(condition, F.lit(False))).withColumn("__was", F.coalesce(lag("__on"), F.lit(False))).where("__on AND NOT __was").drop("__on", "__was")


def index_in_range(bars: DataFrame, value: str, n: int) -> DataFrame:
    """(x - min) / (max - min) * 100 over n rows; 50 where flat, null while warming."""
    lo, hi = over(F.min(value), n), over(F.max(value), n)
    return bars.withColumn("index", F.when(over(F.count(value), n) >= n, F.when(hi > lo, (F.col(value) - lo) / (hi - lo) * 100).otherwise(F.lit(50.0))))


def beta_residual(bars: DataFrame, bench: DataFrame, n: int = 26, k: int = 12) -> DataFrame:
    """Trailing beta to the benchmark (ts, bench) over n returns, and the k-bar momentum without beta times its own."""
    b = bench.withColumn("__br", F.col("bench") / F.lag("bench").over(Window.orderBy("ts")) - 1).withColumn("__bm", F.col("bench") / F.lag("bench", k).over(Window.orderBy("ts")) - 1)
    x = momentum(bars, k, out="__m").withColumn("__r", F.col("close") / lag("close") - 1).join(b.select("ts", "__br", "__bm"), "ts")
    cov, var = over(F.covar_samp("__r", "__br"), n), over(F.var_samp("__br"), n)
    beta = F.when((over(F.count("__r"), n) >= n) & (var > 1e-12), cov / var)
    return x.withColumn("beta", beta).withColumn("residual_mom", F.col("__m") - F.col("beta") * F.col("__bm")).drop("__m", "__r", "__br", "__bm")
