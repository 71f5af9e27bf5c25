"""Aggregations over return and price series; each is one partial aggregation or one window."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import features as f


def rebucket(bars: DataFrame, n: int, day: Column) -> DataFrame:
    """Every n bars of a series and day become one; the day's last bucket may be shorter."""
    k = Window.partitionBy("symbol", "__day").orderBy("ts")
    b = bars.withColumn("__day", day).withColumn("bucket", F.floor((F.row_number().over(k) - 1) / n))
    return b.groupBy("symbol", "__day", "bucket").agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).drop("__day", "bucket")


def percentiles(rows: DataFrame, by: str, value: str, at: dict[str, float], *, accuracy: int = 2000, margin: float = 0.004, small: int = 10_000) -> DataFrame:
    """(by, a column for each of ``at``): exact percentiles of the values that aren't null, linear between neighbours.

    Sketches of bounded size give bounds around each percentile, ``margin`` of the rows to either side, eight times what
    the sketch may err; of a group of ``small`` rows or fewer, its ends. What lies below is counted, and the distinct values between the bounds
    are counted up by a window. No task holds the values of a group.
    For few groups: their bounds, a row a group, are broadcast.
    """
    x = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v"))
    around = [min(1.0, max(0.0, p + side)) for p in at.values() for side in (-margin, margin)]
    sketch = F.percentile_approx("__v", around, accuracy)  # one sketch for all
    marks = x.groupBy(by).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__s"))
    few = F.col("__n") <= small
    bounds = [F.when(few, F.col(end)).otherwise(F.col("__s")[2 * i + up]).alias(f"__{mark}_{k}") for i, k in enumerate(at) for up, mark, end in ((0, "lo", "__min"), (1, "hi", "__max"))]
    j = x.join(F.broadcast(marks.select(F.col(by).alias("__by"), "__n", *bounds)), F.col(by).eqNullSafe(F.col("__by")))
    below = j.groupBy(by).agg(F.first("__n").alias("__n"), *(F.count(F.when(F.col("__v") < F.col(f"__lo_{k}"), 1)).alias(f"__b_{k}") for k in at))
    between = F.filter(F.array(*(F.when(F.col("__v").between(F.col(f"__lo_{k}"), F.col(f"__hi_{k}")), F.lit(k)) for k in at)), lambda m: m.isNotNull())
    inside = j.where(reduce(or_, (F.col("__v").between(F.col(f"__lo_{k}"), F.col(f"__hi_{k}")) for k in at))).select(by, "__v", F.explode(between).alias("__k")).groupBy(by, "__k", "__v").agg(F.count("*").alias("__c"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), F.col(f"__b_{k}").alias("b")) for k, p in at.items())))
    below = below.select(by, "__n", kinds.alias("m")).select(by, F.col("m.k").alias("__k"), F.col("m.p").alias("__p"), "__n", F.lit(None).cast("double").alias("__v"), F.col("m.b").alias("__c"))
    c = below.unionByName(inside, allowMissingColumns=True)
    of = Window.partitionBy(by, "__k")
    c = c.withColumns({"__p": F.max("__p").over(of), "__n": F.max("__n").over(of)})
    upto = F.sum("__c").over(Window.partitionBy(by, "__k").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("__p") * (F.col("__n") - 1)
    c = c.withColumns({"__end": upto, "__low": F.floor(rank), "__high": F.ceil(rank), "__part": rank - F.floor(rank)})
    holds = lambda r: (F.col("__end") > F.col(r)) & (F.col("__end") - F.col("__c") <= F.col(r))
    ranked = c.groupBy(by, "__k").agg(*(F.max(F.when(holds(r), F.col("__v"))).alias(r) for r in ("__low", "__high")), F.max("__part").alias("__part"))
    missed = F.col("__low").isNull() | F.col("__high").isNull()
    exact = F.when(missed, F.raise_error(F.lit("a percentile lies outside the bounds of its sketch"))).otherwise((1 - F.col("__part")) * F.col("__low") + F.col("__part") * F.col("__high"))
    return ranked.withColumn("__x", exact).groupBy(by).agg(*(F.max(F.when(F.col("__k") == k, F.col("__x"))).alias(k) for k in at))


def moments(x: str | Column) -> list[Column]:
    """Population skewness, and kurtosis that is 3 for a normal series."""
    return [F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")]


def sharpe(x: str | Column, periods: int, sample: bool = True) -> Column:
    """Mean over deviation, annualised; 0 where the series is flat or has one value."""
    sd = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.avg(x) / sd * periods**0.5).otherwise(F.lit(0.0))


def drawdowns(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """series with the distance of the value below its running maximum, as a positive share."""
    peak = F.max(value).over(Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return series.withColumn("drawdown", 1 - F.col(value) / peak)


def ols(y: str, x: str) -> list[Column]:
    """Least squares of y on x: slope, intercept, r2 and the deviation of the residuals."""
    slope = F.covar_pop(y, x) / F.var_pop(x)
    r2 = F.corr(y, x) * F.corr(y, x)
    return [slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), r2.alias("r2"), F.sqrt(F.greatest(F.lit(0.0), F.var_pop(y) * (1 - r2))).alias("resid_sd")]


def weighted_score(score: Column, weight: Column) -> Column:
    """sum(w * d) / sum(w) * 100, within 0 and 100; 0 where there is no weight."""
    total = F.sum(weight)
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.sum(weight * score) / total * 100))).otherwise(F.lit(0.0))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 0 for no trial."""
    p, z2 = wins / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def exposure(value: Column, equity: Column) -> list[Column]:
    """Gross, net, long and short exposure over equity."""
    return [(F.sum(F.abs(value)) / equity).alias("gross"), (F.sum(value) / equity).alias("net"), (F.sum(F.greatest(value, F.lit(0.0))) / equity).alias("long"), (F.sum(F.least(value, F.lit(0.0))) / equity).alias("short")]


def annual_returns(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    return series.groupBy(by, F.year("ts").alias("year")).agg((F.max_by(value, "ts") / F.min_by(value, "ts") - 1).alias("ret"))


def beta(series: DataFrame, y: str, x: str, by: str, n: int = 126, least: int = 30) -> DataFrame:
    """Beta and correlation over the last n rows of each series; 0 with fewer than ``least`` or no variance."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"))
    tail = series.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    ok = (F.count("*") >= least) & (F.var_samp(x) >= 1e-12)
    return tail.groupBy(by).agg(F.when(ok, F.covar_samp(y, x) / F.var_samp(x)).otherwise(0.0).alias("beta"), F.when(ok, F.corr(y, x)).otherwise(0.0).alias("corr"))


def return_profile(bars: DataFrame, lengths: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    """Per cent returns over the last k bars of each series, from its first bar where it is shorter."""
    first = F.first("close").over(f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = bars.withColumns({f"ret_{k}": (F.col("close") / F.coalesce(f.lag("close", k), first) - 1) * 100 for k in lengths})
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("__n = 1").drop("__n")
