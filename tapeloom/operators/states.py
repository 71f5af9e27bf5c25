"""Order-dependent detectors: one pass over each series in time order.

Recursive means run in the JVM, in blocks; what feeds back on itself passes through operators/fold.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import features as f


RUN = 128  # rows of a series that one step of a recurrence spans


def recurrence(series: DataFrame, value: str, k: float, out: str) -> DataFrame:
    """series (symbol, ts, ...) with out = k * value + (1 - k) * the row before's out, seeded with the first value.

    In blocks of RUN rows: a running sum of rescaled values gives what a block adds, one row a block carries the state
    across (the only collected part, a 128th of a series), and both meet again on the block.
    """
    keep = 1 - k
    n = series.withColumn("__n", F.row_number().over(f.series()) - 1).withColumns({"__b": F.floor(F.col("__n") / RUN), "__i": F.col("__n") % RUN})
    scaled = F.when(F.col("__n") == 0, F.col(value)).otherwise(k * F.col(value)) * F.pow(F.lit(keep), -F.col("__i"))
    within = Window.partitionBy("symbol", "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("__own", F.sum(scaled).over(within) * F.pow(F.lit(keep), F.col("__i")))
    ends = n.groupBy("symbol", "__b").agg(F.max_by("__own", "__i").alias("own"), F.pow(F.lit(keep), F.max("__i") + 1).alias("keep"))
    start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("out"))
    carried = F.aggregate("s", start, lambda a, x: F.struct((x["keep"] * a["e"] + x["own"]).alias("e"), F.array_append(a["out"], a["e"]).alias("out")))["out"]
    before = ends.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("__b", "own", "keep"))).alias("s")).select("symbol", F.explode(F.arrays_zip(F.col("s.__b").alias("b"), carried.alias("e"))).alias("z")).select("symbol", F.col("z.b").alias("__b"), F.col("z.e").alias("__before"))
    return n.join(before, ["symbol", "__b"]).withColumn(out, F.col("__own") + F.pow(F.lit(keep), F.col("__i") + 1) * F.col("__before")).drop("__n", "__b", "__i", "__own", "__before")


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, ts, atr): the mean of the first n true ranges, then atr + (tr - atr) / n; null before that."""
    t = f.true_range(bars).withColumns({"__r": F.row_number().over(f.series()), "__mean": f.over(F.avg("tr"), n)})
    t = t.select("symbol", "ts", "__r", F.when(F.col("__r") == n, F.col("__mean")).otherwise(F.col("tr")).alias("tr"))
    warm = t.where(F.col("__r") < n).select("symbol", "ts", F.lit(None).cast("double").alias("atr"))
    return warm.unionByName(recurrence(t.where(F.col("__r") >= n), "tr", 1 / n, "atr").select("symbol", "ts", "atr"))


def obv_ema(bars: DataFrame, period: int = 20) -> DataFrame:
    """(symbol, ts, obv, ema): exponential mean of the on-balance volume, seeded with its first value."""
    return recurrence(f.obv(bars).select("symbol", "ts", "obv"), "obv", 2 / (period + 1), "ema")


def drawdown_latch(nav: DataFrame, stop: float = 0.08, resume: float = 0.03) -> DataFrame:
    """invested: off from a drawdown of ``stop`` on until it is under ``resume`` again. nav: (symbol, ts, drawdown).

    The state is that of the last row that crossed either limit, found by one window.
    """
    mark = F.when(F.col("drawdown") >= stop, F.lit(False)).when(F.col("drawdown") <= resume, F.lit(True))
    return nav.withColumn("invested", F.coalesce(F.last(mark, ignorenulls=True).over(f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(True)))
