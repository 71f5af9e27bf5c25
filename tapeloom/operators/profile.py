"""Volume by price: bins of equal width per window, each bar's volume spread over the bins that its range overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def volume_profile(bars: DataFrame, keys: list[str], bins: int = 24) -> DataFrame:
    """(keys, bin, lo, hi, volume). A bar without range gives all its volume to one bin."""
    w = Window.partitionBy(*keys)
    b = bars.withColumns({"__lo": F.min("low").over(w), "__hi": F.max("high").over(w)}).withColumn("__step", (F.col("__hi") - F.col("__lo")) / bins).where("__step > 0")
    place = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("__lo")) / F.col("__step"))).cast("int")
    b = b.withColumn("bin", F.explode(F.sequence(place("low"), place("high"))))
    lo = F.col("__lo") + F.col("bin") * F.col("__step")
    span = F.col("high") - F.col("low")
    part = F.when(span > 0, F.greatest(F.lit(0.0), F.least("high", lo + F.col("__step")) - F.greatest("low", lo)) / span).otherwise(F.lit(1.0))
    return b.groupBy(*keys, "bin").agg(F.min(lo).alias("lo"), F.min(lo + F.col("__step")).alias("hi"), F.sum(F.col("volume") * part).alias("volume"))


def point_of_control(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The bin of the largest volume, the lowest one among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("volume", 6)), "bin")
    return profile.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def nodes(profile: DataFrame, keys: list[str], high: float = 0.7, low: float = 0.2) -> DataFrame:
    """Runs of bins above ``high`` or below ``low`` of the largest volume, as (kind, lo, hi, volume)."""
    top = F.max("volume").over(Window.partitionBy(*keys))
    p = profile.withColumn("kind", F.when(F.col("volume") >= high * top, "HVN").when(F.col("volume") <= low * top, "LVN"))
    order = Window.partitionBy(*keys).orderBy("bin")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(order)) | (F.col("bin") != F.lag("bin").over(order) + 1), F.lit(True))
    p = p.where("kind IS NOT NULL").withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return p.groupBy(*keys, "kind", "__run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("volume").alias("volume")).drop("__run")
