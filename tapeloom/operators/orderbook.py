"""Order-book measures over arrays of levels, best first: higher-order functions on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import features as f


def total(levels: Column, n: int, weight: float = 1.0) -> Column:
    """Sum of the sizes of the first n levels, each weighted ``weight`` to its place."""
    return F.aggregate(F.transform(F.slice(levels, 1, n), lambda x, i: x["size"] * F.pow(F.lit(weight), i)), F.lit(0.0), lambda a, x: a + x)


def imbalance(bids: Column, asks: Column, n: int = 5, weight: float = 1.0) -> Column:
    """(bid - ask) / (bid + ask) size over n levels; 0 for empty books."""
    b, a = total(bids, n, weight), total(asks, n, weight)
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(F.lit(0.0))


def micro_price(bids: Column, asks: Column) -> Column:
    b, a = bids[0], asks[0]
    return (b["price"] * a["size"] + a["price"] * b["size"]) / (a["size"] + b["size"])


def spread_pct(bids: Column, asks: Column) -> Column:
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    return (asks[0]["price"] - bids[0]["price"]) / mid * 100


def depth(levels: Column, mid: Column, band: float) -> Column:
    """Size within ``band`` of the middle price."""
    near = F.filter(levels, lambda x: F.abs(x["price"] - mid) <= band * mid)
    return F.aggregate(F.transform(near, lambda x: x["size"]), F.lit(0.0), lambda a, x: a + x)


def median_size(levels: Column, n: int) -> Column:
    s = F.sort_array(F.transform(F.slice(levels, 1, n), lambda x: x["size"]))
    k = F.size(s)
    return (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2


def walls(books: DataFrame, *, n: int = 10, times: float = 5.0, far: float = 0.02) -> DataFrame:
    """books with walls: levels (side, price, size, suspect) of a size above ``times`` the median of the first n of their side.

    A wall is suspect if it is further off the middle than ``far``, or was none in the series' snapshot before.
    """
    mid = (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2
    out = books.withColumn("__mid", mid)
    for side in ("bids", "asks"):
        out = out.withColumn("__median", median_size(F.col(side), n))
        out = out.withColumn(f"__{side}", F.filter(F.slice(side, 1, n), lambda x: x["size"] > times * F.col("__median")))
        out = out.withColumn(f"__{side}0", F.lag(F.transform(f"__{side}", lambda x: x["price"])).over(f.series()))
    parts = [_walls_of(side, far) for side in ("bids", "asks")]
    return out.withColumn("walls", F.concat(*parts)).drop("__mid", "__median", *(f"__{side}{k}" for side in ("bids", "asks") for k in ("", "0")))


def _walls_of(side: str, far: float) -> Column:
    off = lambda x: (F.abs(x["price"] - F.col("__mid")) > far * F.col("__mid")) | F.coalesce(~F.array_contains(F.col(f"__{side}0"), x["price"]), F.lit(False))
    return F.transform(f"__{side}", lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size"), off(x).alias("suspect")))


def signal(books: DataFrame, *, n: int = 10, window: int = 60, least: int = 10, wide: float = 0.10, strong: float = 0.6, mild: float = 0.2, near: float = 0.01, times: float = 5.0, far: float = 0.02) -> DataFrame:
    """books with obi, z, direction and strength; crossed, unsorted or empty books are left out.

    WAIT where the spread is wide or the imbalance is within one z of its last ``window``; LONG (SHORT) where it is
    strong, the micro price agrees and no wall that is not suspect stands against it within ``near`` of the middle.
    """
    b = walls(books.where(valid(F.col("bids"), F.col("asks"))).withColumn("obi", imbalance(F.col("bids"), F.col("asks"), n, 0.5)), n=n, times=times, far=far)
    sd = F.stddev_samp("obi").over(f.last(window))
    b = b.withColumn("z", F.when(F.count("obi").over(f.last(window)) >= least, F.when(sd > 1e-12, (F.col("obi") - F.avg("obi").over(f.last(window))) / sd).otherwise(0.0)))
    mid = (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2
    lean = micro_price(F.col("bids"), F.col("asks")) - mid
    against = lambda side: F.exists("walls", lambda w: (w["side"] == side) & ~w["suspect"] & (F.abs(w["price"] - mid) <= near * mid))
    calm = F.coalesce(F.abs(F.round("z", 9)) <= 1, F.lit(False))
    o = F.round("obi", 9)
    d = F.when(spread_pct(F.col("bids"), F.col("asks")) > wide, "WAIT").when(F.abs(o) < mild, "NEUTRAL").when(calm, "WAIT")
    d = d.when((o >= strong) & (lean > 0) & ~against("asks"), "LONG").when((o <= -strong) & (lean < 0) & ~against("bids"), "SHORT").when(F.abs(o) >= strong, "WAIT").otherwise("NEUTRAL")
    return b.withColumn("direction", d).withColumn("strength", F.when(F.col("direction").isin("LONG", "SHORT"), F.least(F.lit(1.0), F.abs("obi"))).otherwise(0.0))


def valid(bids: Column, asks: Column) -> Column:
    """Neither crossed nor unsorted nor empty."""
    falling = F.forall(F.sequence(F.lit(1), F.size(bids) - 1), lambda i: F.get(bids, i - 1)["price"] > F.get(bids, i)["price"])
    rising = F.forall(F.sequence(F.lit(1), F.size(asks) - 1), lambda i: F.get(asks, i - 1)["price"] < F.get(asks, i)["price"])
    return (F.size(bids) > 1) & (F.size(asks) > 1) & (bids[0]["price"] < asks[0]["price"]) & falling & rising
