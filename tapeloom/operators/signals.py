"""Volume, open-interest and pair signals over bars: windows of one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import close_location
from tapeloom.operators import features as f

def spread() -> Column:
    return F.col("high") - F.col("low")


def spread_ratio(n: int = 14) -> Column:
    """Range over its n-bar mean, this bar included; null while warming or where the mean is 0."""
    mean = f.full(F.avg(spread()), n)
    return F.when(mean > 0, spread() / mean)


def effort_result(bars: DataFrame) -> DataFrame:
    """Much volume for little range, or much range for little volume."""
    b = f.rvol(bars).withColumn("ratio", spread_ratio())
    up = F.col("close") > F.col("open")
    label = F.when((F.col("rvol") >= 2.0) & (F.col("ratio") < 0.7), F.when(up, "absorption").otherwise("selling_pressure_test")).when((F.col("rvol") < 0.7) & (F.col("ratio") > 1.4), F.when(up, "effortless_rise").otherwise("effortless_fall"))
    return b.withColumn("evr", F.coalesce(label, F.lit("neutral")))


def no_supply_demand(bars: DataFrame) -> DataFrame:
    """Narrow bars on less volume than the two before: no_supply (falling), no_demand (rising), each strong or weak by
    where they close, and the confirmation on the next bar's close."""
    quiet = (spread_ratio() < 0.6) & (F.col("volume") < F.least(f.lag("volume", 1), f.lag("volume", 2))) & f.lag("volume", 2).isNotNull()
    at = close_location(F.col("high"), F.col("low"), F.col("close"))
    down, up = F.col("close") < F.col("open"), F.col("close") > F.col("open")
    no = F.lit(False)
    b = bars.withColumns({
        "no_supply": F.coalesce(quiet & down & (at == "high"), no), "no_supply_weak": F.coalesce(quiet & down & (at == "mid"), no),
        "no_demand": F.coalesce(quiet & up & (at == "low"), no), "no_demand_weak": F.coalesce(quiet & up & (at == "mid"), no),
    })
    return b.withColumns({
        "no_supply_confirmed": F.coalesce(f.lag("no_supply") & (F.col("close") > f.lag("close")), no),
        "no_demand_confirmed": F.coalesce(f.lag("no_demand") & (F.col("close") < f.lag("close")), no),
    })


def climax(bars: DataFrame, lookback: int = 20, rvol_least: float = 3.0) -> DataFrame:
    """top, bottom, bottom_weak or none: heavy volume and range at a new extreme close, without a gap above 3 per cent."""
    b = f.rvol(bars).withColumns({"ratio": spread_ratio(), "__at": close_location(F.col("high"), F.col("low"), F.col("close")), "__max": f.full(F.max("close"), lookback, "close", 1), "__min": f.full(F.min("close"), lookback, "close", 1)})
    before, step = f.lag("close"), F.abs(F.col("open") - f.lag("close"))
    gap = F.when(before > 0, step / before > 0.03).otherwise(step > 0)
    ok = (F.col("rvol") >= rvol_least) & (F.col("ratio") > 1.4) & ~F.coalesce(gap, F.lit(False))
    top = ok & (F.col("close") > F.col("open")) & F.col("__at").isin("mid", "low") & (F.col("close") > F.col("__max"))
    low = ok & (F.col("close") < F.col("open")) & (F.col("close") < F.col("__min"))
    label = F.when(top, "top").when(low & (F.col("__at") == "high"), "bottom").when(low & (F.col("__at") == "mid"), "bottom_weak").otherwise("none")
    return b.withColumn("climax", label).drop("__at", "__max", "__min")


def dry_up(bars: DataFrame, n: int = 5, below: float = 0.5) -> DataFrame:
    """vdu: n bars of low relative volume that never rises, while the range contracts in their later half."""
    b = f.rvol(bars).withColumns({"__low": (F.col("rvol") < below).cast("int"), "__fall": (F.col("volume") <= f.lag("volume")).cast("int")})
    half = n // 2
    early, late = F.max(spread()).over(f.series().rowsBetween(-(n - 1), -(n - half))), f.over(F.max(spread()), n - half)
    ok = (f.over(F.sum("__low"), n) == n) & (f.over(F.sum("__fall"), n - 1) == n - 1) & (late < early)
    return b.withColumn("vdu", F.coalesce(ok, F.lit(False))).drop("__low", "__fall")


def volume_bar(bars: DataFrame) -> DataFrame:
    """Every volume feature of a bar; identical windows share one sort."""
    return f.money_flow(f.obv(climax(dry_up(no_supply_demand(effort_result(bars).drop("rvol", "ratio"))).drop("rvol")))).withColumn("avg_volume", f.over(F.avg("volume"), 20))


def capitulation(bars: DataFrame, n: int = 50, fall: float = 0.3) -> DataFrame:
    """capitulation: open interest (volume here) at least ``fall`` below its n-bar maximum; divergence: a close above all
    n before it while the open interest stays under its maximum, or the mirror."""
    top = f.over(F.max("volume"), n)
    high, low = f.over(F.max("close"), n, 1), f.over(F.min("close"), n, 1)
    div = F.when((F.col("close") > high) & (F.col("volume") < top), "bearish").when((F.col("close") < low) & (F.col("volume") < top), "bullish").otherwise("none")
    return bars.withColumns({"capitulation": F.when(top > 0, (top - F.col("volume")) / top >= fall).otherwise(F.lit(False)), "divergence": div})


def squeeze_cascade(price_move: Column, oi_move: Column, funding: Column, z: Column) -> dict[str, Column]:
    """Crowded and building positions; and a large move that empties them."""
    heavy = funding.isin("heavy_long", "heavy_short")
    return {"squeeze": F.coalesce(heavy & (oi_move > 0) & (z >= 1.0), F.lit(False)), "cascade": F.coalesce((F.abs(price_move) >= 0.02) & (oi_move <= -0.03), F.lit(False))}


def rolling_pair(pairs: DataFrame, by: list[str], n: int = 26) -> DataFrame:
    """z of today's spread against the line fitted on the n rows before today. pairs: (by, ts, y, x)."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(-n, -1)
    var, cov = F.var_pop("x").over(w), F.covar_pop("y", "x").over(w)
    p = pairs.withColumn("hedge", F.when((F.count("*").over(w) >= n) & (var > 0), cov / var))
    p = p.withColumn("__a", F.avg("y").over(w) - F.col("hedge") * F.avg("x").over(w))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.var_pop("y").over(w) - F.col("hedge") * cov))
    return p.withColumn("z", F.when(sd > 1e-12, (F.col("y") - F.col("__a") - F.col("hedge") * F.col("x")) / sd)).drop("__a")


def pair_state(pairs: DataFrame, by: list[str], *, lookback: int = 104, least: int = 60, entry: float = 2.0, leave: float = 0.5) -> DataFrame:
    """The last spread of each pair against the line fitted on its last ``lookback`` common rows. pairs: (by, ts, y, x).

    n, hedge, corr, z (rounded), half_life of the spread and state (entry, exit, watch); null but for n where a pair has
    fewer than ``least`` rows or no variance. Everything comes from one
    aggregation: the spread's own regression on its lag is a quadratic form of the prices' covariances.
    """
    newest = Window.partitionBy(*by).orderBy(F.desc("ts"))
    own = Window.partitionBy(*by).orderBy("ts")
    p = pairs.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= lookback)
    p = p.withColumns({"__y": F.lag("y").over(own), "__x": F.lag("x").over(own)}).withColumns({"__dy": F.col("y") - F.col("__y"), "__dx": F.col("x") - F.col("__x")})
    mean = {c: F.avg(c).alias(f"m_{c}") for c in ("y", "x")}
    moved = {f"{a}_{b}": F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in (("__dy", "__y"), ("__dy", "__x"), ("__dx", "__y"), ("__dx", "__x"), ("__y", "__x"))}
    g = p.groupBy(*by).agg(
        F.count("*").alias("n"), *mean.values(), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("y", "x").alias("c"), F.corr("y", "x").alias("corr"), F.max_by(F.struct("y", "x"), "ts").alias("last"),
        *moved.values(), F.var_pop("__y").alias("vly"), F.var_pop("__x").alias("vlx"),
    ).withColumn("hedge", F.when((F.col("n") >= least) & (F.col("vx") > 0), F.col("c") / F.col("vx")))
    b = F.col("hedge")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - b * F.col("c")))
    z = F.round(F.when(sd > 1e-12, (F.col("last.y") - F.col("m_y") - b * (F.col("last.x") - F.col("m_x"))) / sd), 4)
    cov = F.col("__dy___y") - b * F.col("__dy___x") - b * F.col("__dx___y") + b * b * F.col("__dx___x")
    var = F.col("vly") - 2 * b * F.col("__y___x") + b * b * F.col("vlx")
    slope = F.when(var > 0, cov / var)
    g = g.withColumns({"z": z, "corr": F.when(b.isNotNull(), F.col("corr"))}).withColumn("half_life", F.when(F.col("z").isNotNull() & (slope < 0), -F.log(F.lit(2.0)) / slope))
    return g.withColumn("state", F.when(F.abs("z") >= entry, "entry").when(F.abs("z") <= leave, "exit").when(F.col("z").isNotNull(), "watch"))


def pair_positions(pairs: DataFrame, by: list[str], *, n: int = 26, entry: float = 2.0, leave: float = 0.5, cost: float = 0.0004, trades: int = 3, drawdown: float = 0.2) -> DataFrame:
    """rolling_pair() with the position that is held, its return to the next row, and whether the pair passes its gates.

    A row of |z| >= entry opens against the spread, one of |z| <= leave closes, and between them the last such row
    holds: that is one window, no loop. All windows share the partitioning of the fit.
    """
    own = Window.partitionBy(*by).orderBy("ts")
    upto, whole = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*by)
    p = rolling_pair(pairs.withColumns({"__ny": F.lead("y").over(own), "__nx": F.lead("x").over(own)}), by, n).where("z IS NOT NULL")
    near = F.round("z", 6)
    mark = F.when(F.abs(near) <= leave, F.lit(0.0)).when(F.abs(near) >= entry, -F.signum(near))
    p = p.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0.0)))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(own), F.lit(0.0)))
    p = p.withColumn("__turn", F.when(F.col("__ny").isNotNull(), turn))
    p = p.withColumn("gross", F.col("position") * (F.col("__ny") - F.col("y") - F.col("hedge") * (F.col("__nx") - F.col("x"))) / (1 + F.abs("hedge"))).withColumn("net", F.col("gross") - cost * F.col("__turn"))
    p = p.withColumn("__equity", F.product(1 + F.col("net")).over(upto)).withColumn("__fall", 1 - F.col("__equity") / F.greatest(F.lit(1.0), F.max("__equity").over(upto)))
    opened = F.sum(((F.col("__turn") > 0) & (F.col("position") != 0)).cast("int")).over(whole)
    gates = (opened >= trades) & (F.round(F.product(1 + F.col("net")).over(whole) - 1, 9) > 0) & (F.round(F.avg("net").over(whole), 12) >= 0) & (F.round(F.max("__fall").over(whole), 9) <= drawdown)
    return p.withColumn("passed", F.coalesce(gates, F.lit(False)))


def half_life(series: DataFrame, by: list[str], value: str) -> DataFrame:
    """-ln 2 / slope of the change on the level before it; null unless the slope is negative."""
    w = Window.partitionBy(*by).orderBy("ts")
    s = series.withColumn("__l", F.lag(value).over(w)).withColumn("__d", F.col(value) - F.col("__l")).where("__l IS NOT NULL")
    slope = F.covar_pop("__d", "__l") / F.var_pop("__l")
    return s.groupBy(*by).agg(F.when(slope < 0, -F.log(F.lit(2.0)) / slope).alias("half_life"))


def technical_profile(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Distances, momenta, volatility, drawdown and beta against bench (ts, bench) of each series at its last bar."""
    b = f.realized_vol(f.high_proximity(bars.join(bench.select("ts", "bench"), "ts")), 63)
    b = b.withColumns({"__y": F.col("close") / f.lag("close") - 1, "__x": F.col("bench") / f.lag("bench") - 1})
    b = b.withColumn("beta", f.over(F.covar_pop("__y", "__x"), 252) / F.nullif(f.over(F.var_pop("__x"), 252), F.lit(0.0)))
    b = b.withColumns({"from_low": F.col("close") / f.over(F.min("close"), 252) - 1, "mom_12_1": f.lag("close", 21) / f.lag("close", 252) - 1, "mom_3m": F.col("close") / f.lag("close", 63) - 1, "mom_1m": F.col("close") / f.lag("close", 21) - 1, "dd": 1 - F.col("close") / f.over(F.max("close"), 252)})
    b = b.withColumn("max_dd", f.over(F.max("dd"), 252)).withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    return b.where("__n = 1").drop("__n", "dd")


def level_percentile(bars: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """Share of the last n closes at or under today's, distances from the 200-bar mean, the n-bar high and the 60-bar low."""
    past = F.collect_list("close").over(f.last(n))
    share = F.size(F.filter("__past", lambda x: x <= F.col("close"))) / F.size("__past")
    b = bars.withColumn("__past", past).withColumn("percentile", F.when(F.size("__past") >= least, share)).drop("__past")
    return b.withColumns({"ma_distance": F.col("close") / f.full(F.avg("close"), 200) - 1, "drawdown": F.col("close") / f.over(F.max("close"), n) - 1, "off_low": F.col("close") / f.over(F.min("close"), 60) - 1})
