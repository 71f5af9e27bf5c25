"""Market structure: pivots with their labels, breaks, changes of character, liquidity pools, sweeps and shifts.

Pivots, labels and the two-pivot bias are windows over (symbol, ts); what feeds back on itself (a change of character
overrides the bias that decides on the next one) is a fold with a few numbers of state. Every event stands at the bar
that lets it be known, so later bars change none before them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tapeloom.operators import features as f
from tapeloom.operators.fold import Machine, fold, schema_of

#: Pivots of the two scopes (bars on either side), and how near two prices are equal.
SCOPES = {"swing": 5, "internal": 3}
EQUAL = 0.0015
NAMES = {1: "BULLISH", -1: "BEARISH", 0: "RANGING"}


def _before() -> Window:
    return f.series().rowsBetween(Window.unboundedPreceding, -1)


def _upto() -> Window:
    return f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def confirmed_pivots(bars: DataFrame, side: int, *, equal: float = EQUAL) -> DataFrame:
    """bars with n and, at the bar that confirms a pivot: up, up_label, down, down_label; and geo, the two-pivot bias.

    A label compares a pivot with the one before it: HH, LH or EQH for highs, LL, HL or EQL for lows, the first HH or
    LL. geo is 1 (-1) if the last two unequal highs and the last two unequal lows both rise (fall), else 0.
    """
    p = f.pivots(bars, side, side).withColumn("n", F.row_number().over(f.series()))
    p = p.withColumns({"up": f.lag(F.when(F.col("pivot_high"), F.col("high")), side), "down": f.lag(F.when(F.col("pivot_low"), F.col("low")), side)})
    for c, more, less, same in (("up", "HH", "LH", "EQH"), ("down", "HL", "LL", "EQL")):
        last = F.last(c, ignorenulls=True).over(_before())
        top = F.greatest(F.col(c), last)
        even = F.when(top > 0, F.abs(F.col(c) - last) / top <= equal).otherwise(F.col(c) == last)
        first = "HH" if c == "up" else "LL"
        p = p.withColumn(f"{c}_label", F.when(F.col(c).isNull(), None).when(last.isNull(), first).when(even, same).when(F.col(c) > last, more).otherwise(less))
        p = p.withColumn("__x", F.when(~F.col(f"{c}_label").startswith("EQ"), F.col(c)))
        p = p.withColumn("__y", F.when(F.col("__x").isNotNull(), F.last("__x", ignorenulls=True).over(_before())))
        p = p.withColumns({f"__{c}1": F.last("__x", ignorenulls=True).over(_upto()), f"__{c}2": F.last("__y", ignorenulls=True).over(_upto())})
    rise = (F.col("__up1") > F.col("__up2")) & (F.col("__down1") > F.col("__down2"))
    fall = (F.col("__up1") < F.col("__up2")) & (F.col("__down1") < F.col("__down2"))
    geo = F.when(rise, 1).when(fall, -1).otherwise(0)
    return p.withColumn("geo", geo).drop("__x", "__y", "__up1", "__up2", "__down1", "__down2", "pivot_high", "pivot_low", "confirmed_ts")


def beyond(price: float, level: float) -> float:
    """How far a price is off a level, as a share of it; infinite for a level of zero."""
    return abs(price - level) / level if level else math.inf


class Breaks(Machine):
    """Breaks of structure of one series and scope.

    target: per side the newest pivot not yet broken; guard: the newest higher low (side 1) or lower high (side -1),
    whose loss turns the bias; held: a turned bias, which stands until a pivot after it brings the geometry round.
    """

    def __init__(self, by_close: bool = True, least: float = 0.0):
        self.by_close, self.least = by_close, least
        self.target, self.newest, self.guard = {1: None, -1: None}, {1: None, -1: None}, {1: None, -1: None}
        self.held, self.anchor, self.last_pivot = 0, -1, -1

    def step(self, row: dict) -> list[dict]:
        n, pivots, out = row["n"], [], []
        for side, price, label in ((1, row["up"], row["up_label"]), (-1, row["down"], row["down_label"])):
            if price is None:
                continue
            at = n - row["side"]
            self.target[side] = self.newest[side] = (price, at)
            self.last_pivot = max(self.last_pivot, at)
            if label == ("LH" if side > 0 else "HL"):
                self.guard[-side] = (price, at)
            pivots.append((price, label, at))
        bias = row["geo"]
        if self.held:
            if self.last_pivot > self.anchor and bias == self.held:
                self.held = 0
            else:
                bias = self.held
        if bias:
            ahead, behind = (row["high"], row["low"])[:: bias]
            reach, risk = (row["close"], row["close"]) if self.by_close else (ahead, behind)
            if (t := self.target[bias]) is not None:
                if bias * (reach - t[0]) > 0:
                    if beyond(reach, t[0]) >= self.least:
                        out.append(self._told(row, "BOS", bias, t, bias, beyond(reach, t[0])))
                        self.target[bias] = None
                elif self.by_close and bias * (ahead - t[0]) > 0:
                    out.append(self._told(row, "SWEEP", bias, t, bias, None))
            if (g := self.guard[bias]) is not None and bias * (g[0] - risk) > 0 and beyond(risk, g[0]) >= self.least:
                out.append(self._told(row, "CHOCH", -bias, g, bias, beyond(risk, g[0])))
                self.guard[bias] = None
                bias = self.held = -bias
                self.anchor = self.last_pivot
                self.target = {s: self.newest[s] or self.target[s] for s in (1, -1)}
        seen = [self._told(row, "PIVOT", 0, (price, at), bias, None) | {"label": label} for price, label, at in pivots]
        return seen + out

    def _told(self, row: dict, kind: str, direction: int, level: tuple, bias: int, strength: float | None) -> dict:
        return {"ts": row["ts"], "n": row["n"], "kind": kind, "direction": NAMES[direction] if direction else None, "level": level[0], "label": None, "bias": NAMES[bias], "strength": strength, "pivot_n": level[1]}


def events(bars: DataFrame, scopes: dict[str, int] | None = None, *, by_close: bool = True, least: float = 0.0, equal: float = EQUAL) -> DataFrame:
    """(symbol, scope, ts, n, kind, direction, level, label, bias, strength, pivot_n): PIVOT, BOS, SWEEP and CHOCH events.

    bias is the one in force when the event came, before a CHOCH turns it (for a pivot, at the end of its bar). n counts
    the bars of the series from 1. A series with less than a full window of bars has no event.
    """
    p = scoped(bars, scopes or SCOPES, equal)
    schema = schema_of(p, ["symbol", "scope", "ts", "n"], "kind string, direction string, level double, label string, bias string, strength double, pivot_n int")
    return fold(p, ["symbol", "scope"], ["n"], lambda: Breaks(by_close, least), schema)


def scoped(bars: DataFrame, scopes: dict[str, int], equal: float = EQUAL) -> DataFrame:
    """The rows that Breaks reads, a row a bar and scope: all scopes' pivots from one pass of windows."""
    b = bars
    for scope, side in scopes.items():
        b = confirmed_pivots(b, side, equal=equal).withColumns({scope: F.struct(F.lit(scope).alias("scope"), F.lit(side).alias("side"), "up", "up_label", "down", "down_label", "geo")}).drop("up", "up_label", "down", "down_label", "geo")
    return b.select("symbol", "ts", "n", "high", "low", "close", F.explode(F.array(*scopes)).alias("s")).select("symbol", "s.scope", "ts", "n", "high", "low", "close", "s.side", "s.up", "s.up_label", "s.down", "s.down_label", "s.geo")


class DetectStructure:
    """The machine as a table function: TABLE(rows of scoped) PARTITION BY (symbol, scope) ORDER BY n."""

    def __init__(self):
        self.machine = None

    def eval(self, row):
        r = row.asDict()
        self.machine = self.machine or Breaks()
        for e in self.machine.step(r):
            yield (r["symbol"], r["scope"], *(e[c] for c in ("ts", "n", "kind", "direction", "level", "label", "bias", "strength", "pivot_n")))


def register(spark: SparkSession, name: str = "detect_structure") -> None:
    """Make the machine callable from SQL."""
    spark.udtf.register(name, udtf(DetectStructure, returnType="symbol string, scope string, ts date, n int, kind string, direction string, level double, label string, bias string, strength double, pivot_n int"))


def _place(kind: Column, scope: Column) -> Column:
    """Order of the events of one bar: swing before internal, pivots, then breaks, then changes."""
    return F.when(scope == "swing", 0).otherwise(10) + F.when(kind == "PIVOT", 0).when(kind == "CHOCH", 2).otherwise(1)


def bias_at_bars(bars: DataFrame, found: DataFrame, expiry: int | None = None) -> DataFrame:
    """bars (with n) with what the events known by then say, none older than ``expiry`` bars.

    trend: the bias of the newest BOS or CHOCH (of one bar the first), else of the newest event that has one. latest and
    latest_swing: the newest BOS or CHOCH of any and of the swing scope; int_bos, int_choch: whether there is one.
    """
    cut = F.col("kind").isin("BOS", "CHOCH")
    first = F.struct(-_place(F.col("kind"), F.col("scope")), "n", "kind", "direction", "bias", "scope")
    internal = F.col("scope") == "internal"
    at = found.groupBy("symbol", "n").agg(
        F.max(F.when(cut, first)).alias("cut"), F.max(F.when((F.col("kind") == "CHOCH") & ~internal, first)).alias("swing"),
        F.max(F.when(F.col("bias") != "RANGING", first)).alias("any"), F.max(F.when(internal & (F.col("kind") == "BOS"), F.col("n"))).alias("ib"), F.max(F.when(internal & (F.col("kind") == "CHOCH"), F.col("n"))).alias("ic"),
    )
    b = bars.join(at, ["symbol", "n"], "left")
    w = f.series().rowsBetween(Window.unboundedPreceding if expiry is None else -(expiry - 1), Window.currentRow)
    newest = {c: F.last(c, ignorenulls=True).over(w) for c in ("cut", "swing", "any")}
    b = b.withColumns(newest | {"int_bos": F.max("ib").over(w).isNotNull(), "int_choch": F.max("ic").over(w).isNotNull()})
    trend = F.coalesce(F.col("cut.bias"), F.col("any.bias"), F.lit("RANGING"))
    return b.withColumns({"trend": trend, "latest": F.col("cut.kind"), "latest_swing": F.col("swing.direction")}).drop("cut", "swing", "any", "ib", "ic")


def pools(bars: DataFrame, *, side: int = 3, tolerance: float = EQUAL, last: int = 50, least: int = 1) -> DataFrame:
    """(symbol, side, price, touches, low, high, ts, n, seq): clusters of the last pivots of a side.

    In time order each pivot that no pool holds opens one with all later ones within tolerance of it. BSL (highs) lie at
    their maximum, SSL (lows) at their minimum; ts and n are the newest pivot's, seq the order of opening.
    """
    p = f.pivots(bars, side, side, strict=False).withColumn("n", F.row_number().over(f.series()))
    marks = F.array(F.when(F.col("pivot_high"), F.struct(F.lit("BSL").alias("side"), F.col("high").alias("price"))), F.when(F.col("pivot_low"), F.struct(F.lit("SSL").alias("side"), F.col("low").alias("price"))))
    p = p.select("symbol", "ts", "n", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select("symbol", "ts", "n", "m.*")
    newest = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.desc("n")))
    schema = schema_of(p, ["symbol", "side"], "price double, touches int, low double, high double").add(p.schema["ts"]).add("n", "integer").add("seq", "integer")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:  # at most ``last`` rows
        rest, out = list(pdf.sort_values("n")[["price", "ts", "n"]].itertuples(index=False, name=None)), []
        while rest:
            near = lambda x, a=rest[0][0]: max(a, x[0]) > 0 and abs(a - x[0]) / max(a, x[0]) <= tolerance
            own = [rest[0], *(x for x in rest[1:] if near(x))]
            rest = [x for x in rest[1:] if not near(x)]
            prices = [x[0] for x in own]
            if len(own) >= least:
                out.append((pdf["symbol"].iloc[0], kind := pdf["side"].iloc[0], max(prices) if kind == "BSL" else min(prices), len(own), min(prices), max(prices), own[-1][1], own[-1][2], own[0][2]))
        return pd.DataFrame(out, columns=schema.names)

    return p.withColumn("__k", newest).where(F.col("__k") <= last).drop("__k").groupBy("symbol", "side").applyInPandas(cluster, schema)


class Sweeps(Machine):
    """Sweeps of one series' pools, which come before the bars they are held against (at most ``most`` a side at a time).

    A wick beyond a pool that closes back is a grab; a close beyond it is pending until a bar closes back inside
    (a sweep of several bars) or the pool is more than ``deadline`` bars old (it is broken). A pool ends ``life``
    bars after its newest pivot.
    """

    def __init__(self, deadline: int, life: int):
        self.deadline, self.life, self.pools = deadline, life, []

    def step(self, row: dict) -> list[dict]:
        if row["pool"] is not None:
            p = row["pool"]
            self.pools = [x for x in self.pools if not (x["side"] == p["side"] and x["seq"] == p["seq"])]  # a pool that grew
            self.pools.append(p | {"sign": 1 if p["side"] == "BSL" else -1, "wick": None})
            return []
        out, n = [], row["n"]
        if n < 2:
            return out
        for p in list(self.pools):
            age, s, price = n - p["n"], p["sign"], p["price"]
            if age > self.life:
                self.pools.remove(p)
                continue
            reach, back = row["high"] if s > 0 else row["low"], s * (row["close"] - price) <= 0
            if back and s * (reach - price) > 0:
                out.append(self._told(row, p, reach, "single_bar_grab"))
                p["wick"] = None
                continue
            if not back:
                p["wick"] = reach if p["wick"] is None else s * max(s * p["wick"], s * reach)
            if p["wick"] is not None:
                if back:
                    out.append(self._told(row, p, p["wick"], "multi_bar_sweep"))
                    p["wick"] = None
                elif age > self.deadline:
                    self.pools.remove(p)
        return out

    def _told(self, row: dict, p: dict, wick: float, kind: str) -> dict:
        return {"ts": row["ts"], "n": row["n"], "side": p["side"], "level": p["price"], "wick": wick, "sweep_type": kind, "pool_n": p["n"], "seq": p["seq"]}


def sweeps(bars: DataFrame, found: DataFrame, *, known: Column | None = None, deadline: int = 10, life: int = 50) -> DataFrame:
    """(symbol, ts, n, side, level, wick, sweep_type, pool_n, seq) of pools (symbol, side, price, n, seq) against bars.

    ``known``: the bar from which on a pool is held against bars; without it all pools are known from the start, as in a
    look back over finished bars.
    """
    b = bars.select("symbol", "ts", F.row_number().over(f.series()).alias("n"), "high", "low", "close", F.lit(None).cast("struct<side:string,price:double,n:int,seq:int>").alias("pool"), F.lit(1).alias("turn"))
    at = F.lit(0) if known is None else known.cast("int")
    p = found.select("symbol", F.lit(None).cast(bars.schema["ts"].dataType).alias("ts"), at.alias("n"), *(F.lit(None).cast("double").alias(c) for c in ("high", "low", "close")), F.struct("side", "price", "n", "seq").alias("pool"), F.lit(0 if known is None else 2).alias("turn"))
    order = ["n", "turn", F.col("pool.side"), F.col("pool.seq")]
    schema = schema_of(b, ["symbol", "ts", "n"], "side string, level double, wick double, sweep_type string, pool_n int, seq int")
    return fold(b.unionByName(p), ["symbol"], order, lambda: Sweeps(deadline, life), schema)


def shifts(bars: DataFrame, *, side: int = 2, within: int = 10, body: float = 0.5) -> DataFrame:
    """bars with n, mss_up and mss_down: the shift after a sweep at this bar, of lows (up) and of highs (down), or null.

    The first internal pivot after the bar that a close breaks, both inside the next ``within`` bars. A shift is
    (ts, n, level, displacement: the body is at least ``body`` of the true range); it is known at its own bar.
    """
    p = f.true_range(f.pivots(bars, side, side, strict=False)).withColumn("n", F.row_number().over(f.series()))
    ahead = F.collect_list(F.struct("ts", "n", "open", "high", "low", "close", "tr", "pivot_high", "pivot_low")).over(f.series().rowsBetween(1, within))
    p = p.withColumn("__a", ahead)

    def shift(mark: str, price: str, sign: int) -> Column:
        late = lambda x: F.get(F.filter("__a", lambda y: (y["n"] > x["n"]) & (sign * (y["close"] - x[price]) > 0)), F.lit(0))
        told = lambda x: F.when(late(x).isNotNull(), F.struct(late(x)["ts"].alias("ts"), late(x)["n"].alias("n"), x[price].alias("level"), F.coalesce(F.abs(late(x)["close"] - late(x)["open"]) >= body * F.nullif(late(x)["tr"], F.lit(0.0)), F.lit(False)).alias("displacement")))
        inside = F.filter("__a", lambda x: x[mark] & (x["n"] <= F.col("n") + within - side))
        return F.get(F.filter(F.transform(inside, told), lambda x: x.isNotNull()), F.lit(0))

    return p.withColumns({"mss_up": shift("pivot_high", "high", 1), "mss_down": shift("pivot_low", "low", -1)}).drop("__a", "tr", "pivot_high", "pivot_low", "confirmed_ts")


def dealing_range(high: Column, low: Column, close: Column, sweep_side: Column, *, buffer: float = 0.02) -> dict[str, Column]:
    """eq, price_zone and the optimal entry between the last pivots before a sweep."""
    wide, ok, up = high - low, F.coalesce(high > low, F.lit(False)), sweep_side == "SSL"
    eq = low + wide * 0.5
    zone = F.when(~ok, "undefined").when(close > eq + wide * buffer, "premium").when(close < eq - wide * buffer, "discount").otherwise("equilibrium")
    level = lambda a, b: F.when(ok, F.when(up, high - wide * a).otherwise(low + wide * b))
    return {"eq": F.when(ok, eq), "price_zone": zone, "ote_low": level(0.79, 0.62), "ote_high": level(0.62, 0.79), "ote_mid": level(0.705, 0.705)}
