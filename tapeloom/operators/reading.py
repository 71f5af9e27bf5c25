"""Pattern geometry over pivots, fused chart votes, and studies of zones against later bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import features as f
from tapeloom.operators import gaps


def double_tops(bars: DataFrame, *, side: str = "high", tolerance: float = 0.03, apart: int = 5, span: int = 10) -> DataFrame:
    """Two like pivots of a side within ``tolerance``, at least ``apart`` bars apart and ``span`` from the one before them.

    (symbol, ts, first_price, second_price, neckline): the neckline is the opposite extreme between the two, found
    by a window over bars that carries the pivots' row numbers, not by a join.
    """
    numbered = f.pivots(bars).withColumn("__n", F.row_number().over(f.series()))
    mark, price = (F.col("pivot_high"), F.col("high")) if side == "high" else (F.col("pivot_low"), F.col("low"))
    p = numbered.where(mark).select("symbol", "ts", "confirmed_ts", "__n", price.alias("price"))
    w = Window.partitionBy("symbol").orderBy("__n")
    p = p.withColumns({"p1": F.lag("price").over(w), "n1": F.lag("__n").over(w), "n0": F.lag("__n", 2).over(w)})
    p = p.where((F.abs(F.col("price") / F.col("p1") - 1) <= tolerance) & (F.col("__n") - F.col("n1") >= apart) & (F.col("__n") - F.col("n0") >= span))
    inner = numbered.select(F.col("symbol").alias("__s"), F.col("__n").alias("__k"), F.col("low" if side == "high" else "high").alias("__x"))
    j = p.join(inner, (F.col("symbol") == F.col("__s")) & (F.col("__k") > F.col("n1")) & (F.col("__k") < F.col("__n")))
    edge = F.min("__x") if side == "high" else F.max("__x")
    return j.groupBy("symbol", "ts", "confirmed_ts", F.col("p1").alias("first_price"), F.col("price").alias("second_price")).agg(edge.alias("neckline"))


def head_shoulders(bars: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """Five pivots in turn, H L H L H: the middle one highest, the outer ones within ``tolerance`` of each other."""
    e = f.pivot_labels(bars)
    w = Window.partitionBy("symbol").orderBy("ts", "side")
    e = e.withColumns({f"s{k}": F.lag("side", k).over(w) for k in range(1, 5)} | {f"p{k}": F.lag("price", k).over(w) for k in range(1, 5)})
    turn = (F.col("side") == "high") & (F.col("s1") == "low") & (F.col("s2") == "high") & (F.col("s3") == "low") & (F.col("s4") == "high")
    shape = (F.col("p2") > F.col("price")) & (F.col("p2") > F.col("p4")) & (F.abs(F.col("price") / F.col("p4") - 1) <= tolerance)
    return e.where(turn & shape).select("symbol", "ts", F.col("p4").alias("left"), F.col("p2").alias("head"), F.col("price").alias("right"), ((F.col("p1") + F.col("p3")) / 2).alias("neckline"))


def value_area(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """(keys, low_bin, high_bin): from the fullest bin outward, the fuller neighbour first, up on ties, to ``share``.

    The bins of one profile are a short array, so this is one small function per profile.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.set_index("bin")["volume"].round(6).to_dict()
        lo = hi = min(k for k in v if v[k] == max(v.values()))
        got, want = v[lo], share * sum(v.values())
        first, last = min(v), max(v)
        while got < want and (lo > first or hi < last):
            up = v.get(hi + 1, 0.0) if hi < last else -1.0
            down = v.get(lo - 1, 0.0) if lo > first else -1.0
            if up >= down:
                hi, got = hi + 1, got + up
            else:
                lo, got = lo - 1, got + down
        return pdf[keys].head(1).assign(low_bin=lo, high_bin=hi)

    kinds = dict(profile.dtypes)
    return profile.select(*keys, "bin", "volume").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", low_bin long, high_bin long")


def votes(bars: DataFrame) -> DataFrame:
    """Weighted votes of the window features at every bar: score in 0..100, direction and decision.

    Bullish and bearish votes are separate columns of one row, so a full panel is one window pass.
    """
    b = f.range_position(f.sma_filter(f.money_flow(f.rvol(f.momentum(f.prior_trend(bars), 20)))))
    up = [(F.col("trend") == "up", 2.0), (F.col("mom") > 0, 1.5), (F.col("cmf") > 0.05, 1.0), (F.col("above_vote"), 1.0), ((F.col("rvol") > 1.5) & (F.col("close") > F.col("open")), 1.0), (F.col("range_position") < 0.3, 0.5)]
    down = [(F.col("trend") == "down", 2.0), (F.col("mom") < 0, 1.5), (F.col("cmf") < -0.05, 1.0), (~F.col("above_vote"), 1.0), ((F.col("rvol") > 1.5) & (F.col("close") < F.col("open")), 1.0), (F.col("range_position") > 0.7, 0.5)]
    total = sum(w for _, w in up)
    add = lambda v: sum((F.when(c, w).otherwise(0.0) for c, w in v), F.lit(0.0)) / total * 100
    b = b.withColumns({"long_score": add(up), "short_score": add(down)})
    return b.withColumns({"confluence": F.greatest("long_score", "short_score"), "direction": F.when(F.col("long_score") > F.col("short_score"), "long").when(F.col("long_score") < F.col("short_score"), "short").otherwise("none")})


def retests(bars: DataFrame, zones: DataFrame, *, horizon: int = 30, multiples: tuple[float, ...] = (1.0, 1.5, 2.0), ahead: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Trades of zones (of blocks.detect) entered at their middle by the first bar behind the candle that touches it.

    The stop is the candle's far end, a target lies a multiple of that risk beyond; rr_<multiple * 10> is what a bar after
    the entry meets first within ``horizon`` bars, the stop where one bar meets both; fwd_<n>: signed returns after n bars.
    """
    up, mid = F.col("direction") == "bullish", (F.col("bottom") + F.col("top")) / 2
    z = zones.select("symbol", F.col("block_ts").alias("ts"), "direction", mid.alias("entry"), F.col("extreme").alias("stop"), "has_gap", "strength", F.col("ts").alias("__known"))
    z = z.where(F.when(up, F.col("entry") > F.col("stop")).otherwise(F.col("stop") > F.col("entry")))
    keys = ("direction", "entry", "stop", "has_gap", "strength", "__known")
    hit = gaps.first_hits_by_side(z, bars, up, {"entry_ts": ([("low", "<=", F.col("entry"))], [("high", ">=", F.col("entry"))])}, keys).where("entry_ts IS NOT NULL").withColumnRenamed("ts", "block_ts")
    next_ = F.collect_list(F.struct("high", "low")).over(f.series().rowsBetween(1, horizon))  # at most horizon bars a row
    b = bars.withColumn("__next", next_).withColumns({f"__c{n}": F.lead("close", n).over(f.series()) for n in ahead}).select("symbol", F.col("ts").alias("entry_ts"), "__next", *(f"__c{n}" for n in ahead))
    j = hit.join(b, ["symbol", "entry_ts"])
    sign = F.when(up, 1).otherwise(-1)
    at = lambda test: F.array_min(F.filter(F.transform("__next", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull()))
    lost = at(lambda x: F.when(up, x["low"] <= F.col("stop")).otherwise(x["high"] >= F.col("stop")))
    out = {}
    for m in multiples:
        target = F.col("entry") + m * (F.col("entry") - F.col("stop"))
        won = _first_target(target, up, at)
        out[f"rr_{int(m * 10)}"] = F.when(lost.isNotNull() & (won.isNull() | (lost <= won)), "stop").when(won.isNotNull(), "target").otherwise("timeout")
    return j.withColumns(out | {f"fwd_{n}": sign * (F.col(f"__c{n}") / F.col("entry") - 1) for n in ahead})


def _first_target(target: Column, up: Column, at) -> Column:
    return at(lambda x: F.when(up, x["high"] >= target).otherwise(x["low"] <= target))


def obv_divergence(bars: DataFrame, *, period: int = 20, lookback: int = 20) -> DataFrame:
    """bearish where the last two confirmed close pivots rise while the smoothed volume balance falls, bullish mirrored.

    A pivot row carries the pivot before it, so the last two at any bar are one ``last`` over the rows that confirm.
    """
    from tapeloom.operators import states

    b = bars.join(states.obv_ema(bars, period).select("symbol", "ts", "ema"), ["symbol", "ts"])
    b = b.withColumns({"__n": F.row_number().over(f.series()), "__up": (F.col("close") > f.lag("close")) & (F.col("close") > F.lead("close").over(f.series())), "__down": (F.col("close") < f.lag("close")) & (F.col("close") < F.lead("close").over(f.series()))})
    upto = f.series().rowsBetween(Window.unboundedPreceding, -1)
    seen = f.series().rowsBetween(Window.unboundedPreceding, -2)  # a pivot is known one bar later, and used from the next
    for side in ("up", "down"):
        own = F.when(F.col(f"__{side}"), F.struct(F.col("__n").alias("n"), F.col("close").alias("p"), F.col("ema").alias("e")))
        b = b.withColumn(f"__{side}_before", F.last(own, ignorenulls=True).over(upto)).withColumn(f"__{side}_own", own)
        b = b.withColumn(f"__{side}_pair", F.last(F.when(F.col(f"__{side}"), F.struct(F.col(f"__{side}_own").alias("b"), F.col(f"__{side}_before").alias("a"))), ignorenulls=True).over(seen))
    pair = lambda s, t: F.col(f"__{s}_pair.{t}")
    near = lambda s: pair(s, "a.n") >= F.col("__n") - lookback
    bear = near("up") & (pair("up", "b.p") > pair("up", "a.p")) & (pair("up", "b.e") < pair("up", "a.e"))
    bull = near("down") & (pair("down", "b.p") < pair("down", "a.p")) & (pair("down", "b.e") > pair("down", "a.e"))
    return b.select("symbol", "ts", F.when(bear, "bearish").when(bull, "bullish").otherwise("none").alias("divergence"))


def flags(bars: DataFrame, *, pole_least: float = 0.04, retrace: float = 0.5) -> DataFrame:
    """Bars that end a flag: a pole of 3 to 29 bars that moves ``pole_least``, then 5 to 20 bars that give back at most
    ``retrace`` of it on less volume. (symbol, ts, direction, pole, flag); the longest pole of the shortest flag."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("ts").reset_index(drop=True)
        c, v = p["close"].to_numpy(), np.concatenate([[0.0], p["volume"].cumsum().to_numpy()])
        n, found = len(p), {}
        for flag in range(20, 4, -1):
            for pole in range(3, 30):
                end = np.arange(flag + pole, n)
                if not len(end):
                    continue
                top, base = c[end - flag], c[end - flag - pole]
                move = np.divide(top - base, base, out=np.zeros(len(end)), where=base > 0)
                back = np.divide(top - c[end], top - base, out=np.full(len(end), 9.0), where=top != base)
                calm = (v[end + 1] - v[end - flag + 1]) / flag < (v[end - flag + 1] - v[end - flag - pole + 1]) / pole
                ok = (np.abs(move) >= pole_least) & (back >= 0) & (back <= retrace) & calm
                found |= {int(i): ("up" if m > 0 else "down", pole, flag) for i, m in zip(end[ok], move[ok], strict=True)}
        return pd.DataFrame([(p["symbol"][0], p["ts"][i], *x) for i, x in sorted(found.items())], columns=["symbol", "ts", "direction", "pole", "flag"])

    return bars.select("symbol", "ts", "close", "volume").groupBy("symbol").applyInPandas(run, "symbol string, ts date, direction string, pole long, flag long")
