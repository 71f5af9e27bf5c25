"""Wyckoff schematics by chained first hits: each event is the first bar behind its parent that meets the parent's tests.

One window over each series gives what an event hands on (its bar, price, volume and range), the next window tests
the later bars against it. A series is shuffled once and never held by a function; all steps share the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import features as f

#: Thresholds of the events.
CLIMAX = {"z": 2.0, "lookback": 50, "spread": 1.5, "low_tail": 0.30, "high_tail": 0.25}
MEAN = 20
AR_BARS, AR_MOVE, LEAST_RANGE = 30, 0.05, 0.02
ST = {"near": 0.15, "volume": 0.70, "spread": 0.80}
BREAK, REJECT_BARS, TEST_VOLUME = 0.05, 3, 0.60
MOVE, FORCE, WIDE = 0.03, 1.20, 1.1
LPS = {"back": 0.50, "volume": 0.80, "of_sos": 0.70, "spread": 0.90, "off": 0.01}
JAC, JAC_VOLUME, BUEC, BUEC_VOLUME = 0.003, 1.50, 0.01, 0.8
#: What each event adds to the confidence, in all.
WEIGHTS = {"SC": 0.12, "AR": 0.08, "ST": 0.06, "Spring": 0.15, "Test": 0.10, "SOS": 0.12, "LPS": 0.10, "JAC": 0.08, "BUEC": 0.07, "BC": 0.12, "UTAD": 0.15, "SOW": 0.12, "LPSY": 0.10}
EVENTS = ("SC", "BC", "AR", "ST", "Spring", "Test", "UTAD", "SOS", "SOW", "JAC", "BUEC", "LPS", "LPSY")


def measures(bars: DataFrame) -> DataFrame:
    """bars with n, the volume's z-score, means of volume and spread, and the marks of a climax."""
    spread = F.col("high") - F.col("low")
    b = bars.withColumns({"n": F.row_number().over(f.series()), "spread": spread, "before": f.lag("close"), "volume_before": f.lag("volume")})
    dev = f.over(F.stddev_samp("volume"), CLIMAX["lookback"])
    b = b.withColumns({"z": F.coalesce(F.when(dev > 0, (F.col("volume") - f.over(F.avg("volume"), CLIMAX["lookback"])) / dev), F.lit(0.0)), "vma": f.over(F.avg("volume"), MEAN), "sma": f.over(F.avg("spread"), MEAN)})
    heavy = (F.col("n") > 1) & (F.col("z") >= CLIMAX["z"]) & (F.col("spread") >= F.col("sma") * CLIMAX["spread"])
    wide = F.greatest("spread", F.lit(1e-9))
    sc = heavy & (F.col("close") < F.col("before")) & ((F.col("close") - F.col("low")) / wide >= CLIMAX["low_tail"])
    bc = heavy & (F.col("close") > F.col("before")) & ((F.col("high") - F.col("close")) / wide >= CLIMAX["high_tail"])
    ahead = f.series().rowsBetween(1, REJECT_BARS)
    return b.withColumns({"sc": sc, "bc": bc, "top_close": F.max("close").over(ahead), "low_close": F.min("close").over(ahead)})


def _event(n: Column | str = "n", price: Column | None = None) -> Column:
    return F.struct(F.col("n").alias("n"), F.col("ts").alias("ts"), price.alias("price"), F.col("volume").alias("volume"), F.col("close").alias("close"), F.col("spread").alias("spread"), F.col("z").alias("z"), F.col("sma").alias("sma"))


def _first(test: Column, price: Column) -> Column:
    return F.min(F.when(test, _event(price=price))).over(Window.partitionBy("symbol"))


def chain(bars: DataFrame) -> DataFrame:
    """measures(bars) with the series' schematic on every row: kind, low_anchor, high_anchor, width, an event struct under each name, sts."""
    w = Window.partitionBy("symbol")
    low, high, close, volume, n = (F.col(c) for c in ("low", "high", "close", "volume", "n"))
    b = measures(bars).withColumns({"bars_in_all": F.count("*").over(w), "still": F.count(F.when(volume == 0, 1)).over(w)})
    # Of equal extremes the earliest bar, as min and max of (price, -n or n) give it.
    b = b.withColumns({"sc_": F.min(F.when(F.col("sc"), F.struct(low.alias("price"), n.alias("n")))).over(w), "bc_": F.max(F.when(F.col("bc"), F.struct(high.alias("price"), (-n).alias("n")))).over(w)})
    b = b.withColumns({"sc_n": F.col("sc_.n"), "bc_n": -F.col("bc_.n")})
    b = b.withColumns({"SC": F.min(F.when(n == F.col("sc_n"), _event(price=low))).over(w), "BC": F.min(F.when(n == F.col("bc_n"), _event(price=high))).over(w)})
    near = lambda c: (n > F.col(c)) & (n <= F.col(c) + AR_BARS)
    b = b.withColumns({"up_": F.max(F.when(near("sc_n"), F.struct(high.alias("price"), (-n).alias("n")))).over(w), "down_": F.min(F.when(near("bc_n"), F.struct(low.alias("price"), n.alias("n")))).over(w)})
    rose = (F.col("up_.price") - F.col("SC.price")) / F.greatest(F.col("SC.price"), F.lit(1e-9))
    fell = (F.col("BC.price") - F.col("down_.price")) / F.greatest(F.col("BC.price"), F.lit(1e-9))
    enough = F.col("bars_in_all") >= CLIMAX["lookback"] + 5
    acc = F.coalesce(enough & (F.col("SC.price") > 0) & (rose >= AR_MOVE) & ((F.col("up_.price") - F.col("SC.price")) / F.col("SC.price") >= LEAST_RANGE), F.lit(False))
    dis = F.coalesce(enough & (F.col("down_.price") > 0) & (fell >= AR_MOVE) & ((F.col("BC.price") - F.col("down_.price")) / F.col("down_.price") >= LEAST_RANGE), F.lit(False))
    b = b.withColumn("kind", F.when(acc, "accumulation").when(dis, "distribution"))
    up = F.col("kind") == "accumulation"
    down = F.col("kind") == "distribution"
    b = b.withColumns({"SC": F.when(up, F.col("SC")), "BC": F.when(down, F.col("BC")), "low_anchor": F.when(up, F.col("SC.price")).when(down, F.col("down_.price")), "high_anchor": F.when(up, F.col("up_.price")).when(down, F.col("BC.price"))})
    b = b.withColumn("width", F.greatest(F.col("high_anchor") - F.col("low_anchor"), F.lit(1e-9)))
    ar_n = F.when(up, -F.col("up_.n")).when(down, F.col("down_.n"))
    b = b.withColumn("AR", F.min(F.when(n == ar_n, _event(price=F.when(up, high).otherwise(low)))).over(w))
    floor, roof, width, climax = F.col("low_anchor"), F.col("high_anchor"), F.col("width"), F.coalesce("SC", "BC")
    edge = F.when(up, F.abs(low - floor)).otherwise(F.abs(high - roof)) / width
    inside = F.when(up, low > floor * (1 - BREAK)).otherwise(high < roof * (1 + BREAK))
    st = (n > F.col("AR.n")) & (edge <= ST["near"]) & (volume < climax["volume"] * ST["volume"]) & inside & (F.col("spread") < climax["spread"] * ST["spread"])
    b = b.withColumn("st", F.coalesce(st, F.lit(False))).withColumn("sts", F.count(F.when(F.col("st"), 1)).over(w))
    later, some = n > F.col("AR.n"), F.col("sts") > 0
    b = b.withColumns({
        "Spring": _first(up & some & later & (low < floor) & ((floor - low) / width <= BREAK) & ((close > floor) | (F.col("top_close") > floor)), low),
        "UTAD": _first(down & some & later & (high > roof) & ((high - roof) / width <= BREAK) & ((close < roof) | (F.col("low_close") < roof)), high),
    })
    tested = (n > F.col("Spring.n") + REJECT_BARS) & (low <= floor * (1 + ST["near"])) & (low > floor * (1 - BREAK * 0.5)) & (volume < F.col("Spring.volume") * TEST_VOLUME) & (close > floor)
    b = b.withColumn("Test", _first(up & tested, low))
    root = F.coalesce("Test", "Spring")
    force = (volume >= F.col("vma") * FORCE) & (volume > F.col("volume_before")) & (F.col("spread") >= F.col("sma") * WIDE)
    b = b.withColumns({
        "SOS": _first(up & (n > root["n"]) & ((close - root["close"]) / F.greatest(root["close"], F.lit(1e-9)) >= MOVE) & force & (close >= F.col("open")), close),
        "SOW": _first(down & (n > F.col("UTAD.n")) & ((F.col("UTAD.close") - close) / F.greatest(F.col("UTAD.close"), F.lit(1e-9)) >= MOVE) & force & (close <= F.col("open")), close),
    })
    b = b.withColumn("JAC", _first(up & (n >= F.col("SOS.n")) & (close > F.col("AR.price") * (1 + JAC)) & (volume >= F.col("vma") * JAC_VOLUME), close))
    buec = (n > F.col("JAC.n")) & (low <= F.col("AR.price") * (1 + BUEC)) & (close > F.col("AR.price") * (1 - BUEC)) & (volume < F.col("vma") * BUEC_VOLUME)
    quiet = (volume < F.col("vma") * LPS["volume"]) & (F.col("spread") < F.col("sma") * LPS["spread"])
    least = F.col("SOS.price") - (F.col("SOS.price") - F.col("Spring.price")) * LPS["back"]
    most = F.col("SOW.price") + (F.col("BC.price") - F.col("SOW.price")) * LPS["back"]
    return b.withColumns({
        "BUEC": _first(up & buec, low),
        "LPS": _first(up & (n > F.col("SOS.n")) & (low >= least) & (low > floor * (1 + LPS["off"])) & quiet & (volume < F.col("SOS.volume") * LPS["of_sos"]), low),
        "LPSY": _first(down & (n > F.col("SOW.n")) & (high <= most) & (high < roof * (1 - LPS["off"])) & quiet, high),
    })


def events(chained: DataFrame) -> DataFrame:
    """(symbol, kind, event, ts, price, volume, type): a row an event; type tells springs and upthrusts apart by their volume."""
    own = lambda name: F.when(F.col(f"{name}.n") == F.col("n"), F.struct(F.lit(name).alias("event"), F.col(f"{name}.price").alias("price"), _type(name).alias("type")))
    st = F.when(F.col("st"), F.struct(F.lit("ST").alias("event"), F.when(F.col("kind") == "accumulation", F.col("low")).otherwise(F.col("high")).alias("price"), F.lit(None).cast("int").alias("type")))
    told = F.array(st, *(own(e) for e in EVENTS if e != "ST"))
    x = chained.where("kind IS NOT NULL").select("symbol", "kind", "ts", "volume", F.explode(F.filter(told, lambda e: e.isNotNull())).alias("e"))
    return x.select("symbol", "kind", "e.event", "ts", "e.price", "volume", "e.type")


def _type(name: str) -> Column:
    if name not in ("Spring", "UTAD"):
        return F.lit(None).cast("int")
    z, quiet = F.col(f"{name}.z"), F.when(F.col(f"{name}.spread") < F.col(f"{name}.sma"), 3).otherwise(2) if name == "Spring" else F.lit(3)
    return F.when(z >= CLIMAX["z"], 1).when(z >= CLIMAX["z"] * 0.4, 2).otherwise(quiet)


def schematics(chained: DataFrame, *, asymmetry: float = 1.10, out_by: float = 0.01) -> DataFrame:
    """(symbol, kind, low_anchor, high_anchor, sts, phase, confidence, volume_asymmetry, atr, close, and the event structs), a row a series."""
    up, has = F.col("kind") == "accumulation", lambda e: F.col(e).isNotNull()
    within = (F.col("n") >= F.coalesce("SC", "BC")["n"]) & (F.col("n") <= F.col("AR.n"))
    rose = F.col("close") >= F.col("open")
    tr = F.when(F.col("n") > 1, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before"))))
    g = chained.withColumn("__tr", tr).withColumn("__end", F.col("bars_in_all") - F.col("n")).groupBy("symbol").agg(
        *(F.first(c).alias(c) for c in ("kind", "low_anchor", "high_anchor", "sts", "bars_in_all", "still", *(e for e in EVENTS if e != "ST"))),
        F.avg(F.when(within & rose, F.col("volume"))).alias("adv"), F.avg(F.when(within & ~rose, F.col("volume"))).alias("dec"),
        F.avg(F.when(F.col("__end") < 14, F.col("__tr"))).alias("atr"), F.max_by("close", "n").alias("close"), F.max("ts").alias("ts"),
    )
    ratio = F.when(up, F.col("adv") / F.greatest("dec", F.lit(1e-9))).otherwise(F.col("dec") / F.greatest("adv", F.lit(1e-9)))
    g = g.withColumn("volume_asymmetry", F.coalesce(ratio >= asymmetry, F.lit(False)))
    below = F.col("low_anchor") * (1 - out_by)
    fled = F.coalesce((F.col("SOW.close") < below) | (F.col("LPSY.price") < below), F.lit(False))
    phase = F.when(F.col("sts") == 0, "A").when(~has("Spring") & ~has("UTAD"), "B").when(~has("SOS") & ~has("SOW"), "C").when(has("JAC") | (~up & fled), "E").otherwise("D")
    parts = sum((F.when(has(e), v).otherwise(0.0) for e, v in WEIGHTS.items() if e != "ST"), F.lit(0.0))
    score = parts + F.least(F.col("sts"), F.lit(2)) * WEIGHTS["ST"] + F.when(has("Spring") & (_type("Spring") == 3), 0.05).otherwise(0.0) + F.when(F.col("volume_asymmetry"), 0.07).otherwise(0.0)
    score = F.least(F.greatest(score, F.lit(0.0)), F.when(F.col("still") / F.col("bars_in_all") >= 0.2, 0.5).otherwise(1.0))
    return g.withColumns({"phase": F.when(F.col("kind").isNotNull(), phase), "confidence": F.when(F.col("kind").isNotNull(), F.round(score, 6)).otherwise(0.0), "spring_type": F.when(has("Spring"), _type("Spring"))})


def entries(found: DataFrame, least: float = 0.35) -> DataFrame:
    """(symbol, ts, signal, trigger, price, stop, target) at the last bar of each series."""
    up, p, half = F.col("kind") == "accumulation", F.col("phase"), 0.5 * F.col("atr")
    ok = F.col("kind").isNotNull() & (F.col("confidence") >= least)
    trigger = (
        F.when(up & (p == "C"), F.when(F.col("Test").isNotNull(), "Test").when(F.col("spring_type") == 3, "Spring"))
        .when(up & (p == "D"), F.when(F.col("BUEC").isNotNull(), "BUEC").when(F.col("LPS").isNotNull(), "LPS").otherwise("SOS")).when(up & (p == "E"), "JAC")
        .when(p == "C", "UTAD").when(p == "D", F.when(F.col("LPSY").isNotNull(), "LPSY").otherwise("SOW")).when(p == "E", "SOW_breakout")
    )
    x = found.withColumn("trigger", F.when(ok, trigger))
    t = F.col("trigger")
    signal = F.when(~ok, "avoid").when(t.isNull(), "wait").otherwise(F.when(up, "long").otherwise("short"))
    ref = (
        F.when(t.isin("Test", "Spring"), F.col("Spring.price")).when(t == "BUEC", F.col("BUEC.price")).when(t == "LPS", F.col("LPS.price")).when(t == "SOS", F.col("SOS.price") * 0.99).when(t == "JAC", F.col("high_anchor"))
        .when(t == "UTAD", F.col("UTAD.price")).when(t == "LPSY", F.col("LPSY.price")).when(t == "SOW", F.col("SOW.price") * 1.01).when(t == "SOW_breakout", F.col("low_anchor"))
    )
    width = F.col("high_anchor") - F.col("low_anchor")
    return x.select(
        "symbol", "ts", signal.alias("signal"), F.coalesce(t, F.lit("")).alias("trigger"), F.when(t == "Test", F.col("Test.price")).otherwise(F.col("close")).alias("price"),
        F.round(F.coalesce(F.when(up, ref - half).otherwise(ref + half), F.lit(0.0)), 6).alias("stop"), F.round(F.when(t.isNull(), 0.0).when(up, F.col("high_anchor") + width).otherwise(F.col("low_anchor") - width), 6).alias("target"),
    )
