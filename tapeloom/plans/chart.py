"""Queries of the fused chart readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import scalars as sc
from tapeloom.operators import chart
from tapeloom.operators import features as f
from tapeloom.operators import orderbook as ob
from tapeloom.operators import signals as sg
from tapeloom.plans.registry import query
from tapeloom.plans.windows import r
from tapeloom.sources import adapters as src


def _book(spark, sf):
    """The order book's part of a reading at each snapshot."""
    b, bids, asks = src.book(spark, sf).where(ob.valid(F.col("bids"), F.col("asks"))), F.col("bids"), F.col("asks")
    b = b.withColumn("obi", ob.imbalance(bids, asks, 10))
    sd = f.over(F.stddev_samp("obi"), 60)
    z = F.when(f.over(F.count("obi"), 60) >= 10, F.when(sd > 1e-12, (F.col("obi") - f.over(F.avg("obi"), 60)) / sd).otherwise(0.0))
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    return b.select("symbol", "ts", sc.obi_regime(F.col("obi")).alias("obi_regime"), z.alias("obi_z"), (ob.micro_price(bids, asks) - mid).alias("delta_vamp"), (ob.spread_pct(bids, asks) > 0.1).alias("spread_wide"), F.lit(False).alias("wall_suspect"))


def _interest(spark, sf):
    """Open interest and funding at each bar; the tables have neither, so volume and the bar's change stand for them."""
    b = f.zscore(src.intraday(spark, sf), n=30, least=15, sample=False)
    price, oi = F.nanvl(f.change("close"), F.lit(0.0)), f.change("volume")
    b = b.withColumns({"__p": price, "__o": oi, "funding": sc.funding_label((F.col("close") - F.col("open")) / 100000)})
    x = sg.squeeze_cascade(F.col("__p"), F.col("__o"), F.col("funding"), F.col("z"))
    b = b.withColumns({"squeeze": x["squeeze"], "__c": x["cascade"]})
    return b.select("symbol", "ts", sc.oi_quadrant(F.col("__p"), F.col("__o")).alias("quadrant"), (F.col("__o") > 0.02).alias("buildup"), "squeeze", (F.col("__c") & (F.col("__p") < 0)).alias("cascade_long"), (F.col("__c") & (F.col("__p") > 0)).alias("cascade_short"), "funding")


def hourly(spark, sf):
    """What is told of the hourly series, with their books and open interest."""
    return chart.told(src.intraday(spark, sf), more=_book(spark, sf).join(_interest(spark, sf), ["symbol", "ts"], "full"))


@query()
def chart_votes(spark, sf):
    b = hourly(spark, sf)
    each = [F.filter(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(d).alias("direction"), F.lit(k).alias("name"), v["weight"].alias("weight"), v["direction"].alias("vote"))) for k, v in chart.votes(b, d).items())), lambda x: x.isNotNull()) for d in ("long", "short")]
    return b.select("symbol", "ts", F.explode(F.concat(*each)).alias("v")).select("symbol", "ts", "v.*")


@query()
def chart_veto(spark, sf):
    return hourly(spark, sf).select("symbol", "ts", *(chart.vetoes(d).alias(f"{d}_veto") for d in ("long", "short")), *(chart.vetoes(d, True).alias(f"{d}_reverting_veto") for d in ("long", "short")))


def panel(spark, sf, direction: str = "long"):
    """Daily readings at every bar with the returns that followed; ACT: ENTER_NOW or SCALE_IN."""
    b = chart.read(chart.told(src.daily(spark, sf)), direction)
    ahead = {f"fwd{h}": F.lead("close", h).over(f.series()) / F.col("close") - 1 for h in (3, 5, 10, 20)}
    acts = F.when(F.col("decision").isin("ENTER_NOW", "SCALE_IN"), "ACT").otherwise(F.col("decision"))
    return b.withColumns(ahead | {"act": acts, "direction": F.lit(direction)})


@query()
def chart_read_panel(spark, sf):
    full = F.col("n") >= chart.WINDOW
    return panel(spark, sf).where(full & F.col("fwd20").isNotNull()).select("symbol", "ts", "direction", "decision", "confluence", "trend", *r("fwd3", "fwd5", "fwd10", "fwd20"))


@query()
def chart_read(spark, sf):
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    b = src.daily(spark, sf).withColumn("__k", last).where(F.col("__k") <= chart.WINDOW).drop("__k")  # a reading looks no further back
    x = chart.read(chart.told(b)).withColumn("__k", last).where("__k = 1")
    return x.select("symbol", "ts", "decision", "confluence", "trend", "veto", "n_active", *r("entry_low", "entry_high", "invalidation", "range_position", "atr14"))
