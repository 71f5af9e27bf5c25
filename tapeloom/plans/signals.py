"""Queries of the volume, open-interest, pair and sequential signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import funding_label
from tapeloom.operators import features as f
from tapeloom.operators import gaps
from tapeloom.operators import signals as sg
from tapeloom.operators import states
from tapeloom.operators import portfolio as pf
from tapeloom.plans.registry import query
from tapeloom.plans.selection import HOLD, holdings
from tapeloom.plans.windows import TR, S, r, rows
from tapeloom.sources import adapters as src

AT = "CASE WHEN high <= low THEN 'mid' WHEN (close - low) / (high - low) >= 0.7 THEN 'high' WHEN (close - low) / (high - low) <= 0.3 THEN 'low' ELSE 'mid' END"
VB = f"""v AS (SELECT *, volume / nullif(CASE WHEN count(volume) OVER {rows(20)} = 20 THEN avg(volume) OVER {rows(20)} END, 0) AS rvol, (high - low) / nullif(CASE WHEN count(close) OVER {rows(14)} = 14 THEN avg(high - low) OVER {rows(14)} END, 0) AS ratio,
    {AT} AS loc, lag(volume) OVER ({S}) AS v1, lag(volume, 2) OVER ({S}) AS v2, lag(close) OVER ({S}) AS c1 FROM bars_d)"""


@query(f"WITH {VB} SELECT symbol, ts, CASE WHEN rvol >= 2.0 AND ratio < 0.7 THEN CASE WHEN close > open THEN 'absorption' ELSE 'selling_pressure_test' END WHEN rvol < 0.7 AND ratio > 1.4 THEN CASE WHEN close > open THEN 'effortless_rise' ELSE 'effortless_fall' END ELSE 'neutral' END AS evr FROM v")
def w_evr(spark, sf):
    return sg.effort_result(src.daily(spark, sf)).select("symbol", "ts", "evr")


@query(f"""WITH {VB}, q AS (SELECT *, coalesce(ratio < 0.6 AND volume < least(v1, v2) AND v2 IS NOT NULL, false) AS quiet FROM v), n AS (SELECT *, quiet AND close < open AND loc = 'high' AS no_supply, quiet AND close < open AND loc = 'mid' AS no_supply_weak, quiet AND close > open AND loc = 'low' AS no_demand, quiet AND close > open AND loc = 'mid' AS no_demand_weak FROM q)
    SELECT symbol, ts, no_supply, no_supply_weak, no_demand, no_demand_weak, coalesce(lag(no_supply) OVER ({S}) AND close > c1, false) AS no_supply_confirmed, coalesce(lag(no_demand) OVER ({S}) AND close < c1, false) AS no_demand_confirmed FROM n""")
def w_no_supply_demand(spark, sf):
    return sg.no_supply_demand(src.daily(spark, sf)).select("symbol", "ts", "no_supply", "no_supply_weak", "no_demand", "no_demand_weak", "no_supply_confirmed", "no_demand_confirmed")


CLIMAX = f"""{VB}, m AS (SELECT *, CASE WHEN count(close) OVER {rows(20, 1)} = 20 THEN max(close) OVER {rows(20, 1)} END AS mx, CASE WHEN count(close) OVER {rows(20, 1)} = 20 THEN min(close) OVER {rows(20, 1)} END AS mn FROM v), k AS (SELECT *, rvol >= 2.0 AND ratio > 1.4 AND NOT coalesce(abs(open - c1) / c1 > 0.03, false) AS ok FROM m)"""


@query(f"WITH {CLIMAX} SELECT symbol, ts, CASE WHEN ok AND close > open AND loc IN ('mid', 'low') AND close > mx THEN 'top' WHEN ok AND close < open AND close < mn AND loc = 'high' THEN 'bottom' WHEN ok AND close < open AND close < mn AND loc = 'mid' THEN 'bottom_weak' ELSE 'none' END AS climax FROM k")
def w_climax(spark, sf):
    return sg.climax(src.daily(spark, sf), rvol_least=2.0).select("symbol", "ts", "climax")


@query(f"WITH {VB}, d AS (SELECT *, CASE WHEN rvol < 0.9 THEN 1 ELSE 0 END AS low_, CASE WHEN volume <= v1 THEN 1 ELSE 0 END AS fall FROM v) SELECT symbol, ts, coalesce(sum(low_) OVER {rows(3)} = 3 AND sum(fall) OVER {rows(2)} = 2 AND max(high - low) OVER {rows(2)} < max(high - low) OVER ({S} ROWS BETWEEN 2 PRECEDING AND 2 PRECEDING), false) AS vdu FROM d")
def w_vdu(spark, sf):
    return sg.dry_up(src.daily(spark, sf), 3, 0.9).select("symbol", "ts", "vdu")


@query()
def w_volume_bar(spark, sf):
    return sg.volume_bar(src.daily(spark, sf)).where("avg_volume >= 50")


CAP = f"c AS (SELECT *, max(volume) OVER {rows(50)} AS top, max(close) OVER {rows(50, 1)} AS hi, min(close) OVER {rows(50, 1)} AS lo FROM bars_h)"


@query(f"WITH {CAP} SELECT symbol, ts, (top - volume) / top >= 0.3 AS capitulation, CASE WHEN close > hi AND volume < top THEN 'bearish' WHEN close < lo AND volume < top THEN 'bullish' ELSE 'none' END AS divergence FROM c")
def w_capitulation(spark, sf):
    return sg.capitulation(src.intraday(spark, sf)).select("symbol", "ts", "capitulation", "divergence")


OI = f"o AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS p, volume / lag(volume) OVER ({S}) - 1 AS o, CASE WHEN count(volume) OVER {rows(30)} >= 15 THEN CASE WHEN stddev_pop(volume) OVER {rows(30)} > 0 THEN (volume - avg(volume) OVER {rows(30)}) / stddev_pop(volume) OVER {rows(30)} ELSE 0 END END AS z, (close - open) / 100000 AS fr FROM bars_h), l AS (SELECT *, CASE WHEN fr <= -0.0005 THEN 'heavy_short' WHEN fr <= -0.0001 THEN 'short' WHEN fr <= 0.0001 THEN 'neutral' WHEN fr <= 0.0005 THEN 'long' ELSE 'heavy_long' END AS funding FROM o), q AS (SELECT *, coalesce(funding IN ('heavy_long', 'heavy_short') AND o > 0 AND z >= 1, false) AS squeeze, coalesce(abs(p) >= 0.02 AND o <= -0.03, false) AS cascade FROM l)"


def _oi(spark, sf):
    b = f.zscore(src.intraday(spark, sf), n=30, least=15, sample=False).withColumns({"p": f.change("close"), "o": f.change("volume"), "funding": funding_label((F.col("close") - F.col("open")) / 100000)})
    return b.withColumns(sg.squeeze_cascade(F.col("p"), F.col("o"), F.col("funding"), F.col("z")))


@query(f"WITH {OI} SELECT symbol, ts, squeeze, cascade FROM q")
def oi_squeeze_cascade(spark, sf):
    return _oi(spark, sf).select("symbol", "ts", "squeeze", "cascade")


@query(f"WITH {OI} SELECT symbol, ts, CASE WHEN cascade THEN 'reversal' WHEN squeeze THEN CASE funding WHEN 'heavy_long' THEN 'short' ELSE 'long' END WHEN p > 0 AND o > 0 THEN 'long' WHEN p < 0 AND o > 0 THEN 'short' ELSE 'none' END AS direction, (squeeze::INT + cascade::INT + coalesce(abs(z) >= 2, false)::INT) / 10.0 AS strength FROM q")
def oi_signal(spark, sf):
    x = _oi(spark, sf)
    d = F.when(F.col("cascade"), "reversal").when(F.col("squeeze"), F.when(F.col("funding") == "heavy_long", "short").otherwise("long")).when((F.col("p") > 0) & (F.col("o") > 0), "long").when((F.col("p") < 0) & (F.col("o") > 0), "short").otherwise("none")
    flags = F.col("squeeze").cast("int") + F.col("cascade").cast("int") + F.coalesce(F.abs("z") >= 2, F.lit(False)).cast("int")
    return x.select("symbol", "ts", d.alias("direction"), (flags / 10).alias("strength"))


PAIR = "pr AS (SELECT a.symbol AS sa, b.symbol AS sb, a.ts, ln(a.close) AS y, ln(b.close) AS x FROM bars_w a JOIN bars_w b ON a.ts = b.ts AND a.symbol < b.symbol)"
PW = "(PARTITION BY sa, sb ORDER BY ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)"


def _pairs(spark, sf):
    b = src.weekly(spark, sf)
    return b.select(F.col("symbol").alias("sa"), "ts", F.log("close").alias("y")).join(b.select(F.col("symbol").alias("sb"), "ts", F.log("close").alias("x")), "ts").where("sa < sb")


ROLL = f"{PAIR}, h AS (SELECT *, CASE WHEN count(*) OVER {PW} >= 26 AND var_pop(x) OVER {PW} > 0 THEN covar_pop(y, x) OVER {PW} / var_pop(x) OVER {PW} END AS hedge, lead(y) OVER (PARTITION BY sa, sb ORDER BY ts) AS ny, lead(x) OVER (PARTITION BY sa, sb ORDER BY ts) AS nx, avg(y) OVER {PW} AS my, avg(x) OVER {PW} AS mx, var_pop(y) OVER {PW} AS vy, covar_pop(y, x) OVER {PW} AS c FROM pr)"


@query(f"WITH {ROLL} SELECT sa, sb, ts, round(hedge, 5) AS hedge, round((y - (my - hedge * mx) - hedge * x) / sqrt(greatest(0, vy - hedge * c)), 4) AS z FROM h WHERE hedge IS NOT NULL")
def w_rolling_ols_pair(spark, sf):
    return sg.rolling_pair(_pairs(spark, sf), ["sa", "sb"]).where("hedge IS NOT NULL").select("sa", "sb", "ts", *r("hedge", n=5), *r("z", n=4))


@query(f"WITH {PAIR}, d AS (SELECT sa, sb, ts, y - x AS s, lag(y - x) OVER (PARTITION BY sa, sb ORDER BY ts) AS l FROM pr) SELECT sa, sb, round(CASE WHEN regr_slope(s - l, l) < 0 THEN -ln(2) / regr_slope(s - l, l) END, 5) AS half_life FROM d WHERE l IS NOT NULL GROUP BY 1, 2")
def w_half_life(spark, sf):
    return sg.half_life(_pairs(spark, sf).withColumn("s", F.col("y") - F.col("x")), ["sa", "sb"], "s").select("sa", "sb", *r("half_life", n=5))


@query(f"""WITH {ROLL},
    g AS (SELECT *, (y - (my - hedge * mx) - hedge * x) / sqrt(greatest(0, vy - hedge * c)) AS z FROM h WHERE hedge IS NOT NULL AND vy - hedge * c > 1e-24),
    m AS (SELECT *, coalesce(last_value(CASE WHEN abs(round(z, 6)) <= 0.5 THEN 0.0::DOUBLE WHEN round(z, 6) >= 2 THEN -1 WHEN round(z, 6) <= -2 THEN 1 END IGNORE NULLS) OVER (PARTITION BY sa, sb ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS position FROM g),
    t AS (SELECT *, CASE WHEN ny IS NOT NULL THEN abs(position - coalesce(lag(position) OVER (PARTITION BY sa, sb ORDER BY ts), 0)) END AS turn, position * (ny - y - hedge * (nx - x)) / (1 + abs(hedge)) AS gross FROM m),
    e AS (SELECT *, gross - 0.0004 * turn AS net, product(1 + gross - 0.0004 * turn) OVER (PARTITION BY sa, sb ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM t), d AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY sa, sb ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS fall FROM e),
    k AS (SELECT sa, sb, coalesce(count(*) FILTER (turn > 0 AND position <> 0) >= 3 AND round(product(1 + net) - 1, 9) > 0 AND round(avg(net), 12) >= 0 AND round(max(fall), 9) <= 0.2, false) AS passed FROM d GROUP BY 1, 2)
    SELECT sa, sb, ts, round(z, 4) AS z, position, round(gross, 6) AS gross, round(net, 6) AS net, passed FROM d JOIN k USING (sa, sb)""")
def pf_pair_panel(spark, sf):
    return sg.pair_positions(_pairs(spark, sf), ["sa", "sb"]).select("sa", "sb", "ts", *r("z", n=4), "position", *r("gross", "net"), "passed")


CORR = f"WITH j AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS y, bench / lag(bench) OVER ({S}) - 1 AS x, bench, avg(bench) OVER {rows(20)} AS ma FROM bars_w JOIN bench_w USING (ts))"


@query(f"{CORR} SELECT symbol, ts, coalesce(CASE WHEN count(y) OVER {rows(26)} >= 26 THEN round(corr(y, x) OVER {rows(26)}, 8) > 0.1 END AND bench < ma, false) AS cash FROM j")
def w_rolling_corr(spark, sf):
    j = src.weekly(spark, sf).join(src.benchmark(spark, sf), "ts")
    j = j.withColumns({"y": F.col("close") / f.lag("close") - 1, "x": F.col("bench") / f.lag("bench") - 1, "ma": f.over(F.avg("bench"), 20)})
    high = F.when(f.over(F.count("y"), 26) >= 26, F.round(f.over(F.corr("y", "x"), 26), 8) > 0.1)
    return j.select("symbol", "ts", F.coalesce(high & (F.col("bench") < F.col("ma")), F.lit(False)).alias("cash"))


@query(f"""WITH q AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS rt, 1 - close / max(close) OVER {rows(252)} AS dd FROM bars_d), p AS (SELECT symbol, ts, close / max(close) OVER {rows(252)} AS high_proximity, close / min(close) OVER {rows(252)} - 1 AS from_low, lag(close, 21) OVER ({S}) / lag(close, 252) OVER ({S}) - 1 AS mom_12_1, close / lag(close, 63) OVER ({S}) - 1 AS mom_3m, close / lag(close, 21) OVER ({S}) - 1 AS mom_1m, stddev_samp(rt) OVER {rows(63)} * sqrt(252) AS vol, max(dd) OVER {rows(252)} AS max_dd FROM q)
, bt AS (SELECT symbol, ts, covar_pop(y, x) OVER {rows(252)} / nullif(var_pop(x) OVER {rows(252)}, 0) AS beta FROM (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS y, bench / lag(bench) OVER ({S}) - 1 AS x FROM bars_d JOIN bench_d USING (ts)))
    SELECT symbol, round(high_proximity, 6) AS high_proximity, round(from_low, 6) AS from_low, round(mom_12_1, 6) AS mom_12_1, round(mom_3m, 6) AS mom_3m, round(mom_1m, 6) AS mom_1m, round(vol, 6) AS vol, round(max_dd, 6) AS max_dd, round(beta, 6) AS beta FROM p JOIN bt USING (symbol, ts) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def w_technical_profile(spark, sf):
    x = sg.technical_profile(src.daily(spark, sf), src.benchmark(spark, sf, "day")).withColumnRenamed("vol_sample", "vol")
    return x.select("symbol", *r("high_proximity", "from_low", "mom_12_1", "mom_3m", "mom_1m", "vol", "max_dd", "beta"))


@query(f"WITH l AS (SELECT symbol, ts, close, list(close) OVER {rows(252)} AS past, CASE WHEN count(close) OVER {rows(200)} = 200 THEN avg(close) OVER {rows(200)} END AS ma FROM bars_d) SELECT symbol, ts, round(CASE WHEN len(past) >= 60 THEN len(list_filter(past, lambda x: x <= close)) / len(past) END, 6) AS percentile, round(close / ma - 1, 6) AS ma_distance, round(close / list_max(past) - 1, 6) AS drawdown, round(close / list_min(past[-60:]) - 1, 6) AS off_low FROM l")
def w_vix_percentile(spark, sf):
    return sg.level_percentile(src.daily(spark, sf)).select("symbol", "ts", *r("percentile", "ma_distance", "drawdown", "off_low"))


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT symbol, ts, tr, row_number() OVER ({S}) AS n, avg(tr) OVER {rows(14)} AS seed FROM ({TR})), w AS (SELECT symbol, n, seed AS atr FROM t WHERE n = 14 UNION ALL SELECT t.symbol, t.n, w.atr + (t.tr - w.atr) / 14 FROM w JOIN t ON t.symbol = w.symbol AND t.n = w.n + 1)
    SELECT t.symbol, t.ts, round(w.atr, 5) AS atr FROM t LEFT JOIN w USING (symbol, n)""")
def w_atr_wilder(spark, sf):
    return states.wilder_atr(src.daily(spark, sf)).select("symbol", "ts", *r("atr", n=5))


@query(f"""WITH RECURSIVE b AS (SELECT *, lag(close) OVER ({S}) AS c0 FROM bars_w), o AS MATERIALIZED (SELECT symbol, ts, sum(CASE WHEN c0 IS NULL OR close > c0 THEN volume WHEN close < c0 THEN -volume ELSE 0 END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv, row_number() OVER ({S}) AS n FROM b),
    e AS (SELECT symbol, n, obv AS ema FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.n, 2.0 / 21 * o.obv + (1 - 2.0 / 21) * e.ema FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1) SELECT symbol, ts, obv, round(ema, 4) AS ema FROM o JOIN e USING (symbol, n)""")
def w_obv_ema(spark, sf):
    return states.obv_ema(src.weekly(spark, sf)).select("symbol", "ts", "obv", *r("ema", n=4))


@query(f"""{HOLD}, q AS (SELECT symbol, ts, lead(close) OVER ({S}) / close - 1 AS nxt FROM bars_w), st AS (SELECT ts, sum(weight * nxt) AS ret FROM h JOIN q USING (ts, symbol) WHERE nxt IS NOT NULL GROUP BY 1),
    b AS (SELECT ts, bench, CASE WHEN count(*) OVER w = 200 THEN avg(bench) OVER w END AS ma FROM bench_d WINDOW w AS (ORDER BY ts ROWS 199 PRECEDING)), j AS (SELECT st.ts, ret, coalesce(round(bench - ma, 9) > 0, true) AS invested FROM st ASOF LEFT JOIN b ON st.ts >= b.ts),
    o AS (SELECT *, CASE WHEN invested THEN ret ELSE 0 END - CASE WHEN invested <> coalesce(lag(invested) OVER (ORDER BY ts), true) THEN 0.001 ELSE 0 END AS overlaid FROM j), n AS (SELECT *, exp(sum(ln(1 + overlaid)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS nav FROM o)
    SELECT ts, invested, round(ret, 6) AS ret, round(overlaid, 6) AS overlaid, round(nav, 6) AS nav, round(1 - nav / max(nav) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS drawdown, round(avg(overlaid) OVER () / stddev_samp(overlaid) OVER () * sqrt(52), 5) AS sharpe FROM n""")
def pf_ma_overlay(spark, sf):
    q = src.weekly(spark, sf).select("symbol", "ts", (F.lead("close").over(f.series()) / F.col("close") - 1).alias("nxt")).where("nxt IS NOT NULL")
    held = holdings(spark, sf).select("ts", "symbol", "weight").join(q, ["ts", "symbol"]).groupBy("ts").agg(F.sum(F.col("weight") * F.col("nxt")).alias("ret"))
    return pf.ma_overlay(held, src.benchmark(spark, sf, "day"), fee=0.001).select("ts", "invested", *r("ret", "overlaid", "nav", "drawdown"), *r("sharpe", n=5))
