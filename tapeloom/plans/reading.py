"""Queries of patterns, fused readings, studies, scorecards and the remaining tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import scalars as sc
from tapeloom.functions import stats as st
from tapeloom.operators import candles, gaps, macro as mac, portfolio as pf, reading as rd, risk as rk, signals as sg, states, valuation as val
from tapeloom.operators import crosssection as xs
from tapeloom.operators import blocks, exposure
from tapeloom.operators import features as f
from tapeloom.operators import shapes
from tapeloom.operators.pretrade import Policy, check
from tapeloom.plans.analysis import AQR, FAIR, METRICS as METRICS_SQL, MONTHLY, RATIOS, REG, aqr, compounders, fair_rows, monthly, regimes
from tapeloom.plans.candles import GAP
from tapeloom.plans.chart import panel
from tapeloom.plans.market import PROFILE, exact_cdf, ncdf, profile
from tapeloom.plans.registry import query
from tapeloom.plans.selection import HOLD, MOM
from tapeloom.plans.structure import BLOCKS
from tapeloom.plans.windows import S, _pivot_sql, r, rows
from tapeloom.sources import adapters as src
from tapeloom.streaming.live import written


def _double(kind: str, pivot: str, price: str, edge: str) -> str:
    return f"""{kind} AS (SELECT a.symbol, a.ts, a.confirmed_ts, a.p1 AS first_price, a.price AS second_price, {edge} AS neckline, '{kind}' AS kind FROM (SELECT symbol, ts, confirmed_ts, n, {price} AS price, lag({price}) OVER w AS p1, lag(n) OVER w AS n1, lag(n, 2) OVER w AS n0 FROM pv WHERE {pivot} WINDOW w AS (PARTITION BY symbol ORDER BY n)) a
    JOIN pv b ON b.symbol = a.symbol AND b.n > a.n1 AND b.n < a.n WHERE abs(a.price / a.p1 - 1) <= 0.03 AND a.n - a.n1 >= 5 AND a.n - a.n0 >= 10 GROUP BY ALL)"""


DOUBLES = f"""WITH {_pivot_sql(True)}, pv AS (SELECT b.symbol, b.ts, b.high, b.low, p.confirmed_ts, p.pivot_high, p.pivot_low, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS n FROM bars_d b JOIN p USING (symbol, ts)), {_double('top', 'pivot_high', 'high', 'min(b.low)')}, {_double('bottom', 'pivot_low', 'low', 'max(b.high)')}"""


@query(f"{DOUBLES} SELECT * FROM top UNION ALL SELECT * FROM bottom")
def pat_double(spark, sf):
    b = src.daily(spark, sf)
    return rd.double_tops(b).withColumn("kind", F.lit("top")).unionByName(rd.double_tops(b, side="low").withColumn("kind", F.lit("bottom")))


@query()
def pat_hs(spark, sf):
    return rd.head_shoulders(src.daily(spark, sf))


@query(f"{DOUBLES} SELECT t.symbol, t.confirmed_ts AS ts, first_price, second_price, neckline, min(b.ts) FILTER (b.close < neckline) AS breakout_ts, min(b.ts) FILTER (b.close > greatest(first_price, second_price)) AS failed_ts FROM top t LEFT JOIN bars_d b ON b.symbol = t.symbol AND b.ts > t.confirmed_ts GROUP BY ALL")
def pat_breakout(spark, sf):
    b = src.daily(spark, sf)
    hits = {"breakout_ts": [("close", "<", F.col("neckline"))], "failed_ts": [("close", ">", F.greatest("first_price", "second_price"))]}
    tops = rd.double_tops(b).drop("ts").withColumnRenamed("confirmed_ts", "ts")
    return gaps.first_hits(tops, b, hits, ("first_price", "second_price", "neckline"))


@query()
def vp_value_area(spark, sf):
    return rd.value_area(profile(spark, sf), ["symbol", "year"])


@query(f"WITH {PROFILE}, q AS (SELECT *, max(volume) OVER (PARTITION BY symbol, year) AS top FROM p), g AS (SELECT symbol, year, round(sum(bin * volume) / sum(volume) / 23, 6) AS centre, arg_max(bin, row(round(volume, 6), -bin)) AS poc, count(*) FILTER (volume >= 0.8 * top) AS n_peaks FROM q GROUP BY 1, 2) SELECT symbol, year, poc, n_peaks, CASE WHEN n_peaks > 8 THEN 'B' WHEN centre > 0.6 AND poc > 13 THEN 'P' WHEN centre < 0.4 AND poc < 10 THEN 'b' ELSE 'D' END AS shape FROM g")
def vp_shape(spark, sf):
    p = profile(spark, sf)
    w = Window.partitionBy("symbol", "year")
    where = F.round(F.sum(F.col("bin") * F.col("volume")) / F.sum("volume") / 23, 6)
    g = p.withColumn("top", F.max("volume").over(w)).groupBy("symbol", "year").agg(where.alias("centre"), F.max_by("bin", F.struct(F.round("volume", 6), -F.col("bin"))).alias("poc"), F.count(F.when(F.col("volume") >= 0.8 * F.col("top"), 1)).alias("n_peaks"))
    shape = F.when(F.col("n_peaks") > 8, "B").when((F.col("centre") > 0.6) & (F.col("poc") > 13), "P").when((F.col("centre") < 0.4) & (F.col("poc") < 10), "b").otherwise("D")
    return g.select("symbol", "year", "poc", "n_peaks", shape.alias("shape"))


@query(f"""WITH {PROFILE}, c AS (SELECT symbol, year, bin FROM p QUALIFY row_number() OVER (PARTITION BY symbol, year ORDER BY round(volume, 6) DESC, bin) = 1), pr AS (SELECT c.symbol, c.year, any_value(wlo) + (c.bin + 0.5) * any_value(step) AS price, max(w.ts) AS formed_ts FROM c JOIN w ON w.symbol = c.symbol AND w.y = c.year GROUP BY c.symbol, c.year, c.bin),
    y AS (SELECT symbol, year(ts) AS y, min(low) AS lo, max(high) AS hi FROM bars_d GROUP BY 1, 2), sy AS (SELECT symbol, max(ts) AS ends FROM bars_d GROUP BY 1)
    SELECT symbol, year, round(price, 4) AS price, formed_ts FROM pr JOIN sy USING (symbol) WHERE date_diff('day', formed_ts, ends) <= 2 * 600 AND NOT EXISTS (SELECT 1 FROM y WHERE y.symbol = pr.symbol AND y.y > pr.year AND round(pr.price, 6) BETWEEN round(lo, 6) AND round(hi, 6))""")
def vp_naked_poc(spark, sf):
    """Points of control that no later bar touched, formed at most twice ``sessions`` days before the series' end."""
    sessions, bars = 600, src.daily(spark, sf)
    best = F.max_by((F.col("lo") + F.col("hi")) / 2, F.struct(F.round("volume", 6), -F.col("bin")))
    poc = profile(spark, sf).groupBy("symbol", "year").agg(F.round(best, 6).alias("price"))
    by_year = bars.groupBy(F.col("symbol").alias("s"), F.year("ts").alias("y")).agg(F.round(F.min("low"), 6).alias("low"), F.round(F.max("high"), 6).alias("high"), F.max("ts").alias("formed_ts"))
    ends = by_year.groupBy("s").agg(F.max("formed_ts").alias("ends"))
    own = by_year.join(ends, "s").where(F.datediff("ends", "formed_ts") <= 2 * sessions).select(F.col("s").alias("symbol"), F.col("y").alias("year"), "formed_ts")
    naked = poc.join(by_year, (F.col("symbol") == F.col("s")) & (F.col("y") > F.col("year")) & F.col("price").between(F.col("low"), F.col("high")), "left_anti")
    return naked.join(own, ["symbol", "year"]).select("symbol", "year", *r("price", n=4), "formed_ts")


@query()
def cdl_at_level(spark, sf):
    b = f.atr(src.daily(spark, sf))
    levels = f.pivot_labels(src.daily(spark, sf)).select("symbol", F.col("confirmed_ts").alias("ts"), "price").where("ts IS NOT NULL")
    known = levels.groupBy("symbol", "ts").agg(F.collect_list("price").alias("p"))
    x = b.join(known, ["symbol", "ts"], "left").withColumn("levels", F.flatten(F.collect_list("p").over(f.last(60))))
    near = F.exists("levels", lambda p: (F.abs(F.col("close") - p) <= 0.01 * p) & (F.abs(F.col("close") - p) <= 0.5 * F.col("atr")))
    return candles.scan(src.daily(spark, sf)).join(x.select("symbol", "ts", F.coalesce(near, F.lit(False)).alias("at_level")), ["symbol", "ts"])


def _resample(by: str, block: int, samples: int, seed: int):
    """Moving-block bounds of mean(ACT) - mean(AVOID), and the p-value under block-shuffled labels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("ts")
        x, act, avoid = p["fwd"].to_numpy(), (p["decision"] == "ACT").to_numpy(), (p["decision"] == "AVOID").to_numpy()
        rng, n = np.random.default_rng(seed), len(p)
        diff = lambda at, a, v: x[at][a].mean() - x[at][v].mean() if a.any() and v.any() else np.nan
        own = diff(np.arange(n), act, avoid)
        got, null, blocks = [], [], np.array_split(np.arange(n), np.arange(block, n, block))
        for _ in range(samples):
            at = ((rng.integers(0, n, -(-n // block))[:, None] + np.arange(block)) % n).ravel()[:n]
            got.append(diff(at, act[at], avoid[at]))
            mixed = np.concatenate([blocks[k] for k in rng.permutation(len(blocks))])  # every label once, in blocks
            null.append(diff(np.arange(n), act[mixed], avoid[mixed]))
        null = np.array(null)
        return pd.DataFrame({by: [p[by].iloc[0]], "n": [n], "spread": [own], "low": [np.nanquantile(got, 0.05)], "high": [np.nanquantile(got, 0.95)], "p_value": [((np.abs(null) >= abs(own)).sum() + 1) / (samples + 1)]})

    return run


@query()
def st_bootstrap_spread(spark, sf):
    x = panel(spark, sf).where("fwd20 IS NOT NULL").select("symbol", "ts", F.col("act").alias("decision"), F.col("fwd20").alias("fwd"))
    return x.groupBy("symbol").applyInPandas(_resample("symbol", 20, 2000, 7), "symbol string, n long, spread double, low double, high double, p_value double").drop("p_value")


@query()
def st_block_permutation(spark, sf):
    x = panel(spark, sf).where("fwd20 IS NOT NULL").select("symbol", "ts", F.col("act").alias("decision"), F.col("fwd20").alias("fwd"))
    return x.groupBy("symbol").applyInPandas(_resample("symbol", 20, 2000, 11), "symbol string, n long, spread double, low double, high double, p_value double").drop("low", "high")


def _grid(spark, sf, lookbacks=(4, 12, 26), tops=(3, 7)):
    """Returns of the rotation for every pair of parameters, one long table."""
    g = pf.rotation_grid(written(src.weekly(spark, sf), "grid-bars"), lookbacks, tops)
    return g.select("ts", F.concat(F.lit("k"), F.col("lookback").cast("string"), F.lit("n"), F.col("top_n").cast("string")).alias("config"), F.col("net").alias("ret"))


def _sharpes(panel):
    """Sharpe ratio and growth, in logarithms, of each configuration and year."""
    sd = F.stddev_pop("ret")
    return panel.groupBy("config", F.year("ts").alias("year")).agg(F.when(sd > 0, F.avg("ret") / sd).otherwise(0.0).alias("sr"), F.sum(F.log1p("ret")).alias("total"))


def _walk(spark, sf):
    y = _sharpes(_grid(spark, sf))
    best = y.withColumn("n", F.row_number().over(Window.partitionBy("year").orderBy(F.desc(F.round("sr", 9)), "config"))).where("n = 1").select((F.col("year") + 1).alias("year"), "config", F.col("sr").alias("train_sr"))
    bench = src.benchmark(spark, sf).groupBy(F.year("ts").alias("year")).agg(F.log(F.max_by("bench", "ts") / F.min_by("bench", "ts")).alias("bench"))
    return best.join(y.withColumnsRenamed({"sr": "test_sr", "total": "test_total"}), ["year", "config"]).join(bench, "year")


def _rotated(k: int, n: int) -> str:
    """SQL of one configuration's net returns: ts, config, ret."""
    return f"""SELECT * FROM (WITH x AS (SELECT symbol, ts, close / lag(close, {k}) OVER ({S}) - 1 AS mom FROM bars_w), cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n FROM (SELECT DISTINCT ts FROM bars_w)), c AS (SELECT ts, (n - {k}) // 4 AS period, (n - {k}) % 4 = 0 AS reb, lead(ts) OVER (ORDER BY ts) AS earn FROM cal WHERE n >= {k}),
    h AS (SELECT period, symbol, 1.0 / count(*) OVER (PARTITION BY period) AS weight FROM (SELECT ts, symbol FROM x WHERE mom > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) <= {n}) JOIN c USING (ts) WHERE reb), q AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w),
    g AS (SELECT c.earn AS ts, c.period, sum(weight * coalesce(ret, 0)) AS gross FROM c JOIN h USING (period) LEFT JOIN q ON q.ts = c.earn AND q.symbol = h.symbol WHERE c.earn IS NOT NULL GROUP BY 1, 2), d AS (SELECT period, lead(period) OVER (ORDER BY period) AS nx FROM (SELECT DISTINCT period FROM h)),
    l AS (SELECT period, symbol, weight FROM h UNION ALL SELECT nx, symbol, -weight FROM h JOIN d USING (period) WHERE nx IS NOT NULL), tt AS (SELECT period, sum(abs(ch)) * 0.0005 AS cost FROM (SELECT period, symbol, sum(weight) AS ch FROM l GROUP BY 1, 2) GROUP BY 1), ff AS (SELECT period, min(earn) AS ts FROM c WHERE earn IS NOT NULL GROUP BY 1)
    SELECT g.ts, 'k{k}n{n}' AS config, gross - coalesce(cost, 0) AS ret FROM g LEFT JOIN (SELECT ff.ts, cost FROM tt JOIN ff USING (period)) z ON z.ts = g.ts)"""


GRID = f"gr AS ({' UNION ALL '.join(_rotated(k, n) for k in (4, 12, 26) for n in (3, 7))})"
WALK = f"""WITH {GRID}, yr AS (SELECT config, year(ts) AS year, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) ELSE 0 END AS sr, sum(ln(1 + ret)) AS total FROM gr GROUP BY 1, 2), bt AS (SELECT year + 1 AS year, config, sr AS train_sr FROM yr QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(sr, 9) DESC, config) = 1),
    bb AS (SELECT year(ts) AS year, ln(arg_max(bench, ts) / arg_min(bench, ts)) AS bench FROM bench_w GROUP BY 1), wk AS (SELECT year, config, train_sr, yr.sr AS test_sr, yr.total AS test_total, bench FROM bt JOIN yr USING (year, config) JOIN bb USING (year))"""


@query(f"{WALK} SELECT year, config, round(train_sr, 6) AS train_sr, round(test_sr, 6) AS test_sr, round(test_total, 5) AS test_total, round(bench, 6) AS bench FROM wk")
def st_walk_forward(spark, sf):
    return _walk(spark, sf).select("year", "config", *r("train_sr", "test_sr"), *r("test_total", n=5), *r("bench"))


@query(f"WITH {GRID} SELECT config, CASE WHEN year(ts) <= 1997 THEN 'train' ELSE 'test' END AS half, count(*) AS n, round(CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) ELSE 0 END, 6) AS sr FROM gr GROUP BY 1, 2")
def st_robustness_grid(spark, sf):
    p = _grid(spark, sf).withColumn("half", F.when(F.year("ts") <= 1997, "train").otherwise("test"))
    sd = F.stddev_pop("ret")
    return p.groupBy("config", "half").agg(F.count("*").alias("n"), F.round(F.when(sd > 0, F.avg("ret") / sd).otherwise(0.0), 6).alias("sr"))


@query(f"{WALK} SELECT count(*) AS n, round(avg(CASE WHEN test_total > bench THEN 1.0 ELSE 0 END), 6) AS positive_rate, round(quantile_cont(test_total - bench, 0.5), 5) AS median_excess, round(avg(test_total - bench), 5) AS mean_excess, round(min(test_total - bench), 5) AS worst_excess FROM wk")
def st_grid_summary(spark, sf):
    w = _walk(spark, sf).withColumn("excess", F.col("test_total") - F.col("bench"))
    near = lambda c, n: F.round(c, 5).alias(n)
    return w.agg(F.count("*").alias("n"), F.round(F.avg((F.col("excess") > 0).cast("double")), 6).alias("positive_rate"), near(F.expr("percentile(excess, 0.5)"), "median_excess"), near(F.avg("excess"), "mean_excess"), near(F.min("excess"), "worst_excess"))


#: Rows of the suite: the walk-forward, the mean excess after fees of 5 and 10 basis points a week, the spread over the
#: parameters, and the windows of stress.
STRESS = (("first", "1995-03-01", "1995-06-30"), ("second", "1997-01-01", "1997-04-30"))


@query(f"""{WALK}, fees AS (SELECT unnest([0.0, 0.0005, 0.001]) AS fee), m AS (SELECT ts, avg(ret) AS ret FROM gr GROUP BY 1), s AS (SELECT config, avg(ret) / stddev_pop(ret) AS sr FROM gr GROUP BY 1), rows_ AS (
    SELECT 'walk_forward' AS part, 'win_rate' AS name, avg(CASE WHEN test_total > bench THEN 1.0 ELSE 0 END) AS value FROM wk UNION ALL SELECT 'walk_forward', 'worst_year', min(test_total) FROM wk
    UNION ALL SELECT 'fees', printf('%.4f', fee), avg(ret - fee) FROM m, fees GROUP BY fee UNION ALL SELECT 'parameters', 'least', min(sr) FROM s UNION ALL SELECT 'parameters', 'spread', max(sr) - min(sr) FROM s
    UNION ALL SELECT 'stress', w.name, exp(sum(ln(1 + ret))) - 1 FROM m JOIN (VALUES ('first', DATE '1995-03-01', DATE '1995-06-30'), ('second', DATE '1997-01-01', DATE '1997-04-30')) w(name, lo, hi) ON ts BETWEEN w.lo AND w.hi GROUP BY 2)
    SELECT part, name, round(value, 6) AS value, round(value, 6) >= CASE part WHEN 'walk_forward' THEN CASE name WHEN 'win_rate' THEN 0.6 ELSE -0.3 END WHEN 'stress' THEN -0.25 WHEN 'parameters' THEN CASE name WHEN 'spread' THEN -1 ELSE 0 END ELSE 0 END AS passed FROM rows_""")
def st_validation_suite(spark, sf):
    g = written(_grid(spark, sf), "suite")
    w = _walk(spark, sf)
    mean = g.groupBy("ts").agg(F.avg("ret").alias("ret"))
    part = lambda df, p, pairs: df.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in pairs))).alias("x")).select("x.*")
    walk = part(w.agg(F.avg((F.col("test_total") > F.col("bench")).cast("double")).alias("a"), F.min("test_total").alias("b")), "walk_forward", (("win_rate", "a"), ("worst_year", "b")))
    fees = part(mean.agg(*(F.avg(F.col("ret") - fee).alias(n) for n, fee in (("a", 0.0), ("b", 0.0005), ("c", 0.001)))), "fees", (("0.0000", "a"), ("0.0005", "b"), ("0.0010", "c")))
    sr = g.groupBy("config").agg((F.avg("ret") / F.stddev_pop("ret")).alias("sr")).agg(F.min("sr").alias("a"), (F.max("sr") - F.min("sr")).alias("b"))
    inside = {n: F.col("ts").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) for n, lo, hi in STRESS}
    stress = part(mean.agg(*((F.exp(F.sum(F.when(c, F.log1p("ret")))) - 1).alias(n) for n, c in inside.items())), "stress", tuple((n, n) for n in inside)).where("value IS NOT NULL")
    all_ = walk.unionByName(fees).unionByName(part(sr, "parameters", (("least", "a"), ("spread", "b")))).unionByName(stress).withColumn("value", F.round("value", 6))
    least = F.when(F.col("part") == "walk_forward", F.when(F.col("name") == "win_rate", 0.6).otherwise(-0.3)).when(F.col("part") == "stress", -0.25).when(F.col("name") == "spread", -1.0).otherwise(0.0)
    return all_.withColumn("passed", F.col("value") >= least)


@query(f"WITH x AS (SELECT symbol, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w), m AS (SELECT symbol, round(avg(ret) / stddev_samp(ret), 9) AS sr, count(ret) AS n FROM x WHERE ret IS NOT NULL GROUP BY 1) SELECT symbol, concat_ws(',', CASE WHEN sr < 0.2 THEN 'sharpe' END, CASE WHEN n < 300 THEN 'history' END) AS reasons, NOT (sr < 0.2 OR n < 300) AS promoted FROM m")
def st_promotion_gate(spark, sf):
    m = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").groupBy("symbol").agg(F.round(F.avg("ret") / F.stddev_samp("ret"), 9).alias("sr"), F.count("*").alias("n"))
    reasons = F.filter(F.array(F.when(F.col("sr") < 0.2, "sharpe"), F.when(F.col("n") < 300, "history")), lambda x: x.isNotNull())
    return m.select("symbol", F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("promoted"))


RETEST = f"""{BLOCKS}, okn AS (SELECT ok.*, s.n AS bn, (bottom + top) / 2 AS mid FROM ok JOIN sw s ON s.symbol = ok.symbol AND s.ts = ok.block_ts),
    en AS (SELECT o.symbol, o.block_ts, o.ts, o.direction, o.mid, o.extreme, o.has_gap, o.strength, CASE o.direction WHEN 'bullish' THEN 1 ELSE -1 END AS sign, min(b.n) AS k FROM okn o JOIN sw b ON b.symbol = o.symbol AND b.n > o.bn AND CASE o.direction WHEN 'bullish' THEN b.low <= o.mid ELSE b.high >= o.mid END WHERE CASE o.direction WHEN 'bullish' THEN o.mid > o.extreme ELSE o.extreme > o.mid END GROUP BY ALL),
    oc2 AS (SELECT e.*, rr, min(b.n) FILTER (CASE sign WHEN 1 THEN b.low <= extreme ELSE b.high >= extreme END) AS lost, min(b.n) FILTER (CASE sign WHEN 1 THEN b.high >= mid + rr * (mid - extreme) ELSE b.low <= mid + rr * (mid - extreme) END) AS won FROM en e CROSS JOIN (SELECT unnest([1.0, 1.5, 2.0]) AS rr) LEFT JOIN sw b ON b.symbol = e.symbol AND b.n > e.k AND b.n <= e.k + 30 GROUP BY ALL),
    rs AS (SELECT symbol, block_ts, ts, direction, mid, extreme, has_gap, strength, sign, k, map_from_entries(list((rr, CASE WHEN lost IS NOT NULL AND (won IS NULL OR lost <= won) THEN 'stop' WHEN won IS NOT NULL THEN 'target' ELSE 'timeout' END))) AS o FROM oc2 GROUP BY ALL)
    SELECT rs.symbol, block_ts, direction, b.ts AS entry_ts, round(mid, 6) AS entry, round(extreme, 6) AS stop, has_gap, strength, o[1.0] AS rr_10, o[1.5] AS rr_15, o[2.0] AS rr_20, round(sign * (c.close / mid - 1), 6) AS fwd_6, round(sign * (d.close / mid - 1), 6) AS fwd_12, round(sign * (e.close / mid - 1), 6) AS fwd_24
    FROM rs JOIN sw b ON b.symbol = rs.symbol AND b.n = k LEFT JOIN sw c ON c.symbol = rs.symbol AND c.n = k + 6 LEFT JOIN sw d ON d.symbol = rs.symbol AND d.n = k + 12 LEFT JOIN sw e ON e.symbol = rs.symbol AND e.n = k + 24"""


@query(RETEST)
def st_event_study(spark, sf):
    """Order blocks entered at the first retest of their middle: the target or the stop first within 30 bars, and signed returns."""
    b = src.daily(spark, sf)
    return rd.retests(b, blocks.detect(b)).select("symbol", "block_ts", "direction", "entry_ts", *r("entry", "stop"), "has_gap", "strength", "rr_10", "rr_15", "rr_20", *r("fwd_6", "fwd_12", "fwd_24"))


@query("SELECT symbol, period_end, round(revenue, 2) AS revenue FROM fund_q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY md5('7' || symbol || CAST(period_end AS VARCHAR)), period_end) <= greatest(1, round(0.6 * count(*) OVER (PARTITION BY symbol)))")
def st_degrade_sample(spark, sf):
    by = Window.partitionBy("symbol")
    seeded = F.row_number().over(by.orderBy(F.md5(F.concat(F.lit("7"), "symbol", F.col("period_end").cast("string"))), "period_end"))
    x = src.fundamentals(spark, sf).withColumns({"__n": seeded, "__keep": F.greatest(F.lit(1.0), F.round(0.6 * F.count("*").over(by)))})
    return x.where("__n <= __keep").select("symbol", "period_end", *r("revenue", n=2))


@query()
def st_pattern_mining(spark, sf):
    b = rd.votes(src.daily(spark, sf)).withColumns({f"h{h}": F.lead("close", h).over(f.series()) / F.col("close") - 1 for h in (5, 20)})
    conds = {"trend_up": F.col("trend") == "up", "high_volume": F.col("rvol") > 1.5, "discount": F.col("range_position") < 0.2}
    was = b.withColumns({f"c_{n}": F.coalesce(c, F.lit(False)) for n, c in conds.items()})
    was = was.withColumns({f"e_{n}": F.col(f"c_{n}") & ~F.coalesce(f.lag(f"c_{n}"), F.lit(False)) for n in conds})
    long = was.select("symbol", F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.lit(h).alias("horizon"), F.when(F.col(f"e_{n}"), F.col(f"h{h}")).alias("fwd")) for n in conds for h in (5, 20)))).alias("x")).select("symbol", "x.*").where("fwd IS NOT NULL")
    from tapeloom.operators.aggregates import wilson

    g = long.groupBy("condition", "symbol", "horizon").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("fwd") > 0, 1)).cast("double").alias("wins"), F.avg("fwd").alias("mean"))
    return g.withColumn("bound", wilson(F.col("wins"), F.col("n"))[0])


@query(f"{HOLD}, q AS (SELECT symbol, ts, lead(close) OVER ({S}) / close - 1 AS nxt FROM bars_w), j AS (SELECT ts, sum(weight * nxt) AS ret FROM h JOIN q USING (ts, symbol) WHERE nxt IS NOT NULL GROUP BY 1), a AS (SELECT ts, avg(nxt) AS bench FROM q WHERE nxt IS NOT NULL GROUP BY 1) SELECT count(*) AS n, round(avg(ret - bench), 6) AS excess, round(avg(CASE WHEN ret > bench THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM j JOIN a USING (ts)")
def st_ledger_score(spark, sf):
    h = pf.equal_weights(pf.momentum_holdings(src.weekly(spark, sf), 12, 5)).select("ts", "symbol", "weight")
    nxt = src.weekly(spark, sf).select("symbol", "ts", (F.lead("close").over(f.series()) / F.col("close") - 1).alias("nxt")).where("nxt IS NOT NULL")
    j = h.join(nxt, ["symbol", "ts"]).groupBy("ts").agg(F.sum(F.col("weight") * F.col("nxt")).alias("ret"))
    all_ = nxt.groupBy("ts").agg(F.avg("nxt").alias("bench"))
    return j.join(all_, "ts").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ret") - F.col("bench")), 6).alias("excess"), F.round(F.avg((F.col("ret") > F.col("bench")).cast("double")), 6).alias("hit_rate"))


def _ridge(lags: int, ridge: float):
    """One-step AR forecasts by ridge least squares over an expanding window of one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("month")
        y = p["value"].to_numpy()
        out = [None] * len(y)
        for t in range(lags + 6, len(y)):
            x = np.column_stack([np.ones(t - lags), *(y[lags - k : t - k] for k in range(1, lags + 1))])
            pen = ridge * np.eye(lags + 1)
            pen[0, 0] = 0
            b = np.linalg.solve(x.T @ x + pen, x.T @ y[lags:t])
            out[t] = float(b[0] + b[1:] @ y[t - 1 : t - lags - 1 : -1] if t > lags else np.nan)
        return pd.DataFrame({"series_id": p["series_id"], "month": p["month"], "value": y, "ar": pd.array(out, dtype="Float64")})

    return run


def _ar(spark, sf):
    return monthly(spark, sf).groupBy("series_id").applyInPandas(_ridge(3, 1.0), "series_id string, month date, value double, ar double")


@query()
def mac_ar_bridge(spark, sf):
    return _ar(spark, sf)


@query()
def mac_ensemble(spark, sf):
    w = Window.partitionBy("series_id").orderBy("month")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    x = mac.baselines(_ar(spark, sf), "month").where("ar IS NOT NULL")
    models = ("ar", "last", "mean_n", "ewma")
    x = x.withColumns({f"w_{m}": 1 / F.avg((F.col("value") - F.col(m)) * (F.col("value") - F.col(m))).over(past) for m in models})
    total = sum((F.col(f"w_{m}") for m in models), F.lit(0.0))
    x = x.withColumn("ensemble", sum((F.col(f"w_{m}") * F.col(m) for m in models), F.lit(0.0)) / total).withColumn("e", F.col("value") - F.col("ensemble"))
    n = F.count("e").over(past)
    return x.select("series_id", "month", "value", "ensemble", F.when(n >= 12, F.col("ensemble") - 1.96 * F.stddev_samp("e").over(past)).alias("low95"), F.when(n >= 12, F.col("ensemble") + 1.96 * F.stddev_samp("e").over(past)).alias("high95"))


@query(f"""WITH {MONTHLY} SELECT series_id, month, round(value, 5) AS value, round(value / lag(value) OVER w - 1, 6) AS mom, round(value / lag(value, 3) OVER w - 1, 6) AS qoq, round(value / lag(value, 12) OVER w - 1, 6) AS yoy, round(stddev_samp(value) OVER y, 4) AS sd12, round(value / max(value) OVER y - 1, 6) AS off_high, round(value / min(value) OVER y - 1, 6) AS off_low,
    round(value / avg(value) OVER q - 1, 6) AS gap3, round(value / avg(value) OVER y - 1, 6) AS gap12, round((value - avg(value) OVER y) / nullif(stddev_samp(value) OVER y, 0), 5) AS z12, round((value / lag(value, 3) OVER w - 1) - (lag(value, 3) OVER w / lag(value, 6) OVER w - 1), 6) AS accel
    FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month), y AS (PARTITION BY series_id ORDER BY month ROWS 11 PRECEDING), q AS (PARTITION BY series_id ORDER BY month ROWS 2 PRECEDING)""")
def mac_indicator_panel(spark, sf):
    w = Window.partitionBy("series_id").orderBy("month")
    v = F.col("value")
    roll = lambda n: w.rowsBetween(-(n - 1), 0)
    back = lambda n: F.lag(v, n).over(w)
    sd, mean = F.stddev_samp(v).over(roll(12)), F.avg(v).over(roll(12))
    made = {
        "mom": v / back(1) - 1, "qoq": v / back(3) - 1, "yoy": v / back(12) - 1, "off_high": v / F.max(v).over(roll(12)) - 1, "off_low": v / F.min(v).over(roll(12)) - 1, "gap3": v / F.avg(v).over(roll(3)) - 1, "gap12": v / mean - 1,
        "accel": (v / back(3) - 1) - (back(3) / back(6) - 1),
    }
    return monthly(spark, sf).select("series_id", "month", F.round(v, 5).alias("value"), *(F.round(c, 6).alias(k) for k, c in made.items()), F.round(sd, 4).alias("sd12"), F.round(F.when(sd != 0, (v - mean) / sd), 5).alias("z12"))


@query(f"WITH {REG} SELECT month, raw AS regime, round(count(*) / sum(count(*)) OVER (PARTITION BY month), 6) AS confidence FROM l GROUP BY 1, 2")
def mac_regime_classify(spark, sf):
    n = F.count("*").over(Window.partitionBy("month"))
    return regimes(spark, sf).withColumn("n", n).groupBy("month", F.col("raw").alias("regime")).agg(F.round(F.count("*") / F.first("n"), 6).alias("confidence"))


@query(f"WITH {REG} SELECT month, round(100 * avg(CASE raw WHEN 'expansion' THEN 0.8 WHEN 'reflation' THEN 0.6 WHEN 'stagflation' THEN 0.3 WHEN 'slowdown' THEN 0.4 ELSE 0.1 END), 4) AS equity, round(100 - 100 * avg(CASE raw WHEN 'expansion' THEN 0.8 WHEN 'reflation' THEN 0.6 WHEN 'stagflation' THEN 0.3 WHEN 'slowdown' THEN 0.4 ELSE 0.1 END), 4) AS bonds FROM l GROUP BY 1")
def mac_template_blend(spark, sf):
    conf = regimes(spark, sf).groupBy("month").pivot("raw", ["expansion", "reflation", "stagflation", "slowdown", "crisis"]).agg(F.count(F.lit(1))).fillna(0)
    equity = 0.8 * F.col("expansion") + 0.6 * F.col("reflation") + 0.3 * F.col("stagflation") + 0.4 * F.col("slowdown") + 0.1 * F.col("crisis")
    n = sum((F.col(c) for c in ("expansion", "reflation", "stagflation", "slowdown", "crisis")), F.lit(0))
    return conf.select("month", F.round(100 * equity / n, 4).alias("equity"), F.round(100 - 100 * equity / n, 4).alias("bonds"))


HELD = f"{REG}, s AS (SELECT *, CASE WHEN raw = 'crisis' OR raw = lag(raw) OVER w OR lag(raw) OVER w IS NULL THEN raw END AS sure FROM l WINDOW w AS (PARTITION BY series_id ORDER BY month)), hy AS (SELECT series_id, month, last_value(sure IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS regime FROM s), nx AS (SELECT series_id, month, lead(value) OVER (PARTITION BY series_id ORDER BY month) / value - 1 AS fwd FROM mo)"


@query(f"WITH {HELD}, k AS (SELECT month, fwd, CASE regime WHEN 'crisis' THEN 0.0 WHEN 'expansion' THEN 1.0 ELSE 0.5 END AS share FROM hy JOIN nx USING (series_id, month) WHERE fwd IS NOT NULL) SELECT month, round(avg(share * fwd), 6) AS ret, round(avg(share), 6) AS exposure, count(*) AS n FROM k GROUP BY 1")
def mac_regime_returns(spark, sf):
    x = mac.hysteresis(regimes(spark, sf), "series_id", "month", "raw", ("crisis",))
    fwd = monthly(spark, sf).withColumn("fwd", F.lead("value").over(Window.partitionBy("series_id").orderBy("month")) / F.col("value") - 1).select("series_id", "month", "fwd")
    share = F.when(F.col("regime") == "crisis", 0.0).when(F.col("regime") == "expansion", 1.0).otherwise(0.5)
    return x.join(fwd, ["series_id", "month"]).where("fwd IS NOT NULL").groupBy("month").agg(F.round(F.avg(share * F.col("fwd")), 6).alias("ret"), F.round(F.avg(share), 6).alias("exposure"), F.count("*").alias("n"))


@query(f"""{AQR}, tp AS (SELECT ts, symbol, 1.0 / count(*) OVER (PARTITION BY ts) AS weight FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) <= 7)), nx AS (SELECT symbol, ts, lead(close) OVER ({S}) / close - 1 AS nxt FROM bars_w),
    pn AS (SELECT ts, sum(weight * nxt) AS raw FROM tp JOIN nx USING (ts, symbol) WHERE nxt IS NOT NULL GROUP BY 1), bm AS (SELECT ts, bench, CASE WHEN count(*) OVER w = 100 THEN avg(bench) OVER w END AS ma FROM bench_w WINDOW w AS (ORDER BY ts ROWS 99 PRECEDING)),
    vs AS (SELECT pn.ts, raw, stddev_pop(raw) OVER (ORDER BY pn.ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) * sqrt(52) AS vol, coalesce(round(bench - ma, 9) > 0, true) AS calm FROM pn LEFT JOIN bm USING (ts)),
    rk AS (SELECT ts, raw, calm, CASE WHEN vol > 0 THEN least(1, 0.15 / vol) ELSE 1 END * CASE WHEN calm THEN 1.0 ELSE 0.7 END AS scale FROM vs), nv AS (SELECT *, raw * scale AS ret, product(1 + raw * scale) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nav FROM rk), dn AS (SELECT *, round(1 - nav / max(nav) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) AS dd FROM nv),
    gd AS (SELECT *, coalesce(last_value(CASE WHEN dd >= 0.2 THEN false WHEN dd <= 0.1 THEN true END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_ FROM dn)
    SELECT ts, round(raw, 6) AS raw, calm, round(scale, 6) AS scale, on_ AS invested, round(CASE WHEN on_ THEN ret ELSE 0 END, 6) AS ret FROM gd""")
def pf_factor_panel(spark, sf):
    top = pf.equal_weights(xs.top(aqr(spark, sf), 7, [F.desc("score"), F.col("symbol")])).select("ts", "symbol", "weight")
    nxt = src.weekly(spark, sf).select("symbol", "ts", (F.lead("close").over(f.series()) / F.col("close") - 1).alias("nxt"))
    p = top.join(nxt, ["ts", "symbol"]).where("nxt IS NOT NULL").groupBy("ts").agg(F.sum(F.col("weight") * F.col("nxt")).alias("raw"))
    return pf.guarded(p, src.benchmark(spark, sf)).select("ts", *r("raw"), "calm", *r("scale"), "invested", *r("ret"))


@query()
def pf_monthly_window(spark, sf):
    b = f.momentum(f.returns(src.daily(spark, sf)), 60, out="mom").withColumns({"vol": f.full(F.stddev_pop("ret"), 20, "ret"), "fwd": F.lead("close", 21).over(f.series()) / F.col("close") - 1})
    month_end = F.row_number().over(Window.partitionBy("symbol", F.trunc("ts", "month")).orderBy(F.desc("ts")))
    m = b.withColumn("n", month_end).where("n = 1 AND mom IS NOT NULL AND vol IS NOT NULL").withColumn("ts", F.trunc("ts", "month"))
    w = pf.capped(pf.inverse_vol(xs.top(m, 3, [F.desc("mom"), F.col("symbol")])), 0.5)
    book = w.groupBy("ts").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("ret"), F.sort_array(F.collect_list(F.struct("symbol", "weight"))).alias("weights"))
    rows = book.select(F.lit("book").alias("book"), "ts", "ret", F.lit(1.25).alias("base"), F.lit(True).alias("watch"), "weights")
    return exposure.run(rows, ["book"], fee=0.0005).select("ts", "exposure", *r("turnover", "net", "equity", "drawdown"))


#: The market by month: mean and change of a 21-bar volatility index, drawdown from the 252-bar peak, and the next 21 bars of an equal book.
MARKET = """WITH RECURSIVE br AS (SELECT ts, bench, bench / lag(bench) OVER w - 1 AS ret FROM bench_d WINDOW w AS (ORDER BY ts)), bv AS (SELECT *, CASE WHEN count(ret) OVER k >= 21 THEN stddev_samp(ret) OVER k * sqrt(252) * 10 END AS vix, bench / max(bench) OVER (ORDER BY ts ROWS 251 PRECEDING) - 1 AS fall FROM br WINDOW k AS (ORDER BY ts ROWS 20 PRECEDING)),
    bm AS (SELECT *, avg(vix) OVER k AS mean, vix / first_value(vix) OVER k - 1 AS change FROM bv WINDOW k AS (ORDER BY ts ROWS 20 PRECEDING)), be AS (SELECT * FROM bm WHERE vix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts DESC) = 1),
    fw AS (SELECT symbol, ts, lead(close, 21) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM bars_d), bk AS (SELECT be.ts, any_value(mean) AS mean, any_value(change) AS change, any_value(fall) AS fall, avg(fwd) AS ret FROM be JOIN fw USING (ts) WHERE fwd IS NOT NULL GROUP BY 1),
    ru AS (SELECT ts, ret, unnest([{'rule': 'baseline', 'base': 1.0, 'watch': false}, {'rule': 'vix25', 'base': CASE WHEN mean > 25 THEN 0.5 ELSE 1 END, 'watch': false}, {'rule': 'vix30', 'base': CASE WHEN mean > 30 THEN 0.5 ELSE 1 END, 'watch': false}, {'rule': 'gradient', 'base': greatest(0.3, least(1, 1 - (mean - 20) / 15.0 * 0.7)), 'watch': false}, {'rule': 'spike', 'base': CASE WHEN change > 0.4 THEN 0.5 ELSE 1 END, 'watch': false},
        {'rule': 'market_dd5', 'base': CASE WHEN fall < -0.05 THEN 0.5 ELSE 1 END, 'watch': false}, {'rule': 'market_dd10', 'base': CASE WHEN fall < -0.1 THEN 0.5 ELSE 1 END, 'watch': false}, {'rule': 'port_trail10', 'base': 1.0, 'watch': true}, {'rule': 'combo', 'base': CASE WHEN fall < -0.08 THEN 0.5 ELSE 1 END, 'watch': true}], recursive := true) FROM bk),
    ro AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts) AS n FROM ru),
    eq AS (SELECT DISTINCT rule, 0::BIGINT AS n, NULL::DATE AS ts, 1.0::DOUBLE AS exposure, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak FROM ro
        UNION ALL SELECT rule, n, ts, x, equity * (1 + ret * x), peak FROM (SELECT ro.rule, ro.n, ro.ts, ro.ret, eq.equity, greatest(eq.peak, eq.equity) AS peak, CASE WHEN ro.watch AND eq.equity / greatest(eq.peak, eq.equity) - 1 < -0.1 THEN 0.5 ELSE ro.base END AS x FROM eq JOIN ro ON ro.rule = eq.rule AND ro.n = eq.n + 1))"""


@query(f"{MARKET} SELECT rule, ts, round(exposure, 6)::DOUBLE AS exposure, round(equity, 6) AS equity FROM eq WHERE n > 0")
def pf_exposure_rules(spark, sf):
    """All nine schedules over the same book; the tables have no volatility index, so the market's own volatility stands for it."""
    w = Window.orderBy("ts")  # a row a date
    b = src.benchmark(spark, sf, "day").withColumn("ret", F.col("bench") / F.lag("bench").over(w) - 1)
    last = w.rowsBetween(-20, 0)
    b = b.withColumns({"vix": F.when(F.count("ret").over(last) >= 21, F.stddev_samp("ret").over(last) * 252**0.5 * 10), "fall": F.col("bench") / F.max("bench").over(w.rowsBetween(-251, 0)) - 1})
    b = b.withColumns({"mean": F.avg("vix").over(last), "change": F.col("vix") / F.first("vix").over(last) - 1}).where("vix IS NOT NULL")
    end = b.withColumn("__n", F.row_number().over(Window.partitionBy(F.trunc("ts", "month")).orderBy(F.desc("ts")))).where("__n = 1")
    ahead = src.daily(spark, sf).select("ts", (F.lead("close", 21).over(f.series()) / F.col("close") - 1).alias("fwd")).where("fwd IS NOT NULL")
    book = end.join(ahead, "ts").groupBy("ts", "mean", "change", "fall").agg(F.avg("fwd").alias("ret"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), x.cast("double").alias("base"), F.lit(watch).alias("watch")) for k, (x, watch) in exposure.schedules(F.col("mean"), F.col("change"), F.col("fall")).items())))
    rows = book.select("ts", "ret", each.alias("r")).select("ts", "ret", "r.*", F.lit(None).cast("array<struct<symbol:string,weight:double>>").alias("weights"))
    return exposure.run(rows, ["rule"]).select("rule", "ts", *r("exposure", "equity"))


@query(f"WITH {MONTHLY}, x AS (SELECT series_id, month, value / lag(value) OVER (PARTITION BY series_id ORDER BY month) - 1 AS ret FROM mo) SELECT series_id, month, round(ret, 6) AS ret, round(ret - 0.002 + greatest(0, -0.05 - ret), 6) AS with_put FROM x WHERE ret IS NOT NULL")
def pf_monthly_overlay(spark, sf):
    w = Window.partitionBy("series_id").orderBy("month")
    m = monthly(spark, sf).withColumn("ret", F.col("value") / F.lag("value").over(w) - 1).where("ret IS NOT NULL")
    return m.select("series_id", "month", F.round("ret", 6).alias("ret"), F.round(F.col("ret") - 0.002 + F.greatest(F.lit(0.0), -0.05 - F.col("ret")), 6).alias("with_put"))


@query(f"WITH {HELD} SELECT series_id, month, regime, CASE regime WHEN 'expansion' THEN 1.5 WHEN 'crisis' THEN 0.0 ELSE 1.0 END::DOUBLE AS leverage, round(CASE regime WHEN 'expansion' THEN 1.5 WHEN 'crisis' THEN 0.0 ELSE 1.0 END * fwd, 6) AS ret FROM hy JOIN nx USING (series_id, month) WHERE fwd IS NOT NULL")
def pf_regime_leverage(spark, sf):
    x = mac.hysteresis(regimes(spark, sf), "series_id", "month", "raw", ("crisis",))
    lev = F.when(F.col("regime") == "expansion", 1.5).when(F.col("regime") == "crisis", 0.0).otherwise(1.0)
    nxt = monthly(spark, sf).withColumn("fwd", F.lead("value").over(Window.partitionBy("series_id").orderBy("month")) / F.col("value") - 1).select("series_id", "month", "fwd")
    return x.join(nxt, ["series_id", "month"]).where("fwd IS NOT NULL").select("series_id", "month", "regime", lev.alias("leverage"), F.round(lev * F.col("fwd"), 6).alias("ret"))


def _arch(name: str) -> str:
    """SQL of the blended score of an archetype and its coverage."""
    parts = [(abs(w), f"greatest(-3, least(3, {'-' if w < 0 else ''}z_{m}))") for m, w in val.ARCHETYPES[name]]
    held = " + ".join(f"CASE WHEN {x} IS NOT NULL AND {x.split('z_')[1].rstrip('))')} IS NOT NULL THEN {w} ELSE 0 END" for w, x in parts)
    sums = " + ".join(f"coalesce(CASE WHEN {x.split('z_')[1].rstrip('))')} IS NOT NULL THEN {w} * {x} END, 0)" for w, x in parts)
    return f"({sums}) / nullif({held}, 0) AS b_{name}, round({held}, 9) AS c_{name}"


_USED = sorted({m for ws in val.ARCHETYPES.values() for m, _ in ws})
ARCH = f"""{METRICS_SQL}, mx AS (SELECT symbol, period_end, {', '.join(f'{v} AS {k}' for k, v in RATIOS.items())} FROM l), zx AS (SELECT *, {', '.join(f'CASE WHEN {m} IS NULL THEN NULL WHEN count({m}) OVER () >= 2 AND stddev_pop({m}) OVER () > 1e-12 THEN ({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () ELSE 0 END AS z_{m}' for m in _USED)} FROM mx),
    bx AS (SELECT *, {', '.join(_arch(k) for k in val.ARCHETYPES)} FROM zx), sx AS (SELECT *, {', '.join(f'CASE WHEN c_{k} < 0.5 THEN 0 ELSE 100 * ({ncdf(f"b_{k}")}) END AS s_{k}' for k in val.ARCHETYPES)}, {' + '.join(f'CASE WHEN {m} IS NOT NULL THEN 1 ELSE 0 END' for m in RATIOS)} AS present FROM bx),
    ax AS (SELECT *, greatest({', '.join(f'round(s_{k}, 6)' for k in val.ARCHETYPES)}) AS top, concat_ws(',', CASE WHEN share_growth > 0.05 THEN 'high-dilution' END, CASE WHEN debt_to_equity > 2 THEN 'high-debt' END, CASE WHEN margin_trend < 0 THEN 'margin-declining' END, CASE WHEN fcf_margin < 0 THEN 'negative-fcf' END) AS flags FROM sx),
    kx AS (SELECT *, CASE {' '.join(f"WHEN round(s_{k}, 6) = top THEN '{k}'" for k in val.ARCHETYPES)} END AS best FROM ax)"""


def _archetype(spark, sf):
    return val.archetypes(compounders(spark, sf))


@query(f"{ARCH} SELECT symbol, period_end, {', '.join(f'round(s_{k}, 4) AS {k}, round(c_{k}, 4) AS cover_{k}' for k in val.ARCHETYPES)}, flags FROM kx")
def xs_archetype_score(spark, sf):
    return _archetype(spark, sf).select("symbol", "period_end", *(c for k in val.ARCHETYPES for c in (F.round(f"s_{k}", 4).alias(k), F.round(f"c_{k}", 4).alias(f"cover_{k}"))), "flags")


@query(f"{ARCH} SELECT symbol, best, round(top, 4) AS score, row_number() OVER (ORDER BY top DESC, symbol) AS rank FROM kx WHERE present >= 5 AND ({' OR '.join(f'c_{k} >= 0.5' for k in val.ARCHETYPES)}) QUALIFY rank <= 20")
def xs_compounder_rank(spark, sf):
    covered = F.greatest(*(F.col(f"c_{k}") for k in val.ARCHETYPES)) >= 0.5
    best = _archetype(spark, sf).where((F.col("present") >= 5) & covered).orderBy(F.desc("top"), "symbol").limit(20)
    return best.select("symbol", "best", *r("top", n=4), F.row_number().over(Window.orderBy(F.desc("top"), "symbol")).cast("long").alias("rank")).withColumnRenamed("top", "score")


@query(f"{ARCH} SELECT symbol, best, round(top, 4) AS score, concat_ws('; ', {', '.join(f"CASE WHEN z_{m} > 1 THEN '{m} high' WHEN z_{m} < -1 THEN '{m} low' END" for m in _USED)}) AS explanation, flags FROM kx")
def xs_dossier_rows(spark, sf):
    say = F.concat_ws("; ", *(F.when(F.col(f"z_{m}") > 1, F.lit(f"{m} high")).when(F.col(f"z_{m}") < -1, F.lit(f"{m} low")) for m in _USED))
    return _archetype(spark, sf).select("symbol", "best", F.round("top", 4).alias("score"), say.alias("explanation"), "flags")


@query(f"{ARCH}, tx AS (SELECT *, 100 * ({ncdf('z_revenue_cagr')}) AS technology FROM kx) SELECT symbol, round(technology, 4) AS technology, round(s_profitable_compounder, 4) AS business, round(0.45 * technology + 0.55 * s_profitable_compounder, 4) AS composite FROM tx")
def xs_sector_company(spark, sf):
    t = _archetype(spark, sf).withColumn("technology", 100 * st.normal_cdf(F.col("z_revenue_cagr")))
    return t.select("symbol", *r("technology", n=4), F.round("s_profitable_compounder", 4).alias("business"), F.round(0.45 * F.col("technology") + 0.55 * F.col("s_profitable_compounder"), 4).alias("composite"))


@query("WITH q AS (SELECT symbol, known_date, revenue / lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY period_end) - 1 AS surprise FROM fund_q) SELECT symbol, known_date, CASE WHEN surprise > 0 THEN 'long' ELSE 'short' END AS direction FROM q WHERE abs(surprise) >= 0.05")
def sig_pead(spark, sf):
    s = F.col("revenue") / F.lag("revenue", 4).over(Window.partitionBy("symbol").orderBy("period_end")) - 1
    return src.fundamentals(spark, sf).withColumn("s", s).where("abs(s) >= 0.05").select("symbol", "known_date", F.when(F.col("s") > 0, "long").otherwise("short").alias("direction"))


#: A quarter of the price that the valuation queries use, so that names of every rating appear.
CHEAP = 0.25


@query(f"WITH {FAIR}, g AS (SELECT symbol, period_end, round((fair - {CHEAP} * price) / ({CHEAP} * price), 9) AS g FROM d) SELECT symbol, period_end, CASE WHEN g >= 0.5 THEN 3 ELSE 2 END AS rating, round(g, 6) AS gap FROM g WHERE g >= 0.25")
def sig_value_long(spark, sf):
    price = CHEAP * F.col("price")
    x = fair_rows(spark, sf).withColumns({"rating": sc.rating(F.col("fair"), price), "gap": F.round((F.col("fair") - price) / price, 9)})
    return x.where("rating >= 2").orderBy(F.desc("rating"), F.desc("gap"), "symbol").select("symbol", "period_end", "rating", *r("gap"))


def _scores(spark, sf):
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    t = f.range_position(f.momentum(src.weekly(spark, sf), 12)).withColumn("n", F.row_number().over(last)).where("n = 1").select("symbol", "ts", "mom", "range_position", "close")
    v = fair_rows(spark, sf).groupBy("symbol").agg(F.max_by(F.col("fair") / F.col("price") - 1, "period_end").alias("upside"))
    return t.join(v, "symbol")


SCORES = f"{FAIR}, t AS (SELECT symbol, ts, close, mom, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS range_position FROM (SELECT symbol, ts, close, close / lag(close, 12) OVER ({S}) - 1 AS mom, min(low) OVER {rows(50)} AS lo, max(high) OVER {rows(50)} AS hi FROM bars_w) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), u AS (SELECT symbol, arg_max(fair / price - 1, period_end) AS upside FROM d GROUP BY 1), sx AS (SELECT * FROM t JOIN u USING (symbol))"


@query(f"WITH {SCORES}, k AS (SELECT symbol, round(40 * greatest(0, least(1, 0.5 + mom)) + 30 * (1 - range_position) + 30 * greatest(0, least(1, 0.5 + upside)), 5) AS score FROM sx) SELECT symbol, score, CASE WHEN score >= 60 THEN 'attack' WHEN score >= 40 THEN 'hold' ELSE 'defend' END AS label FROM k")
def sc_playbook(spark, sf):
    s = 40 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("mom"))) + 30 * (1 - F.col("range_position")) + 30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("upside")))
    return _scores(spark, sf).withColumn("score", F.round(s, 5)).select("symbol", "score", F.when(F.col("score") >= 60, "attack").when(F.col("score") >= 40, "hold").otherwise("defend").alias("label"))


@query(f"WITH {SCORES}, k AS (SELECT symbol, round(0.5 * mom + 0.5 * upside, 6) AS composite FROM sx) SELECT symbol, composite, CASE WHEN composite > 0.1 THEN 'buy' WHEN composite < -0.1 THEN 'sell' ELSE 'hold' END AS action, round(greatest(0, least(0.1, composite / 5)), 6) AS size FROM k")
def sc_factor_recommend(spark, sf):
    x = _scores(spark, sf).withColumn("composite", F.round(0.5 * F.col("mom") + 0.5 * F.col("upside"), 6))
    return x.select("symbol", "composite", F.when(F.col("composite") > 0.1, "buy").when(F.col("composite") < -0.1, "sell").otherwise("hold").alias("action"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.1), F.col("composite") / 5)), 6).alias("size"))


@query(f"WITH {SCORES} SELECT symbol, round(upside - range_position, 6) AS directional, CASE WHEN round(upside - range_position, 6) > 0 THEN 'long' ELSE 'short' END AS side FROM sx")
def sc_long_short(spark, sf):
    d = F.round(F.col("upside") - F.col("range_position"), 6)
    return _scores(spark, sf).select("symbol", d.alias("directional"), F.when(d > 0, "long").otherwise("short").alias("side"))


@query(f"WITH {SCORES} SELECT * FROM (SELECT symbol, 0.08::DOUBLE AS weight FROM sx ORDER BY round(mom, 9) DESC, symbol LIMIT 5) UNION ALL SELECT 'CORE', 0.5 UNION ALL SELECT 'CASH', 0.1")
def sc_draft_portfolio(spark, sf):
    movers = _scores(spark, sf).orderBy(F.desc(F.round("mom", 9)), "symbol").limit(5).select("symbol", F.lit(0.08).alias("weight"))
    return movers.unionByName(spark.range(1).select(F.explode(F.create_map(F.lit("CORE"), F.lit(0.5), F.lit("CASH"), F.lit(0.1))).alias("symbol", "weight")))


POLICY = Policy(order_notional=300_000.0, daily_notional=500_000.0, sector_weight=0.3, daily_orders=2)
#: Orders as intents: everything that the tables lack follows from the keys.
INTENTS = """SELECT o_custkey AS account, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 25 + 1 AS k, CASE WHEN o_orderkey % 29 = 0 THEN 'kr' ELSE 'us' END AS market, o_orderkey % 25 % 5 AS sector,
    CASE WHEN o_orderkey % 31 = 0 THEN 'stop' WHEN o_orderkey % 4 = 1 THEN 'limit' ELSE 'market' END AS order_type, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, floor(o_totalprice / (51 + o_orderkey % 25)) AS qty,
    CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 31 <> 0 THEN (51 + o_orderkey % 25) * (1 + (o_orderkey % 11 - 5) / 100.0) END AS limit_price, CAST(51 + o_orderkey % 25 AS DOUBLE) AS mark, o_custkey % 101 = 0 AS halted, o_custkey % 97 = 0 AS blocked, o_custkey % 7 <> 0 AS day_trader, o_custkey % 5 AS daytrades FROM orders"""
#: The fold as a recursion: p holds the quantities by symbol and market, places 1 to 25 for us and 26 to 50 for kr.
PRETRADE = f"""WITH RECURSIVE i AS MATERIALIZED (SELECT *, coalesce(limit_price, mark) AS price, k + CASE market WHEN 'kr' THEN 25 ELSE 0 END AS slot, qty * coalesce(limit_price, mark) AS notional, row_number() OVER (PARTITION BY account ORDER BY day, id) AS n FROM ({INTENTS})),
    b AS (SELECT DISTINCT account, 0::BIGINT AS n, NULL::BIGINT AS id, 400000.0::DOUBLE AS cash, [0.0::DOUBLE FOR x IN range(50)] AS p, NULL::DATE AS day, 0 AS orders, 0.0::DOUBLE AS bought, '' AS breaches FROM i
        UNION ALL
        SELECT account, n, id, CASE WHEN said = '' THEN cash - sign * notional ELSE cash END, CASE WHEN said = '' THEN list_transform(range(1, 51), lambda j: CASE WHEN j = slot THEN own + sign * qty ELSE p[j] END) ELSE p END, day,
            orders + CASE WHEN said = '' THEN 1 ELSE 0 END, bought + CASE WHEN said = '' AND sign = 1 THEN notional ELSE 0 END, said
        FROM (SELECT *, concat_ws(',', CASE WHEN halted THEN 'halted' END, CASE WHEN blocked THEN 'blocked' END, CASE WHEN market <> 'us' THEN 'market' END, CASE WHEN order_type = 'stop' THEN 'type' END, CASE WHEN qty <= 0 THEN 'qty' END,
                CASE WHEN order_type = 'limit' AND CASE sign WHEN 1 THEN limit_price > mark * 1.03 ELSE limit_price < mark * (1 - 0.03) END THEN 'limit_deviation' END, CASE WHEN notional > 300000 THEN 'notional' END, CASE WHEN sign = 1 AND notional > cash THEN 'buying_power' END,
                CASE WHEN sign = 1 AND bought + notional > 500000 THEN 'daily_notional' END, CASE WHEN orders >= 2 THEN 'daily_orders' END, CASE WHEN NOT day_trader AND daytrades >= 3 THEN 'daytrades' END, CASE WHEN sign = 1 AND notional > cash THEN 'cash' END,
                CASE WHEN sign = 1 AND (cash - notional) / 1000000 < 0.05 THEN 'cash_fraction' END, CASE WHEN sign = -1 AND qty > greatest(own, 0) + 1e-8 THEN 'short' END, CASE WHEN (others + abs(own + sign * qty) * price) / 1000000 > 1 THEN 'gross' END,
                CASE WHEN abs(own + sign * qty) * price / 1000000 > 0.25 THEN 'weight' END, CASE WHEN (same + abs(own + sign * qty) * price) / 1000000 > 0.3 AND abs(own + sign * qty) * price > abs(own) * price + 1e-9 THEN 'sector' END) AS said
            FROM (SELECT i.account, i.n, i.id, b.cash, b.p, i.day, CASE WHEN b.day = i.day THEN b.orders ELSE 0 END AS orders, CASE WHEN b.day = i.day THEN b.bought ELSE 0 END AS bought, i.* EXCLUDE (account, n, id, day), CASE i.side WHEN 'buy' THEN 1 ELSE -1 END AS sign, b.p[i.slot] AS own,
                list_sum(list_transform(range(1, 51), lambda j: CASE WHEN j = i.slot THEN 0 ELSE abs(b.p[j]) * (50 + (j - 1) % 25 + 1) END)) AS others, list_sum(list_transform(range(1, 51), lambda j: CASE WHEN j = i.slot OR (j - 1) % 25 % 5 <> i.sector THEN 0 ELSE abs(b.p[j]) * (50 + (j - 1) % 25 + 1) END)) AS same
                FROM b JOIN i ON i.account = b.account AND i.n = b.n + 1)))"""


@query(f"{PRETRADE} SELECT account, id, breaches = '' AS accepted, breaches, round(cash, 2) AS cash_after FROM b WHERE n > 0")
def rk_pretrade_rules(spark, sf):
    i = spark.sql(INTENTS.replace("FROM orders", "FROM {o}"), o=src.read(spark, sf, "orders"))
    i = i.select("account", "id", "day", F.concat(F.lit("S"), "k").alias("symbol"), "market", F.col("sector").cast("string").alias("sector"), "order_type", "side", F.col("qty").cast("double").alias("qty"), F.col("limit_price").cast("double").alias("limit_price"), "mark", F.lit(1e6).alias("equity"), F.lit(4e5).alias("cash"), F.lit(None).cast("double").alias("buying_power"), "halted", "blocked", "day_trader", "daytrades")
    return check(i, POLICY).select("account", "id", "accepted", "breaches", *r("cash_after", n=2))


@query(f"{HOLD}, lt AS (SELECT symbol, weight AS target FROM h WHERE ts = (SELECT max(ts) FROM h)), hd AS (SELECT symbol, arg_max(close, ts) AS mark, 0.04::DOUBLE AS held FROM bars_w GROUP BY 1), j AS (SELECT symbol, held, target, round(coalesce(target, 0) - coalesce(held, 0), 9) AS delta FROM hd FULL JOIN lt USING (symbol)) SELECT symbol, held, round(target, 6) AS target, round(delta, 6) AS delta, CASE WHEN delta < 0 THEN 'sell' WHEN delta > 0 THEN 'buy' ELSE 'keep' END AS side, round(sign(delta) * least(0.01, 0.0005 + 0.001 * sqrt(abs(delta) * 1000 / 10000)), 8) AS slippage FROM j")
def rk_book_report(spark, sf):
    t = pf.equal_weights(pf.momentum_holdings(src.weekly(spark, sf), 12, 5))
    target = t.join(t.agg(F.max("ts").alias("ts")), "ts").select("symbol", F.col("weight").alias("target"))
    held = src.weekly(spark, sf).groupBy("symbol").agg(F.max_by("close", "ts").alias("mark"), F.lit(0.04).alias("held"))
    j = held.join(target, "symbol", "full").withColumn("delta", F.round(F.coalesce("target", F.lit(0.0)) - F.coalesce("held", F.lit(0.0)), 9))
    size = rk.slippage(F.col("delta") * 1000, F.lit(10000.0), 0.0005, 0.001, 0.01)
    return j.select("symbol", "held", *r("target", "delta"), F.when(F.col("delta") < 0, "sell").when(F.col("delta") > 0, "buy").otherwise("keep").alias("side"), F.round(size, 8).alias("slippage"))


@query(f"SELECT event_id, round({exact_cdf('(value - 50) / 25')}, 6) AS phi FROM events")
def udf_scalar(spark, sf):
    return src.read(spark, sf, "events").select("event_id", F.round(st.phi((F.col("value") - 50) / 25), 6).alias("phi"))


@query()
def udaf_series(spark, sf):
    boot = st.bootstrap_aggregate(samples=2000, block=21, seed=7)
    x = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").groupBy("symbol").agg(boot(F.unix_date("ts"), "ret").alias("b"))
    return x.select("symbol", *(F.col("b")[i].alias(k) for i, k in enumerate(st.BOOTSTRAP)))


@query()
def w_obv_divergence(spark, sf):
    return rd.obv_divergence(src.daily(spark, sf))


@query()
def pat_flag(spark, sf):
    return rd.flags(src.daily(spark, sf))


SHAPE = ("symbol", "ts", "pattern", "direction", "breakout", "mitigated")


def _shapes(spark, sf):
    x = shapes.at_bars(src.weekly(spark, sf), fit=0.25)  # the derived prices leap, so their lines fit loosely
    return x.select(*SHAPE, *r("low", "high", "strength", "volume_ratio", "target"))


@query()
def pat_triangle_wedge(spark, sf):
    return _shapes(spark, sf).where(F.col("pattern").endswith("triangle") | F.col("pattern").endswith("wedge"))


@query()
def pat_rectangle_cup(spark, sf):
    return _shapes(spark, sf).where(F.col("pattern").isin("rectangle", "cup_and_handle"))


@query()
def pat_scan(spark, sf):
    b = src.daily(spark, sf)
    name = lambda df, kind: df.select("symbol", "ts", F.lit(kind).alias("pattern"))
    found = name(rd.double_tops(b), "double_top").unionByName(name(rd.double_tops(b, side="low"), "double_bottom")).unionByName(name(rd.head_shoulders(b), "head_shoulders")).unionByName(name(rd.flags(b), "flag"))
    return found.unionByName(shapes.at_bars(b).where("NOT mitigated").select("symbol", "ts", "pattern"))
