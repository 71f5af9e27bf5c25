"""Queries of cross-sections, selections, set operations and portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import crosssection as xs
from tapeloom.operators import features as f
from tapeloom.operators import portfolio as pf
from tapeloom.plans.registry import query
from tapeloom.plans.windows import S, r, rows
from tapeloom.sources import adapters as src

MOM = f"SELECT symbol, ts, close, close / lag(close, 12) OVER ({S}) - 1 AS mom, volume FROM bars_w"


def mom(spark, sf):
    return f.momentum(src.weekly(spark, sf), 12).select("symbol", "ts", "close", "mom", "volume")


def zsql(c: str, by: str = "ts") -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN count({c}) OVER (PARTITION BY {by}) >= 2 AND stddev_pop({c}) OVER (PARTITION BY {by}) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY {by})) / stddev_pop({c}) OVER (PARTITION BY {by}) ELSE 0 END"


@query(f"WITH x AS ({MOM}) SELECT symbol, ts, round({zsql('mom')}, 6) AS z, round({zsql('volume')}, 6) AS z_volume FROM x")
def w_zscore_xs(spark, sf):
    return mom(spark, sf).select("symbol", "ts", F.round(xs.z("mom"), 6).alias("z"), F.round(xs.z("volume"), 6).alias("z_volume"))


@query("SELECT symbol, ts, rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0 AS rank FROM bars_w")
def w_rank_avg(spark, sf):
    return src.weekly(spark, sf).select("symbol", "ts", xs.avg_rank("volume").alias("rank"))


RANKP = "(rank() OVER (PARTITION BY ts ORDER BY {0}) + (count(*) OVER (PARTITION BY ts, {0}) - 1) / 2.0) / count(*) OVER (PARTITION BY ts)"


@query(f"WITH x AS (SELECT symbol, ts, volume, high - low AS span FROM bars_w), y AS (SELECT symbol, ts, count(*) OVER (PARTITION BY ts) AS n, {RANKP.format('volume')} AS a, 1 + 1.0 / count(*) OVER (PARTITION BY ts) - {RANKP.format('span')} AS b FROM x) SELECT symbol, ts, round((a + b) / 2, 6) AS score FROM y WHERE n >= 3")
def w_pct_rank_oriented(spark, sf):
    n = F.count("*").over(Window.partitionBy("ts"))
    x = src.weekly(spark, sf).withColumn("span", F.col("high") - F.col("low")).withColumn("n", n).where("n >= 3")
    up, down = xs.avg_rank("volume") / F.col("n"), (F.col("n") + 1 - xs.avg_rank("span")) / F.col("n")
    return x.select("symbol", "ts", F.round((up + down) / 2, 6).alias("score"))


@query(f"WITH x AS ({MOM}) SELECT ts, symbol, round(mom, 6) AS score, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) AS rank FROM x WHERE mom > 0 QUALIFY rank <= 5")
def topk_momentum_holdings(spark, sf):
    return pf.momentum_holdings(src.weekly(spark, sf), 12, 5).select("ts", "symbol", *r("score"), F.col("rank").cast("long"))


COMPOSITE = f"x AS ({MOM}), y AS (SELECT ts, symbol, round({zsql('mom')} + {zsql('volume')}, 9) AS score FROM x WHERE mom IS NOT NULL)"


def composite(spark, sf):
    return mom(spark, sf).where("mom IS NOT NULL").select("ts", "symbol", F.round(xs.z("mom") + xs.z("volume"), 9).alias("score"))


@query(f"WITH {COMPOSITE} SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS rank FROM y QUALIFY rank <= 5")
def topk_factor(spark, sf):
    return xs.top(composite(spark, sf), 5, [F.desc("score"), F.col("symbol")]).select("ts", "symbol", F.col("rank").cast("long"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def topk_screen(spark, sf):
    return src.read(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query(f"WITH {COMPOSITE}, g AS (SELECT ts, symbol, substr(symbol, 7, 1) AS sector, score, row_number() OVER (PARTITION BY ts, substr(symbol, 7, 1) ORDER BY score DESC, symbol) AS rank FROM y) SELECT ts, sector, symbol, rank, round(avg(score) OVER (PARTITION BY ts, sector), 6) AS sector_score FROM g WHERE rank <= 2")
def topk_group_leaders(spark, sf):
    g = xs.top(composite(spark, sf).withColumn("sector", F.substring("symbol", 7, 1)), 2, [F.desc("score"), F.col("symbol")], ["ts", "sector"])
    return g.select("ts", "sector", "symbol", F.col("rank").cast("long"), F.round(F.avg("score").over(Window.partitionBy("ts", "sector")), 6).alias("sector_score"))


@query(f"WITH {COMPOSITE}, a AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS n FROM y), b AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY -score DESC, symbol) AS m FROM a WHERE n > 3) SELECT ts, symbol, 'current' AS pool FROM a WHERE n <= 3 UNION ALL SELECT ts, symbol, 'next' FROM b WHERE m <= 3")
def topk_two_pool(spark, sf):
    first = xs.top(composite(spark, sf), 1 << 30, [F.desc("score"), F.col("symbol")])
    rest = xs.top(first.where("rank > 3").drop("rank"), 3, [F.col("score"), F.col("symbol")])
    return first.where("rank <= 3").select("ts", "symbol", F.lit("current").alias("pool")).unionByName(rest.select("ts", "symbol", F.lit("next").alias("pool")))


VOL = f"WITH x AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w), v AS (SELECT symbol, ts, ret, close, CASE WHEN count(ret) OVER {rows(12)} = 12 THEN stddev_pop(ret) OVER {rows(12)} END AS vol FROM x)"


def vols(spark, sf):
    b = f.returns(src.weekly(spark, sf))
    return b.withColumn("vol", f.full(F.stddev_pop("ret"), 12, "ret")).select("symbol", "ts", "close", "ret", "vol")


@query(f"{VOL}, k AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY vol, symbol) AS rank FROM v WHERE vol IS NOT NULL QUALIFY rank <= 5) SELECT ts, symbol, round(1.0 / count(*) OVER (PARTITION BY ts), 6) AS weight FROM k")
def topk_lowvol(spark, sf):
    return pf.equal_weights(xs.top(vols(spark, sf).where("vol IS NOT NULL"), 5, [F.col("vol"), F.col("symbol")])).select("ts", "symbol", *r("weight"))


@query(f"WITH {COMPOSITE} SELECT ts, symbol, round(CASE WHEN count(*) OVER (PARTITION BY ts) <= 1 THEN 50 ELSE 100.0 * (count(*) OVER (PARTITION BY ts) - row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol)) / (count(*) OVER (PARTITION BY ts) - 1) END, 6) AS percentile FROM y")
def rank_percentile(spark, sf):
    return composite(spark, sf).select("ts", "symbol", F.round(xs.rank_percentile([F.desc("score"), F.col("symbol")]), 6).alias("percentile"))


@query(f"WITH {COMPOSITE} SELECT ts, symbol, CAST(floor((row_number() OVER (PARTITION BY ts ORDER BY score, symbol) - 1) * 5.0 / count(*) OVER (PARTITION BY ts)) AS BIGINT) AS bucket FROM y")
def quantile_buckets(spark, sf):
    return composite(spark, sf).select("ts", "symbol", xs.quantile("score").cast("long").alias("bucket"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf):
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return src.read(spark, sf, "orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.*")


@query("SELECT ts FROM bars_d GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_d)")
def set_common_dates(spark, sf):
    b = src.daily(spark, sf)
    n = b.agg(F.countDistinct("symbol").alias("n"))
    return b.groupBy("ts").agg(F.countDistinct("symbol").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("ts")


HOLD = f"WITH x AS ({MOM}), h AS (SELECT ts, symbol, 1.0 / count(*) OVER (PARTITION BY ts) AS weight FROM (SELECT ts, symbol FROM x WHERE mom > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) <= 5))"


def holdings(spark, sf):
    return pf.equal_weights(pf.momentum_holdings(src.weekly(spark, sf), 12, 5))


TURN = f"{HOLD}, d AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM h)), l AS (SELECT ts, symbol, weight FROM h UNION ALL SELECT nx, symbol, -weight FROM h JOIN d USING (ts) WHERE nx IS NOT NULL), s AS (SELECT ts, symbol, sum(weight) AS c FROM l GROUP BY 1, 2)"


@query(f"{TURN} SELECT ts, round(sum(abs(c)), 6) AS turnover FROM s GROUP BY 1")
def set_turnover(spark, sf):
    return xs.turnover(holdings(spark, sf)).select("ts", *r("turnover"))


@query(f"""{HOLD}, ye AS (SELECT max(ts) AS ts FROM h GROUP BY year(ts)), yn AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM ye), pv AS (SELECT yn.ts, nx, symbol FROM yn JOIN h USING (ts) WHERE nx IS NOT NULL),
    ls AS (SELECT pv.ts, nx, count(*) AS n, count(*) FILTER (c.symbol IS NULL) AS lost FROM pv LEFT JOIN h c ON c.ts = pv.nx AND c.symbol = pv.symbol GROUP BY 1, 2) SELECT ts, nx AS next_ts, n, lost, round(lost / n / (date_diff('day', ts, nx) / 365.25), 6) AS turnover FROM ls""")
def set_top_turnover(spark, sf):
    """Names of a year's last list that the next year's lacks, over the list, per year between the two."""
    h = holdings(spark, sf).select("ts", "symbol")
    ends = h.groupBy(F.year("ts").alias("y")).agg(F.max("ts").alias("ts")).withColumn("next_ts", F.lead("ts").over(Window.orderBy("y"))).where("next_ts IS NOT NULL")  # a row a year
    before = h.join(ends, "ts").select("ts", "next_ts", "symbol")
    lost = before.join(h.select(F.col("ts").alias("next_ts"), "symbol"), ["next_ts", "symbol"], "left_anti").groupBy("ts").agg(F.count("*").alias("lost"))
    x = before.groupBy("ts", "next_ts").agg(F.count("*").alias("n")).join(lost, "ts", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return x.select("ts", "next_ts", "n", "lost", F.round(F.col("lost") / F.col("n") / (F.datediff("next_ts", "ts") / 365.25), 6).alias("turnover"))


@query(f"{HOLD} SELECT DISTINCT symbol FROM h UNION SELECT 'BENCH'")
def set_union_symbols(spark, sf):
    return holdings(spark, sf).select("symbol").unionByName(spark.range(1).select(F.lit("BENCH").alias("symbol"))).distinct()


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def set_effective_dedupe(spark, sf):
    return src.read(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")).distinct()


SLEEVES = f"""{VOL}, m AS (SELECT ts, symbol, close / lag(close, 12) OVER ({S}) - 1 AS mom, lead(ret) OVER ({S}) AS nxt, vol FROM v), a AS (SELECT ts, avg(nxt) AS ra FROM (SELECT * FROM m WHERE mom > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) <= 5) GROUP BY 1),
    b AS (SELECT ts, avg(nxt) AS rb FROM (SELECT * FROM m WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY vol, symbol) <= 5) GROUP BY 1)"""


def sleeves(spark, sf):
    v = vols(spark, sf).withColumns({"mom": F.col("close") / f.lag("close", 12) - 1, "nxt": F.lead("ret").over(f.series())})
    a = xs.top(v.where("mom > 0"), 5, [F.desc("mom"), F.desc("symbol")]).groupBy("ts").agg(F.avg("nxt").alias("ra"))
    return a.join(xs.top(v.where("vol IS NOT NULL"), 5, [F.col("vol"), F.col("symbol")]).groupBy("ts").agg(F.avg("nxt").alias("rb")), "ts")


@query(f"{SLEEVES} SELECT ts, round(0.8 * ra + 0.2 * rb, 6) AS blended FROM a JOIN b USING (ts)")
def set_series_align(spark, sf):
    return sleeves(spark, sf).select("ts", F.round(0.8 * F.col("ra") + 0.2 * F.col("rb"), 6).alias("blended"))


@query(f"{HOLD}, g AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) AS n FROM bars_w QUALIFY n <= 5), u AS (SELECT ts, symbol, 0.8 * weight AS w FROM h UNION ALL SELECT ts, symbol, 0.2 / 5 FROM g) SELECT ts, symbol, round(sum(w), 6) AS weight FROM u GROUP BY 1, 2")
def pf_blend_sleeves(spark, sf):
    calm = xs.top(src.weekly(spark, sf), 5, [F.desc("volume"), F.col("symbol")]).select("ts", "symbol", F.lit(0.2 / 5).alias("w"))
    both = holdings(spark, sf).select("ts", "symbol", (0.8 * F.col("weight")).alias("w")).unionByName(calm)
    return both.groupBy("ts", "symbol").agg(F.round(F.sum("w"), 6).alias("weight"))


@query(f"{HOLD} SELECT ts, symbol, round(weight, 6) AS weight FROM h")
def pf_equal_weights(spark, sf):
    return holdings(spark, sf).select("ts", "symbol", *r("weight"))


INV = f"{VOL}, k AS (SELECT ts, symbol, vol, substr(symbol, 7, 1) AS sector FROM v WHERE vol IS NOT NULL), w AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS inv FROM k), iv AS (SELECT ts, symbol, sector, inv / sum(inv) OVER (PARTITION BY ts) AS weight FROM w)"


def inv(spark, sf):
    return pf.inverse_vol(vols(spark, sf).where("vol IS NOT NULL").select("ts", "symbol", "vol"))


@query(f"{INV} SELECT ts, symbol, round(weight, 6) AS weight FROM iv")
def pf_inverse_vol(spark, sf):
    return inv(spark, sf).select("ts", "symbol", *r("weight"))


def _capped(rounds: int, cap: float) -> str:
    step = f"CASE WHEN weight >= {cap} THEN {cap} ELSE weight + sum(greatest(weight - {cap}, 0)) OVER (PARTITION BY ts) * weight / nullif(sum(CASE WHEN weight < {cap} THEN weight ELSE 0 END) OVER (PARTITION BY ts), 0) END"
    return ", ".join(f"c{i + 1} AS (SELECT ts, symbol, coalesce({step}, weight) AS weight FROM {'iv' if not i else f'c{i}'})" for i in range(rounds))


@query(f"{INV}, {_capped(10, 0.12)} SELECT ts, symbol, round(weight, 6) AS weight FROM c10")
def pf_capped_inverse_vol(spark, sf):
    return pf.capped(inv(spark, sf), 0.12).select("ts", "symbol", *r("weight"))


@query(f"{INV}, s AS (SELECT *, sum(weight) OVER (PARTITION BY ts, right(symbol, 1)) AS total FROM iv) SELECT ts, symbol, round(CASE WHEN total > 0.15 THEN weight * 0.15 / total ELSE weight END, 6) AS weight FROM s")
def pf_cap_sector(spark, sf):
    w = inv(spark, sf).withColumn("sector", F.substring("symbol", -1, 1))
    return pf.cap_sector(w, "sector", 0.15).select("ts", "symbol", *r("weight"))


@query(f"{INV} SELECT ts, symbol, round(least(weight, 0.1), 6) AS weight FROM iv UNION ALL SELECT ts, 'CASH', round(sum(weight - least(weight, 0.1)), 6) FROM iv GROUP BY 1")
def pf_cap_risk(spark, sf):
    w = inv(spark, sf).select("ts", "symbol", "weight")
    kept = w.select("ts", "symbol", F.least("weight", F.lit(0.1)).alias("weight"))
    over = w.groupBy("ts").agg(F.sum(F.col("weight") - F.least("weight", F.lit(0.1))).alias("weight")).select("ts", F.lit("CASH").alias("symbol"), "weight")
    return kept.unionByName(over).select("ts", "symbol", *r("weight"))


@query(f"{VOL} SELECT symbol, ts, round(CASE WHEN vol * sqrt(52) > 0 THEN least(1.5, 0.15 / (vol * sqrt(52))) ELSE 1 END, 6) AS scale FROM v WHERE vol IS NOT NULL")
def pf_vol_target(spark, sf):
    return vols(spark, sf).where("vol IS NOT NULL").select("symbol", "ts", F.round(pf.vol_target_scale(F.col("vol") * 52**0.5, 0.15, 1.5), 6).alias("scale"))


@query(f"WITH x AS ({MOM}), d AS (SELECT * FROM x WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3')) SELECT ts, CASE WHEN max(mom) > 0 THEN arg_max(symbol, mom) ELSE 'CASH' END AS choice FROM d GROUP BY ts")
def pf_defensive_choice(spark, sf):
    d = mom(spark, sf).where(F.col("symbol").isin("Brand#1", "Brand#2", "Brand#3"))
    return d.groupBy("ts").agg(F.when(F.max("mom") > 0, F.max_by("symbol", "mom")).otherwise("CASH").alias("choice"))


@query("SELECT DISTINCT symbol FROM bars_w WHERE symbol NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def pf_risk_eligible(spark, sf):
    b = src.weekly(spark, sf).select("symbol").distinct()
    hedges = b.where(F.col("symbol").isin("Brand#1", "Brand#2", "Brand#3"))
    return b.join(hedges, "symbol", "left_anti")


@query(f"SELECT symbol, ts, close / max(close) OVER {rows(60)} - 1 <= -0.1 AND coalesce(close / lag(close, 60) OVER ({S}) - 1 <= -0.1, true) AS crash FROM bars_d")
def pf_crash_trigger(spark, sf):
    return pf.crash_trigger(src.daily(spark, sf)).select("symbol", "ts", "crash")


@query(f"{INV} SELECT ts, symbol, round(weight * 0.7, 6) AS weight FROM iv UNION ALL SELECT DISTINCT ts, 'HEDGE', 0.3 FROM iv")
def pf_crash_apply(spark, sf):
    w = inv(spark, sf)
    return w.select("ts", "symbol", F.round(F.col("weight") * 0.7, 6).alias("weight")).unionByName(w.select("ts").distinct().select("ts", F.lit("HEDGE").alias("symbol"), F.lit(0.3).alias("weight")))


@query(f"{INV}, p AS (SELECT ts, right(symbol, 1) AS pod, 1 / avg(vol) AS b FROM k GROUP BY 1, 2), t AS (SELECT ts, pod, b / sum(b) OVER (PARTITION BY ts) * CASE WHEN pod IN ('1', '2') THEN 1.2 ELSE 0.8 END AS b FROM p) SELECT ts, pod, round(b / sum(b) OVER (PARTITION BY ts), 6) AS budget FROM t")
def pf_pod_alloc(spark, sf):
    p = vols(spark, sf).where("vol IS NOT NULL").groupBy("ts", F.substring("symbol", -1, 1).alias("pod")).agg((1 / F.avg("vol")).alias("b"))
    t = p.withColumn("b", F.col("b") / F.sum("b").over(pf.date()) * F.when(F.col("pod").isin("1", "2"), 1.2).otherwise(0.8))
    return t.select("ts", "pod", F.round(F.col("b") / F.sum("b").over(pf.date()), 6).alias("budget"))


TSM = f"""WITH x AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret, CASE WHEN close / lag(close, 20) OVER ({S}) - 1 > 0 THEN 1 ELSE 0 END AS signal FROM bars_d), p AS (SELECT *, coalesce(lag(signal) OVER ({S}), 0) AS position FROM x),
    t AS (SELECT symbol, ts, position, position * coalesce(ret, 0) - 0.0005 * abs(position - coalesce(lag(position) OVER ({S}), 0)) AS strat_ret FROM p)"""


@query(f"{TSM} SELECT symbol, ts, position, round(strat_ret, 6) AS strat_ret FROM t")
def pf_ts_momentum_panel(spark, sf):
    return pf.ts_momentum_panel(src.daily(spark, sf)).select("symbol", "ts", "position", *r("strat_ret"))


@query(f"{TSM}, n AS (SELECT *, exp(sum(ln(1 + strat_ret)) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS nav FROM t), d AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS dd FROM n) SELECT symbol, count(*) AS n, round(exp(sum(ln(1 + strat_ret))) - 1, 5) AS total, round(avg(strat_ret) / stddev_pop(strat_ret) * sqrt(252), 5) AS sharpe, round(max(dd), 5) AS max_drawdown FROM d GROUP BY 1")
def pf_strategy_health(spark, sf):
    return pf.strategy_health(pf.ts_momentum_panel(src.daily(spark, sf)), "strat_ret", 252, "symbol").select("symbol", "n", *r("total", "sharpe", "max_drawdown", n=5))


ROT = f"""WITH x AS ({MOM}), cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n FROM (SELECT DISTINCT ts FROM bars_w)), c AS (SELECT ts, (n - 12) // 4 AS period, (n - 12) % 4 = 0 AS reb, lead(ts) OVER (ORDER BY ts) AS earn FROM cal WHERE n >= 12),
    h AS (SELECT period, symbol, 1.0 / count(*) OVER (PARTITION BY period) AS weight FROM (SELECT ts, symbol FROM x WHERE mom > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) <= 5) JOIN c USING (ts) WHERE reb),
    q AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w), g AS (SELECT c.earn AS ts, c.period, sum(weight * coalesce(ret, 0)) AS gross, count(*) AS n_held FROM c JOIN h USING (period) LEFT JOIN q ON q.ts = c.earn AND q.symbol = h.symbol WHERE c.earn IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT period, lead(period) OVER (ORDER BY period) AS nx FROM (SELECT DISTINCT period FROM h)), l AS (SELECT period, symbol, weight FROM h UNION ALL SELECT nx, symbol, -weight FROM h JOIN d USING (period) WHERE nx IS NOT NULL),
    tt AS (SELECT period, sum(abs(ch)) * 0.0005 AS cost FROM (SELECT period, symbol, sum(weight) AS ch FROM l GROUP BY 1, 2) GROUP BY 1), ff AS (SELECT period, min(earn) AS ts FROM c WHERE earn IS NOT NULL GROUP BY 1)"""


@query(f"{ROT} SELECT g.ts, round(gross, 6) AS gross, n_held, round(gross - coalesce(cost, 0), 6) AS net FROM g LEFT JOIN (SELECT ff.ts, cost FROM tt JOIN ff USING (period)) z ON z.ts = g.ts")
def pf_rotation_panel(spark, sf):
    return pf.rotation_panel(src.weekly(spark, sf)).select("ts", *r("gross", "net"), "n_held")


@query(f"{VOL}, n AS (SELECT ts, symbol, vol, lead(ret) OVER ({S}) AS nxt FROM v) SELECT ts, round(avg(nxt), 6) AS ret FROM (SELECT * FROM n WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY vol, symbol) <= 5) GROUP BY 1")
def pf_lowvol_window(spark, sf):
    v = vols(spark, sf).withColumn("nxt", F.lead("ret").over(f.series()))
    return xs.top(v.where("vol IS NOT NULL"), 5, [F.col("vol"), F.col("symbol")]).groupBy("ts").agg(F.round(F.avg("nxt"), 6).alias("ret"))


@query(f"WITH x AS (SELECT symbol, ts, lag(close, 4) OVER ({S}) / lag(close, 52) OVER ({S}) - 1 AS m, lead(close) OVER ({S}) / close - 1 AS nxt FROM bars_w) SELECT ts, round(sum(CASE WHEN m > 0 THEN nxt ELSE 0 END) / count(*), 6) AS ret FROM x WHERE m IS NOT NULL AND nxt IS NOT NULL GROUP BY 1")
def pf_tsmom_window(spark, sf):
    x = src.weekly(spark, sf).select("symbol", "ts", (f.lag("close", 4) / f.lag("close", 52) - 1).alias("m"), (F.lead("close").over(f.series()) / F.col("close") - 1).alias("nxt"))
    return x.where("m IS NOT NULL AND nxt IS NOT NULL").groupBy("ts").agg(F.round(F.sum(F.when(F.col("m") > 0, F.col("nxt")).otherwise(0.0)) / F.count("*"), 6).alias("ret"))


@query("WITH d AS (SELECT DISTINCT ts FROM bars_w), g AS (SELECT d.ts, s.symbol, first_value(close) OVER (PARTITION BY s.symbol ORDER BY ts0) AS f0, b.close FROM d CROSS JOIN (SELECT symbol, min(ts) AS ts0 FROM bars_w GROUP BY 1) s ASOF JOIN bars_w b ON b.symbol = s.symbol AND d.ts >= b.ts), f AS (SELECT symbol, arg_min(close, ts) AS entry FROM bars_w GROUP BY 1) SELECT g.ts, round(avg(g.close / f.entry), 6) AS nav FROM g JOIN f USING (symbol) GROUP BY 1")
def pf_buyhold_panel(spark, sf):
    b = src.weekly(spark, sf).select("symbol", "ts", "close")
    grid = b.select("ts").distinct().crossJoin(b.select("symbol").distinct()).join(b, ["symbol", "ts"], "left")
    w = f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = grid.withColumns({"mark": F.last("close", ignorenulls=True).over(w), "entry": F.first("close", ignorenulls=True).over(w)}).where("mark IS NOT NULL")
    return held.groupBy("ts").agg(F.round(F.avg(F.col("mark") / F.col("entry")), 6).alias("nav"))


@query(f"{HOLD}, q AS (SELECT symbol, ts, lead(close) OVER ({S}) / close - 1 AS nxt FROM bars_w) SELECT q.ts, round(sum(h.weight * nxt), 6) AS strategy, round(avg(nxt), 6) AS benchmark FROM q LEFT JOIN h USING (ts, symbol) WHERE nxt IS NOT NULL GROUP BY 1")
def pf_weighted_return(spark, sf):
    q = src.weekly(spark, sf).select("symbol", "ts", (F.lead("close").over(f.series()) / F.col("close") - 1).alias("nxt")).where("nxt IS NOT NULL")
    j = q.join(holdings(spark, sf).select("ts", "symbol", "weight"), ["ts", "symbol"], "left")
    return j.groupBy("ts").agg(F.round(F.sum(F.col("weight") * F.col("nxt")), 6).alias("strategy"), F.round(F.avg("nxt"), 6).alias("benchmark"))


@query(f"""{HOLD}, l AS (SELECT max(ts) AS ts FROM h), pl AS (SELECT max(ts) AS ts FROM h WHERE ts < (SELECT ts FROM l)), mk AS (SELECT symbol, close AS mark FROM bars_w JOIN l USING (ts)), tg AS (SELECT symbol, floor(1000000 * weight / mark) AS target FROM h JOIN l USING (ts) JOIN mk USING (symbol)),
    hd AS (SELECT symbol, floor(1000000 * weight / close) AS held FROM h JOIN pl USING (ts) JOIN bars_w USING (symbol, ts)), dl AS (SELECT symbol, coalesce(held, 0) AS held, coalesce(target, 0) AS target, coalesce(target, 0) - coalesce(held, 0) AS delta, mark FROM tg FULL JOIN hd USING (symbol) LEFT JOIN mk USING (symbol))
    SELECT CAST(row_number() OVER (ORDER BY delta > 0, symbol) AS INT) AS place, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(held AS BIGINT) AS held, CAST(target AS BIGINT) AS target, CAST(abs(delta) AS BIGINT) AS qty, round(abs(delta) * mark, 4) AS notional FROM dl WHERE delta <> 0 AND NOT coalesce(mark > 0 AND abs(delta) * mark < 500, false)""")
def pf_targets(spark, sf):
    """Whole-share targets of the last list against the shares of the list before: sells first, then buys, by symbol, without dust."""
    h, bars = holdings(spark, sf).select("ts", "symbol", "weight"), src.weekly(spark, sf).select("symbol", "ts", "close")
    two = h.select("ts").distinct().orderBy(F.desc("ts")).limit(2).withColumn("__k", F.row_number().over(Window.orderBy(F.desc("ts"))))
    sized = h.join(F.broadcast(two), "ts").join(bars, ["symbol", "ts"]).withColumn("qty", F.floor(1_000_000 * F.col("weight") / F.col("close")))
    marks = bars.join(F.broadcast(two.where("__k = 1")), "ts").select("symbol", F.col("close").alias("mark"))
    return pf.plan(sized.where("__k = 1").select("symbol", F.col("qty").alias("target")), sized.where("__k = 2").select("symbol", F.col("qty").alias("held")), marks, dust=500.0)
