"""Queries of factors, valuation, macro, risk, news and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import scalars as sc
from tapeloom.functions import stats as st
from tapeloom.operators import crosssection as xs
from tapeloom.operators import features as f
from tapeloom.operators import joins as j
from tapeloom.operators import macro as mac
from tapeloom.operators import risk as rk
from tapeloom.operators import signals as sg
from tapeloom.operators import states
from tapeloom.operators import valuation as val
from tapeloom.plans.market import MOMENTS, moments, ncdf
from tapeloom.plans.registry import query
from tapeloom.plans.selection import MOM, mom, zsql
from tapeloom.plans.windows import TR, S, r, rows
from tapeloom.sources import adapters as src

#: Weekly bars with the last known fundamentals.
PIT = f"m AS ({MOM}), pit AS (SELECT m.*, f.revenue, f.net_income, f.free_cash_flow, f.total_assets, f.total_equity, f.total_debt, f.gross_profit, f.shares_out, f.period_end FROM m ASOF JOIN (SELECT * FROM fund_q) f ON m.symbol = f.symbol AND m.ts >= f.known_date)"
FACTS = ("revenue", "net_income", "free_cash_flow", "total_assets", "total_equity", "total_debt", "gross_profit", "shares_out")


def pit(spark, sf):
    out = j.asof_backward(mom(spark, sf), src.fundamentals(spark, sf), ("symbol",), "ts", "known_date", ("period_end", *FACTS), ("period_end",)).where("fact IS NOT NULL")
    return out.select("symbol", "ts", "close", "mom", "volume", *(F.col(f"fact.{c}").alias(c) for c in FACTS), F.col("fact.period_end").alias("period_end"))


AQR = f"WITH {PIT}, a AS (SELECT ts, symbol, net_income / (close * shares_out) AS value, mom, (net_income / total_equity + free_cash_flow / (close * shares_out)) / 2 AS quality FROM pit WHERE mom IS NOT NULL), s AS (SELECT ts, symbol, round({zsql('value')} + {zsql('mom')} + {zsql('quality')}, 9) AS score FROM a)"


def aqr(spark, sf):
    cap = F.col("close") * F.col("shares_out")
    a = pit(spark, sf).where("mom IS NOT NULL").select("ts", "symbol", (F.col("net_income") / cap).alias("value"), "mom", ((F.col("net_income") / F.col("total_equity") + F.col("free_cash_flow") / cap) / 2).alias("quality"))
    return a.select("ts", "symbol", F.round(xs.z("value") + xs.z("mom") + xs.z("quality"), 9).alias("score"))


@query(f"{AQR} SELECT ts, symbol, round(score, 6) AS score, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS rank FROM s")
def xs_aqr_rank(spark, sf):
    return aqr(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("score"), "symbol")).cast("long")).withColumn("score", F.round("score", 6))


FC = f"WITH {PIT}, v AS (SELECT symbol, ts, CASE WHEN count(rr) OVER {rows(12)} = 12 THEN stddev_pop(rr) OVER {rows(12)} END AS vol, rr FROM (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS rr FROM bars_w)), a AS (SELECT p.ts, p.symbol, mom, v.rr AS rev, -v.vol AS calm, net_income / (close * shares_out) AS value, net_income / total_equity AS quality FROM pit p JOIN v USING (symbol, ts) WHERE mom IS NOT NULL)"


@query(f"{FC} SELECT ts, symbol, round({zsql('mom')} - 0.5 * {zsql('rev')} + 0.5 * {zsql('calm')} + {zsql('value')} + {zsql('quality')}, 6) AS composite FROM a")
def xs_factor_composite(spark, sf):
    b = f.returns(src.weekly(spark, sf)).select("symbol", "ts", F.col("ret").alias("rev"), (-f.full(F.stddev_pop("ret"), 12, "ret")).alias("calm"))
    a = pit(spark, sf).where("mom IS NOT NULL").join(b, ["symbol", "ts"]).withColumns({"value": F.col("net_income") / (F.col("close") * F.col("shares_out")), "quality": F.col("net_income") / F.col("total_equity")})
    return a.select("ts", "symbol", F.round(xs.z("mom") - 0.5 * xs.z("rev") + 0.5 * xs.z("calm") + xs.z("value") + xs.z("quality"), 6).alias("composite"))


def _variant(k: int) -> str:
    return f"SELECT ts, symbol, 1.0 / count(*) OVER (PARTITION BY ts) AS w FROM (SELECT ts, symbol FROM (SELECT symbol, ts, close / lag(close, {k}) OVER ({S}) - 1 AS mom FROM bars_w) WHERE mom > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol DESC) <= 5)"


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_variant(k)})" for k in (8, 12, 26)) + "), n AS (SELECT ts, count(DISTINCT k) AS n FROM u GROUP BY 1) SELECT u.ts, symbol, round(sum(w) / any_value(n), 6) AS weight FROM u JOIN n USING (ts) GROUP BY 1, 2")
def xs_factor_ensemble(spark, sf):
    from tapeloom.operators import portfolio as pf

    b = src.weekly(spark, sf)
    u = None
    for k in (8, 12, 26):
        v = pf.equal_weights(pf.momentum_holdings(b, k, 5)).select("ts", "symbol", F.col("weight").alias("w"), F.lit(k).alias("k"))
        u = v if u is None else u.unionByName(v)
    n = u.groupBy("ts").agg(F.countDistinct("k").alias("n"))
    return u.join(n, "ts").groupBy("ts", "symbol").agg(F.round(F.sum("w") / F.first("n"), 6).alias("weight"))


@query(f"WITH m AS ({MOM}), a AS (SELECT *, volume / CASE WHEN count(volume) OVER {rows(20)} = 20 THEN avg(volume) OVER {rows(20)} END AS surge FROM m), g AS (SELECT * FROM a WHERE mom > 0 AND surge >= 1.5 AND close * volume > 1000) SELECT ts, symbol, round({zsql('mom')} + {zsql('surge')}, 6) AS score FROM g")
def xs_surge_screen(spark, sf):
    g = f.rvol(mom(spark, sf)).withColumnRenamed("rvol", "surge").where("mom > 0 AND surge >= 1.5 AND close * volume > 1000")
    return g.select("ts", "symbol", F.round(xs.z("mom") + xs.z("surge"), 6).alias("score"))


@query(f"WITH m AS ({MOM}), l AS (SELECT symbol, mom FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) SELECT symbol, round(mom, 6) AS mom, row_number() OVER (ORDER BY mom DESC, symbol) AS rank FROM l WHERE mom IS NOT NULL")
def xs_momentum_screen(spark, sf):
    last = mom(spark, sf).groupBy("symbol").agg(F.max_by("mom", "ts").alias("mom")).where("mom IS NOT NULL")
    return last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mom"), "symbol")).cast("long")).withColumn("mom", F.round("mom", 6))


def _years(n: int) -> str:
    """The record nearest to n years before the last, of those before it and at most 120 days off; the earlier on a tie."""
    gap = f"abs(date_diff('day', CAST(last_end - INTERVAL {round(365.25 * n)} DAY AS DATE), period_end))"
    return f"arg_min({{'rev': revenue, 'eps': eps, 'sh': shares_out}}, row({gap}, period_end)) FILTER (period_end < last_end AND {gap} <= 120) AS y{n}"


METRICS = f"""WITH k AS (SELECT *, net_income / shares_out AS eps, max(period_end) OVER (PARTITION BY symbol) AS last_end, row_number() OVER (PARTITION BY symbol ORDER BY period_end) - 1 AS i, greatest(-1, least(1, CASE WHEN revenue > 0 THEN net_income / revenue END)) AS m FROM fund_q),
    g AS (SELECT symbol, {_years(1)}, {_years(2)}, {_years(3)}, CASE WHEN count(m) >= 2 THEN regr_slope(m, i) END AS trend FROM k GROUP BY 1), p AS (SELECT symbol, arg_max(close, ts) AS price FROM bars_w GROUP BY 1),
    l AS (SELECT k.*, y1, y2, y3, trend, price, price * shares_out AS cap FROM k JOIN g USING (symbol) LEFT JOIN p USING (symbol) WHERE period_end = last_end)"""
RATIOS = {
    "revenue_cagr": "CASE WHEN y3.rev > 0 AND revenue > 0 THEN power(revenue / y3.rev, 1.0 / 3) - 1 END", "revenue_growth_acceleration": "CASE WHEN revenue > 0 AND y1.rev > 0 AND y2.rev > 0 THEN revenue / y1.rev - y1.rev / y2.rev END", "eps_growth": "CASE WHEN y3.eps <> 0 THEN (eps - y3.eps) / abs(y3.eps) END",
    "operating_margin": "CASE WHEN revenue > 0 THEN operating_income / revenue END", "net_margin": "CASE WHEN revenue > 0 THEN net_income / revenue END", "gross_margin": "CASE WHEN revenue > 0 THEN gross_profit / revenue END", "gross_profitability": "CASE WHEN total_assets > 0 THEN gross_profit / total_assets END",
    "margin_trend": "trend", "roic": "CASE WHEN total_equity + total_debt > 0 THEN net_income / (total_equity + total_debt) END", "fcf_margin": "CASE WHEN revenue > 0 THEN free_cash_flow / revenue END", "fcf_conversion": "CASE WHEN net_income > 0 THEN free_cash_flow / net_income END",
    "debt_to_equity": "CASE WHEN total_equity > 0 THEN total_debt / total_equity END", "share_growth": "CASE WHEN y3.sh > 0 AND shares_out > 0 THEN power(shares_out / y3.sh, 1.0 / 3) - 1 END", "pe": "CASE WHEN eps > 0 THEN price / eps END", "pfcf": "CASE WHEN free_cash_flow > 0 THEN cap / free_cash_flow END",
    "ps": "CASE WHEN revenue > 0 THEN cap / revenue END", "pb": "CASE WHEN total_equity > 0 THEN cap / total_equity END", "market_cap": "CASE WHEN shares_out > 0 THEN cap END",
}


@query(f"{METRICS} SELECT symbol, period_end, {', '.join(f'round({v}, 6) AS {k}' for k, v in RATIOS.items())} FROM l")
def xs_compounder_metrics(spark, sf):
    return compounders(spark, sf).select("symbol", "period_end", *r(*val.METRICS))


def compounders(spark, sf):
    price = src.weekly(spark, sf).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return val.compounder_metrics(src.fundamentals(spark, sf).withColumn("eps", F.col("net_income") / F.col("shares_out")), price)


def _steps(v: str, table, sign: str = ">=", missing: int = 0) -> str:
    return f"CASE WHEN {v} IS NULL THEN {missing} " + " ".join(f"WHEN {v} {sign} {k} THEN {n}" for k, n in table) + " ELSE 0 END"


@query(f"""WITH q AS (SELECT symbol, period_end, round(100 * net_income / total_equity, 9) AS roe, round(100 * operating_income / revenue, 9) AS margin, round(100 * (revenue / lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY period_end) - 1), 9) AS growth, round(100 * net_income / total_assets, 9) AS roa, round((total_assets - total_equity) / total_equity, 9) AS lev, round(0.5 * revenue / net_income, 9) AS pe FROM fund_q), p AS (SELECT *, CASE WHEN growth > 0 THEN round(pe / growth, 9) END AS peg FROM q)
    SELECT symbol, period_end, {_steps('roe', val.ROE_STEPS)} + {_steps('margin', val.MARGIN_STEPS)} + {_steps('growth', val.GROWTH_STEPS)} + {_steps('roa', val.ROA_STEPS)} + {_steps('lev', val.LEVERAGE_STEPS, '<=')} AS quality, {_steps('pe', val.PE_STEPS, '<=')} + {_steps('peg', val.PEG_STEPS, '<=', 25)} AS value FROM p""")
def xs_quality_value_score(spark, sf):
    c = F.col
    w = Window.partitionBy("symbol").orderBy("period_end")
    near = lambda x: F.round(x, 9)
    s = val.quality_value(near(100 * c("net_income") / c("total_equity")), near(100 * c("operating_income") / c("revenue")), c("growth"), near(100 * c("net_income") / c("total_assets")), near((c("total_assets") - c("total_equity")) / c("total_equity")), near(0.5 * c("revenue") / c("net_income")))
    return src.fundamentals(spark, sf).withColumn("growth", near(100 * (c("revenue") / F.lag("revenue", 4).over(w) - 1))).select("symbol", "period_end", *(v.alias(k) for k, v in s.items()))


@query("SELECT symbol, period_end, round(revenue, 2) AS latest, round(lag(revenue) OVER (PARTITION BY symbol ORDER BY period_end), 2) AS prior, round(revenue / lag(revenue) OVER (PARTITION BY symbol ORDER BY period_end) - 1, 6) AS growth FROM fund_q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1")
def xs_latest_prior_fact(spark, sf):
    w = Window.partitionBy("symbol").orderBy("period_end")
    q = src.fundamentals(spark, sf).select("symbol", "period_end", F.col("revenue").alias("latest"), F.lag("revenue").over(w).alias("prior"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end"))).alias("n"))
    return q.where("n = 1").select("symbol", "period_end", *r("latest", "prior", n=2), F.round(F.col("latest") / F.col("prior") - 1, 6).alias("growth"))


@query(f"""WITH b AS (SELECT ts, bench / lag(bench, 4) OVER w - 1 AS b1, bench / lag(bench, 13) OVER w - 1 AS b3, bench / lag(bench, 26) OVER w - 1 AS b6 FROM bench_w WINDOW w AS (ORDER BY ts)), s AS (SELECT symbol, ts, close / lag(close, 4) OVER ({S}) - 1 AS s1, close / lag(close, 13) OVER ({S}) - 1 AS s3, close / lag(close, 26) OVER ({S}) - 1 AS s6 FROM bars_w),
    x AS (SELECT symbol, ts, 100 * (s1 - b1) AS r1, 100 * (s3 - b3) AS r3, 100 * (s6 - b6) AS r6, 100 * (s1 - s3 / 3) AS acc FROM s JOIN b USING (ts) WHERE s6 IS NOT NULL AND b6 IS NOT NULL), y AS (SELECT *, round(r1 * 0.25 + r3 * 0.40 + r6 * 0.35, 6) AS leadership, round(r1 * 0.45 + acc * 0.30 + r3 * 0.20 - greatest(r6, 0) * 0.05, 6) AS next_leader FROM x)
    SELECT symbol, ts, round(r1, 6) AS rel_1m, round(r3, 6) AS rel_3m, round(r6, 6) AS rel_6m, round(acc, 6) AS acceleration, leadership, next_leader, CASE WHEN leadership > 10 THEN 'established' WHEN next_leader > 4 AND round(acc, 6) > 0 THEN 'emerging' WHEN leadership > 0 THEN 'positive' WHEN round(acc, 6) > 0 THEN 'improving' ELSE 'lagging' END AS read FROM y""")
def xs_industry_rotation(spark, sf):
    w = Window.orderBy("ts")  # a row a date
    back = ((4, "1"), (13, "3"), (26, "6"))
    b = src.benchmark(spark, sf).select("ts", *((F.col("bench") / F.lag("bench", k).over(w) - 1).alias(f"b{n}") for k, n in back))
    s = src.weekly(spark, sf).select("symbol", "ts", *((F.col("close") / f.lag("close", k) - 1).alias(f"s{n}") for k, n in back))
    x = s.join(b, "ts").where("s6 IS NOT NULL AND b6 IS NOT NULL")
    one, three, six = (100 * (F.col(f"s{n}") - F.col(f"b{n}")) for n in "136")
    acc = 100 * (F.col("s1") - F.col("s3") / 3)
    lead, new = F.round(one * 0.25 + three * 0.40 + six * 0.35, 6), F.round(one * 0.45 + acc * 0.30 + three * 0.20 - F.greatest(six, F.lit(0.0)) * 0.05, 6)
    x = x.select("symbol", "ts", F.round(one, 6).alias("rel_1m"), F.round(three, 6).alias("rel_3m"), F.round(six, 6).alias("rel_6m"), F.round(acc, 6).alias("acceleration"), lead.alias("leadership"), new.alias("next_leader"))
    grows = F.col("acceleration") > 0
    read = F.when(F.col("leadership") > 10, "established").when((F.col("next_leader") > 4) & grows, "emerging").when(F.col("leadership") > 0, "positive").when(grows, "improving").otherwise("lagging")
    return x.withColumn("read", read)


@query("""WITH x AS (SELECT symbol, ts, event_id, net_value, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS n FROM flows WHERE investor = 'view' AND value_kind = 'reported_value' AND confidence = 'high')
    SELECT symbol, max(ts) AS as_of, round(sum(net_value), 4) AS score, CASE WHEN sum(net_value) > 0 THEN 'long' ELSE 'short' END AS direction FROM x WHERE n <= 5 GROUP BY 1 HAVING count(*) = 5""")
def sig_foreign_flow(spark, sf):
    return foreign_flow(src.flows(spark, sf), "view")


def foreign_flow(flows, investor: str, lookback: int = 5):
    """Net trusted flow of one investor over its last rows; the tables name no foreigners, so an event type stands for them."""
    from tapeloom.operators.catalog import trusted

    x = xs.top(flows.where((F.col("investor") == investor) & trusted()), lookback, [F.desc("ts"), F.desc("event_id")], "symbol")
    g = x.groupBy("symbol").agg(F.max("ts").alias("as_of"), F.sum("net_value").alias("net"), F.count("*").alias("n")).where(F.col("n") == lookback)
    return g.select("symbol", "as_of", F.round("net", 4).alias("score"), F.when(F.col("net") > 0, "long").otherwise("short").alias("direction"))


@query(f"WITH x AS (SELECT symbol, ts, CASE WHEN count(volume) OVER {rows(156)} = 156 THEN CASE WHEN max(volume) OVER {rows(156)} > min(volume) OVER {rows(156)} THEN (volume - min(volume) OVER {rows(156)}) / (max(volume) OVER {rows(156)} - min(volume) OVER {rows(156)}) * 100 ELSE 50 END END AS idx FROM bars_w) SELECT symbol, ts, CASE WHEN idx >= 90 THEN 'short' ELSE 'long' END AS direction, round(CASE WHEN idx >= 90 THEN idx - 90 ELSE 10 - idx END, 6) AS score FROM x WHERE idx >= 90 OR idx <= 10")
def sig_cot_extreme(spark, sf):
    x = f.index_in_range(src.weekly(spark, sf), "volume", 156).where("index >= 90 OR index <= 10")
    high = F.col("index") >= 90
    return x.select("symbol", "ts", F.when(high, "short").otherwise("long").alias("direction"), F.round(F.when(high, F.col("index") - 90).otherwise(10 - F.col("index")), 6).alias("score"))


PEAK = f"SELECT symbol, ts, close, CASE WHEN count(close) OVER {rows(21)} = 21 AND min(close) OVER {rows(21)} > 0 THEN max(close) OVER {rows(21)} END AS peak FROM bars_d"


@query(f"SELECT symbol, ts, round(peak, 6) AS peak, round(close / peak, 6) AS share FROM ({PEAK})")
def w_vix_peak(spark, sf):
    b = src.daily(spark, sf).withColumn("peak", F.when(f.over(F.min("close"), 21) > 0, f.full(F.max("close"), 21)))
    return b.select("symbol", "ts", *r("peak"), F.round(F.col("close") / F.col("peak"), 6).alias("share"))


@query(f"SELECT symbol, ts FROM ({PEAK}) WHERE peak >= 1500 AND close <= 0.8 * peak")
def sig_vix_peak(spark, sf):
    b = src.daily(spark, sf).withColumn("peak", F.when(f.over(F.min("close"), 21) > 0, f.full(F.max("close"), 21)))
    return b.where((F.col("peak") >= 1500) & (F.col("close") <= 0.8 * F.col("peak"))).select("symbol", "ts")


@query("SELECT a.ts, round(a.close / b.close, 6) AS ratio, a.close / b.close > 1 AS backwardation FROM bars_w a JOIN bars_w b USING (ts) WHERE a.symbol = 'Brand#1' AND b.symbol = 'Brand#2'")
def sig_vix_term(spark, sf):
    b = src.weekly(spark, sf)
    side = lambda s, n: b.where(F.col("symbol") == s).select("ts", F.col("close").alias(n))
    return side("Brand#1", "a").join(side("Brand#2", "b"), "ts").select("ts", F.round(F.col("a") / F.col("b"), 6).alias("ratio"), (F.col("a") / F.col("b") > 1).alias("backwardation"))


PAIRS104 = "pr AS (SELECT sa, sb, ts, y, x FROM (SELECT a.symbol AS sa, b.symbol AS sb, a.ts, ln(a.close) AS y, ln(b.close) AS x FROM bars_w a JOIN bars_w b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.close > 0 AND b.close > 0) QUALIFY row_number() OVER (PARTITION BY sa, sb ORDER BY ts DESC) <= 104)"


@query(f"""WITH {PAIRS104}, h AS (SELECT sa, sb, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS cut, corr(y, x) AS corr FROM pr GROUP BY 1, 2),
    s AS (SELECT sa, sb, n, slope, corr, ts, y - (cut + slope * x) AS s FROM pr JOIN h USING (sa, sb)), l AS (SELECT *, lag(s) OVER (PARTITION BY sa, sb ORDER BY ts) AS p FROM s),
    g AS (SELECT sa, sb, n, slope, corr, CASE WHEN any_value(n) >= 60 AND stddev_pop(s) > 1e-12 THEN round((arg_max(s, ts) - avg(s)) / stddev_pop(s), 4) END AS z, regr_slope(s - p, p) AS k FROM l GROUP BY ALL)
    SELECT sa AS symbol_a, sb AS symbol_b, n, CASE WHEN n >= 60 THEN round(slope, 5) END AS hedge, CASE WHEN n >= 60 THEN round(corr, 5) END AS corr, z, CASE WHEN z IS NOT NULL AND k < 0 THEN round(-ln(2) / k, 4) END AS half_life, CASE WHEN abs(z) >= 2 THEN 'entry' WHEN abs(z) <= 0.5 THEN 'exit' WHEN z IS NOT NULL THEN 'watch' END AS state, CASE WHEN z >= 2 THEN sb WHEN z <= -2 THEN sa END AS long_symbol FROM g""")
def sig_pair(spark, sf):
    b = src.weekly(spark, sf).where("close > 0")
    x = b.select(F.col("symbol").alias("symbol_a"), "ts", F.log("close").alias("y")).join(b.select(F.col("symbol").alias("symbol_b"), "ts", F.log("close").alias("x")), "ts").where("symbol_a < symbol_b")
    return sg.pair_state(x, ["symbol_a", "symbol_b"]).select("symbol_a", "symbol_b", "n", *r("hedge", "corr", n=5), "z", F.round("half_life", 4).alias("half_life"), "state", F.when(F.col("z") >= 2, F.col("symbol_b")).when(F.col("z") <= -2, F.col("symbol_a")).alias("long_symbol"))


@query(f"WITH x AS ({TR}), a AS (SELECT symbol, ts, close, CASE WHEN count(tr) OVER {rows(14)} = 14 THEN avg(tr) OVER {rows(14)} END AS atr FROM x) SELECT symbol, ts, round(close - 0.5 * atr, 6) AS entry, round(close - 2 * atr, 6) AS stop, round(close + 3 * atr, 6) AS target FROM a WHERE atr > 0 AND close - 2 * atr > 0")
def band_advisory(spark, sf):
    b = f.atr(src.daily(spark, sf)).where("atr > 0 AND close - 2 * atr > 0")
    return b.select("symbol", "ts", *(F.round(F.col("close") + k * F.col("atr"), 6).alias(n) for k, n in ((-0.5, "entry"), (-2.0, "stop"), (3.0, "target"))))


DCF = f"""(SELECT symbol, period_end, CASE WHEN free_cash_flow > 0 AND shares_out > 0 THEN (free_cash_flow * ({' + '.join(f'power(1.03, {t}) / {1.1**t!r}' for t in range(1, 6))}) + free_cash_flow * power(1.03, 5) * 1.02 / (0.1 - 0.02) / {1.1**5!r} - total_debt) / shares_out END AS dcf, net_income / shares_out * 15 AS pe, total_equity / shares_out * 1.2 AS pb, revenue / shares_out * 2 AS price FROM fund_q)"""


def dcf_rows(spark, sf):
    q = src.fundamentals(spark, sf)
    per = lambda c: F.col(c) / F.col("shares_out")
    return q.select("symbol", "period_end", val.dcf(F.col("free_cash_flow"), F.lit(0.03), 0.1, 0.02, F.col("total_debt"), F.col("shares_out")).alias("dcf"), (per("net_income") * 15).alias("pe"), (per("total_equity") * 1.2).alias("pb"), (per("revenue") * 2).alias("price"))


@query(f"SELECT symbol, period_end, round(dcf, 2) AS dcf FROM {DCF}")
def val_dcf(spark, sf):
    return dcf_rows(spark, sf).select("symbol", "period_end", F.round("dcf", 2).alias("dcf"))


FAIR = f"""p AS (SELECT symbol, period_end, price, CASE WHEN dcf > 0 THEN dcf END AS a, CASE WHEN pe > 0 THEN pe END AS b, CASE WHEN pb > 0 THEN pb END AS c FROM {DCF}), n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, (coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / (CASE WHEN a IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END) AS fair FROM p),
    d AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / n AS mean FROM n)"""


def fair_rows(spark, sf):
    m = val.composite({"dcf": (F.col("dcf"), 0.5), "pe": (F.col("pe"), 0.3), "pb": (F.col("pb"), 0.2)})
    return dcf_rows(spark, sf).withColumns(m)


@query(f"WITH {FAIR} SELECT symbol, period_end, round(fair, 2) AS fair, n AS n_methods, round(sqrt((coalesce((a - mean) ** 2, 0) + coalesce((b - mean) ** 2, 0) + coalesce((c - mean) ** 2, 0)) / n) / fair, 5) AS dispersion FROM d")
def val_composite(spark, sf):
    return fair_rows(spark, sf).select("symbol", "period_end", F.round("fair", 2).alias("fair"), "n_methods", F.round("dispersion", 5).alias("dispersion"))


@query(f"WITH {FAIR} SELECT symbol, period_end, round(fair / price - 1, 5) AS upside, count(*) OVER (PARTITION BY period_end) - 1 AS n_peers FROM d")
def val_fair_value(spark, sf):
    return fair_rows(spark, sf).select("symbol", "period_end", F.round(F.col("fair") / F.col("price") - 1, 5).alias("upside"), (F.count("*").over(Window.partitionBy("period_end")) - 1).alias("n_peers"))


@query(f"WITH {FAIR} SELECT symbol, period_end, round(price * 0.3 + price * 0.97 * 0.4 + price * 0.94 * 0.3, 4) AS average_entry, round(price * 0.94 * 0.92, 4) AS stop, round(fair * 1.15, 2) AS target FROM d")
def val_entry_ladder(spark, sf):
    x = fair_rows(spark, sf).withColumn("ladder", val.entry_ladder(F.col("price"), F.col("fair")))
    avg = F.aggregate("ladder", F.lit(0.0), lambda a, s: a + s["pct"] * s["price"])
    return x.select("symbol", "period_end", F.round(avg, 4).alias("average_entry"), F.round(F.element_at("ladder", -1)["price"] * 0.92, 4).alias("stop"), F.round(F.col("fair") * 1.15, 2).alias("target"))


#: Per date: percentile of the upside, method agreement, membership, and the symbol's own record of weekly returns.
CONF = f"""{MOMENTS}, w AS (SELECT symbol, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS wf FROM x WHERE ret IS NOT NULL GROUP BY 1), z AS (SELECT symbol, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS v, sr, n FROM m), e AS (SELECT symbol, CASE WHEN v > 0 THEN sr * sqrt(n - 1) / sqrt(v) END AS z1, CASE WHEN v > 0 THEN (sr - 0.02) * sqrt(n - 1) / sqrt(v) END AS z2 FROM z), {FAIR},
    c AS (SELECT *, sqrt((coalesce((a - mean) ** 2, 0) + coalesce((b - mean) ** 2, 0) + coalesce((c - mean) ** 2, 0)) / n) / fair AS spread FROM d),
    s AS (SELECT c.symbol, c.period_end, c.fair, c.price, 100.0 * (count(*) OVER (PARTITION BY c.period_end) - row_number() OVER (PARTITION BY c.period_end ORDER BY round(fair / price, 9) DESC, c.symbol)) / nullif(count(*) OVER (PARTITION BY c.period_end) - 1, 0) AS pct, row_number() OVER (PARTITION BY c.period_end ORDER BY round(fair / price, 9) DESC, c.symbol) AS rank,
      CASE WHEN n < 2 OR spread > 0.5 THEN 0.8 WHEN spread > 0.25 THEN 0.9 ELSE 1.0 END AS factor, 0.4 * wf + 0.3 * coalesce({ncdf('z1')}, 0) + 0.3 * coalesce({ncdf('z2')}, 0) AS reliability, mb.end_date IS NULL AS inside FROM c LEFT JOIN w USING (symbol) LEFT JOIN e USING (symbol) LEFT JOIN members mb USING (symbol)),
    f AS (SELECT *, round(CASE WHEN inside THEN pct * reliability * factor ELSE least(pct * reliability * factor, 25) END, 4) AS confidence FROM s), h AS (SELECT *, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END AS band FROM f)"""


def confident(spark, sf):
    own = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").groupBy("symbol").agg(F.avg((F.col("ret") > 0).cast("double")).alias("wf"))
    m = moments(spark, sf)
    phi = lambda base: F.coalesce(st.normal_cdf(st.psr(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), F.lit(base))), F.lit(0.0))
    m = m.select("symbol", phi(0.0).alias("psr"), phi(0.02).alias("dsr"))
    best = [F.desc(F.round(F.col("fair") / F.col("price"), 9)), F.col("symbol")]
    x = fair_rows(spark, sf).withColumns({"pct": xs.rank_percentile(best, "period_end"), "rank": F.row_number().over(Window.partitionBy("period_end").orderBy(*best))})
    x = x.join(own, "symbol", "left").join(m, "symbol", "left").join(src.members(spark, sf).select("symbol", F.col("end_date").isNull().alias("inside")), "symbol", "left")
    return x.withColumn("confidence", F.round(val.confidence(F.col("pct"), F.col("inside"), F.col("wf"), F.col("psr"), F.col("dsr"), val.valuation_factor(F.col("n_methods"), F.col("dispersion"))), 4)).withColumn("band", F.when(F.col("confidence") >= 70, "high").when(F.col("confidence") >= 45, "medium").otherwise("low"))


@query(f"{CONF} SELECT symbol, period_end, confidence, band, inside FROM h")
def val_confidence(spark, sf):
    return confident(spark, sf).select("symbol", "period_end", "confidence", "band", "inside")


@query(f"""{CONF} SELECT symbol, period_end, rank, round(fair, 2) AS fair, round(fair / price - 1, 5) AS upside, confidence, band, round(price * 0.97, 4) AS average_entry, round(price * 0.94 * 0.92, 4) AS stop, round(fair * 1.15, 2) AS target,
    CASE WHEN NOT inside THEN 'AVOID' WHEN rank <= 5 THEN CASE WHEN band IN ('high', 'medium') THEN 'BUY' ELSE 'HOLD' END WHEN band IN ('high', 'medium') THEN 'HOLD' ELSE 'AVOID' END AS action FROM h""")
def val_scan(spark, sf):
    x = confident(spark, sf).withColumn("ladder", val.entry_ladder(F.col("price"), F.col("fair")))
    sure = F.col("band").isin("high", "medium")
    action = F.when(~F.col("inside"), "AVOID").when(F.col("rank") <= 5, F.when(sure, "BUY").otherwise("HOLD")).when(sure, "HOLD").otherwise("AVOID")
    entry = F.aggregate("ladder", F.lit(0.0), lambda a, s: a + s["pct"] * s["price"])
    return x.select(
        "symbol", "period_end", F.col("rank").cast("long").alias("rank"), *r("fair", n=2), F.round(F.col("fair") / F.col("price") - 1, 5).alias("upside"), "confidence", "band", F.round(entry, 4).alias("average_entry"),
        F.round(F.element_at("ladder", -1)["price"] * 0.92, 4).alias("stop"), F.round(F.col("fair") * 1.15, 2).alias("target"), action.alias("action"),
    )


OPT = "q AS (SELECT p_brand AS expiry, 0.05 + 0.01 * CAST(substr(p_brand, 7) AS INT) AS t, p_size::DOUBLE + 70 AS strike, max(greatest(0, 100 - p_size - 70.0) + 5 + (p_retailprice % 7) / 10) AS call, max(greatest(0, p_size + 70.0 - 100) + 5 + (p_retailprice % 5) / 10) AS put FROM part GROUP BY 1, 2, 3)"


def options(spark, sf):
    k = F.col("p_size").cast("double") + 70
    p = src.read(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("expiry"), (F.lit(0.05) + 0.01 * F.substring("p_brand", 7, 3).cast("int")).alias("t"), k.alias("strike")).agg(
        F.max(F.greatest(F.lit(0.0), 100 - k) + 5 + (F.col("p_retailprice") % 7) / 10).alias("call"), F.max(F.greatest(F.lit(0.0), k - 100) + 5 + (F.col("p_retailprice") % 5) / 10).alias("put")
    )


OPTVAR = f"""WITH {OPT}, a AS (SELECT *, first_value(strike) OVER w AS kk, first_value(call - put) OVER w AS dd FROM q WINDOW w AS (PARTITION BY expiry ORDER BY abs(call - put), strike)), b AS (SELECT *, kk + exp(0.02 * t) * dd AS fwd FROM a), c AS (SELECT *, max(CASE WHEN strike <= fwd THEN strike END) OVER (PARTITION BY expiry) AS k0, lead(strike) OVER (PARTITION BY expiry ORDER BY strike) AS up, lag(strike) OVER (PARTITION BY expiry ORDER BY strike) AS down FROM b),
    v AS (SELECT expiry, t, fwd, k0, 2 / t * sum(CASE WHEN up IS NULL THEN strike - down WHEN down IS NULL THEN up - strike ELSE (up - down) / 2 END / (strike * strike) * exp(0.02 * t) * CASE WHEN strike < k0 THEN put WHEN strike > k0 THEN call ELSE (call + put) / 2 END) - (fwd / k0 - 1) ** 2 / t AS variance FROM c GROUP BY 1, 2, 3, 4)"""


@query(f"{OPTVAR} SELECT expiry, round(t, 4) AS t, round(fwd, 4) AS fwd, k0, round(variance, 6) AS variance FROM v")
def opt_variance(spark, sf):
    return val.option_variance(options(spark, sf)).select("expiry", *r("t", "fwd", n=4), "k0", *r("variance"))


@query(f"{OPTVAR}, n AS (SELECT max(t) FILTER (t <= 0.155) AS t1, min(t) FILTER (t > 0.155) AS t2, arg_max(variance, t) FILTER (t <= 0.155) AS v1, arg_min(variance, t) FILTER (t > 0.155) AS v2 FROM v) SELECT round(100 * sqrt((t1 * v1 * (t2 - 0.155) / (t2 - t1) + t2 * v2 * (0.155 - t1) / (t2 - t1)) / 0.155), 4) AS index FROM n")
def opt_vix_index(spark, sf):
    v = val.option_variance(options(spark, sf))
    near, far = F.col("t") <= 0.155, F.col("t") > 0.155
    n = v.agg(F.max(F.when(near, F.col("t"))).alias("t1"), F.min(F.when(far, F.col("t"))).alias("t2"), F.max_by("variance", F.when(near, F.col("t"))).alias("v1"), F.min_by("variance", F.when(far, F.col("t"))).alias("v2"))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t2") - 0.155) / (F.col("t2") - F.col("t1"))))
    return n.select(F.round(100 * F.sqrt((F.col("t1") * F.col("v1") * w + F.col("t2") * F.col("v2") * (1 - w)) / 0.155), 4).alias("index"))


#: Quotes with sides, trades and ages, by fixed shares of the mids: some are crossed, missing, old or wide.
QUOTES = f"""{OPT}, b AS (SELECT expiry, t, strike, CAST(round(t * 365) AS INT) AS days, call * 0.98 AS cb, call * CASE WHEN CAST(strike AS INT) % 11 = 0 THEN 0.97 ELSE 1.02 END AS ca, CASE WHEN CAST(strike AS INT) % 13 > 0 THEN put * 0.95 END AS pb, CASE WHEN CAST(strike AS INT) % 13 > 0 THEN put * CASE WHEN CAST(strike AS INT) % 7 = 0 THEN 1.2 ELSE 1.02 END END AS pa,
    CAST(strike AS INT) % 9 AS call_age, CASE WHEN CAST(strike AS INT) % 10 > 0 THEN CAST(strike AS INT) % 8 END AS put_age FROM q)"""


def quotes(spark, sf):
    k = F.col("strike").cast("int")
    part = lambda n, then, other: F.when(k % n == 0, then).otherwise(other)
    return options(spark, sf).select(
        "expiry", "t", "strike", F.round(F.col("t") * 365).cast("int").alias("days"), (F.col("call") * 0.98).alias("cb"), (F.col("call") * part(11, 0.97, 1.02)).alias("ca"),
        F.when(k % 13 > 0, F.col("put") * 0.95).alias("pb"), F.when(k % 13 > 0, F.col("put") * part(7, 1.2, 1.02)).alias("pa"), (k % 9).alias("call_age"), F.when(k % 10 > 0, k % 8).alias("put_age"),
    )


@query(f"""WITH {QUOTES}, s AS (SELECT expiry, any_value(days) AS days, count(*) AS n, count(DISTINCT strike) AS n_strikes, count(*) FILTER (ca < cb OR coalesce(pa < pb, false)) AS inverted, count(*) FILTER (ca < cb OR pb IS NULL OR pa < pb) AS missing_sides, count(*) FILTER (call_age > 5) + count(*) FILTER (put_age > 5) AS stale, count(*) FILTER (put_age IS NULL) AS missing_trades,
      count(*) FILTER (ca >= cb AND (ca - cb) / ((ca + cb) / 2) > 0.1) + count(*) FILTER (pa >= pb AND (pa - pb) / ((pa + pb) / 2) > 0.1) AS wide FROM b GROUP BY 1),
    m AS (SELECT max(days) FILTER (days <= 45) AS lo, min(days) FILTER (days >= 45) AS hi FROM s)
    SELECT expiry, days, days IN (lo, hi) AS bracket, n, n_strikes, inverted, missing_sides, stale, missing_trades, wide, CASE WHEN n_strikes < 3 THEN 1 ELSE 0 END AS n_errors,
      CAST(n_strikes BETWEEN 3 AND 4 AS INT) + CAST(inverted > 0 AS INT) + CAST(missing_sides > 0 AS INT) + CAST(stale > 0 AS INT) + CAST(missing_trades > 0 AS INT) + CAST(wide > 0 AS INT) AS n_warnings FROM s, m""")
def opt_chain_quality(spark, sf):
    return val.chain_quality(quotes(spark, sf), target_days=45, max_age=5, max_spread=0.1)


@query("""WITH e AS (SELECT DISTINCT p_brand AS expiry, CAST(round((0.05 + 0.01 * CAST(substr(p_brand, 7) AS INT)) * 365) AS INT) AS days FROM part), g AS (SELECT unnest([10, 30, 45, 60, 90, 150, 400]) AS target), j AS (SELECT * FROM g, e),
    a AS (SELECT target, max(row(days, expiry)) FILTER (days <= target) AS below, min(row(days, expiry)) FILTER (days >= target) AS above, count(*) AS n, list(row(abs(days - target), days, expiry) ORDER BY abs(days - target), days, expiry) AS near FROM j GROUP BY 1),
    s AS (SELECT target, CASE WHEN below IS NOT NULL AND above IS NOT NULL THEN [below, above] ELSE list_sort([row(near[1][2], near[1][3]), row(near[least(2, n)][2], near[least(2, n)][3])]) END AS pick FROM a)
    SELECT target, pick[1][2] AS near_expiry, pick[1][1] AS near_days, pick[2][2] AS far_expiry, pick[2][1] AS far_days FROM s""")
def select_bracketing_expiry(spark, sf):
    e = options(spark, sf).select("expiry", F.round(F.col("t") * 365).cast("int").alias("days")).distinct()
    return val.bracketing(e.withColumn("target", F.explode(F.array(*map(F.lit, (10, 30, 45, 60, 90, 150, 400))))))


VINT = "v AS (SELECT series_id, asof_date, arg_max(value, revision_n) AS value FROM macro GROUP BY 1, 2)"


def vintage(spark, sf):
    return mac.latest_vintage(src.macro(spark, sf))


@query(f"WITH {VINT}, b AS (SELECT *, last_value(value) OVER (PARTITION BY series_id ORDER BY asof_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS base FROM v) SELECT series_id, asof_date, round((value / base - 1) * 100, 5) AS pct, round((base / value - 1) * 100, 5) AS inverse_pct, round(value - base, 6) AS change FROM b")
def mac_pct_change(spark, sf):
    return mac.change(vintage(spark, sf), 7).select("series_id", "asof_date", *r("pct", "inverse_pct", n=5), *r("change"))


@query(f"WITH {VINT}, b AS (SELECT *, last_value(value) OVER (PARTITION BY series_id ORDER BY asof_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 DAY PRECEDING) AS base FROM v) SELECT series_id, asof_date, round(CASE WHEN series_id IN ('click', 'view') THEN (base / value - 1) * 100 ELSE (value / base - 1) * 100 END, 5) AS metric FROM b WHERE base IS NOT NULL")
def mac_fx_commodity(spark, sf):
    c = mac.change(vintage(spark, sf), 3).where("pct IS NOT NULL")
    return c.select("series_id", "asof_date", F.round(F.when(F.col("series_id").isin("click", "view"), F.col("inverse_pct")).otherwise(F.col("pct")), 5).alias("metric"))


MONTHLY = "mo AS (SELECT symbol AS series_id, CAST(date_trunc('month', ts) AS DATE) AS month, avg(close) AS value FROM bars_d GROUP BY 1, 2)"


def monthly(spark, sf):
    return src.daily(spark, sf).groupBy(F.col("symbol").alias("series_id"), F.trunc("ts", "month").alias("month")).agg(F.avg("close").alias("value"))


@query(f"WITH {MONTHLY} SELECT series_id, month, round(CASE WHEN lag(month) OVER (PARTITION BY series_id ORDER BY month) = month - INTERVAL 1 MONTH THEN (value / lag(value) OVER (PARTITION BY series_id ORDER BY month) - 1) * 100 END, 5) AS mom_pct FROM mo")
def mac_mom(spark, sf):
    return mac.month_over_month(monthly(spark, sf)).select("series_id", "month", *r("mom_pct", n=5))


@query(f"""WITH RECURSIVE {MONTHLY}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS n FROM mo), e AS (SELECT series_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.series_id, o.n, 0.4 * o.value + 0.6 * e.e FROM e JOIN o ON o.series_id = e.series_id AND o.n = e.n + 1)
    SELECT o.series_id, o.month, round(lag(o.value) OVER w, 4) AS last, round(avg(o.value) OVER (PARTITION BY o.series_id ORDER BY o.month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS mean_n, round(e.e, 4) AS ewma, round(y.value, 4) AS year_ago
    FROM o LEFT JOIN e ON e.series_id = o.series_id AND e.n = o.n - 1 LEFT JOIN mo y ON y.series_id = o.series_id AND y.month = o.month - INTERVAL 12 MONTH WINDOW w AS (PARTITION BY o.series_id ORDER BY o.month)""")
def mac_baselines(spark, sf):
    return mac.baselines(monthly(spark, sf), "month").select("series_id", "month", *r("last", "mean_n", "ewma", "year_ago", n=4))


REG = f"{MONTHLY}, g AS (SELECT *, value / lag(value, 3) OVER w - 1 AS growth, value / lag(value, 12) OVER w - 1 AS infl, CASE WHEN value / max(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) < 0.85 THEN 2 ELSE 0 END AS stress FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month)), l AS (SELECT series_id, month, CASE WHEN stress >= 2 THEN 'crisis' WHEN growth > 0 AND infl <= 0 THEN 'expansion' WHEN growth > 0 AND infl > 0 THEN 'reflation' WHEN growth <= 0 AND infl > 0 THEN 'stagflation' ELSE 'slowdown' END AS raw FROM g WHERE infl IS NOT NULL)"


def regimes(spark, sf):
    w = Window.partitionBy("series_id").orderBy("month")
    v = F.col("value")
    m = monthly(spark, sf).withColumns({"growth": v / F.lag(v, 3).over(w) - 1, "infl": v / F.lag(v, 12).over(w) - 1, "stress": F.when(v / F.max(v).over(w.rowsBetween(-11, 0)) < 0.85, 2).otherwise(0)}).where("infl IS NOT NULL")
    return m.select("series_id", "month", mac.regime(F.col("growth"), F.col("infl"), F.col("stress")).alias("raw"))


@query(f"WITH {REG} SELECT series_id, month, raw FROM l")
def mac_regime_rules(spark, sf):
    return regimes(spark, sf)


@query(f"""WITH {REG}, s AS (SELECT *, CASE WHEN raw = 'crisis' OR raw = lag(raw) OVER w OR lag(raw) OVER w IS NULL THEN raw END AS sure FROM l WINDOW w AS (PARTITION BY series_id ORDER BY month)), q AS (SELECT series_id, month, round(1 - value / max(value) OVER w, 9) AS fall FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT series_id, month, coalesce(last_value(CASE WHEN fall >= 0.08 THEN false WHEN fall <= 0.03 THEN true END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING), true) AS invested FROM q)
    SELECT s.series_id, s.month, raw, last_value(sure IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.month ROWS UNBOUNDED PRECEDING) AS regime, invested FROM s JOIN z USING (series_id, month)""")
def w_hysteresis(spark, sf):
    """Committed regimes, and a stop that opens at a fall of 8 per cent from the peak and closes within 3 of it."""
    m = monthly(spark, sf).withColumnsRenamed({"series_id": "symbol", "month": "ts"})
    peak = F.max("value").over(f.series().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    latch = states.drawdown_latch(m.withColumn("drawdown", F.round(1 - F.col("value") / peak, 9))).select(F.col("symbol").alias("series_id"), F.col("ts").alias("month"), "invested")
    return mac.hysteresis(regimes(spark, sf), "series_id", "month", "raw", ("crisis",)).join(latch, ["series_id", "month"]).select("series_id", "month", "raw", "regime", "invested")


RATES = f"""{MONTHLY}, v AS (SELECT *, value / 1000 AS rate, lag(value) OVER w / 1000 AS before, lead(value) OVER w / 1000 AS after, lag(month) OVER w = month - INTERVAL 1 MONTH AND lead(month) OVER w = month + INTERVAL 1 MONTH AS whole FROM mo WINDOW w AS (PARTITION BY series_id ORDER BY month)),
    b AS (SELECT series_id, month AS meeting, round((after - before) * 100, 6) AS bp FROM v WHERE whole AND month(month) % 2 = 1), d AS (SELECT *, CASE WHEN abs(bp) < 12.5 THEN 'hold' WHEN bp > 0 THEN 'hike' ELSE 'cut' END AS decision, CASE WHEN abs(bp) < 12.5 THEN 0 ELSE round(bp, 1) END AS moved FROM b),
    k AS (SELECT *, sum(CASE WHEN decision = 'hold' THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY meeting ROWS UNBOUNDED PRECEDING) AS island FROM d), rd AS (SELECT series_id, meeting, decision, moved, sum(CASE WHEN decision = 'hold' THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, island ORDER BY meeting ROWS UNBOUNDED PRECEDING) AS streak FROM k)"""


def rates(spark, sf):
    return monthly(spark, sf).select("series_id", "month", (F.col("value") / 1000).alias("rate"))


@query(f"WITH {RATES} SELECT series_id, meeting, decision, moved AS bp, CAST(streak AS BIGINT) AS streak FROM rd")
def mac_rate_decision(spark, sf):
    return mac.rate_decisions(rates(spark, sf)).select("series_id", F.col("month").alias("meeting"), "decision", "bp", "streak")


@query(f"""WITH {RATES}, u AS (SELECT series_id, month, rate, round((avg(rate) OVER (PARTITION BY series_id ORDER BY month ROWS 2 PRECEDING) - rate) * 100, 9) AS spread, CASE WHEN lag(month, 12) OVER w = month - INTERVAL 12 MONTH THEN (rate / lag(rate, 12) OVER w - 1) * 100 END AS yoy FROM v WINDOW w AS (PARTITION BY series_id ORDER BY month)),
    t AS (SELECT *, greatest(-2, least(2, spread / 50)) AS market, CASE WHEN yoy IS NOT NULL THEN greatest(-3, least(3, (1 + yoy + 0.5 * (yoy - 2) - (rate - 0.125)) / 0.25)) * 0.33 END AS taylor FROM u), p AS (SELECT t.series_id, month AS meeting, (0.5 * market + coalesce(0.3 * taylor, 0)) / (0.5 + CASE WHEN taylor IS NULL THEN 0 ELSE 0.3 END) AS pressure, 1 + 0.15 * least(coalesce(streak, 0), 6) AS hold FROM t LEFT JOIN rd ON rd.series_id = t.series_id AND rd.meeting = t.month)
    SELECT series_id, meeting, round(pressure, 6) AS pressure, {', '.join(f'round(exp({x}) / (exp(-0.8 * pressure) + exp(hold) + exp(0.8 * pressure)), 4) AS {k}' for k, x in (('cut', '-0.8 * pressure'), ('hold_p', 'hold'), ('hike', '0.8 * pressure')))} FROM p""")
def mac_rate_probs(spark, sf):
    p = mac.rate_probabilities(rates(spark, sf))
    return p.select("series_id", F.col("month").alias("meeting"), *r("pressure"), *r("cut", n=4), F.round("hold", 4).alias("hold_p"), *r("hike", n=4))


@query(f"WITH {VINT}, f AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY asof_date) AS fc FROM v) SELECT series_id, count(fc) AS n, round(avg(abs(value - fc)), 6) AS mae, round(sqrt(avg((value - fc) ** 2)), 6) AS rmse, round(avg(CASE WHEN abs(value - fc) <= 2 THEN 1.0 ELSE 0 END), 6) AS coverage FROM f WHERE fc IS NOT NULL GROUP BY 1")
def mac_ledger_score(spark, sf):
    x = vintage(spark, sf).withColumn("e", F.col("value") - F.lag("value").over(mac.series())).where("e IS NOT NULL")
    return x.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.avg((F.abs("e") <= 2).cast("double")), 6).alias("coverage"))


@query("WITH g AS (SELECT c_nationkey, sum(c_acctbal) / 100000 AS net, sum(abs(c_acctbal)) / 100000 AS gross, max(abs(c_acctbal)) / sum(abs(c_acctbal)) AS top FROM customer GROUP BY 1) SELECT c_nationkey, rule, round(v, 6) AS value, lim AS limit_value FROM (SELECT c_nationkey, 'gross' AS rule, gross AS v, 2.0::DOUBLE AS lim FROM g UNION ALL SELECT c_nationkey, 'net', net, 1.5 FROM g UNION ALL SELECT c_nationkey, 'top', top, 0.04 FROM g) WHERE v > lim")
def rk_exposure_limits(spark, sf):
    b = F.col("c_acctbal")
    g = src.read(spark, sf, "customer").groupBy("c_nationkey").agg((F.sum(b) / 100000).alias("net"), (F.sum(F.abs(b)) / 100000).alias("gross"), (F.max(F.abs(b)) / F.sum(F.abs(b))).alias("top"))
    return rk.breaches(g, {"gross": ("gross", 2.0), "net": ("net", 1.5), "top": ("top", 0.04)}).select("c_nationkey", "rule", *r("value"), F.col("limit").alias("limit_value"))


EQ = f"SELECT symbol, ts, close AS equity, max(close) OVER ({S} ROWS UNBOUNDED PRECEDING) AS peak, coalesce(lag(close) OVER ({S}), close) AS day_ref FROM bars_d"


@query(f"SELECT symbol, ts, peak, day_ref FROM ({EQ})")
def rk_equity_refs(spark, sf):
    return rk.equity_refs(src.daily(spark, sf).withColumn("equity", F.col("close")), "symbol").select("symbol", "ts", "peak", "day_ref")


@query(f"SELECT symbol, ts, 1 - equity / day_ref > 0.02 OR 1 - equity / peak > 0.25 OR 0.9 > 1 AS halted FROM ({EQ})")
def rk_kill_switch(spark, sf):
    e = rk.equity_refs(src.daily(spark, sf).withColumn("equity", F.col("close")), "symbol")
    return e.select("symbol", "ts", rk.kill_switch(1 - F.col("equity") / F.col("day_ref"), 1 - F.col("equity") / F.col("peak"), F.lit(0.9)).alias("halted"))


@query("WITH x AS (SELECT p_partkey, p_retailprice AS price, 0.1 + p_size / 100.0 AS vol, (p_partkey % 7) / 100.0 AS edge FROM part), w AS (SELECT *, 0.15 / vol AS a, greatest(0, edge / (vol * vol) / 2) AS c, least(0.15 / vol, 0.5, greatest(0, edge / (vol * vol) / 2), 0.4) AS weight FROM x) SELECT p_partkey, round(weight, 6) AS weight, CASE WHEN a = weight THEN 'vol_target' WHEN 0.5 = weight THEN 'risk_cap' WHEN c = weight THEN 'half_kelly' ELSE 'hard_cap' END AS binding, CAST(floor(1000000 * weight / price) AS BIGINT) AS shares FROM w")
def rk_sizing(spark, sf):
    s = rk.size(F.lit(1_000_000), F.col("p_retailprice"), 0.1 + F.col("p_size") / 100, (F.col("p_partkey") % 7) / 100, 0.15, 0.5, 0.4)
    return src.read(spark, sf, "part").select("p_partkey", F.round(s["weight"], 6).alias("weight"), s["binding"].alias("binding"), s["shares"].alias("shares"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * least(0.01, 0.0005 + 0.001 * sqrt(l_quantity / 100)), 8) AS slip FROM lineitem")
def rk_slippage(spark, sf):
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return src.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round(rk.slippage(q, F.lit(100.0), 0.0005, 0.001, 0.01), 8).alias("slip"))


@query("WITH s AS (SELECT 'P' || (l_partkey % 40) AS symbol, l_orderkey, arg_max(row(CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END, l_quantity), row(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS s FROM lineitem GROUP BY 1, 2) SELECT symbol, sum(CASE WHEN s[1] = 'buy' THEN s[2] ELSE -s[2] END) AS net_qty FROM s GROUP BY 1")
def rk_expected_positions(spark, sf):
    o = src.read(spark, sf, "lineitem").select(F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("symbol"), "l_orderkey", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("filled_qty"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rk.net_positions(o, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS buy_notional, count(*) > 8 OR sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) > 2000000 AS over_limit FROM orders GROUP BY 1")
def rk_daily_limits(spark, sf):
    buy = F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).otherwise(0.0))
    return src.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(buy, 2).alias("buy_notional"), ((F.count("*") > 8) | (buy > 2_000_000)).alias("over_limit"))


@query("""WITH f AS (SELECT symbol, known_date, CASE month(period_end) WHEN 3 THEN 'low' WHEN 6 THEN 'medium' ELSE 'high' END AS confidence, total_debt / total_equity < 1.02 AS shortable, round(1000 * total_debt / total_equity - 300, 6) AS fee FROM fund_q),
    j AS (SELECT b.symbol, b.ts, f.known_date, f.confidence, f.shortable, f.fee FROM bars_w b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.known_date),
    c AS (SELECT *, CASE WHEN known_date IS NULL THEN '' ELSE concat_ws(',', CASE WHEN date_diff('day', known_date, ts) > 60 THEN 'age' END, CASE WHEN confidence = 'low' THEN 'confidence' END, CASE WHEN NOT shortable THEN 'not_shortable' END, CASE WHEN fee > 500 THEN 'fee' END) END AS reasons FROM j)
    SELECT symbol, ts, known_date, coalesce(confidence, 'missing') AS confidence, fee, reasons, reasons = '' AS passed FROM c""")
def rk_shortability(spark, sf):
    """Availability as of each bar; the tables have none, so leverage and the quarter stand for fee, shortable and confidence."""
    ratio, month = F.col("total_debt") / F.col("total_equity"), F.month("period_end")
    rows = src.fundamentals(spark, sf).select("symbol", "known_date", "period_end", F.when(month == 3, "low").when(month == 6, "medium").otherwise("high").alias("confidence"), (ratio < 1.02).alias("shortable"), F.round(1000 * ratio - 300, 6).alias("fee"))
    out = j.asof_backward(src.weekly(spark, sf).select("symbol", "ts"), rows, ("symbol",), "ts", "known_date", ("confidence", "shortable", "fee"), ("period_end",))
    return rk.shortability(out.select("symbol", "ts", F.col("fact.known").alias("known_date"), "fact.confidence", "fact.shortable", "fact.fee"), max_age=60)


@query("SELECT series_id, max(asof_date) AS last_date, arg_max(revision_n, row(asof_date, revision_n)) AS last_revision, date_diff('day', max(asof_date), (SELECT max(asof_date) FROM macro)) > 2 AS stale FROM macro GROUP BY 1")
def dq_macro_fresh(spark, sf):
    m = src.macro(spark, sf)
    newest = m.agg(F.max("asof_date").alias("newest"))
    g = m.groupBy("series_id").agg(F.max("asof_date").alias("last_date"), F.max_by("revision_n", F.struct("asof_date", "revision_n")).alias("last_revision"))
    return g.crossJoin(F.broadcast(newest)).select("series_id", "last_date", "last_revision", (F.datediff("newest", "last_date") > 2).alias("stale"))


@query("WITH req AS (SELECT 'Brand#' || i AS symbol FROM range(1, 31) t(i)), g AS (SELECT symbol, max(ts) AS last_ts FROM bars_w GROUP BY 1) SELECT symbol, last_ts, CASE WHEN last_ts IS NULL THEN 'missing' WHEN date_diff('day', last_ts, (SELECT max(ts) FROM bars_w)) > 7 THEN 'stale' ELSE 'ok' END AS status FROM req LEFT JOIN g USING (symbol)")
def dq_price_fresh(spark, sf):
    req = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("symbol"))
    g = src.weekly(spark, sf).groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    x = req.join(g, "symbol", "left").crossJoin(F.broadcast(g.agg(F.max("last_ts").alias("newest"))))
    return x.select("symbol", "last_ts", F.when(F.col("last_ts").isNull(), "missing").when(F.datediff("newest", "last_ts") > 7, "stale").otherwise("ok").alias("status"))


@query("SELECT symbol, count(*) AS n, count(*) FILTER (value_kind <> 'reported_value') AS n_estimates, count(*) FILTER (confidence <> 'high') AS n_low, max(ts) AS last_ts FROM flows GROUP BY 1")
def dq_flow_trust(spark, sf):
    return src.flows(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("value_kind") != "reported_value", 1)).alias("n_estimates"), F.count(F.when(F.col("confidence") != "high", 1)).alias("n_low"), F.max("ts").alias("last_ts"))


@query("WITH u AS (SELECT 'price' AS area, symbol AS key, 'error' AS severity FROM bars_d WHERE high < low UNION ALL SELECT 'flow', CAST(event_id AS VARCHAR), 'warning' FROM flows WHERE value_kind <> 'reported_value' UNION ALL SELECT 'fundamental', symbol, 'info' FROM fund_q WHERE total_debt > total_equity) SELECT area, key, severity, count(*) AS n FROM u GROUP BY 1, 2, 3")
def dq_evaluate(spark, sf):
    issue = lambda df, cond, area, key, sev: df.where(cond).select(F.lit(area).alias("area"), F.col(key).cast("string").alias("key"), F.lit(sev).alias("severity"))
    u = issue(src.daily(spark, sf), "high < low", "price", "symbol", "error").unionByName(issue(src.flows(spark, sf), "value_kind <> 'reported_value'", "flow", "event_id", "warning"))
    return u.unionByName(issue(src.fundamentals(spark, sf), "total_debt > total_equity", "fundamental", "symbol", "info")).groupBy("area", "key", "severity").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars_w GROUP BY 1) SELECT m.symbol, date_diff('day', start_date, lo) > 7 AS late_start, CASE WHEN end_date IS NOT NULL THEN date_diff('day', hi, end_date) > 7 ELSE false END AS early_end FROM members m JOIN g USING (symbol)")
def dq_universe_audit(spark, sf):
    g = src.weekly(spark, sf).groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return src.members(spark, sf).join(g, "symbol").select("symbol", (F.datediff("lo", "start_date") > 7).alias("late_start"), F.coalesce(F.datediff("end_date", "hi") > 7, F.lit(False)).alias("early_end"))


@query("SELECT user_id, event_type, CAST(greatest(-2, least(2, sum(CASE WHEN value > 75 THEN 1 WHEN value < 25 THEN -1 ELSE 0 END))) AS DOUBLE) AS adjust FROM events GROUP BY 1, 2")
def nw_signal_adjust(spark, sf):
    v = F.when(F.col("value") > 75, 1).when(F.col("value") < 25, -1).otherwise(0)
    return src.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.greatest(F.lit(-2), F.least(F.lit(2), F.sum(v))).cast("double").alias("adjust"))


#: Own needles for the given texts, beside the fixed ones.
TEXTS = (*sc.SIGNALS, ("license_positive", ("license",)), ("tone_negative", ("worthless", "pathetic")))


@query(f"""WITH e AS (SELECT 'Brand#' || (doc_id % 25 + 1) AS symbol, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(lower(text), '{n}')" for n in ns) + f" THEN '{k.rsplit('_', 1)[1]}'" for k, ns in TEXTS)} END AS direction FROM documents), g AS (SELECT symbol, count(*) FILTER (direction = 'positive') AS up, count(*) FILTER (direction = 'negative') AS down FROM e GROUP BY 1),
    c AS (SELECT symbol, ts, round((close / lag(close) OVER ({S}) - 1) * 100, 6) AS change FROM bars_w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
    SELECT symbol, ts, change, coalesce(up, 0) AS n_positive, coalesce(down, 0) AS n_negative, CASE WHEN change >= 2 THEN 1 WHEN change <= -2 THEN -1 ELSE 0 END + 3 * coalesce(up, 0) - 3 * coalesce(down, 0) AS score FROM c LEFT JOIN g USING (symbol)""")
def nw_event_screen(spark, sf):
    d = src.read(spark, sf, "documents").select(F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"), sc.direction(sc.headline_signal(F.col("text"), TEXTS)).alias("direction"))
    g = d.groupBy("symbol").agg(*(F.count(F.when(F.col("direction") == k, 1)).alias(f"n_{k}") for k in ("positive", "negative")))
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    b = src.weekly(spark, sf).select("symbol", "ts", F.round((F.col("close") / f.lag("close") - 1) * 100, 6).alias("change"), F.row_number().over(last).alias("n")).where("n = 1").drop("n")
    up, down = (F.coalesce(f"n_{k}", F.lit(0)) for k in ("positive", "negative"))
    return b.join(g, "symbol", "left").select("symbol", "ts", "change", up.alias("n_positive"), down.alias("n_negative"), (F.when(F.col("change") >= 2, 1).when(F.col("change") <= -2, -1).otherwise(0) + 3 * up - 3 * down).alias("score"))


@query("WITH u AS (SELECT event_type AS provider, event_id AS id, CAST(ts AS TIMESTAMP) AS seen_at FROM events UNION ALL SELECT 'orders', o_orderkey, CAST(o_orderdate AS TIMESTAMP) FROM orders) SELECT provider, id, seen_at FROM u ORDER BY seen_at DESC, provider, id LIMIT 200")
def nw_fast_news(spark, sf):
    e = src.read(spark, sf, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("seen_at"))
    o = src.read(spark, sf, "orders").select(F.lit("orders").alias("provider"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("seen_at"))
    return e.unionByName(o).orderBy(F.desc("seen_at"), "provider", "id").limit(200)


@query("WITH u AS (SELECT symbol, known_date AS day, 'filing' AS kind FROM fund_q UNION ALL SELECT symbol, start_date, 'membership' FROM members) SELECT symbol, day, kind, CASE WHEN kind = 'membership' THEN 'high' ELSE 'normal' END AS importance FROM u WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def nw_calendar(spark, sf):
    u = src.fundamentals(spark, sf).select("symbol", F.col("known_date").alias("day"), F.lit("filing").alias("kind")).unionByName(src.members(spark, sf).select("symbol", F.col("start_date").alias("day"), F.lit("membership").alias("kind")))
    return u.where("day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'").withColumn("importance", F.when(F.col("kind") == "membership", "high").otherwise("normal"))
