"""Queries of the scalar functions and of the aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import scalars as s
from tapeloom.operators import aggregates as a
from tapeloom.operators import features as f
from tapeloom.plans.registry import query
from tapeloom.plans.windows import S, r, rows
from tapeloom.sources import adapters as src

RETS = f"SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_d"


def rets(spark, sf):
    return f.returns(src.daily(spark, sf)).select("symbol", "ts", "close", "ret")


@query("SELECT c_custkey, upper(trim(c_mktsegment)) AS symbol FROM customer")
def str_symbol_norm(spark, sf):
    return src.read(spark, sf, "customer").select("c_custkey", s.symbol_norm(F.col("c_mktsegment")).alias("symbol"))


def _signal(col: str, signals) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in signals) + " END"


WORDS = (("risk", ("worthless", "pathetic")), ("license", ("license", "cc by")), ("secret", ("token",)))


#: The table has no filings: every second text counts as one, with a form by its id.
FORMS = ("8-K", "10-Q", "4", "S-1", "13F", "DEF 14A")
FORM = f"CASE WHEN doc_id % 2 = 0 AND list_extract([{', '.join(f"'{x}'" for x in FORMS)}], CAST(doc_id % 6 + 1 AS INT)) IN ({', '.join(f"'{x}'" for x in s.WATCH_FORMS)}) THEN 'filing_watch' END"


@query(f"WITH h AS (SELECT doc_id, {_signal('text', WORDS)} AS signal, coalesce({_signal('text', s.SIGNALS)}, {FORM}) AS headline FROM documents) SELECT doc_id, signal, headline, string_split(headline, '_')[2] AS direction, CASE WHEN string_split(headline, '_')[1] IN ('guidance', 'contract') THEN 'high' WHEN headline IS NOT NULL THEN 'medium' END AS confidence FROM h")
def str_keyword_signal(spark, sf):
    text = F.col("text")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("doc_id") % 6 + 1).cast("int"))
    x = src.read(spark, sf, "documents").select("doc_id", s.headline_signal(text, WORDS).alias("signal"), s.classified(text, F.when(F.col("doc_id") % 2 == 0, "sec"), form).alias("headline"))
    return x.select("doc_id", "signal", "headline", s.direction(F.col("headline")).alias("direction"), s.impact(F.col("headline")).alias("confidence"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS plain, floor(o_totalprice / 1000) * 1000 AS thousands, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100) / 100.0 END AS share FROM orders""")
def str_parse_numbers(spark, sf):
    o = src.read(spark, sf, "orders")
    o = o.withColumns({"cell": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), "short": F.concat(F.lit("$"), F.format_number(F.floor(F.col("o_totalprice") / 1000), 0), F.lit("K")), "pct": F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("up "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" %"))).otherwise("N/A")})
    return o.select("o_orderkey", s.money(F.col("cell")).alias("plain"), s.money(F.col("short")).alias("thousands"), s.percent(F.col("pct")).alias("share"))


@query("SELECT DISTINCT event_type, min(ts) OVER (PARTITION BY event_type) AS first_ts FROM events")
def str_dedupe(spark, sf):
    return src.read(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST(CAST(o_orderdate AS DATE) - INTERVAL 7 MONTH AS DATE) AS minus_seven, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders")
def date_month_math(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return src.read(spark, sf, "orders").select("o_orderkey", s.add_months_clamped(d, 1).alias("plus_month"), s.add_months_clamped(d, -7).alias("minus_seven"), s.first_of_month(d).alias("month_start"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 YEAR AS DATE) AS plus_years, CAST(CAST(o_orderdate AS DATE) - to_days(CAST(126 * 365 // 252 + 45 AS INT)) AS DATE) AS warm_from FROM orders")
def date_year_math(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return src.read(spark, sf, "orders").select("o_orderkey", s.add_years_clamped(d, 3).alias("plus_years"), F.date_sub(d, 126 * 365 // 252 + 45).alias("warm_from"))


@query("""SELECT o_orderkey, CASE WHEN e > b THEN (SELECT count(*) FROM (SELECT unnest(generate_series(b + 1, e, INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5) ELSE 0 END AS n_days
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(CAST(o_orderdate AS DATE) + to_days(CAST(o_orderkey % 40 AS INT)) AS DATE) AS e FROM orders)""")
def date_business_days(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return src.read(spark, sf, "orders").select("o_orderkey", s.business_days(d, F.date_add(d, (F.col("o_orderkey") % 40).cast("int"))).alias("n_days"))


@query("SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL 9 HOUR AS ts_utc FROM events")
def ts_naive_utc(spark, sf):
    e = src.read(spark, sf, "events")
    return e.select("event_id", F.convert_timezone(F.lit("Asia/Seoul"), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")).alias("ts_utc"))


@query("SELECT p_partkey, round(greatest(0, least(100, (p_retailprice - 1000) / 800 * 100)), 6) AS linear, round(greatest(0, least(100, (ln(p_retailprice) - ln(900)) / (ln(2000) - ln(900)) * 100)), 6) AS logarithmic FROM part")
def math_clamp_range_score(spark, sf):
    p = F.col("p_retailprice")
    return src.read(spark, sf, "part").select("p_partkey", F.round(s.range_score(p, 1000, 1800), 6).alias("linear"), F.round(s.range_score(p, 900, 2000, log=True), 6).alias("logarithmic"))


@query("""SELECT p_partkey, CASE WHEN k BETWEEN 100 AND 999 THEN 'agriculture' WHEN k BETWEEN 1000 AND 1499 THEN 'mining' WHEN k BETWEEN 1500 AND 1799 THEN 'construction' WHEN k BETWEEN 2000 AND 3999 THEN 'manufacturing' WHEN k BETWEEN 4000 AND 4999 THEN 'transport_utilities'
    WHEN k BETWEEN 5000 AND 5199 THEN 'wholesale' WHEN k BETWEEN 5200 AND 5999 THEN 'retail' WHEN k BETWEEN 6000 AND 6799 THEN 'finance' WHEN k BETWEEN 7000 AND 8999 THEN 'services' ELSE 'other' END AS sector FROM (SELECT p_partkey, (p_partkey * 37) % 10000 AS k FROM part)""")
def map_sic_sector(spark, sf):
    return src.read(spark, sf, "part").select("p_partkey", s.sector_of((F.col("p_partkey") * 37) % 10000).alias("sector"))


@query("SELECT p_partkey, CASE WHEN g >= 0.5 THEN 3 WHEN g >= 0.25 THEN 2 WHEN g >= 0.10 THEN 1 WHEN g <= -0.5 THEN -3 WHEN g <= -0.25 THEN -2 WHEN g <= -0.10 THEN -1 ELSE 0 END AS rating FROM (SELECT p_partkey, (1000.0 + p_size * 20 - p_retailprice) / p_retailprice AS g FROM part)")
def math_rating_ladder(spark, sf):
    return src.read(spark, sf, "part").select("p_partkey", s.rating(F.lit(1000.0) + F.col("p_size") * 20, F.col("p_retailprice")).alias("rating"))


RVOL = f"SELECT *, volume / CASE WHEN count(volume) OVER {rows(20)} = 20 THEN avg(volume) OVER {rows(20)} END AS rvol FROM bars_d"


@query(f"""WITH x AS ({RVOL}) SELECT symbol, ts, CASE WHEN rvol IS NULL THEN NULL WHEN rvol < 0.5 THEN 'low' WHEN rvol < 1.5 THEN 'normal' WHEN rvol < 3 THEN 'high' WHEN rvol < 4 THEN 'very_high' ELSE 'extreme' END AS rvol_label,
    CASE WHEN high <= low THEN 'mid' WHEN (close - low) / (high - low) >= 0.7 THEN 'high' WHEN (close - low) / (high - low) <= 0.3 THEN 'low' ELSE 'mid' END AS close_at FROM x""")
def classify_rvol(spark, sf):
    b = f.rvol(src.daily(spark, sf))
    return b.select("symbol", "ts", s.rvol_label(F.col("rvol")).alias("rvol_label"), s.close_location(F.col("high"), F.col("low"), F.col("close")).alias("close_at"))


@query("SELECT symbol, ts, CASE WHEN x <= -0.0005 THEN 'heavy_short' WHEN x <= -0.0001 THEN 'short' WHEN x <= 0.0001 THEN 'neutral' WHEN x <= 0.0005 THEN 'long' ELSE 'heavy_long' END AS state FROM (SELECT symbol, ts, (close - open) / 100000 AS x FROM bars_h)")
def classify_funding(spark, sf):
    return src.intraday(spark, sf).select("symbol", "ts", s.funding_label((F.col("close") - F.col("open")) / 100000).alias("state"))


@query(f"WITH x AS (SELECT symbol, ts, close - lag(close) OVER ({S}) AS p, volume - lag(volume) OVER ({S}) AS o FROM bars_h) SELECT symbol, ts, CASE WHEN p > 0 AND o > 0 THEN 'new_longs' WHEN p < 0 AND o > 0 THEN 'new_shorts' WHEN p > 0 AND o < 0 THEN 'short_covering' WHEN p < 0 AND o < 0 THEN 'long_liquidation' ELSE 'neutral' END AS quadrant FROM x")
def classify_oi_quadrant(spark, sf):
    b = src.intraday(spark, sf).withColumns({"p": F.col("close") - f.lag("close"), "o": F.col("volume") - f.lag("volume")})
    return b.select("symbol", "ts", s.oi_quadrant(F.col("p"), F.col("o")).alias("quadrant"))


@query("SELECT event_id, CASE WHEN x >= 0.6 THEN 'strong_bid' WHEN x >= 0.2 THEN 'bid' WHEN x <= -0.6 THEN 'strong_ask' WHEN x <= -0.2 THEN 'ask' ELSE 'balanced' END AS regime FROM (SELECT event_id, (event_id % 21 - 10) / 10.0 AS x FROM events)")
def classify_obi_regime(spark, sf):
    return src.read(spark, sf, "events").select("event_id", s.obi_regime((F.col("event_id") % 21 - 10) / 10).alias("regime"))


@query("SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'AVOID' WHEN value >= 70 THEN 'ENTER_NOW' WHEN value >= 50 THEN 'SCALE_IN' WHEN value >= 35 THEN 'WAIT' ELSE 'AVOID' END AS state FROM events")
def entry_state(spark, sf):
    return src.read(spark, sf, "events").select("event_id", s.entry_state(F.col("value"), F.col("user_id") % 9 == 0).alias("state"))


@query("SELECT symbol, ts, bids[1].price AS best_bid, asks[1].price AS best_ask, len(bids) AS n_bids FROM book")
def array_levels(spark, sf):
    return src.book(spark, sf).select("symbol", "ts", F.col("bids")[0]["price"].alias("best_bid"), F.col("asks")[0]["price"].alias("best_ask"), F.size("bids").cast("long").alias("n_bids"))


@query("SELECT p_partkey, '[{\"pct\":30,\"price\":' || p_size || '},{\"pct\":40,\"price\":' || (p_size + 1) || '},{\"pct\":30,\"price\":' || (p_size + 2) || '}]' AS ladder_json FROM part")
def json_ladder(spark, sf):
    step = lambda pct, plus: F.struct(F.lit(pct).alias("pct"), (F.col("p_size") + plus).alias("price"))
    return src.read(spark, sf, "part").select("p_partkey", F.to_json(F.array(step(30, 0), step(40, 1), step(30, 2))).alias("ladder_json"))


RANGE = f"SELECT symbol, ts, close, min(low) OVER {rows(50)} AS lo, max(high) OVER {rows(50)} AS hi FROM bars_d"


def _range(spark, sf):
    return src.daily(spark, sf).withColumns({"lo": f.over(F.min("low"), 50), "hi": f.over(F.max("high"), 50)})


@query(f"SELECT symbol, ts, CASE WHEN hi - lo <= 0 THEN 'undefined' WHEN close > (lo + hi) / 2 + 0.02 * (hi - lo) THEN 'premium' WHEN close < (lo + hi) / 2 - 0.02 * (hi - lo) THEN 'discount' ELSE 'equilibrium' END AS zone FROM ({RANGE})")
def premium_discount(spark, sf):
    return _range(spark, sf).select("symbol", "ts", s.dealing_zone(F.col("close"), F.col("lo"), F.col("hi")).alias("zone"))


@query(f"SELECT symbol, ts, hi - 0.79 * (hi - lo) AS long_low, hi - 0.62 * (hi - lo) AS long_high, lo + 0.705 * (hi - lo) AS short_mid, close BETWEEN hi - 0.79 * (hi - lo) AND hi - 0.62 * (hi - lo) AS in_long FROM ({RANGE})")
def ote_zone(spark, sf):
    x = _range(spark, sf)
    span = F.col("hi") - F.col("lo")
    lo, hi = F.col("hi") - 0.79 * span, F.col("hi") - 0.62 * span
    return x.select("symbol", "ts", lo.alias("long_low"), hi.alias("long_high"), (F.col("lo") + 0.705 * span).alias("short_mid"), F.col("close").between(lo, hi).alias("in_long"))


@query("""WITH x AS (SELECT *, (row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) - 1) // 4 AS k FROM bars_h)
    SELECT symbol, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM x GROUP BY symbol, CAST(ts AS DATE), k""")
def agg_ohlcv_bucket(spark, sf):
    return a.rebucket(src.intraday(spark, sf), 4, F.col("ts").cast("date"))


@query("SELECT series_id, year(asof_date) AS year, month(asof_date) AS month, round(avg(value), 6) AS mean FROM macro_d GROUP BY 1, 2, 3")
def agg_monthly_mean(spark, sf):
    return src.macro(spark, sf).where("revision_n = 0").groupBy("series_id", F.year("asof_date").alias("year"), F.month("asof_date").alias("month")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT symbol, year(b.ts) AS year, round(arg_max(close, b.ts) / arg_min(close, b.ts) - 1, 6) AS ret, round(arg_max(bench, b.ts) / arg_min(bench, b.ts) - 1, 6) AS bench_ret FROM bars_d b JOIN bench_d USING (ts) GROUP BY 1, 2")
def agg_annual_returns(spark, sf):
    x = src.daily(spark, sf).join(src.benchmark(spark, sf, "day"), "ts")
    return a.annual_returns(x, "close").join(a.annual_returns(x, "bench").withColumnRenamed("ret", "bench_ret"), ["symbol", "year"]).select("symbol", "year", *r("ret", "bench_ret"))


@query(f"WITH x AS ({RETS}), m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM x WHERE ret IS NOT NULL) SELECT symbol, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 5) AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2, 5) AS kurt FROM m GROUP BY 1")
def agg_moments(spark, sf):
    return rets(spark, sf).groupBy("symbol").agg(*a.moments("ret")).select("symbol", *r("skew", "kurt", n=5))


@query(f"WITH x AS ({RETS}) SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe_sample, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe_pop FROM x GROUP BY 1")
def agg_sharpe(spark, sf):
    return rets(spark, sf).groupBy("symbol").agg(F.round(a.sharpe("ret", 252), 6).alias("sharpe_sample"), F.round(a.sharpe("ret", 252, False), 6).alias("sharpe_pop"))


@query(f"SELECT symbol, round(max(d), 6) AS max_drawdown FROM (SELECT symbol, 1 - close / max(close) OVER ({S} ROWS UNBOUNDED PRECEDING) AS d FROM bars_d) GROUP BY 1")
def agg_max_drawdown(spark, sf):
    return a.drawdowns(src.daily(spark, sf), "close").groupBy("symbol").agg(F.round(F.max("drawdown"), 6).alias("max_drawdown"))


BETA = f"SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS y, bench / lag(bench) OVER ({S}) - 1 AS x FROM bars_w JOIN bench_w USING (ts)"


def _beta_rows(spark, sf):
    j = src.weekly(spark, sf).join(src.benchmark(spark, sf), "ts")
    return j.select("symbol", "ts", (F.col("close") / f.lag("close") - 1).alias("y"), (F.col("bench") / f.lag("bench") - 1).alias("x"))


@query(f"WITH b AS ({BETA}), t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM b WHERE y IS NOT NULL) SELECT symbol, round(covar_samp(y, x) / var_samp(x), 6) AS beta, round(corr(y, x), 6) AS corr FROM t WHERE n <= 126 GROUP BY 1 HAVING count(*) >= 30")
def agg_beta_corr(spark, sf):
    return a.beta(_beta_rows(spark, sf), "y", "x", "symbol").select("symbol", *r("beta", "corr"))


@query(f"WITH b AS ({BETA}) SELECT symbol, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(sqrt(var_pop(y) * (1 - corr(y, x) ** 2)), 6) AS resid_sd FROM b WHERE y IS NOT NULL GROUP BY 1")
def agg_ols(spark, sf):
    return _beta_rows(spark, sf).where("y IS NOT NULL").groupBy("symbol").agg(*a.ols("y", "x")).select("symbol", *r("slope", "intercept", "r2", "resid_sd"))


@query("SELECT user_id, round(greatest(0, least(100, sum((event_id % 4) * (value / 100)) / nullif(sum(event_id % 4), 0) * 100)), 6) AS score FROM events GROUP BY 1 HAVING sum(event_id % 4) > 0 UNION ALL SELECT user_id, 0 FROM events GROUP BY 1 HAVING sum(event_id % 4) = 0")
def agg_weighted_score(spark, sf):
    return src.read(spark, sf, "events").groupBy("user_id").agg(F.round(a.weighted_score(F.col("value") / 100, (F.col("event_id") % 4).cast("double")), 6).alias("score"))


@query("""WITH x AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'ACT' WHEN event_id % 3 = 1 THEN 'WAIT' ELSE 'AVOID' END AS decision, value - 50 AS fwd FROM events), g AS (SELECT decision, count(*) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM x GROUP BY 1)
    SELECT *, round((SELECT avg(fwd) FROM x WHERE decision = 'ACT') - (SELECT avg(fwd) FROM x WHERE decision = 'AVOID'), 6) AS spread FROM g""")
def agg_bucket_stats(spark, sf):
    k = F.col("event_id") % 3
    x = src.read(spark, sf, "events").select(F.when(k == 0, "ACT").when(k == 1, "WAIT").otherwise("AVOID").alias("decision"), (F.col("value") - 50).alias("fwd"))
    g = x.groupBy("decision").agg(F.count("*").alias("n"), F.avg("fwd").alias("m"), F.round(F.expr("percentile(fwd, 0.5)"), 6).alias("median"), F.round(F.avg((F.col("fwd") > 0).cast("double")), 6).alias("hit_rate"))
    all_ = Window.partitionBy()
    pick = lambda d: F.max(F.when(F.col("decision") == d, F.col("m"))).over(all_)
    return g.withColumn("spread", F.round(pick("ACT") - pick("AVOID"), 6)).withColumn("mean", F.round("m", 6)).drop("m")


@query("WITH p AS (SELECT p_brand, median(p_retailprice) AS m FROM part WHERE p_retailprice > 0 GROUP BY 1) SELECT p_brand, round(m * 1.5, 6) AS peer_value FROM p")
def agg_peer_median(spark, sf):
    return src.read(spark, sf, "part").where("p_retailprice > 0").groupBy("p_brand").agg(F.round(F.expr("percentile(p_retailprice, 0.5)") * 1.5, 6).alias("peer_value"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def agg_percentile_linear(spark, sf):
    return a.percentiles(src.read(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", {"p10": 0.1, "p90": 0.9}).select("l_returnflag", *r("p10", "p90"))


@query("""WITH g AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (value > 50) AS DOUBLE) AS w FROM events GROUP BY 1), p AS (SELECT *, w / n AS p, 1.96 * 1.96 AS z2 FROM g)
    SELECT user_id, round(greatest(0, ((p + z2 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, ((p + z2 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM p""")
def agg_wilson(spark, sf):
    g = src.read(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("value") > 50, 1)).cast("double").alias("w"))
    low, high = a.wilson(F.col("w"), F.col("n"))
    return g.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH p AS (SELECT c_nationkey, c_custkey, c_mktsegment AS sector, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END / 1e6 AS w FROM customer), s AS (SELECT c_nationkey, sector, sum(abs(w)) AS w FROM p GROUP BY 1, 2), t AS (SELECT c_nationkey, arg_max(sector, (w, sector)) AS top_sector, max(w) AS sector_weight FROM s GROUP BY 1)
    SELECT c_nationkey, round(sum(abs(w)), 6) AS gross, round(sum(w), 6) AS net, round(sum(greatest(w, 0)), 6) AS long, round(sum(least(w, 0)), 6) AS short, arg_max(c_custkey, (abs(w), -c_custkey)) AS top_name, round(max(abs(w)), 6) AS top_weight, any_value(top_sector) AS top_sector, round(any_value(sector_weight), 6) AS sector_weight FROM p JOIN t USING (c_nationkey) GROUP BY 1""")
def agg_exposure(spark, sf):
    v = F.when(F.col("c_custkey") % 3 == 0, -F.col("c_acctbal")).otherwise(F.col("c_acctbal"))
    c, size = src.read(spark, sf, "customer"), F.abs(v) / 1e6
    g = c.groupBy("c_nationkey").agg(*a.exposure(v, F.lit(1e6)), F.max_by("c_custkey", F.struct(size, -F.col("c_custkey"))).alias("top_name"), F.max(size).alias("top_weight"))
    s = c.groupBy("c_nationkey", F.col("c_mktsegment").alias("sector")).agg(F.sum(size).alias("w")).groupBy("c_nationkey").agg(F.max_by("sector", F.struct("w", "sector")).alias("top_sector"), F.max("w").alias("sector_weight"))
    return g.join(s, "c_nationkey").select("c_nationkey", *r("gross", "net", "long", "short"), "top_name", *r("top_weight"), "top_sector", *r("sector_weight"))


@query(f"WITH x AS (SELECT symbol, ts, close, " + ", ".join(f"round((close / coalesce(lag(close, {k}) OVER ({S}), first_value(close) OVER ({S})) - 1) * 100, 6) AS ret_{k}" for k in (21, 63, 126)) + " FROM bars_d) SELECT symbol, ret_21, ret_63, ret_126 FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def agg_return_profile(spark, sf):
    return a.return_profile(src.daily(spark, sf)).select("symbol", *r("ret_21", "ret_63", "ret_126"))


@query("SELECT count(*) FILTER (end_date IS NOT NULL) AS n_ended, count(*) FILTER (end_date IS NOT NULL AND substr(symbol, 7) > '2') AS n_without_exit FROM members")
def agg_universe_breadth(spark, sf):
    from tapeloom.plans.tables import delistings

    m = src.members(spark, sf).where("end_date IS NOT NULL")
    d = delistings(spark, sf).where("substr(symbol, 7) <= '2'").select("symbol", F.col("ts").alias("exit_ts"))
    without = m.join(d, (m["symbol"] == d["symbol"]) & (d["exit_ts"] > m["end_date"]), "left").select(d["exit_ts"])
    return without.agg(F.count("*").alias("n_ended"), F.count(F.when(F.col("exit_ts").isNull(), 1)).alias("n_without_exit"))
