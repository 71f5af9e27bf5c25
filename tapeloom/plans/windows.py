"""Queries of the window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import features as f
from tapeloom.plans.registry import query
from tapeloom.sources import adapters as src

#: Named windows of the oracles: a series, and its last n rows.
S = "PARTITION BY symbol ORDER BY ts"


def rows(n: int, end: int = 0) -> str:
    return f"({S} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def r(*names: str, n: int = 6):
    """Columns rounded for comparison."""
    return [F.round(c, n).alias(c) for c in names]


@query(f"SELECT symbol, ts, round(close / lag(close) OVER ({S}) - 1, 6) AS ret, round(CASE WHEN close > 0 AND lag(close) OVER ({S}) > 0 THEN ln(close / lag(close) OVER ({S})) END, 6) AS log_ret FROM bars_d")
def w_return(spark, sf):
    return f.returns(src.daily(spark, sf)).select("symbol", "ts", *r("ret", "log_ret"))


@query(f"SELECT symbol, ts, round(close / lag(close, 20) OVER ({S}) - 1, 6) AS mom, round(lag(close, 21) OVER ({S}) / lag(close, 126) OVER ({S}) - 1, 6) AS mom_skip FROM bars_d")
def w_momentum_k(spark, sf):
    return f.momentum(f.momentum(src.daily(spark, sf), 20), 126, 21, "mom_skip").select("symbol", "ts", *r("mom", "mom_skip"))


@query(f"SELECT symbol, ts, CASE WHEN close / lag(close, 20) OVER ({S}) - 1 > 0.01 THEN 1 ELSE 0 END AS signal FROM bars_d")
def w_ts_momentum_signal(spark, sf):
    return f.ts_momentum_signal(src.daily(spark, sf), 20, 0.01).select("symbol", "ts", "signal")


@query(f"""WITH x AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r FROM bars_d) SELECT symbol, ts,
    round(CASE WHEN count(r) OVER {rows(20)} = 20 THEN stddev_pop(r) OVER {rows(20)} * sqrt(252) END, 6) AS vol_pop, round(CASE WHEN count(r) OVER {rows(20)} = 20 THEN stddev_samp(r) OVER {rows(20)} * sqrt(252) END, 6) AS vol_sample FROM x""")
def w_realized_vol(spark, sf):
    return f.realized_vol(src.daily(spark, sf)).select("symbol", "ts", *r("vol_pop", "vol_sample"))


@query("WITH x AS (SELECT symbol, ts, " + ", ".join(f"coalesce(close >= CASE WHEN count(close) OVER {rows(n)} = {n} THEN avg(close) OVER {rows(n)} END, true) AS above_{n}" for n in (10, 20, 40)) + " FROM bars_d) SELECT *, (above_10::INT + above_20::INT + above_40::INT) / 3.0 >= 0.5 AS above_vote FROM x")
def w_sma_filter(spark, sf):
    return f.sma_filter(src.daily(spark, sf)).select("symbol", "ts", "above_10", "above_20", "above_40", "above_vote")


TR = f"SELECT *, CASE WHEN lag(close) OVER ({S}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S}))) END AS tr FROM bars_d"


@query(f"WITH x AS ({TR}) SELECT symbol, ts, round(CASE WHEN count(tr) OVER {rows(14)} = 14 THEN avg(tr) OVER {rows(14)} END, 6) AS atr, round(avg(tr) OVER {rows(14)}, 6) AS atr_prefix FROM x")
def w_atr_simple(spark, sf):
    return f.atr(src.daily(spark, sf)).select("symbol", "ts", *r("atr", "atr_prefix"))


@query(f"SELECT symbol, ts, round(avg(abs(close - open)) OVER {rows(10)}, 6) AS avg_body, round(avg(abs(close - open)) OVER {rows(10, 1)}, 6) AS avg_body_prior FROM bars_d")
def w_avg_body(spark, sf):
    return f.avg_body(src.daily(spark, sf)).select("symbol", "ts", *r("avg_body", "avg_body_prior"))


@query(f"SELECT symbol, ts, round(CASE WHEN count(volume) OVER {rows(20)} = 20 AND avg(volume) OVER {rows(20)} > 0 THEN volume / avg(volume) OVER {rows(20)} END, 6) AS rvol FROM bars_d")
def w_rvol(spark, sf):
    return f.rvol(src.daily(spark, sf)).select("symbol", "ts", *r("rvol"))


@query(f"""WITH x AS (SELECT *, lag(close) OVER ({S}) AS b FROM bars_d) SELECT symbol, ts, round(sum(CASE WHEN b IS NULL OR close > b THEN volume WHEN close < b THEN -volume ELSE 0 END) OVER ({S} ROWS UNBOUNDED PRECEDING), 6) AS obv FROM x""")
def w_obv(spark, sf):
    return f.obv(src.daily(spark, sf)).select("symbol", "ts", *r("obv"))


MFV = "SELECT *, volume * CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END AS mfv FROM bars_d"


@query(f"WITH x AS ({MFV}) SELECT symbol, ts, round(sum(mfv) OVER ({S} ROWS UNBOUNDED PRECEDING), 5) AS adl FROM x")
def w_adl(spark, sf):
    return f.money_flow(src.daily(spark, sf)).select("symbol", "ts", *r("adl", n=5))


@query(f"WITH x AS ({MFV}) SELECT symbol, ts, round(CASE WHEN count(volume) OVER {rows(20)} = 20 AND sum(volume) OVER {rows(20)} > 0 THEN sum(mfv) OVER {rows(20)} / sum(volume) OVER {rows(20)} END, 6) AS cmf FROM x")
def w_cmf(spark, sf):
    return f.money_flow(src.daily(spark, sf)).select("symbol", "ts", *r("cmf"))


@query(f"SELECT symbol, ts, round(CASE WHEN max(high) OVER {rows(50)} > min(low) OVER {rows(50)} THEN (close - min(low) OVER {rows(50)}) / (max(high) OVER {rows(50)} - min(low) OVER {rows(50)}) ELSE 0.5 END, 6) AS range_position FROM bars_d")
def w_range_position(spark, sf):
    return f.range_position(src.daily(spark, sf)).select("symbol", "ts", *r("range_position"))


TREND = f"""x AS (SELECT *, sign(high - lag(high) OVER ({S})) + sign(low - lag(low) OVER ({S})) AS step FROM bars_d), y AS (SELECT *, CASE WHEN count(step) OVER {rows(4, 1)} = 4 THEN sum(step) OVER {rows(4, 1)} ELSE 0 END AS trend_score FROM x),
    t AS (SELECT *, CASE WHEN trend_score >= 2 THEN 'up' WHEN trend_score <= -2 THEN 'down' ELSE 'neutral' END AS trend FROM y)"""


@query(f"WITH {TREND} SELECT symbol, ts, CAST(trend_score AS DOUBLE) AS trend_score, trend FROM t")
def w_prior_trend(spark, sf):
    return f.prior_trend(src.daily(spark, sf)).select("symbol", "ts", "trend_score", "trend")


def _pivot_sql(strict: bool) -> str:
    hi, lo = (">", "<") if strict else (">=", "<=")
    b, a = f"({S} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", f"({S} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    return f"""p AS (SELECT *, count(close) OVER {b} = 3 AND count(close) OVER {a} = 3 AND high {hi} max(high) OVER {b} AND high {hi} max(high) OVER {a} AS pivot_high,
        count(close) OVER {b} = 3 AND count(close) OVER {a} = 3 AND low {lo} min(low) OVER {b} AND low {lo} min(low) OVER {a} AS pivot_low, lead(ts, 3) OVER ({S}) AS confirmed_ts FROM bars_d)"""


@query(f"""WITH {_pivot_sql(True)}, e AS (SELECT symbol, ts, confirmed_ts, 'high' AS side, high AS price FROM p WHERE pivot_high UNION ALL SELECT symbol, ts, confirmed_ts, 'low', low FROM p WHERE pivot_low),
    l AS (SELECT *, lag(price) OVER (PARTITION BY symbol, side ORDER BY ts) AS b FROM e)
    SELECT symbol, ts, confirmed_ts, side, round(price, 6) AS price, CASE WHEN b IS NULL THEN NULL WHEN price > b THEN CASE side WHEN 'high' THEN 'HH' ELSE 'HL' END WHEN price < b THEN CASE side WHEN 'high' THEN 'LH' ELSE 'LL' END ELSE CASE side WHEN 'high' THEN 'EQH' ELSE 'EQL' END END AS label FROM l""")
def w_pivots(spark, sf):
    return f.pivot_labels(src.daily(spark, sf)).select("symbol", "ts", "confirmed_ts", "side", *r("price"), "label")


@query(f"""WITH x AS (SELECT *, CASE WHEN volume > lag(volume) OVER ({S}) THEN 1 ELSE 0 END AS rose FROM bars_d), y AS (SELECT *, sum(1 - rose) OVER ({S} ROWS UNBOUNDED PRECEDING) AS run FROM x)
    SELECT symbol, ts, CAST(sum(rose) OVER (PARTITION BY symbol, run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM y""")
def w_streak(spark, sf):
    return f.streak(src.daily(spark, sf)).select("symbol", "ts", F.col("streak").cast("long"))


def _z(sd: str, n: int, least: int) -> str:
    return f"SELECT symbol, ts, round(CASE WHEN count(volume) OVER {rows(n)} >= {least} THEN CASE WHEN {sd}(volume) OVER {rows(n)} > 0 THEN (volume - avg(volume) OVER {rows(n)}) / {sd}(volume) OVER {rows(n)} ELSE 0 END END, 6) AS z FROM"


@query(_z("stddev_samp", 20, 10) + " bars_h")
def w_obi_zscore(spark, sf):
    return f.zscore(src.intraday(spark, sf)).select("symbol", "ts", *r("z"))


@query(_z("stddev_pop", 30, 15) + " bars_h")
def w_oi_zscore(spark, sf):
    return f.zscore(src.intraday(spark, sf), n=30, least=15, sample=False).select("symbol", "ts", *r("z"))


@query(f"SELECT symbol, ts, round(close / max(close) OVER {rows(252)}, 6) AS high_proximity FROM bars_d")
def w_high_proximity(spark, sf):
    return f.high_proximity(src.daily(spark, sf)).select("symbol", "ts", *r("high_proximity"))


@query(f"""WITH x AS (SELECT *, close / lag(close, 20) OVER ({S}) - 1 > 0.02 AS c FROM bars_d), y AS (SELECT *, coalesce(c, false) AS on_, coalesce(lag(coalesce(c, false)) OVER ({S}), false) AS was FROM x)
    SELECT symbol, ts FROM y WHERE on_ AND NOT was""")
def w_edge_trigger(spark, sf):
    b = f.momentum(src.daily(spark, sf), 20, out="m")
    return f.edge_trigger(b, F.col("m") > 0.02).select("symbol", "ts")


@query(f"SELECT symbol, ts, round(CASE WHEN count(volume) OVER {rows(156)} = 156 THEN CASE WHEN max(volume) OVER {rows(156)} > min(volume) OVER {rows(156)} THEN (volume - min(volume) OVER {rows(156)}) / (max(volume) OVER {rows(156)} - min(volume) OVER {rows(156)}) * 100 ELSE 50 END END, 6) AS index FROM bars_w")
def w_cot_index(spark, sf):
    return f.index_in_range(src.weekly(spark, sf), "volume", 156).select("symbol", "ts", *r("index"))


@query(f"""WITH b AS (SELECT ts, bench / lag(bench) OVER (ORDER BY ts) - 1 AS br, bench / lag(bench, 12) OVER (ORDER BY ts) - 1 AS bm FROM bench_w),
    x AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS r, close / lag(close, 12) OVER ({S}) - 1 AS m FROM bars_w), j AS (SELECT * FROM x JOIN b USING (ts)),
    k AS (SELECT *, CASE WHEN count(r) OVER {rows(26)} >= 26 AND var_samp(br) OVER {rows(26)} > 1e-12 THEN covar_samp(r, br) OVER {rows(26)} / var_samp(br) OVER {rows(26)} END AS beta FROM j)
    SELECT symbol, ts, round(beta, 5) AS beta, round(m - beta * bm, 5) AS residual_mom FROM k""")
def w_beta_residual(spark, sf):
    return f.beta_residual(src.weekly(spark, sf), src.benchmark(spark, sf)).select("symbol", "ts", *r("beta", "residual_mom", n=5))
