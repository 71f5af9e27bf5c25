"""Queries of the candle patterns and price gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import candles as k
from tapeloom.operators import chart
from tapeloom.operators import gaps
from tapeloom.plans.registry import query
from tapeloom.plans.windows import TREND, S, r, rows
from tapeloom.sources import adapters as src

#: Bars with the two before them (p: previous, q: before that) and their parts.


def _bar(alias: str, k: int) -> str:
    lag = (lambda c: f"lag({c}, {k}) OVER ({S})") if k else (lambda c: c)
    return ", ".join(f"{lag(c)} AS {alias}{c}" for c in ("open", "high", "low", "close", "trend"))


def _geo(a: str) -> str:
    rng = f"CASE WHEN {a}high = {a}low THEN 1e-10 ELSE {a}high - {a}low END"
    return f"""abs({a}close - {a}open) AS {a}body, {rng} AS {a}rng, abs({a}close - {a}open) / ({rng}) AS {a}part, {a}high - greatest({a}open, {a}close) AS {a}up, least({a}open, {a}close) - {a}low AS {a}lo,
        greatest({a}open, {a}close) AS {a}top, least({a}open, {a}close) AS {a}bot, {a}close >= {a}open AS {a}bull, {a}close < {a}open AS {a}bear, ({a}open + {a}close) / 2 AS {a}mid"""


BARS = f"WITH {TREND}, g AS (SELECT symbol, ts, volume, {_bar('c', 0)}, {_bar('p', 1)}, {_bar('q', 2)} FROM t), c AS (SELECT *, {_geo('c')}, {_geo('p')}, {_geo('q')} FROM g)"
SMALL = "cbody <> 0 AND cpart <= 0.35"
HAMMER = f"{SMALL} AND clo >= 2 * cbody AND cup <= 0.10 * crng AND cbot >= clow + 0.60 * crng"
STAR = f"{SMALL} AND cup >= 2 * cbody AND clo <= 0.10 * crng AND ctop <= clow + 0.40 * crng"
MARU = "cpart >= 0.95 AND cup < 0.05 * cbody AND clo < 0.05 * cbody"
DRAGON, GRAVE = "cpart <= 0.05 AND cup <= 0.05 * crng AND clo >= 0.60 * crng", "cpart <= 0.05 AND clo <= 0.05 * crng AND cup >= 0.60 * crng"
UP, DOWN = "pbear AND cbull", "pbull AND cbear"
INSIDE = "cbot >= pbot AND ctop <= ptop AND ppart >= 0.60"
TESTS = {
    "bull_marubozu": f"{MARU} AND cbull", "bear_marubozu": f"{MARU} AND cbear", "dragonfly_doji": DRAGON, "gravestone_doji": f"{GRAVE} AND NOT ({DRAGON})", "doji": f"cpart <= 0.05 AND NOT ({DRAGON}) AND NOT ({GRAVE})",
    "spinning_top": "cpart BETWEEN 0.05 AND 0.30 AND cbody > 0 AND cup >= 2 * cbody AND clo >= 2 * cbody",
    "hammer": f"ctrend = 'down' AND {HAMMER}", "hanging_man": f"ctrend = 'up' AND {HAMMER}", "inverted_hammer": f"ctrend = 'down' AND {STAR}", "shooting_star": f"ctrend = 'up' AND {STAR}",
    "bullish_engulfing": f"ctrend = 'down' AND {UP} AND copen <= pclose AND cclose >= popen AND cbody > pbody", "bearish_engulfing": f"ctrend = 'up' AND {DOWN} AND copen >= pclose AND cclose <= popen AND cbody > pbody",
    "bullish_harami": f"ctrend = 'down' AND {UP} AND {INSIDE}", "bearish_harami": f"ctrend = 'up' AND {DOWN} AND {INSIDE}",
    "piercing_line": f"ctrend = 'down' AND {UP} AND copen < pclose AND cclose > pmid AND cclose < popen", "dark_cloud_cover": f"ctrend = 'up' AND {DOWN} AND copen > pclose AND cclose < pmid AND cclose > popen",
    "tweezer_bottom": f"ctrend = 'down' AND {UP} AND abs(plow - clow) <= 0.003 * plow", "tweezer_top": f"ctrend = 'up' AND {DOWN} AND abs(phigh - chigh) <= 0.003 * phigh",
    "morning_star": "qtrend = 'down' AND qbear AND qpart >= 0.50 AND ppart <= 0.30 AND cbull AND cclose >= qmid AND ptop < qclose", "evening_star": "qtrend = 'up' AND qbull AND qpart >= 0.50 AND ppart <= 0.30 AND cbear AND cclose <= qmid AND pbot > qclose",
    "three_white_soldiers": " AND ".join(f"{a}bull AND {a}part >= 0.50 AND {a}up <= 0.15 * {a}rng" for a in "qpc") + " AND popen BETWEEN qopen AND qclose AND copen BETWEEN popen AND pclose AND pclose > qclose AND cclose > pclose",
    "three_black_crows": " AND ".join(f"{a}bear AND {a}part >= 0.50 AND {a}lo <= 0.15 * {a}rng" for a in "qpc") + " AND popen BETWEEN qclose AND qopen AND copen BETWEEN pclose AND popen AND pclose < qclose AND cclose < pclose",
}


def _names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def found(names=None) -> str:
    """CTEs up to e: a row per bar and pattern."""
    rows_ = " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS pattern FROM c WHERE {TESTS[n]}" for n in names or TESTS)
    return f"{BARS}, u AS ({rows_}), e AS (SELECT *, CASE WHEN pattern IN ({_names(k.BULLISH)}) THEN 'bullish' WHEN pattern IN ({_names(k.BEARISH)}) THEN 'bearish' ELSE 'neutral' END AS direction FROM u)"


def _family(key: str, names: tuple[str, ...]) -> None:
    query(f"{found(names)} SELECT * FROM e", name=key)(lambda spark, sf: k.scan(src.daily(spark, sf), names))


_family("cdl_single", ("bull_marubozu", "bear_marubozu", "dragonfly_doji", "gravestone_doji", "doji", "spinning_top"))
_family("cdl_hammer_family", ("hammer", "hanging_man", "inverted_hammer", "shooting_star"))
_family("cdl_engulfing", ("bullish_engulfing", "bearish_engulfing"))
_family("cdl_harami", ("bullish_harami", "bearish_harami"))
_family("cdl_piercing_darkcloud", ("piercing_line", "dark_cloud_cover"))
_family("cdl_tweezer", ("tweezer_bottom", "tweezer_top"))
_family("cdl_star", ("morning_star", "evening_star"))
_family("cdl_soldiers_crows", ("three_white_soldiers", "three_black_crows"))
_family("cdl_scan", tuple(TESTS))

W10 = rows(10, 1).replace("close", "cclose")
STRENGTH = f"""{found()}, v AS (SELECT symbol, ts, cpart, volume, chigh, clow, lead(cclose) OVER ({S}) AS next_close, coalesce(avg(cpart) OVER {W10}, cpart) AS mp, coalesce(avg(volume) OVER {W10}, volume) AS mv FROM c),
    w AS (SELECT *, CASE WHEN mv > 0 THEN volume / mv ELSE 1 END AS vol_ratio FROM v),
    s AS (SELECT e.*, w.*  EXCLUDE (symbol, ts), CASE WHEN vol_ratio < 0.8 THEN 1 ELSE greatest(1, least(3, 1 + CASE WHEN cpart > 1.2 * mp THEN 1 ELSE 0 END + CASE WHEN vol_ratio > 1.5 THEN 1 ELSE 0 END
        + CASE WHEN pattern IN ({_names(k.THREE_BARS)}) THEN 1 WHEN pattern IN ({_names(k.TWO_BARS)}) THEN 0 ELSE -1 END)) END AS strength FROM e JOIN w USING (symbol, ts))"""


@query(f"{STRENGTH} SELECT symbol, ts, pattern, strength, round(cpart, 6) AS body_part, round(vol_ratio, 6) AS vol_ratio FROM s")
def cdl_strength(spark, sf):
    return k.strength(src.daily(spark, sf)).select("symbol", "ts", "pattern", "strength", *r("body_part", "vol_ratio"))


@query(f"{STRENGTH} SELECT symbol, ts, pattern, direction, strength, coalesce(CASE direction WHEN 'bullish' THEN next_close > chigh ELSE next_close < clow END, false) AS confirmed FROM s WHERE direction <> 'neutral'")
def cdl_confirm(spark, sf):
    return k.confirm(src.daily(spark, sf)).select("symbol", "ts", "pattern", "direction", "strength", "confirmed")


@query("""WITH d AS (SELECT *, abs(close - open) AS body, high - low AS rng FROM bars_d)
    SELECT symbol, ts, body AS body, rng AS range, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick,
    CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS direction, CASE WHEN rng > 0 THEN body / rng ELSE 0.0::DOUBLE END AS body_part FROM d""")
def candle_geometry(spark, sf):
    b = k.Bar()
    span = F.col("high") - F.col("low")
    return src.daily(spark, sf).select(
        "symbol", "ts", (b.body).alias("body"), (span).alias("range"), (b.upper).alias("upper_wick"), (b.lower).alias("lower_wick"),
        F.when(F.col("close") > F.col("open"), "up").when(b.bear, "down").otherwise("flat").alias("direction"), (F.when(span > 0, b.body / span).otherwise(0.0)).alias("body_part"),
    )


@query("SELECT symbol, ts, low <= open AND low <= close AND open <= high AND close <= high AS valid FROM bars_d")
def bar_validity(spark, sf):
    return src.daily(spark, sf).select("symbol", "ts", gaps.valid_bar().alias("valid"))


GAP = f"""WITH x AS (SELECT *, CASE WHEN lag(close) OVER ({S}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S}))) END AS tr FROM bars_d),
    y AS (SELECT symbol, ts, low, high, row_number() OVER ({S}) AS n, avg(tr) OVER {rows(14)} AS atr, lag(high, 2) OVER ({S}) AS high1, lag(low, 2) OVER ({S}) AS low1, lag(open) OVER ({S}) AS open2, lag(close) OVER ({S}) AS close2,
        avg(abs(close - open)) OVER ({S} ROWS BETWEEN 15 PRECEDING AND 2 PRECEDING) AS mean_body FROM x),
    z AS (SELECT *, CASE WHEN low > high1 THEN 'bullish' WHEN low1 > high THEN 'bearish' END AS direction, CASE WHEN low > high1 THEN low - high1 WHEN low1 > high THEN low1 - high END AS gap FROM y WHERE n > 2)
    , g AS (SELECT *, CASE direction WHEN 'bullish' THEN high1 ELSE high END AS bottom, CASE direction WHEN 'bullish' THEN low ELSE low1 END AS top, abs(close2 - open2) / mean_body AS body_ratio FROM z
      WHERE direction IS NOT NULL AND gap >= 0.15 * atr AND mean_body > 0 AND abs(close2 - open2) >= 1.15 * mean_body AND CASE direction WHEN 'bullish' THEN close2 > open2 ELSE close2 < open2 END)"""


GAP_LABEL = f"""{GAP}, sr AS (SELECT symbol, ts, close, row_number() OVER ({S}) AS n, lag(high) OVER ({S}) AS h2, lag(low) OVER ({S}) AS l2, greatest(high, lag(high) OVER ({S}), lag(high, 2) OVER ({S})) AS top3, least(low, lag(low) OVER ({S}), lag(low, 2) OVER ({S})) AS bot3, high, low FROM bars_d)
    SELECT g.symbol, g.ts, g.direction, round(g.bottom, 6) AS bottom, round(g.top, 6) AS top, round(g.gap, 6) AS gap, round(g.body_ratio, 6) AS body_ratio,
        CASE WHEN CASE g.direction WHEN 'bullish' THEN s.close > h2 ELSE s.close < l2 END THEN 'strong' WHEN EXISTS (SELECT 1 FROM sr p WHERE p.symbol = s.symbol AND p.n BETWEEN s.n - 7 AND s.n - 3 AND p.high >= s.top3 AND p.low <= s.bot3) THEN 'weak' ELSE 'normal' END AS label,
        (SELECT count(*) FROM g x WHERE x.symbol = g.symbol AND x.ts > g.ts) >= 50 AS evicted
    FROM g JOIN sr s ON s.symbol = g.symbol AND s.ts = g.ts"""


@query(GAP_LABEL)
def fvg_detect(spark, sf):
    """Gaps with their strength; of a series only the 50 newest stay active, the others are evicted."""
    newer = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    g = chart.gap_labels(src.daily(spark, sf)).where("direction IS NOT NULL").withColumn("evicted", newer > chart.OpenZones.CAP)
    return g.select("symbol", "ts", "direction", *r("bottom", "top", "gap", "body_ratio"), "label", "evicted")


@query(f"""{GAP} SELECT g.symbol, g.ts, g.direction, min(b.ts) FILTER (CASE g.direction WHEN 'bullish' THEN b.low <= (g.bottom + g.top) / 2 ELSE b.high >= (g.bottom + g.top) / 2 END) AS ce_ts,
    min(b.ts) FILTER (CASE g.direction WHEN 'bullish' THEN b.low <= g.bottom ELSE b.high >= g.top END) AS mitigated_ts, min(b.ts) FILTER (CASE g.direction WHEN 'bullish' THEN b.close < g.bottom ELSE b.close > g.top END) AS inverted_ts
    FROM g LEFT JOIN bars_d b ON b.symbol = g.symbol AND b.ts > g.ts GROUP BY 1, 2, 3""")
def fvg_lifecycle(spark, sf):
    return gaps.lifecycle(src.daily(spark, sf)).select("symbol", "ts", "direction", "ce_ts", "mitigated_ts", "inverted_ts")
