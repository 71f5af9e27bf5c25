"""Queries of Wyckoff schematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import wyckoff as wy
from tapeloom.plans.registry import query
from tapeloom.plans.windows import S, r, rows
from tapeloom.sources import adapters as src


def _first(name: str, parents: str, test: str) -> str:
    """The first bar b of each series of ``parents`` (its schematic k, and the rows of the events before) that meets the test."""
    return f"{name} AS (SELECT b.* FROM (SELECT k.symbol, min(b.n) AS n FROM k {parents} JOIN wm b ON b.symbol = k.symbol WHERE {test} GROUP BY 1) q JOIN wm b USING (symbol, n))"


ACC, DIS = "k.kind = 'accumulation'", "k.kind = 'distribution'"
FORCE = "b.volume >= b.vma * 1.2 AND b.volume > b.v0 AND b.sp >= b.sma * 1.1"
QUIET = "b.volume < b.vma * 0.8 AND b.sp < b.sma * 0.9"
AHEAD = "(SELECT {0}(x.close) FROM wm x WHERE x.symbol = b.symbol AND x.n BETWEEN b.n AND b.n + 3)"
WY = f"""WITH wm AS MATERIALIZED (SELECT *, row_number() OVER ({S}) AS n, high - low AS sp, lag(close) OVER ({S}) AS c0, lag(volume) OVER ({S}) AS v0,
        coalesce(CASE WHEN stddev_samp(volume) OVER {rows(50)} > 0 THEN (volume - avg(volume) OVER {rows(50)}) / stddev_samp(volume) OVER {rows(50)} END, 0) AS z, avg(volume) OVER {rows(20)} AS vma, avg(high - low) OVER {rows(20)} AS sma, count(*) OVER (PARTITION BY symbol) AS nb FROM bars_d),
    cl AS (SELECT * FROM wm WHERE n > 1 AND z >= 2 AND sp >= sma * 1.5),
    sc AS (SELECT symbol, arg_min(n, (low, n)) AS n, min(low) AS price FROM cl WHERE close < c0 AND (close - low) / greatest(sp, 1e-9) >= 0.3 GROUP BY 1),
    bc AS (SELECT symbol, arg_max(n, (high, -n)) AS n, max(high) AS price FROM cl WHERE close > c0 AND (high - close) / greatest(sp, 1e-9) >= 0.25 GROUP BY 1),
    ua AS (SELECT sc.symbol, arg_max(b.n, (b.high, -b.n)) AS n, max(b.high) AS price FROM sc JOIN wm b ON b.symbol = sc.symbol AND b.n BETWEEN sc.n + 1 AND sc.n + 30 GROUP BY 1),
    da AS (SELECT bc.symbol, arg_min(b.n, (b.low, b.n)) AS n, min(b.low) AS price FROM bc JOIN wm b ON b.symbol = bc.symbol AND b.n BETWEEN bc.n + 1 AND bc.n + 30 GROUP BY 1),
    ka AS (SELECT sc.symbol, 'accumulation' AS kind, sc.price AS lo, ua.price AS hi, sc.n AS cn, ua.n AS an FROM sc JOIN ua USING (symbol) JOIN (SELECT DISTINCT symbol, nb FROM wm) USING (symbol) WHERE nb >= 55 AND sc.price > 0 AND (ua.price - sc.price) / sc.price >= 0.05),
    kd AS (SELECT bc.symbol, 'distribution', da.price, bc.price, bc.n, da.n FROM bc JOIN da USING (symbol) JOIN (SELECT DISTINCT symbol, nb FROM wm) USING (symbol) WHERE nb >= 55 AND da.price > 0 AND (bc.price - da.price) / bc.price >= 0.05 AND symbol NOT IN (SELECT symbol FROM ka)),
    k AS MATERIALIZED (SELECT s.*, greatest(hi - lo, 1e-9) AS width, c.volume AS cv, c.sp AS csp FROM (SELECT * FROM ka UNION ALL SELECT * FROM kd) s JOIN wm c ON c.symbol = s.symbol AND c.n = cn),
    st AS (SELECT b.*, k.kind FROM k JOIN wm b ON b.symbol = k.symbol AND b.n > an WHERE b.volume < cv * 0.7 AND b.sp < csp * 0.8 AND CASE WHEN {ACC} THEN abs(b.low - lo) / width <= 0.15 AND b.low > lo * 0.95 ELSE abs(b.high - hi) / width <= 0.15 AND b.high < hi * 1.05 END),
    hs AS (SELECT symbol, count(*) AS sts FROM st GROUP BY 1),
    {_first("spring", "JOIN hs USING (symbol)", f"{ACC} AND b.n > an AND b.low < lo AND (lo - b.low) / width <= 0.05 AND {AHEAD.format('max')} > lo")},
    {_first("utad", "JOIN hs USING (symbol)", f"{DIS} AND b.n > an AND b.high > hi AND (b.high - hi) / width <= 0.05 AND {AHEAD.format('min')} < hi")},
    {_first("tst", "JOIN spring p USING (symbol)", "b.n > p.n + 3 AND b.low <= lo * 1.15 AND b.low > lo * (1 - 0.05 * 0.5) AND b.volume < p.volume * 0.6 AND b.close > lo")},
    root AS (SELECT * FROM tst UNION ALL SELECT * FROM spring WHERE symbol NOT IN (SELECT symbol FROM tst)),
    {_first("sos", "JOIN root p USING (symbol)", f"b.n > p.n AND (b.close - p.close) / greatest(p.close, 1e-9) >= 0.03 AND {FORCE} AND b.close >= b.open")},
    {_first("sow", "JOIN utad p USING (symbol)", f"b.n > p.n AND (p.close - b.close) / greatest(p.close, 1e-9) >= 0.03 AND {FORCE} AND b.close <= b.open")},
    {_first("jac", "JOIN sos p USING (symbol)", "b.n >= p.n AND b.close > hi * 1.003 AND b.volume >= b.vma * 1.5")},
    {_first("buec", "JOIN jac p USING (symbol)", "b.n > p.n AND b.low <= hi * 1.01 AND b.close > hi * 0.99 AND b.volume < b.vma * 0.8")},
    {_first("lps", "JOIN sos p USING (symbol) JOIN spring o USING (symbol)", f"b.n > p.n AND b.low >= p.close - (p.close - o.low) * 0.5 AND b.low > lo * 1.01 AND {QUIET} AND b.volume < p.volume * 0.7")},
    {_first("lpsy", "JOIN sow p USING (symbol)", f"b.n > p.n AND b.high <= p.close + (hi - p.close) * 0.5 AND b.high < hi * 0.99 AND {QUIET}")},
    ty AS (SELECT 'Spring' AS event, symbol, CASE WHEN z >= 2 THEN 1 WHEN z >= 0.8 THEN 2 WHEN sp < sma THEN 3 ELSE 2 END AS type FROM spring UNION ALL SELECT 'UTAD', symbol, CASE WHEN z >= 2 THEN 1 WHEN z >= 0.8 THEN 2 ELSE 3 END FROM utad),
    ev AS (SELECT 'ST' AS event, symbol, ts, n, CASE kind WHEN 'accumulation' THEN low ELSE high END AS price, volume, close FROM st
        UNION ALL SELECT CASE kind WHEN 'accumulation' THEN 'SC' ELSE 'BC' END, b.symbol, ts, b.n, CASE kind WHEN 'accumulation' THEN low ELSE high END, volume, close FROM k JOIN wm b ON b.symbol = k.symbol AND b.n = cn
        UNION ALL SELECT 'AR', b.symbol, ts, b.n, CASE kind WHEN 'accumulation' THEN high ELSE low END, volume, close FROM k JOIN wm b ON b.symbol = k.symbol AND b.n = an
        {" ".join(f"UNION ALL SELECT '{name}', symbol, ts, n, {price}, volume, close FROM {t}" for name, t, price in (("Spring", "spring", "low"), ("Test", "tst", "low"), ("UTAD", "utad", "high"), ("SOS", "sos", "close"), ("SOW", "sow", "close"), ("JAC", "jac", "close"), ("BUEC", "buec", "low"), ("LPS", "lps", "low"), ("LPSY", "lpsy", "high")))}),
    by_name AS (SELECT symbol, map_from_entries(list((event, price)) FILTER (event <> 'ST')) AS p FROM ev GROUP BY 1),
    vol AS (SELECT k.symbol, avg(b.volume) FILTER (b.close >= b.open) AS adv, avg(b.volume) FILTER (b.close < b.open) AS decl FROM k JOIN wm b ON b.symbol = k.symbol AND b.n BETWEEN cn AND an GROUP BY 1),
    ends AS (SELECT symbol, max(ts) AS ts, arg_max(close, n) AS close, avg(CASE WHEN n > 1 THEN greatest(high - low, abs(high - c0), abs(low - c0)) END) FILTER (n > nb - 14) AS atr, sum((volume = 0)::INT) / count(*) AS still FROM wm GROUP BY 1),
    g AS (SELECT e.symbol, e.ts, e.close, atr, still, kind, lo, hi, coalesce(sts, 0) AS sts, p, coalesce(CASE kind WHEN 'accumulation' THEN adv / greatest(decl, 1e-9) ELSE decl / greatest(adv, 1e-9) END >= 1.1, false) AS volume_asymmetry, ty.type AS spring_type
        FROM ends e LEFT JOIN k USING (symbol) LEFT JOIN hs USING (symbol) LEFT JOIN by_name USING (symbol) LEFT JOIN vol USING (symbol) LEFT JOIN ty ON ty.symbol = e.symbol AND ty.event = 'Spring'),
    ph AS (SELECT *, CASE WHEN kind IS NULL THEN NULL WHEN sts = 0 THEN 'A' WHEN p['Spring'] IS NULL AND p['UTAD'] IS NULL THEN 'B' WHEN p['SOS'] IS NULL AND p['SOW'] IS NULL THEN 'C' WHEN p['JAC'] IS NOT NULL OR kind = 'distribution' AND (coalesce(p['SOW'] < lo * 0.99, false) OR coalesce(p['LPSY'] < lo * 0.99, false)) THEN 'E' ELSE 'D' END AS phase,
        CASE WHEN kind IS NULL THEN 0 ELSE round(least(greatest({" + ".join(f"(p['{e}'] IS NOT NULL)::INT * {v}" for e, v in wy.WEIGHTS.items() if e != "ST")} + least(sts, 2) * 0.06 + coalesce((spring_type = 3)::INT, 0) * 0.05 + volume_asymmetry::INT * 0.07, 0), CASE WHEN still >= 0.2 THEN 0.5 ELSE 1 END), 6) END::DOUBLE AS confidence FROM g)"""


def _chain(spark, sf):
    return wy.chain(src.daily(spark, sf))


@query(f"{WY} SELECT symbol, ts, 'SC' AS kind, low AS price, round(z, 6) AS z FROM sc JOIN wm USING (symbol, n) UNION ALL SELECT symbol, ts, 'BC', high, round(z, 6) FROM bc JOIN wm USING (symbol, n)")
def wy_climax(spark, sf):
    b = wy.measures(src.daily(spark, sf))
    low = b.where("sc").groupBy("symbol").agg(F.min_by(F.struct("ts", F.lit("SC").alias("kind"), F.col("low").alias("price"), "z"), F.struct("low", "n")).alias("c"))
    high = b.where("bc").groupBy("symbol").agg(F.max_by(F.struct("ts", F.lit("BC").alias("kind"), F.col("high").alias("price"), "z"), F.struct("high", -F.col("n"))).alias("c"))
    return low.unionByName(high).select("symbol", "c.*").select("symbol", "ts", "kind", "price", *r("z"))


@query(f"{WY} SELECT ev.symbol, kind, event, ts, price, volume, type FROM ev JOIN k USING (symbol) LEFT JOIN ty USING (symbol, event)")
def wy_events(spark, sf):
    return wy.events(_chain(spark, sf))


@query(f"{WY} SELECT symbol, kind AS schematic, lo AS low_anchor, hi AS high_anchor, sts, volume_asymmetry FROM ph")
def wy_schematic(spark, sf):
    return wy.schematics(_chain(spark, sf)).select("symbol", F.col("kind").alias("schematic"), "low_anchor", "high_anchor", "sts", "volume_asymmetry")


@query(f"{WY} SELECT symbol, phase, confidence FROM ph")
def wy_phase(spark, sf):
    return wy.schematics(_chain(spark, sf)).select("symbol", "phase", "confidence")


@query(f"""{WY}, tr AS (SELECT *, kind IS NOT NULL AND confidence >= 0.35 AS ok, CASE WHEN kind = 'accumulation' THEN CASE phase WHEN 'C' THEN CASE WHEN p['Test'] IS NOT NULL THEN 'Test' WHEN spring_type = 3 THEN 'Spring' END WHEN 'D' THEN CASE WHEN p['BUEC'] IS NOT NULL THEN 'BUEC' WHEN p['LPS'] IS NOT NULL THEN 'LPS' ELSE 'SOS' END WHEN 'E' THEN 'JAC' END
        ELSE CASE phase WHEN 'C' THEN 'UTAD' WHEN 'D' THEN CASE WHEN p['LPSY'] IS NOT NULL THEN 'LPSY' ELSE 'SOW' END WHEN 'E' THEN 'SOW_breakout' END END AS t FROM ph), tt AS (SELECT *, CASE WHEN ok THEN t END AS tg FROM tr),
    rf AS (SELECT *, CASE tg WHEN 'Test' THEN p['Spring'] WHEN 'JAC' THEN hi WHEN 'SOW_breakout' THEN lo WHEN 'SOS' THEN p['SOS'] * 0.99 WHEN 'SOW' THEN p['SOW'] * 1.01 ELSE p[tg] END AS ref FROM tt)
    SELECT symbol, ts, CASE WHEN NOT ok THEN 'avoid' WHEN tg IS NULL THEN 'wait' WHEN kind = 'accumulation' THEN 'long' ELSE 'short' END AS signal, coalesce(tg, '') AS trigger, CASE WHEN tg = 'Test' THEN p['Test'] ELSE close END AS price,
        round(coalesce(CASE kind WHEN 'accumulation' THEN ref - 0.5 * atr ELSE ref + 0.5 * atr END, 0), 6) AS stop, round(CASE WHEN tg IS NULL THEN 0 WHEN kind = 'accumulation' THEN hi + (hi - lo) ELSE lo - (hi - lo) END, 6) AS target FROM rf""")
def wy_entry(spark, sf):
    return wy.entries(wy.schematics(_chain(spark, sf)))
