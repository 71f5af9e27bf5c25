"""Queries of market structure, liquidity and order blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import blocks, gaps, structure as ms
from tapeloom.operators import features as f
from tapeloom.plans.registry import query
from tapeloom.plans.windows import S, r
from tapeloom.sources import adapters as src

SCOPED = """
    {0}_a AS (SELECT symbol, ts, high, low, close, row_number() OVER w AS n,
            CASE WHEN count(*) OVER b = {1} AND count(*) OVER a = {1} AND high > max(high) OVER b AND high > max(high) OVER a THEN high END AS ph,
            CASE WHEN count(*) OVER b = {1} AND count(*) OVER a = {1} AND low < min(low) OVER b AND low < min(low) OVER a THEN low END AS pl
        FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY ts), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {1} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {1} FOLLOWING)),
    {0}_b AS (SELECT *, lag(ph, {1}) OVER w AS up, lag(pl, {1}) OVER w AS down FROM {0}_a WINDOW w AS (PARTITION BY symbol ORDER BY n)),
    {0}_c AS (SELECT *, last_value(up IGNORE NULLS) OVER w AS up0, last_value(down IGNORE NULLS) OVER w AS down0 FROM {0}_b WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {0}_d AS (SELECT *, CASE WHEN up IS NULL THEN NULL WHEN up0 IS NULL THEN 'HH' WHEN abs(up - up0) / greatest(up, up0) <= 0.0015 THEN 'EQH' WHEN up > up0 THEN 'HH' ELSE 'LH' END AS up_label,
            CASE WHEN down IS NULL THEN NULL WHEN down0 IS NULL THEN 'LL' WHEN abs(down - down0) / greatest(down, down0) <= 0.0015 THEN 'EQL' WHEN down > down0 THEN 'HL' ELSE 'LL' END AS down_label FROM {0}_c),
    {0}_h AS (SELECT symbol, n, up AS h1, lag(up) OVER (PARTITION BY symbol ORDER BY n) AS h2 FROM {0}_d WHERE up_label IN ('HH', 'LH')),
    {0}_l AS (SELECT symbol, n, down AS l1, lag(down) OVER (PARTITION BY symbol ORDER BY n) AS l2 FROM {0}_d WHERE down_label IN ('HL', 'LL')),
    {0}_t AS (SELECT d.*, '{0}' AS scope, {1} AS side, CASE WHEN h1 > h2 AND l1 > l2 THEN 1 WHEN h1 < h2 AND l1 < l2 THEN -1 ELSE 0 END AS geo
        FROM {0}_d d ASOF LEFT JOIN {0}_h h ON h.symbol = d.symbol AND d.n >= h.n ASOF LEFT JOIN {0}_l l ON l.symbol = d.symbol AND d.n >= l.n)"""

#: The machine as a recursion over bars: tu/td the unbroken targets, nu/nd the newest pivots, gl/gh the guards.
EVENTS = f"""WITH RECURSIVE {SCOPED.format("swing", 5)}, {SCOPED.format("internal", 3)},
    t AS MATERIALIZED (SELECT symbol, scope, side, ts, n, high, low, close, up, down, up_label, down_label, geo FROM swing_t UNION ALL SELECT symbol, scope, side, ts, n, high, low, close, up, down, up_label, down_label, geo FROM internal_t),
    m AS (SELECT DISTINCT symbol, scope, 0::BIGINT AS n, NULL::DOUBLE AS tu, 0::BIGINT AS tun, NULL::DOUBLE AS td, 0::BIGINT AS tdn, NULL::DOUBLE AS nu, 0::BIGINT AS nun, NULL::DOUBLE AS nd, 0::BIGINT AS ndn, NULL::DOUBLE AS gl, 0::BIGINT AS gln, NULL::DOUBLE AS gh, 0::BIGINT AS ghn,
            0 AS held, -1::BIGINT AS anchor, -1::BIGINT AS lastp, 0 AS bias, 0 AS ended, NULL::VARCHAR AS kind, NULL::DOUBLE AS lvl, 0::BIGINT AS lvn, false AS choch, NULL::DOUBLE AS clvl, 0::BIGINT AS cln FROM t
        UNION ALL
        SELECT symbol, scope, n, CASE WHEN choch THEN coalesce(nu, tu) WHEN kind = 'BOS' AND bias = 1 THEN NULL ELSE tu END, CASE WHEN choch AND nu IS NOT NULL THEN nun ELSE tun END,
            CASE WHEN choch THEN coalesce(nd, td) WHEN kind = 'BOS' AND bias = -1 THEN NULL ELSE td END, CASE WHEN choch AND nd IS NOT NULL THEN ndn ELSE tdn END, nu, nun, nd, ndn,
            CASE WHEN choch AND bias = 1 THEN NULL ELSE gl END, gln, CASE WHEN choch AND bias = -1 THEN NULL ELSE gh END, ghn,
            CASE WHEN choch THEN -bias ELSE held END, CASE WHEN choch THEN lastp ELSE anchor END, lastp, bias, CASE WHEN choch THEN -bias ELSE bias END, kind,
            CASE WHEN bias = 1 THEN tu ELSE td END, CASE WHEN bias = 1 THEN tun ELSE tdn END, choch, CASE WHEN bias = 1 THEN gl ELSE gh END, CASE WHEN bias = 1 THEN gln ELSE ghn END
        FROM (SELECT *, CASE WHEN bias = 1 AND close > tu OR bias = -1 AND close < td THEN 'BOS' WHEN bias = 1 AND high > tu OR bias = -1 AND low < td THEN 'SWEEP' END AS kind, coalesce(bias = 1 AND close < gl OR bias = -1 AND close > gh, false) AS choch
        FROM (SELECT * REPLACE (CASE WHEN held <> 0 AND lastp > anchor AND geo = held THEN 0 ELSE held END AS held), CASE WHEN held <> 0 THEN held ELSE geo END AS bias
        FROM (SELECT t.symbol, t.scope, t.n, t.high, t.low, t.close, t.geo, m.held, m.anchor, greatest(m.lastp, CASE WHEN coalesce(t.up, t.down) IS NOT NULL THEN t.n - t.side ELSE -1 END) AS lastp,
            coalesce(t.up, m.tu) AS tu, CASE WHEN t.up IS NOT NULL THEN t.n - t.side ELSE m.tun END AS tun, coalesce(t.down, m.td) AS td, CASE WHEN t.down IS NOT NULL THEN t.n - t.side ELSE m.tdn END AS tdn,
            coalesce(t.up, m.nu) AS nu, CASE WHEN t.up IS NOT NULL THEN t.n - t.side ELSE m.nun END AS nun, coalesce(t.down, m.nd) AS nd, CASE WHEN t.down IS NOT NULL THEN t.n - t.side ELSE m.ndn END AS ndn,
            CASE WHEN t.down_label = 'HL' THEN t.down ELSE m.gl END AS gl, CASE WHEN t.down_label = 'HL' THEN t.n - t.side ELSE m.gln END AS gln, CASE WHEN t.up_label = 'LH' THEN t.up ELSE m.gh END AS gh, CASE WHEN t.up_label = 'LH' THEN t.n - t.side ELSE m.ghn END AS ghn
            FROM m JOIN t ON t.symbol = m.symbol AND t.scope = m.scope AND t.n = m.n + 1)))),
    name(d, word) AS (VALUES (1, 'BULLISH'), (-1, 'BEARISH'), (0, 'RANGING')),
    e AS (SELECT symbol, scope, n, kind, bias AS d, lvl AS level, NULL AS label, bias, lvn AS pivot_n FROM m WHERE kind IS NOT NULL
        UNION ALL SELECT symbol, scope, n, 'CHOCH', -bias, clvl, NULL, bias, cln FROM m WHERE choch
        UNION ALL SELECT symbol, scope, n, 'PIVOT', NULL, up, up_label, ended, n - side FROM m JOIN t USING (symbol, scope, n) WHERE up IS NOT NULL
        UNION ALL SELECT symbol, scope, n, 'PIVOT', NULL, down, down_label, ended, n - side FROM m JOIN t USING (symbol, scope, n) WHERE down IS NOT NULL),
    ev AS (SELECT symbol, scope, t.ts, n, kind, a.word AS direction, level, label, b.word AS bias, CASE WHEN kind IN ('BOS', 'CHOCH') THEN abs(t.close - level) / level END AS strength, CAST(pivot_n AS INT) AS pivot_n
        FROM e JOIN t USING (symbol, scope, n) LEFT JOIN name a ON a.d = e.d JOIN name b ON b.d = e.bias)"""


def events(spark, sf):
    return ms.events(src.daily(spark, sf))


@query(f"{EVENTS} SELECT symbol, scope, ts, kind, direction, level, bias, round(strength, 6) AS strength, pivot_n FROM ev WHERE kind IN ('BOS', 'CHOCH')")
def struct_bos_choch(spark, sf):
    return events(spark, sf).where("kind IN ('BOS', 'CHOCH')").select("symbol", "scope", "ts", "kind", "direction", "level", "bias", *r("strength"), "pivot_n")


SWUNG = f"{EVENTS}, z AS (SELECT symbol, scope, arg_max(ended, n) AS d FROM m GROUP BY 1, 2) SELECT symbol, scope, ts, kind, direction, level, label, bias, word AS final_bias FROM ev JOIN z USING (symbol, scope) JOIN name USING (d)"


@query(SWUNG)
def struct_swing(spark, sf):
    return swing(events(spark, sf))


def swing(found):
    """Events with the bias that stands at the end of the series, by its last event and what a change there turned it to."""
    turned = F.when(F.col("kind") == "CHOCH", F.col("direction")).otherwise(F.col("bias"))
    place = F.when(F.col("kind") == "CHOCH", 2).when(F.col("kind") == "PIVOT", 0).otherwise(1)
    last = Window.partitionBy("symbol", "scope").orderBy(F.desc("n"), F.desc(place))
    return found.withColumn("final_bias", F.first(turned).over(last)).select("symbol", "scope", "ts", "kind", "direction", "level", "label", "bias", "final_bias")


@query(SWUNG)
def udtf_detectors(spark, sf):
    """The same events by a table function, called in SQL."""
    ms.register(spark)
    rows = ms.scoped(src.daily(spark, sf), ms.SCOPES)
    return swing(spark.sql("SELECT e.* FROM detect_structure(TABLE({rows}) PARTITION BY (symbol, scope) ORDER BY n) e", rows=rows))


@query()
def struct_eqh_eql(spark, sf):
    p = ms.pools(src.daily(spark, sf), tolerance=0.02, least=2)
    return gaps.first_hits_by_side(p, src.daily(spark, sf), F.col("side") == "BSL", {"mitigated_ts": ([("close", ">", F.col("high"))], [("close", "<", F.col("low"))])}, ("side", "low", "high", "touches"))


@query()
def liq_pools(spark, sf):
    return ms.pools(src.daily(spark, sf)).select("symbol", "side", "price", "touches", "low", "high", "ts")


def _sweeps(spark, sf):
    b = src.daily(spark, sf)
    return ms.sweeps(b, ms.pools(b))


@query()
def liq_sweeps(spark, sf):
    return _sweeps(spark, sf).select("symbol", "ts", "side", "level", "wick", "sweep_type", F.lit(True).alias("reclaimed"))


def _shifted(spark, sf):
    at = ms.shifts(src.daily(spark, sf)).select("symbol", "n", "mss_up", "mss_down")
    return _sweeps(spark, sf).join(at, ["symbol", "n"]).withColumn("mss", F.when(F.col("side") == "SSL", F.col("mss_up")).otherwise(F.col("mss_down")))


@query()
def liq_mss(spark, sf):
    return _shifted(spark, sf).where("mss IS NOT NULL").select("symbol", F.col("ts").alias("sweep_ts"), "side", F.col("level").alias("pool"), F.col("mss.ts").alias("ts"), F.col("mss.level").alias("broken_level"), F.col("mss.displacement").alias("displacement"))


@query()
def liq_analyze(spark, sf):
    b = src.daily(spark, sf)
    p = f.pivots(b, 3, 3, strict=False).withColumn("n", F.row_number().over(f.series()))
    before = f.series().rowsBetween(Window.unboundedPreceding, -4)  # pivots whose bars lie before the sweep
    p = p.withColumns({"dr_high": F.last(F.when(F.col("pivot_high"), F.col("high")), ignorenulls=True).over(before), "dr_low": F.last(F.when(F.col("pivot_low"), F.col("low")), ignorenulls=True).over(before)})
    last = Window.partitionBy("symbol").orderBy(F.desc("n"), F.desc("side"), F.desc("seq"))
    s = _shifted(spark, sf)
    counts = s.groupBy("symbol").agg(F.count("*").alias("n_sweeps"), F.count("mss").alias("n_mss"))
    newest = s.withColumn("__k", F.row_number().over(last)).where("__k = 1").select("symbol", "n", "side", F.col("ts").alias("sweep_ts"), "sweep_type")
    end = b.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    n_pools = ms.pools(b).groupBy("symbol").agg(F.count("*").alias("n_pools"))
    x = end.join(n_pools, "symbol", "left").join(counts, "symbol", "left").join(newest.join(p.select("symbol", "n", "dr_high", "dr_low"), ["symbol", "n"]), "symbol", "left")
    x = x.withColumns(ms.dealing_range(F.col("dr_high"), F.col("dr_low"), F.col("close"), F.col("side")))
    return x.select("symbol", "ts", "close", "n_pools", F.coalesce("n_sweeps", F.lit(0)).alias("n_sweeps"), F.coalesce("n_mss", F.lit(0)).alias("n_mss"), "sweep_ts", "side", "sweep_type", "dr_high", "dr_low", *r("eq", "ote_low", "ote_high", "ote_mid"), "price_zone")


W = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {{0}} AND {{1}})"
SWING = f"""sw_a AS (SELECT *, row_number() OVER ({S}) AS n, coalesce(lag(close) OVER ({S}), NULL) AS c0 FROM bars_d),
    sw_b AS (SELECT *, greatest(high - low, coalesce(abs(high - c0), 0), coalesce(abs(low - c0), 0)) AS tr,
        CASE WHEN count(*) OVER {W.format("2 PRECEDING", "1 PRECEDING")} = 2 AND count(*) OVER {W.format("1 FOLLOWING", "2 FOLLOWING")} = 2 AND high >= max(high) OVER {W.format("2 PRECEDING", "2 FOLLOWING")} THEN high END AS ph,
        CASE WHEN count(*) OVER {W.format("2 PRECEDING", "1 PRECEDING")} = 2 AND count(*) OVER {W.format("1 FOLLOWING", "2 FOLLOWING")} = 2 AND low <= min(low) OVER {W.format("2 PRECEDING", "2 FOLLOWING")} THEN low END AS pl,
        avg(volume) OVER {W.format("14 PRECEDING", "1 PRECEDING")} AS vm FROM sw_a),
    sw AS MATERIALIZED (SELECT *, lag(ph, 2) OVER ({S}) AS up, lag(pl, 2) OVER ({S}) AS down, avg(tr) OVER {W.format("13 PRECEDING", "CURRENT ROW")} AS seed FROM sw_b)"""

BLOCKS = f"""WITH RECURSIVE {SWING},
    k AS (SELECT DISTINCT symbol, 0::BIGINT AS n, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo, NULL::DOUBLE AS atr, false AS u, false AS d FROM sw
        UNION ALL SELECT symbol, n, CASE WHEN u THEN NULL ELSE hi END, CASE WHEN d THEN NULL ELSE lo END, atr, u, d
        FROM (SELECT *, coalesce(atr IS NOT NULL AND close > hi, false) AS u, coalesce(atr IS NOT NULL AND close < lo, false) AS d
        FROM (SELECT s.symbol, s.n, s.close, greatest(k.hi, s.up) AS hi, least(k.lo, s.down) AS lo, CASE WHEN s.n = 14 THEN seed WHEN s.n > 14 THEN k.atr + (s.tr - k.atr) / 14 END AS atr FROM k JOIN sw s ON s.symbol = k.symbol AND s.n = k.n + 1))),
    br AS (SELECT symbol, n, atr, 'bullish' AS direction, 1 AS sign FROM k WHERE u UNION ALL SELECT symbol, n, atr, 'bearish', -1 FROM k WHERE d),
    oc AS (SELECT br.*, s.ts, s.close, abs(s.close - s.open) AS body, s.high - s.low AS span, (SELECT max(c.n) FROM sw c WHERE c.symbol = br.symbol AND c.n BETWEEN br.n - 10 AND br.n - 1 AND br.sign * (c.close - c.open) < 0) AS cn
        FROM br JOIN sw s USING (symbol, n) WHERE br.sign * (s.close - s.open) > 0),
    ob AS (SELECT oc.symbol, oc.ts, oc.n, direction, least(c.open, c.close) AS bottom, greatest(c.open, c.close) AS top, CASE sign WHEN 1 THEN c.low ELSE c.high END AS extreme, c.ts AS block_ts,
        (SELECT count(*) > 0 FROM sw x JOIN sw y ON y.symbol = x.symbol AND y.n = x.n - 2 WHERE x.symbol = oc.symbol AND x.n BETWEEN cn + 2 AND oc.n AND (sign = 1 AND x.low > y.high OR sign = -1 AND x.high < y.low)) AS has_gap,
        body, atr, body / (span + 1e-12) AS ratio, coalesce(c.volume > c.vm, false) AS heavy, coalesce(c.ph, c.pl) IS NOT NULL AND cn + 2 <= oc.n AS at_swing,
        (SELECT arg_max(CASE sign WHEN 1 THEN x.down ELSE x.up END, x.n) FROM sw x WHERE x.symbol = oc.symbol AND x.n <= oc.n AND CASE sign WHEN 1 THEN x.down ELSE x.up END IS NOT NULL) AS sweep_level
        FROM oc JOIN sw c ON c.symbol = oc.symbol AND c.n = cn WHERE body >= atr AND body / (span + 1e-12) >= 0.5 AND sign * (oc.close - CASE sign WHEN 1 THEN c.high ELSE c.low END) > 0),
    os AS (SELECT *, round((body >= 2 * atr)::INT * 0.3 + has_gap::INT * 0.25 + heavy::INT * 0.2 + (ratio >= 0.65)::INT * 0.15 + at_swing::INT * 0.1, 6)::DOUBLE AS strength FROM ob),
    ok AS (SELECT symbol, ts, direction, bottom, top, extreme, block_ts, strength, has_gap, sweep_level FROM os WHERE strength >= 0.4)"""
OB_COLUMNS = ("symbol", "ts", "direction", "bottom", "top", "extreme", "block_ts", "strength", "has_gap", "sweep_level")


@query(f"{BLOCKS} SELECT * FROM ok")
def ob_detect(spark, sf):
    return blocks.detect(src.daily(spark, sf)).select(*OB_COLUMNS)


LIFE = f"""{BLOCKS}, v AS (SELECT ok.*, min(b.ts) FILTER (CASE direction WHEN 'bullish' THEN b.low <= top ELSE b.high >= bottom END) AS visited_ts, min(b.ts) FILTER (CASE direction WHEN 'bullish' THEN b.low < sweep_level ELSE b.high > sweep_level END) AS s_ts,
        min(b.ts) FILTER (CASE direction WHEN 'bullish' THEN b.close < extreme ELSE b.close > extreme END) AS mitigated_ts FROM ok LEFT JOIN bars_d b ON b.symbol = ok.symbol AND b.ts > ok.ts GROUP BY ALL),
    w AS (SELECT * EXCLUDE (s_ts), CASE WHEN s_ts <= coalesce(mitigated_ts, s_ts) THEN s_ts END AS swept_ts FROM v), x AS (SELECT *, swept_ts IS NOT NULL AND mitigated_ts IS NOT NULL AS breaker FROM w),
    lf AS (SELECT x.*, (SELECT min(b.ts) FROM bars_d b WHERE b.symbol = x.symbol AND breaker AND b.ts >= mitigated_ts AND CASE direction WHEN 'bullish' THEN b.high >= bottom ELSE b.low <= top END) AS retest_ts FROM x)"""


@query(f"{LIFE} SELECT * FROM lf")
def ob_lifecycle(spark, sf):
    b = src.daily(spark, sf)
    return blocks.lifecycle(b, blocks.detect(b)).select(*OB_COLUMNS, "visited_ts", "swept_ts", "mitigated_ts", "breaker", "retest_ts")


@query()
def ob_score(spark, sf):
    b = src.daily(spark, sf)
    n = b.withColumn("n", F.row_number().over(f.series()))
    trend = ms.bias_at_bars(n, ms.events(b), 250).select("symbol", "ts", "trend")
    rose = n.select("symbol", F.col("ts").alias("block_ts"), (F.lead("volume").over(f.series()) > F.col("volume")).alias("rose"))  # the tables have no open interest: volume stands for it
    x = blocks.lifecycle(b, blocks.detect(b)).join(trend, ["symbol", "ts"]).join(rose, ["symbol", "block_ts"])
    return blocks.score(x, F.col("trend"), F.col("rose")).select("symbol", "ts", "direction", "strength", "trend", *r("score"), "confluence", "oi_confirmed")
