"""Queries of the order book, the volume profile and the validation statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import stats as st
from tapeloom.operators import aggregates as a
from tapeloom.operators import crosssection as xs
from tapeloom.operators import features as f
from tapeloom.operators import orderbook as ob
from tapeloom.operators import profile as vp
from tapeloom.plans.registry import query
from tapeloom.plans.selection import COMPOSITE, MOM, composite, mom
from tapeloom.plans.windows import S, r, rows
from tapeloom.sources import adapters as src


def _total(side: str, n: int, w: float) -> str:
    return "(" + " + ".join(f"{side}[{i + 1}].size * {w**i!r}" for i in range(n)) + ")"


def _obi(n: int, w: float) -> str:
    b, k = _total("bids", n, w), _total("asks", n, w)
    return f"({b} - {k}) / ({b} + {k})"


@query(f"SELECT symbol, ts, round({_obi(5, 1.0)}, 6) AS flat, round({_obi(5, 0.5)}, 6) AS weighted FROM book")
def obk_imbalance(spark, sf):
    return src.book(spark, sf).select("symbol", "ts", F.round(ob.imbalance(F.col("bids"), F.col("asks")), 6).alias("flat"), F.round(ob.imbalance(F.col("bids"), F.col("asks"), 5, 0.5), 6).alias("weighted"))


@query("SELECT symbol, ts, round((bids[1].price * asks[1].size + asks[1].price * bids[1].size) / (asks[1].size + bids[1].size) - (bids[1].price + asks[1].price) / 2, 6) AS micro_minus_mid, round((asks[1].price - bids[1].price) / ((bids[1].price + asks[1].price) / 2) * 100, 6) AS spread_pct FROM book WHERE close > 0")
def obk_vamp_spread(spark, sf):
    b, k = F.col("bids"), F.col("asks")
    mid = (b[0]["price"] + k[0]["price"]) / 2
    return src.book(spark, sf).where("close > 0").select("symbol", "ts", F.round(ob.micro_price(b, k) - mid, 6).alias("micro_minus_mid"), F.round(ob.spread_pct(b, k), 6).alias("spread_pct"))


@query("SELECT symbol, ts, list_sum(list_transform(list_filter(bids, lambda x: abs(x.price - close) <= 0.0055 * close), lambda x: x.size)) AS bid_depth, list_sum(list_transform(list_filter(asks, lambda x: abs(x.price - close) <= 0.0055 * close), lambda x: x.size)) AS ask_depth FROM book WHERE close > 0")
def obk_depth(spark, sf):
    return src.book(spark, sf).where("close > 0").select("symbol", "ts", ob.depth(F.col("bids"), F.col("close"), 0.0055).alias("bid_depth"), ob.depth(F.col("asks"), F.col("close"), 0.0055).alias("ask_depth"))


def _walls(times: float, far: float) -> str:
    side = lambda k: f"list_filter({k}, lambda x: x.size > {times} * list_median(list_transform({k}, lambda y: y.size)))"
    seen = lambda k: f"CASE WHEN {k}0 IS NULL THEN false ELSE NOT list_contains({k}0, x.price) END"
    made = lambda k: f"list_transform({k}w, lambda x: {{'side': '{k}', 'price': x.price, 'size': x.size, 'suspect': abs(x.price - mid) > {far} * mid OR {seen(k)}}})"
    return f"""wa AS (SELECT *, (bids[1].price + asks[1].price) / 2 AS mid, {side('bids')} AS bidsw, {side('asks')} AS asksw FROM book),
    wb AS (SELECT *, lag(list_transform(bidsw, lambda x: x.price)) OVER ({S}) AS bids0, lag(list_transform(asksw, lambda x: x.price)) OVER ({S}) AS asks0 FROM wa), wl AS (SELECT *, list_concat({made('bids')}, {made('asks')}) AS walls FROM wb)"""


@query(f"WITH {_walls(1.7, 0.008)}, e AS (SELECT symbol, ts, unnest(walls) AS x FROM wl) SELECT symbol, ts, x.side AS side, x.price AS price, x.size AS size, x.suspect AS suspect FROM e")
def obk_walls(spark, sf):
    return ob.walls(src.book(spark, sf), times=1.7, far=0.008).select("symbol", "ts", F.explode("walls").alias("w")).select("symbol", "ts", "w.*")


@query(f"""WITH {_walls(1.7, 0.008)}, x AS (SELECT *, {_obi(10, 0.5)} AS obi FROM wl WHERE close > 0), z AS (SELECT *, CASE WHEN count(obi) OVER {rows(60)} >= 10 THEN CASE WHEN stddev_samp(obi) OVER {rows(60)} > 1e-12 THEN (obi - avg(obi) OVER {rows(60)}) / stddev_samp(obi) OVER {rows(60)} ELSE 0 END END AS z,
        (bids[1].price * asks[1].size + asks[1].price * bids[1].size) / (asks[1].size + bids[1].size) - mid AS lean, (asks[1].price - bids[1].price) / mid * 100 AS spread, round(obi, 9) AS o FROM x),
    d AS (SELECT *, CASE WHEN spread > 0.5 THEN 'WAIT' WHEN abs(o) < 0.05 THEN 'NEUTRAL' WHEN coalesce(abs(round(z, 9)) <= 1, false) THEN 'WAIT' WHEN o >= 0.1 AND lean > 0 AND len(list_filter(walls, lambda w: w.side = 'asks' AND NOT w.suspect AND abs(w.price - mid) <= 0.01 * mid)) = 0 THEN 'LONG'
        WHEN o <= -0.1 AND lean < 0 AND len(list_filter(walls, lambda w: w.side = 'bids' AND NOT w.suspect AND abs(w.price - mid) <= 0.01 * mid)) = 0 THEN 'SHORT' WHEN abs(o) >= 0.1 THEN 'WAIT' ELSE 'NEUTRAL' END AS direction FROM z)
    SELECT symbol, ts, direction, round(obi, 6) AS obi, round(CASE WHEN direction IN ('LONG', 'SHORT') THEN least(1, abs(obi)) ELSE 0 END, 6) AS strength FROM d""")
def obk_signal(spark, sf):
    x = ob.signal(src.book(spark, sf), wide=0.5, strong=0.1, mild=0.05, times=1.7, far=0.008)  # the derived books lean little
    return x.select("symbol", "ts", "direction", *r("obi", "strength"))


PROFILE = """w AS (SELECT *, year(ts) AS y, min(low) OVER (PARTITION BY symbol, year(ts)) AS wlo, (max(high) OVER (PARTITION BY symbol, year(ts)) - min(low) OVER (PARTITION BY symbol, year(ts))) / 24 AS step FROM bars_d),
    e AS (SELECT *, unnest(generate_series(CAST(least(23, floor((low - wlo) / step)) AS INT), CAST(least(23, floor((high - wlo) / step)) AS INT))) AS bin FROM w WHERE step > 0),
    p AS (SELECT symbol, y AS year, bin, sum(volume * CASE WHEN high > low THEN greatest(0, least(high, wlo + bin * step + step) - greatest(low, wlo + bin * step)) / (high - low) ELSE 1 END) AS volume FROM e GROUP BY 1, 2, 3)"""


def profile(spark, sf):
    return vp.volume_profile(src.daily(spark, sf).withColumn("year", F.year("ts")), ["symbol", "year"])


@query(f"WITH {PROFILE} SELECT symbol, year, bin, round(volume, 4) AS volume FROM p")
def vp_profile(spark, sf):
    return profile(spark, sf).select("symbol", "year", "bin", *r("volume", n=4))


@query(f"WITH {PROFILE} SELECT symbol, year, bin AS poc_bin, round(volume, 4) AS volume FROM p QUALIFY row_number() OVER (PARTITION BY symbol, year ORDER BY round(volume, 6) DESC, bin) = 1")
def vp_poc(spark, sf):
    return vp.point_of_control(profile(spark, sf), ["symbol", "year"]).select("symbol", "year", F.col("bin").alias("poc_bin"), *r("volume", n=4))


@query(f"WITH {PROFILE}, k AS (SELECT *, CASE WHEN volume >= 0.7 * max(volume) OVER (PARTITION BY symbol, year) THEN 'HVN' WHEN volume <= 0.2 * max(volume) OVER (PARTITION BY symbol, year) THEN 'LVN' END AS kind FROM p), q AS (SELECT *, bin - row_number() OVER (PARTITION BY symbol, year, kind ORDER BY bin) AS run FROM k WHERE kind IS NOT NULL) SELECT symbol, year, kind, min(bin) AS first_bin, max(bin) AS last_bin, round(sum(volume), 4) AS volume FROM q GROUP BY symbol, year, kind, run")
def vp_nodes(spark, sf):
    return vp.nodes(profile(spark, sf), ["symbol", "year"]).select("symbol", "year", "kind", "first_bin", "last_bin", *r("volume", n=4))


RET = f"SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w"
def ncdf(z: str) -> str:
    """SQL of stats.normal_cdf, the same rational approximation."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / {2**0.5!r}))"
    half = f"0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {half} ELSE {half} END"


def exact_cdf(x: str, levels: int = 80) -> str:
    """SQL of Phi by its series, to full precision within six deviations and 0 or 1 beyond."""
    inner = "1.0"
    for k in range(2 * levels + 1, 1, -2):
        inner = f"(1 + q / {k} * {inner})"
    return f"(SELECT CASE WHEN zz >= 6 THEN 1 WHEN zz <= -6 THEN 0 ELSE 0.5 + exp(-q / 2) / {(2 * 3.141592653589793) ** 0.5!r} * zz * {inner} END FROM (SELECT {x} AS zz, ({x}) * ({x}) AS q))"


MOMENTS = f"WITH x AS ({RET}), dv AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM x WHERE ret IS NOT NULL), m AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(d ** 3) / avg(d ** 2) ** 1.5 AS skew, avg(d ** 4) / avg(d ** 2) ** 2 AS kurt FROM dv GROUP BY 1)"


def moments(spark, sf):
    x = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), *a.moments("ret"))


@query(f"{MOMENTS}, v AS (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS v FROM m WHERE n > 1), z AS (SELECT *, CASE WHEN v > 0 THEN (sr - 0.02) * sqrt(n - 1) / sqrt(v) END AS z FROM v) SELECT symbol, n, round(sr, 5) AS sr, round(z, 4) AS z, round(coalesce({ncdf('z')}, 0), 5) AS psr FROM z")
def st_psr(spark, sf):
    m = moments(spark, sf).where("n > 1").withColumn("z", st.psr(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), F.lit(0.02)))
    return m.select("symbol", "n", *r("sr", n=5), *r("z", n=4), F.round(F.when(F.col("z").isNull(), 0.0).otherwise(st.normal_cdf(F.col("z"))), 5).alias("psr"))


@query(f"{MOMENTS} SELECT symbol, round(CASE WHEN sr > 0.01 THEN 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (1.6448536269514722 / (sr - 0.01)) ** 2 ELSE 1e300 END, 2) AS needed FROM m")
def st_mintrl(spark, sf):
    m = moments(spark, sf).withColumn("x", st.min_track_record(F.col("sr"), F.col("skew"), F.col("kurt"), F.lit(0.01)))
    return m.select("symbol", F.round(F.least("x", F.lit(1e300)), 2).alias("needed"))


#: Newton steps to the two quantiles of the expected maximum, from the number of trials.
TOP = f"{MOMENTS}, t AS (SELECT stddev_samp(sr) AS sd, count(*)::DOUBLE AS n FROM m), n0 AS (SELECT sd, n, unnest([1 - 1 / n, 1 - 1 / (n * exp(1))]) AS p, 1.5::DOUBLE AS g FROM t)"
for _i in range(8):
    TOP += f", n{_i + 1} AS (SELECT sd, n, p, g - ({exact_cdf('g')} - p) / (exp(-g * g / 2) / {(2 * 3.141592653589793) ** 0.5!r}) AS g FROM n{_i})"
TOP += f", em AS (SELECT any_value(sd) AS sd, any_value(n) AS trials, any_value(sd) * ((1 - {st.EULER!r}) * arg_min(g, p) + {st.EULER!r} * arg_max(g, p)) AS sr0 FROM n8)"


@query(f"{TOP} SELECT trials, round(sd, 6) AS sd, round(sr0, 6) AS expected_max FROM em")
def st_expected_max_sr(spark, sf):
    m = moments(spark, sf).agg(F.stddev_samp("sr").alias("sd"), F.count("*").cast("double").alias("trials"))
    return m.select("trials", *r("sd"), F.round(st.expected_max_sharpe(F.col("sd"), F.col("trials")), 6).alias("expected_max"))


@query(f"{TOP}, z AS (SELECT symbol, sr, sr0, (sr - sr0) * sqrt(m.n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM m, em) SELECT symbol, round(sr, 6) AS sr, round(sr0, 6) AS sr0, round({exact_cdf('z')}, 5) AS dsr FROM z")
def st_dsr(spark, sf):
    m = moments(spark, sf)
    top = m.agg(F.stddev_samp("sr").alias("sd"), F.count("*").cast("double").alias("trials")).select(st.expected_max_sharpe(F.col("sd"), F.col("trials")).alias("sr0"))
    x = m.crossJoin(F.broadcast(top)).withColumn("z", st.psr(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), F.col("sr0")))
    return x.select("symbol", *r("sr", "sr0"), F.round(st.phi("z"), 5).alias("dsr"))


@query(f"SELECT event_id, round((value - 50) / 20, 6) AS x, round({exact_cdf('(value - 50) / 20')}, 6) AS cdf, CASE WHEN abs(value - 50) <= 100 THEN round((value - 50) / 20, 6) END AS ppf FROM events")
def math_normal_cdf_ppf(spark, sf):
    e = src.read(spark, sf, "events").select("event_id", ((F.col("value") - 50) / 20).alias("x"))
    return e.select("event_id", "x", st.phi("x").alias("cdf")).withColumn("ppf", F.when(F.abs("x") <= 5, st.phi_inverse("cdf"))).select("event_id", *r("x", "cdf", "ppf"))


@query()
def st_block_bootstrap(spark, sf):
    return st.block_bootstrap(f.returns(src.weekly(spark, sf)), "symbol", "ret")


PAIRS = f"WITH x AS ({RET}), c AS (SELECT corr(a.ret, b.ret) AS c FROM x a JOIN x b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol)"


@query(f"{PAIRS} SELECT 25 AS n_trials, round(625.0 / (25 + 2 * sum(c * c)), 6) AS effective FROM c")
def st_effective_trials(spark, sf):
    x = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").select("symbol", "ts", "ret")
    p = x.join(x.select(F.col("symbol").alias("other"), "ts", F.col("ret").alias("ro")), "ts").where("symbol < other").groupBy("symbol", "other").agg(F.corr("ret", "ro").alias("corr"))
    return st.effective_trials(p).select("n_trials", *r("effective"))


def _cscv_sql() -> str:
    from itertools import combinations

    masks = ", ".join(f"({i}, {b}, {str(b in own).lower()})" for i, own in enumerate(combinations(range(6), 3)) for b in range(6))
    sr = "CASE WHEN sum(q) / sum(n) - (sum(s) / sum(n)) ** 2 > 1e-18 THEN sum(s) / sum(n) / sqrt(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2) ELSE 0 END"
    return f"""WITH x AS ({RET}), o AS (SELECT symbol, ret, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) * 6.0 / count(*) OVER (PARTITION BY symbol)) AS INT) AS block FROM x WHERE ret IS NOT NULL),
        b AS (SELECT symbol, block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS n FROM o GROUP BY 1, 2), m(split, block, inside) AS (VALUES {masks}), h AS (SELECT split, symbol, inside, {sr} AS sr FROM b JOIN m USING (block) GROUP BY 1, 2, 3),
        z AS (SELECT split, symbol, max(sr) FILTER (inside) AS is_sr, max(sr) FILTER (NOT inside) AS oos_sr FROM h GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(is_sr, 12) DESC, symbol) AS best, rank() OVER (PARTITION BY split ORDER BY round(oos_sr, 12)) AS rk, count(*) OVER (PARTITION BY split) AS n FROM z)
        SELECT split, symbol AS best, round(is_sr, 6) AS is_sr, round(oos_sr, 6) AS oos_sr, round(ln((rk / (n + 1.0)) / (1 - rk / (n + 1.0))), 6) AS logit FROM k WHERE best = 1"""


@query(_cscv_sql())
def st_pbo_cscv(spark, sf):
    return st.cscv(f.returns(src.weekly(spark, sf)), "symbol", "ret", 6).select("split", "best", *r("is_sr", "oos_sr", "logit"))


IC = f"{COMPOSITE}, q AS (SELECT symbol, ts, lead(close, 4) OVER ({S}) / close - 1 AS fwd FROM bars_w), j AS (SELECT ts, symbol, score, fwd FROM y JOIN q USING (ts, symbol) WHERE fwd IS NOT NULL)"


def scored(spark, sf):
    fwd = src.weekly(spark, sf).select("symbol", "ts", (F.lead("close", 4).over(f.series()) / F.col("close") - 1).alias("fwd")).where("fwd IS NOT NULL")
    return composite(spark, sf).join(fwd, ["ts", "symbol"])


def rk(c: str, by: str = "ts") -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query(f"WITH {IC}, k AS (SELECT ts, {rk('score')} AS a, {rk('fwd')} AS b FROM j) SELECT ts, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS ic FROM k GROUP BY 1")
def st_spearman(spark, sf):
    return xs.spearman(scored(spark, sf), "score", "fwd").select("ts", "n", *r("ic"))


@query(f"""WITH {IC}, v AS (SELECT j.*, volume FROM j JOIN bars_w USING (ts, symbol)), k AS (SELECT ts, {rk('score')} AS a, {rk('fwd')} AS b, {rk('volume')} AS c FROM v),
    g AS (SELECT ts, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, count(*) AS n FROM k GROUP BY 1) SELECT ts, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 5) AS partial FROM g WHERE n >= 4 AND abs(ac) < 0.999999 AND abs(bc) < 0.999999""")
def st_partial_spearman(spark, sf):
    v = scored(spark, sf).join(src.weekly(spark, sf).select("ts", "symbol", "volume"), ["ts", "symbol"])
    k = v.select("ts", xs.avg_rank("score").alias("a"), xs.avg_rank("fwd").alias("b"), xs.avg_rank("volume").alias("c"))
    g = k.groupBy("ts").agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"), F.count("*").alias("n")).where("n >= 4 AND abs(ac) < 0.999999 AND abs(bc) < 0.999999")
    return g.select("ts", F.round((F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") ** 2) * (1 - F.col("bc") ** 2)), 5).alias("partial"))


@query(f"WITH {IC}, s AS (SELECT *, substr(symbol, 7, 1) AS sector FROM j), k AS (SELECT ts, sector, {rk('score', 'ts, sector')} AS a, {rk('fwd', 'ts, sector')} AS b FROM s), g AS (SELECT ts, sector, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1, 2) SELECT ts, round(sum(n * ic) / sum(n), 6) AS ic FROM g WHERE n >= 4 AND ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1")
def st_sector_neutral_ic(spark, sf):
    s = scored(spark, sf).withColumn("key", F.struct("ts", F.substring("symbol", 7, 1).alias("sector")))
    g = xs.spearman(s, "score", "fwd", "key", 4).where("ic IS NOT NULL AND NOT isnan(ic)")
    return g.groupBy("key.ts").agg(F.round(F.sum(F.col("n") * F.col("ic")) / F.sum("n"), 6).alias("ic"))


@query(f"WITH {IC}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY ts ORDER BY score, symbol DESC) AS lo, greatest(1, count(*) OVER (PARTITION BY ts) // 10) AS kk FROM j) SELECT ts, round(avg(fwd) FILTER (hi <= kk) - avg(fwd) FILTER (lo <= kk), 6) AS long_short, count(*) AS n FROM k GROUP BY 1")
def st_ic_panel(spark, sf):
    w = Window.partitionBy("ts")
    k = scored(spark, sf).withColumns({"hi": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "lo": F.row_number().over(w.orderBy("score", F.desc("symbol"))), "k": F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 10))})
    pick = lambda side: F.avg(F.when(F.col(side) <= F.col("k"), F.col("fwd")))
    return k.groupBy("ts").agg(F.round(pick("hi") - pick("lo"), 6).alias("long_short"), F.count("*").alias("n"))


@query(f"WITH {IC}, k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY ts ORDER BY score, symbol) - 1) * 5.0 / count(*) OVER (PARTITION BY ts)) AS BIGINT) AS q FROM j) SELECT ts, round(avg(fwd) FILTER (q = 4), 6) AS top, round(avg(fwd), 6) AS universe, round(avg(fwd) FILTER (q = 0), 6) AS bottom FROM k GROUP BY 1")
def xs_residual_bucket(spark, sf):
    k = scored(spark, sf).withColumn("q", xs.quantile("score"))
    pick = lambda q: F.round(F.avg(F.when(F.col("q") == q, F.col("fwd"))), 6)
    return k.groupBy("ts").agg(pick(4).alias("top"), F.round(F.avg("fwd"), 6).alias("universe"), pick(0).alias("bottom"))


@query(f"""WITH cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars_w)), q AS (SELECT symbol, ts, lag(close, 4) OVER ({S}) / lag(close, 56) OVER ({S}) - 1 AS m, lead(close, 4) OVER ({S}) / close - 1 AS fwd FROM bars_w),
    j AS (SELECT ts, symbol, round(m, 9) AS m, fwd FROM q JOIN cal USING (ts) WHERE i >= 56 AND (i - 56) % 4 = 0 AND m IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY m DESC, symbol) AS n, count(*) OVER (PARTITION BY ts) AS names, rank() OVER (PARTITION BY ts ORDER BY m) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY ts ORDER BY round(fwd, 9)) + (count(*) OVER (PARTITION BY ts, round(fwd, 9)) - 1) / 2.0 AS rf FROM j),
    g AS (SELECT ts, avg(fwd) FILTER (n <= 5) AS top, avg(fwd) AS eq, corr(rm, rf) AS ic FROM k WHERE names >= 6 GROUP BY 1)
    SELECT count(*) AS n, round(avg(top) / stddev_samp(top) * sqrt(13), 5) AS long_sharpe, round(avg(eq) / stddev_samp(eq) * sqrt(13), 5) AS bench_sharpe, round(avg(top - eq) * 13, 6) AS excess_ann, round(avg(ic), 6) AS mean_ic, round(avg(CASE WHEN top > eq THEN 1.0 ELSE 0 END), 6) AS win_rate FROM g""")
def st_replication(spark, sf):
    b = src.weekly(spark, sf)
    cal = b.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1).where("i >= 56 AND (i - 56) % 4 = 0").select("ts")
    q = b.select("symbol", "ts", F.round(f.lag("close", 4) / f.lag("close", 56) - 1, 9).alias("m"), (F.lead("close", 4).over(f.series()) / F.col("close") - 1).alias("fwd"))
    by = Window.partitionBy("ts")
    k = q.join(cal, "ts").where("m IS NOT NULL AND fwd IS NOT NULL").withColumn("near", F.round("fwd", 9))
    k = k.withColumns({"n": F.row_number().over(by.orderBy(F.desc("m"), "symbol")), "names": F.count("*").over(by), "rm": xs.avg_rank("m"), "rf": xs.avg_rank("near")}).where("names >= 6")
    g = k.groupBy("ts").agg(F.avg(F.when(F.col("n") <= 5, F.col("fwd"))).alias("top"), F.avg("fwd").alias("eq"), F.corr("rm", "rf").alias("ic"))
    sharpe = lambda c: F.round(F.avg(c) / F.stddev_samp(c) * 13**0.5, 5)
    return g.agg(F.count("*").alias("n"), sharpe("top").alias("long_sharpe"), sharpe("eq").alias("bench_sharpe"), F.round(F.avg(F.col("top") - F.col("eq")) * 13, 6).alias("excess_ann"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg((F.col("top") > F.col("eq")).cast("double")), 6).alias("win_rate"))


TESTS = "WITH g AS (SELECT p_brand AS symbol, count(*)::DOUBLE AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v, count(*) FILTER (p_size > 25)::DOUBLE AS w FROM part GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v, count(*) FILTER (p_size > 25)::DOUBLE AS w FROM part), z AS (SELECT g.symbol, (g.m - t.m) / sqrt(g.v / g.n + t.v / t.n) AS welch, (g.m - 1300) / sqrt(g.v / g.n) AS one_sample, (g.w / g.n - t.w / t.n) / sqrt((g.w + t.w) / (g.n + t.n) * (1 - (g.w + t.w) / (g.n + t.n)) * (1 / g.n + 1 / t.n)) AS prop_z FROM g, t)"


@query(f"{TESTS} SELECT symbol, {', '.join(f'round({c}, 5) AS {c}, round(2 * (1 - ({ncdf(f"abs({c})")})), 5) AS p_{c}' for c in ('welch', 'one_sample', 'prop_z'))} FROM z")
def st_tests(spark, sf):
    p = src.read(spark, sf, "part")
    aggs = lambda k: [F.count("*").cast("double").alias(f"n{k}"), F.avg("p_retailprice").alias(f"m{k}"), F.var_samp("p_retailprice").alias(f"v{k}"), F.count(F.when(F.col("p_size") > 25, 1)).cast("double").alias(f"w{k}")]
    x = p.groupBy(F.col("p_brand").alias("symbol")).agg(*aggs("")).crossJoin(F.broadcast(p.agg(*aggs("2"))))
    pool = (F.col("w") + F.col("w2")) / (F.col("n") + F.col("n2"))
    z = {
        "welch": (F.col("m") - F.col("m2")) / F.sqrt(F.col("v") / F.col("n") + F.col("v2") / F.col("n2")), "one_sample": (F.col("m") - 1300) / F.sqrt(F.col("v") / F.col("n")),
        "prop_z": (F.col("w") / F.col("n") - F.col("w2") / F.col("n2")) / F.sqrt(pool * (1 - pool) * (1 / F.col("n") + 1 / F.col("n2"))),
    }
    return x.withColumns(z).select("symbol", *(c for k in z for c in (F.round(k, 5).alias(k), F.round(2 * (1 - st.normal_cdf(F.abs(F.col(k)))), 5).alias(f"p_{k}"))))


@query("SELECT symbol, w.name, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS ret FROM bars_d JOIN (VALUES ('first', DATE '1995-03-01', DATE '1995-06-30'), ('second', DATE '1997-01-01', DATE '1997-04-30')) w(name, lo, hi) ON ts BETWEEN w.lo AND w.hi GROUP BY 1, 2")
def st_stress_windows(spark, sf):
    w = spark.createDataFrame([("first", "1995-03-01", "1995-06-30"), ("second", "1997-01-01", "1997-04-30")], "name string, lo string, hi string").select("name", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    return src.daily(spark, sf).join(F.broadcast(w), F.col("ts").between(F.col("lo"), F.col("hi"))).groupBy("symbol", "name").agg(F.round(F.max_by("close", "ts") / F.min_by("close", "ts") - 1, 6).alias("ret"))


@query(f"WITH x AS ({RET}), c AS (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 26 AS chunk, ret FROM x WHERE ret IS NOT NULL), g AS (SELECT symbol, chunk, avg(ret) / stddev_samp(ret) AS sr FROM c GROUP BY 1, 2 HAVING count(*) = 26) SELECT symbol, round(var_samp(sr), 6) AS dispersion FROM g GROUP BY 1")
def st_regime_dispersion(spark, sf):
    x = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").withColumn("chunk", F.floor((F.row_number().over(f.series()) - 1) / 26))
    g = x.groupBy("symbol", "chunk").agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr")).where("n = 26")
    return g.groupBy("symbol").agg(F.round(F.var_samp("sr"), 6).alias("dispersion"))


@query("""WITH a AS (SELECT DISTINCT ts FROM bars_w WHERE month(ts) = 6), p AS (SELECT a.ts, count(DISTINCT symbol) AS priced FROM a JOIN bars_w USING (ts) GROUP BY 1), f AS (SELECT a.ts, symbol, count(*) AS n FROM a JOIN fund_q ON known_date <= a.ts GROUP BY 1, 2), e AS (SELECT f.ts, count(*) AS eligible FROM f JOIN bars_w USING (ts, symbol) WHERE n >= 2 GROUP BY 1)
    SELECT p.ts, priced, coalesce(eligible, 0) AS eligible, round(priced / 25.0, 6) AS priced_share, round(coalesce(eligible, 0) / 25.0, 6) AS eligible_share FROM p LEFT JOIN e USING (ts)""")
def st_survivorship(spark, sf):
    b = src.weekly(spark, sf).where(F.month("ts") == 6).select("ts", "symbol")
    known = src.fundamentals(spark, sf).select(F.col("symbol").alias("s"), "known_date")
    n = b.join(known, (F.col("symbol") == F.col("s")) & (F.col("known_date") <= F.col("ts")), "left").groupBy("ts", "symbol").agg(F.count("known_date").alias("n"))
    today = src.weekly(spark, sf).agg(F.countDistinct("symbol").alias("today"))
    g = n.groupBy("ts").agg(F.count("*").alias("priced"), F.count(F.when(F.col("n") >= 2, 1)).alias("eligible")).crossJoin(F.broadcast(today))
    return g.select("ts", "priced", "eligible", F.round(F.col("priced") / F.col("today"), 6).alias("priced_share"), F.round(F.col("eligible") / F.col("today"), 6).alias("eligible_share"))
