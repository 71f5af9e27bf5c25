"""Queries of the catalog and of the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import catalog as c
from tapeloom.operators import joins as j
from tapeloom.plans.registry import query
from tapeloom.plans.windows import S, r
from tapeloom.sources import adapters as src
from tapeloom.streaming.live import shared_path

D = "DATE '1996-06-30'"
DAY = "1996-06-30"


#: The bar catalog of each application and input: written once, then scanned.
_CATALOG: dict[tuple[str, str], str] = {}


def bar_catalog(spark, sf):
    """Bars of all series as a table partitioned by market and frequency, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CATALOG:
        path = shared_path(spark, "bars")
        for market, freq, b in (("types", "1d", src.daily(spark, sf)), ("brands", "1w", src.weekly(spark, sf))):
            c.write_partitions(b.withColumns({"market": F.lit(market), "freq": F.lit(freq)}).repartition("symbol").sortWithinPartitions("symbol", "ts"), path, ("market", "freq"))
        _CATALOG[key] = path
    schema = "symbol string, ts date, open double, high double, low double, close double, volume double, market string, freq string"
    return spark.read.schema(schema).parquet(_CATALOG[key])


@query("SELECT symbol, ts, open, high, low, close, volume FROM bars_d WHERE symbol = 'ECONOMY' OR (symbol >= 'S' AND ts BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')")
def bars_scan(spark, sf):
    b = c.scan(bar_catalog(spark, sf), market="types", freq="1d")
    both = c.scan(b, symbol="ECONOMY").unionByName(c.scan(b.where("symbol >= 'S'"), start="1995-01-01", end="1996-12-31"))
    return both.select("symbol", "ts", "open", "high", "low", "close", "volume")


def _revised(b):
    """A second batch for the odd days, at one per cent more."""
    return b.where(F.dayofmonth("ts") % 2 == 1).withColumn("close", F.col("close") * 1.01)


@query("SELECT symbol, ts, CASE WHEN day(ts) % 2 = 1 THEN close * 1.01 ELSE close END AS close, volume FROM bars_d")
def bars_upsert(spark, sf):
    b = src.daily(spark, sf).select("symbol", "ts", "close", "volume")
    return c.upsert(b, _revised(b), ["symbol", "ts"])


@query("SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars_d GROUP BY 1")
def catalog_coverage(spark, sf):
    return c.coverage(src.daily(spark, sf))


@query("SELECT symbol, start_date, CASE WHEN symbol < 'Brand#3' THEN DATE '1997-01-01' ELSE end_date END AS end_date FROM members")
def universe_upsert(spark, sf):
    m = src.members(spark, sf)
    return c.upsert(m, m.where("symbol < 'Brand#3'").withColumn("end_date", F.lit("1997-01-01").cast("date")), ["symbol", "start_date"])


@query("SELECT symbol, start_date, end_date FROM members WHERE symbol >= 'Brand#2'")
def universe_scan(spark, sf):
    return src.members(spark, sf).where("symbol >= 'Brand#2'").select("symbol", "start_date", "end_date")


def delistings(spark, sf):
    """A week after its end every ended member has a terminal return of -30 %."""
    return src.members(spark, sf).where("end_date IS NOT NULL").select("symbol", F.date_add("end_date", 7).alias("ts"), F.lit(-0.30).alias("return_pct"))


DELIST = "SELECT symbol, CAST(end_date + INTERVAL 7 DAY AS DATE) AS ts, -0.30::DOUBLE AS return_pct FROM members WHERE end_date IS NOT NULL"


@query(f"SELECT symbol, ts, CASE WHEN symbol < 'Brand#3' THEN -0.5::DOUBLE ELSE return_pct END AS return_pct FROM ({DELIST})")
def delisting_upsert(spark, sf):
    d = delistings(spark, sf)
    return c.upsert(d, d.where("symbol < 'Brand#3'").withColumn("return_pct", F.lit(-0.5)), ["symbol", "ts"])


@query(f"SELECT * FROM ({DELIST}) WHERE symbol IN ('Brand#12', 'Brand#24', 'Brand#31', 'Brand#33') AND ts <= DATE '2010-01-01'")
def delisting_scan(spark, sf):
    return c.scan(delistings(spark, sf).where(F.col("symbol").isin("Brand#12", "Brand#24", "Brand#31", "Brand#33")), end="2010-01-01")


@query("SELECT symbol, period_end, known_date, round(revenue, 2) AS revenue FROM fund_q UNION ALL SELECT symbol, period_end, CAST(known_date + INTERVAL 30 DAY AS DATE), round(revenue * 1.02, 2) FROM fund_q WHERE month(period_end) = 12")
def fundamentals_upsert(spark, sf):
    q = src.fundamentals(spark, sf)
    restated = q.where(F.month("period_end") == 12).withColumn("known_date", F.date_add("known_date", 30)).withColumn("revenue", F.col("revenue") * 1.02)
    return c.upsert(q, restated, ["symbol", "period_end", "known_date"]).select("symbol", "period_end", "known_date", *r("revenue", n=2))


@query(f"SELECT symbol, period_end, known_date, round(revenue, 2) AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY known_date DESC, period_end DESC) AS n FROM fund_q WHERE known_date <= {D}) WHERE n <= 4")
def fundamentals_asof_topk(spark, sf):
    return c.latest_known(src.fundamentals(spark, sf), ("symbol",), "known_date", ("known_date", "period_end"), DAY, 4).select("symbol", "period_end", "known_date", *r("revenue", n=2))


TRADES = "SELECT 'C' || (o_custkey % 50) AS symbol, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_orderdate + INTERVAL 2 DAY + CASE WHEN o_orderkey % 7 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS DATE) AS asof_ts, o_orderpriority AS insider_name, o_orderstatus AS txn_code, CAST(o_orderkey % 90 AS DOUBLE) AS shares, o_totalprice AS value_usd, CAST(NULL AS DOUBLE) AS price FROM orders"


def trades(spark, sf):
    o = src.read(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), day.alias("txn_date"), F.date_add(day, F.when(F.col("o_orderkey") % 7 == 0, 12).otherwise(2)).alias("asof_ts"),
        F.col("o_orderpriority").alias("insider_name"), F.col("o_orderstatus").alias("txn_code"), (F.col("o_orderkey") % 90).cast("double").alias("shares"), F.col("o_totalprice").alias("value_usd"), F.lit(None).cast("double").alias("price"),
    )


@query(f"SELECT symbol, txn_date, asof_ts, insider_name, txn_code, sum(shares) AS shares, round(sum(value_usd), 2) AS value_usd, CAST(floor(CASE WHEN sum(shares) > 0 THEN sum(value_usd) / sum(shares) END) AS BIGINT) AS price FROM ({TRADES}) GROUP BY 1, 2, 3, 4, 5")
def insider_upsert(spark, sf):
    t = c.merge_executions(trades(spark, sf))
    return c.upsert(t, t, ["symbol", "txn_date", "asof_ts", "insider_name", "txn_code"]).select("symbol", "txn_date", "asof_ts", "insider_name", "txn_code", "shares", *r("value_usd", n=2), F.floor("price").alias("price"))


@query(f"""SELECT symbol, txn_date, insider_name, txn_code, asof_ts, shares FROM (SELECT *, row_number() OVER (PARTITION BY symbol, txn_date, insider_name, txn_code ORDER BY asof_ts DESC) AS n FROM
    (SELECT symbol, txn_date, asof_ts, insider_name, txn_code, sum(shares) AS shares FROM ({TRADES}) GROUP BY 1, 2, 3, 4, 5) WHERE asof_ts <= {D} AND txn_date <= {D}) WHERE n = 1""")
def insider_asof_supersede(spark, sf):
    return c.supersede(c.merge_executions(trades(spark, sf)), DAY).select("symbol", "txn_date", "insider_name", "txn_code", "asof_ts", "shares")


@query("SELECT series_id, asof_date, revision_n, CASE WHEN revision_n = 1 THEN round(value + 1, 6) ELSE round(value, 6) END AS value FROM macro")
def macro_upsert(spark, sf):
    m = src.macro(spark, sf)
    return c.upsert(m, m.where("revision_n = 1").withColumn("value", F.col("value") + 1), ["series_id", "asof_date", "revision_n"]).select("series_id", "asof_date", "revision_n", *r("value"))


LATE = "(SELECT min(asof_date) FROM macro)"


@query(f"SELECT series_id, asof_date, revision_n FROM macro WHERE NOT (series_id = 'click' AND asof_date BETWEEN {LATE} + 5 AND {LATE} + 15)")
def macro_delete_range(spark, sf):
    m = src.macro(spark, sf)
    first = m.agg(F.min("asof_date").alias("__lo"))
    return m.crossJoin(F.broadcast(first)).where(~((F.col("series_id") == "click") & F.col("asof_date").between(F.date_add("__lo", 5), F.date_add("__lo", 15)))).select("series_id", "asof_date", "revision_n")


@query(f"SELECT series_id, asof_date, revision_n, round(value, 6) AS value FROM macro WHERE release_date <= {LATE} + 20")
def macro_asof_scan(spark, sf):
    m = src.macro(spark, sf)
    return m.crossJoin(F.broadcast(m.agg(F.min("asof_date").alias("__lo")))).where(F.col("release_date") <= F.date_add("__lo", 20)).select("series_id", "asof_date", "revision_n", *r("value"))


TRUST = "value_kind = 'reported_value' AND confidence = 'high'"


@query(f"SELECT event_id, symbol, ts, investor, net_value, CASE WHEN {TRUST} THEN 'flows' ELSE 'flow_estimates' END AS route FROM flows")
def flows_route(spark, sf):
    return c.route_flows(src.flows(spark, sf)).select("event_id", "symbol", "ts", "investor", "net_value", "route")


@query(f"SELECT event_id, 'flows' AS held_in FROM flows WHERE {TRUST} UNION ALL SELECT event_id, 'flow_estimates' FROM flows WHERE NOT ({TRUST})")
def flows_quarantine(spark, sf):
    f = src.flows(spark, sf)
    clean, held = c.quarantine(f, f.where(~c.trusted() & (F.col("event_id") % 4 == 0)), ("event_id",))
    return clean.select("event_id", F.lit("flows").alias("held_in")).unionByName(held.select("event_id", F.lit("flow_estimates").alias("held_in")))


@query("SELECT event_id, ts, net_value FROM flows WHERE release_date IS NULL OR release_date <= (SELECT CAST(min(ts) + INTERVAL 10 DAY AS DATE) FROM flows)")
def flows_asof_scan(spark, sf):
    f = src.flows(spark, sf)
    cut = f.agg(F.date_add(F.min("ts"), 10).alias("__cut"))
    return f.crossJoin(F.broadcast(cut)).where(F.col("release_date").isNull() | (F.col("release_date") <= F.col("__cut"))).select("event_id", "ts", "net_value")


@query("SELECT symbol, ts, CASE WHEN hour(ts) = 8 THEN close / 2 ELSE close END AS funding_rate FROM bars_h")
def funding_upsert(spark, sf):
    f = src.intraday(spark, sf).select("symbol", "ts", F.col("close").alias("funding_rate"))
    return c.upsert(f, f.where(F.hour("ts") == 8).withColumn("funding_rate", F.col("funding_rate") / 2), ["symbol", "ts"])


@query("SELECT *, CAST('usd' AS VARCHAR) AS currency, CAST(0 AS DOUBLE) AS mark_price FROM (SELECT symbol, ts, close FROM bars_d)")
def schema_evolve(spark, sf):
    return c.evolve(src.daily(spark, sf).select("symbol", "ts", "close"), {"currency": ("string", "usd"), "mark_price": ("double", 0.0), "close": ("double", None)})


@query("""SELECT b.symbol, b.ts, f.period_end, f.known_date, round(f.revenue, 2) AS revenue FROM bars_w b ASOF LEFT JOIN (SELECT * FROM fund_q) f ON b.symbol = f.symbol AND b.ts >= f.known_date""")
def asof_join_fundamentals(spark, sf):
    out = j.asof_backward(src.weekly(spark, sf).select("symbol", "ts"), src.fundamentals(spark, sf), ("symbol",), "ts", "known_date", ("period_end", "revenue"), ("period_end",))
    return out.select("symbol", "ts", "fact.period_end", F.col("fact.known").alias("known_date"), F.round("fact.revenue", 2).alias("revenue"))


SPARSE = "SELECT symbol, ts, close FROM bars_d WHERE day(ts) <= 3"


@query(f"""WITH gp AS (SELECT symbol, date_diff('day', min(ts) FILTER (n = 1), min(ts) FILTER (n = 2)) AS gap FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars_w) GROUP BY 1)
    SELECT b.symbol, b.ts, CASE WHEN date_diff('day', s.ts, b.ts) <= 2 * gap THEN s.close END AS mark FROM bars_w b JOIN gp USING (symbol) ASOF LEFT JOIN (SELECT symbol, ts, close FROM bars_w WHERE month(ts) % 2 = 0) s ON b.symbol = s.symbol AND b.ts >= s.ts""")
def asof_join_stale(spark, sf):
    """Records as of each bar, null where they are older than twice the gap between the series' first two bars."""
    b = src.weekly(spark, sf).select("symbol", "ts", "close")
    out = j.asof_backward(b.select("symbol", "ts"), b.where(F.month("ts") % 2 == 0), ("symbol",), "ts", "ts", ("close",))
    w = Window.partitionBy("symbol").orderBy("ts")
    gaps = b.withColumns({"__n": F.row_number().over(w), "__gap": F.datediff("ts", F.lag("ts").over(w))}).where("__n = 2").select("symbol", "__gap")
    return out.join(gaps, "symbol", "left").select("symbol", "ts", F.when(F.datediff("ts", "fact.known") <= 2 * F.col("__gap"), F.col("fact.close")).alias("mark"))


@query(f"SELECT b.symbol, b.ts, s.close AS mark, s.ts AS mark_ts FROM bars_d b ASOF JOIN ({SPARSE}) s ON b.symbol = s.symbol AND b.ts >= s.ts WHERE date_diff('day', s.ts, b.ts) <= 5")
def asof_marks_stale(spark, sf):
    b = src.daily(spark, sf).select("symbol", "ts", "close")
    out = j.asof_backward(b.select("symbol", "ts"), b.where(F.dayofmonth("ts") <= 3), ("symbol",), "ts", "ts", ("close",))
    return out.where(F.datediff("ts", "fact.known") <= 5).select("symbol", "ts", F.col("fact.close").alias("mark"), F.col("fact.known").alias("mark_ts"))


@query("SELECT b.ts, m.series_id, m.asof_date, round(m.value, 6) AS value FROM (SELECT DISTINCT series_id, asof_date + 1 AS ts FROM macro_d) b ASOF JOIN (SELECT * FROM macro_d WHERE day(asof_date) % 3 = 0) m ON b.series_id = m.series_id AND b.ts >= m.asof_date")
def asof_observation(spark, sf):
    m = src.macro(spark, sf).where("revision_n = 0").select("series_id", "asof_date", "value")
    dates = m.select("series_id", F.date_add("asof_date", 1).alias("ts"))
    out = j.asof_backward(dates, m.where(F.dayofmonth("asof_date") % 3 == 0), ("series_id",), "ts", "asof_date", ("value",)).where("fact IS NOT NULL")
    return out.select("ts", "series_id", F.col("fact.known").alias("asof_date"), F.round("fact.value", 6).alias("value"))


@query("SELECT f.symbol, f.known_date, b.ts, b.close FROM fund_q f ASOF LEFT JOIN bars_w b ON f.symbol = b.symbol AND f.known_date <= b.ts")
def asof_forward_price(spark, sf):
    out = j.asof_forward(src.fundamentals(spark, sf).select("symbol", "known_date"), src.weekly(spark, sf), ("symbol",), "known_date", "ts", ("close",))
    return out.select("symbol", "known_date", F.col("fact.known").alias("ts"), F.col("fact.close").alias("close"))


@query("SELECT f.symbol, f.known_date, b.ts, b.close FROM fund_q f ASOF LEFT JOIN bars_w b ON f.symbol = b.symbol AND f.known_date >= b.ts")
def asof_price_date(spark, sf):
    out = j.asof_backward(src.fundamentals(spark, sf).select("symbol", "known_date"), src.weekly(spark, sf), ("symbol",), "known_date", "ts", ("close",))
    return out.select("symbol", "known_date", F.col("fact.known").alias("ts"), F.col("fact.close").alias("close"))


@query("SELECT DISTINCT d.ts, m.symbol FROM (SELECT DISTINCT ts FROM bars_w) d JOIN members m ON m.start_date <= d.ts AND (m.end_date IS NULL OR d.ts <= m.end_date)")
def interval_membership(spark, sf):
    return j.members_on(src.weekly(spark, sf).select("ts").distinct(), src.members(spark, sf))


@query(f"SELECT d.symbol, c.ts, d.ts AS exit_ts, return_pct FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT ts FROM bars_w)) c JOIN ({DELIST}) d ON d.ts > c.ts AND d.ts <= c.next_ts")
def interval_delisting(spark, sf):
    from pyspark.sql import Window

    cal = src.weekly(spark, sf).select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))
    d = delistings(spark, sf).withColumnRenamed("ts", "exit_ts")
    return cal.join(d, (F.col("exit_ts") > F.col("ts")) & (F.col("exit_ts") <= F.col("next_ts"))).select("symbol", "ts", "exit_ts", "return_pct")


HELD = "SELECT b.* FROM bars_w b JOIN members m ON b.symbol = m.symbol AND (m.end_date IS NULL OR b.ts <= m.end_date)"


@query(f"""WITH h AS ({HELD}), c AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT ts FROM h)), d AS ({DELIST})
    SELECT h.symbol, h.ts, c.next_ts, round(coalesce(n.close / h.close - 1, d.return_pct), 6) AS ret, c.next_ts IS NOT NULL AND coalesce(n.close / h.close - 1, d.return_pct) IS NULL AS problem
    FROM h JOIN c ON h.ts = c.ts LEFT JOIN h n ON n.symbol = h.symbol AND n.ts = c.next_ts LEFT JOIN d ON d.symbol = h.symbol AND d.ts > h.ts AND d.ts <= c.next_ts""")
def holding_return_join(spark, sf):
    m = src.members(spark, sf).select(F.col("symbol").alias("__m"), "end_date")
    held = src.weekly(spark, sf).join(m, (F.col("symbol") == F.col("__m")) & (F.col("end_date").isNull() | (F.col("ts") <= F.col("end_date")))).select("symbol", "ts", "close")
    return j.holding_returns(held, delistings(spark, sf)).select("symbol", "ts", "next_ts", *r("ret"), "problem")


@query(f"WITH x AS (SELECT symbol, ts, close, lag(close) OVER ({S}) AS c0, lag(ts) OVER ({S}) AS t0 FROM bars_w) SELECT symbol, x.ts, round(close / c0 - 1 - (b.bench / a.bench - 1), 6) AS excess FROM x JOIN bench_w a ON a.ts = x.t0 JOIN bench_w b ON b.ts = x.ts")
def benchmark_join(spark, sf):
    from tapeloom.operators import features as f

    b = src.weekly(spark, sf).withColumns({"c0": f.lag("close"), "t0": f.lag("ts")})
    m = src.benchmark(spark, sf)
    x = b.join(m, "ts").join(m.select(F.col("ts").alias("t0"), F.col("bench").alias("bench0")), "t0")
    return x.select("symbol", "ts", F.round(F.col("close") / F.col("c0") - 1 - (F.col("bench") / F.col("bench0") - 1), 6).alias("excess"))


@query("SELECT a.ts, a.close AS close_a, b.close AS close_b FROM bars_w a JOIN bars_w b ON a.ts = b.ts WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#12' AND a.close > 0 AND b.close > 0 QUALIFY row_number() OVER (ORDER BY a.ts DESC) <= 100")
def pair_align(spark, sf):
    b = src.weekly(spark, sf).where("close > 0")
    side = lambda s, n: b.where(F.col("symbol") == s).select("ts", F.col("close").alias(n))
    return side("Brand#11", "close_a").join(side("Brand#12", "close_b"), "ts").orderBy(F.desc("ts")).limit(100)


@query(f"WITH x AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM bars_w) SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr FROM x a JOIN x b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def all_pairs_join(spark, sf):
    from tapeloom.operators import features as f

    x = f.returns(src.weekly(spark, sf)).where("ret IS NOT NULL").select("symbol", "ts", "ret")
    y = x.select(F.col("symbol").alias("symbol_b"), "ts", F.col("ret").alias("rb"))
    return x.withColumnRenamed("symbol", "symbol_a").join(y, "ts").where("symbol_a < symbol_b").groupBy("symbol_a", "symbol_b").agg(F.count("*").alias("n"), F.round(F.corr("ret", "rb"), 6).alias("corr"))


@query("SELECT k AS lookback, n AS top_n, w AS rebalance, count(*) AS weeks FROM (SELECT DISTINCT ts FROM bars_w), (SELECT unnest([4, 12, 26]) AS k), (SELECT unnest([3, 7]) AS n), (SELECT unnest([1, 4]) AS w) GROUP BY 1, 2, 3")
def grid_cross_join(spark, sf):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (4, 12, 26)))).alias("lookback")).select("*", F.explode(F.array(F.lit(3), F.lit(7))).alias("top_n")).select("*", F.explode(F.array(F.lit(1), F.lit(4))).alias("rebalance"))
    return src.weekly(spark, sf).select("ts").distinct().crossJoin(F.broadcast(grid)).groupBy("lookback", "top_n", "rebalance").agg(F.count("*").alias("weeks"))


@query("""WITH l AS (SELECT symbol, max(period_end) AS latest FROM fund_q GROUP BY 1), x AS (SELECT l.symbol, latest, f.period_end, round(revenue, 2) AS revenue, abs(date_diff('day', f.period_end, latest) - 1095.75) AS gap FROM l JOIN fund_q f USING (symbol))
    SELECT symbol, latest, period_end, revenue FROM x WHERE gap <= 120 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gap, period_end) = 1""")
def nearest_year_join(spark, sf):
    from pyspark.sql import Window

    q = src.fundamentals(spark, sf)
    latest = q.groupBy("symbol").agg(F.max("period_end").alias("latest"))
    x = q.join(latest, "symbol").withColumn("gap", F.abs(F.datediff("latest", "period_end") - 365.25 * 3)).where("gap <= 120")
    return x.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy("gap", "period_end"))).where("__n = 1").select("symbol", "latest", "period_end", *r("revenue", n=2))


@query("SELECT symbol, round(expected, 4) AS expected, round(actual, 4) AS actual FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.v, 0) AS expected, coalesce(b.v, 0) AS actual FROM (SELECT symbol, sum(net_value) AS v FROM flows WHERE event_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT symbol, -sum(net_value) AS v FROM flows WHERE event_id % 2 = 1 GROUP BY 1) b USING (symbol)) WHERE abs(expected - actual) > 1e-6")
def full_outer_reconcile(spark, sf):
    f = src.flows(spark, sf)
    net = lambda odd, sign: f.where(F.col("event_id") % 2 == odd).groupBy("symbol").agg((sign * F.sum("net_value")).alias("v"))
    return j.reconcile(net(0, 1), net(1, -1), "symbol", "v").select("symbol", *r("expected", "actual", n=4))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def anti_unresolved(spark, sf):
    done = src.read(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return src.read(spark, sf, "orders").where("o_orderdate < DATE '1996-01-01'").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT symbol, ts, close FROM bars_w WHERE symbol IN (SELECT symbol FROM members WHERE end_date IS NULL)")
def semi_requested(spark, sf):
    return src.weekly(spark, sf).join(src.members(spark, sf).where("end_date IS NULL"), "symbol", "left_semi").select("symbol", "ts", "close")


@query("SELECT symbol, ts, CASE WHEN substr(symbol, 7, 1) IN ('1', '2', '3') THEN substr(symbol, 7, 1) ELSE '' END AS sector FROM bars_w")
def sector_left_join(spark, sf):
    b = src.weekly(spark, sf).select("symbol", "ts")
    sectors = b.select("symbol").distinct().select("symbol", F.substring("symbol", 7, 1).alias("s")).where("s IN ('1', '2', '3')")
    return b.join(sectors, "symbol", "left").select("symbol", "ts", F.coalesce("s", F.lit("")).alias("sector"))
