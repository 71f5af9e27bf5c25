"""Queries of the text sources: each writes a derived table in the feed's format and reads it through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import catalog as c
from tapeloom.plans.registry import query
from tapeloom.plans.tables import DELIST, delistings
from tapeloom.plans.windows import r
from tapeloom.sources import adapters as src
from tapeloom.sources import formats as fm
from tapeloom.streaming.live import shared_path


def as_csv(df, name: str, sep: str = ",") -> str:
    path = shared_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def as_json(df, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.json(path)
    return path


def as_text(df, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("SELECT symbol, start_date, end_date, 'feed' AS source FROM members")
def src_universe_csv(spark, sf):
    path = as_csv(src.members(spark, sf).select(F.col("symbol").alias("Symbol"), F.col("start_date").alias("Start Date"), F.col("end_date").alias("End Date")), "universe")
    rows = fm.typed(fm.read_csv(spark, path, ("symbol", "start_date")), {"symbol": "string", "start_date": "date", "end_date": "date"})
    return rows.withColumn("source", F.lit("feed"))


@query(f"SELECT * FROM ({DELIST})")
def src_delistings_csv(spark, sf):
    return fm.typed(fm.read_csv(spark, as_csv(delistings(spark, sf), "delistings"), ("symbol", "ts", "return_pct")), {"symbol": "string", "ts": "date", "return_pct": "double"})


@query("SELECT symbol, period_end, known_date, CASE WHEN month(period_end) = 6 THEN NULL ELSE round(revenue, 2) END AS revenue, CAST(NULL AS DOUBLE) AS eps FROM fund_q")
def src_fundamentals_csv(spark, sf):
    q = src.fundamentals(spark, sf).select("symbol", "period_end", "known_date", F.when(F.month("period_end") != 6, F.round("revenue", 2)).alias("revenue"))
    return fm.typed(fm.read_csv(spark, as_csv(q, "fundamentals"), ("symbol", "period_end", "known_date")), {"symbol": "string", "period_end": "date", "known_date": "date", "revenue": "double", "eps": "double"})


@query("SELECT p_partkey AS strike, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS call_bid, p_retailprice + 1 AS call_ask FROM part")
def src_option_quotes_csv(spark, sf):
    p = src.read(spark, sf, "part").select(F.col("p_partkey").alias(" Strike "), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("Call Bid"), (F.col("p_retailprice") + 1).alias("CALL ASK"))
    return fm.typed(fm.read_csv(spark, as_csv(p, "options"), ("strike",)), {"strike": "bigint", "call_bid": "double", "call_ask": "double"})


@query("SELECT c_custkey AS symbol, c_custkey % 3 = 0 AS shortable, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS fee FROM customer")
def src_shortability_csv(spark, sf):
    k = F.col("c_custkey")
    x = src.read(spark, sf, "customer").select(k.alias("symbol"), F.when(k % 3 == 0, F.when(k % 2 == 0, "Yes").otherwise("TRUE")).otherwise(F.when(k % 2 == 0, "no").otherwise("0")).alias("shortable"), F.when(k % 4 > 0, k % 50).alias("fee"))
    rows = fm.read_csv(spark, as_csv(x, "short"), ("symbol", "shortable"))
    return rows.select(F.col("symbol").cast("long").alias("symbol"), fm.truth(F.col("shortable")).alias("shortable"), F.col("fee").cast("double").alias("fee"))


@query("SELECT upper(c_name) AS symbol, c_mktsegment AS sector FROM customer")
def src_sector_csv(spark, sf):
    x = src.read(spark, sf, "customer").select(F.lower("c_name").alias("Symbol"), F.col("c_mktsegment").alias("Sector"))
    return fm.read_csv(spark, as_csv(x, "sectors"), ("symbol", "sector")).select(F.upper("symbol").alias("symbol"), "sector")


@query("SELECT ts, lower(symbol) AS symbol, close FROM bars_d")
def src_marks_csv(spark, sf):
    wide = src.daily(spark, sf).groupBy(F.col("ts").alias("Date")).pivot("symbol", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).agg(F.first("close"))
    rows = fm.unpivot(fm.read_csv(spark, as_csv(wide, "marks"), ("date",)), ["date"], "symbol", "close")
    return fm.typed(rows.withColumnRenamed("date", "ts"), {"ts": "date", "symbol": "string", "close": "double"})


@query("SELECT event_id, ts, investor, net_value, CAST(ts AS TIMESTAMP) + INTERVAL 18 HOUR AS release_ts FROM flows")
def src_flow_csv_long(spark, sf):
    x = src.flows(spark, sf).select("event_id", F.col("ts").alias("Trade Date"), F.col("investor").alias("Investor Type"), F.format_number("net_value", 6).alias("Net"))
    rows = fm.read_csv(spark, as_csv(x, "flows"), ("ts", "investor", "net_value"), aliases={"trade_date": "ts", "investor_type": "investor", "net": "net_value"})
    ts = F.col("ts").cast("date")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), ts.alias("ts"), "investor", fm.number(F.col("net_value")).alias("net_value"), (ts.cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")).alias("release_ts"))


KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT ts, investor, round(sum(net_value), 2) AS net_value FROM flows GROUP BY 1, 2")
def src_flow_csv_wide(spark, sf):
    cell = F.format_number(F.abs(F.round(F.sum("net_value"), 2)), 2)
    wide = src.flows(spark, sf).groupBy(F.col("ts").alias("Date")).pivot("investor", list(KINDS)).agg(F.when(F.sum("net_value") < 0, F.concat(F.lit("("), cell, F.lit(")"))).otherwise(cell))
    rows = fm.unpivot(fm.read_csv(spark, as_csv(wide, "flows-wide"), ("date",)), ["date"], "investor", "net_value")
    return rows.select(F.col("date").cast("date").alias("ts"), "investor", (fm.number(F.col("net_value")) + 0.0).alias("net_value"))


@query("SELECT ts, investor, round(sum(net_value), 4) AS net_value FROM flows GROUP BY 1, 2")
def src_flow_frame(spark, sf):
    wide = src.flows(spark, sf).groupBy("ts").pivot("investor", list(KINDS)).agg(F.round(F.sum("net_value"), 4))
    return fm.unpivot(wide, ["ts"], "investor", "net_value")


@query("SELECT asof_date, round(value, 4) AS value FROM macro_d WHERE series_id = 'view' AND day(asof_date) % 4 > 0")
def src_macro_csv(spark, sf):
    m = src.macro(spark, sf).where("series_id = 'view' AND revision_n = 0").select(F.col("asof_date").alias("DATE"), F.when(F.dayofmonth("asof_date") % 4 > 0, F.round("value", 4).cast("string")).otherwise(".").alias("VALUE"))
    rows = fm.read_csv(spark, as_csv(m, "macro"), ("date", "value"))
    return rows.select(F.col("date").cast("date").alias("asof_date"), fm.number(F.col("value")).alias("value")).where("value IS NOT NULL")


@query("SELECT symbol AS series_id, CAST(date_trunc('month', ts) AS DATE) AS asof_date, round(avg(close), 4) AS value FROM bars_d GROUP BY 1, 2")
def src_macro_json(spark, sf):
    m = src.daily(spark, sf).groupBy(F.col("symbol").alias("series_id"), F.date_format("ts", "yyyyMM").alias("period")).agg(F.round(F.avg("close"), 4).alias("value"))
    path = as_json(m.groupBy("series_id").agg(F.collect_list(F.struct("period", "value")).alias("observations")), "macro-json")
    rows = fm.read_json(spark, path, "series_id string, observations array<struct<period string, value double>>").select("series_id", F.explode("observations").alias("o"))
    return rows.select("series_id", F.to_date(F.concat("o.period", F.lit("01")), "yyyyMMdd").alias("asof_date"), F.col("o.value").alias("value"))


@query("SELECT asof_date, round(value, 4) AS value FROM macro_d WHERE series_id = 'click'")
def src_macro_xml(spark, sf):
    m = src.macro(spark, sf).where("series_id = 'click' AND revision_n = 0").select(F.concat(F.lit("<entry><day>"), F.col("asof_date").cast("string"), F.lit("</day><bc10>"), F.round("value", 4).cast("string"), F.lit("</bc10></entry>")).alias("value"))
    rows = fm.read_xml(spark, as_text(m, "macro-xml"), "day date, bc10 double")
    return rows.select(F.col("day").alias("asof_date"), F.col("bc10").alias("value"))


@query("SELECT series_id, asof_date, round(value, 4) AS value FROM macro_d")
def src_macro_fixedwidth(spark, sf):
    m = src.macro(spark, sf).where("revision_n = 0").select(F.concat(F.rpad("series_id", 12, " "), F.col("asof_date").cast("string"), F.lpad(F.round("value", 4).cast("string"), 14, " ")).alias("value"))
    return fm.fixed_width(spark.read.text(as_text(m, "macro-text")), {"series_id": (1, 12, "string"), "asof_date": (13, 10, "date"), "value": (23, 14, "double")})


@query("SELECT ts AS date, close AS vix FROM bars_d WHERE symbol = 'LARGE'")
def src_vix_csv(spark, sf):
    b = src.daily(spark, sf).where("symbol = 'LARGE'").select(F.date_format("ts", "MM/dd/yyyy").alias("DATE"), F.col("close").alias("CLOSE"))
    return fm.read_csv(spark, as_csv(b, "vix"), ("date", "close")).select(F.to_date("date", "MM/dd/yyyy").alias("date"), F.col("close").cast("double").alias("vix"))


@query("SELECT ts AS date, volume - 2 AS nc_net, 2 - volume AS comm_net, volume AS open_interest FROM bars_w WHERE symbol = 'Brand#7'")
def src_cot_csv(spark, sf):
    b = src.weekly(spark, sf).select(F.col("symbol").alias("Market"), F.col("ts").alias("Report Date"), F.col("volume").alias("NC Long"), F.lit(2).alias("NC Short"), F.lit(2).alias("Comm Long"), F.col("volume").alias("Comm Short"), F.col("volume").alias("Open Interest"))
    x = fm.read_csv(spark, as_csv(b.unionByName(b), "cot"), ("market", "report_date")).where("market = 'Brand#7'")
    d = lambda n: F.col(n).cast("double")
    rows = x.select(F.col("report_date").cast("date").alias("date"), (d("nc_long") - d("nc_short")).alias("nc_net"), (d("comm_long") - d("comm_short")).alias("comm_net"), d("open_interest").alias("open_interest"))
    return rows.where("nc_net IS NOT NULL AND comm_net IS NOT NULL").dropDuplicates(["date"])


@query("SELECT symbol, ts, open * 0.5 AS open, close * 0.5 AS close FROM bars_w WHERE close <> 0 AND volume > 60")
def src_chart_json_bars(spark, sf):
    row = F.struct(F.col("ts").cast("string").alias("t"), "open", "close", (F.col("close") * 0.5).alias("adj"), F.when(F.col("volume") > 60, F.col("volume")).alias("volume"))
    doc = src.weekly(spark, sf).groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("s")).select("symbol", *(F.col(f"s.{k}").alias(k) for k in ("t", "open", "close", "adj", "volume")))
    cols = ["t", "open", "close", "adj", "volume"]
    rows = fm.arrays_to_rows(fm.read_json(spark, as_json(doc, "chart"), "symbol string, t array<date>, open array<double>, close array<double>, adj array<double>, volume array<double>"), ["symbol"], cols)
    rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in cols)).where("close <> 0")
    return rows.select("symbol", F.col("t").alias("ts"), (F.col("open") * (F.col("adj") / F.col("close"))).alias("open"), F.col("adj").alias("close"))


@query("SELECT symbol, ts, open, high, low, close, volume FROM bars_h")
def src_ohlcv_rows(spark, sf):
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    doc = src.intraday(spark, sf).groupBy("symbol").agg(F.collect_list(F.array(ms, "open", "high", "low", "close", "volume")).alias("rows"))
    x = fm.read_json(spark, as_json(doc, "ohlcv"), "symbol string, rows array<array<double>>").select("symbol", F.explode("rows").alias("r"))
    return x.select("symbol", F.timestamp_millis(F.col("r")[0].cast("long")).cast("timestamp_ntz").alias("ts"), *(F.col("r")[i + 1].alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))))


@query("SELECT symbol, ts, CASE WHEN volume > 2 THEN close / 10000 END AS funding_rate FROM bars_h")
def src_funding_rows(spark, sf):
    m = F.create_map(F.lit("symbol"), F.col("symbol"), F.lit("ts"), F.col("ts").cast("string"), F.lit("fundingRate"), F.when(F.col("volume") > 2, (F.col("close") / 10000).cast("string")).otherwise(""))
    x = fm.read_json(spark, as_json(src.intraday(spark, sf).select(m.alias("m")), "funding"), "m map<string, string>")
    return x.select(F.col("m")["symbol"].alias("symbol"), F.col("m")["ts"].cast("timestamp_ntz").alias("ts"), F.expr("try_cast(m['fundingRate'] AS double)").alias("funding_rate"))


@query("SELECT upper(symbol) || '/USDT:USDT' AS symbol, ts, volume AS open_interest FROM bars_h")
def src_oi_rows(spark, sf):
    x = fm.read_json(spark, as_json(src.intraday(spark, sf).select(F.concat(F.col("symbol"), F.lit("/usdt")).alias("pair"), F.col("ts").cast("string").alias("ts"), "volume"), "oi"), "pair string, ts timestamp_ntz, volume double")
    base, quote = F.split(F.upper("pair"), "/")[0], F.split(F.upper("pair"), "/")[1]
    return x.select(F.concat(base, F.lit("/"), quote, F.lit(":"), quote).alias("symbol"), "ts", F.col("volume").alias("open_interest"))


@query("""WITH f AS (SELECT symbol, period_end, known_date AS filed, CASE WHEN month(period_end) = 3 THEN 'SalesRevenueNet' ELSE 'Revenues' END AS tag, round(revenue, 2) AS val, CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form FROM fund_q)
    SELECT symbol, period_end, filed AS known_date, val AS revenue FROM f""")
def src_filings_facts_json(spark, sf):
    q = src.fundamentals(spark, sf).select("symbol", F.col("period_end").alias("end"), F.col("known_date").alias("filed"), F.when(F.month("period_end") == 3, "SalesRevenueNet").otherwise("Revenues").alias("tag"), F.round("revenue", 2).alias("val"), F.when(F.month("period_end") == 12, "10-K").otherwise("10-Q").alias("form"))
    again = q.withColumns({"filed": F.date_add("filed", 30), "val": F.col("val") + 1})  # restated later: the first filed value counts
    other = q.withColumns({"form": F.lit("8-K"), "filed": F.date_sub("filed", 10)})
    facts = q.unionByName(again).unionByName(other).groupBy("symbol").agg(F.collect_list(F.struct("tag", "form", "end", "filed", "val")).alias("facts"))
    x = fm.read_json(spark, as_json(facts, "facts"), "symbol string, facts array<struct<tag string, form string, end date, filed date, val double>>").select("symbol", F.explode("facts").alias("f")).select("symbol", "f.*")
    x = x.where("tag IN ('Revenues', 'SalesRevenueNet') AND (form LIKE '10-K%' OR form LIKE '10-Q%')")
    first = x.groupBy("symbol", F.col("end").alias("period_end")).agg(F.min_by("val", "filed").alias("revenue"), F.min("filed").alias("known_date"))
    return first.select("symbol", "period_end", "known_date", "revenue")


@query("SELECT o_orderkey AS id, o_orderpriority AS owner, o_totalprice AS value FROM orders WHERE o_orderstatus IN ('P', 'F')")
def src_insider_xml(spark, sf):
    o = src.read(spark, sf, "orders").select(F.concat(F.lit("<transaction><id>"), F.col("o_orderkey").cast("string"), F.lit("</id><owner>"), F.col("o_orderpriority"), F.lit("</owner><code>"), F.col("o_orderstatus"), F.lit("</code><value>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</value></transaction>")).alias("value"))
    x = fm.read_xml(spark, as_text(o, "insider"), "id long, owner string, code string, value double")
    return x.where("code IN ('P', 'F')").select("id", "owner", "value")


@query("SELECT o_custkey AS cik, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def src_insider_index(spark, sf):
    o = src.read(spark, sf, "orders").withColumn("form", F.when(F.col("o_orderpriority") == "1-URGENT", "4").when(F.col("o_orderpriority") == "2-HIGH", "4/A").otherwise("8-K"))
    doc = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct("o_orderkey", "form", F.col("o_orderdate").cast("date").alias("filed"))).alias("s")).select("cik", F.col("s.o_orderkey").alias("accession"), F.col("s.form").alias("form"), F.col("s.filed").alias("filed"))
    x = fm.read_json(spark, as_json(doc, "index"), "cik long, accession array<long>, form array<string>, filed array<date>")
    return fm.arrays_to_rows(x, ["cik"], ["accession", "form", "filed"]).where("form IN ('4', '4/A')").drop("form")


@query("SELECT DISTINCT upper(p_name) AS symbol, CASE p_size % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'OTHER' END AS exchange FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 7 <> 2")
def src_listings_pipe(spark, sf):
    k = F.col("p_partkey")
    p = src.read(spark, sf, "part").select(F.col("p_name").alias("Symbol"), F.element_at(F.array(F.lit("N"), F.lit("Q"), F.lit("X")), (F.col("p_size") % 3 + 1).cast("int")).alias("Exchange"), F.when(k % 10 == 3, "Y").otherwise("N").alias("Test Issue"), F.when(k % 7 == 2, "Y").otherwise("N").alias("ETF"))
    x = fm.read_csv(spark, as_csv(p, "listings", "|"), ("symbol", "exchange", "test_issue", "etf"), sep="|").where("test_issue = 'N' AND etf = 'N'")
    return x.select(F.upper("symbol").alias("symbol"), F.when(F.col("exchange") == "N", "NYSE").when(F.col("exchange") == "Q", "NASDAQ").otherwise("OTHER").alias("exchange")).distinct()


@query("SELECT 'S' || s_suppkey AS ticker, s_acctbal AS weight FROM supplier WHERE s_suppkey % 4 <> 1")
def src_holdings_csv(spark, sf):
    s = src.read(spark, sf, "supplier")
    body = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(","), F.when(F.col("s_suppkey") % 4 != 1, "Equity").otherwise("Cash"), F.lit(","), F.col("s_acctbal").cast("string")).alias("value"))
    pre = spark.range(1).select(F.explode(F.array(F.lit("Fund Holdings"), F.lit("as of today"), F.lit("Ticker,Asset Class,Weight"))).alias("value"))
    lines = spark.read.text(as_text(pre.unionByName(body), "holdings"))  # the preamble has no three cells, the header no number
    x = lines.select(F.split("value", ",").alias("p")).where("size(p) = 3").select(F.col("p")[0].alias("ticker"), F.col("p")[1].alias("kind"), F.expr("try_cast(p[2] AS double)").alias("weight"))
    return x.where("kind = 'Equity' AND weight IS NOT NULL").select("ticker", "weight")


@query("SELECT symbol, known_date AS announce_date, 'earnings' AS kind FROM fund_q")
def src_earnings_calendar(spark, sf):
    q = src.fundamentals(spark, sf).select("symbol", F.col("known_date").alias("reportDate"))
    a = fm.read_csv(spark, as_csv(q.where("symbol < 'Brand#2'"), "calendar"), ("symbol", "reportdate"))
    b = fm.read_json(spark, as_json(q.where("symbol >= 'Brand#2'"), "calendar-json"), "symbol string, reportDate date")
    both = a.select("symbol", F.col("reportdate").cast("date").alias("announce_date")).unionByName(b.select("symbol", F.col("reportDate").alias("announce_date")))
    return both.withColumn("kind", F.lit("earnings"))


@query("SELECT event_id, 'T' || (user_id % 20) AS ticker, value AS sentiment FROM events WHERE user_id % 20 < 10")
def src_news_json(spark, sf):
    t = F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string"))
    e = src.read(spark, sf, "events").select("event_id", F.array(F.struct(F.lit("OTHER").alias("symbol"), F.lit(0.0).alias("sentiment")), F.struct(t.alias("symbol"), F.col("value").alias("sentiment"))).alias("entities"))
    x = fm.read_json(spark, as_json(e, "news"), "event_id long, entities array<struct<symbol string, sentiment double>>").select("event_id", F.explode(F.filter("entities", lambda y: y["symbol"].rlike("^T[0-9]$"))).alias("e"))
    return x.select("event_id", F.col("e.symbol").alias("ticker"), F.col("e.sentiment").alias("sentiment"))


@query("WITH k AS (SELECT DISTINCT p_brand AS expiry, p_size AS strike FROM part), c AS (SELECT p_brand AS expiry, p_size AS strike, max(p_retailprice) AS call FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), p AS (SELECT p_brand AS expiry, p_size AS strike, max(p_retailprice) AS put FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2) SELECT expiry, strike, call, put FROM k LEFT JOIN c USING (expiry, strike) LEFT JOIN p USING (expiry, strike)")
def src_option_chain_frames(spark, sf):
    p = src.read(spark, sf, "part").withColumns({"expiry": F.col("p_brand"), "strike": F.col("p_size")})
    side = lambda odd, n: p.where(F.col("p_partkey") % 2 == odd).groupBy("expiry", "strike").agg(F.max("p_retailprice").alias(n))
    return side(0, "call").join(side(1, "put"), ["expiry", "strike"], "full")


@query("SELECT symbol, round(arg_max(revenue, period_end), 2) AS latest, round(arg_max(revenue, period_end) FILTER (period_end < m), 2) AS prior FROM fund_q JOIN (SELECT symbol, max(period_end) AS m FROM fund_q GROUP BY 1) USING (symbol) GROUP BY 1")
def src_fundamentals_info(spark, sf):
    row = F.struct("period_end", F.round("revenue", 2).alias("revenue"))
    doc = src.fundamentals(spark, sf).groupBy("symbol").agg(F.struct(F.sort_array(F.collect_list(row), False).alias("timeseries")).alias("info"))
    x = fm.read_json(spark, as_json(doc, "info"), "symbol string, info struct<timeseries array<struct<period_end date, revenue double>>>")
    t = F.col("info.timeseries")
    return x.select("symbol", t[0]["revenue"].alias("latest"), F.get(t, F.lit(1))["revenue"].alias("prior"))


@query("SELECT count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM bars_d")
def snapshot_write(spark, sf):
    path = shared_path(spark, "snapshot")
    fm.write_snapshot(src.daily(spark, sf), path)
    return fm.read_snapshot(spark, fm.pinned(path)).agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"))


@query("SELECT count(*) AS n, true AS same_in_any_order, false AS same_after_change FROM bars_d")
def snapshot_hash(spark, sf):
    b = src.daily(spark, sf)
    a = fm.content_hash(b)
    shuffled, changed = fm.content_hash(b.repartition(7, "close").withColumn("source", F.lit("x"))), fm.content_hash(b.withColumn("close", F.when(F.col("volume") == F.lit(-1), 0.0).otherwise(F.col("close") + 1e-9)))
    j = a.crossJoin(shuffled.select(F.col("hash").alias("h2"))).crossJoin(changed.select(F.col("hash").alias("h3")))
    return j.select("n", (F.col("hash") == F.col("h2")).alias("same_in_any_order"), (F.col("hash") == F.col("h3")).alias("same_after_change"))


@query("SELECT symbol, ts, close FROM bars_d")
def snapshot_read_verify(spark, sf):
    path = shared_path(spark, "snapshot")
    fm.write_snapshot(src.daily(spark, sf).select("symbol", "ts", "close"), path)
    return fm.read_snapshot(spark, path)


@query("SELECT symbol, count(*) AS n FROM bars_d GROUP BY 1")
def pinned_guard(spark, sf):
    path = shared_path(spark, "snapshot")
    fm.write_snapshot(src.daily(spark, sf).select("symbol", "ts"), path)
    try:
        fm.pinned(path.replace("/snapshot-", "/loose-"))
    except ValueError:
        return fm.read_snapshot(spark, fm.pinned(path)).groupBy("symbol").agg(F.count("*").alias("n"))
    raise AssertionError("an unpinned input was accepted")


@query("SELECT symbol, period_end, known_date, CASE WHEN month(period_end) = 9 THEN round(revenue * 1.1, 2) ELSE round(revenue, 2) END AS eps FROM fund_q")
def earnings_upsert(spark, sf):
    e = src.fundamentals(spark, sf).select("symbol", "known_date", "period_end", F.col("revenue").alias("eps"))
    return c.upsert(e, e.where("month(period_end) = 9").withColumn("eps", F.col("eps") * 1.1), ["symbol", "known_date", "period_end"]).select("symbol", "period_end", "known_date", *r("eps", n=2))


@query("SELECT ts, close AS vix FROM bars_d WHERE symbol = 'LARGE' AND NOT ts BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'")
def option_sentiment_upsert(spark, sf):
    v = src.daily(spark, sf).where("symbol = 'LARGE'").select("ts", F.col("close").alias("vix"))
    return c.delete_range(c.upsert(v, v.where("year(ts) = 1997"), ["ts"]), F.lit(True), "ts", "1996-01-01", "1996-01-31")


@query("SELECT symbol, period_end, round(revenue, 2) AS score FROM fund_q ORDER BY period_end DESC, score DESC, symbol LIMIT 40")
def valuation_upsert_scan(spark, sf):
    v = src.fundamentals(spark, sf).select("symbol", "period_end", F.round("revenue", 2).alias("score"))
    return c.upsert(v.withColumn("score", F.lit(0.0)), v, ["symbol", "period_end"]).orderBy(F.desc("period_end"), F.desc("score"), "symbol").limit(40)


@query("SELECT symbol, period_end, 3 AS n_steps, shares_out AS first_price FROM fund_q")
def entry_plan_upsert(spark, sf):
    step = lambda pct: F.struct(F.lit(pct).alias("pct"), (F.col("shares_out") * (1 - pct / 100)).alias("price"))
    e = src.fundamentals(spark, sf).select("symbol", "period_end", F.to_json(F.array(step(0), step(3), step(6))).alias("ladder_json"))
    kept = c.upsert(e.withColumn("ladder_json", F.lit("[]")), e, ["symbol", "period_end"])
    ladder = F.from_json("ladder_json", "array<struct<pct int, price double>>")
    return kept.select("symbol", "period_end", F.size(ladder).alias("n_steps"), ladder[0]["price"].alias("first_price"))
