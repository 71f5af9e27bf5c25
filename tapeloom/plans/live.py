"""Queries of the streaming operators, run over the whole event table to its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.plans.registry import query
from tapeloom.plans.windows import r
from tapeloom.sources import adapters as src
from tapeloom.streaming import bookstate, live


def ticks(spark, sf):
    return live.events(spark, f"{sf}/events.parquet")


@query("SELECT symbol, ts, open, high, low, close, volume FROM bars_h")
def ss_ohlcv_tumbling(spark, sf):
    rows = live.drain(live.tumbling_bars(ticks(spark, sf)), "update", "tumbling")
    return live.latest(rows, ["symbol", "ts"]).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "volume": F.col("volume").cast("double")})


@query("SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1")
def ss_latest_bars(spark, sf):
    t = ticks(spark, sf).withColumnRenamed("event_type", "symbol")
    rows = live.drain(live.last_rows(t, "symbol", F.struct("ts", "event_id"), ["ts", "value"]), "update", "latest")
    return live.latest(rows, ["symbol"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def ss_bar_upsert(spark, sf):
    t = ticks(spark, sf).select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "ts", "event_id", "value")
    rows = live.drain(t, "append", "upsert")
    w = Window.partitionBy("user_id", "event_type", "day").orderBy(F.desc("batch"), F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "day", "value")


@query("SELECT user_id, count(*) AS n_records, arg_max(event_type, row(ts, event_id)) AS status FROM events GROUP BY 1")
def ss_order_ledger(spark, sf):
    t = ticks(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_records"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return live.latest(live.drain(t, "update", "ledger"), ["user_id"])


def _sizes(a: int, b: int, m: int, r: int) -> str:
    return f"[((event_id * {a} + i * {b}) % 11 + 1 + CASE WHEN event_id % {m} = i THEN 60 ELSE 0 END) * CASE WHEN event_id // 7 % 5 = {r} THEN 6 ELSE 1 END FOR i IN range(1, 11)]"


BOOKS = f"""WITH o AS (SELECT event_type AS symbol, event_id, ts, floor(value / 10) * 10 + 10 AS base, {_sizes(7, 5, 13, 0)} AS b, {_sizes(5, 3, 17, 1)} AS a FROM events),
    q AS (SELECT *, (list_sum(b) - list_sum(a)) / (list_sum(b) + list_sum(a)) AS obi, list_concat([base * 100 + i FOR i IN range(1, 11) IF b[i] > 5 * list_median(b)], [-base * 100 - i FOR i IN range(1, 11) IF a[i] > 5 * list_median(a)]) AS walls FROM o),
    p AS (SELECT *, lag(walls) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM q),
    st AS (SELECT symbol, event_id, obi, CASE WHEN count(*) OVER k >= {{1}} THEN CASE WHEN stddev_samp(obi) OVER k > 1e-12 THEN (obi - avg(obi) OVER k) / stddev_samp(obi) OVER k ELSE 0 END END AS z, CAST(len(walls) AS INT) AS n_walls, before IS NOT NULL AND NOT list_has_all(before, walls) AS suspect
        FROM p WINDOW k AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {{0}} PRECEDING AND CURRENT ROW))"""


@query(f"{BOOKS.format(19, 10)} SELECT symbol, event_id, round(obi, 6) AS obi, round(z, 6) AS z, n_walls, suspect FROM st")
def ss_book_state(spark, sf):
    rows = live.drain(bookstate.book_state(bookstate.snapshots(ticks(spark, sf))), "append", "state")
    return rows.select("symbol", "event_id", *r("obi", "z"), "n_walls", "suspect")


@query(f"""{BOOKS.format(59, 10)}, rg AS (SELECT *, CASE WHEN obi >= 0.6 THEN 'strong_bid' WHEN obi >= 0.2 THEN 'bid' WHEN obi <= -0.6 THEN 'strong_ask' WHEN obi <= -0.2 THEN 'ask' ELSE 'balanced' END AS regime, n_walls > 0 AND NOT suspect AS held FROM st),
    dr AS (SELECT *, CASE WHEN regime = 'balanced' THEN 'NEUTRAL' WHEN abs(round(z, 9)) <= 1 THEN 'WAIT' WHEN obi >= 0.6 AND NOT held THEN 'LONG' WHEN obi <= -0.6 AND NOT held THEN 'SHORT' WHEN abs(obi) >= 0.6 THEN 'WAIT' ELSE 'NEUTRAL' END AS direction FROM rg)
    SELECT symbol, event_id, regime, direction, round(CASE WHEN direction IN ('LONG', 'SHORT') THEN least(1, abs(obi)) ELSE 0 END, 6) AS strength FROM dr""")
def udtf_state(spark, sf):
    rows = live.drain(bookstate.book_state(bookstate.snapshots(ticks(spark, sf)), history=60), "append", "state-long")
    return bookstate.signals(rows.withColumn("z", F.round("z", 9))).select("symbol", "event_id", "regime", "direction", *r("strength"))


@query("""WITH l AS (SELECT * FROM bars_w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), q AS (SELECT symbol, CASE CAST(substr(symbol, 7) AS INT) % 3 WHEN 0 THEN ts WHEN 1 THEN ts + 7 ELSE ts - 7 END AS t, close * 1.05 AS p FROM l)
    SELECT symbol, CASE WHEN t > ts THEN t ELSE ts END AS ts, CASE WHEN t > ts THEN p ELSE open END AS open, CASE WHEN t > ts THEN p WHEN t = ts THEN greatest(high, p) ELSE high END AS high, CASE WHEN t > ts THEN p WHEN t = ts THEN least(low, p) ELSE low END AS low,
    CASE WHEN t >= ts THEN p ELSE close END AS close, CASE WHEN t > ts THEN 0 ELSE volume END AS volume FROM l JOIN q USING (symbol)""")
def ss_quote_overlay(spark, sf):
    row = F.struct("ts", "open", "high", "low", "close", "volume")
    last = src.weekly(spark, sf).groupBy("symbol").agg(F.max_by(row, "ts").alias("r")).select("symbol", "r.*")
    k = F.substring("symbol", 7, 3).cast("int") % 3
    quotes = last.select("symbol", F.when(k == 0, F.col("ts")).when(k == 1, F.date_add("ts", 7)).otherwise(F.date_sub("ts", 7)).alias("ts"), (F.col("close") * 1.05).alias("price"))
    return live.overlay_quotes(last, quotes)


@query("WITH g AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1) SELECT user_id, date_diff('hour', last_ts, (SELECT max(ts) FROM events)) >= 48 AS stale FROM g")
def ss_staleness(spark, sf):
    rows = live.latest(live.drain(ticks(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last_ts")), "update", "age"), ["user_id"])
    now = rows.agg(F.max("last_ts").alias("now"))
    hour = lambda c: F.unix_timestamp(F.date_trunc("hour", c)) / 3600
    return rows.crossJoin(F.broadcast(now)).select("user_id", (hour("now") - hour("last_ts") >= 48).alias("stale"))
