"""Live paths as Structured Streaming: upserts, tumbling bars, latest rows, keyed state.

Sinks are Parquet tables in the shared folder, written batch by batch under the batch's number, so a batch that is
run again replaces its own files. state() and latest() read what the batches have left.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH = 64 << 20  # files of one micro-batch, or a single larger one
#: Where the session names no shared folder (tests): one of our own per application.
_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tapeloom-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: for what several plans read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(spark: SparkSession, path: str, batch_bytes: int = BATCH) -> DataFrame:
    """A Parquet table as a stream, with ts as a timestamp; its schema is read from the files once.

    The path may be a folder or one file: as a pattern it is fit for the file source either way.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run the stream over all that is there now; rows of every batch with its number in column batch."""
    spark = stream.sparkSession
    path, log = shared_path(spark, name), shared_path(spark, f"{name}-log")

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", path).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest batch for each key: what an updating sink holds."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def tumbling_bars(ticks: DataFrame, *, length: str = "1 hour", late: str = "1 day", symbol: str = "event_type", price: str = "value", key: str = "event_id") -> DataFrame:
    """OHLCV bars per event-time window; ticks later than ``late`` behind the newest one are dropped by the watermark."""
    order = F.struct("ts", key)
    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", length), F.col(symbol).alias("symbol"))
    bars = w.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def last_rows(ticks: DataFrame, by: str, order: Column, values: list[str]) -> DataFrame:
    """The newest row per key, as a running aggregate."""
    return ticks.groupBy(by).agg(F.max_by(F.struct(*values), order).alias("row")).select(by, "row.*")


def overlay_quotes(last_bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Last bar per symbol with a quote laid over it: same day widens it, a newer day begins a bar, an older one is ignored."""
    q = quotes.select(F.col("symbol").alias("__s"), F.col("ts").alias("__t"), F.col("price").alias("__p"))
    j = last_bars.join(q, F.col("symbol") == F.col("__s"), "left")
    same, newer = F.col("__t") == F.col("ts"), F.col("__t") > F.col("ts")
    pick = lambda old, new, live: F.when(newer, new).when(same, live).otherwise(old)
    p = F.col("__p")
    return j.select(
        "symbol", pick(F.col("ts"), F.col("__t"), F.col("ts")).alias("ts"), pick(F.col("open"), p, F.col("open")).alias("open"), pick(F.col("high"), p, F.greatest("high", p)).alias("high"),
        pick(F.col("low"), p, F.least("low", p)).alias("low"), pick(F.col("close"), p, p).alias("close"), pick(F.col("volume"), F.lit(0.0), F.col("volume")).alias("volume"),
    )
