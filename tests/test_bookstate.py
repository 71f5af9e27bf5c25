"""Keyed book state over several micro-batches equals one batch window over the same snapshots."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tapeloom.streaming import bookstate, live


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rng, rows = np.random.default_rng(2), []
    for i in range(240):
        rows.append((i, str(rng.choice(["a", "b", "c"])), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(rng.integers(0, 40))))
    ticks = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double")
    for part in range(3):
        ticks.where((F.col("event_id") >= part * 80) & (F.col("event_id") < part * 80 + 80)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.events(spark, str(tmp_path / "in"), batch_bytes=1)
    out = live.drain(bookstate.book_state(bookstate.snapshots(stream)), "append", "book")
    got = {r["event_id"]: r for r in out.collect()}
    assert len({r["batch"] for r in got.values()}) >= 3 and len(got) == 240
    books = bookstate.measured(bookstate.snapshots(ticks)).collect()
    past, before = {}, {}
    for b in sorted(books, key=lambda r: r["ts"]):
        s, r = b["symbol"], got[b["event_id"]]
        past.setdefault(s, []).append(b["obi"])
        seen = past[s][-20:]
        want = None if len(seen) < 10 else (seen[-1] - np.mean(seen)) / np.std(seen, ddof=1)
        assert (r["z"] is None) == (want is None) and (want is None or abs(r["z"] - want) < 1e-9)
        assert r["suspect"] == (b["far"] or (s in before and not set(b["walls"]) <= before[s])) and r["n_walls"] == len(b["walls"])
        before[s] = set(b["walls"])
    assert {r["suspect"] for r in got.values()} == {True, False}
