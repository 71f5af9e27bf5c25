"""Order-book state per symbol over a stream of snapshots: the imbalance's history, the walls of the snapshot before, a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeloom.functions.scalars import obi_regime
from tapeloom.operators import orderbook as ob

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, event_id long, obi double, z double, n_walls int, suspect boolean"


def rolling_z(past: np.ndarray, values: np.ndarray, n: int, least: int, chunk: int = 8192) -> np.ndarray:
    """z of each value among the last n, those of ``past`` before it included; NaN with fewer than ``least`` of them, 0 where they don't vary."""
    past = past[len(past) - min(len(past), n - 1) :]
    whole, first = np.concatenate([past, values]), len(past)
    out = np.full(len(whole), np.nan)
    for end in range(max(first, least - 1), min(n - 1, len(whole))):  # frames not yet full
        out[end] = _z(whole[None, : end + 1])[0]
    for at in range(max(n - 1, first), len(whole), chunk):
        stop = min(at + chunk, len(whole))
        out[at:stop] = _z(np.lib.stride_tricks.sliding_window_view(whole[at - n + 1 : stop], n))
    return out[first:]


def _z(frames: np.ndarray) -> np.ndarray:
    sd = frames.std(1, ddof=1) if frames.shape[1] > 1 else np.zeros(len(frames))
    return np.divide(frames[:, -1] - frames.mean(1), sd, out=np.zeros(len(frames)), where=sd > 1e-12)


class BookState(StatefulProcessor):
    """List state: the last ``history`` imbalances. Value state: the walls of the snapshot before. A symbol that stays
    silent for ``idle_ms`` of event time is forgotten by a timer."""

    def __init__(self, history: int, least: int, idle_ms: int):
        self.history, self.least, self.idle_ms = history, least, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "obi double")
        self.before = handle.getValueState("before", "walls array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # a micro-batch of one symbol
        past = [x[0] for x in self.past.get()] if self.past.exists() else []
        before = set(self.before.get()[0]) if self.before.exists() else None
        z = rolling_z(np.array(past, float), p["obi"].to_numpy(float), self.history, self.least)
        suspect = []
        for far, walls in zip(p["far"], p["walls"], strict=True):
            now = set(walls.tolist())
            suspect.append(bool(far) or before is not None and not now <= before)
            before = now
        self.past.put([(float(x),) for x in [*past, *p["obi"].iloc[-self.history :]][-self.history :]])
        self.before.update((sorted(before),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(p["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame({"symbol": key[0], "event_id": p["event_id"].to_numpy(), "obi": p["obi"].to_numpy(), "z": pd.array(pd.Series(z), dtype="Float64"), "n_walls": p["walls"].map(len).astype("int32").to_numpy(), "suspect": suspect})

    def handleExpiredTimer(self, key, timer, expired) -> Iterator[pd.DataFrame]:
        self.past.clear()
        self.before.clear()
        yield pd.DataFrame({"symbol": pd.Series([], dtype="str"), "event_id": pd.Series([], dtype="int64"), "obi": pd.Series([], dtype="float64"), "z": pd.Series([], dtype="float64"), "n_walls": pd.Series([], dtype="int32"), "suspect": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def _above(times: float, median: str):
    return lambda x: x["size"] > times * F.col(median)


def _tick(sign: int):
    return lambda x: (sign * F.round(x["price"] * 10_000)).cast("long")


def measured(books: DataFrame, *, n: int = 10, times: float = 5.0, far: float = 0.02) -> DataFrame:
    """books (symbol, ts, event_id, bids, asks) with obi, walls (price ticks, asks negative) and far: a wall lies off by more than ``far``."""
    mid = (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2
    sides = {"bids": 1, "asks": -1}
    out = books.withColumns({"__mid": mid} | {f"__median_{s}": ob.median_size(F.col(s), n) for s in sides})  # once a row, not once a level
    out = out.withColumns({f"__walls_{s}": F.filter(F.slice(s, 1, n), _above(times, f"__median_{s}")) for s in sides})
    ticks = [F.transform(f"__walls_{s}", _tick(sign)) for s, sign in sides.items()]
    off = F.exists(F.concat(*(f"__walls_{s}" for s in sides)), lambda x: F.abs(x["price"] - F.col("__mid")) > far * F.col("__mid"))
    return out.withColumns({"obi": ob.imbalance(F.col("bids"), F.col("asks"), n), "walls": F.concat(*ticks), "far": off}).drop("__mid", *(f"__{k}_{s}" for s in sides for k in ("median", "walls")))


def book_state(books: DataFrame, *, history: int = 20, least: int = 10, idle_ms: int = 30 * 86_400_000, late: str = "7 days") -> DataFrame:
    """(symbol, event_id, obi, z, n_walls, suspect) of a stream of snapshots (symbol, ts, event_id, bids, asks), by symbol in order of ts.

    z is the imbalance against its last ``history`` ones, null before ``least``; suspect: a wall far off, or absent from
    the snapshot before. The state passes from one micro-batch to the next in the state store; snapshots that come more
    than ``late`` behind the newest one are dropped.
    """
    books.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = measured(books.withWatermark("ts", late)).select("symbol", "ts", "event_id", "obi", "far", "walls")
    return rows.groupBy("symbol").transformWithStateInPandas(BookState(history, least, idle_ms), OUT, "Append", "EventTime")


def signals(states: DataFrame, *, strong: float = 0.6) -> DataFrame:
    """states with regime, direction and strength: with the book's side, beyond one z, and no wall that is not suspect."""
    regime = obi_regime(F.col("obi"))
    calm = F.col("z").isNotNull() & (F.abs("z") <= 1)
    held = (F.col("n_walls") > 0) & ~F.col("suspect")
    d = F.when(regime == "balanced", "NEUTRAL").when(calm, "WAIT").when((F.col("obi") >= strong) & ~held, "LONG").when((F.col("obi") <= -strong) & ~held, "SHORT").when(F.abs("obi") >= strong, "WAIT").otherwise("NEUTRAL")
    return states.withColumns({"regime": regime, "direction": d, "strength": F.when(d.isin("LONG", "SHORT"), F.least(F.lit(1.0), F.abs("obi"))).otherwise(0.0)})


def snapshots(ticks: DataFrame) -> DataFrame:
    """A book of ten levels around each tick; walls come and go by the tick's number. The tables have no quotes."""
    base, k = F.floor(F.col("value") / 10) * 10 + 10, F.col("event_id")
    size = lambda i, a, b, m, push: ((k * a + i * b) % 11 + 1 + F.when(k % m == i, 60).otherwise(0)) * push
    heavy = lambda r: F.when(F.floor(k / 7) % 5 == r, 6).otherwise(1)
    level = lambda i, sign, a, b, m, r: F.struct((base * (1 + sign * 0.001 * i)).alias("price"), size(i, a, b, m, heavy(r)).cast("double").alias("size"))
    bids = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: level(i, -1, 7, 5, 13, 0))
    asks = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: level(i, 1, 5, 3, 17, 1))
    return ticks.select(F.col("event_type").alias("symbol"), "ts", "event_id", bids.alias("bids"), asks.alias("asks"))
