"""Fair-value gaps and the first later bars that hit a zone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import features as f
from tapeloom.operators.fold import Machine, fold


def valid_bar() -> Column:
    return F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))


def marked(bars: DataFrame, *, min_gap_atr: float = 0.15, body_mult: float = 1.15, body_lookback: int = 14, atr_period: int = 14) -> DataFrame:
    """bars with direction, bottom, top, gap and body_ratio at the bars that complete a gap, else nulls.

    Three-bar gaps: the third bar doesn't reach the first, by at least min_gap_atr true ranges, and the middle bar
    moves in the gap's direction with a body above body_mult times the mean of the bodies before it."""
    b = f.true_range(bars)
    body = F.abs(F.col("close") - F.col("open"))
    b = b.withColumns({
        "__n": F.row_number().over(f.series()), "__atr": f.over(F.avg("tr"), atr_period), "__high1": f.lag("high", 2), "__low1": f.lag("low", 2), "__open2": f.lag("open"), "__close2": f.lag("close"),
        "__mean": f.over(F.avg(body), body_lookback, 2),
    })
    bull, bear = F.col("low") > F.col("__high1"), F.col("__low1") > F.col("high")
    b = b.withColumn("direction", F.when((F.col("__n") > 2) & (F.col("__mean") > 0), F.when(bull, "bullish").when(bear, "bearish")))
    up = F.col("direction") == "bullish"
    b = b.withColumns({"bottom": F.when(up, F.col("__high1")).otherwise(F.col("high")), "top": F.when(up, F.col("low")).otherwise(F.col("__low1"))}).withColumn("gap", F.col("top") - F.col("bottom"))
    middle = F.abs(F.col("__close2") - F.col("__open2"))
    moved = F.when(up, F.col("__close2") > F.col("__open2")).otherwise(F.col("__close2") < F.col("__open2"))
    ok = F.coalesce((F.col("gap") >= min_gap_atr * F.col("__atr")) & (middle >= body_mult * F.col("__mean")) & moved, F.lit(False))
    b = b.withColumn("body_ratio", F.when(F.col("__mean") > 0, middle / F.col("__mean")))
    return b.withColumns({c: F.when(ok, F.col(c)) for c in ("direction", "bottom", "top", "gap", "body_ratio")}).drop("tr", "__n", "__atr", "__high1", "__low1", "__open2", "__close2", "__mean")


def detect(bars: DataFrame, **options) -> DataFrame:
    """(symbol, ts, direction, bottom, top, gap, body_ratio): the gaps of marked()."""
    return marked(bars, **options).where("direction IS NOT NULL").select("symbol", "ts", "direction", "bottom", "top", "gap", "body_ratio")


#: Bars whose extremes stand for them: a zone looks into a block only where they allow a hit.
BLOCK = 256
OPS = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


def _first(values: dict[str, np.ndarray], start: np.ndarray, tests: list[tuple[str, str, np.ndarray]]) -> np.ndarray:
    """For each zone the first bar from ``start`` on that meets all tests (bar column, comparison, threshold), or -1."""
    out, n = np.full(len(start), -1), len(next(iter(values.values())))
    left = np.flatnonzero(np.all([~np.isnan(t) for _, _, t in tests], axis=0) & (start < n))
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        live = left[start[left] < end]
        for column, op, limit in tests:
            x = values[column][at:end]
            live = live[OPS[op](x.min() if op[0] == "<" else x.max(), limit[live])]
        if not len(live):
            continue
        ok = np.arange(at, end)[None, :] >= start[live, None]
        for column, op, limit in tests:
            ok &= OPS[op](values[column][at:end][None, :], limit[live, None])
        hit = ok.any(1)
        out[live[hit]] = at + ok.argmax(1)[hit]
        left = left[out[left] < 0]
        if not len(left):
            break
    return out


class Zones(Machine):
    """Zones of one series that wait for their hits. Bars come in batches; each is held against the zones still open.

    Rows of a day: bars first, then the zones that begin to wait behind them.
    """

    def __init__(self, tests: dict[str, list[tuple[str, str]]], columns: list[str]):
        self.tests, self.columns, self.keep = tests, columns, None

    def push(self, batch: pa.RecordBatch) -> list[dict]:
        day = batch.column("__day").to_numpy(zero_copy_only=False)
        zone = batch.column("zone").is_valid().to_numpy(zero_copy_only=False)
        bars, news = np.flatnonzero(~zone), np.flatnonzero(zone)
        fresh = [{"zone": z, "start": int(np.searchsorted(bars, i)), "hit": {}} for i, z in zip(news.tolist(), batch.column("zone").take(pa.array(news)).to_pylist(), strict=True)]
        self.keep = [z | {"start": 0} for z in self.keep or []] + fresh
        values = {c: batch.column(c).to_numpy(zero_copy_only=False)[bars] for c in self.columns}
        if len(bars):
            for n, tests in self.tests.items():
                open_ = [z for z in self.keep if n not in z["hit"]]
                limits = [(c, op, np.array([np.nan if (x := z["zone"][f"__{n}{i}"]) is None else x for z in open_])) for i, (c, op) in enumerate(tests)]
                at = _first(values, np.array([z["start"] for z in open_], int), limits)
                for z, k in zip(open_, at.tolist(), strict=True):
                    if k >= 0:
                        z["hit"][n] = int(day[bars[k]])
        done = [z for z in self.keep if len(z["hit"]) == len(self.tests)]
        self.keep = [z for z in self.keep if len(z["hit"]) < len(self.tests)]
        return [self._told(z) for z in done]

    def close(self) -> list[dict]:
        return [self._told(z) for z in self.keep or []]

    def _told(self, z: dict) -> dict:
        return {k: v for k, v in z["zone"].items() if not k.startswith("__") or k == "__ts"} | {n: z["hit"].get(n) for n in self.tests}


def first_hits(zones: DataFrame, bars: DataFrame, hits: dict[str, list[tuple[str, str, Column]]], keys: tuple[str, ...]) -> DataFrame:
    """Per zone (symbol, ts, *keys) the first later bar that meets all tests of each hit: (bar column, comparison, threshold).

    Thresholds are columns of the zone; a null one is never met. Zones and bars of a series pass through one fold in
    time order: a task holds a batch of bars and the zones still open, and holds these against blocks of bars by the
    blocks' extremes first. No zone is joined with all bars behind it, and no series is held whole.
    """
    limits = {f"__{n}{i}": t for n, tests in hits.items() for i, (_, _, t) in enumerate(tests)}
    columns = sorted({c for tests in hits.values() for c, _, _ in tests})
    z = zones.withColumns(limits).select("symbol", F.unix_date("ts").alias("__day"), "ts", *keys, *(F.col(c).cast("double").alias(c) for c in limits)).dropDuplicates(["symbol", "ts", *keys])
    schema = z.select("symbol", "ts", *keys, *(F.lit(None).cast("int").alias(n) for n in hits)).schema
    z = z.select("symbol", "__day", *(F.lit(None).cast("double").alias(c) for c in columns), F.struct("ts", *keys, *limits).alias("zone"))
    b = bars.select("symbol", F.unix_date("ts").alias("__day"), *(F.col(c).cast("double").alias(c) for c in columns), F.lit(None).cast(z.schema["zone"].dataType).alias("zone"))
    plain = {n: [(c, op) for c, op, _ in tests] for n, tests in hits.items()}
    found = fold(b.unionByName(z), ["symbol"], ["__day", F.col("zone").isNotNull()], lambda: Zones(plain, columns), schema)
    return found.withColumns({n: F.date_from_unix_date(n) for n in hits})


def lifecycle(bars: DataFrame, **options) -> DataFrame:
    """Gaps with the first later touch of their middle, of their far edge, and the first close beyond that edge."""
    up, mid = F.col("direction") == "bullish", (F.col("bottom") + F.col("top")) / 2
    return first_hits_by_side(detect(bars, **options), bars, up, {
        "ce_ts": ([("low", "<=", mid)], [("high", ">=", mid)]),
        "mitigated_ts": ([("low", "<=", F.col("bottom"))], [("high", ">=", F.col("top"))]),
        "inverted_ts": ([("close", "<", F.col("bottom"))], [("close", ">", F.col("top"))]),
    }, ("direction",))


def first_hits_by_side(zones: DataFrame, bars: DataFrame, up: Column, hits: dict[str, tuple[list, list]], keys: tuple[str, ...]) -> DataFrame:
    """first_hits() with one list of tests for the zones where ``up`` holds and one for the others."""
    one = {f"{n}__{k}": [(c, op, F.when(up if not k else ~up, t)) for c, op, t in tests] for n, sides in hits.items() for k, tests in enumerate(sides)}
    return first_hits(zones, bars, one, keys).select("symbol", "ts", *keys, *(F.coalesce(f"{n}__0", f"{n}__1").alias(n) for n in hits))
