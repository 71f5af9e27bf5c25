"""Chart readings at every bar: what each detector had told by then, eleven weighted votes, vetoes, entry and stop.

All detectors run once over a series, each event standing at the bar that lets it be known; the last states are found by
one window, or by a fold that keeps the open zones or the last WINDOW bars. Events older than WINDOW bars count no more.
So a reading at every bar costs one pass, and later bars change no reading before them.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import entry_state
from tapeloom.operators import blocks, candles, gaps, structure
from tapeloom.operators import features as f
from tapeloom.operators import signals as sg
from tapeloom.operators.fold import Machine, fold, schema_of
from tapeloom.operators.shapes import Shapes

#: How far back a reading looks, the votes' weights, and the location gate of mean-reverting series.
WINDOW = 250
WEIGHTS = {
    "structure": 0.30, "structure_combo": 0.40, "structure_alone": 0.15, "sweep": 0.30, "sweep_alone": 0.10, "profile": 0.20, "profile_inside": 0.10, "fvg_strong": 0.65, "fvg_normal": 0.45, "fvg_weak": 0.25,
    "block_backed": 0.65, "block": 0.45, "block_again": 0.15, "candle_triple": 0.45, "candle_dual": 0.35, "candle_single": 0.25, "candle_doji": 0.15, "volume": 0.75, "volume_dry": 0.65, "volume_obv": 0.45,
    "pattern_broken": 0.65, "pattern": 0.40, "book": 0.25, "interest": 0.70, "interest_extreme": 0.90, "wyckoff": 0.75,
}
VOTES = ("structure", "liquidity_sweep", "volume_profile", "fvg", "order_block", "candle", "volume", "chart_pattern", "obi", "open_interest", "wyckoff")
BINS, VALUE_SHARE = 50, 0.70
CHASE = 0.6
#: What the bars may bring along for the votes that need more than bars.
BOOK = {"obi_regime": "string", "obi_z": "double", "delta_vamp": "double", "spread_wide": "boolean", "wall_suspect": "boolean"}
INTEREST = {"quadrant": "string", "buildup": "boolean", "squeeze": "boolean", "cascade_long": "boolean", "cascade_short": "boolean", "funding": "string"}
WYCKOFF = {"wyckoff_signal": "string", "wyckoff_phase": "string", "wyckoff_confidence": "double", "spring_low": "double", "range_high": "double"}


def shape_of(bins: np.ndarray, low: float, high: float, close: float, n_bars: int) -> tuple[str, float, float, bool]:
    """(shape, lower and upper end of the value area, flat: nothing can be told) of a profile."""
    if high == low:
        return "D", low, high, True
    size, top, total = (high - low) / len(bins), bins.max(), bins.sum()
    poc = int(bins.argmax())
    lo = hi = poc
    got = bins[poc]
    while got < VALUE_SHARE * total and (lo > 0 or hi < len(bins) - 1):
        above, below = bins[hi + 1] if hi < len(bins) - 1 else -1.0, bins[lo - 1] if lo else -1.0
        if above >= below:
            hi, got = hi + 1, got + above
        else:
            lo, got = lo - 1, got + below
    val, vah = low + lo * size, high if hi == len(bins) - 1 else low + (hi + 1) * size
    if top <= 0 or (top - bins.min()) / top < 0.10:
        return "D", val, vah, top > 0
    if n_bars < 10:
        return "D", val, vah, False
    runs = np.flatnonzero(np.diff(bins, prepend=np.nan, append=np.nan) != 0)  # edges of stretches of equal volume
    peaks = [(a + b - 1) // 2 for a, b in zip(runs, runs[1:], strict=False) if bins[a] >= 0.5 * top and (a == 0 or bins[a - 1] < bins[a]) and (b == len(bins) or bins[b] < bins[a])]
    if len(peaks) == 2:
        valley = peaks[0] + int(bins[peaks[0] : peaks[1] + 1].argmin())
        if bins[valley] / top * 100 <= 20 and bins[:valley].sum() >= 0.1 * total and bins[valley + 1 :].sum() >= 0.1 * total:
            return "B", val, vah, False
    at, centre, last = (low + (poc + 0.5) * size - low) / (high - low), ((vah + val) / 2 - low) / (high - low), (close - low) / (high - low)
    if at >= 0.6 and centre >= 0.55 and last >= 0.5:
        return "P", val, vah, False
    if at <= 0.4 and centre <= 0.45 and last <= 0.5:
        return "b", val, vah, False
    return "D", val, vah, False


class Profile(Machine):
    """The volume profile of the last WINDOW bars at every bar."""

    def __init__(self):
        self.last: deque = deque(maxlen=WINDOW)

    def step(self, row: dict) -> list[dict]:
        self.last.append((row["high"], row["low"], row["close"], row["volume"]))
        h, lo, c, v = np.array(self.last, float).T
        low, high = lo.min(), h.max()
        edge = low + np.arange(BINS + 1) * ((high - low) / BINS)
        edge[-1] = high
        over = np.maximum(np.minimum(h[:, None], edge[None, 1:]) - np.maximum(lo[:, None], edge[None, :-1]), 0)
        span = h - lo
        bins = (v[:, None] * np.divide(over, span[:, None], out=np.zeros_like(over), where=span[:, None] > 0)).sum(0)
        flat = (span == 0) & (high > low)
        if flat.any():
            np.add.at(bins, np.minimum(((c[flat] - low) / (high - low) * BINS).astype(int), BINS - 1), v[flat])
        bins = np.round(bins, 9)  # equal volumes are equal, whatever the order of the sums
        shape, val, vah, nothing = shape_of(bins, low, high, row["close"], len(self.last))
        return [{"n": row["n"], "shape": shape, "val": float(val), "vah": float(vah), "flat": bool(nothing)}]


class OpenZones(Machine):
    """Gaps and order blocks still open at every bar, and what they say for either direction.

    A gap is half filled once its middle is touched and gone once its far end is; only the CAP newest count. A block is
    gone once a bar closes beyond its candle.
    """

    CAP = 50

    def __init__(self):
        self.gaps: list[dict] = []
        self.blocks: list[dict] = []

    def step(self, row: dict) -> list[dict]:
        if (z := row["zone"]) is not None:
            if z["kind"] == "gap":
                self.gaps = [*self.gaps, z | {"half": False, "gone": False}][-self.CAP :]
            else:
                self.blocks = sorted([*self.blocks, z | {"seen": False}], key=lambda b: b["place"])
            return []
        n, high, low, close, trend = row["n"], row["high"], row["low"], row["close"], row["trend"]
        self.gaps = [g for g in self.gaps if n - g["n"] < WINDOW]
        for g in self.gaps:
            if g["n"] < n and not g["gone"]:
                up, mid = g["direction"] == "bullish", (g["bottom"] + g["top"]) / 2
                g["gone"] = low <= g["bottom"] if up else high >= g["top"]
                g["half"] = g["half"] or (low <= mid if up else high >= mid)
        kept = []
        for b in self.blocks:
            up = b["direction"] == "bullish"
            if b["n"] < n:
                b["seen"] = b["seen"] or (low <= b["top"] if up else high >= b["bottom"])
                if close < b["extreme"] if up else close > b["extreme"]:
                    continue
            if n - b["n"] < WINDOW:
                kept.append(b)
        self.blocks = kept
        out = {"n": n}
        for d, bias, other in (("bullish", "BULLISH", "BEARISH"), ("bearish", "BEARISH", "BULLISH")):
            alive = [g for g in self.gaps if g["direction"] == d and not g["gone"]]
            inside = [g for g in alive if not g["half"] and g["n"] < n and g["bottom"] <= close <= g["top"]]
            best = min(inside, key=lambda g: abs((g["bottom"] + g["top"]) / 2 - close), default=None)
            own = [b for b in self.blocks if b["direction"] == d]
            worth = lambda b: max(0.0, (min(1.0, b["strength"] + 0.15) if trend == bias else b["strength"]) - (0.15 if b["seen"] else 0))  # noqa: E731, B023
            hit = max((b for b in own if trend != other and b["bottom"] <= close <= b["top"]), key=worth, default=None)
            weight = None
            if hit is not None:
                weight = max(0.0, (WEIGHTS["block_backed"] if trend == bias and hit["has_gap"] else WEIGHTS["block"]) - (WEIGHTS["block_again"] if hit["seen"] else 0))
            near = min([*alive, *own], key=lambda z: abs((z["bottom"] + z["top"]) / 2 - close), default=None)
            out |= {f"{d}_gap": bool(alive), f"{d}_fvg": best and best["label"], f"{d}_block": weight, f"{d}_low": near and near["bottom"], f"{d}_high": near and near["top"], f"{d}_extreme": own[-1]["extreme"] if own else None}
        return [out]


def gap_labels(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """gaps.marked() with label: strong, weak or normal at the bars that complete a gap."""
    b = gaps.marked(bars).withColumns({"__h2": f.lag("high"), "__l2": f.lag("low"), "__h1": f.lag("high", 2), "__l1": f.lag("low", 2)})
    before = F.collect_list(F.struct("high", "low")).over(f.series().rowsBetween(-2 - lookback, -3))
    top, bottom = F.greatest("high", "__h2", "__h1"), F.least("low", "__l2", "__l1")
    b = b.withColumns({"__top": top, "__bot": bottom, "__before": before})
    held = F.exists("__before", lambda p: (p["high"] >= F.col("__top")) & (p["low"] <= F.col("__bot")))
    strong = F.when(F.col("direction") == "bullish", F.col("close") > F.col("__h2")).otherwise(F.col("close") < F.col("__l2"))
    label = F.when(F.col("direction").isNotNull(), F.when(strong, "strong").when(held, "weak").otherwise("normal"))
    return b.withColumn("label", label).drop("__h2", "__l2", "__h1", "__l1", "__top", "__bot", "__before")


class Divergence:
    """The smoothed volume balance against the last two close pivots of a side: a pivot is known one bar later, and used from the next."""

    def __init__(self, period: int = 20, lookback: int = 20):
        self.k, self.lookback, self.ema = 2 / (period + 1), lookback, None
        self.last: deque = deque(maxlen=3)  # (n, close, ema)
        self.seen = {1: deque(maxlen=3), -1: deque(maxlen=3)}

    def step(self, n: int, close: float, obv: float) -> str:
        self.ema = obv if self.ema is None else self.k * obv + (1 - self.k) * self.ema
        self.last.append((n, close, self.ema))
        if len(self.last) == 3:
            (_, a, _), own, (_, c, _) = self.last
            for side in (1, -1):
                if side * own[1] > side * a and side * own[1] > side * c:
                    self.seen[side].append(own)
        told = {}
        for side in (1, -1):
            pair = [p for p in self.seen[side] if p[0] <= n - 2][-2:]
            told[side] = len(pair) == 2 and pair[0][0] >= n - self.lookback and side * pair[1][1] > side * pair[0][1] and side * pair[1][2] < side * pair[0][2]
        return "bearish" if told[1] else "bullish" if told[-1] else "none"


class LivePools(structure.Sweeps):
    """Sweeps of pools that form on the way: a pivot joins the first pool of its side within tolerance of the pool's first
    pivot, or opens one; and whether a shift has followed a sweep: a close within ``deadline`` bars beyond an internal
    pivot that came after it."""

    def __init__(self, deadline: int = 10, life: int = 50, tolerance: float = structure.EQUAL):
        super().__init__(deadline, life)
        self.tolerance, self.opened, self.swept, self.newest, self.shifted = tolerance, 0, [], None, None

    def add(self, side: str, price: float, n: int) -> None:
        sign = 1 if side == "BSL" else -1
        for own in self.pools:
            if own["sign"] == sign and (own["seed"] == price or abs(own["seed"] - price) / max(own["seed"], price) <= self.tolerance):
                own["price"], own["n"] = sign * max(sign * own["price"], sign * price), n
                return
        self.opened += 1
        self.pools.append({"side": side, "price": price, "n": n, "seq": self.opened, "sign": sign, "wick": None, "seed": price})

    def bar(self, row: dict) -> None:
        n = row["n"]
        for s in self.swept:
            mark = row["m_up"] if s["side"] == "SSL" else row["m_down"]
            if mark is not None and s["n"] < n - 2 <= s["n"] + self.deadline - 2:
                s["marks"].append(mark)
            up = 1 if s["side"] == "SSL" else -1
            if any(up * row["close"] > up * m for m in s["marks"]):
                self.shifted = n
        self.swept = [s for s in self.swept if n < s["n"] + self.deadline]
        for e in super().step(row | {"pool": None}):
            self.newest = {"n": n, "side": e["side"], "wick": e["wick"]}
            self.swept.append({"n": n, "side": e["side"], "marks": []})
        for side, price in (("BSL", row["p_up"]), ("SSL", row["p_down"])):
            if price is not None:
                self.add(side, price, n - 3)


class Reader(Machine):
    """All that feeds back on itself in a reading of one series: structure of both scopes, sweeps, profile, zones, shapes, divergence."""

    def __init__(self):
        self.scopes = {s: structure.Breaks() for s in structure.SCOPES}
        self.known: dict[str, tuple] = {}  # what happened last: (n, value)
        self.pools, self.profile, self.zones, self.extremes, self.divergence, self.shapes = LivePools(), Profile(), OpenZones(), blocks.Extremes(), Divergence(), Shapes()

    def live(self, what: str, n: int):
        at = self.known.get(what)
        return at[1] if at and n - at[0] < WINDOW else None

    def step(self, row: dict) -> list[dict]:
        n, known = row["n"], self.known
        first: dict[str, str] = {}
        for scope, machine in self.scopes.items():
            for e in machine.step(row | row[scope]):
                if e["bias"] != "RANGING":
                    first.setdefault("any", e["bias"])
                if scope == "swing" and e["label"] in ("HL", "LH"):
                    known[e["label"]] = (n, e["level"])
                if e["kind"] not in ("BOS", "CHOCH"):
                    continue
                if "cut" not in first:
                    first["cut"] = e["bias"]
                    known["latest"] = (n, e["kind"])
                if scope == "internal":
                    known[e["kind"]] = (n, True)
                elif e["kind"] == "CHOCH":
                    known["turn"] = (n, e["direction"])
        known |= {k: (n, v) for k, v in first.items()}
        trend = self.live("cut", n) or self.live("any", n) or "RANGING"
        self.pools.bar(row)
        if row["gap"] is not None:
            self.zones.step({"zone": row["gap"] | {"kind": "gap", "n": n}})
        for e in self.extremes.step({"n": n, "close": row["close"], "up": row["m_up"], "down": row["m_down"], "tr": row["tr"]}):
            c = row[e["direction"]]
            if c is not None and c["body"] >= e["atr"]:
                strength = round(c["strength"] + (blocks.STRENGTH["strong"] if c["body"] >= 2 * e["atr"] else 0), 6)
                if strength >= blocks.LEAST:
                    self.zones.step({"zone": c | {"kind": "block", "direction": e["direction"], "n": n, "strength": strength}})
        shown = self.shapes.step(row)
        out = self.zones.step({"zone": None, "n": n, "high": row["high"], "low": row["low"], "close": row["close"], "trend": trend})[0]
        for side, want in (("bull", "bullish"), ("bear", "bearish")):
            best = max((x for x in shown if x["direction"] == want and not x["mitigated"]), key=lambda x: x["strength"], default=None)
            out |= {f"{side}_strength": best and best["strength"], f"{side}_broken": best and best["breakout"]}
        sweep = self.pools.newest
        swept = sweep if sweep and n - sweep["n"] < WINDOW else None
        shifted = self.pools.shifted is not None and n - self.pools.shifted < WINDOW
        return [out | self.profile.step(row)[0] | {
            "ts": row["ts"], "trend": trend, "latest": self.live("latest", n), "latest_swing": self.live("turn", n), "int_bos": bool(self.live("BOS", n)), "int_choch": bool(self.live("CHOCH", n)), "last_hl": self.live("HL", n), "last_lh": self.live("LH", n),
            "sweep": swept and {"side": swept["side"], "wick": swept["wick"]}, "has_mss": shifted, "divergence": self.divergence.step(n, row["close"], row["obv"]),
        }]


def _absent(columns: dict[str, str]) -> dict[str, Column]:
    return {c: F.lit(None).cast(kind) for c, kind in columns.items()}


def told(bars: DataFrame, *, more: DataFrame | None = None) -> DataFrame:
    """bars (symbol, ts, open, ..., volume) with n and all that the votes, vetoes and levels need at each bar.

    Windows over (symbol, ts) first, all from one shuffle and sort, then one fold over the same partitions.
    more: (symbol, ts) with columns of BOOK, INTEREST or WYCKOFF; those it lacks are null and don't vote.
    """
    b = bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    b = blocks.marked(b)
    b = b.withColumns(blocks.candidates(b)).withColumnsRenamed({"up": "m_up", "down": "m_down"}).drop("__bear", "__bull", "__up", "__down", "__low", "__high")
    p = f.pivots(b, 3, 3, strict=False)
    b = p.withColumns({"p_up": f.lag(F.when(F.col("pivot_high"), F.col("high")), 3), "p_down": f.lag(F.when(F.col("pivot_low"), F.col("low")), 3)}).drop("pivot_high", "pivot_low", "confirmed_ts")
    for scope, side in structure.SCOPES.items():
        b = structure.confirmed_pivots(b, side).withColumn(scope, F.struct(F.lit(side).alias("side"), "up", "up_label", "down", "down_label", "geo")).drop("up", "up_label", "down", "down_label", "geo")
    b = sg.volume_bar(candles.last_pattern(b))
    g = gap_labels(b)
    gap = F.when(F.col("direction").isNotNull(), F.struct("direction", "bottom", "top", "label"))
    b = f.true_range(g.withColumn("gap", gap).drop("direction", "bottom", "top", "label", "body_ratio"))
    b = f.range_position(b).withColumns({"candle_before": f.lag("candle"), "atr14": F.avg(F.when(F.col("n") > 1, F.col("tr"))).over(f.last(14))})
    kept = ["symbol", "ts", "open", "high", "low", "close", "volume", "n", "evr", "no_supply_confirmed", "no_demand_confirmed", "vdu", "cmf", "rvol", "candle", "candle_before", "range_position", "atr14"]
    per = ", ".join(f"{d}_gap boolean, {d}_fvg string, {d}_block double, {d}_low double, {d}_high double, {d}_extreme double" for d in ("bullish", "bearish"))
    more_ = "trend string, latest string, latest_swing string, int_bos boolean, int_choch boolean, last_hl double, last_lh double, sweep struct<side:string,wick:double>, has_mss boolean, divergence string, bull_strength double, bull_broken boolean, bear_strength double, bear_broken boolean, shape string, val double, vah double, flat boolean, "
    b = fold(b, ["symbol"], ["n"], lambda: Carried(kept, Reader()), schema_of(b, kept, more_ + per))
    if more is not None:
        b = b.join(more, ["symbol", "ts"], "left")
    return b.withColumns({k: x for k, x in _absent(BOOK | INTEREST | WYCKOFF).items() if k not in b.columns})


class Carried(Machine):
    """A machine of one row a row, with columns of the row beside its own."""

    def __init__(self, kept: list[str], inner: Machine):
        self.kept, self.inner = kept, inner

    def step(self, row: dict) -> list[dict]:
        return [{c: row[c] for c in self.kept} | r for r in self.inner.step(row)]


def _vote(weight: Column | float, direction: Column | int) -> Column:
    return F.struct((F.lit(weight) if isinstance(weight, float) else weight).cast("double").alias("weight"), (F.lit(direction) if isinstance(direction, int) else direction).cast("int").alias("direction"))


def votes(b: DataFrame, direction: str) -> dict[str, Column]:
    """The eleven votes of told() bars for a direction: structs (weight, direction), or null where a detector has none."""
    w, long = WEIGHTS, direction == "long"
    sign, want, against = (1, "bullish", "bearish") if long else (-1, "bearish", "bullish")
    col = F.col
    bias = F.when(col("trend") == "BULLISH", 1).when(col("trend") == "BEARISH", -1).otherwise(0)
    base = F.when(col("int_choch") & col("int_bos"), w["structure_combo"]).otherwise(w["structure"])
    backed = F.when(bias > 0, col("bullish_gap")).otherwise(col("bearish_gap"))
    base = F.when((col("latest") == "CHOCH") & ~backed, F.least(base, F.lit(w["structure_alone"]))).otherwise(base)
    out = {"structure": F.when(bias == 0, _vote(0.0, 0)).otherwise(_vote(base, F.when(bias == sign, 1).otherwise(-1)))}
    swept = F.when(col("sweep.side") == "SSL", 1).otherwise(-1)
    out["liquidity_sweep"] = F.when(col("sweep").isNotNull(), _vote(F.when(col("has_mss"), w["sweep"]).otherwise(w["sweep_alone"]), F.when(swept == sign, 1).otherwise(-1)))
    inside = col("close").between(col("val"), col("vah"))
    weight = F.when((col("shape") == "D") & inside, w["profile_inside"]).otherwise(w["profile"])
    leans = F.when(col("shape") == "P", sign).when(col("shape") == "b", -sign).when(inside, 0).otherwise(1)
    out["volume_profile"] = F.when(~col("flat"), _vote(weight, leans))
    gap = col(f"{want}_fvg")
    out["fvg"] = F.when(gap.isNotNull(), _vote(F.when(gap == "strong", w["fvg_strong"]).when(gap == "weak", w["fvg_weak"]).otherwise(w["fvg_normal"]), 1))
    out["order_block"] = F.when(col(f"{want}_block").isNotNull(), _vote(col(f"{want}_block"), 1))
    now, k = col("candle").isNotNull(), F.coalesce("candle", "candle_before")
    confirmed = ~now & ((col("close") > k["high"]) if long else (col("close") < k["low"]))
    size = F.when(k["strength"] >= 3, w["candle_triple"]).when(k["pattern"].contains("doji") | (k["pattern"] == "spinning_top"), w["candle_doji"]).otherwise(w["candle_dual"])
    told_ = (k["direction"] == want) & ((k["strength"] >= 3) | ((k["strength"] == 2) & confirmed))
    out["candle"] = F.when(k["direction"] == against, _vote(w["candle_single"], -1)).when(told_, _vote(size, 1))
    cmf = col("cmf")
    if long:
        good = col("no_supply_confirmed") & (cmf > 0.05) | col("no_supply_confirmed") & (F.abs(cmf) > 0.25)
        volume = F.when(col("evr") == "absorption", _vote(w["volume"], -1)).when(good, _vote(w["volume"], 1)).when(col("vdu") & (col("rvol") >= 1.5), _vote(w["volume_dry"], 1))
    else:
        volume = F.when(col("no_demand_confirmed") & (cmf < -0.05) & (F.abs(cmf) <= 0.25), _vote(w["volume"], 1))
    out["volume"] = volume.when(col("divergence") == want, _vote(w["volume_obv"], 1))
    side = "bull" if long else "bear"
    out["chart_pattern"] = F.when(col(f"{side}_strength") >= 0.4, _vote(F.when(col(f"{side}_broken"), w["pattern_broken"]).otherwise(w["pattern"]), 1))
    mine, theirs = ("strong_bid", "strong_ask") if long else ("strong_ask", "strong_bid")
    good = (col("obi_regime") == mine) & (sign * col("delta_vamp") > 0) & ~col("spread_wide") & ~col("wall_suspect")
    out["obi"] = F.when(F.abs("obi_z") <= 1, _vote(0.0, 0)).when(good, _vote(w["book"], 1)).when(col("obi_regime") == theirs, _vote(w["book"], -1))
    good = (col("quadrant") == ("new_longs" if long else "new_shorts")) & col("buildup")
    out["open_interest"] = F.when(col("quadrant").isin("short_covering", "long_liquidation"), _vote(0.0, 0)).when(good, _vote(F.when(col("squeeze"), w["interest_extreme"]).otherwise(w["interest"]), 1))
    out["wyckoff"] = F.when(col("wyckoff_phase").isin("C", "D", "E") & (col("wyckoff_confidence") >= 0.4) & (col("wyckoff_signal") == direction), _vote(w["wyckoff"], 1))
    return out


def vetoes(direction: str, mean_reversion: bool = False) -> Column:
    """The first reason that forbids an entry, or null: ranging, an opposed change of character, a cascade, crowding, a chase."""
    long = direction == "long"
    far = F.col("range_position") > CHASE if long else F.col("range_position") < 1 - CHASE
    reason = F.when(F.col("trend") == "RANGING", "ranging").when(F.col("latest_swing") == ("BEARISH" if long else "BULLISH"), "swing_choch")
    reason = reason.when(F.col("cascade_long" if long else "cascade_short"), "cascade").when(F.col("funding") == ("heavy_long" if long else "heavy_short"), "crowded")
    return reason.when(far, "chase") if mean_reversion else reason


def read(b: DataFrame, direction: str = "long", *, mean_reversion: bool = False) -> DataFrame:
    """told() bars with votes (array of name, weight, direction), confluence, veto, decision, the entry zone and the invalidation level."""
    each = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(name).alias("name"), v["weight"].alias("weight"), v["direction"].alias("direction"))) for name, v in votes(b, direction).items()))
    b = b.withColumns({"votes": F.filter(each, lambda x: x.isNotNull()), "veto": vetoes(direction, mean_reversion)})
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["weight"])
    raw = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["weight"] * x["direction"])
    score = F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw / total * 100))).otherwise(0.0)
    long, want = direction == "long", "bullish" if direction == "long" else "bearish"
    b = b.withColumn("score", score).withColumn("decision", entry_state(F.round("score", 9), F.col("veto").isNotNull()))
    pad = 0.5 * F.col("atr14") * (-1 if long else 1)
    block = F.col(f"{want}_extreme") + pad
    now = F.coalesce(*([F.col("spring_low")] if long else []), F.col("sweep.wick") + pad, block)
    level = F.when(F.col("decision") == "ENTER_NOW", now).when(F.col("decision") == "SCALE_IN", F.coalesce(F.col("range_high") * 0.97, block)).when(F.col("decision") == "WAIT", F.col("last_hl" if long else "last_lh"))
    active = F.size(F.filter("votes", lambda x: x["weight"] > 0))
    return b.withColumns({"confluence": F.round("score", 2), "entry_low": F.col(f"{want}_low"), "entry_high": F.col(f"{want}_high"), "invalidation": level, "n_active": active})
