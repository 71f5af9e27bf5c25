"""Readings at every bar: no lookahead, the profile and the open zones against plain Python, each gate and veto on a row of its own."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from tapeloom import plans
from tapeloom.operators import chart
from tests.test_structure import blocks_by_hand, frame, random_bars


@pytest.fixture(scope="module")
def series():
    return {s: rows for s, rows in random_bars(6, 320, seed=21, grid=0.01).items()}


@pytest.fixture(scope="module")
def readings(spark, series):
    return chart.read(chart.told(frame(spark, series))).cache()


def test_later_bars_change_no_reading(spark, series, readings):
    short = {s: rows[:270] for s, rows in series.items()}
    columns = ["symbol", "ts", "decision", "confluence", "trend", "veto", "votes", "entry_low", "entry_high", "invalidation", "n_active"]
    early = chart.read(chart.told(frame(spark, short))).select(*columns).orderBy("symbol", "ts").collect()
    whole = readings.where("n <= 270").select(*columns).orderBy("symbol", "ts").collect()
    assert early == whole
    names = {v["name"] for r in whole for v in r["votes"]}
    assert names >= {"structure", "liquidity_sweep", "volume_profile", "fvg", "order_block", "candle", "volume"}
    assert len({r["decision"] for r in whole}) >= 2


def profile_by_hand(rows):
    low, high = min(r[3] for r in rows), max(r[2] for r in rows)
    size, bins = (high - low) / 50, [0.0] * 50
    for _, _, h, lo, c, v in rows:
        for i in range(50):
            a, b = low + i * size, high if i == 49 else low + i * size + size
            if h > lo:
                bins[i] += v * max(0.0, min(h, b) - max(lo, a)) / (h - lo)
            elif i == min(49, int((c - low) / size)):
                bins[i] += v
    bins = [round(x, 9) for x in bins]
    poc = bins.index(max(bins))
    lo = hi = poc
    while sum(bins[lo : hi + 1]) < 0.7 * sum(bins):
        above, below = bins[hi + 1] if hi < 49 else -1, bins[lo - 1] if lo > 0 else -1
        lo, hi = (lo, hi + 1) if above >= below else (lo - 1, hi)
    return low + lo * size, high if hi == 49 else low + (hi + 1) * size


def gaps_by_hand(rows):
    """Gaps with (place, direction, bottom, top, label); thresholds from the bars before the middle one."""
    out = []
    tr = [rows[0][2] - rows[0][3]] + [max(b[2] - b[3], abs(b[2] - a[4]), abs(b[3] - a[4])) for a, b in zip(rows, rows[1:], strict=False)]
    for i in range(2, len(rows)):
        (_, _, h1, l1, _, _), (_, o2, h2, l2, c2, _), (_, _, h3, l3, c3, _) = rows[i - 2 : i + 1]
        direction = "bullish" if l3 > h1 else "bearish" if l1 > h3 else None
        if not direction:
            continue
        bottom, top = (h1, l3) if direction == "bullish" else (h3, l1)
        atr, bodies = np.mean(tr[max(0, i - 13) : i + 1]), [abs(r[4] - r[1]) for r in rows[max(0, i - 15) : i - 1]]
        moved = c2 > o2 if direction == "bullish" else c2 < o2
        if top - bottom < 0.15 * atr or not bodies or np.mean(bodies) <= 0 or abs(c2 - o2) < 1.15 * np.mean(bodies) or not moved:
            continue
        strong = c3 > h2 if direction == "bullish" else c3 < l2
        held = any(r[2] >= max(h1, h2, h3) and r[3] <= min(l1, l2, l3) for r in rows[max(0, i - 7) : i - 2])
        out.append((i, direction, bottom, top, "strong" if strong else "weak" if held else "normal"))
    return out


def test_profile_and_zones_match_plain_python(series, readings):
    hits = defaultdict(int)
    for r in readings.collect():
        rows, t = series[r["symbol"]], r["n"] - 1
        if t % 4 and r["bullish_block"] is None and r["bearish_block"] is None:
            continue
        past = rows[: t + 1]
        val, vah = profile_by_hand(past[-250:])
        assert (round(r["val"], 6), round(r["vah"], 6)) == (round(val, 6), round(vah, 6))
        found = [g for g in gaps_by_hand(past) if t - g[0] < 250][-50:]
        close = past[-1][4]
        live = []
        for i, d, bottom, top, label in found:
            later, up = past[i + 1 :], d == "bullish"
            gone = any(x[3] <= bottom if up else x[2] >= top for x in later)
            half = any(x[3] <= (bottom + top) / 2 if up else x[2] >= (bottom + top) / 2 for x in later)
            live += [(i, d, bottom, top, label, half)] if not gone else []
        for d in ("bullish", "bearish"):
            assert r[f"{d}_gap"] == any(g[1] == d for g in live)
            inside = [g for g in live if g[1] == d and not g[5] and g[0] < t and g[2] <= close <= g[3]]
            best = min(inside, key=lambda g: abs((g[2] + g[3]) / 2 - close), default=None)
            assert r[f"{d}_fvg"] == (best and best[4])
            hits["fvg"] += best is not None
            # (ts, direction, bottom, top, extreme, block_ts, strength, gap, visited, swept, mitigated, ...)
            blocks = [b for b in blocks_by_hand(past) if b[1] == d and b[10] is None and (past[-1][0] - b[0]).days < 250]
            bias, other = ("BULLISH", "BEARISH") if d == "bullish" else ("BEARISH", "BULLISH")
            near = sorted((b for b in blocks if r["trend"] != other and b[2] <= close <= b[3]), key=lambda b: b[5])
            worth = lambda b: max(0.0, min(1.0, b[6] + 0.15 * (r["trend"] == bias)) - 0.15 * (b[8] is not None))  # noqa: E731, B023
            hit = max(near, key=worth, default=None)
            want = None if hit is None else (0.65 if r["trend"] == bias and hit[7] else 0.45) - 0.15 * (hit[8] is not None)
            assert (r[f"{d}_block"] is None) == (want is None) and (want is None or abs(r[f"{d}_block"] - want) < 1e-9)
            hits["block"] += hit is not None
    assert hits["fvg"] > 3 and hits["block"] > 0


BASE = {
    "trend": "BULLISH", "latest": "BOS", "latest_swing": None, "int_bos": False, "int_choch": False, "bullish_gap": False, "bearish_gap": False, "has_mss": False, "shape": "D", "val": 1.0, "vah": 2.0, "close": 1.5, "flat": False,
    "bullish_fvg": None, "bearish_fvg": None, "bullish_block": None, "bearish_block": None, "evr": "neutral", "no_supply_confirmed": False, "no_demand_confirmed": False, "vdu": False, "cmf": 0.0, "rvol": 1.0, "divergence": "none",
    "bull_strength": None, "bull_broken": None, "bear_strength": None, "bear_broken": None, "obi_regime": None, "obi_z": None, "delta_vamp": None, "spread_wide": None, "wall_suspect": None, "quadrant": None, "buildup": None, "squeeze": None,
    "cascade_long": None, "cascade_short": None, "funding": None, "wyckoff_signal": None, "wyckoff_phase": None, "wyckoff_confidence": None, "range_position": 0.5,
}
PATTERN = {"bull_strength": "double", "bull_broken": "boolean", "bear_strength": "double", "bear_broken": "boolean"}
CASES = [
    ({}, {"structure": (0.3, 1), "volume_profile": (0.1, 0)}), ({"trend": "RANGING"}, {"structure": (0.0, 0)}), ({"trend": "BEARISH"}, {"structure": (0.3, -1)}), ({"int_bos": True, "int_choch": True}, {"structure": (0.4, 1)}),
    ({"latest": "CHOCH"}, {"structure": (0.15, 1)}), ({"latest": "CHOCH", "bullish_gap": True}, {"structure": (0.3, 1)}), ({"sweep": "SSL"}, {"liquidity_sweep": (0.1, 1)}), ({"sweep": "BSL", "has_mss": True}, {"liquidity_sweep": (0.3, -1)}),
    ({"shape": "P"}, {"volume_profile": (0.2, 1)}), ({"shape": "b"}, {"volume_profile": (0.2, -1)}), ({"shape": "B", "close": 3.0}, {"volume_profile": (0.2, 1)}), ({"flat": True}, {"volume_profile": None}),
    ({"bullish_fvg": "strong"}, {"fvg": (0.65, 1)}), ({"bullish_fvg": "weak"}, {"fvg": (0.25, 1)}), ({"bearish_fvg": "strong"}, {"fvg": None}), ({"bullish_block": 0.5}, {"order_block": (0.5, 1)}),
    ({"candle": ("hammer", "bullish", 3)}, {"candle": (0.45, 1)}), ({"candle": ("hammer", "bullish", 2)}, {"candle": None}), ({"before": ("hammer", "bullish", 2)}, {"candle": (0.35, 1)}), ({"candle": ("hanging_man", "bearish", 1)}, {"candle": (0.25, -1)}),
    ({"before": ("dragonfly_doji", "bullish", 2)}, {"candle": (0.15, 1)}), ({"candle": ("doji", "neutral", 3)}, {"candle": None}), ({"evr": "absorption"}, {"volume": (0.75, -1)}), ({"no_supply_confirmed": True, "cmf": 0.1}, {"volume": (0.75, 1)}),
    ({"no_supply_confirmed": True}, {"volume": None}), ({"divergence": "bullish"}, {"volume": (0.45, 1)}), ({"vdu": True, "rvol": 2.0}, {"volume": (0.65, 1)}), ({"bull_strength": 0.5, "bull_broken": True}, {"chart_pattern": (0.65, 1)}),
    ({"bull_strength": 0.3, "bull_broken": True}, {"chart_pattern": None}), ({"obi_z": 0.5, "obi_regime": "strong_bid"}, {"obi": (0.0, 0)}), ({"obi_z": 2.0, "obi_regime": "strong_ask"}, {"obi": (0.25, -1)}),
    ({"obi_z": 2.0, "obi_regime": "strong_bid", "delta_vamp": 0.1, "spread_wide": False, "wall_suspect": False}, {"obi": (0.25, 1)}), ({"obi_z": 2.0, "obi_regime": "strong_bid", "delta_vamp": 0.1, "spread_wide": True, "wall_suspect": False}, {"obi": None}),
    ({"quadrant": "new_longs", "buildup": True, "squeeze": True}, {"open_interest": (0.9, 1)}), ({"quadrant": "short_covering"}, {"open_interest": (0.0, 0)}), ({"quadrant": "new_shorts", "buildup": True}, {"open_interest": None}),
    ({"wyckoff_signal": "long", "wyckoff_phase": "D", "wyckoff_confidence": 0.5}, {"wyckoff": (0.75, 1)}), ({"wyckoff_signal": "long", "wyckoff_phase": "B", "wyckoff_confidence": 0.5}, {"wyckoff": None}), ({"wyckoff_signal": "long", "wyckoff_phase": "D", "wyckoff_confidence": 0.3}, {"wyckoff": None}),
]
VETOES = [({}, None), ({"trend": "RANGING"}, "ranging"), ({"latest_swing": "BEARISH"}, "swing_choch"), ({"latest_swing": "BULLISH"}, None), ({"cascade_long": True}, "cascade"), ({"cascade_short": True}, None), ({"funding": "heavy_long"}, "crowded"), ({"range_position": 0.7}, "chase")]


def test_each_gate_and_veto(spark):
    candle = "pattern string, direction string, strength int, high double, low double"
    kinds = {bool: "boolean", float: "double", str: "string", type(None): None}
    special = {k: t for group in (chart.BOOK, chart.INTEREST, chart.WYCKOFF, PATTERN) for k, t in group.items()}
    names = list(BASE)
    schema = ", ".join(f"{c} {special.get(c) or kinds[type(BASE[c])] or ('double' if c.endswith('block') else 'string')}" for c in names)
    schema += f", sweep struct<side:string,wick:double>, candle struct<{candle.replace(' ', ':').replace(',:', ',')}>, candle_before struct<{candle.replace(' ', ':').replace(',:', ',')}>, at int"

    def row(change, at):
        c = BASE | change
        bar = lambda k: (*c[k], 1.2, 1.0) if k in c else None
        return (*(c[n] for n in names), (c["sweep"], 0.0) if "sweep" in c else None, bar("candle"), bar("before"), at)

    b = spark.createDataFrame([row(x, i) for i, (x, _) in enumerate(CASES)], schema)
    for r in b.select("at", *(v.alias(k) for k, v in chart.votes(b, "long").items())).collect():
        for name, want in CASES[r["at"]][1].items():
            assert (r[name] and tuple(r[name])) == want, (CASES[r["at"]], r[name])
    b = spark.createDataFrame([row(x, i) for i, (x, _) in enumerate(VETOES)], schema)
    got = {r["at"]: r["v"] for r in b.select("at", chart.vetoes("long", True).alias("v")).collect()}
    assert [got[i] for i in range(len(VETOES))] == [v for _, v in VETOES]
    assert b.where(chart.vetoes("long").isNull()).count() == 4
    short = b.select("at", chart.vetoes("short").alias("v")).where("v IS NOT NULL").collect()
    assert {VETOES[r["at"]][1] or str(VETOES[r["at"]][0]) for r in short} == {"ranging", "{'latest_swing': 'BULLISH'}", "{'cascade_short': True}"}


def test_prices_of_zero(spark, tmp_path):
    pools = chart.LivePools()
    for n, price in enumerate((0.0, 0.0, 1.0)):
        pools.add("SSL", price, n)
    assert [(p["price"], p["n"]) for p in pools.pools] == [(0.0, 1), (1.0, 2)]
    rng = np.random.default_rng(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * (i // 2)), "ab"[i % 2], float(rng.integers(0, 4))) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert plans.QUERIES["chart_votes"](spark, str(tmp_path)).count() > 0
    got = {(r["symbol"], r["ts"]): r for r in plans.QUERIES["chart_veto"](spark, str(tmp_path)).collect()}
    bars = {}
    for _, ts, symbol, value in rows:
        bars.setdefault((symbol, ts.replace(minute=0)), []).append(value)
    assert set(got) == set(bars)
    rises = [k for k in bars if (b := bars.get((k[0], k[1] - dt.timedelta(hours=1)))) and b[-1] == 0 and bars[k][-1] > 0]
    assert rises  # a close from zero is an unbounded rise; without a fall in volume it is no cascade
    assert not any("cascade" in (got[k]["long_veto"], got[k]["short_veto"]) for k in rises)
