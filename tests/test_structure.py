"""Structure, pools, sweeps, shifts, order blocks and first hits against plain Python over whole lists of bars."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import blocks, gaps, structure

DAY = dt.date(2020, 1, 1)


def random_bars(n_series, n, seed=1, grid=0.5):
    """Coarse prices, so that ties are frequent; series s has s % 7 * 3 bars less."""
    rng, out = np.random.default_rng(seed), {}
    for s in range(n_series):
        level, rows = 50.0, []
        for i in range(n - s % 7 * 3):
            o = level + rng.normal(0, 0.4)
            c = o + rng.normal(0, 1.5) * (3 if rng.random() < 0.1 else 1)
            h, low = max(o, c) + abs(rng.normal(0, 0.7)), min(o, c) - abs(rng.normal(0, 0.7))
            o, h, low, c = (round(x / grid) * grid for x in (o, h, low, c))
            level = c if 10 < c < 200 else 50.0
            rows.append((DAY + dt.timedelta(i), o, max(h, o, c), min(low, o, c), c, float(rng.integers(1, 9))))
        out[f"s{s:03d}"] = rows
    return out


@pytest.fixture(scope="module")
def series():
    return random_bars(200, 90)


@pytest.fixture(scope="module")
def bars(spark, series):
    return frame(spark, series)


def frame(spark, series):
    return spark.createDataFrame([(s, *r) for s, rows in series.items() for r in rows], "symbol string, ts date, open double, high double, low double, close double, volume double").repartition(4, "symbol").cache()


def pivots(rows, side, strict):
    beyond = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    for i in range(side, len(rows) - side):
        around = [rows[j] for j in range(i - side, i + side + 1) if j != i]
        yield i, all(beyond(rows[i][2], x[2]) for x in around), all(beyond(-rows[i][3], -x[3]) for x in around)


def labelled(rows, side):
    """Pivots in order: (kind, place, price, label)."""
    out, last = [], {}
    for i, up, down in pivots(rows, side, True):
        for kind, is_one, price in (("high", up, rows[i][2]), ("low", down, rows[i][3])):
            if not is_one:
                continue
            names = ("HH", "LH", "EQH") if kind == "high" else ("HL", "LL", "EQL")
            if kind not in last:
                label = "HH" if kind == "high" else "LL"
            elif abs(price - last[kind]) / max(price, last[kind]) <= 0.0015:
                label = names[2]
            else:
                label = names[0] if price > last[kind] else names[1]
            last[kind] = price
            out.append((kind, i, price, label))
    return out


def structure_by_hand(rows, side):
    """Every decision from the full list of what is confirmed at the bar."""
    all_pivots, found = labelled(rows, side), []
    broken, used, override, anchor, reset = set(), set(), None, None, {}
    for t, (ts, _, high, low, close, _) in enumerate(rows):
        seen = [p for p in all_pivots if p[1] + side <= t]
        trend = {k: [p[2] for p in seen if p[0] == k and not p[3].startswith("EQ")][-2:] for k in ("high", "low")}
        geometry = None
        if all(len(v) == 2 for v in trend.values()):
            geometry = "BULLISH" if all(v[1] > v[0] for v in trend.values()) else "BEARISH" if all(v[1] < v[0] for v in trend.values()) else None
        if override and max((p[1] for p in seen), default=-1) > anchor and geometry == override:
            override = None
        bias = override or geometry
        now = []
        if bias:
            kind, wick, back = ("high", high, "low") if bias == "BULLISH" else ("low", low, "high")
            other = "BEARISH" if bias == "BULLISH" else "BULLISH"
            sign = 1 if bias == "BULLISH" else -1
            target = next((p for p in reversed(seen) if p[0] == kind), None)
            if target and (kind, target[1], reset.get((kind, target[1]), 0)) not in broken:
                if sign * close > sign * target[2]:
                    broken.add((kind, target[1], reset.get((kind, target[1]), 0)))
                    now.append(("BOS", bias, target[2], bias))
                elif sign * wick > sign * target[2]:
                    now.append(("SWEEP", bias, target[2], bias))
            guard = next((p for p in reversed(seen) if p[0] == back and p[3] == ("HL" if back == "low" else "LH")), None)
            if guard and guard[:2] not in used and sign * close < sign * guard[2]:
                used.add(guard[:2])
                now.append(("CHOCH", other, guard[2], bias))
                override, anchor, bias = other, max(p[1] for p in seen), other
                for k in ("high", "low"):  # the newest pivots may be broken anew
                    if new := [p for p in seen if p[0] == k]:
                        reset[k, new[-1][1]] = t + 1
        for p in [p for p in all_pivots if p[1] + side == t]:
            found.append((ts, "PIVOT", None, p[2], p[3], bias or "RANGING"))
        found += [(ts, k, d, level, None, b) for k, d, level, b in now]
    return found


def test_structure_matches_plain_python(series, bars):
    got = defaultdict(list)
    for r in structure.events(bars, {"swing": 5, "internal": 2}).collect():
        got[r["symbol"], r["scope"]].append((r["ts"], r["kind"], r["direction"], r["level"], r["label"], r["bias"]))
    kinds = set()
    for s, rows in series.items():
        for scope, side in (("swing", 5), ("internal", 2)):
            want = structure_by_hand(rows, side)
            assert sorted(got[s, scope], key=str) == sorted(want, key=str), (s, scope)
            kinds |= {x[1] for x in want}
    assert kinds == {"PIVOT", "BOS", "SWEEP", "CHOCH"}


def test_structure_is_the_same_in_short_batches_and_without_later_bars(spark, series):
    one = {"s": random_bars(1, 400, seed=9)["s000"]}
    whole = structure.events(frame(spark, one)).orderBy("n", "scope", "kind", "level").collect()
    assert len(whole) > 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        cut = structure.events(frame(spark, one)).orderBy("n", "scope", "kind", "level").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole
    early = structure.events(frame(spark, {"s": one["s"][:233]})).orderBy("n", "scope", "kind", "level").collect()
    assert early == [r for r in whole if r["n"] <= 233]


def test_trend_at_bars(spark):
    one = {"s": random_bars(1, 300, seed=4)["s000"]}
    b = frame(spark, one).withColumn("n", F.row_number().over(structure.f.series()))
    rows = structure.bias_at_bars(b, structure.events(frame(spark, one)), 60).orderBy("n").collect()
    found = [(n, scope, e) for scope, side in (("swing", 5), ("internal", 3)) for e in structure_by_hand(one["s"], side) for n in [1 + one["s"].index(next(r for r in one["s"] if r[0] == e[0]))]]
    rank = {"PIVOT": 0, "BOS": 1, "SWEEP": 1, "CHOCH": 2}
    for r in rows:
        live = [(n, -rank[e[1]] - 10 * (scope == "internal"), e, scope) for n, scope, e in found if r["n"] - 60 < n <= r["n"]]
        cut = max((x for x in live if x[2][1] in ("BOS", "CHOCH")), key=lambda x: x[:2], default=None)
        other = max((x for x in live if x[2][5] != "RANGING"), key=lambda x: x[:2], default=None)
        assert r["trend"] == (cut or other)[2][5] if cut or other else r["trend"] == "RANGING"
        assert r["latest"] == (cut[2][1] if cut else None)
        assert r["int_bos"] == any(x[2][1] == "BOS" and x[3] == "internal" for x in live)


def pools_by_hand(rows, tolerance=0.0015):
    out = []
    marks = list(pivots(rows, 3, False))
    for side, pick, at in (("BSL", 1, 2), ("SSL", 2, 3)):
        left = [(m[0], rows[m[0]][at]) for m in marks if m[pick]][-50:]
        taken = set()
        for i, (k, price) in enumerate(left):
            if i in taken:
                continue
            own = [(k, price)]
            for j in range(i + 1, len(left)):
                if j not in taken and abs(left[j][1] - price) / max(left[j][1], price) <= tolerance:
                    own.append(left[j])
                    taken.add(j)
            prices = [p for _, p in own]
            out.append({"side": side, "price": max(prices) if side == "BSL" else min(prices), "touches": len(own), "at": own[-1][0]})
    return out


def sweeps_by_hand(rows, pools):
    out, pending, dead = [], {}, set()
    for t in range(1, len(rows)):
        ts, _, high, low, close, _ = rows[t]
        for k, p in enumerate(pools):
            if k in dead:
                continue
            if t - p["at"] > 50:
                dead.add(k)
                continue
            bsl = p["side"] == "BSL"
            outside, inside = (high, close <= p["price"]) if bsl else (low, close >= p["price"])
            through = high > p["price"] if bsl else low < p["price"]
            if through and inside:
                out.append((ts, p["side"], p["price"], outside, "single_bar_grab"))
                pending.pop(k, None)
            elif not inside:
                pending[k] = outside if k not in pending else (max if bsl else min)(pending[k], outside)
                if t - p["at"] > 10:
                    dead.add(k)
            elif k in pending:
                out.append((ts, p["side"], p["price"], pending.pop(k), "multi_bar_sweep"))
    return out


def test_pools_and_sweeps_match_plain_python(series, bars):
    pool_rows = structure.pools(bars).cache()
    got, swept = defaultdict(list), defaultdict(list)
    for r in pool_rows.collect():
        got[r["symbol"]].append((r["side"], r["price"], r["touches"], r["n"] - 1))
    for r in structure.sweeps(bars, pool_rows).collect():
        swept[r["symbol"]].append((r["ts"], r["side"], r["level"], r["wick"], r["sweep_type"]))
    kinds = set()
    for s, rows in series.items():
        pools = pools_by_hand(rows)
        assert sorted(got[s]) == sorted((p["side"], p["price"], p["touches"], p["at"]) for p in pools)
        want = sweeps_by_hand(rows, pools)
        assert sorted(swept[s]) == sorted(want), s
        kinds |= {w[4] for w in want}
    assert kinds == {"single_bar_grab", "multi_bar_sweep"}


def shift_by_hand(rows, at, up):
    end = min(at + 11, len(rows))
    marks = {i: (hi, lo) for i, hi, lo in pivots(rows, 2, False)}
    for i in range(at + 1, end - 2):
        if i not in marks or not marks[i][0 if up else 1]:
            continue
        level = rows[i][2 if up else 3]
        for t in range(i + 1, end):
            if (rows[t][4] > level) if up else (rows[t][4] < level):
                tr = max(rows[t][2] - rows[t][3], abs(rows[t][2] - rows[t - 1][4]), abs(rows[t][3] - rows[t - 1][4]))
                return rows[t][0], level, tr > 0 and abs(rows[t][4] - rows[t][1]) / tr >= 0.5
    return None


def test_shifts_match_plain_python(series, bars):
    some = 0
    for r in structure.shifts(bars).collect():
        for name, up in (("mss_up", True), ("mss_down", False)):
            want = shift_by_hand(series[r["symbol"]], r["n"] - 1, up)
            x = r[name]
            assert (None if x is None else (x["ts"], x["level"], x["displacement"])) == want
            some += want is not None
    assert some > 100


def blocks_by_hand(rows):
    n, tr = len(rows), [rows[0][2] - rows[0][3]]
    tr += [max(r[2] - r[3], abs(r[2] - p[4]), abs(r[3] - p[4])) for p, r in zip(rows, rows[1:], strict=False)]
    atr = [None] * n
    for i in range(13, n):
        atr[i] = sum(tr[:14]) / 14 if i == 13 else atr[i - 1] + (tr[i] - atr[i - 1]) / 14
    marks = list(pivots(rows, 2, False))
    swings = {"bullish": [(i, rows[i][3]) for i, _, lo in marks if lo], "bearish": [(i, rows[i][2]) for i, hi, _ in marks if hi]}
    found = []
    for direction, sign, col in (("bullish", 1, 2), ("bearish", -1, 3)):
        own = swings["bearish" if sign > 0 else "bullish"]
        since = -1
        for k in range(n):
            levels = [p for i, p in own if since < i + 2 <= k]
            if atr[k] is None or not levels or sign * rows[k][4] <= max(sign * p for p in levels):
                continue
            since = k
            body, span = abs(rows[k][4] - rows[k][1]), rows[k][2] - rows[k][3]
            if body < atr[k] or body / (span + 1e-12) < 0.5 or sign * (rows[k][4] - rows[k][1]) <= 0:
                continue
            i = next((j for j in range(k - 1, max(0, k - 10) - 1, -1) if sign * (rows[j][4] - rows[j][1]) < 0), None)
            if i is None or sign * (rows[k][4] - rows[i][col]) <= 0:
                continue
            gap = any((rows[c][3] > rows[c - 2][2]) if sign > 0 else (rows[c][2] < rows[c - 2][3]) for c in range(i + 2, k + 1))
            before = [r[5] for r in rows[max(0, i - 14) : i]]
            strength = 0.3 * (body >= 2 * atr[k]) + 0.25 * gap + 0.2 * (bool(before) and rows[i][5] > sum(before) / len(before)) + 0.15 * (body / (span + 1e-12) >= 0.65) + 0.1 * (i + 2 <= k and any(i == x for v in swings.values() for x, _ in v))
            if strength < 0.4 - 1e-9:
                continue
            top, bottom, extreme = max(rows[i][1], rows[i][4]), min(rows[i][1], rows[i][4]), rows[i][3 if sign > 0 else 2]
            level = next((p for x, p in reversed(swings[direction]) if x + 2 <= k), None)
            state = dict.fromkeys(("visited", "swept", "mitigated", "retest"))
            for ts, _, high, low, close, _ in rows[k + 1 :]:
                if state["visited"] is None and (low <= top if sign > 0 else high >= bottom):
                    state["visited"] = ts
                if state["swept"] is None and state["mitigated"] is None and level is not None and (low < level if sign > 0 else high > level):
                    state["swept"] = ts
                if state["mitigated"] is None and (close < extreme if sign > 0 else close > extreme):
                    state["mitigated"] = ts
                if state["mitigated"] and state["swept"] and state["retest"] is None and (high >= bottom if sign > 0 else low <= top):
                    state["retest"] = ts
            found.append((rows[k][0], direction, bottom, top, extreme, rows[i][0], round(strength, 6), gap, *state.values(), bool(state["mitigated"] and state["swept"])))
    return found


def test_order_blocks_match_plain_python(series, bars):
    got = defaultdict(list)
    for r in blocks.lifecycle(bars, blocks.detect(bars)).collect():
        got[r["symbol"]].append((r["ts"], r["direction"], r["bottom"], r["top"], r["extreme"], r["block_ts"], r["strength"], r["has_gap"], r["visited_ts"], r["swept_ts"], r["mitigated_ts"], r["retest_ts"], r["breaker"]))
    total = breakers = 0
    for s, rows in series.items():
        want = blocks_by_hand(rows)
        assert sorted(got[s], key=str) == sorted(want, key=str), s
        total, breakers = total + len(want), breakers + sum(w[-1] for w in want)
    assert total > 100 and breakers > 5


def test_first_hits_in_short_batches(spark, series, bars):
    zones = spark.createDataFrame([(s, rows[i][0], "long" if i % 2 else "short", rows[i][4]) for s, rows in series.items() for i in range(0, len(rows), 11)], "symbol string, ts date, side string, price double")
    hits = {"touch_ts": [("low", "<=", F.col("price") - 2)], "inside_ts": [("high", ">", F.col("price")), ("close", "<", F.col("price"))], "never_ts": [("close", ">", F.lit(None).cast("double"))]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = gaps.first_hits(zones, bars, hits, ("side", "price")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(len(range(0, len(rows), 11)) for rows in series.values())
    for r in got:
        later = [x for x in series[r["symbol"]] if x[0] > r["ts"]]
        assert r["touch_ts"] == next((x[0] for x in later if x[3] <= r["price"] - 2), None)
        assert r["inside_ts"] == next((x[0] for x in later if x[2] > r["price"] > x[4]), None) and r["never_ts"] is None
