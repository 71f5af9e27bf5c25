"""Triangles, wedges, rectangles and cups at every bar against plain Python over the bars so far."""

import datetime as dt
import statistics
from collections import defaultdict

import numpy as np

from tapeloom.operators import shapes
from tests.test_structure import DAY, frame


def zigzag(points, seed, noise=0.02):
    """Bars along a polyline of (bar, price) with a little noise."""
    rng = np.random.default_rng(seed)
    x = np.interp(np.arange(points[-1][0] + 1), *zip(*points, strict=True))
    out = []
    for i, c in enumerate(x):
        o, c = (x[i - 1] if i else c) + rng.normal(0, noise), c + rng.normal(0, noise)
        out.append((DAY + dt.timedelta(i), float(o), float(max(o, c) + abs(rng.normal(0, noise))), float(min(o, c) - abs(rng.normal(0, noise))), float(c), float(rng.integers(5, 9) * (3 if i == len(x) - 2 else 1))))
    return out


def made_up():
    leg = lambda start, n, up, down, each=7: [(start + i * each, (up if i % 2 == 0 else down)(start + i * each)) for i in range(n)]
    lines = {
        "sym": leg(10, 9, lambda x: 120 - 0.15 * x, lambda x: 90 + 0.15 * x), "asc": leg(10, 9, lambda x: 110, lambda x: 90 + 0.2 * x), "desc": leg(10, 9, lambda x: 120 - 0.25 * x, lambda x: 95),
        "rise": leg(10, 10, lambda x: 100 + 0.10 * x, lambda x: 88 + 0.25 * x), "fall": leg(10, 10, lambda x: 112 - 0.25 * x, lambda x: 100 - 0.10 * x), "rect": leg(10, 11, lambda x: 105, lambda x: 95),
    }
    out = {}
    for k, (name, pts) in enumerate(lines.items()):
        for end, to in (("up", 8), ("down", -8)):
            last = pts[-1]
            out[f"{name}_{end}"] = zigzag([(0, 100), *pts, (last[0] + 4, last[1] + to), (last[0] + 9, last[1] + to * 1.5)], k)
    cup = [(0, 85), (10, 101), (14, 98), (18, 99), (40, 82), (43, 80.3), (47, 80.8), (51, 80.1), (56, 80.7), (60, 80.2), (65, 80.8), (70, 80.2), (75, 80.8), (80, 88), (83, 86), (90, 100.5), (94, 97), (96, 98), (97, 104), (98, 105)]
    out |= {f"cup{i}": zigzag(cup, 50 + i, 0.05 + 0.05 * i) for i in range(3)}
    rng = np.random.default_rng(9)
    out |= {f"r{i}": zigzag([(0, 100), *((5 * k, 100 + float(rng.normal(0, 4))) for k in range(1, 25))], 70 + i, 0.1) for i in range(6)}
    return out


def turns(rows):
    out = []
    for i in range(2, len(rows) - 2):
        around = rows[i - 2 : i + 3]
        side = "H" if rows[i][2] == max(r[2] for r in around) else "L" if rows[i][3] == min(r[3] for r in around) else None
        if side is None:
            continue
        p = (side, i, rows[i][2 if side == "H" else 3])
        if out and out[-1][0] == side:
            if (p[2] >= out[-1][2]) if side == "H" else (p[2] <= out[-1][2]):
                out[-1] = p
        else:
            out.append(p)
    return out


def fit(pts):
    x, y = [p[1] for p in pts], [p[2] for p in pts]
    m, b = np.polyfit(x, y, 1)
    res = [abs(v - (m * u + b)) for u, v in zip(x, y, strict=True)]
    tot = sum((v - np.mean(y)) ** 2 for v in y)
    return m, b, 1 - sum(r * r for r in res) / tot if tot > 0 and len(x) > 2 else 1.0, statistics.pstdev(res) if len(x) > 2 else 0.0


def by_hand(rows):
    """(pattern, direction, breakout, strength) at the last bar."""
    out, t, last, piv = [], len(rows) - 1, rows[-1], turns(rows)
    for count, kinds in ((8, "lines"), (10, "channel")):
        used = piv[-count:]
        top, bot = [p for p in used if p[0] == "H"], [p for p in used if p[0] == "L"]
        if len(top) < 2 or len(bot) < 2:
            continue
        (mt, bt, rt, st), (mb, bb, rb, sb) = fit(top), fit(bot)
        mean = np.mean([p[2] for p in used])
        if len(top) > 2 and st / mean > 0.01 or len(bot) > 2 and sb / mean > 0.01:
            continue
        seg = rows[used[0][1] :]
        unit = (max(r[2] for r in seg) - min(r[3] for r in seg)) / max(t - used[0][1], 1)
        if kinds == "channel":
            if abs(mt) / unit < 0.1 and abs(mb) / unit < 0.1 and used[-1][1] - used[0][1] >= 10:
                hi, lo = np.mean([p[2] for p in top]), np.mean([p[2] for p in bot])
                way = "bullish" if last[4] > hi + 0.003 * last[4] else "bearish" if last[4] < lo - 0.003 * last[4] else "neutral"
                out.append(("rectangle", way, way != "neutral", (rt + rb) / 2))
            continue
        apex = (bb - bt) / (mt - mb)
        if apex <= t:
            continue
        name = "ascending_triangle" if abs(mt) / unit < 0.1 and mb > 0 else "descending_triangle" if abs(mb) / unit < 0.1 and mt < 0 else "symmetrical_triangle" if mt < 0 < mb else None
        if name:
            part = (t - used[0][1]) / (apex - used[0][1])
            broke = last[4] > mt * t + bt or last[4] < mb * t + bb
            broke = broke and 0.5 <= part <= 0.75
            way = {"a": "bullish", "d": "bearish", "s": "neutral"}[name[0]]
            if broke and name[0] == "s":
                way = "bullish" if last[4] > mt * t + bt else "bearish"
            slope = round(np.polyfit(range(len(seg)), [r[5] for r in seg], 1)[0], 9) if len(seg) >= 3 else 0
            out.append((name, way, broke, (rt + rb) / 2 * 0.7 + 0.3 * (0.7 if slope < 0 else 0.3 if slope > 0 else 0.5)))
        rising, falling = mt > 0 and mb > mt, mb < 0 and mt < mb
        if len(top) > 2 and len(bot) > 2 and (rising or falling):
            room = 0.002 * last[4]
            if all(mb * j + bb - room <= rows[j][4] <= mt * j + bt + room for j in range(used[0][1], t + 1)):
                broke = last[4] < mb * t + bb if rising else last[4] > mt * t + bt
                out.append(("rising_wedge" if rising else "falling_wedge", "bearish" if rising else "bullish", broke, (rt + rb) / 2))
    hs, ls = [p[1:] for p in piv if p[0] == "H"], [p[1:] for p in piv if p[0] == "L"]
    if len(hs) > 1 and len(ls) > 1 and hs[-1][1] > hs[-2][1] and ls[-1][1] > ls[-2][1] and t + 1 >= 30:
        near = [h for h in hs if h[0] >= max(0, t + 1 - 120)]
        inner = [x for x in ls if near and x[0] > near[0][0]]
        if len(near) > 1 and inner:
            (left, rim), (low_at, floor) = near[0], min(inner, key=lambda x: x[1])
            right = next((h for h in hs if h[0] > low_at and abs(h[1] - rim) <= 0.03 * rim), None)
            if right and 0.12 <= (rim - floor) / rim <= 0.33:
                cup, handle = rows[left : right[0] + 1], rows[right[0] :]
                flat = sum(r[4] < floor + 0.1 * (rim - floor) for r in cup) / len(cup)
                lows = [p for k, p in ls if k > right[0]] or [r[3] for r in handle]
                if flat >= 0.3 and len(handle) < (right[0] - left) / 2 and right[1] - min(lows) <= (rim - floor) / 2 and min(lows) > floor + 0.33 * (rim - floor):
                    broke = last[4] > right[1] and last[5] >= 1.4 * np.mean([r[5] for r in rows[-10:]])
                    out.append(("cup_and_handle", "bullish", bool(broke), 0.9 if broke else 0.7))
    return out


def test_shapes_match_plain_python(spark):
    series, got = made_up(), defaultdict(list)
    for r in shapes.at_bars(frame(spark, series)).collect():
        got[r["symbol"], r["n"]].append((r["pattern"], r["direction"], r["breakout"], round(r["strength"], 6)))
    seen = set()
    for s, rows in series.items():
        for t in range(5, len(rows)):
            want = [(*x[:2], bool(x[2]), round(float(max(0, min(1, x[3]))), 6)) for x in by_hand(rows[: t + 1])]
            assert sorted(got[s, t + 1]) == sorted(want), (s, t)
            seen |= {(x[0], x[2]) for x in want}
    assert {x[0] for x in seen} >= {"ascending_triangle", "descending_triangle", "symmetrical_triangle", "rising_wedge", "falling_wedge", "rectangle", "cup_and_handle"}
    assert len({x for x in seen if x[1]}) >= 3
