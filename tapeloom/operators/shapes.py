"""Chart shapes at every bar from fitted lines and rims: triangles, wedges, rectangles, cups with a handle.

A fold over each series keeps the last pivots, in turn high and low, and the last KEEP bars; a shape is what the state of
a bar shows, so no later bar changes it. Shapes that begin before the kept bars are not seen.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import features as f
from tapeloom.operators.fold import Machine, fold, schema_of

#: Pivots in a triangle or wedge and in a rectangle, flatness, fit, room beyond a line, the apex window, the cup.
PIVOTS, CHANNEL, FLAT, FIT, ROOM, APEX = 8, 10, 0.1, 0.01, 0.002, (0.50, 0.75)
SPAN, BUFFER = 10, 0.003
CUP = {"bars": 120, "rim": 0.03, "least": 0.12, "most": 0.33, "flat": 0.30, "handle": 0.5, "low": 0.33, "volume": 1.4}
KEEP = 400


def line(points: list[tuple[int, float]]) -> tuple[float, float, float, float]:
    """(slope, offset, r squared, deviation of the absolute residuals) of a least-squares line."""
    x, y = np.array(points, float).T
    dx = x - x.mean()
    slope = float(dx @ y / (dx @ dx))
    offset = float(y.mean() - slope * x.mean())
    if len(points) == 2:
        return slope, offset, 1.0, 0.0
    left = y - (slope * x + offset)
    whole = float(((y - y.mean()) ** 2).sum())
    return slope, offset, 1 - float(left @ left) / whole if whole > 0 else 1.0, float(np.abs(left).std())


class Shapes(Machine):
    def __init__(self, fit: float = FIT):
        self.fit = fit
        self.bars: deque = deque(maxlen=KEEP)  # (n, high, low, close, volume)
        self.pivots: list[tuple[str, int, float]] = []

    def step(self, row: dict) -> list[dict]:
        n = row["n"]
        self.bars.append((n, row["high"], row["low"], row["close"], row["volume"]))
        side, price = ("H", row["m_up"]) if row["m_up"] is not None else ("L", row["m_down"])
        if price is not None:
            if self.pivots and self.pivots[-1][0] == side:
                if price >= self.pivots[-1][2] if side == "H" else price <= self.pivots[-1][2]:
                    self.pivots[-1] = (side, n - 2, price)
            else:
                self.pivots.append((side, n - 2, price))
            first = self.bars[0][0]
            self.pivots = [p for p in self.pivots if p[1] >= first]
        found = [*self.converging(n), *self.channel(n), *self.cup(n)]
        return [{"ts": row["ts"], "n": n} | x for x in found]

    def since(self, n: int) -> np.ndarray:
        return np.array([b for b in self.bars if b[0] >= n], float)

    def ratio(self, bars: int) -> float | None:
        v = [b[4] for b in list(self.bars)[-bars:]]
        mean = sum(v) / len(v)
        return v[-1] / mean if mean > 0 else None

    def fitted(self, count: int, least: int):
        """Pivots of a shape with both lines, if they fit: three points and more within ``fit`` of the mean price."""
        used = self.pivots[-count:]
        top, bottom = ([p[1:] for p in used if p[0] == s] for s in "HL")
        if min(len(top), len(bottom)) < least:
            return None
        upper, lower = line(top), line(bottom)
        mean = float(np.mean([p for _, p in top + bottom]))
        if any(len(pts) >= 3 and mean > 0 and ln[3] / mean > self.fit for pts, ln in ((top, upper), (bottom, lower))):
            return None
        return used[0][1], used[-1][1], top, bottom, upper, lower

    @staticmethod
    def told(pattern: str, direction: str, low: float, high: float, strength: float, close: float, height: float, broke: str | None, ratio: float | None, apex: float | None, n: int) -> dict:
        target = None if broke is None else close + height if broke == "bullish" else close - height
        strength = max(0.0, min(1.0, strength))
        return {"pattern": pattern, "direction": direction, "low": low, "high": high, "strength": strength, "breakout": broke is not None, "volume_ratio": ratio if broke else None, "target": target, "mitigated": apex is not None and int(apex) <= n}

    def converging(self, n: int) -> list[dict]:
        shape, out = self.fitted(PIVOTS, 2), []
        if shape is None:
            return out
        start, _, top, bottom, (mt, bt, rt, _), (mb, bb, rb, _) = shape
        if mt == mb or (apex := (bb - bt) / (mt - mb)) <= n:
            return out
        bars = self.since(start)
        close, low, high = bars[-1, 3], min(p for _, p in bottom), max(p for _, p in top)
        steep = (bars[:, 1].max() - bars[:, 2].min()) / max(n - start, 1)
        flat = lambda m: steep > 0 and abs(m) / steep < FLAT
        upper, lower = mt * n + bt, mb * n + bb
        kind = ("ascending_triangle", "bullish") if flat(mt) and mb > 0 else ("descending_triangle", "bearish") if flat(mb) and mt < 0 else ("symmetrical_triangle", "neutral") if mt < 0 < mb else None
        if kind:
            part = (n - start) / (apex - start)
            broke = "bullish" if close > upper else "bearish" if close < lower else None
            broke = broke if APEX[0] <= part <= APEX[1] else None
            x, v = np.arange(len(bars)), bars[:, 4]
            trend = round(len(x) * float(x @ v) - float(x.sum()) * float(v.sum()), 6) if len(bars) >= 3 else 0.0  # the slope's sign
            volume = 0.7 if trend < 0 else 0.3 if trend > 0 else 0.5
            way = broke if kind[0].startswith("sym") and broke else kind[1]
            out.append(self.told(kind[0], way, low, high, (rt + rb) / 2 * 0.7 + volume * 0.3, close, high - low, broke, self.ratio(20), apex, n))
        rising, falling = mb > mt > 0, mt < mb < 0
        if min(len(top), len(bottom)) >= 3 and (rising or falling):
            room, at = ROOM * close, bars[:, 0]
            if not ((bars[:, 3] > mt * at + bt + room) | (bars[:, 3] < mb * at + bb - room)).any():
                broke = "bearish" if rising and close < lower else "bullish" if falling and close > upper else None
                width = abs((mt * start + bt) - (mb * start + bb))
                out.append(self.told("rising_wedge" if rising else "falling_wedge", "bearish" if rising else "bullish", low, high, (rt + rb) / 2, close, width, broke, self.ratio(20), apex, n))
        return out

    def channel(self, n: int) -> list[dict]:
        shape = self.fitted(CHANNEL, 2)
        if shape is None:
            return []
        start, end, top, bottom, (mt, _, rt, _), (mb, _, rb, _) = shape
        bars = self.since(start)
        steep = (bars[:, 1].max() - bars[:, 2].min()) / max(n - start, 1)
        if not steep > 0 or max(abs(mt), abs(mb)) / steep >= FLAT or end - start < SPAN:
            return []
        high, low, close = float(np.mean([p for _, p in top])), float(np.mean([p for _, p in bottom])), bars[-1, 3]
        broke = "bullish" if close > high + BUFFER * close else "bearish" if close < low - BUFFER * close else None
        return [self.told("rectangle", broke or "neutral", low, high, (rt + rb) / 2, close, high - low, broke, self.ratio(20), None, n)]

    def cup(self, n: int) -> list[dict]:
        highs, lows = ([p[1:] for p in self.pivots if p[0] == s] for s in "HL")
        if n < CUP["bars"] // 4 or len(highs) < 2 or len(lows) < 2 or not (highs[-1][1] > highs[-2][1] and lows[-1][1] > lows[-2][1]):
            return []
        recent = [h for h in highs if h[0] > n - CUP["bars"]]
        if len(recent) < 2:
            return []
        left, rim = recent[0]
        inner = [x for x in lows if x[0] > left]
        if not inner or rim <= 0:
            return []
        at, floor = min(inner, key=lambda x: x[1])
        right = next((h for h in highs if h[0] > at and rim * (1 - CUP["rim"]) <= h[1] <= rim * (1 + CUP["rim"])), None)
        depth = rim - floor
        if right is None or not CUP["least"] <= depth / rim <= CUP["most"]:
            return []
        bars = self.since(left)
        cup, handle = bars[bars[:, 0] <= right[0]], bars[bars[:, 0] >= right[0]]
        if (cup[:, 3] < floor + 0.1 * depth).mean() < CUP["flat"] or len(handle) >= (right[0] - left) * CUP["handle"]:
            return []
        later = [p for k, p in lows if k > right[0]]
        low = min(later) if later else float(handle[:, 2].min())
        if right[1] - low > depth * CUP["handle"] or low <= floor + depth * CUP["low"]:
            return []
        ratio = self.ratio(10)
        broke = "bullish" if bars[-1, 3] > right[1] and (ratio or 0.0) >= CUP["volume"] else None
        return [self.told("cup_and_handle", "bullish", floor, right[1], 0.9 if broke else 0.7, right[1], depth, broke, ratio, None, n) | {"target": right[1] + depth}]


SCHEMA = "pattern string, direction string, low double, high double, strength double, breakout boolean, volume_ratio double, target double, mitigated boolean"


def at_bars(bars: DataFrame, *, fit: float = FIT) -> DataFrame:
    """(symbol, ts, n, pattern, direction, low, high, strength, breakout, volume_ratio, target, mitigated): a row a bar and shape."""
    p = f.pivots(bars, 2, 2, strict=False).withColumn("n", F.row_number().over(f.series()))
    known = {"m_up": f.lag(F.when(F.col("pivot_high"), F.col("high")), 2), "m_down": f.lag(F.when(F.col("pivot_low"), F.col("low")), 2)}
    p = p.withColumns(known).select("symbol", "ts", "n", "high", "low", "close", "volume", "m_up", "m_down")
    return fold(p, ["symbol"], ["n"], lambda: Shapes(fit), schema_of(p, ["symbol", "ts", "n"], SCHEMA))
