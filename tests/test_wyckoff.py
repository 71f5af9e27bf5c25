"""The Wyckoff chain on many made-up series against its SQL, which follows each event by a join of its own."""

import duckdb
import pandas as pd

from tapeloom.operators import wyckoff as wy
from tapeloom.plans.registry import _no_negative_zero
from tapeloom.plans.wyckoff import WY
from tests.test_structure import frame, random_bars


def made_up(n_series):
    """Random bars with climaxes, ranges, false breaks and breakouts at random places and of random sizes."""
    import numpy as np

    series = random_bars(n_series, 260, seed=11, grid=0.05)
    rng = np.random.default_rng(5)
    for k, (s, rows) in enumerate(series.items()):
        if k % 9 == 8:
            series[s] = [(*r[:5], 0.0 if i % 4 == 0 else r[5]) for i, r in enumerate(rows)]
            rows = series[s]
        sign = 1 if k % 2 else -1
        base, at = 50.0, 60
        path = [base - sign * 4 * min(1, i / 55) for i in range(at)] + [base - sign * 4]
        path += [base - sign * (4 - 5 * min(1, i / 8)) for i in range(20)]
        path += [base - sign * (1.5 + 3.4 * np.sin(i / 6)) for i in range(60)]
        path += [base - sign * 4, base - sign * 3.5, base - sign * 3, base - sign * 3.3, base - sign * 4.2, base - sign * 4.2]
        path += [base - sign * (3 - 6 * min(1, i / 40)) for i in range(len(rows) - len(path))]
        out = []
        for i, (ts, _, _, _, _, v) in enumerate(rows):
            o, c = (path[i - 1] if i else path[0]) + rng.normal(0, 0.1), path[i] + rng.normal(0, 0.15)
            h, low = max(o, c) + abs(rng.normal(0, 0.15)), min(o, c) - abs(rng.normal(0, 0.15))
            if i == at:
                v, (h, low) = 60.0, (h, low - 1.5) if sign > 0 else (h + 1.5, low)
            elif v and i > at:
                v = v * (2.5 if rng.random() < 0.15 else 1)
            if i == at:
                anchor = low if sign > 0 else h
            if i == 141:  # a false break, of its own depth
                beyond = anchor - sign * rng.uniform(0.02, 0.4)
                h, low, c = (max(h, o), beyond, anchor + 0.3) if sign > 0 else (beyond, min(low, o), anchor - 0.3)
                o, v = c, v * 3
            out.append((ts, *(float(round(x, 2)) for x in (o, h, low, c)), v))
        series[s] = out
    return series


def test_chain_matches_its_sql(spark):
    series = made_up(90)
    con = duckdb.connect()
    con.register("bars_d", pd.DataFrame([(s, *r) for s, rows in series.items() for r in rows], columns=["symbol", "ts", "open", "high", "low", "close", "volume"]))
    chained = wy.chain(frame(spark, series))
    want = con.execute(_no_negative_zero(f"{WY} SELECT ev.symbol, kind, event, CAST(ts AS DATE), price, volume, type FROM ev JOIN k USING (symbol) LEFT JOIN ty USING (symbol, event)")).fetchall()
    got = [tuple(r) for r in wy.events(chained).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {e[2] for e in got} >= {"SC", "BC", "AR", "ST", "Spring", "UTAD", "SOS"} and len(got) > 300
    want = con.execute(_no_negative_zero(f"{WY} SELECT symbol, kind, sts, phase, confidence FROM ph")).fetchall()
    found = wy.schematics(chained)
    got = [tuple(r) for r in found.select("symbol", "kind", "sts", "phase", "confidence").collect()]
    assert sorted(got, key=str) == sorted(((s, k, n, p, float(c)) for s, k, n, p, c in want), key=str)
    assert len({g[3] for g in got}) >= 4
    signals = {r["signal"] for r in wy.entries(found).collect()}
    assert signals <= {"avoid", "wait", "long", "short"} and len(signals) >= 2
