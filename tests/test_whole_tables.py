"""Queries that once read a part of the symbols or of the texts: all of it counts."""

import pytest

from tapeloom import plans
from tapeloom.plans import selection
from tapeloom.sources import adapters as src


@pytest.fixture(scope="module")
def symbols(spark, sf_dir):
    return {r["symbol"] for r in src.weekly(spark, sf_dir).select("symbol").distinct().collect()}


@pytest.mark.parametrize("name", ["pf_inverse_vol", "pf_capped_inverse_vol", "pf_cap_sector", "pf_cap_risk", "pf_crash_apply"])
def test_weights_cover_all_symbols(spark, sf_dir, symbols, name):
    rows = plans.QUERIES[name](spark, sf_dir).collect()
    assert {r["symbol"] for r in rows} - {"CASH", "HEDGE"} == symbols
    if name not in ("pf_cap_sector", "pf_capped_inverse_vol"):  # what no name may take above a cap is left in cash
        total = {}
        for r in rows:
            total[r["ts"]] = total.get(r["ts"], 0) + r["weight"]
        assert all(abs(x - 1) < 1e-4 for x in total.values())


def test_pods_hold_all_symbols(spark, sf_dir, symbols):
    rows = plans.QUERIES["pf_pod_alloc"](spark, sf_dir).collect()
    assert {r["pod"] for r in rows} == {s[-1] for s in symbols}
    vols = selection.vols(spark, sf_dir).where("vol IS NOT NULL").collect()
    ts = max(r["ts"] for r in rows)
    by = {}
    for r in vols:
        if r["ts"] == ts:
            by.setdefault(r["symbol"][-1], []).append(r["vol"])
    raw = {p: len(v) / sum(v) for p, v in by.items()}
    tilted = {p: b / sum(raw.values()) * (1.2 if p in "12" else 0.8) for p, b in raw.items()}
    for r in rows:
        if r["ts"] == ts:
            assert abs(r["budget"] - tilted[r["pod"]] / sum(tilted.values())) < 1e-5


@pytest.mark.parametrize(("name", "a", "b"), [("w_half_life", "sa", "sb"), ("sig_pair", "symbol_a", "symbol_b")])
def test_all_pairs(spark, sf_dir, symbols, name, a, b):
    pairs = [(r[a], r[b]) for r in plans.QUERIES[name](spark, sf_dir).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for x in symbols for y in symbols if x < y}


@pytest.mark.parametrize("name", ["w_rolling_ols_pair", "pf_pair_panel"])
def test_rolling_pairs_cover_all_symbols(spark, sf_dir, name):
    weeks = {}
    for r in src.weekly(spark, sf_dir).collect():
        weeks.setdefault(r["symbol"], set()).add(r["ts"])
    got = {(r["sa"], r["sb"]) for r in plans.QUERIES[name](spark, sf_dir).select("sa", "sb").distinct().collect()}
    assert got == {(a, b) for a in weeks for b in weeks if a < b and len(weeks[a] & weeks[b]) > 26}  # a window is 26 weeks before the row


def test_keywords_behind_the_first_characters(spark, tmp_path):
    rows = [(1, "x " * 100 + "a Worthless claim"), (2, "y " * 5000 + "the token"), (3, "z " * 200), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["signal"] for r in plans.QUERIES["str_keyword_signal"](spark, str(tmp_path)).collect()}
    assert got == {1: "risk", 2: "secret", 3: None, 4: None}
