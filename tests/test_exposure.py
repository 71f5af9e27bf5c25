"""The book whose exposure follows its own drawdown, by hand."""

from tapeloom.operators import exposure


def test_drawdown_switch_and_fee_on_levered_targets(spark):
    rows = [("a", 1, 0.10, 1.5, True, [("x", 0.5), ("y", 0.5)]), ("a", 2, -0.20, 1.5, True, [("x", 0.5), ("y", 0.5)]), ("a", 3, 0.05, 1.5, True, [("x", 1.0)]), ("a", 4, 0.50, 1.5, True, [("x", 1.0)]), ("a", 5, 0.01, 1.5, True, None), ("b", 1, -0.5, 1.0, False, None), ("b", 2, 0.1, 1.0, False, None)]
    df = spark.createDataFrame(rows, "book string, ts int, ret double, base double, watch boolean, weights array<struct<symbol:string,weight:double>>")
    got = {(r["book"], r["ts"]): r for r in exposure.run(df, ["book"], fee=0.001).collect()}
    equity = 1 + (0.10 * 1.5 - 0.0015)
    assert abs(got["a", 1]["equity"] - equity) < 1e-12
    fallen = equity * (1 - 0.20 * 1.5)
    assert abs(got["a", 2]["equity"] - fallen) < 1e-12 and got["a", 2]["turnover"] == 0
    third = got["a", 3]  # 30 % down: half invested, both weights change
    assert third["exposure"] == 0.5 and abs(third["turnover"] - (0.25 + 0.75)) < 1e-12 and abs(third["drawdown"] - (fallen - equity) / equity) < 1e-12
    assert got["a", 4]["exposure"] == 0.5 and got["a", 5]["exposure"] == 1.5 or got["a", 5]["drawdown"] < -0.1
    assert [got["b", t]["exposure"] for t in (1, 2)] == [1.0, 1.0]
