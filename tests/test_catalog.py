"""Merged executions: sums that don't depend on the order of the rows."""

import datetime as dt

from tapeloom.operators import catalog


def test_a_price_that_is_whole_stays_whole(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day, day, "n", "P", 1.0 if i == 0 else 0.0, 0.1, None) for i in range(10)]  # added as doubles: 0.9999999999999999
    t = spark.createDataFrame(rows, "symbol string, txn_date date, asof_ts date, insider_name string, txn_code string, shares double, value_usd double, price double")
    r = catalog.merge_executions(t.coalesce(1)).collect()[0]
    assert (r["shares"], r["value_usd"], r["price"]) == (1.0, 1.0, 1.0)
