"""Percentiles from bounds and counts equal Spark's own, whatever the size and shape of a group."""

from pyspark.sql import functions as F

from tapeloom.operators import aggregates as a


def test_percentiles_without_a_groups_values_in_one_task(spark):
    big = spark.range(60_000).select(F.lit("big").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    same = spark.range(30_000).select(F.lit("same").alias("g"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    few = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.0), ("two", None), ("none", None), (None, 4.0), *(("five", float(i * i)) for i in range(5))], "g string, v double")
    rows = big.unionByName(same).unionByName(few).cache()
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    out = a.percentiles(rows, "g", "v", at)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in out.collect()}
    want = {r["g"]: r for r in rows.where("v IS NOT NULL").groupBy("g").agg(*(F.expr(f"percentile(v, {p})").alias(k) for k, p in at.items())).collect()}
    assert set(got) == set(want)
    assert all(abs(got[g][k] - want[g][k]) < 1e-6 for g in want for k in at)
