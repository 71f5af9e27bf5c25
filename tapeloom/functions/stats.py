"""Validation statistics. Closed forms are Column expressions; resampling is one Arrow function per group."""

from __future__ import annotations

import math
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Phi by the rational approximation 7.1.26 of Abramowitz and Stegun to erf, absolute error under 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z)
    return F.when(x >= 0, 1 - half).otherwise(half)


def _phi(x: pd.Series) -> pd.Series:
    erf = np.frompyfunc(math.erf, 1, 1)
    return pd.Series(0.5 * (1 + erf(x.to_numpy(float) / math.sqrt(2)).astype(float)))


def _phi_inverse(p: pd.Series) -> pd.Series:
    v = p.to_numpy(float)
    ok = (v > 0) & (v < 1)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(ok, np.log(v / (1 - v)) / 1.702, 0.0)
    for _ in range(50):  # all values of a batch step together
        d = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = (0.5 * erfc(-x / math.sqrt(2)).astype(float) - v) / np.maximum(d, 1e-300)
        x = x - np.where(ok, np.clip(step, -1.0, 1.0), 0.0)
        if not ok.any() or np.abs(step[ok]).max() < 1e-14:
            break
    return pd.Series(np.where(ok, x, np.nan))


def phi(x: Column | str) -> Column:
    """Phi by erf, to full precision, as an Arrow function: Spark has no erf."""
    return F.pandas_udf(_phi, "double")(x)


def phi_inverse(p: Column | str) -> Column:
    """Inverse of Phi by damped Newton steps from a logistic start, to full precision; null outside (0, 1)."""
    return F.pandas_udf(_phi_inverse, "double")(p)


def psr(sr: Column, n: Column, skew: Column, kurt: Column, sr0: Column) -> Column:
    """z of the probabilistic Sharpe ratio (per period); its Phi is the probability. Null where the denominator isn't positive."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when((var > 0) & (n > 1), (sr - sr0) * F.sqrt(n - 1) / F.sqrt(var))


def min_track_record(sr: Column, skew: Column, kurt: Column, sr0: Column, z: float = 1.6448536269514722) -> Column:
    """Observations needed for sr to beat sr0 with the confidence of z; infinite where it doesn't."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when(sr > sr0, 1 + var * (z / (sr - sr0)) * (z / (sr - sr0))).otherwise(F.lit(float("inf")))


EULER = 0.5772156649015329


def expected_max_sharpe(sd: Column, trials: Column) -> Column:
    """Expected largest Sharpe ratio among independent trials of no skill; 0 for a single one."""
    a, b = phi_inverse(1 - 1 / trials), phi_inverse(1 - 1 / (trials * math.e))
    return F.when(trials > 1, sd * ((1 - EULER) * a + EULER * b)).otherwise(F.lit(0.0))


def effective_trials(correlations: DataFrame, corr: str = "corr") -> DataFrame:
    """n ** 2 / sum of squared correlations, from the pairs a < b of n series."""
    c = correlations.agg(F.count("*").alias("pairs"), F.sum(F.col(corr) * F.col(corr)).alias("ss"))
    n = (1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2
    return c.select(n.cast("long").alias("n_trials"), (n * n / (n + 2 * F.col("ss"))).alias("effective"))


BOOTSTRAP = ("n", "sharpe", "mean", "median", "sd", "low", "high", "p_positive", "p_null")


def bootstrap_values(x: np.ndarray, *, samples: int, block: int, seed: int, per_year: int = 52, confidence: float = 0.95) -> list[float]:
    """BOOTSTRAP of a return series: its annual Sharpe ratio, and those of circular blocks drawn from it and, for the
    null, from it less its mean. Draws come in slices, so memory is bounded by the series."""
    n, year = len(x), per_year**0.5
    block = max(1, min(block, n))
    rng = np.random.default_rng(seed)
    sharpe = lambda m: m.mean(1) / np.where((s := m.std(1, ddof=1)) > 0, s, np.inf) * year
    own = float(sharpe(x[None, :])[0]) if n > 1 else 0.0

    def drawn(values: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, samples, 250):
            starts = rng.integers(0, n, (min(250, samples - at), -(-n // block)))
            out.append(sharpe(values[((starts[:, :, None] + np.arange(block)) % n).reshape(len(starts), -1)[:, :n]]))
        return np.concatenate(out)

    got, null = drawn(x), drawn(x - x.mean())
    tail = (1 - confidence) / 2
    return [float(n), own, float(got.mean()), float(np.median(got)), float(got.std()), float(np.quantile(got, tail)), float(np.quantile(got, 1 - tail)), float((got > 0).mean()), float((null >= own).mean())]


def bootstrap_aggregate(*, samples: int, block: int, seed: int):
    """A grouped aggregate (order, return) -> array of BOOTSTRAP."""

    def run(order, value):
        return bootstrap_values(value.to_numpy()[np.argsort(order.to_numpy(), kind="stable")], samples=samples, block=block, seed=seed)

    run.__annotations__ = {"order": pd.Series, "value": pd.Series, "return": Any}  # series to one value: a grouped aggregate
    return F.pandas_udf(run, "array<double>")


def block_bootstrap(returns: DataFrame, by: str, value: str, *, block: int = 21, samples: int = 10_000, seed: int = 7) -> DataFrame:
    """BOOTSTRAP of each series, one Arrow function a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")[value].dropna().to_numpy()
        return pd.DataFrame([[pdf[by].iloc[0], *bootstrap_values(x, samples=samples, block=block, seed=seed)]], columns=[by, *BOOTSTRAP])

    return returns.select(by, "ts", value).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(run, f"{by} string, " + ", ".join(f"{k} double" for k in BOOTSTRAP))


def cscv(returns: DataFrame, config: str, value: str, splits: int = 8) -> DataFrame:
    """Combinatorially symmetric cross-validation, in Spark: a row per way of taking half of the blocks in sample.

    Sums per configuration and block come from one aggregation; each split then joins them through a small table of
    masks, so the returns themselves move once. logit < 0: the best in sample is below the median out of sample.
    """
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(config).orderBy("ts"))
    n = F.count("*").over(Window.partitionBy(config))
    blocks = returns.where(F.col(value).isNotNull()).withColumn("block", F.floor((order - 1) * splits / n)).groupBy(config, "block").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count("*").alias("n"))
    spark = returns.sparkSession
    masks = spark.createDataFrame([(i, b, b in own) for i, own in enumerate(combinations(range(splits), splits // 2)) for b in range(splits)], "split int, block long, inside boolean")
    j = blocks.join(F.broadcast(masks), "block")
    mean = F.sum("s") / F.sum("n")
    sr = F.when(F.sum("q") / F.sum("n") - mean * mean > 1e-18, mean / F.sqrt(F.sum("q") / F.sum("n") - mean * mean)).otherwise(0.0)
    half = j.groupBy("split", config, "inside").agg(sr.alias("sr"))
    both = half.groupBy("split", config).agg(F.max(F.when(F.col("inside"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("inside"), F.col("sr"))).alias("oos_sr"))
    w = Window.partitionBy("split")
    ranked = both.withColumns({"__best": F.row_number().over(w.orderBy(F.desc(F.round("is_sr", 12)), config)), "__rank": F.rank().over(w.orderBy(F.round("oos_sr", 12))), "__n": F.count("*").over(w)})
    share = F.col("__rank") / (F.col("__n") + 1)
    return ranked.where("__best = 1").select("split", F.col(config).alias("best"), "is_sr", "oos_sr", F.log(share / (1 - share)).alias("logit"))
