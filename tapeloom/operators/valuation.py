"""Valuation and option tables as expressions over fundamentals and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dcf(fcf: Column, growth: Column, discount: float, terminal: float, net_debt: Column, shares: Column, years: int = 5) -> Column:
    """Per-share value of ``years`` growing cash flows and a terminal value, less net debt; null without cash flow or shares."""
    flows = sum((fcf * F.pow(1 + growth, t) / (1 + discount) ** t for t in range(1, years + 1)), F.lit(0.0))
    end = fcf * F.pow(1 + growth, years) * (1 + terminal) / (discount - terminal) / (1 + discount) ** years
    return F.when((fcf > 0) & (shares > 0), (flows + end - net_debt) / shares)


def composite(methods: dict[str, tuple[Column, float]]) -> dict[str, Column]:
    """Weighted mean of the positive methods, their number, and population deviation over the mean."""
    zero = F.lit(0.0)
    ok = {k: (F.when(v > 0, v), w) for k, (v, w) in methods.items()}
    weight = sum((F.when(v.isNotNull(), w).otherwise(zero) for v, w in ok.values()), zero)
    fair = sum((F.coalesce(v * w, zero) for v, w in ok.values()), zero) / weight
    n = sum((v.isNotNull().cast("int") for v, _ in ok.values()), F.lit(0))
    mean = sum((F.coalesce(v, zero) for v, _ in ok.values()), zero) / n
    var = sum((F.coalesce((v - mean) * (v - mean), zero) for v, _ in ok.values()), zero) / n
    return {"fair": F.when(weight > 0, fair), "n_methods": n, "dispersion": F.when(weight > 0, F.sqrt(var) / fair)}


def entry_ladder(price: Column, fair: Column) -> Column:
    """Three buys of 30, 40 and 30 per cent at the price, 3 and 6 per cent below; array of struct<pct, price>."""
    step = lambda pct, cut: F.struct(F.lit(pct).alias("pct"), (price * (1 - cut)).alias("price"))
    return F.array(step(0.3, 0.0), step(0.4, 0.03), step(0.3, 0.06))


def option_variance(quotes: DataFrame, rate: float = 0.02) -> DataFrame:
    """Model-free variance per expiry from (expiry, t, strike, call, put): forward from the strike of least call-put gap.

    Out-of-the-money mids, weighted by the strikes' spacing; one window and two aggregations.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("expiry")
    gap = F.abs(F.col("call") - F.col("put"))
    first = F.struct(gap.alias("g"), F.col("strike").alias("k"), (F.col("call") - F.col("put")).alias("d"))
    q = quotes.withColumn("__m", F.min(first).over(by)).withColumn("fwd", F.col("__m.k") + F.exp(rate * F.col("t")) * F.col("__m.d"))
    q = q.withColumn("k0", F.max(F.when(F.col("strike") <= F.col("fwd"), F.col("strike"))).over(by))
    price = F.when(F.col("strike") < F.col("k0"), F.col("put")).when(F.col("strike") > F.col("k0"), F.col("call")).otherwise((F.col("call") + F.col("put")) / 2)
    w = by.orderBy("strike")
    up, down = F.lead("strike").over(w), F.lag("strike").over(w)
    dk = F.when(up.isNull(), F.col("strike") - down).when(down.isNull(), up - F.col("strike")).otherwise((up - down) / 2)
    q = q.withColumn("__c", dk / (F.col("strike") * F.col("strike")) * F.exp(rate * F.col("t")) * price)
    return q.groupBy("expiry", "t", "fwd", "k0").agg((2 / F.col("t") * F.sum("__c") - (F.col("fwd") / F.col("k0") - 1) * (F.col("fwd") / F.col("k0") - 1) / F.col("t")).alias("variance"))


def bracketing(expiries: DataFrame) -> DataFrame:
    """Per target (target, expiry, days): the last expiry at or before it and the first at or after it.

    Where one side is empty the two nearest, or the single one twice. One aggregation: the two nearest are kept by
    the expiries' distances, of which a chain has few.
    """
    pick, gap = F.struct("days", "expiry"), F.abs(F.col("days") - F.col("target"))
    g = expiries.groupBy("target").agg(
        F.max(F.when(F.col("days") <= F.col("target"), pick)).alias("below"), F.min(F.when(F.col("days") >= F.col("target"), pick)).alias("above"),
        F.slice(F.sort_array(F.collect_list(F.struct(gap.alias("gap"), "days", "expiry"))), 1, 2).alias("near"),
    )
    two = F.sort_array(F.transform(F.array(F.element_at("near", 1), F.element_at("near", -1)), lambda x: F.struct(x["days"].alias("days"), x["expiry"].alias("expiry"))))
    both = F.when(F.col("below").isNotNull() & F.col("above").isNotNull(), F.array("below", "above")).otherwise(two)
    g = g.withColumn("p", both)
    return g.select("target", *(F.col("p")[i][c].alias(f"{n}_{c}") for i, n in ((0, "near"), (1, "far")) for c in ("expiry", "days")))


def chain_quality(quotes: DataFrame, *, target_days: int, max_age: int, max_spread: float, least: int = 5) -> DataFrame:
    """Per expiry: strikes, crossed, missing, stale and wide sides, the number of errors and of warnings, and whether the
    expiry is one of the two around the target. quotes: (expiry, days, strike, cb, ca, pb, pa, call_age, put_age)."""
    count = lambda c: F.count(F.when(c, 1))
    crossed = lambda b, a: F.coalesce(F.col(a) < F.col(b), F.lit(False))
    wide = lambda b, a: (F.col(a) >= F.col(b)) & ((F.col(a) - F.col(b)) / ((F.col(a) + F.col(b)) / 2) > max_spread)
    none = lambda b, a: crossed(b, a) | (F.col(a).isNull() & F.col(b).isNull())
    s = quotes.groupBy("expiry").agg(
        F.first("days").alias("days"), F.count("*").alias("n"), F.countDistinct("strike").alias("n_strikes"), count(crossed("cb", "ca") | crossed("pb", "pa")).alias("inverted"), count(none("cb", "ca") | none("pb", "pa")).alias("missing_sides"),
        (count(F.col("call_age") > max_age) + count(F.col("put_age") > max_age)).alias("stale"), (count(F.col("call_age").isNull()) + count(F.col("put_age").isNull())).alias("missing_trades"), (count(wide("cb", "ca")) + count(wide("pb", "pa"))).alias("wide"),
    )
    ends = s.agg(F.max(F.when(F.col("days") <= target_days, F.col("days"))).alias("lo"), F.min(F.when(F.col("days") >= target_days, F.col("days"))).alias("hi"))
    few = (F.col("n_strikes") >= 3) & (F.col("n_strikes") < least)
    warnings = sum((c.cast("int") for c in (few, *(F.col(k) > 0 for k in ("inverted", "missing_sides", "stale", "missing_trades", "wide")))), F.lit(0))
    x = s.crossJoin(F.broadcast(ends)).withColumns({"bracket": (F.col("days") == F.col("lo")) | (F.col("days") == F.col("hi")), "n_errors": (F.col("n_strikes") < 3).cast("int"), "n_warnings": warnings})
    return x.select("expiry", "days", "bracket", "n", "n_strikes", "inverted", "missing_sides", "stale", "missing_trades", "wide", "n_errors", "n_warnings")


METRICS = (
    "revenue_cagr", "revenue_growth_acceleration", "eps_growth", "operating_margin", "net_margin", "gross_margin", "gross_profitability", "margin_trend", "roic", "fcf_margin", "fcf_conversion",
    "debt_to_equity", "share_growth", "pe", "pfcf", "ps", "pb", "market_cap",
)


def compounder_metrics(facts: DataFrame, prices: DataFrame, *, tolerance: int = 120, winsor: float = 1.0) -> DataFrame:
    """METRICS of each symbol at its last record (symbol, period_end, ...), with its price.

    The records one, two and three years before are the nearest to that date among the earlier ones, at most
    ``tolerance`` days off, the earlier on a tie; the margin's trend is the slope of the clipped margins over their
    order. One window marks the last record and one aggregation finds them all.
    """
    from pyspark.sql import Window

    c = F.col
    by = Window.partitionBy("symbol")
    over = lambda a, b: F.when(b > 0, a / b)
    x = facts.withColumns({"__end": F.max("period_end").over(by), "__i": F.row_number().over(by.orderBy("period_end")), "__m": F.greatest(F.lit(-winsor), F.least(F.lit(winsor), over(c("net_income"), c("revenue"))))})

    def before(years: int) -> Column:
        gap = F.abs(F.datediff("period_end", F.date_sub("__end", round(365.25 * years))))
        ok = (c("period_end") < c("__end")) & (gap <= tolerance)
        return F.min_by(F.struct("revenue", "eps", "shares_out"), F.when(ok, F.struct(gap.alias("g"), "period_end")))

    trend = F.when(F.count("__m") >= 2, F.regr_slope(c("__m"), c("__i")))
    g = x.groupBy("symbol").agg(F.max_by(F.struct(*(k for k in facts.columns if k != "symbol")), "period_end").alias("l"), *(before(k).alias(f"y{k}") for k in (1, 2, 3)), trend.alias("margin_trend"))
    g = g.join(prices.select("symbol", "price"), "symbol", "left")
    f = lambda k: c(f"l.{k}")
    cap = F.when(f("shares_out") > 0, c("price") * f("shares_out"))
    rate = lambda a, b: F.when((a > 0) & (b > 0), F.pow(a / b, 1 / 3) - 1)
    rev = f("revenue")
    out = {
        "revenue_cagr": rate(rev, c("y3.revenue")), "revenue_growth_acceleration": F.when((rev > 0) & (c("y1.revenue") > 0) & (c("y2.revenue") > 0), rev / c("y1.revenue") - c("y1.revenue") / c("y2.revenue")),
        "eps_growth": F.when(c("y3.eps") != 0, (f("eps") - c("y3.eps")) / F.abs(c("y3.eps"))), "operating_margin": over(f("operating_income"), rev), "net_margin": over(f("net_income"), rev), "gross_margin": over(f("gross_profit"), rev),
        "gross_profitability": over(f("gross_profit"), f("total_assets")), "margin_trend": c("margin_trend"), "roic": over(f("net_income"), f("total_equity") + f("total_debt")), "fcf_margin": over(f("free_cash_flow"), rev),
        "fcf_conversion": over(f("free_cash_flow"), f("net_income")), "debt_to_equity": over(f("total_debt"), f("total_equity")), "share_growth": rate(f("shares_out"), c("y3.shares_out")), "pe": over(c("price"), f("eps")),
        "pfcf": over(cap, f("free_cash_flow")), "ps": over(cap, rev), "pb": over(cap, f("total_equity")), "market_cap": cap,
    }
    return g.select("symbol", f("period_end").alias("period_end"), *(v.alias(k) for k, v in out.items()))


#: Points of the step tables, (least value, points), the first that holds.
ROE_STEPS = MARGIN_STEPS = ((25.0, 25), (18.0, 22), (12.0, 17), (6.0, 10), (0.0, 4))
GROWTH_STEPS = ((30.0, 20), (15.0, 17), (5.0, 12), (0.0, 6))
ROA_STEPS = ((12.0, 15), (7.0, 12), (3.0, 8), (0.0, 3))
LEVERAGE_STEPS = ((0.5, 15), (1.0, 12), (2.0, 8), (4.0, 4))
PE_STEPS = ((10.0, 50), (15.0, 40), (25.0, 30), (40.0, 18), (80.0, 8))
PEG_STEPS = ((0.5, 50), (1.0, 40), (1.5, 30), (2.0, 18), (4.0, 8))


def steps(value: Column, table, at_most: bool = False, missing: int = 0) -> Column:
    """Points of the first step that the value reaches (or stays within), 0 beyond the last; a default where it is null."""
    out = F.lit(0)
    for limit, points in reversed(table):
        out = F.when(value <= limit if at_most else value >= limit, points).otherwise(out)
    return F.when(value.isNull(), missing).otherwise(out)


def quality_value(roe: Column, margin: Column, growth: Column, roa: Column, leverage: Column, pe: Column) -> dict[str, Column]:
    """Quality of 100 (per cents and liabilities to equity) and value of 100: 50 by the multiple, 50 by it over the growth."""
    quality = steps(roe, ROE_STEPS) + steps(margin, MARGIN_STEPS) + steps(growth, GROWTH_STEPS) + steps(roa, ROA_STEPS) + steps(leverage, LEVERAGE_STEPS, True)
    peg = F.when((pe > 0) & (growth > 0), pe / growth)
    return {"quality": quality, "value": steps(pe, PE_STEPS, True) + steps(peg, PEG_STEPS, True, missing=25)}


def valuation_factor(methods: Column, spread: Column) -> Column:
    """1 where two methods or more agree within a quarter, 0.9 within a half, else 0.8."""
    return F.when((methods < 2) | spread.isNull() | (spread > 0.5), 0.8).when(spread > 0.25, 0.9).otherwise(1.0)


def confidence(percentile: Column, inside: Column, positive: Column, psr: Column, dsr: Column, factor: Column, cap: float = 25.0) -> Column:
    """0 to 100: the percentile times the record's reliability (0.4, 0.3 and 0.3 of its three shares) times the factor.

    Names outside the validated universe are capped.
    """
    raw = percentile * (0.4 * positive + 0.3 * psr + 0.3 * dsr) * factor
    return F.when(inside, raw).otherwise(F.least(raw, F.lit(cap)))


#: Weights of the archetypes over METRICS; a negative one counts the lower the better.
ARCHETYPES = {
    "profitable_compounder": (("roic", 0.30), ("fcf_margin", 0.25), ("margin_trend", 0.20), ("revenue_cagr", 0.15), ("share_growth", -0.10)),
    "hypergrowth_disruptor": (("revenue_cagr", 0.40), ("revenue_growth_acceleration", 0.35), ("margin_trend", 0.25)),
    "value_turnaround": (("pfcf", -0.30), ("pb", -0.20), ("margin_trend", 0.30), ("fcf_margin", 0.20)),
}


def archetypes(metrics: DataFrame, *, clip: float = 3.0, least: float = 0.5) -> DataFrame:
    """metrics with z_* of the used ones, and per archetype its coverage c_* and score s_* of 100; best, top, flags, present.

    A score is Phi of the weighted mean of the clipped z of what is there; 0 under the least coverage. Means and
    deviations of the universe are one row of aggregates, joined to all.
    """
    from tapeloom.functions.stats import normal_cdf

    used = sorted({m for ws in ARCHETYPES.values() for m, _ in ws})
    ends = metrics.agg(*(x for m in used for x in (F.avg(m).alias(f"__a_{m}"), F.stddev_pop(m).alias(f"__s_{m}"), F.count(m).alias(f"__n_{m}"))))
    x = metrics.crossJoin(F.broadcast(ends))
    z = lambda m: F.when((F.col(f"__n_{m}") >= 2) & (F.col(f"__s_{m}") > 1e-12), (F.col(m) - F.col(f"__a_{m}")) / F.col(f"__s_{m}")).otherwise(0.0)
    x = x.withColumns({f"z_{m}": F.when(F.col(m).isNotNull(), z(m)) for m in used}).drop(*(f"__{k}_{m}" for k in "asn" for m in used))
    for name, ws in ARCHETYPES.items():
        signed = {m: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(f"z_{m}") if w > 0 else -F.col(f"z_{m}"))) for m, w in ws}
        there = {m: F.col(f"z_{m}").isNotNull() for m, _ in ws}
        held = sum((F.when(there[m], abs(w)).otherwise(0.0) for m, w in ws), F.lit(0.0))
        total = sum((F.when(there[m], abs(w) * signed[m]).otherwise(0.0) for m, w in ws), F.lit(0.0))
        x = x.withColumn(f"c_{name}", F.round(held, 9)).withColumn(f"s_{name}", F.when(F.col(f"c_{name}") < least, 0.0).otherwise(100 * normal_cdf(total / held)))
    flags = F.concat_ws(",", F.when(F.col("share_growth") > 0.05, "high-dilution"), F.when(F.col("debt_to_equity") > 2, "high-debt"), F.when(F.col("margin_trend") < 0, "margin-declining"), F.when(F.col("fcf_margin") < 0, "negative-fcf"))
    top = F.greatest(*(F.round(f"s_{k}", 6) for k in ARCHETYPES))
    best = F.coalesce(*(F.when(F.round(f"s_{k}", 6) == F.col("top"), F.lit(k)) for k in ARCHETYPES))
    present = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    return x.withColumns({"top": top, "flags": flags, "present": present}).withColumn("best", best)
