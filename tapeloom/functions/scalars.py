"""Scalar expressions: labels, scores, dates and text, as Column functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The label of the first step that the value is under (or at, unless strict), else the last label."""
    out = F.lit(otherwise)
    for limit, label in reversed(steps):
        out = F.when(value < limit if strict else value <= limit, label).otherwise(out)
    return F.when(value.isNull(), None).otherwise(out)


#: Limits of the label ladders.
RVOL = [(0.5, "low"), (1.5, "normal"), (3.0, "high"), (4.0, "very_high")]
FUNDING = [(-0.0005, "heavy_short"), (-0.0001, "short"), (0.0001, "neutral"), (0.0005, "long")]


def rvol_label(rvol: Column) -> Column:
    return ladder(rvol, RVOL, "extreme", strict=True)


def funding_label(rate: Column) -> Column:
    return ladder(rate, FUNDING, "heavy_long")


def close_location(high: Column, low: Column, close: Column) -> Column:
    part = (close - low) / (high - low)
    return F.when(high <= low, "mid").when(part >= 0.7, "high").when(part <= 0.3, "low").otherwise("mid")


def oi_quadrant(price_change: Column, oi_change: Column) -> Column:
    up, more = price_change > 0, oi_change > 0
    down, less = price_change < 0, oi_change < 0
    return F.when(up & more, "new_longs").when(down & more, "new_shorts").when(up & less, "short_covering").when(down & less, "long_liquidation").otherwise("neutral")


def obi_regime(x: Column) -> Column:
    return F.when(x >= 0.6, "strong_bid").when(x >= 0.2, "bid").when(x <= -0.6, "strong_ask").when(x <= -0.2, "ask").otherwise("balanced")


def entry_state(score: Column, veto: Column) -> Column:
    return F.when(veto, "AVOID").when(score >= 70, "ENTER_NOW").when(score >= 50, "SCALE_IN").when(score >= 35, "WAIT").otherwise("AVOID")


def rating(fair: Column, price: Column) -> Column:
    """-3 to 3 by the fair value's distance from the price, at 10, 25 and 50 per cent."""
    gap = (fair - price) / price
    return F.when(price <= 0, None).when(gap >= 0.5, 3).when(gap >= 0.25, 2).when(gap >= 0.10, 1).when(gap <= -0.5, -3).when(gap <= -0.25, -2).when(gap <= -0.10, -1).otherwise(0)


def range_score(x: Column, low: float, high: float, missing: float = 50.0, log: bool = False) -> Column:
    """0 at ``low`` to 100 at ``high``, linear or in logarithms, clamped; a default where it is missing."""
    ln = (lambda c: F.log(c)) if log else (lambda c: c)
    lo, hi = ln(F.lit(float(low))), ln(F.lit(float(high)))
    part = (ln(x) - lo) / (hi - lo) * 100
    bad = x.isNull() | (x <= 0) if log else x.isNull()
    return F.when(bad, missing).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), part)))


def sector_of(code: Column) -> Column:
    """Coarse sector of an industry code; the first range that holds it."""
    ranges = [(100, 999, "agriculture"), (1000, 1499, "mining"), (1500, 1799, "construction"), (2000, 3999, "manufacturing"), (4000, 4999, "transport_utilities"), (5000, 5199, "wholesale"), (5200, 5999, "retail"), (6000, 6799, "finance"), (7000, 8999, "services")]
    out = F.lit("other")
    for lo, hi, name in reversed(ranges):
        out = F.when(code.between(lo, hi), name).otherwise(out)
    return out


def add_months_clamped(day: Column, months: int | Column) -> Column:
    return F.add_months(day, months)


def first_of_month(day: Column) -> Column:
    return F.trunc(day, "month")


def add_years_clamped(day: Column, years: int) -> Column:
    return F.add_months(day, 12 * years)


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in (start, end], in closed form: whole weeks and the weekdays of the rest."""
    upto = lambda d: (lambda n: F.floor(n / 7) * 5 + F.least(F.lit(5), F.pmod(n, F.lit(7))))(F.datediff(d, F.lit("1970-01-05").cast("date")) + 1)
    return F.when(end > start, upto(end) - upto(start)).otherwise(0).cast("long")


def symbol_norm(raw: Column) -> Column:
    return F.upper(F.trim(raw))


#: Needles of the headline signals, the first list with a hit wins.
SIGNALS = (
    ("guidance_negative", ("cuts guidance", "cut guidance", "lowers guidance", "guidance cut", "profit warning", "warns", "misses estimates", "demand slows", "weak demand")),
    ("guidance_positive", ("raises guidance", "raised guidance", "boosts forecast", "raises outlook", "beats estimates", "raises forecast")),
    ("contract_negative", ("loses contract", "lost contract", "contract terminated", "terminates contract", "contract canceled", "contract cancelled", "contract dispute")),
    ("contract_positive", ("wins contract", "contract win", "contract award", "awarded contract", "multi-year cloud contract", "multi-year deal", "customer win", "strategic partnership")),
    ("demand_negative", ("order slowdown", "orders slow", "backlog declines", "churn rises", "renewal rates fall")),
    ("demand_positive", ("strong demand", "orders rise", "record backlog", "backlog rises", "usage growth")),
    ("margin_negative", ("margin pressure", "costs rise", "cost inflation", "supply shortage", "capacity constraint")),
    ("legal_negative", ("investigation", "lawsuit", "probe", "antitrust", "regulatory scrutiny")),
)
#: Forms of filings that are watched where no needle hits.
WATCH_FORMS = ("8-K", "10-Q", "10-K", "S-1", "S-3", "DEF 14A")


def classified(title: Column, origin: Column, form: Column, signals=SIGNALS) -> Column:
    """headline_signal, or ``filing_watch`` for a watched form of a filing."""
    return F.coalesce(headline_signal(title, signals), F.when((F.upper(origin) == "SEC") & F.upper(form).isin(*WATCH_FORMS), "filing_watch"))


def direction(signal: Column) -> Column:
    return F.substring_index(signal, "_", -1)


def impact(signal: Column) -> Column:
    """Confidence of a signal's kind."""
    return F.when(F.split_part(signal, F.lit("_"), F.lit(1)).isin("guidance", "contract"), "high").when(signal.isNotNull(), "medium")


def headline_signal(title: Column, signals=SIGNALS) -> Column:
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for name, needles in reversed(signals):
        hit = low.contains(needles[0])
        for n in needles[1:]:
            hit = hit | low.contains(n)
        out = F.when(hit, name).otherwise(out)
    return out


def money(text: Column) -> Column:
    """Number of a cell: thousands commas, $ and T/B/M/K suffixes; -- and N/A are null."""
    bare = F.upper(F.regexp_replace(F.trim(text), r"[$,\s]", ""))
    number = F.regexp_extract(bare, r"^\(?(-?[0-9]*\.?[0-9]+)", 1)
    unit = F.regexp_extract(bare, r"([TBMK])\)?$", 1)
    scale = F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)
    sign = F.when(bare.startswith("("), -1.0).otherwise(1.0)
    return F.when(number != "", number.cast("double") * scale * sign)


def percent(text: Column) -> Column:
    """The first percentage in a cell, as a share."""
    p = F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)\s*%", 1)
    return F.when(p != "", p.cast("double") / 100)


def dealing_zone(price: Column, low: Column, high: Column, buffer: float = 0.02) -> Column:
    """premium, discount or equilibrium against the middle of the range; undefined where it is degenerate."""
    mid, span = (low + high) / 2, high - low
    return F.when(span <= 0, "undefined").when(price > mid + buffer * span, "premium").when(price < mid - buffer * span, "discount").otherwise("equilibrium")
