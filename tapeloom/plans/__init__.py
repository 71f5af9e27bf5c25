"""All registered queries of the reference's operators."""

from tapeloom.plans import analysis, candles, chart, ingest, live, market, measures, reading, selection, signals, structure, tables, windows, wyckoff  # noqa: F401
from tapeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
