"""Folds: series of any length pass through a small state machine, batch by batch.

Spark partitions by series and sorts by time; a task streams the sorted rows as Arrow batches and carries the machine's
state from one batch to the next, so a series is never held whole. What a window can compute is computed by windows
before the fold; the machine keeps only what feeds back on itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Machine:
    """One series: push() gets its rows in order, a stretch at a time, and returns rows as dictionaries; close() the rest."""

    def step(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def push(self, batch: pa.RecordBatch) -> list[dict]:
        return [out for row in batch.to_pylist() for out in self.step(row)]

    def close(self) -> list[dict]:
        return []


def fold(rows: DataFrame, by: list[str], order: list[str | Column], machine: Callable[[], Machine], schema: StructType) -> DataFrame:
    """The rows that a machine of each series returns; ``by`` columns of schema are filled in."""
    kind = to_arrow_schema(schema)

    def run(batches):
        held, key, done = None, None, []

        def told():
            out = [pa.RecordBatch.from_pylist([dict(zip(by, k, strict=True)) | r for k, r in done], schema=kind)] if done else []
            done.clear()
            return out

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if held is None or keys[at] != key:
                    if held is not None:
                        done += [(key, r) for r in held.close()]
                    held, key = machine(), keys[at]
                done += [(key, r) for r in held.push(b.slice(at, end - at))]
                at = end
            yield from told()
        if held is not None:
            done += [(key, r) for r in held.close()]
        yield from told()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def schema_of(rows: DataFrame, like: list[str], more: str) -> StructType:
    """Columns of rows under their types, and further ones as DDL."""
    return StructType([rows.schema[c] for c in like] + list(StructType.fromDDL(more).fields))
