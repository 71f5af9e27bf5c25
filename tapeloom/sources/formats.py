"""Readers of text feeds into catalog rows: CSV, pipe-delimited, JSON and XML through Spark's own sources.

Every reader takes a path that Spark can open and a fixed schema; nothing is inferred from data. Headers are matched
without case and spacing, blanks are missing values, and a missing required column is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header_norm(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").split())


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), *, sep: str = ",", aliases: dict[str, str] | None = None) -> DataFrame:
    """All columns as trimmed text under normalised names; blank cells are null."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    names = {c: (aliases or {}).get(header_norm(c), header_norm(c)) for c in raw.columns}
    missing = set(required) - set(names.values())
    if missing:
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    blank = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")))
    return raw.select(*(blank(c).alias(n) for c, n in names.items()))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; a cell that isn't of the type is null. Columns that the feed lacks are null."""
    return df.select(*((F.expr(f"try_cast({c} AS {t})") if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()))


def number(c: Column) -> Column:
    """Numbers with thousands commas, negatives in parentheses; a dot or dashes are missing."""
    bare = F.regexp_replace(c, r"[,\s$]", "")
    digits = F.regexp_extract(bare, r"([0-9]+\.?[0-9]*(?:[eE]-?[0-9]+)?)", 1)
    sign = F.when(bare.startswith("(") | bare.startswith("-"), -1.0).otherwise(1.0)
    return F.when(digits != "", digits.cast("double") * sign)


def truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "t", "yes", "y"), True).when(low.isin("0", "false", "f", "no", "n"), False)


def unpivot(df: DataFrame, keys: list[str], name: str, value: str, values: list[str] | None = None) -> DataFrame:
    """Wide columns to rows, missing values dropped; one pass, no shuffle."""
    cols = values or [c for c in df.columns if c not in keys]
    return df.unpivot(keys, cols, name, value).where(F.col(value).isNotNull())


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a line."""
    return spark.read.schema(schema).json(path)


def arrays_to_rows(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays of a document to a row an element."""
    return df.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("z")).select(*keys, *(F.col(f"z.{a}").alias(a) for a in arrays))


def read_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of an XML feed, one a line, so that any split of a file can be read alone; the malformed yield no row."""
    x = spark.read.text(path).select(F.from_xml("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return x.select("x.*").dropna("all")


def fixed_width(lines: DataFrame, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Columns name -> (first, length, type) of text lines in column ``value``."""
    cell = lambda a, n, t: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS {t})")
    return lines.select(*(cell(*spec).alias(c) for c, spec in fields.items()))


def canonical(df: DataFrame, exclude: tuple[str, ...] = ("source",)) -> Column:
    """A row's canonical text: columns by name, numbers in full, NaN and missing values blank."""
    cols = sorted(c for c in df.columns if c not in exclude)
    kind = dict(df.dtypes)
    cell = lambda c: F.coalesce((F.when(~F.isnan(c), F.col(c)) if kind[c] in ("double", "float") else F.col(c)).cast("string"), F.lit(""))
    return F.concat_ws("\x1f", *(cell(c) for c in cols))


def content_hash(df: DataFrame) -> DataFrame:
    """(n, hash): an order-independent digest of all rows.

    Row digests are summed as 128-bit numbers, so that the hash needs one partial aggregation and no sort.
    """
    d = df.select(F.sha2(canonical(df), 256).alias("d"))
    part = lambda at: F.sum(F.conv(F.substring("d", at, 14), 16, 10).cast("decimal(38,0)"))
    return d.agg(F.count("*").alias("n"), part(1).alias("a"), part(15).alias("b")).select("n", F.sha2(F.concat_ws(":", F.coalesce(F.col("a"), F.lit(0)).cast("string"), F.coalesce(F.col("b"), F.lit(0)).cast("string"), F.col("n").cast("string")), 256).alias("hash"))


def write_snapshot(df: DataFrame, path: str) -> dict:
    """Write rows and a manifest beside them; returns the manifest."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    h = content_hash(df.sparkSession.read.parquet(f"{path}/rows")).first()
    manifest = {"n": h["n"], "hash": h["hash"], "columns": ",".join(sorted(df.columns))}
    df.sparkSession.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot; an error unless they have the manifest's hash and columns."""
    want = spark.read.schema("n long, hash string, columns string").json(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/rows")
    got = content_hash(rows).first()
    if want is None or (got["n"], got["hash"], ",".join(sorted(rows.columns))) != (want["n"], want["hash"], want["columns"]):
        raise ValueError(f"{path}: the rows don't match the manifest")
    return rows


def pinned(path: str, strict: bool = True) -> str:
    """The path, if it names a snapshot; in strict mode any other is refused."""
    if strict and "/snapshot-" not in path:
        raise ValueError(f"{path}: only pinned snapshots are read in strict mode")
    return path
