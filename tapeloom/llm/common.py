"""Helpers shared by the training-data operators: the shared folder, written tables, the word class, hold-out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: the white space that parts words, and the fold of the hold-out.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
FOLDS, HELD_FOLD = 4, 2


#: Where the session names no shared folder (tests): one of our own per application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in one process (tests), one made here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tapeloom-shared-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Unlike cached blocks the files outlive any executor, and their size is known to the planner, so small
    tables are broadcast only below the configured threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a table that stash() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """pyarrow's file system of a folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves the held-out remainder; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in short slices of themselves, so that few texts at once become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
