"""Small helpers that the training-text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.storage import counted, new_folder, saved

__all__ = ["WORD", "counted", "crc_of", "cut", "free_name", "new_folder", "per_text", "share_of", "short_batches", "slices", "table", "words_in"]

#: Write a table to the shared folder and read it back: later steps don't recompute it if executors are lost.
cut = saved

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return in it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and both the JVM and the worker hold a batch whole.
BATCH = 1024


def short_batches() -> None:
    """Lower the session's rows of an Arrow batch to BATCH, if it holds more."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


#: Texts that become Python strings at once, whatever the size of an Arrow batch.
TEXTS = 256


def slices(texts: pa.Array) -> Iterator[list]:
    """The values as Python objects, a few at a time, so that a worker never holds a batch twice."""
    for at in range(0, len(texts), TEXTS):
        yield texts.slice(at, TEXTS).to_pylist()


def per_text(function: Callable[[str | None], Any], spark_type: str, arrow_type: pa.DataType) -> Callable[[Column | str], Column]:
    """A column function from a function of one text; null texts are passed as None."""

    short_batches()

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([function(t) for t in some], arrow_type) for some in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)

    return F.arrow_udf(run, spark_type)


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_of(key: Column) -> Column:
    """A number from 0 to 1 (less than 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def crc_of(doc_id: Column) -> Column:
    """CRC-32 of the identifier's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))

