"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.operators.intermediate import materialise, release  # noqa: F401  used by the operators

#: Bytes of one Arrow batch handed to Python; a batch of long texts holds few rows.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_BYTES`` at most, or of one row.

    Spark reads the limit when the plan runs, so it stays set in the session;
    it bounds the bytes of a batch and changes no result.  A smaller limit of
    the session's own is kept.
    """
    spark = df.sparkSession
    held = spark.conf.get(_LIMIT)
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def marked(rows: DataFrame, ids: DataFrame, log_words: int = 16) -> DataFrame:
    """``rows`` with ``_mark``: false where the row's ``id`` is surely not among ``ids``.

    A bitmap of hashed ids, 2**log_words words of 64 bits and never more, goes
    to every executor, so that only the marked rows need a shuffled join.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << (log_words + 6)))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    word = F.shiftright("_place", 6)
    bitmap = ids.select(place.alias("_place")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = rows.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    return out.withColumn("_mark", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word", "_bits")


def utf8_sizes(texts: pa.Array) -> list[int]:
    """UTF-8 bytes of each text of an Arrow column; a null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def byte_runs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Half-open index ranges of consecutive texts of about ``limit`` bytes each."""
    start, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if i >= start:
        yield start, i + 1


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with these columns in the schema's order and types."""
    arrays = []
    for f in schema:
        c = columns[f.name]
        c = c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
        arrays.append(c if c.type == f.type else c.cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
