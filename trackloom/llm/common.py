"""What the corpus operators share: loading tables, Arrow mapping and small numeric helpers."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.operators.graph import min_labels  # noqa: F401
from trackloom.session import ship

#: Rows and bytes of one Arrow batch; they bound a Python worker's memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches; call before any operator that runs Python in tasks."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ready(df.sparkSession)

    @wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what a task has freed: Spark keeps its workers for later tasks, and what idle ones hold is an executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text is a multiple of five; a null id counts as learnable."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts one at a time, so that only one is held as a Python string."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def word_list(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at exactly these six characters."""
    return [] if text is None else text.encode("utf-8").split()
