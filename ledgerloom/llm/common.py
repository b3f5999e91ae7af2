"""Shared pieces of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return it without its lineage.

    The folder is the session's spark.checkpoint.dir. Only where that is unset in local mode, as in
    tests, a temporary folder is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(local_folder(spark))
    return df.checkpoint(eager=True)


def local_folder(spark: SparkSession) -> str:
    """A new temporary folder; an error on a cluster, whose machines do not share one."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Say in a Python worker that owner works in it now: what other operators keep there is freed.

    Workers live on from stage to stage, and so would their caches.
    """
    others = [n for n in _kept if n != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give freed memory back, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        pa.default_memory_pool().release_unused()
    _kept[owner] = clear


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about most_bytes of text; a longer single text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def key_columns(df: DataFrame, text: str = "text") -> list:
    """Columns that name a document where doc_id may be null or repeat: equal rows are one document."""
    return [F.col("doc_id"), F.xxhash64(F.col(text)).alias("text_key")]
