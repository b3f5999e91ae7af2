"""Work in stages: what a stage has found is written down before the next one begins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once, without its lineage, as files in the session's shared checkpoint folder.

    A checkpoint would keep the conditions on its columns by old ids, and unions of such tables fail on them ("key not found").
    Where spark.checkpoint.dir is unset, a temporary folder serves in local mode; on a cluster that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    at = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Rows of a task where a step sorts or sums rows by many keys.
DEALT = 500_000


def tasks(df: DataFrame, rows: int = DEALT) -> int:
    """So many tasks that each gets about `rows` rows of df, but at least the session's; the rows are counted."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """df by its keys over so many tasks that each gets about `rows` rows; the rows are counted first.

    Short rows pack so well that a shuffle's partitions of the advised size hold millions, which all lie in one task's memory at a time.
    """
    return df.repartition(tasks(df, rows), *keys)
