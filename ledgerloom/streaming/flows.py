"""Structured Streaming: ingestion, latest states, audit counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import parse_money
from ..functions.text import normalize_source_catalog
from ..operators.grid import document_profile
from ..operators.planning import chunk_pages
from ..operators.stages import dealt, settled
from ..sources.io import EXTENSIONS, read_documents, replace_by_document


#: A parser's table of the documents that it could not read.
FAILED = "failed"
#: Arrivals that a task parses.
PARSED = 100_000


def ingest_batch(parse: Callable[[DataFrame], dict[str, DataFrame]], path: str, key: str = "doc_id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A10: parse a batch of arrivals and reload their documents in all tables that the parser gives.

    parse(arrivals) gives tables by name, each with the key, and may give `failed` (key, error). A failed document keeps its rows of
    before, has the status `failed` with its error, and its arrival lies in the table `quarantine` until it is read; the others get the
    status `parsed`. A document without rows is emptied. The table `batches`, written last, has the batches that are done: one that
    runs again after that is left out, and one that failed halfway is loaded again with the same result. Arrivals are dealt by their
    number: texts of one kind pack so well that few scan tasks would parse them all.
    """

    def load(arrivals: DataFrame, batch_id: int) -> None:
        spark = arrivals.sparkSession
        if not read_documents(spark, f"{path}/batches", "batch_id long").where(F.col("batch_id") == batch_id).isEmpty():
            return
        arrivals = settled(dealt(settled(arrivals), key, rows=PARSED))
        tables = dict(parse(arrivals))
        docs = arrivals.select(key).distinct()
        failed = tables.pop(FAILED, None)
        failed = docs.limit(0).withColumn("error", F.lit(None).cast("string")) if failed is None else settled(failed.groupBy(key).agg(F.min("error").alias("error")))
        good = settled(docs.join(failed, key, "left_anti"))
        for name, rows in tables.items():
            replace_by_document(rows, f"{path}/{name}", key, buckets, good)
        replace_by_document(arrivals.join(failed, key, "left_semi"), f"{path}/quarantine", key, buckets, docs)
        told = good.select(key, F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(failed.select(key, F.lit("failed").alias("status"), "error"))
        replace_by_document(told.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{path}/status", key, buckets)
        replace_by_document(spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")), f"{path}/batches", "batch_id", 1)

    return load


def stream_ingest(spark: SparkSession, source: str, schema: str, parse: Callable[[DataFrame], dict[str, DataFrame]], path: str, key: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """All files that have arrived, then stop."""
    arrivals = spark.readStream.schema(schema).parquet(source)
    return arrivals.writeStream.foreachBatch(ingest_batch(parse, path, key, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a document's payload holds: its pages and its funding lines.
PAYLOAD = "struct<pages: array<string>, lines: array<struct<name: string, year: int, source: string, amount: string, unit: string>>>"


def parse_payloads(arrivals: DataFrame, topics: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Arrivals (doc_id, document_type, payload as JSON) to tables: lines, profile, pages, chunks and totals by year and source; failed are
    documents of an unknown type, without a readable payload, or with an amount that is no number.

    Payloads and lines are read once and settled, not once for each table."""
    read = settled(arrivals.select("doc_id", F.from_json("payload", PAYLOAD).alias("p"), F.col("document_type").isin(*EXTENSIONS).alias("known")))
    lines = read.where("p is not null").select("doc_id", F.posexplode("p.lines").alias("line_no", "e"))
    lines = settled(lines.select("doc_id", "line_no", "e.name", "e.year", normalize_source_catalog(F.col("e.source")).alias("source_type"), F.when(F.col("e.unit") == "thousand_rub", parse_money(F.col("e.amount"), "thousand_rub")).otherwise(parse_money(F.col("e.amount"))).alias("amount")))
    bad = lines.where("amount is null").select("doc_id").distinct().withColumn("bad", F.lit(True))
    error = F.when(~F.col("known"), "unknown_type").when(F.col("p").isNull() | (F.col("p.lines").isNull() & F.col("p.pages").isNull()), "unreadable").when(F.col("bad"), "bad_amount")
    failed = read.join(bad, "doc_id", "left").select("doc_id", error.alias("error")).where("error is not null")
    pages = read.where("p is not null").select("doc_id", F.posexplode("p.pages").alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("page_number"), "text")
    return {
        "lines": lines,
        "profile": document_profile(lines),
        "pages": pages,
        "chunks": chunk_pages(pages, topics or {}, fallback="text") if topics else pages.select("doc_id", F.lit("text").alias("topic"), "page_number", "text"),
        "totals": lines.groupBy("doc_id", "year", "source_type").agg(F.sum("amount").cast("decimal(20,2)").alias("amount")),
        FAILED: failed,
    }


def latest_status(events: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    """R2: the newest state of each id, for streams (update mode) and tables."""
    return events.groupBy(by).agg(F.max_by(status, F.struct(*order)).alias("status"))


def audit_counts(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """Counts by hour and action; on a stream rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
