"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: extensions by document type, and the largest upload.
EXTENSIONS = {"program": ["docx"], "finance_report": ["xlsx", "xls"], "agreement": ["pdf"], "procedure": ["pdf"]}
MOST_BYTES = 100 * 1024 * 1024


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """A2: grid cells without blank ones."""
    return spark.read.parquet(path).where(F.trim("text") != "")


def scan_pages(docs: DataFrame, marker: str = "\f") -> DataFrame:
    """A4: a row a page, with its number and normalized text."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", marker)).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).alias("page_number"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def scan_fragments(fragments: DataFrame) -> DataFrame:
    """A5: positioned fragments that are not blank."""
    return fragments.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def scan_payload(df: DataFrame, column: str, schema: str, part: str) -> DataFrame:
    """A3: the rows of an array in a JSON payload; a missing array gives none."""
    return df.withColumn("__p", F.from_json(column, schema)).select(*(c for c in df.columns if c != column), F.explode(f"__p.{part}").alias("e")).select("*", "e.*").drop("e")


def upload_policy_filter(files: DataFrame) -> DataFrame:
    """Files (document_type, path, length) with accepted."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    ok = F.lit(False)
    for kind, exts in EXTENSIONS.items():
        ok = ok | (F.col("document_type") == kind) & ext.isin(exts)
    return files.withColumn("accepted", ok & (F.col("length") <= MOST_BYTES))


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version of a table of documents, and the folder of each bucket that has rows; as many entries as the table has buckets."""
    try:
        rows = spark.read.schema("version int, bucket int, folder string").parquet(f"{path}/manifest")
    except AnalysisException:  # nothing there yet
        return 0, {}
    newest = rows.agg(F.max("version")).first()[0]
    if newest is None:
        return 0, {}
    return newest, {r.bucket: r.folder for r in rows.where(F.col("version") == newest).collect() if r.folder is not None}


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest version of a table that replace_by_document has written; schema serves for a table without rows."""
    folders = [f"{path}/{folder}/bucket={b}" for b, folder in sorted(manifest(spark, path)[1].items())]
    if not folders:
        if schema is None:
            raise ValueError(f"no rows in {path}, and no schema")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*folders)


def replace_by_document(df: DataFrame, path: str, key: str, buckets: int = 64, docs: DataFrame | None = None) -> None:
    """Idempotent reload: all rows of the documents are replaced, those of other documents stay.

    docs has the key of each document that is loaded; one without rows in df is emptied. Without docs they are those of df. Rows lie in
    `buckets` folders by a hash of the key, so their number does not grow with the documents; only buckets that hold a document of the
    load are written, into folders of the new version. A manifest of the folders is written last, in one file: until then readers see
    the version before, so a load that fails halfway leaves it as it was and may be run again. One writer at a time; a table keeps its
    number of buckets.
    """
    spark = df.sparkSession
    in_bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    version, folders = manifest(spark, path)
    keys = (df if docs is None else docs).select(key).distinct()
    touched = [r.b for r in keys.select(in_bucket.alias("b")).distinct().collect()]
    old = [f"{path}/{folders[b]}/bucket={b}" for b in touched if b in folders]
    out = df if docs is None else df.join(keys, key, "left_semi")
    if old:
        out = out.unionByName(spark.read.schema(df.schema).parquet(*old).join(keys, key, "left_anti").select(df.columns))
    folder = f"{version + 1}-{uuid.uuid4().hex}"
    dealt = out.withColumn("bucket", in_bucket).repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(4)))
    dealt.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    filled = {r.bucket for r in spark.read.schema("bucket int").parquet(f"{path}/{folder}").distinct().collect()}
    entries = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in filled}
    rows = [(version + 1, b, f) for b, f in entries.items()] or [(version + 1, None, None)]
    spark.createDataFrame(rows, "version int, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_reconciliation_report(totals: DataFrame, by: str, path: str) -> None:
    """Nested JSON, a document a line."""
    rows = F.struct(*(c for c in totals.columns if c != by))
    totals.groupBy(by).agg(F.sort_array(F.collect_list(rows)).alias("totals")).write.mode("overwrite").json(path)


def write_change_report(items: DataFrame, path: str) -> None:
    """A flat report."""
    items.write.mode("overwrite").option("header", True).csv(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append only, partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
