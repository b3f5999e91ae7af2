"""Queries of sources, set operations, composite flows and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, tree
from ..sources import io
from ..streaming import flows
from .registry import bound, query, rows

D = "DECIMAL(20,2)"
SUM = f"CAST(sum(amount) AS {D})"


@query("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def latest_status(spark, sf):
    return flows.latest_status(bound(spark, sf, "SELECT user_id, event_type, ts, event_id FROM events"), "user_id", "event_type", ["ts", "event_id"])


@query("audit_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_counts(spark, sf):
    return flows.audit_counts(bound(spark, sf, "SELECT ts, event_type FROM events"))


@query("upload_policy_filter", "SELECT event_id, (event_id % 4 = 0 AND event_id % 3 = 0 OR event_id % 4 = 2 AND event_id % 3 = 2) AND user_id % 9 <> 0 AS accepted FROM events")
def upload_policy_filter(spark, sf):
    files = bound(
        spark, sf,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'program' WHEN 1 THEN 'other' WHEN 2 THEN 'agreement' ELSE 'finance_report' END AS document_type, concat('/in/', event_id, CASE event_id % 3 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.txt' ELSE '.pdf' END) AS path, CASE WHEN user_id % 9 = 0 THEN 200000000 ELSE 1000 END AS length FROM events",
    )
    return io.upload_policy_filter(files).select("event_id", "accepted")


@query("scan_pages", r"SELECT doc_id, count(*) AS pages, CAST(sum(length(trim(regexp_replace(p, '\s+', ' ', 'g')))) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1")
def scan_pages(spark, sf):
    pages = io.scan_pages(bound(spark, sf, "SELECT doc_id, text FROM documents"), "\n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.char_length("text")).alias("chars"))


@query("scan_payload", f"SELECT o_custkey AS doc_id, o_orderkey AS key, CAST(o_totalprice AS {D}) AS amount FROM orders")
def scan_payload(spark, sf):
    df = bound(spark, sf, f"SELECT o_custkey AS doc_id, o_orderkey AS key, CAST(o_totalprice AS {D}) AS amount FROM orders")
    payload = df.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(F.struct("key", "amount")).alias("funding_lines"))).alias("payload"))
    return io.scan_payload(payload, "payload", "funding_lines array<struct<key: bigint, amount: decimal(20,2)>>", "funding_lines")


@query("scan_fragments", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1")
def scan_fragments(spark, sf):
    df = bound(spark, sf, "SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN '  ' ELSE l_returnflag END AS text FROM lineitem")
    return io.scan_fragments(df).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("union_evidence", f"SELECT node_id, year, {SUM} AS amount FROM (SELECT node_id, year, amount FROM current UNION ALL SELECT node_id, year, amount FROM target) GROUP BY ALL")
def union_evidence(spark, sf):
    """U1."""
    both = rows(spark, sf, "current").unionByName(rows(spark, sf, "target"))
    return both.groupBy("node_id", "year").agg(tree.total().alias("amount"))


@query("union_keys", "SELECT node_id, year FROM current UNION SELECT node_id, year FROM target")
def union_keys(spark, sf):
    """U2."""
    return rows(spark, sf, "current").select("node_id", "year").union(rows(spark, sf, "target").select("node_id", "year")).distinct()


@query("except_keys", "SELECT node_id, year FROM current EXCEPT SELECT node_id, year FROM target")
def except_keys(spark, sf):
    """U3."""
    return rows(spark, sf, "current").select("node_id", "year").distinct().join(rows(spark, sf, "target").select("node_id", "year"), ["node_id", "year"], "left_anti")


@query("chunk_document_join", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def chunk_document_join(spark, sf):
    """D29."""
    docs = bound(spark, sf, "SELECT doc_id, source FROM documents")
    return docs.join(bound(spark, sf, "SELECT doc_id, quality FROM labels WHERE quality = 1"), "doc_id")


@query(
    "auto_pipeline",
    f"""WITH w AS (SELECT node_id, year, source_type, {SUM} AS n FROM target GROUP BY ALL), h AS (SELECT node_id, year, source_type, {SUM} AS o FROM current GROUP BY ALL),
    k AS (SELECT node_id, year, source_type, coalesce(n, o) AS amount, n IS NULL AND o IS NOT NULL AS gone FROM w FULL JOIN h USING (node_id, year, source_type))
    SELECT node_id, year, source_type, CAST(CASE WHEN gone THEN 0 ELSE amount END AS {D}) AS amount FROM k""",
)
def auto_pipeline(spark, sf):
    """Differences, resolved and applied to the current lines, give the target's amounts."""
    lines = rows(spark, sf, "current").groupBy("node_id", "year", "source_type").agg(tree.total().alias("amount")).withColumn("line_no", F.lit(1)).withColumn("line_id", F.lit(1))
    items = changes.build_change_set(rows(spark, sf, "target"), rows(spark, sf, "current")).withColumn("has_conflict", F.lit(False))
    ready = changes.resolve(items).where("resolution = 'resolved'")
    return changes.apply_amounts(lines, ready, ["change_type"]).drop("line_no")


@query("activate_version", "SELECT o_custkey AS program_id, o_orderkey AS version_number, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS active FROM orders")
def activate_version(spark, sf):
    """The uploaded version is current, all before it are not."""
    v = bound(spark, sf, "SELECT o_custkey AS program_id, o_orderkey AS version_number, true AS approved FROM orders")
    return changes.lifecycle(v).select("program_id", "version_number", (F.col("status") == "current").alias("active"))


@query("apply_new_objects", f"SELECT parent_id, n, CAST(amount AS {D}) AS amount FROM (SELECT node_id AS parent_id, count(*) AS n, sum(amount) AS amount FROM items WHERE is_new GROUP BY 1)")
def apply_new_objects(spark, sf):
    """New objects under their parents, numbered, with their lines."""
    new = rows(spark, sf, "items").where("is_new").select(F.col("node_id").alias("parent_id"), F.col("item_id").alias("seq"), "amount")
    numbered = tree.next_sibling_number(rows(spark, sf, "nodes").select("parent_id", "display_number").where("parent_id like 'C%'"), new)
    return numbered.groupBy("parent_id").agg(F.countDistinct("number").alias("n"), tree.total().alias("amount"))


@query("instructions_to_items", "SELECT o_orderkey AS command_id, CASE WHEN o_orderkey BETWEEN 2000 AND 2099 THEN 'amount' ELSE CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'year' ELSE 'amount' END END AS missing FROM orders")
def instructions_to_items(spark, sf):
    """P25: the fields that a command lacks; an amount like a year (20xx) is a year and no amount."""
    from ..functions import money, text

    df = bound(spark, sf, "SELECT o_orderkey AS command_id, CASE o_orderkey % 3 WHEN 0 THEN concat('Установить ', o_orderkey, ' в 2026') WHEN 1 THEN concat('Установить ', o_orderkey) ELSE 'Установить в 2026' END AS command FROM orders")
    c = F.col("command")
    missing = F.array_compact(F.array(F.when(F.size(text.instruction_years(c)) == 0, "year"), F.when(money.extract_last_amount(c).isNull(), "amount")))
    return df.select("command_id", F.array_join(missing, ",").alias("missing"))
