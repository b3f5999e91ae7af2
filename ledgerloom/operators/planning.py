"""Cell plans, coordinates, order, search and chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded
from .stages import dealt
from .tree import MONEY, total


def latest_parsed_document(registry: DataFrame) -> DataFrame:
    """A1: the newest parsed document of an organization and type; ties go to the larger id."""
    return registry.where("status = 'parsed'").groupBy("org_id", "document_type").agg(F.max_by("doc_id", F.struct("updated_at", "doc_id")).alias("doc_id"))


TABLE = ["doc_id", "table_idx"]


def insert_offsets(rows: DataFrame) -> DataFrame:
    """The row at which an inserted object begins: its anchor, one, and all rows inserted before in its table."""
    before = F.sum("n_rows").over(W.partitionBy(*TABLE).orderBy("anchor", "seq").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("row_idx", (F.col("anchor") + 1 + F.coalesce(before, F.lit(0))).cast("bigint"))


def shift_coordinates(updates: DataFrame, insertions: DataFrame, inclusive: bool = False) -> DataFrame:
    """Rows moved down by what was inserted above them in their table, by a running sum over both tables' rows."""
    order = F.lit(0 if inclusive else 2)
    marks = insertions.select(*TABLE, F.col("anchor").alias("at"), F.lit(1).alias("kind"), F.col("n_rows").alias("n"), F.lit(None).cast("bigint").alias("update_id"))
    rows = updates.select(*TABLE, F.col("row_idx").alias("at"), (F.lit(2) - order).alias("kind"), F.lit(0).cast("bigint").alias("n"), "update_id")
    moved = marks.unionByName(rows).withColumn("shift", F.sum("n").over(W.partitionBy(*TABLE).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)))
    return moved.where("update_id is not null").select("update_id", (F.col("at") + F.col("shift")).cast("bigint").alias("row_idx"))


def preferred_cell_update(updates: DataFrame, cell: list[str]) -> DataFrame:
    """Of a cell's updates those with a raw value, then not zero, then the later one."""
    w = W.partitionBy(*cell).orderBy(F.desc(F.col("raw").isNotNull()), F.desc(F.col("amount") != 0), F.desc("seq"))
    return updates.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def infer_year_column(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """A missing year's column: the first known year's and the years between."""
    base = known.groupBy("row_id").agg(F.min("year").alias("y"), F.min_by("col_idx", "year").alias("c"))
    return wanted.join(base, "row_id").withColumn("col_idx", F.col("c") + F.col("year") - F.col("y")).where("col_idx > 0").drop("y", "c")


def anchor_row(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The last row that a parent's numbered children take, else its own."""
    last = children.where("display_number is not null").groupBy("parent_id").agg(F.max("row_idx").alias("last"))
    return parents.join(last, parents.node_id == last.parent_id, "left").select("node_id", F.greatest("row_idx", F.coalesce("last", "row_idx")).alias("anchor"))


def order_items(items: DataFrame, category: Column) -> DataFrame:
    """L1: items with their place: category, year (missing last), id."""
    rank = F.when(category == "new_object", 1).when(category == "object_amount_update", 2).when(category == "zeroing", 3).otherwise(4)
    return items.withColumn("place", F.row_number().over(W.partitionBy("set_id").orderBy(rank, F.coalesce("year", F.lit(9999)), "item_id")))


def first_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """L2, L4: the first k rows of each group."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def latest_change_set(sets: DataFrame, able: Column) -> DataFrame:
    """L3: the newest set of an organization that passes a test."""
    return sets.where(able).groupBy("org_id").agg(F.max_by("set_id", F.struct("created_at", "set_id")).alias("set_id"))


def recent_messages(messages: DataFrame, n: int = 10, cut: int = 350, tail: int = 4000) -> DataFrame:
    """The last n turns, each cut, joined in order, the last `tail` characters."""
    last = first_k(messages, ["conv_id"], [F.desc("turn")], n)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.left(F.col("text"), F.lit(cut)).alias("t"))))
    return last.groupBy("conv_id").agg(F.right(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit(tail)).alias("summary"))


def recent_mention(messages: DataFrame, names: DataFrame, n: int = 12) -> DataFrame:
    """The first listed name with a five-letter word's beginning in the last n messages; a stem stands for its first name."""
    said = first_k(messages, ["conv_id"], [F.desc("turn")], n).select("conv_id", F.explode(F.split(folded(F.col("text")), r"[^\p{L}\p{Nd}]+")).alias("w")).where(F.char_length("w") >= 5).select("conv_id", F.left("w", F.lit(5)).alias("stem")).distinct()
    stems = names.select("name_id", F.explode(F.split(folded(F.col("name")), r"[^\p{L}\p{Nd}]+")).alias("w")).where(F.char_length("w") >= 5).groupBy(F.left("w", F.lit(5)).alias("stem")).agg(F.min("name_id").alias("name_id"))
    return said.join(stems, "stem").groupBy("conv_id").agg(F.min("name_id").alias("name_id"))


def search_chunks(chunks: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Chunks with any of six distinct words of four letters or more in title, content or type, newest first."""
    words = list(dict.fromkeys(w for w in query.lower().split() if len(w) >= 4))[:6]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("title").contains(w) | F.lower("content").contains(w) | F.lower("chunk_type").contains(w)
    return chunks.where(hit).orderBy(F.desc("created_at"), F.desc("chunk_id")).limit(k)


def document_search(docs: DataFrame, query: str) -> DataFrame:
    """All words in the name, or the first eight letters of some long one."""
    words = query.lower().split()
    every, some = F.lit(True), F.lit(False)
    for w in words:
        every = every & F.lower("name").contains(w)
        if len(w) >= 8:
            some = some | F.lower("name").contains(w[:8])
    return docs.where(every | some)


def index_chunks(docs: DataFrame) -> DataFrame:
    """A chunk a line that is not blank, with defaults for type and title."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content")).where(F.trim("content") != "")
    return rows.withColumn("chunk_type", F.lit("text")).withColumn("title", F.concat(F.lit("Text "), F.col("position") + 1))


def chunk_pages(pages: DataFrame, topics: dict[str, list[str]], k: int = 3, fallback: str | None = None) -> DataFrame:
    """Per document and topic the pages with a keyword: the first k page numbers, their texts, and how many there are.

    With a fallback, documents without any topic have one row of that topic with their first k pages, matched 0.
    """
    found = [F.when(F.lower("text").rlike("|".join(words)), F.lit(name)) for name, words in topics.items()]
    hits = pages.select("doc_id", "page_number", "text", F.explode(F.array_compact(F.array(*found))).alias("topic"))
    w = W.partitionBy("doc_id", "topic").orderBy("page_number")
    ranked = hits.withColumn("rn", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("rn") <= k, F.struct("page_number", "text"))))
    show = [F.array_join(F.transform(first, lambda x: x["page_number"]).cast("array<string>"), ",").alias("first_pages"), F.array_join(F.transform(first, lambda x: x["text"]), "\n").alias("text")]
    out = ranked.groupBy("doc_id", "topic").agg(F.count("*").alias("matched"), *show)
    if fallback is None:
        return out
    rest = pages.join(out.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("page_number")))
    return out.unionByName(rest.groupBy("doc_id").agg(*show).select("doc_id", F.lit(fallback).alias("topic"), F.lit(0).cast("bigint").alias("matched"), "first_pages", "text"))


def extract_rules(docs: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """A rule holds where all of its parts are in the text."""

    def all_of(words: list[str]) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.lower("text").contains(w)
        return out

    return docs.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(all_of(words), F.lit(name)) for name, words in table.items())))).alias("rule"))


def cell_update_plan(lines: DataFrame, coords: DataFrame, impacted: DataFrame) -> DataFrame:
    """For impacted nodes a cell a year, and the total column: the sum of the displayed years."""
    shown = (F.round(F.col("amount") / F.lit(1000), 2) * 1000).cast(MONEY)
    mine = dealt(lines.select("node_id", "year", "amount"), "node_id")
    # no left_semi: that would be pushed below the dealing, which would be lost
    rows = mine.join(impacted.select("node_id").distinct(), "node_id").groupBy("node_id", "year").agg(total().alias("amount")).withColumn("shown", shown)
    nodes = rows.groupBy("node_id").agg(F.collect_list(F.struct("year", "shown")).alias("years"), F.sum("shown").cast(MONEY).alias("sum"))
    column = lambda y: F.struct((F.col("first_col") + y["year"] - F.col("first_year")).cast("int").alias("col_idx"), y["shown"].alias("value"))
    cells = F.concat(F.transform("years", column), F.array(F.struct(F.col("total_col").cast("int").alias("col_idx"), F.col("sum").alias("value"))))
    return nodes.join(coords, "node_id").select("node_id", "row_idx", F.explode(cells).alias("c")).select("node_id", "row_idx", "c.col_idx", "c.value")


def insert_rows_cube(items: DataFrame, years: list[int]) -> DataFrame:
    """A new object's rows: a row a source and a TOTAL row, a column a year."""
    shown = (F.round(F.col("amount") / F.lit(1000), 2) * 1000).cast(MONEY)
    cells = [F.coalesce(F.sum(F.when(F.col("year") == y, shown)), F.lit(0)).cast(MONEY).alias(f"y{y}") for y in years]
    return items.rollup("object_id", "source_type").agg(*cells).where("object_id is not null").withColumn("source_type", F.coalesce("source_type", F.lit("TOTAL")))


def duplicate_group_report(groups: DataFrame) -> DataFrame:
    """Names with several groups: their distinct rows in order, and the totals by year."""
    named = groups.groupBy("object_name").agg(F.countDistinct("group_key").alias("groups"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.array_sort(F.collect_set("row_id")).alias("row_ids"), total().alias("amount")).where("groups > 1")
    years = groups.groupBy("object_name", "year").agg(total().alias("year_amount")).groupBy("object_name").agg(F.array_sort(F.collect_list(F.struct("year", "year_amount"))).alias("by_year"))
    return named.join(years, "object_name")


def group_object_rows(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """G1: groups with the fields of their first row by `by`, and amounts by year and source."""
    order = F.struct(*by)
    groups = rows.groupBy("group_key").agg(F.min_by("object_name", order).alias("object_name"), F.min_by("source_type", order).alias("first_source"), F.bool_or(F.col("amount") == 0).alias("explicit_zero"), F.count("*").alias("n_rows"))
    return groups, rows.groupBy("group_key", "year", "source_type").agg(total().alias("amount"))


def context_counts(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Counts by node type."""
    n = lines.groupBy("node_id").agg(F.count("*").alias("lines"))
    return nodes.join(n, "node_id", "left").groupBy("node_type").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def organization_context(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Per organization the items that wait, those in conflict, and the latest version's status."""
    waiting = items.groupBy("org_id").agg(F.count_if(F.col("status") == "proposed").alias("pending"), F.count_if(F.col("has_conflict")).alias("conflicts"))
    latest = versions.groupBy("org_id").agg(F.max_by("status", F.struct("created_at", "version_id")).alias("latest_status"), F.count("*").alias("versions"))
    joined = waiting.join(latest, "org_id", "full_outer")
    return joined.select("org_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "conflicts", "versions")), "latest_status")


def analysis_diagnostics(items: DataFrame) -> DataFrame:
    """Per session: items, without a node, without an amount, unsure ones, and the share with a node."""
    found = F.count("node_id")
    return items.groupBy("session_id").agg(F.count("*").alias("items"), (F.count("*") - found).alias("without_node"), F.count_if(F.col("amount").isNull()).alias("without_amount"), F.count_if(F.col("confidence") < 0.92).alias("unsure"), F.round(found * 100.0 / F.count("*"), 2).alias("percent"))


def usage_by_model(runs: DataFrame) -> DataFrame:
    """G29."""
    return runs.groupBy("model", "purpose").agg(F.count("*").alias("runs"), F.round(F.sum("cost"), 4).alias("cost"))


def insert_plan(parents: DataFrame, children: DataFrame, new: DataFrame) -> DataFrame:
    """Where new objects (parent_id, seq, doc_id, table_idx, n_rows) go: below their parent's last row, one after the other."""
    anchors = anchor_row(children, parents).withColumnRenamed("node_id", "parent_id")
    return insert_offsets(new.join(anchors, "parent_id")).select("parent_id", "seq", *TABLE, "row_idx")
