"""G25, W14 and P19 in full: rows of new objects and the places at which they go into a document's tables.

A new object has a row a source: its own sources and those that its parents and their children use, at zero where it has no money,
and a total row. It goes below the last row that the siblings before it take, lines of several rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import finance_display_number
from .planning import insert_offsets
from .stages import settled
from .tree import MONEY, total

# The order of sources in a document.
SOURCE_ORDER = {"FEDERAL_BUDGET": 10, "REGIONAL_BUDGET": 20, "LOCAL_BUDGET": 30, "MUNICIPAL_BUDGET": 40, "EXTRABUDGETARY": 50, "PRIVATE_FUNDS": 60, "OTHER_SOURCE": 70}

TABLE = ["doc_id", "table_idx"]


def displayed(amount: Column) -> Column:
    """An amount as a document in thousands shows it: two places of thousands."""
    return (F.round(amount / F.lit(1000), 2) * 1000).cast(MONEY)


def source_place(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_ORDER.items() for x in kv]), source), F.lit(99))


def context_sources(objects: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(object_id, source_type): what an object's parents and all their children are paid from.

    Nodes find the parents that are asked for before any line meets them, and sources are made distinct by parent before any object
    meets them, so lines are moved once and a parent with many children costs a row a source.
    """
    parents = objects.select("object_id", F.explode(F.array_distinct(F.array_compact(F.array("parent_id", "anchor_id")))).alias("parent"))
    under = nodes.select("node_id", F.explode(F.array_distinct(F.array("node_id", "parent_id"))).alias("parent")).join(parents.select("parent").distinct(), "parent", "left_semi")
    by_parent = lines.select("node_id", "source_type").join(under, "node_id").select("parent", "source_type").distinct()
    return parents.join(by_parent, "parent").select("object_id", "source_type").distinct()


def insert_rows(objects: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """object_id, place, source_type, total_amount, by_year (array of year and amount).

    objects: object_id, parent_id, anchor_id, is_aggregate; nodes: node_id, parent_id; lines: node_id, year, source_type, amount, those of
    the objects too (an object is a node). Totals add up what a document shows, years stay exact. The total row is the first, of an
    activity the last; an activity's total counts once for each of its source rows. Objects without a line have no rows; null amounts
    are zero, null years are left out, a null source comes last.
    """
    own = settled(lines.where("year is not null").join(objects.select(F.col("object_id").alias("node_id")).distinct(), "node_id", "left_semi").groupBy(F.col("node_id").alias("object_id"), "source_type", "year").agg(F.coalesce(total(), F.lit(0)).cast(MONEY).alias("amount")))
    years = own.groupBy("object_id", "year").agg(F.sum("amount").cast(MONEY).alias("amount"))
    years = years.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("year", "amount"))).alias("all"))
    of_source = own.groupBy("object_id", "source_type").agg(F.map_from_entries(F.collect_list(F.struct("year", "amount"))).alias("amounts"))
    sources = context_sources(objects, nodes, lines).withColumn("amounts", F.lit(None).cast(of_source.schema["amounts"].dataType)).unionByName(of_source).groupBy("object_id", "source_type").agg(F.max_by("amounts", F.col("amounts").isNotNull()).alias("amounts"))
    zero = F.lit(0).cast(MONEY)
    added = lambda items: F.aggregate(items, F.lit(0).cast("decimal(38,2)"), lambda s, y: (s + displayed(y["amount"])).cast("decimal(38,2)"))
    filled = F.transform("all", lambda y: F.struct(y["year"].alias("year"), F.coalesce(F.try_element_at("amounts", y["year"]), zero).alias("amount")))
    kinds = objects.groupBy("object_id").agg(F.bool_or("is_aggregate").alias("is_aggregate"))
    rows = settled(sources.join(years, "object_id").withColumn("by_year", filled))
    totals = rows.groupBy("object_id").agg(F.first("all").alias("by_year"), F.count("*").alias("n")).join(kinds, "object_id")
    times = F.when(F.col("is_aggregate"), F.col("n")).otherwise(1).cast("decimal(10,0)")
    last = F.when(F.col("is_aggregate"), 100).otherwise(0)
    out = rows.select("object_id", source_place(F.col("source_type")).alias("rank"), "source_type", added("by_year").cast(MONEY).alias("total_amount"), "by_year").unionByName(
        totals.select("object_id", last.alias("rank"), F.lit("TOTAL").alias("source_type"), (added("by_year") * times).cast(MONEY).alias("total_amount"), "by_year")
    )
    place = F.row_number().over(W.partitionBy("object_id").orderBy("rank", F.col("source_type").asc_nulls_last()))
    return out.withColumn("place", place).drop("rank")


def occupied(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Nodes with last_row: the last row that a node or one of its lines takes in the node's table."""
    taken = lines.where("src_row is not null").groupBy("node_id", F.col("src_table").alias("table_idx")).agg(F.max("src_row").alias("taken"))
    return nodes.join(taken, ["node_id", "table_idx"], "left").withColumn("last_row", F.greatest("row_idx", "taken")).drop("taken")


def segments(number: Column) -> Column:
    """A display number's parts as integers; a part that is no number is 0."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(number, F.lit("")), r"\.+$", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)))


def insert_anchors(objects: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """object_id, table_idx, insert_after, template_row.

    objects: doc_id, object_id, parent_id, display_number, is_aggregate; nodes: doc_id, node_id, parent_id, table_idx, row_idx,
    display_number, is_new; lines: node_id, src_table, src_row. An object goes below its parent's last numbered child in the
    parent's table. An activity goes one row below the nearest lower number of its parent's level in the table, but above the next
    higher one. Without such a row it goes below its parent. Objects whose parent has no table, or nothing placed, have no anchor.
    Siblings are found by sorting old and new ones together, so no object meets all its siblings.
    """
    placed = settled(occupied(nodes.where(~F.coalesce("is_new", F.lit(False))), lines))
    parents = placed.select("doc_id", F.col("node_id").alias("parent_id"), "table_idx", F.col("last_row").alias("parent_row"), F.regexp_replace("display_number", r"\.+$", "").alias("prefix"))
    new = settled(objects.join(parents, ["doc_id", "parent_id"]).where("table_idx is not null"))
    rows = placed.where("table_idx is not null and row_idx is not null")
    children = rows.where(finance_display_number(F.col("display_number"))).groupBy("doc_id", "parent_id", "table_idx").agg(F.max_by(F.struct("row_idx", "last_row"), F.struct("row_idx", "node_id")).alias("child"))
    plain = new.where(~F.col("is_aggregate")).join(children, ["doc_id", "parent_id", "table_idx"], "left")
    after = F.coalesce("child.last_row", "parent_row")
    plain = plain.select("doc_id", "object_id", "table_idx", after.alias("insert_after"), F.coalesce("child.row_idx", after).alias("template_row"))

    level, last = r"^(.*)\.\d+$", r"\.+$"
    shelf = rows.select(*TABLE, F.regexp_replace("display_number", last, "").alias("number"), "row_idx", "last_row", F.col("node_id").alias("id"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("bigint").alias("parent_row")).where(F.col("number").rlike(level))
    shelf = shelf.withColumn("prefix", F.regexp_extract("number", level, 1))
    asked = new.where(F.col("is_aggregate")).select(*TABLE, F.regexp_replace("display_number", last, "").alias("number"), F.lit(None).cast("bigint").alias("row_idx"), F.lit(None).cast("bigint").alias("last_row"), F.lit(None).cast("string").alias("id"), "object_id", "parent_row", "prefix")
    line = shelf.unionByName(asked).withColumn("at", segments(F.col("number")))
    # rows of the object's own number are neither before nor after it
    same = W.partitionBy(*TABLE, "prefix", "at")
    best = F.struct("at", "row_idx", "last_row", "id")
    here = F.max(F.when(F.col("id").isNotNull(), best)).over(same)
    groups = line.withColumns({"here": here, "least": F.min("row_idx").over(same)}).select(*TABLE, "prefix", "at", "here", "least").distinct()
    # what follows is read backwards: a frame that ends with the last row would be summed up anew for each row
    step, back = (W.partitionBy(*TABLE, "prefix").orderBy(by).rowsBetween(W.unboundedPreceding, -1) for by in (F.asc("at"), F.desc("at")))
    near = groups.withColumns({"low": F.last("here", True).over(step), "high": F.min("least").over(back)})
    found = line.where("object_id is not null").join(near.select(*TABLE, "prefix", "at", "low", "high"), [*TABLE, "prefix", "at"])
    base = F.coalesce("low.last_row", "parent_row")
    spot = F.when(F.col("low").isNull(), base).when(F.col("high").isNull(), base + 1).when(F.col("high") - 1 >= base, F.least(base + 1, F.col("high") - 1)).otherwise(base)
    alone = new.where(F.col("is_aggregate") & (F.coalesce("prefix", F.lit("")) == "")).select("doc_id", "object_id", "table_idx", F.col("parent_row").alias("insert_after"), F.col("parent_row").alias("template_row"))
    activities = found.where("prefix <> ''").select("doc_id", "object_id", "table_idx", spot.alias("insert_after"), F.coalesce("low.row_idx", spot).alias("template_row"))
    out = plain.unionByName(activities).unionByName(alone).where("insert_after is not null")
    return out.select("doc_id", "object_id", "table_idx", F.col("insert_after").cast("bigint").alias("insert_after"), F.col("template_row").cast("bigint").alias("template_row"))


def plan_insertions(objects: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of all new objects with the row each takes, (doc_id, table_idx, row_idx, object_id, source_type, total_amount, by_year).

    Objects of one table are put in by anchor, then id; each moves those below it by its own rows. Lines are settled: three steps read them.
    """
    lines = settled(lines.select("node_id", "year", "source_type", "amount", "src_table", "src_row"))
    rows = settled(insert_rows(objects, nodes, lines))
    n = rows.groupBy("object_id").agg(F.count("*").alias("n_rows"))
    anchors = insert_anchors(objects, nodes, lines).join(n, "object_id").withColumnRenamed("insert_after", "anchor").withColumn("seq", F.col("object_id"))
    first = insert_offsets(anchors).select("doc_id", "table_idx", "object_id", F.col("row_idx").alias("first_row"))
    return first.join(rows, "object_id").select("doc_id", "table_idx", (F.col("first_row") + F.col("place") - 1).alias("row_idx"), "object_id", "source_type", "total_amount", "by_year")
