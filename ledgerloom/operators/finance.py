"""Finance tables of a document, row by row, under a layout of each table.

A table's layout is one struct: first data row, year columns, total column. Each row takes it, moved where the row is a summary whose
merged first cells push the source one column on. Rows whose source says "total" are nodes; the other sources' rows are lines of the
node with their own number and name, and open one where the table has none so far.

rows: doc_id, table_idx, row_idx, cells (array of texts). tables: doc_id, table_idx, subprogram_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.predicates import summary_row
from ..functions.text import classify_finance_node, extract_code, normalize_display_number, normalize_name_alnum, normalize_source_cells, slug, total_source_marker
from .stages import settled

TABLE = ["doc_id", "table_idx"]
#: Header rows that are read for columns, rows looked through for the first data row, and the first column that may be a year's.
HEAD, NUMBERED, SOURCES, FIRST_YEAR = 4, 6, 5, 5


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def layouts(rows: DataFrame) -> DataFrame:
    """doc_id, table_idx, years (map of column to year), total_col, start; tables without a year column have none."""
    head = rows.where(F.col("row_idx") < max(HEAD, NUMBERED))
    cell = lambda i: clean(F.get("cells", F.lit(i)))
    numbers = (cell(0) == "1") & (cell(1) == "2") & (cell(3) == "4")
    source = (F.col("row_idx") < SOURCES) & F.exists("cells", lambda x: F.lower(clean(x)).contains("источник"))
    start = head.groupBy(*TABLE).agg((F.coalesce(F.min(F.when(numbers, F.col("row_idx"))), F.min(F.when(source, F.col("row_idx"))), F.lit(0)) + 1).alias("start"))
    texts = head.where(F.col("row_idx") < HEAD).select(*TABLE, "row_idx", F.posexplode("cells").alias("col", "text"))
    dated = texts.where(F.col("col") >= FIRST_YEAR).withColumn("year", F.regexp_extract(F.lower(clean(F.col("text"))), r"(?<!\d)(20\d{2})(?!\d)", 1).try_cast("int")).where("year is not null")
    first = dated.groupBy(*TABLE, "year").agg(F.min(F.struct("row_idx", "col")).alias("at"))
    # of several years of one column the one read last
    columns = first.groupBy(*TABLE, F.col("at.col").alias("col")).agg(F.max_by("year", "at").alias("year"))
    years = columns.groupBy(*TABLE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "year")))).alias("years"), F.min("col").alias("first_col"))
    name = normalize_name_alnum(F.col("text"))
    totals = texts.where((name == "всего") | name.startswith("всего ")).join(years, TABLE).where(~F.array_contains(F.map_keys("years"), F.col("col")) & (F.col("col") <= F.col("first_col")))
    totals = totals.groupBy(*TABLE).agg(F.min(F.struct("row_idx", "col")).alias("t")).select(*TABLE, F.col("t.col").alias("total_col"))
    return years.drop("first_col").join(start, TABLE).join(totals, TABLE, "left")


def shifted(row_years: Column, total: Column, n: Column) -> Column:
    """A moved row's year columns: a year that lies where its total now is goes one column on, if that is free and the row has it."""
    year, free = F.try_element_at(row_years, total), (total + 1 < n) & ~F.map_contains_key(row_years, total + 1)
    moved = F.map_concat(F.map_filter(row_years, lambda k, v: k != total), F.create_map(total + 1, year))
    return F.when(year.isNotNull() & free, moved).otherwise(row_years)


def described(rows: DataFrame) -> DataFrame:
    """Data rows with number, name, kind (total, source or null), node_type, source_type and their own columns."""
    cell = lambda i: clean(F.get("cells", i if isinstance(i, Column) else F.lit(i)))
    named = F.when(normalize_name_alnum(F.col("name")).startswith("мероприятие"), F.regexp_extract("name", r"\b(\d{2}(?:\.\d{2})?)\b", 1)).otherwise("")
    number = F.when(F.col("number") != "", F.col("number")).otherwise(named)
    out = rows.join(layouts(rows), TABLE).where((F.col("row_idx") >= F.col("start")) & (F.size("cells") >= 4))
    out = out.withColumns({"number": normalize_display_number(F.get("cells", F.lit(0))), "name": cell(1)}).withColumn("number", number).where("number <> '' and name <> ''")
    out = settled(out)  # all that follows hangs on these two, again and again
    out = out.withColumn("is_summary", F.coalesce(summary_row(F.col("number"), F.col("name"), F.lit(None).cast("string")), F.lit(False)))
    firsts, fifth = F.transform(F.slice("cells", 1, 4), normalize_name_alnum), cell(4)
    same = (F.size(F.array_distinct(firsts)) == 1) & (F.get(firsts, F.lit(0)) != "")
    out = out.withColumn("moved", (F.size("cells") > 4) & F.col("is_summary") & same & (total_source_marker(fifth) | (normalize_source_cells(fifth) != "UNKNOWN") | normalize_name_alnum(fifth).contains("источник")))
    out = out.withColumns({"source_cell": F.when(F.col("moved"), 4).otherwise(3), "total_cell": F.when(F.col("moved"), F.col("total_col") + 1).otherwise(F.col("total_col"))})
    out = out.withColumns({"year_cells": F.when(F.col("moved") & F.col("total_col").isNotNull(), shifted(F.col("years"), F.col("total_cell"), F.size("cells"))).otherwise(F.col("years")), "source_label": cell(F.col("source_cell")), "total_raw": F.when(F.col("total_cell") < F.size("cells"), cell(F.col("total_cell")))})
    out = out.withColumns({"source_type": normalize_source_cells(F.col("source_label")), "node_type": classify_finance_node(F.col("number"), F.col("name")), "norm": normalize_name_alnum(F.col("name")), "execution_period": F.nullif(cell(2), F.lit(""))})
    return out.withColumn("kind", F.when(total_source_marker(F.col("source_label")), "total").when(F.col("source_type") != "UNKNOWN", "source"))


def finance_rows(rows: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and lines of finance tables.

    A line's node is that of the last object row of totals above it with its number and name, else the node that the table's first
    source row of that number and name has opened. Main activities and activities of total rows are parents of what follows them.
    """
    # both are written whole: a filter right behind long expressions would be made of all of them, once for each place that names them
    every = settled(described(settled(rows))).where("kind is not null").join(tables, TABLE)
    table = W.partitionBy(*TABLE).orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1)
    sign = W.partitionBy(*TABLE, "number", "norm").orderBy("row_idx")
    at = lambda cond, w: F.last(F.when(cond, F.col("row_idx")), True).over(w)
    total, obj = F.col("kind") == "total", F.col("node_type") == "object"
    key = lambda kind: F.concat_ws(":", kind, F.col("table_idx"), F.col("row_idx"), slug(F.col("number")))
    every = every.withColumns({
        "own_key": key(F.when(total, F.col("node_type")).otherwise("object")),
        "__main": F.last(F.when(total & (F.col("node_type") == "main_activity"), F.struct("row_idx", key(F.lit("main_activity")).alias("key"))), True).over(table),
        "__act": F.last(F.when(total & (F.col("node_type") == "activity"), F.struct("row_idx", key(F.lit("activity")).alias("key"))), True).over(table),
        "__total": at(total & obj, sign.rowsBetween(W.unboundedPreceding, -1)),
        "__first": F.min(F.when(~total, F.col("row_idx"))).over(sign.rowsBetween(W.unboundedPreceding, 0)),
    })
    main = F.col("__main.key")
    act = F.when(F.coalesce(F.col("__act.row_idx") > F.col("__main.row_idx"), F.lit(True)), F.col("__act.key"))
    whole = total & F.col("is_summary") & normalize_name_alnum(F.concat_ws(" ", "number", "name")).contains("подпрограмм")
    parent = F.when((F.col("node_type") == "main_activity") | (whole & (F.col("node_type") != "activity")), F.col("subprogram_key")).when(F.col("node_type") == "activity", F.coalesce(main, "subprogram_key")).otherwise(F.coalesce(act, main, "subprogram_key"))
    opened = ~total & F.col("__total").isNull() & (F.col("__first") == F.col("row_idx"))
    nodes = every.where(total | opened).select(
        *TABLE, "row_idx", F.col("own_key").alias("key"), F.when(total, F.col("node_type")).otherwise("object").alias("node_type"), parent.alias("parent_key"), F.col("number").alias("display_number"),
        extract_code(F.col("number"), F.col("name")).alias("code"), "name", "execution_period", "is_summary", F.when(total, "finance_table").otherwise("finance_source_row").alias("source"), "source_cell", "year_cells", "total_cell", "total_raw")
    node_key = F.concat_ws(":", F.lit("object"), F.col("table_idx"), F.coalesce("__total", "__first"), slug(F.col("number")))
    lines = every.where(~total).select(*TABLE, "row_idx", "cells", node_key.alias("node_key"), "source_type", "source_label", "total_cell", "total_raw", F.explode("year_cells").alias("cell", "year"))
    lines = lines.where(F.col("cell") < F.size("cells")).withColumn("raw", clean(F.get("cells", F.col("cell")))).where("raw <> ''")
    return nodes, lines.select(*TABLE, "row_idx", "node_key", "year", "source_type", parse_money(F.col("raw"), "thousand_rub").alias("amount"), "cell", "raw", "source_label", "total_cell", "total_raw")
