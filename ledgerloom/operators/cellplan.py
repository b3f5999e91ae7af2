"""The cells of a document that a new version of a budget changes, with their amounts.

Impacted are the changed nodes and all above them, what lies above new nodes, summary rows that refer to an impacted node, and rows that
say the same as an impacted one (mirrors). Their rows give year cells and a total column, their lines the rows of the sources, and the
version's totals the cells of its passport. Of a cell's several amounts one is kept (W10).

nodes: version_id, node_id, parent_id, node_type, name, display_number, refers_to, source, table_idx, row_idx, year_cells (map of year to
column), year_raw (map of year to text), total_cell, total_raw, unit, execution_period, period_start, period_end (the
program's years, null if open), number_was. lines: node_id, line_no, year,
source_type, amount, src_table, src_row, cell, raw, unit, total_cell, total_raw. passport: version_id, kind (source, source_total, total,
grand), year, source_type, table_idx, row_idx, col_idx, raw, unit. changed: node_id, item_id, mode. added: node_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import display_amount
from ..functions.predicates import finance_display_number, summary_row
from ..functions.text import display_number_as_in_document, normalize_display_number, normalize_name_alnum
from .planning import preferred_cell_update
from .stages import settled, tasks
from .tree import MONEY, ancestor_closure, total

UNIT = "thousand_rub"
CELL = ["version_id", "table_idx", "row_idx", "col_idx"]
OUT = [*CELL, "amount", "raw", "unit", "reason", "node_id", "item_id", "seq"]
MAPS = ["year_cells", "year_raw"]


def shown(amount: Column, unit: Column) -> Column:
    """The amount as the document displays it; a unit that is not stated leaves it as it is."""
    return F.when(unit == UNIT, display_amount(amount)).otherwise(amount.cast(MONEY))


def impacted(nodes: DataFrame, changed: DataFrame, added: DataFrame) -> DataFrame:
    """node_id of all nodes whose rows change. Of rows that say the same all change if one does."""
    starts = changed.select("node_id", F.lit(0).alias("__least")).unionByName(added.select("node_id", F.lit(1).alias("__least"))).groupBy("node_id").agg(F.min("__least").alias("__least"))
    # one join of the closure: semi joins would be made anew for each of its steps, all of them in the same tasks
    ids = settled(ancestor_closure(nodes).join(starts, "node_id").where("depth >= __least").select(F.col("ancestor_id").alias("node_id")).distinct())
    referring = nodes.where(summary_row(F.col("display_number"), F.col("name"), F.lit(None).cast("string"))).select("node_id", "refers_to")
    ids = settled(ids.unionByName(referring.join(ids.withColumnRenamed("node_id", "refers_to"), "refers_to", "left_semi").select("node_id")).distinct())
    same = ["version_id", "parent_id", "table_idx", "__number", "__name"]
    rows = nodes.where("table_idx is not null and row_idx is not null and source like 'finance%'").withColumns({"__number": normalize_display_number(F.col("display_number")), "__name": normalize_name_alnum(F.col("name")), "parent_id": F.coalesce("parent_id", F.lit(""))})
    keyed = rows.select("node_id", *same)
    touched = keyed.join(ids, "node_id", "left_semi").select(*same).distinct()
    return ids.unionByName(keyed.join(touched, same, "left_semi").select("node_id")).join(nodes.select("node_id"), "node_id", "left_semi").distinct()


def seq(phase: int, node: Column, kind: int, line: Column | None = None) -> Column:
    return F.struct(F.lit(phase).alias("phase"), node.alias("node"), F.lit(kind).alias("kind"), (F.lit(0) if line is None else line).cast("long").alias("line"))


def update(df: DataFrame, reason: str, order: Column, item: Column | None = None) -> DataFrame:
    """One kind of update; cells without all their coordinates go."""
    out = df.withColumns({"unit": F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit(UNIT)), "reason": F.lit(reason), "seq": F.struct(order.alias("order"), F.col("amount").cast(MONEY).alias("amount")), "item_id": F.lit(None).cast("long") if item is None else item, "raw": F.nullif(F.col("raw"), F.lit("")), "amount": F.col("amount").cast(MONEY)})
    return out.where("table_idx is not null and row_idx is not null and col_idx is not null").select(*(F.col(c).cast("int").alias(c) if c in CELL[1:] else F.col(c) for c in OUT))


def node_rows(nodes: DataFrame, mine: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """The year cells of the own rows of some nodes (mine, without maps), for years with lines, and their total columns: the sum of all years as displayed.

    Of the maps only the years that have lines are taken, where the nodes are read: maps pack to nearly nothing in a shuffle but lie open in memory."""
    placed, mine = (df.where("table_idx is not null and row_idx is not null") for df in (nodes, mine))
    # summed before they meet nodes, for a few nodes may have most lines; no left_semi, which would be pushed below the sums
    years = settled(lines.groupBy("node_id", "year").agg(total().alias("amount")).join(mine.select("node_id").distinct(), "node_id"))
    cells = placed.select("node_id", *CELL[:3], "unit", "year_raw", F.explode("year_cells").alias("year", "col_idx")).join(F.broadcast(years.select("year").distinct()), "year")
    met = cells.withColumn("raw", F.try_element_at("year_raw", "year")).drop("year_raw").join(years, ["node_id", "year"])
    sums = mine.select("node_id", "unit").join(years, "node_id").groupBy("node_id").agg(F.sum(shown(F.col("amount"), F.col("unit"))).alias("amount"))
    columns = mine.where("total_cell is not null").join(sums, "node_id", "left").withColumns({"amount": F.coalesce("amount", F.lit(0)), "col_idx": F.col("total_cell"), "raw": F.col("total_raw")})
    return [update(met, "node_total_year", seq(0, F.col("node_id"), 0)), update(columns, "node_total_column", seq(0, F.col("node_id"), 1))]


def line_rows(nodes: DataFrame, lines: DataFrame, changed: DataFrame) -> list[DataFrame]:
    """The cells of the sources' rows: a line's own column, or that of its row's first known year moved by the years between, and the row's total.
    Lines without a row have no cells, so they do not meet the others of their node. The others are dealt by their number, and so is what they
    meet: a join of two deals takes one of them for both, and may take the smaller."""
    items = changed.groupBy("node_id").agg(F.min("item_id").alias("item_id"))
    heads = settled(nodes.select("node_id", "version_id").join(items, "node_id", "left"))
    drawn = lines.where("src_row is not null")
    n = tasks(drawn)
    row = W.partitionBy("node_id", "source_type", "src_row")
    first = lambda c: F.first(c).over(row.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    mine = drawn.repartition(n, "node_id").join(heads.repartition(n, "node_id"), "node_id")
    mine = mine.withColumns({"table_idx": first("src_table"), "__unit": first("unit"), "__total": first("total_cell"), "__raw": first("total_raw"), "__base": F.min(F.when(F.col("cell").isNotNull(), F.struct("year", "cell"))).over(row)})
    guess = F.col("__base.cell") + F.col("year") - F.col("__base.year")
    mine = settled(mine.where("table_idx is not null").withColumn("col_idx", F.coalesce("cell", F.when(guess > 0, guess))).drop("src_table", "cell", "total_cell", "total_raw", "__base"))
    mine = mine.withColumnRenamed("src_row", "row_idx")
    columns = mine.where("__total is not null").groupBy("version_id", "node_id", "item_id", "source_type", "table_idx", "row_idx", F.col("__total").alias("col_idx"), F.col("__raw").alias("raw"), F.col("__unit").alias("unit"))
    columns = columns.agg(F.sum(shown(F.col("amount"), F.col("__unit"))).alias("amount"), F.min("line_no").alias("line_no"))
    order = lambda kind: seq(0, F.col("node_id"), kind, F.col("line_no"))
    return [update(mine, "funding_line_year", order(2), F.col("item_id")), update(columns, "funding_line_total_column", order(3), F.col("item_id"))]


def root_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Per version the sums of its total: those of its program node, else of all nodes without a known parent; root_id is the least of these nodes."""
    version = W.partitionBy("version_id")
    known = nodes.select(F.col("node_id").alias("__up")).distinct()
    tops = nodes.join(known, F.col("parent_id") == F.col("__up"), "left").where("node_type = 'program' or __up is null")
    tops = tops.withColumn("__any", F.max(F.col("node_type") == "program").over(version)).where("node_type = 'program' or not __any")
    tops = tops.select("version_id", "node_id", F.min("node_id").over(version).alias("root_id"), "__any").where("not __any or node_id = root_id")
    return lines.join(settled(tops), "node_id").groupBy("version_id", "root_id", "year", "source_type").agg(total().alias("amount"))


def passport_rows(nodes: DataFrame, lines: DataFrame, passport: DataFrame) -> list[DataFrame]:
    """The passport's cells by source and year, by source, by year, and of the grand total. Total cells that are not given lie before the first cell of their row."""
    roots = settled(root_lines(nodes, lines))
    by = ["version_id", "root_id"]
    cells = ["table_idx", "row_idx", "col_idx", "raw", "unit"]
    place = lambda kind, *key: passport.where(F.col("kind") == kind).select("version_id", *key, *cells)
    sources = roots.groupBy(*by, "year", "source_type").agg(total().alias("amount"))
    years = roots.groupBy(*by, "year").agg(total().alias("amount"))

    def before(kind: str, order: Column, *key: str) -> DataFrame:
        """A cell left of the kind's first one, for versions without cells of the kind that is looked for."""
        named = "source_total" if kind == "source" else "grand"
        start = passport.where(F.col("kind") == kind).join(passport.where(F.col("kind") == named).select("version_id").distinct(), "version_id", "left_anti").where("col_idx > 0")
        first = start.groupBy("version_id", *key).agg(F.min_by(F.struct("table_idx", "row_idx", "col_idx", "unit"), order).alias("c"))
        return first.select("version_id", *key, "c.table_idx", "c.row_idx", (F.col("c.col_idx") - 1).alias("col_idx"), F.lit(None).cast("string").alias("raw"), "c.unit")

    source_totals = place("source_total", "source_type").unionByName(before("source", F.col("year"), "source_type"))
    grand = place("grand").unionByName(before("total", F.struct("col_idx", "year")))
    displayed = total(shown(F.col("amount"), F.col("unit"))).alias("amount")
    row = lambda df, reason, kind: update(df.withColumnRenamed("root_id", "node_id"), reason, seq(1, F.col("node_id"), kind))
    return [
        row(sources.join(place("source", "year", "source_type"), ["version_id", "year", "source_type"]), "passport_source_year", 0),
        row(sources.join(source_totals, ["version_id", "source_type"]).groupBy(*by, "source_type", *cells).agg(displayed), "passport_source_total_column", 1),
        row(years.join(place("total", "year"), ["version_id", "year"]), "passport_total", 2),
        row(years.join(grand, "version_id").groupBy(*by, *cells).agg(displayed), "passport_grand_total_column", 3),
    ]


def cell_plan(nodes: DataFrame, lines: DataFrame, passport: DataFrame, changed: DataFrame, added: DataFrame) -> DataFrame:
    """version_id, table_idx, row_idx, col_idx, amount, raw, unit, reason, node_id, item_id: one amount a cell. Among equals the later
    wins: passport cells after rows, then by node and kind, then the larger. Versions without an impacted node have passport cells too.

    Lines with a row and the updates are dealt by their numbers, so no task's memory grows with them. Nodes are settled first: if they are a
    union, a semi join is made for each of its parts, and these parts then have other numbers of tasks than what they are joined with, which fails."""
    flat = settled(nodes.drop(*MAPS))
    mine = settled(flat.join(settled(impacted(flat, changed, added)), "node_id", "left_semi"))
    cells = line_rows(mine, lines, changed)
    every = [*node_rows(nodes, mine, lines), *cells, *passport_rows(flat, lines, passport)]
    return preferred_cell_update(reduce(DataFrame.unionByName, every).repartition(tasks(cells[0]), *CELL), CELL).drop("seq")


def text_plan(nodes: DataFrame, lines: DataFrame, changed: DataFrame) -> DataFrame:
    """P18's texts: the period of nodes whose money goes in some year (column 2) and new display numbers (column 0); of one cell's the latter."""
    rows = nodes.where("table_idx is not null and row_idx is not null")
    zeroed = changed.where("mode = 'zeroing'").select("node_id").distinct()
    years = lines.where("amount <> 0").groupBy("node_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    period = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    bounds = [F.regexp_extract("execution_period", r"^\s*(20\d{2})\s*[-–—]\s*(20\d{2})\s*$", i).try_cast("int") for i in (1, 2)]
    open_ = bounds[0].isNotNull() & F.coalesce((bounds[0] >= F.col("period_start")) & (bounds[1] <= F.col("period_end")), F.lit(True))
    plain = ~F.coalesce(summary_row(F.col("display_number"), F.col("name"), F.lit(None).cast("string")), F.lit(False)) & (F.col("node_type") != "result") & F.col("source").startswith("finance") & finance_display_number(F.col("display_number"))
    periods = rows.join(zeroed, "node_id", "left_semi").where(plain & open_).join(years, "node_id").select("version_id", "table_idx", "row_idx", F.lit(2).alias("col_idx"), period.alias("text"), F.lit("execution_period").alias("reason"), "node_id")
    numbers = rows.where(F.coalesce(F.trim("number_was"), F.lit("")) != "").select("version_id", "table_idx", "row_idx", F.lit(0).alias("col_idx"), display_number_as_in_document(F.col("display_number"), F.col("number_was"), normalize_name_alnum(F.col("name")).contains("мероприятие")).alias("text"), F.lit("display_number").alias("reason"), "node_id")
    return periods.unionByName(numbers)
