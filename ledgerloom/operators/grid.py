"""Grid-to-table operators: cells (doc_id, row_idx, col_idx, text) to layouts, nodes and funding lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.text import amount_mode, classify_finance_node, classify_sheet_row, extract_object_name, extraction_confidence, folded, group_identity, normalize_display_number, normalize_source_cells, slug, total_source_marker, trim_evidence
from .reconcile import control_sums
from .stages import dealt, settled, tasks
from .tree import MONEY

YEAR = r"\b(20\d\d|19\d\d)\b"


def detect_header(cells: DataFrame, below: int = 4, within: int | None = None) -> DataFrame:
    """The header rows of each document: the first with "наименование" and up to `below` next ones with years or marks; a numbering row ends them.

    Where headers are known to begin above row `within`, no row below it and `below` is read.
    """
    if within is not None:
        cells = cells.where(F.col("row_idx") < within + below)
    # none of the words has a blank in it, so lower case is enough
    t, bare = F.translate(F.lower("text"), "ё", "е"), F.trim("text")
    rows = cells.groupBy("doc_id", "row_idx").agg(
        F.bool_or(t.contains("наименование")).alias("named"),
        F.bool_or(t.contains("всего") | t.contains("бюджет") | t.contains("источник") | (t.rlike(YEAR))).alias("marked"),
        F.bool_and((F.length(bare) <= 2) & bare.rlike(r"^\d{0,2}$")).alias("numbering"),
    )
    first = rows.where("named").groupBy("doc_id").agg(F.min("row_idx").alias("first"))
    near = rows.join(first, "doc_id").where((F.col("row_idx") >= F.col("first")) & (F.col("row_idx") <= F.col("first") + below))
    ends = (F.col("row_idx") > F.col("first")) & (F.col("numbering") | ~F.col("marked"))
    stop = F.max(ends.cast("int")).over(W.partitionBy("doc_id").orderBy("row_idx"))
    return near.withColumn("__stop", stop).where("__stop = 0").select("doc_id", "row_idx")


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """An empty cell inside a merged range takes the range's first cell's text.

    Ranges are cut to their document's used rows and columns and laid out cell by cell, so cells meet them by equal places.
    """
    first = cells.select("doc_id", F.col("row_idx").alias("row_from"), F.col("col_idx").alias("col_from"), F.col("text").alias("top_text"))
    used = cells.groupBy("doc_id").agg(F.max("row_idx").alias("last_row"), F.max("col_idx").alias("last_col"))
    top = ranges.join(first, ["doc_id", "row_from", "col_from"]).join(used, "doc_id").where("row_to >= row_from and col_to >= col_from")
    slots = top.select("doc_id", "col_from", "col_to", "last_col", "top_text", F.explode(F.sequence("row_from", F.least("row_to", "last_row"))).alias("row_idx"))
    slots = slots.select("doc_id", "row_idx", F.explode(F.sequence("col_from", F.least("col_to", "last_col"))).alias("col_idx"), "top_text")
    filled = cells.join(slots, ["doc_id", "row_idx", "col_idx"], "left")
    return filled.select("doc_id", "row_idx", "col_idx", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "top_text", F.lit("")).alias("text"))


def header_text(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Per column the header's parts from top to bottom.

    Cells below the last header row of all documents are left out before any are joined, so bodies are not shuffled.
    """
    header = settled(header)
    cells = cells.join(F.broadcast(header.agg(F.max("row_idx").alias("__last"))), F.col("row_idx") <= F.col("__last")).drop("__last")
    parts = cells.join(header, ["doc_id", "row_idx"]).where(F.trim("text") != "")
    return parts.groupBy("doc_id", "col_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda x: x["text"]), " ").alias("header"))


def base_year(cells: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The largest 20xx in the first ten rows and columns; for documents without any the largest of their file's name (doc_id, file_name)."""
    found = cells.where("row_idx < 10 and col_idx < 10 and text like '%20%'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(20\d\d)\b"), F.lit(1))).alias("y"))
    out = found.groupBy("doc_id").agg(F.max(F.col("y").cast("int")).alias("base_year"))
    if files is None:
        return out
    named = files.select("doc_id", F.array_max(F.regexp_extract_all("file_name", F.lit(r"(?<!\d)(20\d\d)(?!\d)"), F.lit(1)).cast("array<int>")).alias("named"))
    return out.join(named, "doc_id", "full_outer").select("doc_id", F.coalesce("base_year", "named").alias("base_year")).where("base_year is not null")


def amount_columns(headers: DataFrame, base: DataFrame) -> DataFrame:
    """C4: year and source of each amount column; a year carries to the right, fact columns end it, "очередной год" is the base year and one."""
    # headers repeat: each wording is read once
    headers = settled(headers)
    t, source = folded(F.col("header")), normalize_source_cells(F.col("header"))
    wording = headers.select("header").distinct().select(
        "header", F.regexp_extract("header", YEAR, 1).try_cast("int").alias("__year"), t.contains("очередной").alias("__next"), t.contains("текущий").alias("__this"),
        t.rlike("поставлено|фактически|% исполнения").cast("int").alias("__stop"), source.alias("__source"), total_source_marker(F.col("header")).alias("__total"),
    )
    w = W.partitionBy("doc_id").orderBy("col_idx").rowsBetween(W.unboundedPreceding, 0)
    year = F.coalesce("__year", F.when(F.col("__next"), F.col("base_year") + 1).when(F.col("__this"), F.col("base_year")))
    out = headers.join(wording, "header").join(base, "doc_id", "left").withColumn("own_year", year).withColumn("year", F.last("own_year", True).over(w))
    out = out.withColumn("stopped", F.max("__stop").over(w))
    known = F.col("__source") != "UNKNOWN"
    is_amount = F.col("year").isNotNull() & (F.col("own_year").isNotNull() | known | F.col("__total"))
    return out.where(is_amount & (F.col("stopped") == 0)).select("doc_id", "col_idx", "year", F.col("__source").alias("source_type"), (~known).alias("needs_row_source"))


def amount_cells(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Cells of amount columns with amount and what the layout says of the column; columns that no layout names go before the join.

    Conditions on amount belong into aggregates: as filters they would be read before the join, and then again.
    """
    layout = settled(layout)
    named = cells.join(F.broadcast(layout.select("col_idx").distinct()), "col_idx", "left_semi")
    return named.join(layout, ["doc_id", "col_idx"]).withColumn("amount", parse_money(F.col("text")))


def row_fields(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Per row the text of each role's column; of several columns the first that is not blank."""
    joined = cells.join(roles, ["doc_id", "col_idx"]).where(F.trim("text") != "")
    pick = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("col_idx"))).alias(r)
    return joined.groupBy("doc_id", "row_idx").agg(*(pick(r) for r in ("name", "program_code", "measure_code", "object_code", "object_name", "source")))


def unpivot_funding(cells: DataFrame, layout: DataFrame, row_sources: DataFrame) -> DataFrame:
    """Amounts by year and source; zeros go; where a row has source columns its totals go; of repeated keys the last column counts.

    A row's amounts come together once, as a short list (a row has as many as its header has columns), and stay so till the end.
    """
    found = F.collect_list(F.when(F.col("amount") != 0, F.struct("col_idx", "year", "source_type", "needs_row_source", "amount")))
    row = amount_cells(cells, layout).groupBy("doc_id", "row_idx").agg(found.alias("found")).join(row_sources, ["doc_id", "row_idx"], "left")
    own = F.filter("found", lambda x: ~x["needs_row_source"])
    kept = F.when(F.size(own) > 0, own).otherwise(F.transform("found", lambda x: x.withField("source_type", F.coalesce("row_source", F.lit("UNKNOWN")))))
    row = row.withColumn("kept", kept)
    last = F.filter("kept", lambda x: ~F.exists("kept", lambda y: (y["year"] == x["year"]) & (y["source_type"] == x["source_type"]) & (y["col_idx"] > x["col_idx"])))
    return row.select("doc_id", "row_idx", F.explode(last).alias("x")).select("doc_id", "row_idx", "x.year", "x.source_type", "x.amount")


def total_columns(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Year totals from columns without a source; later rows overwrite earlier ones."""
    at = F.when(F.col("amount") != 0, F.struct("row_idx", "col_idx"))
    return amount_cells(cells, layout.where("needs_row_source")).groupBy("doc_id", "year").agg(F.max_by("amount", at).alias("amount")).where("amount is not null")


def passport_amounts(cells: DataFrame) -> DataFrame:
    """The amounts of a passport's table (cells: doc_id, table_idx, row_idx, col_idx, text), in roubles, with their coordinates.

    The header is the first row with plain years and a cell that names the source; tables whose first six rows speak of
    activities and of finance are none. Row kinds: source (year, source), year_total (the row "всего"), and from the total
    column source_total and grand_total, without a year. A later row of the same kind and key replaces an earlier one.
    """
    table = ["doc_id", "table_idx"]
    t, lower = folded(F.col("text")), F.translate(F.lower("text"), "ё", "е")
    sample = cells.where("row_idx < 6 and col_idx < 8").groupBy(*table).agg(F.bool_or(lower.contains("мероприят")).alias("a"), F.bool_or(lower.contains("финанс")).alias("b")).where("a and b")
    named = t.isin("источник", "источники") | t.rlike("^источники? .*(финанс|средств|бюджет)")
    year = F.regexp_extract(t, r"^(20\d\d)( ?год)?$", 1).try_cast("int")
    # marks begin with a year or one of two letters; other texts are not read further
    marks = cells.where(F.col("text").rlike(r"^\s*(20\d\d|[иИвВ])")).select(*table, "row_idx", "col_idx", year.alias("year"), named.alias("named"), t.rlike(r"^всего( |$)").alias("whole"))
    rows = marks.where("year is not null or named or whole").groupBy(*table, "row_idx").agg(
        F.collect_list(F.when(F.col("year").isNotNull(), F.struct("col_idx", "year"))).alias("years"), F.bool_or("named").alias("named"), F.min(F.when(F.col("whole") & F.col("year").isNull(), F.col("col_idx"))).alias("total_col")
    )
    able = rows.where("named and size(years) > 0").join(sample.select(*table), table, "left_anti")
    head = able.groupBy(*table).agg(F.min_by(F.struct("years", "total_col"), "row_idx").alias("h"), F.min("row_idx").alias("head"))
    columns = head.select(*table, "head", F.explode(F.array_append(F.col("h.years"), F.struct(F.col("h.total_col").alias("col_idx"), F.lit(None).cast("int").alias("year")))).alias("c")).select(*table, "head", "c.*").where("col_idx is not null")
    # of a year's several columns the first counts
    columns = columns.groupBy(*table, "head", "year").agg(F.min("col_idx").alias("col_idx"))
    labels = cells.where("col_idx = 0").select(*table, "row_idx", F.col("text").alias("label"))
    # labels repeat: each wording is read once
    label = folded(F.col("label"))
    wording = settled(labels.select("label").distinct().select("label", label.startswith("всего").alias("whole"), normalize_source_cells(F.col("label")).alias("source")))
    labels = labels.join(wording.where("whole or source <> 'UNKNOWN'"), "label").drop("label")
    body = cells.join(columns, [*table, "col_idx"]).where("row_idx > head").join(labels, [*table, "row_idx"])
    whole, source, none = F.col("whole"), F.col("source"), F.col("year").isNull()
    kind = F.when(whole & none, "grand_total").when(whole, "year_total").when(none, "source_total").otherwise("source")
    out = body.select(*table, "row_idx", "col_idx", kind.alias("kind"), "year", F.when(~whole, source).alias("source_type"), parse_money(F.col("text"), "thousand_rub").alias("amount"))
    last = out.groupBy("doc_id", "kind", "year", "source_type").agg(F.max_by(F.struct("table_idx", "row_idx", "col_idx", "amount"), F.struct("table_idx", "row_idx")).alias("x"))
    return last.select("doc_id", "kind", "year", "source_type", "x.*")


def explicit_zero_rows(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows with amount columns and no amount but zero."""
    return amount_cells(cells, layout).groupBy("doc_id", "row_idx").agg(F.count_if(F.col("amount") != 0).alias("n")).where("n = 0").select("doc_id", "row_idx")


def finance_tables(cells: DataFrame) -> DataFrame:
    """C11: tables whose first four rows and six columns speak of sources and years, numbered within the document."""
    head = cells.where("row_idx < 4 and col_idx < 6").groupBy("doc_id", "table_idx").agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("t"))
    return head.where(F.col("t").rlike("источник") & F.col("t").rlike(YEAR)).select("doc_id", "table_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("table_idx")).alias("ordinal"))


def finance_layout(cells: DataFrame, first_col: int = 5) -> DataFrame:
    """The first column of each year from `first_col` on, by row and column."""
    found = cells.where(F.col("col_idx") >= first_col).withColumn("year", F.regexp_extract("text", YEAR, 1).try_cast("int")).where("year is not null")
    return found.groupBy("doc_id", "year").agg(F.min_by("col_idx", F.struct("row_idx", "col_idx")).alias("col_idx"))


def finance_tree(rows: DataFrame) -> DataFrame:
    """Rows (number, name) to nodes; main activities and activities carry down, a main activity resets the activity."""
    w = W.partitionBy("doc_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    kind = classify_finance_node(F.col("number"), F.col("name"))
    out = rows.withColumn("node_type", kind).withColumn("key", F.concat_ws(":", "node_type", normalize_display_number(F.col("number")), slug(F.col("name"))))
    last = lambda k, c: F.last(F.when(F.col("node_type") == k, F.col(c)), True).over(w)
    out = out.withColumns({"main": last("main_activity", "key"), "main_row": last("main_activity", "row_idx"), "act": last("activity", "key"), "act_row": last("activity", "row_idx")})
    act = F.when(F.coalesce("act_row", F.lit(-1)) > F.coalesce("main_row", F.lit(-1)), F.col("act"))
    parent = F.when(F.col("node_type") == "object", F.coalesce(act, "main")).when(F.col("node_type") == "activity", F.col("main"))
    return out.select("doc_id", "row_idx", "node_type", "key", parent.alias("parent_key"))


def node_dedup(nodes: DataFrame) -> DataFrame:
    """Of equal keys the first row."""
    return nodes.withColumn("__rn", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("row_idx"))).where("__rn = 1").drop("__rn")


def finance_lines(source_rows: DataFrame, nodes: DataFrame, n: int | None = None) -> DataFrame:
    """C14: each source row goes to the last node above it; dealt by their documents over n tasks if that is given."""
    marks = nodes.select("doc_id", "row_idx", F.col("key").alias("node_key"), F.lit(None).cast("string").alias("source"), F.lit(None).cast(MONEY).alias("amount"))
    every = marks.unionByName(source_rows.select("doc_id", "row_idx", F.lit(None).cast("string").alias("node_key"), "source", "amount"))
    every = every if n is None else every.repartition(n, "doc_id")
    above = F.last("node_key", True).over(W.partitionBy("doc_id").orderBy("row_idx", F.col("source").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    return every.withColumn("node_key", above).where("source is not null").select("doc_id", "row_idx", "node_key", normalize_source_cells(F.col("source")).alias("source_type"), "amount")


def shifted_rows(rows: DataFrame) -> DataFrame:
    """Where the first four cells are equal and the fifth is a source or total, source and totals lie one column to the right."""
    same = F.size(F.array_distinct(F.slice("cells", 1, 4))) == 1
    fifth = F.get("cells", F.lit(4))
    return rows.withColumn("shift", F.when(same & ((normalize_source_cells(fifth) != "UNKNOWN") | total_source_marker(fifth)), 1).otherwise(0))


def subprograms(paragraphs: DataFrame) -> DataFrame:
    """C17: "Подпрограмма N «…»": the first name of each number."""
    found = paragraphs.select("doc_id", "para_idx", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?iu)подпрограмма\s+(\d+)\s+«[^»]+»"), F.lit(0))).alias("p", "m"))
    parsed = found.select("doc_id", "para_idx", "p", F.regexp_extract("m", r"(\d+)", 1).cast("int").alias("number"), F.regexp_extract("m", "«([^»]+)»", 1).alias("name"))
    return parsed.groupBy("doc_id", "number").agg(F.min_by("name", F.struct("para_idx", "p")).alias("name"))


def program_metadata(paragraphs: DataFrame) -> DataFrame:
    """The first quoted name and the first range of years."""
    name, span = F.nullif(F.regexp_extract("text", "«([^»]+)»", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"(20\d\d\s*[-–]\s*20\d\d)", 1), F.lit(""))
    p = paragraphs.withColumns({"n": name, "s": span})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("para_idx")))
    return p.groupBy("doc_id").agg(first("n").alias("program_name"), first("s").alias("period"))


def text_changes(pages: DataFrame) -> DataFrame:
    """C20: sentences with a year and money as change rows."""
    sentences = pages.select("doc_id", "page_number", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("position", "sentence"))
    kept = sentences.where(F.col("sentence").rlike(YEAR) & F.col("sentence").rlike(r"\d+([.,]\d+)?\s*(тыс|млн|руб)"))
    return kept.select("doc_id", "page_number", "position", F.regexp_extract("sentence", YEAR, 1).cast("int").alias("year"), amount_mode(F.col("sentence")).alias("mode"), extract_object_name(F.col("sentence")).alias("object_name"))


def stated_years(sentence: Column) -> Column:
    """The years that a sentence speaks of, in order: numbers within quoted names and amounts are none, unless there are no others."""
    found = lambda c: F.regexp_extract_all(c, F.lit(YEAR + r"(?![.,]?\d)(?!\s*(?:тыс|млн|млрд|миллион|руб|rub|₽))"), F.lit(1))
    years = found(F.regexp_replace(sentence, "«[^»]*»|\"[^\"]*\"", " "))
    return F.when(F.size(years) > 0, years).otherwise(F.regexp_extract_all(sentence, F.lit(YEAR), F.lit(1))).cast("array<int>")


def change_fields(windows: DataFrame) -> DataFrame:
    """C20's fields of windows (doc_id, page_number, position, sentence): mode, years, source, old and new amount, delta, confidence, evidence.

    Two amounts with "с … до …" are the old and the new one. Deltas carry the sign of their mode; a transfer has two years
    and no new amount; zeroing sets zero.
    """
    s = F.col("sentence")
    number = r"\d+(?:[ \u00a0]\d{3})*(?:[.,]\d+)?"
    raw = F.regexp_extract_all(s, F.lit(rf"({number}\s*(?:тыс\S*\s*руб|млн\S*\s*руб|тыс|млн|руб))"), F.lit(1))
    value = lambda x: F.round(F.translate(F.regexp_replace(x, r"[^\d.,]|\.(?!\d)", ""), ",", ".").try_cast("decimal(24,6)") * F.when(x.contains("тыс"), 1000).when(x.contains("млн"), 1000000).otherwise(1), 2).cast(MONEY)
    rows = windows.withColumns({"mode": amount_mode(s), "years": stated_years(s), "amounts": F.transform(raw, value), "source_type": normalize_source_cells(s), "object_name": extract_object_name(s)})
    mode, amounts, zero = F.col("mode"), F.col("amounts"), F.lit(0).cast(MONEY)
    first, second = F.get("amounts", F.lit(0)), F.get("amounts", F.lit(1))
    two = (mode == "absolute") & (F.size(amounts) > 1) & folded(s).rlike(r"\bс\b.* до |увеличить с |уменьшить с ")
    old = F.when(two, first)
    new = F.when(mode == "zeroing", zero).when(two, second).when(mode == "absolute", first)
    delta = F.when(two, (second - first).cast(MONEY)).when(mode == "delta_minus", (-first).cast(MONEY)).when(mode.isin("delta_plus", "transfer"), first)
    span = F.col("years")
    moved = mode == "transfer"
    conf = extraction_confidence(F.col("object_name") != "", F.col("source_type") != "UNKNOWN", F.size(amounts), old.isNotNull(), mode)
    return rows.select(
        "doc_id", "page_number", "position", "object_name", "mode", F.get(span, F.lit(0)).alias("year"), "source_type", old.alias("old_amount"), new.alias("new_amount"), delta.alias("delta"),
        F.when(moved, F.get(span, F.lit(0))).alias("from_year"), F.when(moved, F.get(span, F.lit(1))).alias("to_year"), conf.alias("confidence"), trim_evidence(s).alias("evidence"),
    )


def change_windows(pages: DataFrame, size: int = 120, step: int = 80) -> DataFrame:
    """C20's windows: sentences that speak of a year and of money or of an end of financing; for pages without any, windows of words that do."""
    able = lambda c: F.col(c).rlike(YEAR) & (F.col(c).rlike(r"\d+([.,]\d+)?\s*(тыс|млн|руб)") | (amount_mode(F.col(c)) == "zeroing"))
    sentences = pages.select("doc_id", "page_number", F.posexplode(F.split("text", r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])")).alias("position", "sentence")).where(able("sentence"))
    rest = pages.join(sentences.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    words = rest.select("doc_id", "page_number", F.split(F.trim("text"), r"\s+").alias("w"))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(i.alias("position"), F.array_join(F.slice(F.col("w"), i + 1, size), " ").alias("sentence")))
    windows = words.select("doc_id", "page_number", F.explode(at).alias("x")).select("doc_id", "page_number", "x.position", "x.sentence").where(able("sentence"))
    return sentences.unionByName(windows)


def word_windows(pages: DataFrame, size: int = 120, step: int = 80) -> DataFrame:
    """C20's fallback: overlapping windows of words."""
    words = pages.select("doc_id", F.split(F.trim("text"), r"\s+").alias("w"))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(i.alias("start"), F.slice(F.col("w"), i + 1, size).alias("words")))
    return words.select("doc_id", F.explode(at).alias("x")).select("doc_id", "x.start", F.size("x.words").alias("n_words"))


def fragment_columns(fragments: DataFrame, layout: DataFrame) -> DataFrame:
    """Fragments in the column whose x range holds them; the layout is a small table a document type."""
    on = (fragments.kind == layout.kind) & (fragments.x >= layout.x_min) & (fragments.x < layout.x_max)
    return fragments.join(layout, on).select(fragments.doc_id, fragments.y, fragments.x, fragments.text, layout.col)


def position_table(placed: DataFrame, height: float = 5.0) -> DataFrame:
    """Fragments of one band of y and one column joined from left to right."""
    return placed.groupBy("doc_id", F.floor(F.col("y") / height).alias("band"), "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda f: f["text"]), "").alias("text"))


def change_dedup(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The first change of each key by page and position."""
    return changes.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy("page_number", "position"))).where("__rn = 1").drop("__rn")


def document_profile(lines: DataFrame) -> DataFrame:
    """Per document years, sources, warnings, confidence and whether the profile is active."""
    p = lines.groupBy("doc_id").agg(F.countDistinct("year").alias("years"), F.countDistinct("source_type").alias("sources"), F.count_if(F.col("amount").isNull()).alias("bad"))
    warnings = F.array_compact(F.array(F.when(F.col("years") == 0, "no_years"), F.when(F.col("sources") < 2, "few_sources"), F.when(F.col("bad") > 0, "bad_amounts")))
    conf = (F.lit("0.95").cast("decimal(5,4)") - F.size(warnings) * F.lit("0.15").cast("decimal(5,4)")).cast("decimal(5,4)")
    return p.select("doc_id", "years", "sources", F.array_join(warnings, ",").alias("warnings"), conf.alias("confidence"), ((conf >= 0.65) & (F.size(warnings) == 0)).alias("active"))


def numbered_batch(commands: DataFrame) -> DataFrame:
    """A command's numbered blocks as instructions with their years and amounts."""
    blocks = commands.select("command_id", F.posexplode(F.filter(F.split("text", r"(?:^|\s)\d+\)\s+"), lambda b: F.trim(b) != "")).alias("n", "block"))
    return blocks.select("command_id", (F.col("n") + 1).alias("n"), F.regexp_extract("block", YEAR, 1).try_cast("int").alias("year"), (F.translate(F.regexp_extract("block", r"(\d+(?:[.,]\d+)?)\s*тыс", 1), ",", ".").try_cast("decimal(20,2)") * 1000).cast(MONEY).alias("amount"))


def result_heads(rows: DataFrame, table: list[str]) -> DataFrame:
    """The row of each table's header "наименование результата"; tables without one have none."""
    return rows.where(folded(F.col("name")).contains("наименование результата")).groupBy(*table).agg(F.min("row_idx").alias("head"))


def result_nodes(rows: DataFrame, table: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (number, name) below a table's header "наименование результата" as result nodes."""
    table = list(table)
    below = rows.join(result_heads(rows, table), table).where((F.col("row_idx") > F.col("head")) & (F.trim("name") != ""))
    return below.select("doc_id", "row_idx", F.concat_ws(":", F.lit("result"), normalize_display_number(F.col("number")), slug(F.col("name"))).alias("key"))


def build_groups(cells: DataFrame, roles: DataFrame, first_row: int, ranges: DataFrame | None = None, within: int | None = None) -> tuple[DataFrame, DataFrame]:
    """P2 with its groups: merged cells filled, rows typed (T7) and grouped (T13, G1), rows without money kept when they say zero.

    Gives groups (doc_id, group_key, status, object_name, explicit_zero, n_rows) and their funding (doc_id, group_key, year,
    source_type, amount). Totals, empty rows and rows above objects belong to no group.
    """
    filled = cells if ranges is None else fill_merged(cells, ranges)
    layout = settled(amount_columns(header_text(filled, detect_header(filled, within=within)), base_year(filled)))
    body = filled.where(F.col("row_idx") >= first_row)
    fields = row_fields(body, roles)
    kind = classify_sheet_row(F.col("name"), F.col("program_code"), F.col("measure_code"), F.col("object_code"), F.col("object_name"))
    identity = group_identity(F.col("object_code"), F.col("object_name"), F.coalesce("measure_code", F.lit("")), F.coalesce("name", F.lit("")))
    rows = fields.withColumns({"row_type": kind, "identity": identity}).where(F.col("row_type").isin("OBJECT_LEAF", "UNASSIGNED_RESIDUAL", "ACTIVITY_AGGREGATE"))
    rows = rows.select("doc_id", "row_idx", "row_type", F.col("identity.key").alias("group_key"), F.col("identity.status").alias("status"), F.coalesce("object_name", "name").alias("object_name"), normalize_source_cells(F.col("source")).alias("row_source"))
    zeros = explicit_zero_rows(body, layout).withColumn("zero", F.lit(True))
    groups = rows.join(zeros, ["doc_id", "row_idx"], "left").groupBy("doc_id", "group_key").agg(
        F.min_by("status", "row_idx").alias("status"), F.min_by("object_name", "row_idx").alias("object_name"), F.bool_and(F.coalesce("zero", F.lit(False))).alias("explicit_zero"), F.count("*").alias("n_rows")
    )
    money = unpivot_funding(body, layout, rows.select("doc_id", "row_idx", "row_source")).join(rows.select("doc_id", "row_idx", "group_key"), ["doc_id", "row_idx"])
    return groups, money.groupBy("doc_id", "group_key", "year", "source_type").agg(F.sum("amount").cast(MONEY).alias("amount"))


def build_target(cells: DataFrame, row_sources: DataFrame, first_row: int) -> tuple[DataFrame, DataFrame]:
    """A sheet's funding by row, year and source, and its year totals."""
    layout = settled(amount_columns(header_text(cells, detect_header(cells)), base_year(cells)))
    body = cells.where(F.col("row_idx") >= first_row)
    return unpivot_funding(body, layout, row_sources), total_columns(body, layout)


def build_tree(rows: DataFrame, source_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document's nodes, each once, and the lines of its nodes. Nodes are settled, as both are made of them."""
    nodes = settled(node_dedup(finance_tree(dealt(rows, "doc_id"))))
    return nodes, finance_lines(source_rows, nodes, tasks(nodes.select("doc_id").unionByName(source_rows.select("doc_id"))))


def build_program(rows: DataFrame, source_rows: DataFrame, cells: DataFrame, paragraphs: DataFrame) -> dict[str, DataFrame]:
    """P1 in full: nodes and lines of the finance tables, result nodes, subprograms, the program's name and period, the passport's amounts.

    rows: doc_id, table_idx, row_idx, number, name, their row_idx counted over the whole document. Tables with a header of results have
    no finance nodes.
    """
    table = ["doc_id", "table_idx"]
    nodes, lines = build_tree(rows.join(result_heads(rows, table), table, "left_anti").drop("table_idx"), source_rows)
    return {"nodes": nodes, "lines": lines, "results": result_nodes(rows, ("doc_id", "table_idx")), "subprograms": subprograms(paragraphs), "metadata": program_metadata(paragraphs), "passport": passport_amounts(cells)}


def build_patch_checked(pages: DataFrame, placed: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P3 in full: changes of texts, each object, year, source and mode once, and the control sums of positioned amounts.

    placed: fragments with their column's year and source (doc_id, y, x, col, text, year, source_type); their bands are put together
    (C21) and summed by document, year and source against controls (doc_id, year, source_type, amount) (C22).
    """
    # a split of short pages holds millions, and the first of each key is looked for by sorting a task's changes
    pages = dealt(pages, "doc_id")
    changes = change_dedup(change_fields(change_windows(pages)), ["doc_id", "object_name", "year", "source_type", "mode"])
    keys = placed.select("doc_id", "col", "year", "source_type").distinct()
    table = position_table(placed).join(keys, ["doc_id", "col"]).withColumn("amount", parse_money(F.col("text")))
    details = table.groupBy("doc_id", "year", "source_type").agg(F.sum("amount").cast(MONEY).alias("amount"))
    return changes, control_sums(details, controls, ["doc_id", "year", "source_type"])


def build_patch(pages: DataFrame) -> DataFrame:
    """A document's changes, the first of each object, year and mode."""
    return change_dedup(text_changes(pages), ["doc_id", "object_name", "year", "mode"])
