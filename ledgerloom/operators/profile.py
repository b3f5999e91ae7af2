"""C26 in full: what a document holds, which of it is missing, and how far its profile can be trusted.

All that was parsed from documents is brought into one table of facts, grouped once by document, kind and table and once more by
document, so that a document with very many lines is summed before it meets anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The role of a type of documents, the unit of its money, and the least confidence of an active profile.
ROLES = {"docx_program": "current_program", "xlsx_finance": "xlsx_target_model", "pdf_agreement": "pdf_patch_source", "pdf_procedure": "procedure"}
UNITS = {"docx_program": "thousand_rub", "xlsx_finance": "rub", "pdf_agreement": "rub"}
ACTIVE = "0.65"

CELLS = "array<struct<year:int,col_idx:int>>"


def profile_documents(documents: DataFrame, lines: DataFrame, passport: DataFrame, groups: DataFrame, changes: DataFrame, tables: DataFrame, controls: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a document: role, unit, finance tables with their columns, years, sources, passport, counts, warnings, confidence, status.

    documents: doc_id, document_type. lines: doc_id, line_no, table_idx, source_type, source_col, total_col, year_cells (array of year
    and col_idx). passport: doc_id, kind (total, source, or an amount without a place), table_idx, year, col_idx. groups: doc_id,
    group_key, source_type, explicit_zero. changes, chunks: doc_id a row. tables: doc_id, table_idx, table_type. controls: doc_id, status.

    A table's columns are those of its first line that knows its year cells (else of its first line); lines without a table count for
    the sources only. Facts count for the type of document that they belong to. A document that is listed twice has one row, that of
    its least type; facts of unlisted documents are left out, and rows without doc_id. Missing facts give empty lists and zeros.
    """
    order = F.struct(F.coalesce(F.size("year_cells") <= 0, F.lit(True)), "line_no")
    columns = F.struct("source_col", "total_col", F.array_sort(F.array_distinct(F.coalesce("year_cells", F.array().cast(CELLS)))).alias("year_cells"))
    facts = [
        documents.select("doc_id", F.lit("document").alias("kind"), "document_type"),
        lines.select("doc_id", F.lit("line").alias("kind"), "table_idx", "source_type", order.alias("order"), columns.alias("columns")),
        passport.select("doc_id", F.when(F.col("kind").isin("total", "source"), F.concat(F.lit("passport_"), "kind")).otherwise("passport").alias("kind"), F.struct("year", "col_idx").alias("place"), F.col("table_idx").alias("at")),
        groups.select("doc_id", F.lit("group").alias("kind"), F.col("group_key").alias("item"), "source_type", F.col("explicit_zero").alias("flag")),
        changes.select("doc_id", F.lit("change").alias("kind")),
        tables.select("doc_id", F.lit("table").alias("kind"), "table_idx", F.col("table_type").alias("item")),
        controls.select("doc_id", F.lit("control").alias("kind"), F.col("status").alias("item")),
        chunks.select("doc_id", F.lit("chunk").alias("kind")),
    ]
    told = facts[0]
    for more in facts[1:]:
        told = told.unionByName(more, allowMissingColumns=True)
    # a group's key may come in several rows, one a source
    seen = told.where("doc_id is not null").groupBy("doc_id", "kind", "table_idx", F.when(F.col("kind").isin("group", "table", "control"), F.col("item")).alias("item")).agg(
        F.count("*").alias("n"), F.min("document_type").alias("document_type"), F.min_by("columns", "order").alias("columns"), F.array_sort(F.collect_set("source_type")).alias("sources"),
        F.bool_or("flag").alias("flag"), F.array_sort(F.collect_set("place")).alias("places"), F.min_by("at", F.struct("place", "at")).alias("at"),
    )
    of = lambda *kinds: F.col("kind").isin(*kinds)
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    number = lambda cond, c=None: F.coalesce(F.sum(F.when(cond, F.lit(1) if c is None else F.col(c))), F.lit(0)).cast("bigint")
    in_table = of("line") & F.col("table_idx").isNotNull()
    by = seen.groupBy("doc_id").agg(
        F.min("document_type").alias("document_type"), F.bool_or(of("document")).alias("listed"),
        F.array_sort(F.collect_list(F.when(in_table, F.struct("table_idx", "columns.source_col", "columns.total_col", "columns.year_cells")))).alias("finance_tables"),
        number(of("line"), "n").alias("lines"), lists(F.when(of("line"), F.col("sources"))).alias("line_sources"),
        number(of("group")).alias("groups"), number(of("group") & F.col("flag")).alias("zero_groups"), lists(F.when(of("group"), F.col("sources"))).alias("group_sources"),
        F.bool_or(of("passport", "passport_total", "passport_source")).alias("has_passport"),
        F.coalesce(F.min(F.when(of("passport_total"), F.col("at"))), F.min(F.when(of("passport_source"), F.col("at")))).alias("passport_table"),
        lists(F.when(of("passport_total"), F.filter("places", lambda p: p["col_idx"].isNotNull()))).alias("passport_years"),
        number(of("change"), "n").alias("changes"), number(of("table"), "n").alias("tables"), F.array_sort(F.collect_set(F.when(of("table"), F.col("item")))).alias("table_types"),
        F.min(F.when(of("control"), F.col("item"))).alias("control_status"), number(of("chunk"), "n").alias("chunks"),
    ).where("listed")
    return judged(by)


def judged(by: DataFrame) -> DataFrame:
    """Warnings, confidence and status of gathered facts, each type by its own tests."""
    kind = F.col("document_type")
    docx, sheet, patch, rules = (kind == F.lit(k) for k in ROLES)
    known, no_tables = F.coalesce(kind.isin(*ROLES), F.lit(False)), F.size("finance_tables") == 0
    failed = patch & F.coalesce(F.col("control_status") == "failed", F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(~known, "unsupported_type"), F.when(docx & (F.col("lines") == 0), "no_funding_lines"), F.when(docx & ~F.col("has_passport"), "no_passport"), F.when(sheet & (F.col("groups") == 0), "no_object_groups"),
            F.when(patch & (F.col("changes") == 0), "no_changes"), F.when(failed, "controls_failed"), F.when(patch & F.col("control_status").isNull() & (F.col("tables") > 0), "controls_missing"),
        )
    )
    part = lambda cond, cost: F.when(cond, F.lit(cost)).otherwise(F.lit("0")).cast("decimal(5,2)")
    costs = [part(F.size("warnings") > 0, "0.25"), part(docx & no_tables, "0.35"), part(docx & ~F.col("has_passport"), "0.25"), part(patch & (F.col("changes") == 0), "0.35"), part(failed, "0.45")]
    confidence = F.greatest(F.lit("1").cast("decimal(5,2)") - sum(costs[1:], costs[0]), F.lit("0").cast("decimal(5,2)")).cast("decimal(5,2)")
    none = F.array().cast("array<string>")
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    of = lambda cond, c, other: F.when(cond, c).otherwise(other)
    tables = of(docx, F.col("finance_tables"), F.array_except("finance_tables", "finance_tables"))
    out = by.withColumn("warnings", warnings).withColumn("confidence", confidence)
    return out.select(
        "doc_id", "document_type", F.try_element_at(names, kind).alias("document_role"), F.try_element_at(units, kind).alias("unit"), tables.alias("finance_tables"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(tables, lambda t: F.transform(t["year_cells"], lambda y: y["year"]))))).alias("years"),
        F.exists(tables, lambda t: t["source_col"].isNotNull()).alias("source_column"), F.exists(tables, lambda t: t["total_col"].isNotNull()).alias("total_column"),
        F.when(docx, F.col("line_sources")).when(sheet, F.col("group_sources")).otherwise(none).alias("sources"),
        of(docx, F.col("has_passport"), F.lit(False)).alias("passport"), F.when(docx, F.col("passport_table")).alias("passport_table"), F.when(docx, F.col("passport_years")).alias("passport_years"),
        *(of(cond, F.col(c), F.lit(0)).cast("bigint").alias(c) for cond, c in ((docx, "lines"), (sheet, "groups"), (sheet, "zero_groups"), (patch, "changes"), (patch, "tables"), (rules, "chunks"))),
        of(patch, F.col("table_types"), none).alias("table_types"), F.when(patch, F.col("control_status")).alias("control_status"), "warnings", "confidence",
        F.when((F.col("confidence") >= F.lit(ACTIVE).cast("decimal(5,2)")) & (F.size("warnings") == 0), "active").otherwise("failed").alias("status"),
    )
