"""Boolean columns on nodes and change items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import folded


def active_item(status: Column, excluded: Column) -> Column:
    """B1."""
    return (status != "rejected") & ~F.coalesce(excluded, F.lit(False))


def tenant_scope(df: DataFrame, grants: DataFrame) -> DataFrame:
    """B2: rows of granted organizations; grants with a created_by reach only that user's rows."""
    g = grants.select(F.col("org_id").alias("__o"), F.col("created_by").alias("__u")).distinct()
    return df.join(g, (df.org_id == F.col("__o")) & (F.col("__u").isNull() | (df.created_by == F.col("__u"))), "left_semi")


def summary_row(number: Column, name: Column, code: Column) -> Column:
    """B4."""
    t = folded(F.concat_ws(" ", number, name, code))
    return t.rlike(r"^(итого|всего)\b|\b(итого|всего)\s+по\b")


def virtual_node(name: Column, flag: Column) -> Column:
    """B5."""
    return F.coalesce(flag, F.lit(False)) | folded(name).rlike("корректировк|adjustment")


def concrete_financial_node(node_type: Column, is_summary: Column, is_virtual: Column) -> Column:
    """B3."""
    return node_type.isin("object", "residual") & ~is_summary & ~is_virtual


def numeric_label(name: Column) -> Column:
    """B6 (a)."""
    return F.trim(name).rlike(r"^[-+]?\d+([.,]\d+)?$")


def numeric_label_verifier(name: Column) -> Column:
    """B6 (b): digits and points, five digits at least."""
    return F.trim(name).rlike(r"^[\d.]+$") & (F.length(F.regexp_replace(name, r"\D", "")) >= 5)


def finance_display_number(c: Column) -> Column:
    """B7."""
    return F.regexp_replace(c, r"\.+$", "").rlike(r"^\d+(\.\d+)*$")


def in_program_period(year: Column, start: Column, end: Column) -> Column:
    """Open if a bound is missing."""
    return start.isNull() | end.isNull() | year.between(start, end)


def target_years(df: DataFrame, years: DataFrame) -> DataFrame:
    """Rows of the target years; all rows if there are none."""
    wanted = years.select(F.col("year").alias("__y")).where("__y is not null").distinct()
    any_ = wanted.agg((F.count("*") == 0).alias("__none"))
    marked = df.join(wanted, df.year == F.col("__y"), "left").crossJoin(F.broadcast(any_))
    return marked.where("__none or __y is not null").select(*df.columns)


def service_row(name: Column, marker: str) -> Column:
    """B10."""
    return folded(name) == marker


def category_code_present(values: Column) -> Column:
    """A value under a header with КОСГУ and without суб."""
    return F.exists(F.map_entries(values), lambda e: F.lower(e["key"]).contains("косгу") & ~F.lower(e["key"]).contains("суб") & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))


def matches_query(text: Column, query: Column) -> Column:
    """A six-letter beginning of some word of the query is in the text."""
    return F.exists(F.split(folded(query), " "), lambda w: (F.char_length(w) >= 6) & folded(text).contains(F.left(w, F.lit(6))))


def safe_to_confirm(is_new: Column, confidence: Column, threshold: float, conflict: Column, manual: Column, ocr: Column, mode: Column) -> Column:
    """B13."""
    return ~is_new & (confidence >= threshold) & ~conflict & ~manual & ~ocr & ~mode.isin("unknown", "transfer", "zeroing")


def entry_requires_check(mode: Column, ocr: Column, confidence: Column, threshold: float, conflict: Column) -> Column:
    """A confidence that is no number asks for a check."""
    value = confidence.cast("string").try_cast("decimal(5,4)")
    return mode.isin("unknown", "transfer", "zeroing") | ocr | conflict | F.coalesce(value < threshold, F.lit(True))


def export_ready(*facts: Column) -> Column:
    """B15."""
    out = F.lit(True)
    for f in facts:
        out = out & F.coalesce(f, F.lit(False))
    return out


def stale_payloads(groups: DataFrame, marker: str) -> DataFrame:
    """Documents with groups but no years and no money, or with a service group."""
    g = groups.groupBy("doc_id").agg(F.count("year").alias("years"), F.sum(F.abs("amount")).alias("money"), F.bool_or(service_row(F.col("name"), marker)).alias("service"))
    return g.where("(years = 0 and coalesce(money, 0) = 0) or service").select("doc_id")


def visible_residual(name: Column, allowed: list[str]) -> Column:
    """B17."""
    t = folded(name)
    hit = F.lit(False)
    for a in allowed:
        hit = hit | t.startswith(a)
    return hit & ~t.contains("сверх объема")
