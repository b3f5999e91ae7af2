"""Reconciliation, control totals, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import dealt
from .tree import KEY, MONEY, total

#: Fixed tolerances: totals, control sums.
TOLERANCE, CONTROL_TOLERANCE = 10.0, 0.01
PRIORITY = ["FEDERAL_BUDGET", "REGIONAL_BUDGET", "LOCAL_BUDGET"]


def money(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast(MONEY)


def reconcile_totals(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = TOLERANCE, keep_ok: bool = True) -> DataFrame:
    """D3: keys of either side with left, right, delta and OK or DIFF; a missing side counts as zero; the tolerance is strict."""
    joined = left.withColumnRenamed("amount", "l").join(right.withColumnRenamed("amount", "r"), keys, "full_outer")
    out = joined.select(*keys, money("l").alias("left_amount"), money("r").alias("right_amount"))
    out = out.withColumn("delta", (F.col("right_amount") - F.col("left_amount")).cast(MONEY)).withColumn("status", F.when(F.abs("delta") > tolerance, "DIFF").otherwise("OK"))
    return out if keep_ok else out.where("status = 'DIFF'")


def total_by_year(lines: DataFrame, by: list[str]) -> DataFrame:
    """G2."""
    return lines.groupBy(*by, "year").agg(total().alias("amount"))


def total_without_double_count(programs: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Program totals where a document has any, else the sum of its groups."""
    stated = programs.select(by).distinct()
    own = programs.groupBy(by, "year").agg(total().alias("amount"))
    rest = groups.join(stated, by, "left_anti").groupBy(by, "year").agg(total().alias("amount"))
    return own.unionByName(rest)


def target_source_totals(candidates: DataFrame, by: str) -> DataFrame:
    """Of candidates (by, stage, year, source, amount) those of each document's first stage that has any."""
    first = F.min("stage").over(W.partitionBy(by))
    return candidates.withColumn("__first", first).where("stage = __first").groupBy(by, "stage", *KEY).agg(total().alias("amount"))


def spread_difference(totals: DataFrame, control: DataFrame, priority: list[str] = PRIORITY, tolerance: float = CONTROL_TOLERANCE) -> DataFrame:
    """Per year the control's difference goes to the first present source by priority, else to LOCAL_BUDGET."""
    rank = F.coalesce(*(F.when(F.col("source_type") == s, F.lit(i)) for i, s in enumerate(priority)), F.lit(len(priority)))
    first = totals.groupBy("year").agg(F.min_by("source_type", F.struct(rank, "source_type")).alias("source_type"), F.sum("amount").alias("have"))
    joined = control.withColumnRenamed("amount", "want").join(first, "year", "left")
    delta = joined.select("year", F.coalesce("source_type", F.lit("LOCAL_BUDGET")).alias("source_type"), (F.col("want") - F.coalesce("have", F.lit(0))).cast(MONEY).alias("amount")).where(F.abs("amount") > tolerance)
    return totals.select(*KEY, "amount").unionByName(delta).groupBy(*KEY).agg(total().alias("amount"))


def column_total_checks(amounts: DataFrame, columns: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Sums over years by source, and over all (source ALL), against stated totals."""
    sums = amounts.rollup("source_type").agg(total().alias("amount")).select(F.coalesce("source_type", F.lit("ALL")).alias("source_type"), "amount")
    return reconcile_totals(columns, sums, ["source_type"], tolerance)


def year_source_checks(expected: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Expected keys by year (source ALL) and by year and source: OK, MISMATCH or MISSING, which is no zero."""

    def sums(df: DataFrame, name: str) -> DataFrame:
        return df.groupingSets([["year"], ["year", "source_type"]], "year", "source_type").agg(total().alias(name)).select("year", F.coalesce("source_type", F.lit("ALL")).alias("source_type"), name)

    joined = sums(expected, "expected").join(sums(actual, "actual"), KEY, "left")
    code = F.when(F.col("actual").isNull(), "MISSING").when(F.abs(F.col("actual") - F.col("expected")) > tolerance, "MISMATCH").otherwise("OK")
    return joined.withColumn("code", code)


def aggregate_expected(nodes: DataFrame, lines: DataFrame, summary: Column) -> DataFrame:
    """Summary nodes by source, other nodes by year only (source TOTAL)."""
    joined = dealt(lines.select("node_id", *KEY, "amount"), "node_id").join(nodes.select("node_id", summary.alias("is_summary")), "node_id").where("is_summary is not null")
    source = F.when(F.col("is_summary"), F.col("source_type")).otherwise("TOTAL").alias("source_type")
    return joined.groupBy("node_id", "is_summary", "year", source).agg(total().alias("amount")).drop("is_summary")


def control_sums(details: DataFrame, controls: DataFrame, by: list[str], tolerance: float = CONTROL_TOLERANCE) -> DataFrame:
    """Per key passed or failed, not_applicable without a control row; within the tolerance passes."""
    joined = details.withColumnRenamed("amount", "d").join(controls.withColumnRenamed("amount", "c"), by, "full_outer")
    status = F.when(F.col("c").isNull(), "not_applicable").when(F.abs(money("d") - F.col("c")) <= tolerance, "passed").otherwise("failed")
    return joined.select(*by, money("d").alias("detail"), F.col("c").alias("control"), status.alias("status"))


def document_control(checks: DataFrame, doc: str) -> DataFrame:
    """C22 by document: failed if any failed, passed if any passed, else not_applicable."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "passed"), "passed").otherwise("not_applicable")
    return checks.groupBy(doc).agg(status.alias("status"), F.count("*").alias("checks"))


def funding_validate(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Expected amounts that are not about zero against actual ones; keys that are missing there are skipped."""
    joined = expected.where(F.abs("amount") > tolerance).withColumnRenamed("amount", "expected").join(actual.withColumnRenamed("amount", "actual"), keys)
    return joined.withColumn("delta", (F.col("actual") - F.col("expected")).cast(MONEY)).withColumn("valid", F.abs("delta") <= F.greatest(F.lit(tolerance), F.lit(50.0)))


def validate_version(target: DataFrame, observed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """P20: per node and year: OK, MISSING, MISMATCH or UNEXPECTED."""
    sums = lambda df, n: df.groupBy("node_id", "year").agg(total().alias(n))
    joined = sums(target, "expected").join(sums(observed, "observed"), ["node_id", "year"], "full_outer")
    code = F.when(F.col("observed").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.abs(F.col("observed") - F.col("expected")) > tolerance, "MISMATCH").otherwise("OK")
    return joined.withColumn("code", code)


def validation_rows(level: str, expected: DataFrame, actual: DataFrame, keys: list[str], missing: str | None, mismatch: str, tolerance: float = TOLERANCE) -> DataFrame:
    """One level of P20: expected keys with actual amounts, delta and an error code, null where all is well.

    Keys that are missing in actual give the code `missing`, or none if that is null. `key` shows the level's columns.
    """
    joined = expected.groupBy(*keys).agg(total().alias("expected")).join(actual.groupBy(*keys).agg(total().alias("actual")), keys, "left")
    delta = (F.col("actual") - F.col("expected")).cast(MONEY)
    code = F.when(F.col("actual").isNull(), F.lit(missing)).when(F.abs(delta) > tolerance, F.lit(mismatch))
    return joined.select(F.lit(level).alias("level"), F.concat_ws("::", *keys).alias("key"), "expected", "actual", delta.alias("delta"), code.alias("code"))


def validate_levels(target: DataFrame, passport: DataFrame, nodes: DataFrame, observed: DataFrame, summary: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """P20 on all levels: the passport by year and by year and source against the target's lines (node_id, year, source_type, amount),
    objects by source, aggregates by year or, where they are summaries, by source (G20) against the observed lines.

    A passport year must be there; a missing passport source or object is no error, only a different amount.
    """
    objects = nodes.where(~summary).select("node_id")
    want, have = (aggregate_expected(nodes, df, summary) for df in (target, observed))
    parts = [
        validation_rows("passport_year", target, passport, ["year"], "passport_total_missing", "passport_total_mismatch", tolerance),
        validation_rows("passport_source", target, passport, KEY, None, "passport_source_mismatch", tolerance),
        validation_rows("object", target.join(objects, "node_id", "left_semi"), observed, ["node_id", *KEY], None, "object_funding_mismatch", tolerance),
        validation_rows("aggregate", want, have, ["node_id", *KEY], None, "aggregate_funding_mismatch", tolerance),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def version_status(checks: DataFrame, by: list[str]) -> DataFrame:
    """P20's status: invalid with mismatches, valid_with_warnings with unexpected or missing rows, else valid."""
    bad, odd = F.count_if(F.col("code") == "MISMATCH"), F.count_if(F.col("code").isin("MISSING", "UNEXPECTED"))
    return checks.groupBy(*by).agg(bad.alias("errors"), odd.alias("warnings")).withColumn("status", F.when(F.col("errors") > 0, "invalid").when(F.col("warnings") > 0, "valid_with_warnings").otherwise("valid"))


def ledger_validate(ledger: DataFrame, lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Ledger entries (node, year, source, expected_after) against the actual amounts."""
    joined = ledger.join(lines.withColumnRenamed("amount", "actual"), ["node_id", *KEY], "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.abs(F.col("actual") - F.col("expected_after")) > tolerance, "failed").otherwise("applied")
    return joined.withColumn("status", status)


def coverage(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (node_id null if unmatched) against baseline objects."""
    seen = rows.agg(F.count("*").alias("rows_total"), F.count("node_id").alias("rows_matched"), F.countDistinct("node_id").alias("objects_matched"))
    base = baseline.join(rows.select("node_id").distinct().withColumn("hit", F.lit(1)), "node_id", "left").agg(F.count("*").alias("baseline"), F.count_if(F.col("hit").isNull()).alias("absent"))
    return seen.crossJoin(base).withColumn("percent", F.round(F.col("rows_matched") * 100.0 / F.col("rows_total"), 2))


def infer_single_source(lines: DataFrame) -> DataFrame:
    """The source of a node's year if it has just one, else null."""
    return lines.groupBy("node_id", "year").agg(F.when(F.countDistinct("source_type") == 1, F.min("source_type")).alias("source_type"))
