"""Queries of reconciliation and change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as c
from ..operators import reconcile as r
from ..operators.tree import KEY, aggregate_lines, total
from .registry import bound, query, rows

SUM = "CAST(sum(amount) AS DECIMAL(20,2))"
D = "DECIMAL(20,2)"


def sums(spark, sf, name, *by):
    return rows(spark, sf, name).groupBy(*by).agg(total().alias("amount"))


@query(
    "reconcile_totals",
    f"""WITH a AS (SELECT year, {SUM} AS l FROM lines GROUP BY 1), b AS (SELECT year, {SUM} AS r FROM current GROUP BY 1)
    SELECT year, CAST(coalesce(l, 0) AS {D}) AS left_amount, CAST(coalesce(r, 0) AS {D}) AS right_amount, CAST(coalesce(r, 0) - coalesce(l, 0) AS {D}) AS delta,
      CASE WHEN abs(coalesce(r, 0) - coalesce(l, 0)) > 10 THEN 'DIFF' ELSE 'OK' END AS status FROM a FULL JOIN b USING (year)""",
)
def reconcile_totals(spark, sf):
    return r.reconcile_totals(sums(spark, sf, "lines", "year"), sums(spark, sf, "current", "year"), ["year"])


@query(
    "year_source_checks",
    f"""WITH e AS (SELECT year, coalesce(source_type, 'ALL') AS source_type, {SUM} AS expected FROM lines GROUP BY GROUPING SETS ((year), (year, source_type))),
    a AS (SELECT year, coalesce(source_type, 'ALL') AS source_type, {SUM} AS actual FROM target GROUP BY GROUPING SETS ((year), (year, source_type)))
    SELECT year, source_type, expected, actual, CASE WHEN actual IS NULL THEN 'MISSING' WHEN abs(actual - expected) > 10 THEN 'MISMATCH' ELSE 'OK' END AS code FROM e LEFT JOIN a USING (year, source_type)""",
)
def year_source_checks(spark, sf):
    return r.year_source_checks(rows(spark, sf, "lines"), rows(spark, sf, "target"))


@query(
    "column_total_checks",
    f"""WITH s AS (SELECT coalesce(source_type, 'ALL') AS source_type, {SUM} AS r FROM lines GROUP BY ROLLUP (source_type)),
    c AS (SELECT source_type, CAST(sum(amount) - count(*) AS {D}) AS l FROM lines GROUP BY 1)
    SELECT source_type, CAST(coalesce(l, 0) AS {D}) AS left_amount, CAST(coalesce(r, 0) AS {D}) AS right_amount, CAST(coalesce(r, 0) - coalesce(l, 0) AS {D}) AS delta,
      CASE WHEN abs(coalesce(r, 0) - coalesce(l, 0)) > 10 THEN 'DIFF' ELSE 'OK' END AS status FROM c FULL JOIN s USING (source_type)""",
)
def column_total_checks(spark, sf):
    lines = rows(spark, sf, "lines")
    stated = lines.groupBy("source_type").agg((F.sum("amount") - F.count("*")).cast("decimal(20,2)").alias("amount"))
    return r.column_total_checks(lines, stated)


@query(
    "spread_difference",
    f"""WITH t AS (SELECT year, source_type, {SUM} AS amount FROM lines WHERE source_type <> 'FEDERAL_BUDGET' OR year % 2 = 0 GROUP BY ALL),
    k AS (SELECT year, {SUM} AS want FROM current GROUP BY 1),
    f AS (SELECT year, arg_min(source_type, CASE source_type WHEN 'FEDERAL_BUDGET' THEN 0 WHEN 'REGIONAL_BUDGET' THEN 1 ELSE 2 END) AS source_type, sum(amount) AS have FROM t GROUP BY 1),
    d AS (SELECT k.year, coalesce(source_type, 'LOCAL_BUDGET') AS source_type, want - coalesce(have, 0) AS amount FROM k LEFT JOIN f USING (year) WHERE abs(want - coalesce(have, 0)) > 0.01)
    SELECT year, source_type, {SUM} AS amount FROM (SELECT * FROM t UNION ALL SELECT * FROM d) GROUP BY ALL""",
)
def spread_difference(spark, sf):
    totals = rows(spark, sf, "lines").where("source_type <> 'FEDERAL_BUDGET' or year % 2 = 0").groupBy(*KEY).agg(total().alias("amount"))
    return r.spread_difference(totals, sums(spark, sf, "current", "year"))


STAGES = """SELECT o_custkey AS doc, CASE WHEN o_orderkey % 10 < 2 THEN 1 WHEN o_orderkey % 10 < 6 THEN 2 ELSE 3 END AS stage, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(o_totalprice AS DECIMAL(20,2)) AS amount FROM orders"""


@query("target_totals_fallback", f"SELECT doc, stage, year, source_type, {SUM} AS amount FROM ({STAGES}) x WHERE stage = (SELECT min(stage) FROM ({STAGES}) y WHERE y.doc = x.doc) GROUP BY ALL")
def target_totals_fallback(spark, sf):
    return r.target_source_totals(bound(spark, sf, STAGES), "doc")


@query("total_by_year", f"SELECT brand, year, {SUM} AS amount FROM groups GROUP BY ALL")
def total_by_year(spark, sf):
    return r.total_by_year(rows(spark, sf, "groups"), ["brand"])


@query(
    "no_double_count",
    f"""WITH p AS (SELECT concat('C', c_custkey) AS node_id, 2024 AS year, CAST(c_acctbal AS {D}) AS amount FROM customer WHERE c_custkey % 2 = 0)
    SELECT node_id, year, {SUM} AS amount FROM p GROUP BY ALL UNION ALL SELECT node_id, year, {SUM} FROM current WHERE node_id NOT IN (SELECT node_id FROM p) GROUP BY ALL""",
)
def no_double_count(spark, sf):
    programs = bound(spark, sf, f"SELECT concat('C', c_custkey) AS node_id, 2024 AS year, CAST(c_acctbal AS {D}) AS amount FROM customer WHERE c_custkey % 2 = 0")
    return r.total_without_double_count(programs, rows(spark, sf, "current"), "node_id")


@query(
    "aggregate_expected",
    f"""SELECT node_id, year, source_type, {SUM} AS amount FROM lines WHERE node_id LIKE '%1' GROUP BY ALL
    UNION ALL SELECT node_id, year, 'TOTAL', {SUM} FROM lines WHERE node_id NOT LIKE '%1' GROUP BY ALL""",
)
def aggregate_expected(spark, sf):
    return r.aggregate_expected(rows(spark, sf, "nodes"), rows(spark, sf, "lines"), F.col("node_id").like("%1"))


CONTROLS = "SELECT o_orderkey AS doc, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS DECIMAL(20,2)) AS extra FROM orders WHERE o_orderkey % 5 <> 0"
CONTROL_SQL = f"""d AS (SELECT l_orderkey AS doc, CAST(sum(CAST(l_extendedprice AS {D})) AS {D}) AS detail FROM lineitem GROUP BY 1),
    k AS (SELECT doc, CAST(detail + extra AS {D}) AS control FROM d JOIN ({CONTROLS}) USING (doc)),
    s AS (SELECT doc, CAST(coalesce(detail, 0) AS {D}) AS detail, control, CASE WHEN control IS NULL THEN 'not_applicable' WHEN abs(coalesce(detail, 0) - control) <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM d FULL JOIN k USING (doc))"""


def controls(spark, sf):
    d = bound(spark, sf, f"SELECT l_orderkey AS doc, CAST(l_extendedprice AS {D}) AS amount FROM lineitem").groupBy("doc").agg(total().alias("amount"))
    k = d.join(bound(spark, sf, CONTROLS), "doc").select("doc", (F.col("amount") + F.col("extra")).cast("decimal(20,2)").alias("amount"))
    return r.control_sums(d, k, ["doc"])


@query("control_sums", f"WITH {CONTROL_SQL} SELECT * FROM s")
def control_sums(spark, sf):
    return controls(spark, sf)


@query(
    "document_control",
    f"WITH {CONTROL_SQL} SELECT doc % 100 AS doc, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'passed') THEN 'passed' ELSE 'not_applicable' END AS status, count(*) AS checks FROM s GROUP BY 1",
)
def document_control(spark, sf):
    return r.document_control(controls(spark, sf).withColumn("doc", F.col("doc") % 100), "doc")


@query(
    "funding_validate",
    f"""WITH e AS (SELECT node_id, year, {SUM} AS expected FROM current GROUP BY ALL), a AS (SELECT node_id, year, {SUM} AS actual FROM target GROUP BY ALL)
    SELECT node_id, year, expected, actual, CAST(actual - expected AS {D}) AS delta, abs(actual - expected) <= 50 AS valid FROM e JOIN a USING (node_id, year) WHERE abs(expected) > 10""",
)
def funding_validate(spark, sf):
    return r.funding_validate(sums(spark, sf, "current", "node_id", "year"), sums(spark, sf, "target", "node_id", "year"), ["node_id", "year"])


VALID_SQL = f"""e AS (SELECT node_id, year, {SUM} AS expected FROM current GROUP BY ALL), a AS (SELECT node_id, year, {SUM} AS observed FROM target GROUP BY ALL),
    v AS (SELECT node_id, year, expected, observed, CASE WHEN observed IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'UNEXPECTED' WHEN abs(observed - expected) > 10 THEN 'MISMATCH' ELSE 'OK' END AS code FROM e FULL JOIN a USING (node_id, year))"""


@query("validate_version", f"WITH {VALID_SQL} SELECT * FROM v")
def validate_version(spark, sf):
    return r.validate_version(rows(spark, sf, "current"), rows(spark, sf, "target"))


@query(
    "version_status",
    f"""WITH {VALID_SQL}, n AS (SELECT node_id, count(*) FILTER (code = 'MISMATCH') AS errors, count(*) FILTER (code IN ('MISSING', 'UNEXPECTED')) AS warnings FROM v GROUP BY 1)
    SELECT *, CASE WHEN errors > 0 THEN 'invalid' WHEN warnings > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS status FROM n""",
)
def version_status(spark, sf):
    return r.version_status(r.validate_version(rows(spark, sf, "current"), rows(spark, sf, "target")), ["node_id"])


@query(
    "coverage",
    """WITH x AS (SELECT DISTINCT o_custkey AS k, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0), y AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE k END AS k FROM x)
    SELECT count(*) AS rows_total, count(k) AS rows_matched, count(DISTINCT k) AS objects_matched, (SELECT count(*) FROM customer) AS baseline,
      (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM y WHERE k IS NOT NULL)) AS absent, round(count(k) * 100.0 / count(*), 2) AS percent FROM y""",
)
def coverage(spark, sf):
    found = rows(spark, sf, "target").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("node_id")).alias("node_id"))
    return r.coverage(found, bound(spark, sf, "SELECT concat('C', c_custkey) AS node_id FROM customer")).withColumn("percent", F.col("percent").cast("double"))


@query("infer_single_source", "SELECT node_id, year, CASE WHEN count(DISTINCT source_type) = 1 THEN min(source_type) END AS source_type FROM lines GROUP BY ALL")
def infer_single_source(spark, sf):
    return r.infer_single_source(rows(spark, sf, "lines"))


@query(
    "amount_diff",
    f"""WITH w AS (SELECT node_id, year, source_type, {SUM} AS n FROM target GROUP BY ALL), h AS (SELECT node_id, year, source_type, {SUM} AS o FROM current GROUP BY ALL)
    SELECT node_id, year, source_type, CAST(coalesce(n, 0) AS {D}) AS new_amount, CAST(coalesce(o, 0) AS {D}) AS old_amount,
      CASE WHEN n IS NULL THEN 'zeroing' WHEN o IS NULL THEN 'new_key' ELSE 'amount_update' END AS change_type, CAST(coalesce(n, 0) - coalesce(o, 0) AS {D}) AS delta
    FROM w FULL JOIN h USING (node_id, year, source_type) WHERE coalesce(n, 0) <> coalesce(o, 0)""",
)
def amount_diff(spark, sf):
    return c.build_change_set(rows(spark, sf, "target"), rows(spark, sf, "current"))


@query("current_amount", f"SELECT item_id, CAST(coalesce(s, 0) AS {D}) AS old_amount FROM items LEFT JOIN (SELECT node_id, year, source_type, sum(amount) AS s FROM current GROUP BY ALL) USING (node_id, year, source_type)")
def current_amount(spark, sf):
    return c.current_amount(rows(spark, sf, "items").drop("old_amount"), rows(spark, sf, "current")).select("item_id", "old_amount")


@query("absent_zeroing", f"SELECT node_id, year, source_type, {SUM} AS amount FROM current WHERE node_id NOT IN (SELECT node_id FROM target WHERE o_orderkey % 2 = 0) GROUP BY ALL")
def absent_zeroing(spark, sf):
    return c.absent_in_target(rows(spark, sf, "current"), rows(spark, sf, "target").where("o_orderkey % 2 = 0"))


@query(
    "absent_keys",
    f"SELECT node_id, year, source_type, {SUM} AS amount FROM current x WHERE node_id IN (SELECT node_id FROM target) AND NOT EXISTS (SELECT 1 FROM target t WHERE t.node_id = x.node_id AND t.year = x.year AND t.source_type = x.source_type) GROUP BY ALL",
)
def absent_keys(spark, sf):
    return c.absent_keys(rows(spark, sf, "current"), rows(spark, sf, "target"))


ENTRIES = """SELECT concat('C', o_custkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CASE WHEN o_orderkey % 2 = 0 THEN 'xlsx' ELSE 'pdf' END AS doc_type,
  CAST(o_totalprice AS DECIMAL(20,2)) AS amount, o_orderkey FROM orders"""
CONFLICT_SQL = f"""f AS (SELECT node_id, year, source_type, arg_min(amount, o_orderkey) FILTER (doc_type = 'xlsx') AS amount_xlsx, arg_min(amount, o_orderkey) FILTER (doc_type = 'pdf') AS amount_pdf FROM ({ENTRIES}) GROUP BY ALL),
    conflicts AS (SELECT * FROM f WHERE amount_xlsx IS NOT NULL AND amount_pdf IS NOT NULL AND amount_xlsx <> amount_pdf)"""


def conflict_rows(spark, sf):
    return c.detect_conflicts(bound(spark, sf, ENTRIES), ("xlsx", "pdf"), ["o_orderkey"])


@query("conflicts", f"WITH {CONFLICT_SQL} SELECT * FROM conflicts")
def conflicts(spark, sf):
    return conflict_rows(spark, sf)


@query("conflict_lookup", f"WITH {CONFLICT_SQL} SELECT item_id, k.node_id IS NOT NULL AS has_conflict FROM items i LEFT JOIN conflicts k ON i.node_id = k.node_id AND i.year = k.year AND i.source_type = k.source_type")
def conflict_lookup(spark, sf):
    return c.conflict_lookup(rows(spark, sf, "items").drop("has_conflict"), conflict_rows(spark, sf)).select("item_id", "has_conflict")


@query("new_conflicts_only", f"WITH {CONFLICT_SQL} SELECT node_id, year FROM conflicts WHERE (node_id, year) NOT IN (SELECT (node_id, year) FROM target WHERE o_orderkey % 3 = 0)")
def new_conflicts_only(spark, sf):
    return c.new_conflicts_only(conflict_rows(spark, sf), rows(spark, sf, "target").where("o_orderkey % 3 = 0")).select("node_id", "year")


TINY = """SELECT concat('O', l_orderkey) AS node_id, CAST(year(l_shipdate) AS INT) AS year, CAST(l_quantity - 25 AS DECIMAL(20,2)) AS delta FROM lineitem"""


@query(
    "tiny_reallocation",
    f"SELECT node_id, year FROM ({TINY}) GROUP BY ALL HAVING count(*) >= 2 AND abs(sum(delta)) <= 10 AND bool_or(delta > 0) AND bool_or(delta < 0) AND max(abs(delta)) <= 200",
)
def tiny_reallocation(spark, sf):
    return c.tiny_reallocation(bound(spark, sf, TINY))


TRANSFERS = """SELECT o_orderkey AS change_id, CAST(o_totalprice AS DECIMAL(20,2)) AS amount, CAST(year(o_orderdate) AS INT) AS from_year,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(year(o_orderdate) + 1 AS INT) END AS to_year FROM orders"""


@query(
    "transfer_pairs",
    f"""WITH t AS ({TRANSFERS}) SELECT change_id, from_year AS year, CAST(CASE WHEN to_year IS NULL THEN amount ELSE -amount END AS {D}) AS delta FROM t
    UNION ALL SELECT change_id, to_year, amount FROM t WHERE to_year IS NOT NULL""",
)
def transfer_pairs(spark, sf):
    return c.transfer_pair(bound(spark, sf, TRANSFERS))


@query(
    "explicit_zero",
    f"""SELECT 'update' AS kind, node_id, year, {SUM} AS amount, CAST(NULL AS STRING) AS note FROM target GROUP BY ALL
    UNION ALL SELECT 'zero', concat('C', c_custkey), 2024, CAST(0 AS {D}), c_mktsegment FROM customer WHERE c_acctbal < 0""",
)
def explicit_zero(spark, sf):
    zero = bound(spark, sf, f"SELECT 'zero' AS kind, concat('C', c_custkey) AS node_id, 2024 AS year, CAST(0 AS {D}) AS amount, c_mktsegment AS note FROM customer WHERE c_acctbal < 0")
    return c.expand_change_rows(sums(spark, sf, "target", "node_id", "year").withColumn("kind", F.lit("update")), zero)


ITEMS2 = "SELECT *, CASE WHEN item_id % 29 = 0 THEN NULL ELSE node_id END AS n2, CAST(amount - old_amount AS DECIMAL(20,2)) AS delta FROM items"


@query(
    "resolve",
    f"""WITH i AS ({ITEMS2}), q AS (SELECT item_id, CASE WHEN has_conflict THEN 'conflict' WHEN n2 IS NULL THEN 'no_node' WHEN delta = 0 THEN 'no_change' END AS reason FROM i)
    SELECT item_id, CASE WHEN reason = 'no_change' THEN 'excluded' WHEN reason IS NOT NULL THEN 'needs_clarification' ELSE 'resolved' END AS resolution, reason FROM q""",
)
def resolve(spark, sf):
    return c.resolve(bound(spark, sf, ITEMS2).drop("node_id").withColumnRenamed("n2", "node_id")).select("item_id", "resolution", "reason")


@query("pick_source_priority", "SELECT item_id, CASE WHEN has_conflict AND mode <> 'absolute' THEN 'rejected' ELSE status END AS status, has_conflict AND mode <> 'absolute' AS has_conflict FROM items")
def pick_source_priority(spark, sf):
    return c.pick_source_priority(rows(spark, sf, "items"), F.col("mode") == "absolute").select("item_id", "status", "has_conflict")


LINES3 = "SELECT concat('O', l_orderkey) AS node_id, CAST(year(l_shipdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_linenumber AS line_no, l_partkey * 100000 + l_suppkey AS line_id FROM lineitem"
NEW3 = "SELECT concat('O', o_orderkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS new_amount, o_orderkey AS order_id FROM orders WHERE o_orderkey % 4 = 0"


@query(
    "apply_amounts",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY node_id, year ORDER BY line_no, line_id) AS rn FROM ({LINES3})), n AS ({NEW3})
    SELECT node_id, year, source_type, line_no, CASE WHEN new_amount IS NOT NULL AND rn = 1 THEN new_amount ELSE amount END AS amount FROM l LEFT JOIN n USING (node_id, year, source_type)
    UNION ALL SELECT node_id, year, source_type, 1, new_amount FROM n WHERE new_amount IS NOT NULL AND (node_id, year) NOT IN (SELECT (node_id, year) FROM l)""",
)
def apply_amounts(spark, sf):
    return c.apply_amounts(bound(spark, sf, LINES3), bound(spark, sf, NEW3), ["order_id"])


@query("clone_version", "SELECT node_id AS source_node_id, concat('v2:', node_id) AS node_id, CASE WHEN parent_id IS NOT NULL THEN concat('v2:', parent_id) END AS parent_id FROM nodes")
def clone_version(spark, sf):
    return c.clone_version(rows(spark, sf, "nodes"), "v2")


@query("node_map_join", f"SELECT concat('v2:', node_id) AS node_id, year, source_type, {SUM} AS amount FROM current GROUP BY ALL")
def node_map_join(spark, sf):
    ids = c.clone_version(rows(spark, sf, "nodes"), "v2").select(F.col("source_node_id"), F.col("node_id").alias("new_id"))
    lines = aggregate_lines(rows(spark, sf, "current"))
    return lines.join(ids, lines.node_id == ids.source_node_id).select(F.col("new_id").alias("node_id"), "year", "source_type", "amount")


@query("new_object_lines", f"SELECT set_id, year, source_type, CAST(sum(amount) AS {D}) AS amount FROM items WHERE is_new GROUP BY ALL")
def new_object_lines(spark, sf):
    return c.new_object_lines(rows(spark, sf, "items").where("is_new").withColumnRenamed("amount", "new_amount"), "set_id")


PARENTS = """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('C', o_custkey) END AS anchor, CASE WHEN o_orderkey % 3 = 1 THEN concat('C', o_custkey) END AS parent_code,
  CASE WHEN o_orderkey % 7 <> 2 THEN concat('10', r, '0', n) END AS main_code, concat('N', n) AS main_node, o_custkey
  FROM orders JOIN (SELECT c_custkey, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey"""


@query(
    "resolve_parent",
    f"SELECT item_id, CASE WHEN anchor IS NOT NULL OR parent_code IS NOT NULL THEN concat('C', o_custkey) WHEN main_code IS NOT NULL THEN main_node END AS parent_id, CASE WHEN anchor IS NOT NULL THEN 1 WHEN parent_code IS NOT NULL THEN 2 WHEN main_code IS NOT NULL THEN 3 ELSE 0 END AS stage FROM ({PARENTS})",
)
def resolve_parent(spark, sf):
    return c.resolve_parent(bound(spark, sf, PARENTS), rows(spark, sf, "nodes"))


AFTER = f"CAST(CASE WHEN mode IN ('delta_plus', 'delta_minus') THEN old_amount + amount WHEN mode = 'zeroing' THEN 0 ELSE amount END AS {D})"
OPERATION = "CASE mode WHEN 'absolute' THEN 'set_absolute_amount' WHEN 'delta_minus' THEN 'subtract_delta' WHEN 'delta_plus' THEN 'add_delta' ELSE mode END"


@query("ledger", f"SELECT item_id, set_id, node_id, year, source_type, old_amount AS before, {OPERATION} AS operation, {AFTER} AS expected_after, CAST({AFTER} - old_amount AS {D}) AS delta, status FROM items")
def ledger(spark, sf):
    return c.ledger(rows(spark, sf, "items"))


@query(
    "ledger_summary",
    """SELECT set_id, count(*) AS entries, count(*) FILTER (status = 'rejected') AS rejected,
      concat_ws(',', CASE WHEN bool_or(mode = 'unknown') THEN 'unknown_operation' END, CASE WHEN bool_or(status = 'rejected') THEN 'rejected_entries' END) AS blocking FROM items GROUP BY 1""",
)
def ledger_summary(spark, sf):
    return c.ledger_summary(c.ledger(rows(spark, sf, "items")))


@query(
    "ledger_validate",
    f"""WITH a AS (SELECT node_id, year, source_type, {SUM} AS actual FROM target GROUP BY ALL)
    SELECT item_id, CASE WHEN actual IS NULL THEN 'missing' WHEN abs(actual - {AFTER}) > 10 THEN 'failed' ELSE 'applied' END AS check_status FROM items LEFT JOIN a USING (node_id, year, source_type)""",
)
def ledger_validate(spark, sf):
    return r.ledger_validate(c.ledger(rows(spark, sf, "items")).drop("status"), aggregate_lines(rows(spark, sf, "target"))).select("item_id", F.col("status").alias("check_status"))


@query(
    "change_summary",
    """SELECT set_id, count(*) AS n, count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected,
      count(*) FILTER (mode = 'zeroing' AND NOT is_new) AS zeroing, count(*) FILTER (is_new) AS new_object FROM items GROUP BY 1""",
)
def change_summary(spark, sf):
    items = rows(spark, sf, "items").withColumn("category", F.when(F.col("is_new"), "new_object").when(F.col("mode") == "zeroing", "zeroing").otherwise("other"))
    return c.change_summary(items)


@query("recalc_by_key", f"SELECT node_id, year, source_type, CAST(sum(old_amount) AS {D}) AS old_amount, CAST(sum(amount) AS {D}) AS new_amount, CAST(sum(amount - old_amount) AS {D}) AS delta FROM items GROUP BY ALL")
def recalc_by_key(spark, sf):
    return c.recalc_by_key(rows(spark, sf, "items").withColumnRenamed("amount", "new_amount"))


@query("duplicate_updates", "SELECT set_id, node_id, year, source_type, count(*) AS n FROM items WHERE status <> 'rejected' AND NOT excluded GROUP BY ALL HAVING count(*) > 1")
def duplicate_updates(spark, sf):
    return c.duplicate_updates(rows(spark, sf, "items").where("status <> 'rejected' and not excluded"))


GATE = """SELECT set_id, bool_and(amount <> 0) AS amounts_present, bool_or(status = 'confirmed') AS any_confirmed, bool_and(NOT ocr_applied) AS no_ocr, count(*) < 400 AS small_enough FROM items GROUP BY set_id"""


@query(
    "quality_gate",
    f"""WITH g AS ({GATE}) SELECT set_id, amounts_present AND any_confirmed AND no_ocr AND small_enough AS ready, "check",
      CASE "check" WHEN 'amounts_present' THEN amounts_present WHEN 'any_confirmed' THEN any_confirmed WHEN 'no_ocr' THEN no_ocr ELSE small_enough END AS passed
    FROM g, (SELECT unnest(['amounts_present', 'any_confirmed', 'no_ocr', 'small_enough']) AS "check")""",
)
def quality_gate(spark, sf):
    return c.quality_gate(bound(spark, sf, GATE), "set_id", ["amounts_present", "any_confirmed", "no_ocr", "small_enough"])


VERSIONS = "SELECT o_custkey AS program_id, o_orderkey AS version_number, o_orderstatus = 'F' AS approved FROM orders"


@query(
    "lifecycle",
    f"WITH v AS ({VERSIONS}) SELECT program_id, version_number, CASE WHEN NOT approved THEN 'draft' WHEN version_number = (SELECT max(version_number) FROM v w WHERE w.program_id = v.program_id AND approved) THEN 'current' ELSE 'archived' END AS status FROM v",
)
def lifecycle(spark, sf):
    return c.lifecycle(bound(spark, sf, VERSIONS)).drop("approved")


@query("next_version_number", "SELECT o_custkey AS program_id, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def next_version_number(spark, sf):
    return c.next_version_number(bound(spark, sf, VERSIONS))


KINDS = "SELECT o_custkey AS org_id, CASE WHEN o_orderkey % 4 = 0 THEN 'xlsx' WHEN o_orderkey % 5 = 0 THEN 'pdf' ELSE 'docx' END AS kind FROM orders"


@query(
    "source_mode",
    f"WITH k AS (SELECT org_id, bool_or(kind = 'xlsx') AS x, bool_or(kind = 'pdf') AS p FROM ({KINDS}) GROUP BY 1) SELECT org_id, CASE WHEN x AND p THEN 'target_with_evidence' WHEN x THEN 'target_only' WHEN p THEN 'patch_only' ELSE 'manual_only' END AS mode FROM k",
)
def source_mode(spark, sf):
    return c.source_mode(bound(spark, sf, KINDS))


SETS = """SELECT set_id, CAST(0 AS BIGINT) + count(CASE WHEN confidence < 0.005 THEN 1 END) AS unresolved, CAST(0 AS BIGINT) AS duplicates, CASE WHEN max(item_id) % 2 = 0 THEN 'ready' ELSE 'draft' END AS status, min(item_id) AS a, max(item_id) AS b FROM items GROUP BY set_id"""


@query("reuse_check", f"SELECT set_id, unresolved = 0 AND duplicates = 0 AND status = 'ready' AND (a % 3 <> 0) AS reusable FROM ({SETS})")
def reuse_check(spark, sf):
    sets = bound(spark, sf, SETS).withColumn("docs", F.array("a", "b")).withColumn("wanted_docs", F.when(F.col("a") % 3 != 0, F.array("b", "a")).otherwise(F.array("a")))
    return c.reuse_check(sets).select("set_id", "reusable")


@query(
    "assign_clarified",
    f"""SELECT item_id, coalesce(CASE WHEN item_id % 29 = 0 THEN NULL ELSE node_id END, CASE WHEN item_id % 58 = 0 THEN 'C1' END) AS node_id,
      CASE WHEN item_id % 58 = 0 THEN CAST(CASE WHEN mode = 'delta_plus' THEN old_amount + abs(amount) WHEN mode = 'delta_minus' THEN old_amount - abs(amount) WHEN mode = 'zeroing' THEN 0 ELSE amount END AS {D}) ELSE amount END AS new_amount FROM items""",
)
def assign_clarified(spark, sf):
    items = rows(spark, sf, "items").withColumn("node_id", F.when(F.col("item_id") % 29 != 0, F.col("node_id"))).withColumn("new_amount", F.col("amount"))
    choices = bound(spark, sf, "SELECT o_orderkey AS item_id, 'C1' AS node_id FROM orders WHERE o_orderkey % 58 = 0")
    return c.assign_clarified(items, choices).select("item_id", "node_id", F.col("new_amount").cast("decimal(20,2)").alias("new_amount"))


@query("confirm_items", "SELECT item_id, CASE WHEN item_id % 31 = 0 OR confidence >= 0.92 THEN 'confirmed' ELSE status END AS status FROM items")
def confirm_items(spark, sf):
    return c.confirm_items(rows(spark, sf, "items"), bound(spark, sf, "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 31 = 0"), F.col("confidence") >= 0.92).select("item_id", "status")


@query(
    "result_counts",
    "WITH d AS (SELECT l_suppkey AS parent_id, l_partkey AS object_id, max(CAST(year(l_shipdate) AS INT)) AS year FROM lineitem WHERE l_quantity > 1 GROUP BY 1, 2) SELECT parent_id, year, count(*) AS objects FROM d GROUP BY ALL",
)
def result_counts(spark, sf):
    return c.result_counts(bound(spark, sf, "SELECT l_suppkey AS parent_id, l_partkey AS object_id, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_quantity > 1 THEN l_quantity ELSE 0 END AS amount FROM lineitem"))


@query("tenant_defaults", "SELECT s_suppkey AS org_id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 10.0 END AS tolerance, CASE WHEN s_suppkey % 6 = 0 THEN 'strict' ELSE 'auto' END AS policy FROM supplier")
def tenant_defaults(spark, sf):
    settings = bound(spark, sf, "SELECT s_suppkey AS org_id, s_acctbal AS tolerance, CASE WHEN s_suppkey % 6 = 0 THEN 'strict' END AS policy FROM supplier WHERE s_suppkey % 3 = 0")
    return c.tenant_defaults(bound(spark, sf, "SELECT s_suppkey AS org_id FROM supplier"), settings, {"tolerance": 10.0, "policy": "auto"})
