"""Queries of policies, scopes, validation levels, passports, whole parsers, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import text as t
from ..operators import changes as c
from ..operators import grid as g
from ..operators import match as x
from ..operators import planning as q
from ..operators import reconcile as r
from ..operators import tree
from ..sources import io
from ..streaming import flows
from .grid_queries import PARAS, TREE, TREE_SQL
from .registry import bound, query, rows, scratch
from .tree_queries import CLOSURE_SQL

D = "DECIMAL(20,2)"
SUM = f"CAST(sum(amount) AS {D})"


# --- column functions


@query("source_codes", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'LOCAL_BUDGET' WHEN 2 THEN 'FEDERAL_BUDGET' WHEN 4 THEN 'REGIONAL_BUDGET' ELSE 'UNKNOWN' END AS source_type, CASE o_orderkey % 6 WHEN 0 THEN 'Средства местного бюджета' WHEN 2 THEN 'Средства федерального бюджета' WHEN 4 THEN 'Средства бюджета субъекта РФ' ELSE 'Источник не определен' END AS label FROM orders")
def source_codes(spark, sf):
    """Whole codes only."""
    df = bound(spark, sf, "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '900100' WHEN 1 THEN '900100123' WHEN 2 THEN ' 900203 ' WHEN 3 THEN concat('9002031', o_custkey) WHEN 4 THEN '900304' ELSE concat('900304.', o_custkey) END AS code FROM orders")
    key = t.normalize_source_cells(F.col("code"))
    return df.select("id", key.alias("source_type"), t.source_label(key).alias("label"))


@query("summary_targets", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'subprogram' WHEN 1 THEN 'main_activity' WHEN 2 THEN 'activity' END AS target FROM orders")
def summary_targets(spark, sf):
    """T10."""
    df = bound(spark, sf, "SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'Итого по подпрограмме ' WHEN 1 THEN 'Итого по основному мероприятию ' WHEN 2 THEN 'Итого по мероприятию ' ELSE 'Школа ' END, o_custkey) AS label FROM orders")
    return df.select("id", t.summary_target_type(F.col("label")).alias("target"))


@query("parse_funding_key", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate) END AS INT) AS year, CASE WHEN o_orderkey % 3 < 2 THEN 'LOCAL_BUDGET' END AS source_type FROM orders")
def parse_funding_key(spark, sf):
    """Both spellings, and keys that are none."""
    df = bound(spark, sf, "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat(year(o_orderdate), '::LOCAL_BUDGET') WHEN 1 THEN concat('[', year(o_orderdate), ', \"LOCAL_BUDGET\"]') ELSE '::' END AS key FROM orders")
    k = t.parse_funding_key(F.col("key"))
    return df.select("id", k["year"].alias("year"), k["source_type"].alias("source_type"))


@query("normalize_mode", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'xlsx_target' WHEN 1 THEN 'pdf_patch' WHEN 2 THEN 'manual_instruction' WHEN 3 THEN 'xlsx_target_with_pdf_evidence' WHEN 4 THEN 'auto' END AS mode, CASE o_orderstatus WHEN 'F' THEN 'Подтверждено' WHEN 'O' THEN 'Предложено' ELSE 'Отклонено' END AS label FROM orders")
def normalize_mode(spark, sf):
    """T21."""
    df = bound(spark, sf, "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN ' excel ' WHEN 1 THEN 'pdf_agreement' WHEN 2 THEN 'chat_instruction' WHEN 3 THEN 'excel_target_with_pdf_evidence' WHEN 4 THEN 'auto' ELSE concat('x', o_custkey) END AS name, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status FROM orders")
    return df.select("id", t.normalize_mode(F.col("name")).alias("mode"), t.status_label(F.col("status")).alias("label"))


@query("canonical_label", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat('Мероприятие ', p_size, '.') END AS label FROM part")
def canonical_label(spark, sf):
    """T31."""
    df = bound(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_name, ' ') ELSE '  ' END AS name, CAST(p_size AS STRING) AS code FROM part")
    return df.select("id", t.canonical_label(F.col("name"), F.col("code")).alias("label"))


@query("topic_label", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'Правила' WHEN 'click' THEN 'Таблица' ELSE event_type END AS label FROM events")
def topic_label(spark, sf):
    """T33."""
    df = bound(spark, sf, "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'rules' WHEN 'click' THEN 'table' ELSE event_type END AS kind FROM events")
    return df.select("id", t.topic_label(F.col("kind")).alias("label"))


@query(
    "token_overlap",
    "SELECT p_partkey AS id, CAST(len(list_filter(string_split(p_name, ' '), lambda v: len(list_filter(string_split(lower(p_type), ' '), lambda w: starts_with(v, w) OR starts_with(w, v))) > 0)) AS INT) AS n FROM part",
)
def token_overlap(spark, sf):
    """J3."""
    df = bound(spark, sf, "SELECT p_partkey AS id, p_name, lower(p_type) AS p_type FROM part")
    return df.select("id", a.token_overlap_any(F.split("p_name", " "), F.split("p_type", " ")).alias("n"))


@query(
    "intent_decisions",
    "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'validate_control_sums' WHEN 1 THEN 'explain_change' WHEN 2 THEN 'generate_docx' WHEN 3 THEN 'show_pending' WHEN 4 THEN 'run_analysis' ELSE 'unknown' END AS intent, CAST(CASE o_orderkey % 6 WHEN 0 THEN 2020 + o_orderkey % 9 END AS INT) AS year, CASE o_orderkey % 6 WHEN 1 THEN concat('школа ', o_custkey) END AS object_query, CAST(CASE o_orderkey % 6 WHEN 5 THEN 0.3 ELSE 0.9 END AS DOUBLE) AS confidence FROM orders",
)
def intent_decisions(spark, sf):
    """T29 with its arguments."""
    df = bound(
        spark, sf,
        "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('Почему не сходится ', 2020 + o_orderkey % 9, ' год?') WHEN 1 THEN concat('Объясни изменения по объекту Школа ', o_custkey, '?') WHEN 2 THEN 'Выгрузи новую редакцию' WHEN 3 THEN 'Покажи ручную проверку' WHEN 4 THEN 'Пересчитай программу' ELSE concat('Поставь сумму ', o_custkey, ' рублей без проверки') END AS command FROM orders",
    )
    d = t.intent_decision(F.col("command"))
    return df.select("id", *(d[k].alias(k) for k in ("intent", "year", "object_query", "confidence")))


# --- trees, change sets, versions


@query(
    "rollup_excluded",
    f"""WITH RECURSIVE {CLOSURE_SQL}, leaves AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL AND (node_id NOT LIKE 'C%' OR CAST(substr(node_id, 2) AS BIGINT) % 3 <> 0)) AND (node_id NOT LIKE 'C%' OR CAST(substr(node_id, 2) AS BIGINT) % 3 <> 0)),
    cut AS (SELECT node_id, min(depth) AS cut FROM closure WHERE ancestor_id LIKE 'C%' AND CAST(substr(ancestor_id, 2) AS BIGINT) % 3 = 0 GROUP BY 1)
    SELECT ancestor_id AS node_id, year, source_type, {SUM} AS amount FROM own_lines JOIN leaves USING (node_id) JOIN closure USING (node_id) LEFT JOIN cut USING (node_id) WHERE cut IS NULL OR depth < cut GROUP BY ALL""",
)
def rollup_excluded(spark, sf):
    """G6 with inner nodes that nothing passes through; leaves below them keep their own totals."""
    excluded = F.col("node_id").like("C%") & (F.expr("try_cast(substring(node_id, 2) as bigint)") % 3 == 0)
    return tree.rollup_replace(rows(spark, sf, "nodes"), rows(spark, sf, "own_lines"), excluded)


ONE_LINE = f"SELECT node_id, year, source_type, {SUM} AS amount, 1 AS line_no, 1 AS line_id FROM current GROUP BY node_id, year, source_type"
REPEATED = "SELECT concat('C', o_custkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(o_totalprice AS DECIMAL(20,2)) AS new_amount, o_orderkey AS seq FROM orders WHERE o_custkey % 2 = 0"


@query("apply_repeated", f"WITH l AS ({ONE_LINE}), n AS (SELECT node_id, year, source_type, arg_max(new_amount, seq) AS new_amount FROM ({REPEATED}) GROUP BY ALL) SELECT node_id, year, source_type, line_no, coalesce(new_amount, amount) AS amount FROM l LEFT JOIN n USING (node_id, year, source_type)")
def apply_repeated(spark, sf):
    """P10: of a key's several items the last counts, and a line stays one line."""
    return c.apply_amounts(bound(spark, sf, ONE_LINE), bound(spark, sf, REPEATED), ["seq"])


@query(
    "closed_root",
    f"""WITH a AS (SELECT year, source_type, {SUM} AS x FROM current GROUP BY ALL), e AS (SELECT year, source_type, {SUM} AS y FROM target GROUP BY ALL)
    SELECT year, source_type, CAST(CASE WHEN abs(coalesce(y, 0) - coalesce(x, 0)) > 10 THEN coalesce(y, 0) ELSE x END AS {D}) AS amount FROM a FULL JOIN e USING (year, source_type)""",
)
def closed_root(spark, sf):
    """P16's second roll-up."""
    side = lambda n: rows(spark, sf, n).groupBy(*tree.KEY).agg(tree.total().alias("amount"))
    return tree.closed_root(side("current"), side("target"))


MARKS = "SELECT concat('S', c_custkey) AS node_id, CASE WHEN c_custkey % 2 = 0 THEN concat('C', c_custkey) END AS refers_to, c_custkey FROM customer"


@query(
    "refresh_summaries_local",
    f"""WITH m AS ({MARKS}), s AS (SELECT node_id, year, source_type, {SUM} AS amount FROM current GROUP BY ALL), g AS (SELECT m.node_id, year, source_type, amount FROM m JOIN s ON s.node_id = refers_to)
    SELECT * FROM g UNION ALL SELECT node_id, 2000, 'LOCAL_BUDGET', CAST(c_custkey AS {D}) FROM m WHERE node_id NOT IN (SELECT node_id FROM g)""",
)
def refresh_summaries_local(spark, sf):
    """P13 with the sums of the rows above, for summaries that refer to nothing."""
    marks = bound(spark, sf, MARKS)
    local = marks.select("node_id", F.lit(2000).alias("year"), F.lit("LOCAL_BUDGET").alias("source_type"), F.col("c_custkey").cast("decimal(20,2)").alias("amount"))
    return tree.refresh_summaries(marks.select("node_id", "refers_to"), tree.aggregate_lines(rows(spark, sf, "current")), local)


POLICY_ITEMS = "SELECT item_id, set_id, CASE WHEN item_id % 29 = 0 THEN NULL ELSE node_id END AS node_id, year, source_type, CASE WHEN item_id % 6 = 0 THEN CAST(0 AS DECIMAL(20,2)) ELSE amount END AS delta, CASE WHEN item_id % 2 = 0 THEN 'xlsx_finance' ELSE 'pdf_agreement' END AS doc_type, has_conflict OR item_id % 5 = 0 AS has_conflict FROM items"
UPLOADS = "SELECT concat('set', event_id % 50) AS set_id, CASE WHEN event_type = 'click' THEN 'xlsx_finance' ELSE 'pdf_agreement' END AS doc_type, ts AS uploaded_at, event_id AS doc_id FROM events"
POLICY = "CASE WHEN set_id IN ('set1', 'set2', 'set3', 'set4', 'set5') THEN 'pdf_over_xlsx' WHEN set_id LIKE 'set2%' THEN 'latest_uploaded' ELSE 'xlsx_over_pdf' END"


@query(
    "resolve_policy",
    f"""WITH u AS (SELECT set_id, arg_max(doc_type, (uploaded_at, doc_id)) AS newest FROM ({UPLOADS}) GROUP BY 1), i AS (SELECT *, {POLICY} AS policy FROM ({POLICY_ITEMS}) LEFT JOIN u USING (set_id)),
    w AS (SELECT *, CASE policy WHEN 'pdf_over_xlsx' THEN 'pdf_agreement' WHEN 'latest_uploaded' THEN newest ELSE 'xlsx_finance' END AS winner FROM i),
    k AS (SELECT *, has_conflict AND coalesce(bool_or(doc_type = winner) OVER (PARTITION BY set_id, node_id, year, source_type), false) AS settled FROM w),
    o AS (SELECT item_id, CASE WHEN settled AND NOT coalesce(doc_type = winner, false) THEN 'source_priority' WHEN has_conflict AND NOT settled THEN 'conflict' WHEN node_id IS NULL THEN 'no_node' WHEN delta = 0 THEN 'no_change' END AS reason FROM k)
    SELECT item_id, reason, CASE WHEN reason IN ('source_priority', 'no_change') THEN 'excluded' WHEN reason IS NOT NULL THEN 'needs_clarification' ELSE 'resolved' END AS resolution FROM o""",
)
def resolve_policy(spark, sf):
    """P8 with its three policies."""
    policy = F.when(F.col("set_id").isin("set1", "set2", "set3", "set4", "set5"), "pdf_over_xlsx").when(F.col("set_id").like("set2%"), "latest_uploaded").otherwise("xlsx_over_pdf")
    return c.resolve_policy(bound(spark, sf, POLICY_ITEMS), policy, bound(spark, sf, UPLOADS)).select("item_id", "reason", "resolution")


ORGS = "SELECT c_custkey AS org_id, CASE c_custkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'excel' WHEN 2 THEN 'nothing' END AS requested, CASE c_custkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'auto' END AS configured, c_custkey % 7 = 0 AS plain_user FROM customer"
DOCS = "SELECT o_custkey AS org_id, o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'pdf' ELSE 'docx' END AS kind, o_orderdate AS uploaded_at FROM orders"


@query(
    "source_policy",
    f"""WITH h AS (SELECT org_id, arg_max(doc_id, (uploaded_at, doc_id)) FILTER (kind = 'xlsx') AS sheet, string_agg(CAST(doc_id AS STRING), ',' ORDER BY doc_id) FILTER (kind = 'pdf') AS pdfs FROM ({DOCS}) GROUP BY 1),
    o AS (SELECT org_id, CASE requested WHEN 'auto' THEN 'auto' WHEN 'excel' THEN 'xlsx_target' END AS asked, CASE WHEN NOT plain_user THEN CASE configured WHEN 'pdf' THEN 'pdf_patch' WHEN 'auto' THEN 'auto' END END AS own,
      sheet, pdfs, CASE WHEN sheet IS NOT NULL AND pdfs IS NOT NULL THEN 'xlsx_target_with_pdf_evidence' WHEN sheet IS NOT NULL THEN 'xlsx_target' WHEN pdfs IS NOT NULL THEN 'pdf_patch' END AS inferred FROM ({ORGS}) LEFT JOIN h USING (org_id)),
    m AS (SELECT *, CASE WHEN coalesce(asked = 'auto', own = 'auto', false) THEN coalesce(inferred, 'auto') ELSE coalesce(asked, own, inferred, 'auto') END AS mode FROM o)
    SELECT org_id, mode, CASE WHEN mode LIKE 'xlsx%' THEN coalesce(CAST(sheet AS STRING), '') WHEN mode = 'pdf_patch' THEN coalesce(pdfs, '') ELSE '' END AS calculation, CASE WHEN mode = 'xlsx_target_with_pdf_evidence' THEN coalesce(pdfs, '') ELSE '' END AS evidence,
      CASE WHEN mode LIKE 'xlsx%' THEN 'target_model' ELSE 'ignored' END AS xlsx_role, CASE mode WHEN 'xlsx_target_with_pdf_evidence' THEN 'evidence' WHEN 'pdf_patch' THEN 'change_source' ELSE 'ignored' END AS pdf_role,
      CASE WHEN mode = 'xlsx_target_with_pdf_evidence' THEN 'pdf_evidence_only' ELSE 'single_calculation_source' END AS double_count_guard FROM m""",
)
def source_policy(spark, sf):
    """P6 with requested and configured modes, roles and the guard."""
    out = c.source_policy(bound(spark, sf, ORGS), bound(spark, sf, DOCS))
    show = lambda k: F.array_join(F.col(k).cast("array<string>"), ",")
    return out.withColumns({"calculation": show("calculation_docs"), "evidence": show("evidence_docs")}).drop("calculation_docs", "evidence_docs")


STATES = "SELECT o_custkey AS program_id, o_orderkey AS version_number, o_orderstatus = 'F' AS approved FROM orders"


@query(
    "version_actions",
    f"""WITH v AS (SELECT *, max(version_number) FILTER (approved) OVER (PARTITION BY program_id) AS newest FROM ({STATES})), s AS (SELECT program_id, version_number, CASE WHEN NOT approved THEN 'draft' WHEN version_number = newest THEN 'current' ELSE 'archived' END AS status FROM v),
    j AS (SELECT program_id, version_number, CASE WHEN status = 'draft' AND version_number % 3 = 0 THEN 'rejected' ELSE status END AS status FROM s),
    b AS (SELECT program_id, max(version_number) AS back FROM j WHERE status = 'archived' AND version_number % 4 = 0 GROUP BY 1)
    SELECT program_id, version_number, CASE WHEN version_number = back THEN 'current' WHEN back IS NOT NULL AND status = 'current' THEN 'archived' ELSE status END AS status FROM j LEFT JOIN b USING (program_id)""",
)
def version_actions(spark, sf):
    """Rejection of drafts, then restoration."""
    v = c.lifecycle(bound(spark, sf, STATES)).drop("approved")
    rejected = c.reject_drafts(v, v.where("version_number % 3 = 0"))
    return c.restore_versions(rejected, v.where("version_number % 4 = 0")).select("program_id", "version_number", "status")


@query(
    "confirm_expected",
    """WITH m AS (SELECT item_id, set_id, status, item_id % 31 = 0 OR confidence >= 0.92 AS chosen FROM items), n AS (SELECT set_id, count(*) FILTER (chosen) AS n, CASE WHEN set_id LIKE '%3' THEN count(*) FILTER (chosen) + 1 ELSE count(*) FILTER (chosen) END AS expected FROM m GROUP BY 1)
    SELECT item_id, CASE WHEN chosen AND n = expected THEN 'confirmed' ELSE status END AS status FROM m JOIN n USING (set_id)""",
)
def confirm_expected(spark, sf):
    """P32 with the count that the user saw."""
    items, chosen = rows(spark, sf, "items"), bound(spark, sf, "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 31 = 0")
    safe = F.col("confidence") >= 0.92
    hit = safe | (F.col("item_id") % 31 == 0)
    expected = items.groupBy("set_id").agg(F.count_if(hit).alias("n")).select("set_id", (F.col("n") + F.col("set_id").like("%3").cast("int")).alias("expected"))
    return c.confirm_items(items, chosen, safe, expected).select("item_id", "status")


@query("auto_pipeline_stop", "WITH i AS (SELECT item_id, node_id AS set_id, has_conflict, amount, CASE WHEN has_conflict THEN 1 ELSE 0 END AS open FROM items) SELECT item_id FROM i WHERE amount <> 0 AND set_id NOT IN (SELECT set_id FROM i WHERE open = 1)")
def auto_pipeline_stop(spark, sf):
    """Sets with an item that needs clarification stop."""
    return c.without_open_sets(c.resolve(rows(spark, sf, "items").withColumn("set_id", F.col("node_id")).withColumnRenamed("amount", "delta"))).select("item_id")


TAILS = """SELECT o_orderkey AS item_id, CAST(NULL AS STRING) AS anchor, CASE WHEN o_orderkey % 2 = 0 THEN concat('10', (r + o_orderkey) % 9, '0', n) END AS parent_code, CAST(NULL AS STRING) AS main_code
  FROM orders JOIN (SELECT c_custkey, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey"""


@query(
    "resolve_parent_shifted",
    f"""WITH i AS ({TAILS}), k AS (SELECT node_id, code, node_type, substr(code, 4) AS tail FROM nodes WHERE node_type <> 'object'), u AS (SELECT tail, min(node_id) AS node_id FROM k WHERE tail <> '' GROUP BY 1 HAVING count(*) = 1)
    SELECT item_id, coalesce((SELECT min(k.node_id) FROM k WHERE k.code = i.parent_code), u.node_id) AS parent_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.code = i.parent_code) THEN 2 WHEN u.node_id IS NOT NULL THEN 4 ELSE 0 END AS stage FROM i LEFT JOIN u ON u.tail = substr(i.parent_code, 4)""",
)
def resolve_parent_shifted(spark, sf):
    """Codes whose subprogram digit is another's."""
    return c.resolve_parent(bound(spark, sf, TAILS), rows(spark, sf, "nodes"))


@query(
    "code_scope",
    """WITH n AS (SELECT concat('N', n_nationkey) AS node_id, concat(n_regionkey, lpad(CAST(n_nationkey AS STRING), 2, '0')) AS code FROM nation), g AS (SELECT concat('G', c_custkey) AS group_key, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat((c_custkey % 6), lpad(CAST(c_nationkey AS STRING), 2, '0')) END AS parent_code FROM customer)
    SELECT group_key, CASE WHEN parent_code IS NULL THEN 'ALL' ELSE coalesce(o.node_id, s.node_id) END AS scope, CASE WHEN parent_code IS NULL THEN 'all' WHEN o.node_id IS NOT NULL THEN 'code' WHEN s.node_id IS NOT NULL THEN 'shifted' ELSE 'none' END AS how
    FROM g LEFT JOIN n o ON o.code = parent_code LEFT JOIN n s ON substr(s.code, 2) = substr(parent_code, 2)""",
)
def code_scope(spark, sf):
    """D7's scopes by code."""
    nodes = bound(spark, sf, "SELECT concat('N', n_nationkey) AS node_id, concat(n_regionkey, lpad(CAST(n_nationkey AS STRING), 2, '0')) AS code FROM nation")
    groups = bound(spark, sf, "SELECT concat('G', c_custkey) AS group_key, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat((c_custkey % 6), lpad(CAST(c_nationkey AS STRING), 2, '0')) END AS parent_code FROM customer")
    return x.code_scope(groups, nodes)


# --- validation and reports

PASSPORT = "SELECT year, source_type, CAST(sum(amount) + CASE WHEN year % 2 = 0 THEN 100 ELSE 0 END AS DECIMAL(20,2)) AS amount FROM current WHERE year <> 1995 GROUP BY year, source_type"
KINDS = "SELECT concat('C', c_custkey) AS node_id, c_custkey % 5 = 0 AS summary FROM customer"


def _level(name, keys, have, missing, code, want="current", extra=""):
    on = ", ".join(keys)
    key = ", '::', ".join(f"CAST({k} AS STRING)" for k in keys)
    return f"""SELECT '{name}' AS level, concat({key}) AS key, expected, actual, CAST(actual - expected AS {D}) AS delta, CASE WHEN actual IS NULL THEN {missing} WHEN abs(actual - expected) > 10 THEN '{code}' END AS code
      FROM (SELECT {on}, {SUM} AS expected FROM {want} {extra} GROUP BY ALL) LEFT JOIN (SELECT {on}, {SUM} AS actual FROM {have} GROUP BY ALL) USING ({on})"""


@query(
    "validate_levels",
    f"""WITH k AS ({KINDS}), p AS ({PASSPORT}), obs AS (SELECT * FROM target), agg AS (SELECT node_id, year, CASE WHEN summary THEN source_type ELSE 'TOTAL' END AS source_type, amount FROM current JOIN k USING (node_id)), agg2 AS (SELECT node_id, year, CASE WHEN summary THEN source_type ELSE 'TOTAL' END AS source_type, amount FROM target JOIN k USING (node_id))
    {_level("passport_year", ["year"], "p", "'passport_total_missing'", "passport_total_mismatch")} UNION ALL {_level("passport_source", ["year", "source_type"], "p", "NULL", "passport_source_mismatch")}
    UNION ALL {_level("object", ["node_id", "year", "source_type"], "obs", "NULL", "object_funding_mismatch", extra="WHERE node_id IN (SELECT node_id FROM k WHERE NOT summary)")}
    UNION ALL {_level("aggregate", ["node_id", "year", "source_type"], "agg2", "NULL", "aggregate_funding_mismatch", want="agg")}""",
)
def validate_levels(spark, sf):
    """P20 on its four levels."""
    return r.validate_levels(rows(spark, sf, "current"), bound(spark, sf, PASSPORT), bound(spark, sf, KINDS), rows(spark, sf, "target"), F.col("summary"))


ORG_ITEMS = "SELECT concat('org', item_id % 40) AS org_id, status, has_conflict FROM items"
ORG_VERSIONS = "SELECT concat('org', o_custkey % 45) AS org_id, o_orderstatus AS status, o_orderdate AS created_at, o_orderkey AS version_id FROM orders"


@query(
    "organization_context",
    f"""WITH i AS (SELECT org_id, count(*) FILTER (status = 'proposed') AS pending, count(*) FILTER (has_conflict) AS conflicts FROM ({ORG_ITEMS}) GROUP BY 1), v AS (SELECT org_id, arg_max(status, (created_at, version_id)) AS latest_status, count(*) AS versions FROM ({ORG_VERSIONS}) GROUP BY 1)
    SELECT org_id, coalesce(pending, 0) AS pending, coalesce(conflicts, 0) AS conflicts, coalesce(versions, 0) AS versions, latest_status FROM i FULL JOIN v USING (org_id)""",
)
def organization_context(spark, sf):
    """G23."""
    return q.organization_context(bound(spark, sf, ORG_ITEMS), bound(spark, sf, ORG_VERSIONS))


SESSIONS = "SELECT set_id AS session_id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE node_id END AS node_id, CASE WHEN item_id % 9 = 0 THEN NULL ELSE amount END AS amount, confidence FROM items"


@query("analysis_diagnostics", f"SELECT session_id, count(*) AS items, count(*) - count(node_id) AS without_node, count(*) - count(amount) AS without_amount, count(*) FILTER (confidence < 0.92) AS unsure, round(count(node_id) * 100.0 / count(*), 2) AS percent FROM ({SESSIONS}) GROUP BY 1")
def analysis_diagnostics(spark, sf):
    """G28."""
    return q.analysis_diagnostics(bound(spark, sf, SESSIONS)).withColumn("percent", F.col("percent").cast("double"))


@query(
    "chunk_fallback",
    "WITH p AS (SELECT doc_id % 100 AS doc_id, doc_id AS page_number, lower(text) LIKE '%scum%' AS hit FROM documents), d AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM p GROUP BY 1), r AS (SELECT doc_id, n, page_number, hit, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM p JOIN d USING (doc_id) WHERE hit OR n = 0) SELECT doc_id, CASE WHEN n = 0 THEN 'general' ELSE 'insult' END AS topic, n AS matched, string_agg(CAST(page_number AS STRING), ',' ORDER BY page_number) AS first_pages FROM r WHERE rn <= 3 GROUP BY ALL".replace("row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM p JOIN d USING (doc_id) WHERE hit OR n = 0", "row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM (SELECT p.*, n FROM p JOIN d USING (doc_id)) WHERE hit OR n = 0"),
)
def chunk_fallback(spark, sf):
    """Documents without a topic have their first pages."""
    pages = bound(spark, sf, "SELECT doc_id % 100 AS doc_id, doc_id AS page_number, text FROM documents")
    return q.chunk_pages(pages, {"insult": ["scum"]}, fallback="general").drop("text")


# --- grids and parsers: an order is a document

PASSPORT_CELLS = f"""SELECT o_orderkey AS doc_id, 1 AS table_idx, CAST(h.r AS INT) AS row_idx, CAST(h.c AS INT) AS col_idx, h.t AS text FROM orders,
    (SELECT 0 AS r, 0 AS c, 'Паспорт' AS t UNION ALL SELECT 1, 0, 'Источники финансирования' UNION ALL SELECT 1, 1, 'Всего' UNION ALL SELECT 1, 2, '2026' UNION ALL SELECT 1, 3, '2027 год' UNION ALL SELECT 1, 4, '2026'
     UNION ALL SELECT 2, 0, 'Средства федерального бюджета' UNION ALL SELECT 3, 0, 'Примечание' UNION ALL SELECT 4, 0, 'Средства местного бюджета' UNION ALL SELECT 5, 0, 'Всего, в том числе') h
  UNION ALL SELECT o_orderkey, 1, CAST(v.r AS INT), CAST(v.c AS INT), CAST(CAST(o_custkey * v.r + v.c AS {D}) AS STRING) FROM orders, (SELECT k.r, j.c FROM (SELECT 2 AS r UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k, (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) j) v
  UNION ALL SELECT o_orderkey, 2, CAST(0 AS INT), CAST(0 AS INT), 'Финансирование мероприятий' FROM orders
  UNION ALL SELECT o_orderkey, 2, CAST(1 AS INT), CAST(0 AS INT), 'Источник' FROM orders UNION ALL SELECT o_orderkey, 2, CAST(1 AS INT), CAST(1 AS INT), '2026' FROM orders"""


PASSPORT_SQL = f"""SELECT o_orderkey AS doc_id, CASE WHEN r = 5 AND c = 1 THEN 'grand_total' WHEN r = 5 THEN 'year_total' WHEN c = 1 THEN 'source_total' ELSE 'source' END AS kind, CAST(CASE c WHEN 2 THEN 2026 WHEN 3 THEN 2027 END AS INT) AS year, CASE r WHEN 2 THEN 'FEDERAL_BUDGET' WHEN 4 THEN 'LOCAL_BUDGET' END AS source_type,
      CAST(1 AS INT) AS table_idx, CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col_idx, CAST((o_custkey * r + c) * 1000 AS {D}) AS amount FROM orders, (SELECT unnest([2, 4, 5]) AS r), (SELECT unnest([1, 2, 3]) AS c)"""


@query("passport_amounts", PASSPORT_SQL)
def passport_amounts(spark, sf):
    """C10."""
    return g.passport_amounts(bound(spark, sf, PASSPORT_CELLS))


@query("base_year_files", "SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2030 ELSE 2020 + o_orderkey % 7 END AS INT) AS base_year FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0")
def base_year_files(spark, sf):
    """Cells first, then the file's name."""
    cells = bound(spark, sf, "SELECT o_orderkey AS doc_id, 0 AS row_idx, 0 AS col_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'План на 2030 год' ELSE 'План' END AS text FROM orders")
    files = bound(spark, sf, "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'plan.xlsx' ELSE concat('plan_', 2020 + o_orderkey % 7, '_v', 12000 + o_orderkey, '.xlsx') END AS file_name FROM orders")
    return g.base_year(cells, files)


CHANGE_PAGES = """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page_number, CASE o_orderkey % 6
    WHEN 0 THEN concat('По объекту «Школа ', o_custkey, '» на 2028 год средства бюджета Московской области увеличить с ', o_custkey, ',18 тыс. рублей до ', o_custkey + 90, ',18 тыс. рублей.')
    WHEN 1 THEN concat('Общие слова. По объекту «Школа ', o_custkey, '» на 2028 год увеличить на 10 000 ', 100 + o_orderkey % 900, ' рублей средства федерального бюджета.')
    WHEN 2 THEN concat('По объекту «Школа ', o_custkey, '» на 2027 год уменьшить на ', o_custkey, ' рублей средства местного бюджета.')
    WHEN 3 THEN concat('По объекту «Школа ', o_custkey, '» перенести 7 000 000 рублей с 2026 года на 2027 год.')
    WHEN 4 THEN concat('По объекту «Школа ', o_custkey, '» на 2028 год исключить финансирование из средств местного бюджета.')
    ELSE concat('Слова без чисел ', o_orderpriority) END AS text FROM orders"""


@query(
    "change_fields",
    f"""SELECT o_orderkey AS doc_id, concat('Школа ', o_custkey) AS object_name, CASE o_orderkey % 6 WHEN 0 THEN 'absolute' WHEN 1 THEN 'delta_plus' WHEN 2 THEN 'delta_minus' WHEN 3 THEN 'transfer' ELSE 'zeroing' END AS mode,
      CAST(CASE o_orderkey % 6 WHEN 2 THEN 2027 WHEN 3 THEN 2026 ELSE 2028 END AS INT) AS year, CASE o_orderkey % 6 WHEN 0 THEN 'REGIONAL_BUDGET' WHEN 1 THEN 'FEDERAL_BUDGET' WHEN 3 THEN 'UNKNOWN' ELSE 'LOCAL_BUDGET' END AS source_type,
      CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000 + 180 END AS {D}) AS old_amount, CAST(CASE o_orderkey % 6 WHEN 0 THEN (o_custkey + 90) * 1000 + 180 WHEN 4 THEN 0 END AS {D}) AS new_amount,
      CAST(CASE o_orderkey % 6 WHEN 0 THEN 90000 WHEN 1 THEN 10000000 + 100 + o_orderkey % 900 WHEN 2 THEN -o_custkey WHEN 3 THEN 7000000 END AS {D}) AS delta, CAST(CASE o_orderkey % 6 WHEN 3 THEN 2026 END AS INT) AS from_year, CAST(CASE o_orderkey % 6 WHEN 3 THEN 2027 END AS INT) AS to_year
    FROM orders WHERE o_orderkey % 6 <> 5""",
)
def change_fields(spark, sf):
    """C20 with amounts and sources."""
    return g.change_fields(g.change_windows(bound(spark, sf, CHANGE_PAGES))).drop("page_number", "position", "confidence", "evidence")


PLACED = f"SELECT l_orderkey AS doc_id, CAST(l_linenumber * 5 AS DOUBLE) AS y, CAST(v.x AS DOUBLE) AS x, CAST(l_linenumber % 2 AS INT) AS col, CAST(2026 + l_linenumber % 2 AS INT) AS year, 'LOCAL_BUDGET' AS source_type, v.t AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), (SELECT 0 AS x, '1' AS t UNION ALL SELECT 1, '2' UNION ALL SELECT 2, ',5') v"
CONTROLS = f"SELECT l_orderkey AS doc_id, CAST(2026 + l_linenumber % 2 AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(count(DISTINCT l_linenumber) * 12.5 + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS {D}) AS amount FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey, l_linenumber % 2"


@query(
    "build_patch_checked",
    f"""SELECT l_orderkey AS doc_id, CAST(2026 + l_linenumber % 2 AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(count(DISTINCT l_linenumber) * 12.5 AS {D}) AS detail, CAST(CASE WHEN l_orderkey % 3 <> 0 THEN count(DISTINCT l_linenumber) * 12.5 + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS {D}) AS control,
      CASE WHEN l_orderkey % 3 = 0 THEN 'not_applicable' WHEN l_orderkey % 5 = 0 THEN 'failed' ELSE 'passed' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber % 2""",
)
def build_patch_checked(spark, sf):
    """P3's control sums of positioned amounts."""
    return g.build_patch_checked(bound(spark, sf, CHANGE_PAGES), bound(spark, sf, PLACED), bound(spark, sf, CONTROLS))[1]


@query("build_patch_changes", "SELECT o_orderkey AS doc_id, concat('Школа ', o_custkey) AS object_name, CASE o_orderkey % 6 WHEN 0 THEN 'absolute' WHEN 1 THEN 'delta_plus' WHEN 2 THEN 'delta_minus' WHEN 3 THEN 'transfer' ELSE 'zeroing' END AS mode FROM orders WHERE o_orderkey % 6 <> 5")
def build_patch_changes(spark, sf):
    """P3's changes, once each, though every page comes twice."""
    pages = bound(spark, sf, CHANGE_PAGES)
    return g.build_patch_checked(pages.unionByName(pages.withColumn("page_number", F.lit(2))), bound(spark, sf, PLACED), bound(spark, sf, CONTROLS))[0].select("doc_id", "object_name", "mode")


SHEET = f"""SELECT o_orderkey AS doc_id, CAST(h.r AS INT) AS row_idx, CAST(h.c AS INT) AS col_idx, h.t AS text FROM orders,
    (SELECT 0 AS r, 0 AS c, 'Наименование' AS t UNION ALL SELECT 0, 1, 'Код объекта' UNION ALL SELECT 0, 2, 'Источник' UNION ALL SELECT 0, 3, '2026 год всего' UNION ALL SELECT 1, 0, '1' UNION ALL SELECT 1, 1, '2') h
  UNION ALL SELECT l_orderkey, CAST(10 + l_linenumber AS INT), CAST(v.c AS INT), CASE v.c WHEN 0 THEN CASE WHEN l_linenumber = 7 THEN 'Итого' ELSE concat('Школа ', p % 3) END WHEN 1 THEN CASE WHEN l_linenumber = 7 THEN '' ELSE concat('K', p % 3) END WHEN 2 THEN '900203' ELSE CASE WHEN p % 3 = 0 THEN '0' ELSE CAST(amount AS STRING) END END
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CAST(min(l_extendedprice) AS {D}) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber), (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v"""
ROLES = "SELECT o_orderkey AS doc_id, CAST(v.c AS INT) AS col_idx, v.role FROM orders, (SELECT 0 AS c, 'name' AS role UNION ALL SELECT 1, 'object_code' UNION ALL SELECT 2, 'source') v"
SHEET_ROWS = f"l AS (SELECT l_orderkey AS doc_id, l_linenumber, min(l_partkey) % 3 AS k, CAST(min(l_extendedprice) AS {D}) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING l_linenumber <> 7)"


@query("build_groups", f"WITH {SHEET_ROWS} SELECT doc_id, concat('object::::K', k) AS group_key, 'OBJECT' AS status, concat('Школа ', k) AS object_name, k = 0 AS explicit_zero, count(*) AS n_rows FROM l GROUP BY doc_id, k")
def build_groups(spark, sf):
    """P2's groups."""
    return g.build_groups(bound(spark, sf, SHEET), bound(spark, sf, ROLES), 10, within=4)[0]


@query("build_groups_funding", f"WITH {SHEET_ROWS} SELECT doc_id, concat('object::::K', k) AS group_key, CAST(2026 AS INT) AS year, 'FEDERAL_BUDGET' AS source_type, {SUM} AS amount FROM l WHERE k <> 0 AND amount <> 0 GROUP BY doc_id, k")
def build_groups_funding(spark, sf):
    """P2's funding."""
    return g.build_groups(bound(spark, sf, SHEET), bound(spark, sf, ROLES), 10, within=4)[1]


# a program's finance table has a row a line item, its results stand in a table of every second order
PLACE = "CAST(l_linenumber AS BIGINT) * 100000000000000 + l_partkey * 10000000 + l_suppkey"
PROGRAM_TREE = f"SELECT l_orderkey AS doc_id, {PLACE} AS row_idx, CASE l_partkey % 3 WHEN 0 THEN '1.' WHEN 1 THEN '1.1' ELSE '1.1.1' END AS number, concat('row ', l_partkey) AS name, l_partkey FROM lineitem"
PROGRAM_ROWS = f"""SELECT DISTINCT doc_id, 1 AS table_idx, row_idx, number, name FROM ({PROGRAM_TREE})
  UNION ALL SELECT o_orderkey, 2, CAST(900000000000000 + v.r AS BIGINT), CASE v.r WHEN 1 THEN '2.' ELSE '' END, CASE v.r WHEN 0 THEN 'Наименование  результата' WHEN 1 THEN concat('Результат ', o_custkey) ELSE ' ' END FROM orders, (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) v WHERE o_orderkey % 2 = 0"""
PROGRAM_SOURCES = f"SELECT l_orderkey AS doc_id, {PLACE} AS row_idx, CASE WHEN l_linenumber % 2 = 0 THEN 'федеральный бюджет' ELSE 'местный бюджет' END AS source, CAST(l_extendedprice AS {D}) AS amount FROM lineitem"


@query(
    "build_program",
    f"""WITH {TREE_SQL.replace(TREE, PROGRAM_TREE)}, n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY row_idx) = 1), p AS ({PASSPORT_SQL})
    SELECT 'nodes' AS part, doc_id, row_idx, node_type AS kind, key, parent_key, NULL::INT AS number, NULL AS name, NULL AS period, NULL::INT AS year, NULL AS source_type, NULL::INT AS table_idx, NULL::INT AS col_idx, NULL::{D} AS amount FROM n
    UNION ALL SELECT 'lines', l.doc_id, l.row_idx, NULL, n.key, NULL, NULL, NULL, NULL, NULL, CASE WHEN source LIKE 'ф%' THEN 'FEDERAL_BUDGET' ELSE 'LOCAL_BUDGET' END, NULL, NULL, amount FROM ({PROGRAM_SOURCES}) l ASOF JOIN n ON n.doc_id = l.doc_id AND l.row_idx >= n.row_idx
    UNION ALL SELECT 'results', o_orderkey, 900000000000001, NULL, concat('result:2:результат-', o_custkey), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'subprograms', o_custkey, NULL, NULL, NULL, NULL, CAST(o_orderkey % 5 AS INT), concat('Имя ', min(o_orderkey)), NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey, o_orderkey % 5
    UNION ALL SELECT 'metadata', o_custkey, NULL, NULL, NULL, NULL, NULL, 'Имя ' || min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), CASE WHEN bool_or(o_orderkey % 3 = 0) THEN '2024-2028' END, NULL, NULL, NULL, NULL, NULL FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'passport', doc_id, row_idx, kind, NULL, NULL, NULL, NULL, NULL, year, source_type, table_idx, col_idx, amount FROM p""",
)
def build_program(spark, sf):
    """P1 with the rows of all its parts, one below the other; a column that a part hasn't is null."""
    found = g.build_program(bound(spark, sf, PROGRAM_ROWS), bound(spark, sf, PROGRAM_SOURCES), bound(spark, sf, PASSPORT_CELLS), bound(spark, sf, PARAS))
    names = {"nodes": {"node_type": "kind"}, "lines": {"node_key": "key"}, "metadata": {"program_name": "name"}}
    parts = [df.withColumnsRenamed(names.get(k, {})).withColumns({"part": F.lit(k), **({"row_idx": F.col("row_idx").cast("long")} if "row_idx" in df.columns else {})}) for k, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- sources and sinks: written, and read again


@query("scan_cells", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def scan_cells(spark, sf):
    """A2."""
    return io.scan_cells(spark, f"{sf}/conversations.parquet").select("conv_id", "turn")


STATUS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


@query("replace_by_document", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 10 <> 0")
def replace_by_document(spark, sf):
    """A load, then a reload of half the keys, twice, in which every tenth is emptied."""
    path, df = scratch(spark, "reload"), bound(spark, sf, STATUS)
    io.replace_by_document(df, path, "o_custkey", 8)
    again = df.where("o_custkey % 2 = 0").withColumn("o_orderstatus", F.lit("NEW"))
    for _ in range(2):
        io.replace_by_document(again.where("o_custkey % 10 <> 0"), path, "o_custkey", 8, again.select("o_custkey"))
    return io.read_documents(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("write_change_report", "SELECT item_id, set_id, status FROM items")
def write_change_report(spark, sf):
    """A8."""
    path = scratch(spark, "report")
    io.write_change_report(rows(spark, sf, "items").select("item_id", "set_id", "status"), path)
    return spark.read.option("header", True).schema("item_id long, set_id string, status string").csv(path)


@query("append_audit", "SELECT CAST(ts AS DATE) AS day, count(*) * 2 AS n FROM events GROUP BY 1")
def append_audit(spark, sf):
    """Two appends."""
    path, df = scratch(spark, "audit"), bound(spark, sf, "SELECT event_id, ts, event_type FROM events")
    for _ in range(2):
        io.append_audit(df, path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n")).select(F.to_date("day").alias("day"), "n")


ARRIVALS = """SELECT concat('D', o_orderkey) AS doc_id, CASE WHEN o_orderkey % 50 = 7 THEN 'letter' ELSE 'finance_report' END AS document_type,
  CASE WHEN o_orderkey % 10 = 3 AND NOT fixed THEN concat('{bad ', o_orderkey) WHEN o_orderkey % 15 = 0 AND fixed THEN '{"lines": [], "pages": []}'
    ELSE concat('{"pages": ["page of ', o_custkey, '", "Rules"], "lines": [{"name": "x", "year": ', year(o_orderdate), ', "source": "', CASE WHEN o_orderkey % 2 = 0 THEN 'FEDERAL_BUDGET' ELSE 'LOCAL_BUDGET' END, '", "amount": "', CASE WHEN o_orderkey % 40 = 6 THEN 'unclear' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) END, '", "unit": "rub"}]}') END AS payload
  FROM orders CROSS JOIN (SELECT {fixed} AS fixed)"""


@query(
    "stream_ingest",
    """WITH d AS (SELECT concat('D', o_orderkey) AS doc_id, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(20,2)) AS amount, o_orderkey % 3 = 0 AS again, CASE WHEN o_orderkey % 50 = 7 THEN 'unknown_type' WHEN o_orderkey % 10 = 3 AND o_orderkey % 3 <> 0 THEN 'unreadable' WHEN o_orderkey % 15 = 0 THEN NULL WHEN o_orderkey % 40 = 6 THEN 'bad_amount' END AS error FROM orders)
    SELECT doc_id, CASE WHEN error IS NULL THEN 'parsed' ELSE 'failed' END AS status, error, CAST(CASE WHEN again THEN 1 ELSE 0 END AS BIGINT) AS batch_id, CASE WHEN error IS NULL AND k % 15 <> 0 THEN amount END AS amount, CAST(CASE WHEN error IS NULL AND k % 15 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS pages, error IS NOT NULL AS quarantined FROM d""",
)
def stream_ingest(spark, sf):
    """Documents arrive as files; a third of them arrives again, mended or emptied; a third run finds nothing new."""
    path = scratch(spark, "ingest")
    for fixed in (False, True, None):
        if fixed is not None:
            arrivals = bound(spark, sf, ARRIVALS.replace("{fixed}", str(fixed).lower()))
            (arrivals.where("substring(doc_id, 2, 20) % 3 = 0") if fixed else arrivals).write.mode("append").parquet(f"{path}/in")
        flows.stream_ingest(spark, f"{path}/in", "doc_id string, document_type string, payload string", flows.parse_payloads, f"{path}/out", "doc_id", f"{path}/state", 8).awaitTermination()
    read = lambda name: io.read_documents(spark, f"{path}/out/{name}")
    out = read("status").join(read("totals").groupBy("doc_id").agg(F.sum("amount").cast("decimal(20,2)").alias("amount")), "doc_id", "left")
    out = out.join(read("pages").groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id", "left").join(read("quarantine").select("doc_id", F.lit(True).alias("quarantined")), "doc_id", "left")
    return out.select("doc_id", "status", "error", "batch_id", "amount", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
