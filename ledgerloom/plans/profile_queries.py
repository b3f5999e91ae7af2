"""Profiles of documents, one a customer, and rows of new objects, which are orders below customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insertions, profile
from .registry import bound, query

D = "DECIMAL(20,2)"
KIND = "CASE c_custkey % 5 WHEN 0 THEN 'docx_program' WHEN 1 THEN 'xlsx_finance' WHEN 2 THEN 'pdf_agreement' WHEN 3 THEN 'pdf_procedure' ELSE 'text' END"
SOURCE = "CASE o_orderkey % 3 WHEN 0 THEN 'LOCAL_BUDGET' WHEN 1 THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END"


@query(
    "document_profiles",
    f"""WITH d AS (SELECT c_custkey AS doc_id, {KIND} AS t FROM customer), o AS (SELECT *, o_custkey AS doc_id, {SOURCE} AS source, CAST(year(o_orderdate) AS INT) AS y FROM orders),
    tb AS (SELECT doc_id, o_orderkey % 3 AS ti, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END || '/' || coalesce(CAST(CASE WHEN o_orderkey % 7 <> 0 THEN 4 END AS VARCHAR), ''), (o_orderkey % 5 = 0, o_orderkey)) AS unused,
        arg_min({{'s': CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END, 't': CASE WHEN o_orderkey % 7 <> 0 THEN 4 END, 'y': CASE WHEN o_orderkey % 5 <> 0 THEN y END}}, (o_orderkey % 5 = 0, o_orderkey)) AS f FROM o WHERE o_orderkey % 6 <> 5 AND o_orderkey % 3 <> 2 GROUP BY ALL),
    t2 AS (SELECT doc_id, count(*) AS n_tables, list_sort(list(ti)) AS tis, count(f.s) > 0 AS sc, count(f.t) > 0 AS tc, list_sort(list_distinct(list_concat(list(f.y) FILTER (f.y IS NOT NULL), list(f.y + 1) FILTER (f.y IS NOT NULL)))) AS ys FROM tb GROUP BY 1),
    l AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT source)) AS s FROM o WHERE o_orderkey % 6 <> 5 GROUP BY 1),
    p AS (SELECT doc_id, arg_min(o_orderkey % 9, (y, y - 1990, o_orderkey % 9)) FILTER (o_orderkey % 4 = 1) AS ti, list_sort(list(DISTINCT y) FILTER (o_orderkey % 4 = 1)) AS ys, arg_min(o_orderkey % 9, (y, y - 1990, o_orderkey % 9)) FILTER (o_orderkey % 4 = 2) AS ti2 FROM o WHERE o_orderkey % 4 IN (1, 2, 3) AND o_orderkey % 5 = 0 GROUP BY 1),
    g AS (SELECT doc_id, count(DISTINCT o_orderpriority) AS n, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 10 = 0) AS z, list_sort(list(DISTINCT source)) AS s FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS n FROM o WHERE o_orderstatus = 'F' GROUP BY 1), x AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS ty FROM o WHERE o_orderkey % 7 = 0 GROUP BY 1),
    k AS (SELECT doc_id, count(*) AS n FROM o WHERE o_orderkey % 8 = 0 GROUP BY 1),
    r AS (SELECT d.doc_id, t, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 4 < 3 THEN 'passed' END AS control, coalesce(l.n, 0) AS nl, coalesce(l.s, []) AS ls, coalesce(n_tables, 0) AS nt, tis, coalesce(sc, false) AS sc, coalesce(tc, false) AS tc, coalesce(t2.ys, []) AS ys, p.doc_id IS NOT NULL AS pass, coalesce(p.ti, p.ti2) AS pti, coalesce(p.ys, []) AS pys,
        coalesce(g.n, 0) AS ng, coalesce(g.z, 0) AS nz, coalesce(g.s, []) AS gs, coalesce(c.n, 0) AS nc, coalesce(x.n, 0) AS nx, coalesce(x.ty, []) AS xt, coalesce(k.n, 0) AS nk
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN t2 USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)),
    w AS (SELECT *, concat_ws(',', CASE WHEN t = 'text' THEN 'unsupported_type' END, CASE WHEN t = 'docx_program' AND nl = 0 THEN 'no_funding_lines' END, CASE WHEN t = 'docx_program' AND NOT pass THEN 'no_passport' END, CASE WHEN t = 'xlsx_finance' AND ng = 0 THEN 'no_object_groups' END,
        CASE WHEN t = 'pdf_agreement' AND nc = 0 THEN 'no_changes' END, CASE WHEN t = 'pdf_agreement' AND control = 'failed' THEN 'controls_failed' END, CASE WHEN t = 'pdf_agreement' AND control IS NULL AND nx > 0 THEN 'controls_missing' END) AS warnings FROM r),
    q AS (SELECT *, CAST(greatest(0, 1 - CASE WHEN warnings <> '' THEN 0.25 ELSE 0 END - CASE WHEN t = 'docx_program' AND nt = 0 THEN 0.35 ELSE 0 END - CASE WHEN t = 'docx_program' AND NOT pass THEN 0.25 ELSE 0 END - CASE WHEN t = 'pdf_agreement' AND nc = 0 THEN 0.35 ELSE 0 END - CASE WHEN t = 'pdf_agreement' AND control = 'failed' THEN 0.45 ELSE 0 END) AS DECIMAL(5,2)) AS confidence FROM w)
    SELECT doc_id, CASE t WHEN 'docx_program' THEN 'current_program' WHEN 'xlsx_finance' THEN 'xlsx_target_model' WHEN 'pdf_agreement' THEN 'pdf_patch_source' WHEN 'pdf_procedure' THEN 'procedure' END AS document_role, CASE t WHEN 'docx_program' THEN 'thousand_rub' WHEN 'xlsx_finance' THEN 'rub' WHEN 'pdf_agreement' THEN 'rub' END AS unit,
      CASE WHEN t = 'docx_program' THEN array_to_string(coalesce(tis, []), ',') ELSE '' END AS tables_found, CASE WHEN t = 'docx_program' THEN array_to_string(ys, ',') ELSE '' END AS years, t = 'docx_program' AND sc AS source_column, t = 'docx_program' AND tc AS total_column, CASE t WHEN 'docx_program' THEN array_to_string(ls, ',') WHEN 'xlsx_finance' THEN array_to_string(gs, ',') ELSE '' END AS sources,
      t = 'docx_program' AND pass AS passport, CASE WHEN t = 'docx_program' THEN pti END AS passport_table, CASE WHEN t = 'docx_program' THEN array_to_string(pys, ',') END AS passport_years, CASE WHEN t = 'docx_program' THEN nl ELSE 0 END AS lines, CASE WHEN t = 'xlsx_finance' THEN ng ELSE 0 END AS groups, CASE WHEN t = 'xlsx_finance' THEN nz ELSE 0 END AS zero_groups,
      CASE WHEN t = 'pdf_agreement' THEN nc ELSE 0 END AS changes, CASE WHEN t = 'pdf_agreement' THEN nx ELSE 0 END AS tables, CASE WHEN t = 'pdf_procedure' THEN nk ELSE 0 END AS chunks, CASE WHEN t = 'pdf_agreement' THEN array_to_string(xt, ',') ELSE '' END AS table_types, CASE WHEN t = 'pdf_agreement' THEN control END AS control_status, warnings, confidence, CASE WHEN confidence >= 0.65 AND warnings = '' THEN 'active' ELSE 'failed' END AS status FROM q""",
)
def document_profiles(spark, sf):
    """C26 in full."""
    at = lambda sql: bound(spark, sf, sql)
    y = "CAST(year(o_orderdate) AS INT)"
    out = profile.profile_documents(
        at(f"SELECT c_custkey AS doc_id, {KIND} AS document_type FROM customer"),
        at(f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 3 END AS table_idx, {SOURCE} AS source_type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS source_col, CASE WHEN o_orderkey % 7 <> 0 THEN 4 END AS total_col, "
           f"CASE WHEN o_orderkey % 5 <> 0 THEN array(named_struct('year', {y}, 'col_idx', 5), named_struct('year', {y} + 1, 'col_idx', 6)) END AS year_cells FROM orders WHERE o_orderkey % 6 <> 5"),
        at(f"SELECT o_custkey AS doc_id, CASE o_orderkey % 4 WHEN 1 THEN 'total' WHEN 2 THEN 'source' ELSE 'amount' END AS kind, o_orderkey % 9 AS table_idx, {y} AS year, {y} - 1990 AS col_idx FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0"),
        at(f"SELECT o_custkey AS doc_id, o_orderpriority AS group_key, {SOURCE} AS source_type, o_orderkey % 10 = 0 AS explicit_zero FROM orders WHERE o_orderkey % 2 = 0"),
        at("SELECT o_custkey AS doc_id FROM orders WHERE o_orderstatus = 'F'"),
        at("SELECT o_custkey AS doc_id, o_orderkey AS table_idx, o_orderpriority AS table_type FROM orders WHERE o_orderkey % 7 = 0"),
        at("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'passed' END AS status FROM customer WHERE c_custkey % 4 <> 3"),
        at("SELECT o_custkey AS doc_id FROM orders WHERE o_orderkey % 8 = 0"),
    )
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return out.select(
        "doc_id", "document_role", "unit", joined(F.col("finance_tables.table_idx")).alias("tables_found"), joined(F.col("years")).alias("years"), "source_column", "total_column", joined(F.col("sources")).alias("sources"), "passport", "passport_table",
        joined(F.col("passport_years.year")).alias("passport_years"), "lines", "groups", "zero_groups", "changes", "tables", "chunks", joined(F.col("table_types")).alias("table_types"), "control_status", joined(F.col("warnings")).alias("warnings"), "confidence", "status",
    )


# customers are parents in three tables, orders their children; every seventh order is new, every 21st of them an activity
NODES = """
  SELECT c_custkey % 4 AS doc_id, concat('C', c_custkey) AS node_id, concat('N', c_nationkey) AS parent_id, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 3 END AS table_idx, CAST(c_custkey * 100 AS BIGINT) AS row_idx, concat('1.', c_custkey, '.') AS display_number, false AS is_new FROM customer
  UNION ALL SELECT o_custkey % 4, concat('O', o_orderkey), concat('C', o_custkey), o_custkey % 3, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey * 100 + 1 + o_orderkey % 83 AS BIGINT) END, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE concat('1.', o_custkey, '.', o_orderkey) END, o_orderkey % 7 = 0 FROM orders"""
OBJECTS = "SELECT o_custkey % 4 AS doc_id, concat('O', o_orderkey) AS object_id, concat('C', o_custkey) AS parent_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('C', o_custkey + 1) END AS anchor_id, concat('1.', o_custkey, '.', o_orderkey) AS display_number, o_orderkey % 21 = 0 AS is_aggregate FROM orders WHERE o_orderkey % 7 = 0"
LINES = f"""
  SELECT concat('O', l_orderkey) AS node_id, CAST(year(l_shipdate) AS INT) AS year, CASE l_returnflag WHEN 'A' THEN 'LOCAL_BUDGET' WHEN 'N' THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END AS source_type, CAST(l_extendedprice AS {D}) AS amount,
    o_custkey % 3 AS src_table, CASE WHEN o_orderkey % 7 <> 0 AND l_linenumber % 2 = 0 THEN CAST(o_custkey * 100 + 5 + o_orderkey % 83 AS BIGINT) END AS src_row FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT concat('C', c_custkey), 2000, 'EXTRABUDGETARY', CAST(c_acctbal AS {D}), c_custkey % 3, CAST(c_custkey * 100 + 3 AS BIGINT) FROM customer WHERE c_custkey % 5 = 0"""
SHOWN = "CAST(((abs(CAST({0} * 100 AS HUGEINT)) + 500) // 1000) * 10 * sign({0})::INT AS DECIMAL(20,2))"
ROWS_SQL = f"""nodes0 AS ({NODES}), objects0 AS ({OBJECTS}), lines0 AS ({LINES}),
    own AS (SELECT node_id AS object_id, source_type, year, sum(amount) AS amount FROM lines0 WHERE node_id IN (SELECT object_id FROM objects0) GROUP BY ALL),
    ps AS (SELECT object_id, parent_id AS p FROM objects0 UNION SELECT object_id, anchor_id FROM objects0 WHERE anchor_id IS NOT NULL),
    used AS (SELECT node_id AS p, source_type FROM lines0 UNION SELECT parent_id, source_type FROM lines0 JOIN nodes0 USING (node_id)),
    src AS (SELECT object_id, source_type FROM ps JOIN used USING (p) WHERE object_id IN (SELECT object_id FROM own) UNION SELECT object_id, source_type FROM own),
    ys AS (SELECT DISTINCT object_id, year FROM own), cells AS (SELECT object_id, source_type, year, coalesce(amount, 0) AS amount FROM src JOIN ys USING (object_id) LEFT JOIN own USING (object_id, source_type, year)),
    rs AS (SELECT object_id, source_type, sum({SHOWN.format("amount")}) AS total_amount, string_agg(concat(year, '=', CAST(amount AS {D})), ',' ORDER BY year) AS by_year FROM cells GROUP BY ALL),
    ts AS (SELECT object_id, sum({SHOWN.format("amount")}) AS t, string_agg(concat(year, '=', CAST(amount AS {D})), ',' ORDER BY year) AS by_year FROM (SELECT object_id, year, sum(amount) AS amount FROM own GROUP BY ALL) GROUP BY 1),
    un AS (SELECT object_id, CASE source_type WHEN 'FEDERAL_BUDGET' THEN 10 WHEN 'REGIONAL_BUDGET' THEN 20 WHEN 'LOCAL_BUDGET' THEN 30 ELSE 50 END AS rank, source_type, total_amount, by_year FROM rs
      UNION ALL SELECT object_id, CASE WHEN is_aggregate THEN 100 ELSE 0 END, 'TOTAL', t * CASE WHEN is_aggregate THEN (SELECT count(*) FROM rs WHERE rs.object_id = ts.object_id) ELSE 1 END, by_year FROM ts JOIN objects0 USING (object_id)),
    inserted AS (SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY rank) AS INT) AS place, source_type, CAST(total_amount AS {D}) AS total_amount, by_year FROM un)"""
ANCHORS_SQL = """placed AS (SELECT n.*, greatest(row_idx, (SELECT max(src_row) FROM lines0 l WHERE l.node_id = n.node_id AND l.src_table = n.table_idx)) AS last_row FROM nodes0 n WHERE NOT is_new),
    news AS (SELECT b.*, p.table_idx, p.last_row AS parent_row, rtrim(p.display_number, '.') AS prefix FROM objects0 b JOIN placed p ON p.doc_id = b.doc_id AND p.node_id = b.parent_id WHERE p.table_idx IS NOT NULL),
    kids AS (SELECT doc_id, parent_id, table_idx, arg_max(row_idx, (row_idx, node_id)) AS r, arg_max(last_row, (row_idx, node_id)) AS l FROM placed WHERE display_number <> 'x' AND row_idx IS NOT NULL GROUP BY ALL),
    sib AS (SELECT doc_id, table_idx, row_idx, last_row, CAST(split_part(display_number, '.', 3) AS BIGINT) AS k, concat('1.', split_part(display_number, '.', 2)) AS prefix FROM placed WHERE regexp_matches(display_number, '^1[.][0-9]+[.][0-9]+$') AND row_idx IS NOT NULL),
    low AS (SELECT object_id, arg_max(s.row_idx, k) AS r, arg_max(s.last_row, k) AS l FROM news n JOIN sib s ON s.doc_id = n.doc_id AND s.table_idx = n.table_idx AND s.prefix = n.prefix WHERE is_aggregate AND k < CAST(substr(object_id, 2) AS BIGINT) GROUP BY 1),
    high AS (SELECT object_id, min(s.row_idx) AS h FROM news n JOIN sib s ON s.doc_id = n.doc_id AND s.table_idx = n.table_idx AND s.prefix = n.prefix WHERE is_aggregate AND k > CAST(substr(object_id, 2) AS BIGINT) GROUP BY 1),
    anchored AS (SELECT n.doc_id, object_id, n.table_idx, CAST(coalesce(kids.l, parent_row) AS BIGINT) AS insert_after, CAST(coalesce(kids.r, kids.l, parent_row) AS BIGINT) AS template_row FROM news n LEFT JOIN kids ON kids.doc_id = n.doc_id AND kids.parent_id = n.parent_id AND kids.table_idx = n.table_idx WHERE NOT is_aggregate
      UNION ALL SELECT doc_id, object_id, table_idx, spot, coalesce(r, spot) FROM (SELECT doc_id, object_id, table_idx, r, CAST(CASE WHEN l IS NULL THEN parent_row WHEN h IS NULL THEN l + 1 WHEN h - 1 >= l THEN least(l + 1, h - 1) ELSE l END AS BIGINT) AS spot FROM news LEFT JOIN low USING (object_id) LEFT JOIN high USING (object_id) WHERE is_aggregate))"""


def tables(spark, sf):
    return (bound(spark, sf, sql) for sql in (OBJECTS, NODES, LINES))


def shown_years(df):
    return df.withColumn("by_year", F.array_join(F.transform("by_year", lambda y: F.concat(y["year"].cast("string"), F.lit("="), y["amount"].cast("string"))), ","))


@query("insert_rows", f"WITH {ROWS_SQL} SELECT * FROM inserted")
def insert_rows(spark, sf):
    """G25 in full."""
    return shown_years(insertions.insert_rows(*tables(spark, sf)))


@query("insert_anchors", f"WITH nodes0 AS ({NODES}), objects0 AS ({OBJECTS}), lines0 AS ({LINES}), {ANCHORS_SQL} SELECT * FROM anchored")
def insert_anchors(spark, sf):
    """W14 in full."""
    return insertions.insert_anchors(*tables(spark, sf))


@query(
    "insertion_plan",
    f"""WITH {ROWS_SQL}, {ANCHORS_SQL}, seat AS (SELECT doc_id, table_idx, object_id, insert_after + 1 + coalesce(sum(n) OVER (PARTITION BY doc_id, table_idx ORDER BY insert_after, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row FROM anchored JOIN (SELECT object_id, count(*) AS n FROM inserted GROUP BY 1) USING (object_id))
    SELECT doc_id, table_idx, CAST(first_row + place - 1 AS BIGINT) AS row_idx, object_id, source_type, total_amount, by_year FROM seat JOIN inserted USING (object_id)""",
)
def insertion_plan(spark, sf):
    """P19 in full."""
    return shown_years(insertions.plan_insertions(*tables(spark, sf)))
