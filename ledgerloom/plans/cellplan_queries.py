"""The full cell plan over five versions: regions are programs, nations main activities, customers activities, orders objects."""

from __future__ import annotations

from ..operators import cellplan
from .registry import bound, query

D = "DECIMAL(20,2)"
# a node has its year cells from the years of its kind; mirrors of customers and summary rows of nations stand beside them
NODES = """
  SELECT concat('V', r_regionkey) AS version_id, concat('R', r_regionkey) AS node_id, CAST(NULL AS STRING) AS parent_id, CASE WHEN r_regionkey = 4 THEN 'subprogram' ELSE 'program' END AS node_type, r_name AS name, '1' AS display_number, CAST(NULL AS STRING) AS refers_to, 'program' AS source, CAST(NULL AS INT) AS table_idx, CAST(NULL AS INT) AS row_idx, false AS has_cells, CAST(NULL AS STRING) AS execution_period, CAST(NULL AS STRING) AS number_was FROM region
  UNION ALL SELECT concat('V', n_regionkey), concat('N', n_nationkey), concat('R', n_regionkey), 'main_activity', n_name, concat('1.', n_nationkey), NULL, 'finance', 1, CAST(n_nationkey AS INT), true, NULL, CASE WHEN n_nationkey % 3 = 0 THEN '9.9.' WHEN n_nationkey % 3 = 1 THEN '9.9' END FROM nation
  UNION ALL SELECT concat('V', n_regionkey), concat('T', n_nationkey), concat('R', n_regionkey), 'main_activity', concat('Итого по ', n_name), NULL, concat('N', n_nationkey), 'finance', 1, CAST(100 + n_nationkey AS INT), true, NULL, NULL FROM nation
  UNION ALL SELECT concat('V', n_regionkey), concat('C', c_custkey), concat('N', c_nationkey), 'activity', c_name, concat(c_nationkey, '.', c_custkey), NULL, 'finance_table', 2, CAST(c_custkey AS INT), true, CASE c_custkey % 3 WHEN 0 THEN '2010-2020' WHEN 1 THEN '2012 - 2015' ELSE 'all years' END, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('V', n_regionkey), concat('D', c_custkey), concat('N', c_nationkey), 'activity', upper(c_name), concat(c_nationkey, '.', c_custkey, '.'), NULL, 'finance_table', 2, CAST(c_custkey / 10 * 10 + 1000000 AS INT), true, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0
  UNION ALL SELECT concat('V', n_regionkey), concat('O', o_orderkey), concat('C', o_custkey), 'object', concat('Order ', o_orderkey), NULL, NULL, 'sheet', NULL, NULL, false, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
SOURCE = "CASE {0} % 3 WHEN 0 THEN 'LOCAL_BUDGET' WHEN 1 THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END"
LINES = f"""
  SELECT concat('O', l_orderkey) AS node_id, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS line_no, CAST(year(l_shipdate) AS INT) AS year, {SOURCE.format("l_linenumber")} AS source_type, CAST(l_extendedprice AS {D}) AS amount,
    3 AS src_table, CAST(l_orderkey * 10 + l_linenumber % 3 AS INT) AS src_row, CASE WHEN l_linenumber < 3 THEN CAST(year(l_shipdate) - 1988 AS INT) END AS cell, CASE WHEN l_linenumber % 2 = 0 THEN 'x' END AS raw, 'thousand_rub' AS unit, CASE WHEN l_orderkey % 2 = 0 THEN 3 END AS total_cell, CAST(NULL AS STRING) AS total_raw FROM lineitem WHERE l_linenumber <= 6
  UNION ALL SELECT concat(k, o_custkey), CAST(o_orderkey AS BIGINT), CAST(year(o_orderdate) AS INT), {SOURCE.format("o_orderkey")}, CAST(o_totalprice AS {D}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders CROSS JOIN (SELECT 'C' AS k UNION ALL SELECT 'D') WHERE k = 'C' OR o_custkey % 10 = 0
  UNION ALL SELECT concat(k, c_nationkey), CAST(o_orderkey AS BIGINT), CAST(year(o_orderdate) AS INT), {SOURCE.format("o_orderkey")}, CAST(o_totalprice AS {D}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT 'N' AS k UNION ALL SELECT 'T')
  UNION ALL SELECT concat('R', n_regionkey), CAST(o_orderkey AS BIGINT), CAST(year(o_orderdate) AS INT), {SOURCE.format("o_orderkey")}, CAST(o_totalprice AS {D}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
YEARS = "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE year(o_orderdate) < 2200"
# version 3 states its total cells, the others leave them to be inferred; version 2 has no cells by source
PASSPORT = f"""
  SELECT concat('V', r_regionkey) AS version_id, 'source' AS kind, y AS year, s AS source_type, 0 AS table_idx, 10 + i AS row_idx, y - 1980 AS col_idx, CASE WHEN y % 2 = 0 THEN 'p' END AS raw, 'thousand_rub' AS unit FROM region CROSS JOIN ({YEARS}) CROSS JOIN (SELECT 'LOCAL_BUDGET' AS s, 0 AS i UNION ALL SELECT 'REGIONAL_BUDGET', 1) WHERE r_regionkey <> 2
  UNION ALL SELECT concat('V', r_regionkey), 'total', y, NULL, 0, 9, y - 1980, 'p', CASE WHEN r_regionkey = 1 THEN 'rub' ELSE 'thousand_rub' END FROM region CROSS JOIN ({YEARS})
  UNION ALL SELECT 'V3', 'source_total', NULL, 'LOCAL_BUDGET', 0, 10, 2, 'q', 'thousand_rub' FROM region WHERE r_regionkey = 3
  UNION ALL SELECT 'V3', 'grand', NULL, NULL, 0, 9, 2, NULL, 'thousand_rub' FROM region WHERE r_regionkey = 3"""
CHANGED = "SELECT concat('C', o_custkey) AS node_id, CAST(o_orderkey AS BIGINT) AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'zeroing' ELSE 'absolute' END AS mode FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT concat('O', o_orderkey), CAST(o_orderkey AS BIGINT), 'absolute' FROM orders WHERE o_orderkey % 7 = 0"
ADDED = "SELECT concat('O', o_orderkey) AS node_id FROM orders WHERE o_orderkey % 11 = 0"

SHOWN = "CASE WHEN {1} = 'thousand_rub' THEN CAST(((CAST({0} * 100 AS HUGEINT) + 500 * sign({0})::INT) // 1000) * 10 AS DECIMAL(20,2)) ELSE {0} END"
COMMON = f"""
nodes0 AS ({NODES}), lines0 AS ({LINES}), passport0 AS ({PASSPORT}), changed0 AS ({CHANGED}), added0 AS ({ADDED}),
up AS (SELECT node_id, node_id AS a, 0 AS d FROM nodes0 UNION ALL SELECT u.node_id, n.parent_id, d + 1 FROM up u JOIN nodes0 n ON n.node_id = u.a WHERE n.parent_id IS NOT NULL),
i1 AS (SELECT DISTINCT a AS node_id FROM up WHERE node_id IN (SELECT node_id FROM changed0) OR (d > 0 AND node_id IN (SELECT node_id FROM added0))),
i2 AS (SELECT node_id FROM i1 UNION SELECT node_id FROM nodes0 WHERE refers_to IN (SELECT node_id FROM i1)),
i3 AS (SELECT node_id FROM i2 UNION SELECT replace(node_id, 'C', 'D') FROM i2 JOIN nodes0 n USING (node_id) WHERE n.source = 'finance_table' AND replace(node_id, 'C', 'D') IN (SELECT node_id FROM nodes0) UNION SELECT replace(node_id, 'D', 'C') FROM i2 WHERE node_id LIKE 'D%')"""
PLAN_SQL = f"""
WITH RECURSIVE {COMMON},
n AS (SELECT *, CASE WHEN has_cells THEN 4 END AS total_cell, CASE WHEN table_idx = 1 THEN 'rub' ELSE 'thousand_rub' END AS unit FROM nodes0 WHERE node_id IN (SELECT node_id FROM i3)),
l AS (SELECT * FROM lines0 WHERE node_id IN (SELECT node_id FROM i3)),
y AS (SELECT node_id, year, CAST(sum(amount) AS {D}) AS amount FROM l GROUP BY ALL),
rows1 AS (SELECT version_id, table_idx, row_idx, year - 1985 AS col_idx, amount, CASE WHEN year % 2 = 0 THEN 'r' END AS raw, unit, 'node_total_year' AS reason, node_id, NULL::BIGINT AS item_id, 0 AS phase, 0 AS kind, 0 AS line FROM n JOIN y USING (node_id) WHERE has_cells AND year >= 1992),
rows2 AS (SELECT version_id, table_idx, row_idx, total_cell, coalesce(CAST(sum({SHOWN.format("amount", "unit")}) AS {D}), 0), NULL, unit, 'node_total_column', node_id, NULL, 0, 1, 0 FROM n LEFT JOIN y USING (node_id) WHERE has_cells GROUP BY ALL),
item AS (SELECT node_id, min(item_id) AS item_id FROM changed0 GROUP BY 1),
based AS (SELECT l.*, n.version_id, item.item_id, arg_min(cell, (year, cell)) FILTER (cell IS NOT NULL) OVER w AS c0, min(year) FILTER (cell IS NOT NULL) OVER w AS y0 FROM l JOIN n USING (node_id) LEFT JOIN item USING (node_id) WHERE src_table IS NOT NULL WINDOW w AS (PARTITION BY l.node_id, source_type, src_row)),
rows3 AS (SELECT version_id, src_table, src_row, coalesce(cell, CASE WHEN c0 + year - y0 > 0 THEN c0 + year - y0 END) AS col, amount, raw, unit, 'funding_line_year', node_id, item_id, 0, 2, line_no FROM based WHERE coalesce(cell, CASE WHEN c0 + year - y0 > 0 THEN c0 + year - y0 END) IS NOT NULL),
rows4 AS (SELECT version_id, src_table, src_row, total_cell, CAST(sum({SHOWN.format("amount", "unit")}) AS {D}), NULL, unit, 'funding_line_total_column', node_id, item_id, 0, 3, min(line_no) FROM based WHERE total_cell IS NOT NULL GROUP BY version_id, src_table, src_row, total_cell, unit, node_id, item_id, source_type),
r AS (SELECT version_id, node_id, year, source_type, CAST(sum(amount) AS {D}) AS amount FROM lines0 JOIN nodes0 USING (node_id) WHERE parent_id IS NULL GROUP BY ALL),
ry AS (SELECT version_id, node_id, year, CAST(sum(amount) AS {D}) AS amount FROM r GROUP BY ALL),
st AS (SELECT version_id, source_type, table_idx, row_idx, col_idx, raw, unit FROM passport0 WHERE kind = 'source_total' UNION ALL SELECT version_id, source_type, table_idx, row_idx, min(col_idx) - 1, NULL, unit FROM passport0 WHERE kind = 'source' AND version_id <> 'V3' GROUP BY ALL),
gt AS (SELECT version_id, table_idx, row_idx, col_idx, raw, unit FROM passport0 WHERE kind = 'grand' UNION ALL SELECT version_id, table_idx, row_idx, min(col_idx) - 1, NULL, unit FROM passport0 WHERE kind = 'total' AND version_id <> 'V3' GROUP BY ALL),
rows5 AS (SELECT version_id, table_idx, row_idx, col_idx, amount, raw, unit, 'passport_source_year', node_id, NULL, 1, 0, 0 FROM r JOIN passport0 p USING (version_id, year, source_type) WHERE kind = 'source'),
rows6 AS (SELECT version_id, table_idx, row_idx, col_idx, CAST(sum({SHOWN.format("amount", "unit")}) AS {D}), raw, unit, 'passport_source_total_column', node_id, NULL, 1, 1, 0 FROM r JOIN st USING (version_id, source_type) GROUP BY ALL),
rows7 AS (SELECT version_id, table_idx, row_idx, col_idx, amount, raw, unit, 'passport_total', node_id, NULL, 1, 2, 0 FROM ry JOIN passport0 p USING (version_id, year) WHERE kind = 'total'),
rows8 AS (SELECT version_id, table_idx, row_idx, col_idx, CAST(sum({SHOWN.format("amount", "unit")}) AS {D}), raw, unit, 'passport_grand_total_column', node_id, NULL, 1, 3, 0 FROM ry JOIN gt USING (version_id) GROUP BY ALL),
every AS ({" UNION ALL ".join(f"SELECT * FROM rows{i}" for i in range(1, 9))}),
best AS (SELECT *, row_number() OVER (PARTITION BY version_id, table_idx, row_idx, col_idx ORDER BY raw IS NOT NULL DESC, amount <> 0 DESC, phase DESC, node_id DESC, kind DESC, line DESC, amount DESC) AS rn FROM every)
SELECT version_id, table_idx, row_idx, col_idx, CAST(amount AS {D}) AS amount, raw, unit, reason, node_id, item_id FROM best WHERE rn = 1
"""


def tables(spark, sf):
    cells = "CASE WHEN has_cells THEN map_from_arrays(sequence(1992, 2200), transform(sequence(1992, 2200), y -> y - 1985)) END AS year_cells, map_from_arrays(transform(sequence(996, 1100), y -> y * 2), transform(sequence(996, 1100), y -> 'r')) AS year_raw"
    nodes = bound(spark, sf, f"SELECT *, {cells}, CASE WHEN has_cells THEN 4 END AS total_cell, CAST(NULL AS STRING) AS total_raw, CASE WHEN table_idx = 1 THEN 'rub' ELSE 'thousand_rub' END AS unit, 2010 AS period_start, 2018 AS period_end FROM ({NODES})")
    return nodes, bound(spark, sf, LINES)


@query("cell_plan_full", PLAN_SQL)
def cell_plan_full(spark, sf):
    """P18 with ancestors, mirrors, summary rows, source rows and passports."""
    return cellplan.cell_plan(*tables(spark, sf), bound(spark, sf, PASSPORT), bound(spark, sf, CHANGED), bound(spark, sf, ADDED))


# a second source's rows change their customers and orders; orders that it lacks are new
TARGETED = "SELECT node_id, CAST(o_orderkey AS BIGINT) AS item_id, 'absolute' AS mode FROM target WHERE o_orderkey % 3 = 0 UNION ALL SELECT concat('O', o_orderkey), CAST(o_orderkey AS BIGINT), 'absolute' FROM target WHERE o_orderkey % 3 = 0"
LACKED = "SELECT concat('O', o_orderkey) AS node_id FROM orders WHERE o_orderkey % 7 = 0"


@query("cell_update_plan", PLAN_SQL.replace(CHANGED, TARGETED).replace(ADDED, LACKED))
def cell_update_plan(spark, sf):
    """P18 in all its steps for the rows of a second source: closure, summary rows, mirrors, year and total cells, source rows, passports, W10 and W11."""
    return cellplan.cell_plan(*tables(spark, sf), bound(spark, sf, PASSPORT), bound(spark, sf, TARGETED), bound(spark, sf, LACKED))


@query(
    "text_plan",
    f"""WITH nodes0 AS ({NODES}), p AS (SELECT node_id, min(year) AS a, max(year) AS b FROM ({LINES}) WHERE amount <> 0 GROUP BY 1)
    SELECT version_id, table_idx, row_idx, 2 AS col_idx, CASE WHEN a = b THEN CAST(a AS STRING) ELSE concat(a, '-', b) END AS text, 'execution_period' AS reason, node_id FROM nodes0 JOIN p USING (node_id)
    WHERE execution_period = '2012 - 2015' AND node_id IN (SELECT node_id FROM ({CHANGED}) WHERE mode = 'zeroing')
    UNION ALL SELECT version_id, table_idx, row_idx, 0, concat(display_number, CASE WHEN number_was = '9.9.' THEN '.' ELSE '' END), 'display_number', node_id FROM nodes0 WHERE number_was IS NOT NULL""",
)
def text_plan(spark, sf):
    return cellplan.text_plan(*tables(spark, sf), bound(spark, sf, CHANGED))
