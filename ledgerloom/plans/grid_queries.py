"""Queries of the grid operators. An order is a document, its lines are rows; texts are made from their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from .registry import bound, query

D = "DECIMAL(20,2)"
MONEY = f"CAST(l_extendedprice AS {D})"
# row 0: a title; rows 1 and 2: the header; row 3: column numbers; from row 10: lines
CELLS = f"""SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS row_idx, CAST(0 AS INT) AS col_idx, concat('План на ', year(o_orderdate) + 10, ' год') AS text FROM orders
  UNION ALL SELECT o_orderkey, CAST(h.r AS INT), CAST(h.c AS INT), CASE WHEN h.t = 'Y' THEN concat(year(o_orderdate) + 10, ' год') ELSE h.t END FROM orders,
    (SELECT 1 AS r, 0 AS c, 'Наименование' AS t UNION ALL SELECT 1, 1, 'Код' UNION ALL SELECT 1, 2, 'Y' UNION ALL SELECT 1, 3, '' UNION ALL SELECT 1, 4, 'Очередной год' UNION ALL SELECT 1, 5, 'Фактически'
     UNION ALL SELECT 2, 2, 'Всего' UNION ALL SELECT 2, 3, 'Федеральный бюджет' UNION ALL SELECT 2, 4, '' UNION ALL SELECT 3, 0, '1' UNION ALL SELECT 3, 1, '2' UNION ALL SELECT 3, 2, '3') h
  UNION ALL SELECT l_orderkey, CAST(10 + l_linenumber AS INT), CAST(v.c AS INT), CASE v.c WHEN 0 THEN concat('Объект ', l_partkey) WHEN 1 THEN CAST(l_suppkey AS STRING) WHEN 2 THEN CAST({MONEY} AS STRING) WHEN 3 THEN CASE WHEN l_partkey % 3 = 0 THEN '-' ELSE CAST({MONEY} AS STRING) END ELSE CASE WHEN l_partkey % 2 = 0 THEN '' ELSE CAST({MONEY} AS STRING) END END
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey, l_linenumber), (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) v"""
L1 = f"l AS (SELECT l_orderkey AS doc_id, CAST(10 + l_linenumber AS INT) AS row_idx, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_extendedprice) AS {D}) AS amount, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def cells(spark, sf):
    return bound(spark, sf, CELLS)


def layout(spark, sf):
    c = cells(spark, sf)
    return g.amount_columns(g.header_text(c.where("row_idx < 10"), g.detect_header(c, within=6)), g.base_year(c))


@query("header_rows", "SELECT o_orderkey AS doc_id, CAST(r AS INT) AS row_idx FROM orders, (SELECT unnest([1, 2]) AS r)")
def header_rows(spark, sf):
    return g.detect_header(cells(spark, sf))


@query("header_layout", "SELECT o_orderkey AS doc_id, CAST(c AS INT) AS col_idx, CASE c WHEN 0 THEN 'Наименование' WHEN 1 THEN 'Код' WHEN 2 THEN concat(year(o_orderdate) + 10, ' год Всего') WHEN 3 THEN 'Федеральный бюджет' WHEN 4 THEN 'Очередной год' ELSE 'Фактически' END AS header FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c)")
def header_layout(spark, sf):
    c = cells(spark, sf)
    return g.header_text(c, g.detect_header(c))


@query("amount_columns", "SELECT o_orderkey AS doc_id, CAST(c AS INT) AS col_idx, CAST(year(o_orderdate) + 10 + CASE WHEN c = 4 THEN 1 ELSE 0 END AS INT) AS year, CASE WHEN c = 3 THEN 'FEDERAL_BUDGET' ELSE 'UNKNOWN' END AS source_type, c <> 3 AS needs_row_source FROM orders, (SELECT unnest([2, 3, 4]) AS c)")
def amount_columns(spark, sf):
    return layout(spark, sf)


@query("base_year", "SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) + 10 AS INT) AS base_year FROM orders")
def base_year(spark, sf):
    return g.base_year(cells(spark, sf))


@query(
    "unpivot_funding",
    f"""WITH {L1}, y AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) + 10 AS INT) AS y FROM orders)
    SELECT doc_id, row_idx, y AS year, 'FEDERAL_BUDGET' AS source_type, amount FROM l JOIN y USING (doc_id) WHERE p % 3 <> 0 AND amount <> 0
    UNION ALL SELECT doc_id, row_idx, y, 'LOCAL_BUDGET', amount FROM l JOIN y USING (doc_id) WHERE p % 3 = 0 AND amount <> 0
    UNION ALL SELECT doc_id, row_idx, y + 1, 'LOCAL_BUDGET', amount FROM l JOIN y USING (doc_id) WHERE p % 3 = 0 AND p % 2 <> 0 AND amount <> 0""",
)
def unpivot_funding(spark, sf):
    c = cells(spark, sf).where("row_idx >= 10")
    sources = c.select("doc_id", "row_idx").distinct().withColumn("row_source", F.lit("LOCAL_BUDGET"))
    return g.unpivot_funding(c, layout(spark, sf), sources)


@query("total_columns", f"WITH {L1}, y AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) + 10 AS INT) AS y FROM orders) SELECT doc_id, y AS year, arg_max(amount, row_idx) AS amount FROM l JOIN y USING (doc_id) WHERE amount <> 0 GROUP BY ALL UNION ALL SELECT doc_id, y + 1, arg_max(amount, row_idx) FROM l JOIN y USING (doc_id) WHERE amount <> 0 AND p % 2 <> 0 GROUP BY ALL")
def total_columns(spark, sf):
    return g.total_columns(cells(spark, sf).where("row_idx >= 10"), layout(spark, sf))


@query("explicit_zero_rows", f"WITH {L1} SELECT doc_id, row_idx FROM l WHERE p % 6 = 0")
def explicit_zero_rows(spark, sf):
    return g.explicit_zero_rows(cells(spark, sf).where("row_idx >= 10"), layout(spark, sf).where("col_idx >= 3"))


@query("row_fields", f"WITH {L1} SELECT doc_id, row_idx, concat('Объект ', p) AS name, CAST(s AS STRING) AS object_code FROM l")
def row_fields(spark, sf):
    c = cells(spark, sf).where("row_idx >= 10")
    docs = c.select("doc_id").distinct()
    roles = docs.select("doc_id", F.lit(0).alias("col_idx"), F.lit("name").alias("role")).unionByName(docs.select("doc_id", F.lit(1).alias("col_idx"), F.lit("object_code").alias("role")))
    return g.row_fields(c, roles).select("doc_id", "row_idx", "name", "object_code")


@query("fill_merged", "SELECT o_orderkey AS doc_id, CAST(r AS INT) AS row_idx, CASE r WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority ELSE 'own' END AS text FROM orders, (SELECT unnest([0, 1, 2]) AS r)")
def fill_merged(spark, sf):
    c = bound(spark, sf, "SELECT o_orderkey AS doc_id, v.r AS row_idx, 0 AS col_idx, CASE v.r WHEN 0 THEN o_orderpriority WHEN 1 THEN '' ELSE 'own' END AS text FROM orders, (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) v")
    ranges = bound(spark, sf, "SELECT o_orderkey AS doc_id, 0 AS row_from, 2 AS row_to, 0 AS col_from, 0 AS col_to FROM orders")
    return g.fill_merged(c, ranges).select("doc_id", "row_idx", "text")


TABLES = "SELECT o_custkey AS doc_id, o_orderkey AS table_idx, 0 AS row_idx, 0 AS col_idx, CASE WHEN o_orderkey % 3 = 0 THEN 'Источник' ELSE 'Прочее' END AS text FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, 5, '2026' FROM orders"


@query("finance_tables", "SELECT o_custkey AS doc_id, o_orderkey AS table_idx, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS ordinal FROM orders WHERE o_orderkey % 3 = 0")
def finance_tables(spark, sf):
    return g.finance_tables(bound(spark, sf, TABLES))


@query("finance_layout", "SELECT o_custkey AS doc_id, CAST(year(o_orderdate) + 10 AS INT) AS year, arg_min(o_orderkey % 9 + 5, o_orderkey) AS col_idx FROM orders GROUP BY ALL")
def finance_layout(spark, sf):
    c = bound(spark, sf, "SELECT o_custkey AS doc_id, o_orderkey AS row_idx, o_orderkey % 9 + 5 AS col_idx, concat(year(o_orderdate) + 10, ' год') AS text FROM orders")
    return g.finance_layout(c)


TREE = "SELECT l_orderkey AS doc_id, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS row_idx, CASE l_partkey % 3 WHEN 0 THEN '1.' WHEN 1 THEN '1.1' ELSE '1.1.1' END AS number, concat('row ', l_partkey) AS name, l_partkey, l_extendedprice FROM lineitem"
TREE_SQL = f"""t AS (SELECT DISTINCT doc_id, row_idx, l_partkey % 3 AS k, concat(CASE l_partkey % 3 WHEN 0 THEN 'main_activity:1:' WHEN 1 THEN 'activity:1.1:' ELSE 'object:1.1.1:' END, 'row-', l_partkey) AS key FROM ({TREE})),
  u AS (SELECT *, last_value(CASE WHEN k = 0 THEN key END IGNORE NULLS) OVER w AS main, last_value(CASE WHEN k = 0 THEN row_idx END IGNORE NULLS) OVER w AS mr, last_value(CASE WHEN k = 1 THEN key END IGNORE NULLS) OVER w AS act, last_value(CASE WHEN k = 1 THEN row_idx END IGNORE NULLS) OVER w AS ar FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT doc_id, row_idx, CASE k WHEN 0 THEN 'main_activity' WHEN 1 THEN 'activity' ELSE 'object' END AS node_type, key, CASE k WHEN 2 THEN coalesce(CASE WHEN coalesce(ar, -1) > coalesce(mr, -1) THEN act END, main) WHEN 1 THEN main END AS parent_key FROM u)"""


@query("finance_tree", f"WITH {TREE_SQL} SELECT * FROM v")
def finance_tree(spark, sf):
    return g.finance_tree(bound(spark, sf, TREE).select("doc_id", "row_idx", "number", "name").distinct())


@query("node_dedup", f"WITH {TREE_SQL} SELECT doc_id, key, min(row_idx) AS row_idx FROM v GROUP BY ALL")
def node_dedup(spark, sf):
    nodes = g.finance_tree(bound(spark, sf, TREE).select("doc_id", "row_idx", "number", "name").distinct())
    return g.node_dedup(nodes).select("doc_id", "key", "row_idx")


SOURCE_ROWS = "SELECT o_orderkey AS doc_id, o_custkey AS row_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'федеральный бюджет' ELSE 'местный бюджет' END AS source, CAST(o_totalprice AS DECIMAL(20,2)) AS amount FROM orders"


@query("finance_lines", "SELECT o_orderkey AS doc_id, o_custkey AS row_idx, concat('node', CASE WHEN o_custkey >= 100 THEN 100 ELSE 0 END) AS node_key, CASE WHEN o_orderkey % 2 = 0 THEN 'FEDERAL_BUDGET' ELSE 'LOCAL_BUDGET' END AS source_type, CAST(o_totalprice AS DECIMAL(20,2)) AS amount FROM orders")
def finance_lines(spark, sf):
    nodes = bound(spark, sf, "SELECT o_orderkey AS doc_id, CAST(v.r AS BIGINT) AS row_idx, concat('node', v.r) AS key FROM orders, (SELECT 0 AS r UNION ALL SELECT 100) v")
    return g.finance_lines(bound(spark, sf, SOURCE_ROWS), nodes)


@query("shifted_rows", "SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS shift FROM orders")
def shifted_rows(spark, sf):
    x = F.concat(F.lit("Объект "), "o_custkey")
    fifth = F.when(F.col("doc_id") % 2 == 0, "Всего").otherwise("12,5")
    df = bound(spark, sf, "SELECT o_orderkey AS doc_id, o_custkey FROM orders").withColumn("cells", F.array(x, x, x, F.when(F.col("doc_id") % 4 == 0, x).otherwise("другое"), fifth))
    return g.shifted_rows(df).select("doc_id", "shift")


PARAS = "SELECT o_custkey AS doc_id, o_orderkey AS para_idx, CASE WHEN o_orderkey % 3 = 0 THEN concat('Подпрограмма ', o_orderkey % 5, ' «Имя ', o_orderkey, '» на 2024-2028') ELSE 'Текст без имён' END AS text FROM orders"


@query("subprograms", "SELECT o_custkey AS doc_id, CAST(o_orderkey % 5 AS INT) AS number, concat('Имя ', min(o_orderkey)) AS name FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def subprograms(spark, sf):
    return g.subprograms(bound(spark, sf, PARAS))


@query("program_metadata", "SELECT o_custkey AS doc_id, concat('Имя ', min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END)) AS program_name, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN '2024-2028' END AS period FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 3 = 0)")
def program_metadata(spark, sf):
    return g.program_metadata(bound(spark, sf, PARAS)).where("program_name is not null")


CHANGES = "SELECT o_custkey AS doc_id, o_orderkey AS page_number, concat('Общие слова. Увеличить на ', o_orderkey, ' тыс. руб в 2026 году по объекту: Школа ', o_custkey, ', далее! Конец.') AS text FROM orders"


@query("text_changes", "SELECT o_custkey AS doc_id, o_orderkey AS page_number, CAST(CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN o_orderkey ELSE 2026 END AS INT) AS year, 'delta_plus' AS mode, concat('Школа ', o_custkey) AS object_name FROM orders")
def text_changes(spark, sf):
    return g.text_changes(bound(spark, sf, CHANGES.replace(" тыс. руб", " тыс руб"))).drop("position")


@query("word_windows", "WITH w AS (SELECT doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM documents WHERE doc_id < 1000000000) SELECT doc_id, count(*) AS windows, CAST(sum(least(120, n - s)) AS BIGINT) AS words FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 80)) AS s FROM w) GROUP BY 1")
def word_windows(spark, sf):
    return g.word_windows(bound(spark, sf, "SELECT doc_id, text FROM documents")).groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum("n_words").alias("words"))


FRAGMENTS = "SELECT l_orderkey AS doc_id, l_returnflag AS kind, l_quantity AS x, CAST(l_linenumber * 4 AS DOUBLE) AS y, CAST(l_partkey AS STRING) AS text FROM lineitem"


@query("range_fragments", f"SELECT doc_id, floor(x / 10) AS col, count(*) AS n FROM ({FRAGMENTS}) WHERE x < 60 GROUP BY ALL".replace("floor(x / 10) AS col", "CAST(floor(x / 10) AS BIGINT) AS col"))
def range_fragments(spark, sf):
    lay = bound(spark, sf, "SELECT k.kind, v.c AS col, v.c * 10.0 AS x_min, v.c * 10.0 + 10.0 AS x_max FROM (SELECT DISTINCT l_returnflag AS kind FROM lineitem) k, (SELECT CAST(r_regionkey AS BIGINT) AS c FROM region UNION ALL SELECT 5 FROM region WHERE r_regionkey = 0) v")
    return g.fragment_columns(bound(spark, sf, FRAGMENTS).where("x < 60"), F.broadcast(lay)).groupBy("doc_id", "col").agg(F.count("*").alias("n"))


@query("position_table", f"SELECT doc_id, CAST(floor(y / 5) AS BIGINT) AS band, col, string_agg(text, '' ORDER BY x, text) AS text FROM (SELECT *, CAST(x >= 25 AS INT) AS col FROM ({FRAGMENTS})) GROUP BY ALL")
def position_table(spark, sf):
    return g.position_table(bound(spark, sf, FRAGMENTS).withColumn("col", (F.col("x") >= 25).cast("int")))


@query("change_dedup", "SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS page_number FROM orders GROUP BY ALL")
def change_dedup(spark, sf):
    df = bound(spark, sf, "SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey AS page_number, 0 AS position FROM orders")
    return g.change_dedup(df, ["o_custkey", "y"]).drop("position")


@query("document_profile", "WITH p AS (SELECT l_orderkey AS doc_id, count(DISTINCT year(l_shipdate)) AS years, count(DISTINCT l_returnflag) AS sources, count(*) FILTER (l_quantity > 45) AS bad FROM lineitem GROUP BY 1) SELECT doc_id, years, sources, concat_ws(',', CASE WHEN sources < 2 THEN 'few_sources' END, CASE WHEN bad > 0 THEN 'bad_amounts' END) AS warnings, CAST(0.95 - 0.15 * (CAST(sources < 2 AS INT) + CAST(bad > 0 AS INT)) AS DECIMAL(5,4)) AS confidence, sources >= 2 AND bad = 0 AS active FROM p")
def document_profile(spark, sf):
    return g.document_profile(bound(spark, sf, f"SELECT l_orderkey AS doc_id, year(l_shipdate) AS year, l_returnflag AS source_type, CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_extendedprice AS {D}) END AS amount FROM lineitem"))


@query("numbered_batch", f"SELECT o_orderkey AS command_id, n, CAST(2024 + n AS INT) AS year, CAST(CASE n WHEN 1 THEN o_orderkey ELSE o_custkey END * 1000 AS {D}) AS amount FROM orders, (SELECT unnest([1, 2]) AS n)")
def numbered_batch(spark, sf):
    return g.numbered_batch(bound(spark, sf, "SELECT o_orderkey AS command_id, concat('1) в 2025 году ', o_orderkey, ' тыс. 2) в 2026 году ', o_custkey, ' тыс.') AS text FROM orders"))


@query("result_nodes", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_idx, concat('result:1:', 'part-', min(l_partkey)) AS key FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey, l_linenumber HAVING l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def result_nodes(spark, sf):
    df = bound(spark, sf, "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_idx, '1.' AS number, CASE WHEN l_linenumber = 1 THEN 'Наименование результата' ELSE concat('part ', min(l_partkey)) END AS name FROM lineitem GROUP BY l_orderkey, l_linenumber")
    return g.result_nodes(df)


@query("build_target", f"WITH {L1}, y AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) + 10 AS INT) AS y FROM orders) SELECT doc_id, y AS year, 'FEDERAL_BUDGET' AS source_type, CAST(sum(amount) AS {D}) AS amount FROM l JOIN y USING (doc_id) WHERE p % 3 <> 0 AND amount <> 0 GROUP BY ALL")
def build_target(spark, sf):
    c = cells(spark, sf)
    sources = c.select("doc_id", "row_idx").distinct().withColumn("row_source", F.lit("LOCAL_BUDGET"))
    funding, _ = g.build_target(c, sources, 10)
    return funding.where("source_type = 'FEDERAL_BUDGET'").groupBy("doc_id", "year", "source_type").agg(F.sum("amount").cast("decimal(20,2)").alias("amount"))


@query("build_tree", f"WITH {TREE_SQL}, d AS (SELECT DISTINCT doc_id, key FROM v) SELECT doc_id, count(*) AS nodes FROM d GROUP BY 1")
def build_tree(spark, sf):
    lines = bound(spark, sf, "SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS row_idx, 'x' AS source, CAST(0 AS DECIMAL(20,2)) AS amount FROM lineitem")
    nodes, _ = g.build_tree(bound(spark, sf, TREE).select("doc_id", "row_idx", "number", "name").distinct(), lines)
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))


@query("build_patch", "SELECT o_custkey AS doc_id, concat('Школа ', o_custkey) AS object_name, CAST(CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN o_orderkey ELSE 2026 END AS INT) AS year, min(o_orderkey) AS page_number FROM orders GROUP BY ALL")
def build_patch(spark, sf):
    """Amounts that look like years count as the year."""
    return g.build_patch(bound(spark, sf, CHANGES.replace(" тыс. руб", " тыс руб"))).select("doc_id", "object_name", "year", "page_number")
