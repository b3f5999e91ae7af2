"""Finance tables with a layout per row: customers are documents, their orders the rows of one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finance, positions
from .registry import bound, query

HEADS = """
  SELECT c_custkey AS doc_id, 1 AS table_idx, CAST(0 AS BIGINT) AS row_idx, 'Всего' AS total, CASE c_custkey % 4 WHEN 1 THEN '' ELSE CASE c_custkey % 4 WHEN 0 THEN '2027 год' ELSE '2027' END END AS six, CASE c_custkey % 4 WHEN 1 THEN '2027 год' ELSE '' END AS seven, 'a' AS kind FROM customer
  UNION ALL SELECT c_custkey, 1, 1, '5', CASE WHEN c_custkey % 4 = 0 THEN 'на 2028 год' ELSE '7' END, '8', CASE WHEN c_custkey % 4 = 0 THEN 'c' ELSE 'b' END FROM customer"""
BODY = "SELECT o_custkey AS doc_id, 1 AS table_idx, CAST(10 + o_orderkey AS BIGINT) AS row_idx, o_orderkey % 7 AS k, o_orderkey % 3 AS o, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) AS price, CAST(CAST(o_totalprice AS DECIMAL(20,2)) + 2 AS STRING) AS more, o_orderkey % 2 = 1 AS odd FROM orders"

SQL = f"""b AS (SELECT *, CASE k WHEN 0 THEN '1' WHEN 1 THEN '1.2' WHEN 5 THEN 'Итого по подпрограмме' WHEN 6 THEN '03.04' ELSE concat('1.2.', o) END AS number, k IN (0, 1, 2, 5) AS total FROM ({BODY})),
w AS (SELECT *, replace(number, '.', '-') AS slug, max(CASE WHEN k = 2 THEN row_idx END) OVER s AS last_total, min(CASE WHEN NOT total THEN row_idx END) OVER s AS first_source, max(CASE WHEN k = 0 THEN row_idx END) OVER t AS main_row, max(CASE WHEN k = 1 THEN row_idx END) OVER t AS act_row FROM b
  WINDOW s AS (PARTITION BY doc_id, number ORDER BY row_idx ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def tables(spark, sf):
    texts = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    heads = bound(spark, sf, HEADS)
    c = F.col("kind")
    first = texts("№ п/п", "Наименование мероприятия подпрограммы", "Срок", "Источник финансирования", F.col("total"), "2026 год", F.col("six"), F.col("seven"))
    heads = heads.select("doc_id", "table_idx", "row_idx", F.when(c == "a", first).when(c == "b", texts("1", "2", "3", "4", "5", "6", "7", "8")).otherwise(texts("", "", "", "", "", "", F.col("six"), "")).alias("cells"))
    k, money = F.col("k"), (F.col("price"), F.when(F.col("odd"), F.col("price")).otherwise(""), F.col("more"))
    row = lambda number, name, source: texts(number, name, "2026-2027", source, F.col("price"), *money)
    own = F.concat(F.lit("1.2."), "o", F.lit("."))
    whole = "Итого по подпрограмме"
    source = F.when(F.col("k") == 3, "900203").otherwise("Местный бюджет")
    cells = F.when(k == 0, row("1.", "Основное мероприятие", "Всего")).when(k == 1, row("1.2", "Мероприятие  01.02", "Итого")).when(k == 5, texts(whole, whole, whole, whole, "Всего", F.col("price"), *money))
    cells = cells.when(k == 6, row("", "Мероприятие 03.04. Ремонт", source)).when(k == 2, row(own, F.concat(F.lit("Объект "), "o"), "Всего")).otherwise(row(own, F.concat(F.lit("Объект  "), "o"), source))
    rows = heads.unionByName(bound(spark, sf, BODY).select("doc_id", "table_idx", "row_idx", cells.alias("cells")))
    keys = bound(spark, sf, "SELECT c_custkey AS doc_id, 1 AS table_idx, concat('subprogram:', c_nationkey) AS subprogram_key FROM customer")
    return finance.finance_rows(rows, keys)


@query(
    "finance_row_nodes",
    f"""WITH {SQL}, n AS (SELECT *, CASE k WHEN 0 THEN 'main_activity' WHEN 1 THEN 'activity' WHEN 5 THEN 'main_activity' ELSE 'object' END AS kind FROM w)
    SELECT n.doc_id, row_idx, CASE WHEN k = 5 THEN concat('main_activity:1:', row_idx, ':итого-по-подпрограмме') ELSE concat(kind, ':1:', row_idx, ':', slug) END AS key, kind AS node_type,
      CASE WHEN k IN (0, 5) THEN concat('subprogram:', c_nationkey) WHEN k IN (1, 6) THEN coalesce('main_activity:1:' || main_key, concat('subprogram:', c_nationkey)) ELSE coalesce(CASE WHEN act_row IS NOT NULL AND coalesce(act_row > main_any, true) THEN concat('activity:1:', act_row, ':1-2') END, 'main_activity:1:' || main_key, concat('subprogram:', c_nationkey)) END AS parent_key,
      CASE WHEN total THEN 'finance_table' ELSE 'finance_source_row' END AS source, CASE WHEN k = 5 THEN 5 ELSE 4 END AS total_cell,
      CASE doc_id % 4 WHEN 0 THEN '5=2026,6=2028' WHEN 1 THEN CASE WHEN k = 5 THEN '6=2026,7=2027' ELSE '5=2026,7=2027' END ELSE '5=2026,6=2027' END AS year_cells
    FROM (SELECT *, max(CASE WHEN k IN (0, 5) THEN row_idx END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS main_any,
      arg_max(CASE k WHEN 0 THEN concat(row_idx, ':1') ELSE concat(row_idx, ':итого-по-подпрограмме') END, row_idx) FILTER (k IN (0, 5)) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS main_key FROM n) n
    JOIN customer ON c_custkey = n.doc_id WHERE total OR (last_total IS NULL AND first_source = row_idx)""",
)
def finance_row_nodes(spark, sf):
    """The nodes of total rows and those that source rows open, with the columns of each row."""
    nodes, _ = tables(spark, sf)
    cells = F.array_join(F.transform(F.array_sort(F.map_entries("year_cells")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return nodes.select("doc_id", "row_idx", "key", "node_type", "parent_key", "source", F.col("total_cell").cast("int").alias("total_cell"), cells.alias("year_cells"))


@query(
    "finance_row_lines",
    f"""WITH {SQL}, y AS (SELECT * FROM (VALUES (0, 5, 2026), (0, 6, 2028), (1, 5, 2026), (1, 7, 2027), (2, 5, 2026), (2, 6, 2027), (3, 5, 2026), (3, 6, 2027)) v(c, cell, year))
    SELECT doc_id, row_idx, concat('object:1:', coalesce(last_total, first_source), ':', slug) AS node_key, year, CASE WHEN k = 3 THEN 'FEDERAL_BUDGET' ELSE 'LOCAL_BUDGET' END AS source_type, CAST(CAST(CASE WHEN cell = 7 THEN more ELSE price END AS DECIMAL(20,2)) * 1000 AS DECIMAL(20,2)) AS amount, cell, 4 AS total_cell
    FROM w JOIN y ON c = doc_id % 4 WHERE NOT total AND (cell <> 6 OR odd)""",
)
def finance_row_lines(spark, sf):
    """C14: each source row's lines go to the node of its own number and name."""
    _, lines = tables(spark, sf)
    return lines.select("doc_id", "row_idx", "node_key", "year", "source_type", "amount", F.col("cell").cast("int").alias("cell"), F.col("total_cell").cast("int").alias("total_cell"))


# one fragment a line item: orders are places of a page; the kind's columns are 20 apart
PLACED = "SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'wide' ELSE 'narrow' END AS kind, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_suppkey % 17 + l_linenumber % 4 * 0.25 AS DOUBLE) AS y, CASE WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN l_partkey % 3 = 1 THEN concat('word', l_partkey % 50, CASE WHEN l_suppkey % 2 = 0 THEN '.' ELSE '' END) ELSE concat('на ', l_partkey % 50) END AS text FROM lineitem"
CENTRES = "SELECT 'wide' AS kind, CAST(r_regionkey AS INT) AS col, r_regionkey * 20.0 AS centre FROM region UNION ALL SELECT 'narrow', CAST(r_regionkey AS INT), r_regionkey * 12.0 + 5 FROM region"


@query(
    "nearest_columns",
    f"SELECT doc_id, x, col, count(*) AS n FROM (SELECT p.*, c.col, row_number() OVER (PARTITION BY p.id ORDER BY abs(x - centre), c.col) AS rn FROM (SELECT *, row_number() OVER () AS id FROM ({PLACED})) p JOIN ({CENTRES}) c ON c.kind = p.kind AND abs(x - CAST(centre AS DOUBLE)) <= 8.5) WHERE rn = 1 GROUP BY ALL",
)
def nearest_columns(spark, sf):
    """D19."""
    return positions.nearest_column(bound(spark, sf, PLACED), bound(spark, sf, CENTRES)).groupBy("doc_id", "x", "col").agg(F.count("*").alias("n"))


LINES_SQL = f"""frags AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, text) AS rn FROM ({PLACED})),
fold AS (SELECT doc_id, rn, y AS first_y, 0 AS line_no, x, text FROM frags WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.rn, CASE WHEN abs(first_y - i.y) > 3 THEN i.y ELSE first_y END, line_no + CASE WHEN abs(first_y - i.y) > 3 THEN 1 ELSE 0 END, i.x, i.text FROM fold f JOIN frags i ON i.doc_id = f.doc_id AND i.rn = f.rn + 1),
joined AS (SELECT doc_id, line_no, string_agg(text, '' ORDER BY x, text) AS text FROM fold GROUP BY ALL)"""


@query("position_lines", f"WITH RECURSIVE {LINES_SQL} SELECT doc_id, line_no, text FROM joined")
def position_lines(spark, sf):
    """Lines by the distance to a line's first fragment."""
    return positions.text_lines(bound(spark, sf, PLACED), ["doc_id"])


@query(
    "position_texts",
    f"""WITH RECURSIVE {LINES_SQL}, texts AS (SELECT doc_id, line_no, trim(text) AS text FROM joined WHERE line_no = 0
      UNION ALL SELECT j.doc_id, j.line_no, concat(t.text, CASE WHEN starts_with(trim(j.text), 'на ') OR ends_with(t.text, '.') THEN ' ' ELSE '' END, trim(j.text)) FROM texts t JOIN joined j ON j.doc_id = t.doc_id AND j.line_no = t.line_no + 1)
    SELECT doc_id, arg_max(text, line_no) AS text FROM texts GROUP BY 1""",
)
def position_texts(spark, sf):
    """A place's lines as one text."""
    return positions.cell_texts(positions.text_lines(bound(spark, sf, PLACED), ["doc_id"]), ["doc_id"])


PARAS = """SELECT o_custkey AS doc_id, o_orderkey AS para_idx, concat(CASE o_orderkey % 3 WHEN 0 THEN 'Муниципальная  программа ' WHEN 1 THEN 'Программа ' ELSE 'Подпрограмма муниципалитета ' END, CASE o_orderkey % 4 WHEN 0 THEN concat('«Имя ', o_orderkey, '»') WHEN 1 THEN concat('"Имя ', o_orderkey, '"') ELSE 'без имени' END, CASE WHEN o_orderkey % 5 < 2 THEN concat(' на 20', 10 + o_orderkey % 80, ' – 20', 11 + o_orderkey % 80, ' годы') ELSE '' END) AS text FROM orders"""


@query(
    "program_description",
    f"""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS i, CASE WHEN o_orderkey % 4 < 2 THEN concat('Имя ', o_orderkey) END AS name, CASE WHEN o_orderkey % 5 < 2 THEN 2010 + o_orderkey % 80 END AS a FROM orders WHERE o_orderkey % 3 <> 1),
    s AS (SELECT doc_id, CASE WHEN min(i) FILTER (name IS NOT NULL) IS NOT NULL AND min(i) FILTER (a IS NOT NULL) IS NOT NULL THEN greatest(min(i) FILTER (name IS NOT NULL), min(i) FILTER (a IS NOT NULL)) END AS stop FROM p GROUP BY 1)
    SELECT doc_id, arg_min(name, i) FILTER (name IS NOT NULL) AS name, CAST(arg_max(a, i) FILTER (a IS NOT NULL) AS INT) AS period_start, CAST(arg_max(a, i) FILTER (a IS NOT NULL) + 1 AS INT) AS period_end FROM p JOIN s USING (doc_id) WHERE stop IS NULL OR i <= stop GROUP BY 1 HAVING count(name) + count(a) > 0""",
)
def program_description(spark, sf):
    """Only paragraphs about a municipal program."""
    return positions.program_description(bound(spark, sf, PARAS))
