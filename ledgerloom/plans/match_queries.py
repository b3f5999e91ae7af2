"""Queries of matching, planning, search and chat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as x
from ..operators import planning as q
from ..operators import search
from .registry import bound, query, rows, scratch

D = "DECIMAL(20,2)"
SUM = f"CAST(sum(amount) AS {D})"

# parts stand for nodes, their brands for blocks; groups are the same names, some without a code, some renamed
NODES = "SELECT concat('P', p_partkey) AS node_id, p_brand AS block, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN concat('K', p_partkey) END AS code, p_type, p_size FROM part"
GROUPS = "SELECT concat('G', p_partkey) AS group_key, p_brand AS block, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' x') ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN concat('K', p_partkey) WHEN p_partkey % 6 = 1 THEN 'K0' END AS code FROM part"
NORM = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"
N_SQL = f"n AS (SELECT *, {NORM} AS norm FROM ({NODES})), g AS (SELECT *, {NORM} AS norm FROM ({GROUPS}))"
CODE_SQL = "c AS (SELECT group_key, min(node_id) AS node_id, 'MATCH_EXACT_CODE' AS match_status, 1.0 AS confidence FROM g JOIN n USING (block, code) WHERE code IS NOT NULL GROUP BY 1)"
ONE = "CASE WHEN count(DISTINCT node_id) = 1 THEN min(node_id) END AS node_id, CASE WHEN count(DISTINCT node_id) = 1 THEN '{0}' ELSE 'NEEDS_CONFIRMATION' END AS match_status, CASE WHEN count(DISTINCT node_id) = 1 THEN 1.0 ELSE 0.5 END AS confidence"
EXACT_SQL = f"e AS (SELECT group_key, {ONE.format('MATCH_EXACT_NAME')} FROM g JOIN n USING (block, norm) GROUP BY 1)"
GLOBAL_SQL = f"l AS (SELECT group_key, {ONE.format('MATCH_EXACT_NAME_GLOBAL')} FROM g JOIN (SELECT node_id, norm FROM n) USING (norm) WHERE code IS NULL GROUP BY 1)"
OUT = "group_key, node_id, match_status, CAST(confidence AS DOUBLE) AS confidence"


def sides(spark, sf):
    n = x.named(bound(spark, sf, NODES), F.col("name")).withColumn("codes", F.array("code"))
    return x.named(bound(spark, sf, GROUPS), F.col("name")), n


@query("match_code", f"WITH {N_SQL}, {CODE_SQL} SELECT {OUT} FROM c")
def match_code(spark, sf):
    return x.match_code(*sides(spark, sf))


@query("match_exact", f"WITH {N_SQL}, {EXACT_SQL} SELECT {OUT} FROM e")
def match_exact(spark, sf):
    return x.match_exact_name(*sides(spark, sf))


@query("match_global", f"WITH {N_SQL}, {GLOBAL_SQL} SELECT {OUT} FROM l")
def match_global(spark, sf):
    return x.match_global_name(*sides(spark, sf))


@query(
    "match_cascade",
    f"""WITH {N_SQL}, {CODE_SQL}, {EXACT_SQL}, {GLOBAL_SQL}
    SELECT g.group_key, CASE WHEN c.group_key IS NOT NULL THEN c.node_id WHEN e.group_key IS NOT NULL THEN e.node_id ELSE l.node_id END AS node_id, coalesce(c.match_status, e.match_status, l.match_status, 'MISSING_IN_DOCX') AS match_status, CAST(coalesce(c.confidence, e.confidence, l.confidence, 0.0) AS DOUBLE) AS confidence
    FROM g LEFT JOIN c USING (group_key) LEFT JOIN e USING (group_key) LEFT JOIN l USING (group_key)""",
)
def match_cascade(spark, sf):
    g, n = sides(spark, sf)
    return x.match_cascade(g, [x.match_code(g, n), x.match_exact_name(g, n), x.match_global_name(g, n)])


@query("parent_scope", f"SELECT group_key, count(*) AS candidates FROM ({GROUPS}) JOIN ({NODES}) USING (block) GROUP BY 1")
def parent_scope(spark, sf):
    g, n = sides(spark, sf)
    return x.scope_sizes(g.select("group_key", "block"), n.select("node_id", "block"))


PAIRED_SQL = f"""p AS (SELECT g.group_key, n.node_id, n.p_size > 10 AS is_leaf, contains(n.norm, g.norm) AS held, list_filter(list_distinct(string_split(g.norm, ' ')), lambda w: length(w) > 1) AS l, list_filter(list_distinct(string_split(n.norm, ' ')), lambda w: length(w) > 1) AS r FROM g JOIN n USING (block)),
    o AS (SELECT group_key, node_id, is_leaf, held, round(len(list_filter(l, lambda a: len(list_filter(r, lambda b: starts_with(a, b) OR starts_with(b, a))) > 0)) / CAST(greatest(len(l), len(r), 1) AS DOUBLE), 4) AS overlap FROM p)"""


def _match(a, b):
    return f"({a} = {b} OR length({a}) >= 5 AND starts_with({b}, {a}) OR length({b}) >= 5 AND starts_with({a}, {b}) OR least(length({a}), length({b})) >= 6 AND left({a}, CAST(ceil(least(length({a}), length({b})) * 0.75) AS INT)) = left({b}, CAST(ceil(least(length({a}), length({b})) * 0.75) AS INT)))"


# names have two words, so the greedy match is two steps
GREEDY_SQL = f"""gp AS (SELECT group_key, node_id, l, r, list_filter(range(1, len(r) + 1), lambda i: {_match("l[1]", "r[i]")})[1] AS p1 FROM p),
    gn AS (SELECT group_key, node_id, l, r, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE CAST(p1 IS NOT NULL AS INT) + CAST(len(l) > 1 AND len(list_filter(range(1, len(r) + 1), lambda i: i IS DISTINCT FROM p1 AND {_match("l[2]", "r[i]")})) > 0 AS INT) END AS n FROM gp),
    gs AS (SELECT group_key, node_id, round(greatest(n / CAST(greatest(len(l), len(r), 1) AS DOUBLE), 0.98 * n / CAST(greatest(len(l), 1) AS DOUBLE)), 4) AS score FROM gn),
    gk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM gs WINDOW w AS (PARTITION BY group_key ORDER BY score DESC, node_id))"""


@query(
    "match_fuzzy_greedy",
    f"""WITH {N_SQL}, {PAIRED_SQL}, {GREEDY_SQL}, f AS (SELECT *, second IS NULL OR score - second > 0.05 AS clear FROM gk WHERE rn = 1 AND score >= 0.6)
    SELECT group_key, CASE WHEN clear THEN node_id END AS node_id, CASE WHEN clear THEN 'MATCH_FUZZY_CONFIDENT' ELSE 'NEEDS_CONFIRMATION' END AS match_status, CAST(CASE WHEN clear THEN score ELSE 0.5 END AS DOUBLE) AS confidence FROM f""",
)
def match_fuzzy_greedy(spark, sf):
    return x.match_fuzzy(*sides(spark, sf), threshold=0.6)


@query(
    "match_event_name",
    f"""WITH {N_SQL}, {PAIRED_SQL}, {GREEDY_SQL}, s AS (SELECT group_key, node_id, CASE WHEN held THEN 0.95 ELSE score END AS score FROM gs JOIN p USING (group_key, node_id)), k AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY group_key ORDER BY score DESC, node_id))
    SELECT group_key, node_id, 'MATCH_PDF_EVENT_NAME' AS match_status, CAST(score AS DOUBLE) AS confidence FROM k WHERE rn = 1 AND score >= 0.45 AND (second IS NULL OR second < score)""",
)
def match_event_name(spark, sf):
    return x.match_event_name(*sides(spark, sf))


@query(
    "match_residual_parent",
    f"""WITH {N_SQL}, {PAIRED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY overlap DESC, node_id) AS rn FROM o WHERE overlap >= 0.45)
    SELECT group_key, node_id, 'MATCH_RESIDUAL_PARENT' AS match_status, CAST(overlap AS DOUBLE) AS confidence FROM k WHERE rn = 1 AND is_leaf""",
)
def match_residual_parent(spark, sf):
    g, n = sides(spark, sf)
    return x.match_residual_parent(g, n.withColumn("is_leaf", F.col("p_size") > 10))


PARENT = "SELECT concat('G', o_custkey) AS group_key, concat('C', o_custkey) AS parent_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS amount FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY o_custkey, year(o_orderdate)"


@query(
    "match_residual_total",
    f"""WITH w AS ({PARENT}), h AS (SELECT node_id, year, source_type, {SUM} AS have FROM current GROUP BY ALL),
    a AS (SELECT group_key, parent_id, count(*) AS n FROM w JOIN h ON h.node_id = parent_id AND h.year = w.year AND h.source_type = w.source_type WHERE amount = have GROUP BY ALL)
    SELECT group_key, parent_id AS node_id, 'MATCH_RESIDUAL_PARENT_TOTAL' AS match_status, CAST(1.0 AS DOUBLE) AS confidence FROM a
    WHERE n = (SELECT count(*) FROM w WHERE w.group_key = a.group_key) AND n = (SELECT count(*) FROM h WHERE h.node_id = a.parent_id)""",
)
def match_residual_total(spark, sf):
    lines = rows(spark, sf, "current").groupBy("node_id", "year", "source_type").agg(F.sum("amount").cast("decimal(20,2)").alias("amount"))
    return x.match_parent_total(bound(spark, sf, PARENT), lines)


@query(
    "match_activity_aggregate",
    """SELECT concat('G', n_nationkey) AS group_key, concat('N', n_nationkey) AS node_id, 'MATCH_ACTIVITY_AGGREGATE' AS match_status, CAST(1.0 AS DOUBLE) AS confidence FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT concat('G', a.n_nationkey), min(concat('N', b.n_nationkey)), 'MATCH_ACTIVITY_AGGREGATE', CAST(1.0 AS DOUBLE) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND contains(lower(b.n_name), lower(a.n_name)) WHERE a.n_nationkey % 2 = 1 GROUP BY a.n_nationkey HAVING count(*) = 1""",
)
def match_activity_aggregate(spark, sf):
    g = bound(spark, sf, "SELECT concat('G', n_nationkey) AS group_key, n_regionkey AS block, CASE WHEN n_nationkey % 2 = 0 THEN concat('A', n_nationkey) END AS parent_code, lower(n_name) AS norm FROM nation")
    a = bound(spark, sf, "SELECT concat('N', n_nationkey) AS node_id, n_regionkey AS block, concat('A', n_nationkey) AS code, lower(n_name) AS norm FROM nation")
    return x.match_activity_aggregate(g, a)


SCORED = "SELECT concat('S', l_suppkey) AS group_key, concat('P', l_partkey) AS node_id, CAST(sum(l_quantity) AS DOUBLE) AS score, concat(l_partkey % 10, '') AS display_number FROM lineitem GROUP BY l_suppkey, l_partkey"


@query("topk_candidates", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_key ORDER BY score DESC, display_number, node_id) AS INT) AS rank FROM ({SCORED})) WHERE rank <= 10")
def topk_candidates(spark, sf):
    return x.topk_candidates(bound(spark, sf, SCORED))


@query("rank_candidates", f"SELECT group_key, node_id, CAST(row_number() OVER w AS INT) AS rank, lead(score) OVER w AS second FROM ({SCORED}) WINDOW w AS (PARTITION BY group_key ORDER BY score DESC, node_id)")
def rank_candidates(spark, sf):
    return x.rank_candidates(bound(spark, sf, SCORED)).select("group_key", "node_id", "rank", "second")


CONTEXT = "SELECT l_orderkey AS doc_id, l_linenumber * 100000000 + l_partkey * 100 + l_suppkey % 100 AS row_idx, l_returnflag AS class_code, concat('n', l_partkey) AS name, l_quantity > 25 AS usable, l_suppkey, l_extendedprice FROM lineitem"


@query(
    "residual_context",
    f"""SELECT doc_id, row_idx, coalesce(last_value(CASE WHEN usable THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id, class_code ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      last_value(CASE WHEN usable THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS context FROM ({CONTEXT})""",
)
def residual_context(spark, sf):
    return x.residual_context(bound(spark, sf, CONTEXT)).select("doc_id", "row_idx", "context")


@query("decision_check", "SELECT item_id, item_id % 4 <> 0 AND confidence >= 0.70 AND item_id % 5 <> 0 AS accepted FROM items")
def decision_check(spark, sf):
    items = rows(spark, sf, "items")
    node = F.when(F.col("item_id") % 5 == 0, F.lit("X0")).otherwise(F.col("node_id"))
    d = items.select("item_id", "confidence", node.alias("selected"), F.when(F.col("item_id") % 4 == 0, F.array(F.lit("Z"))).otherwise(F.array("node_id", F.lit("X0"))).alias("candidates"))
    return x.decision_check(d, items).select("item_id", "accepted")


@query(
    "find_candidates",
    f"""WITH r AS (SELECT p_partkey AS ref_id, {NORM} AS norm FROM (SELECT p_partkey, p_name AS name FROM part)), n AS (SELECT concat('P', p_partkey) AS node_id, {NORM} AS nn FROM (SELECT p_partkey, p_name AS name FROM part)),
    rs AS (SELECT DISTINCT ref_id, norm, substr(w, 1, 6) AS stem FROM (SELECT ref_id, norm, unnest(string_split(norm, ' ')) AS w FROM r) WHERE length(w) >= 6), ns AS (SELECT DISTINCT node_id, nn, substr(w, 1, 6) AS stem FROM (SELECT node_id, nn, unnest(string_split(nn, ' ')) AS w FROM n) WHERE length(w) >= 6),
    s AS (SELECT ref_id, node_id, count(*) + CASE WHEN norm = nn THEN 2 ELSE 0 END AS score FROM rs JOIN ns USING (stem) GROUP BY ref_id, node_id, norm, nn),
    k AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY ref_id ORDER BY score DESC, node_id))
    SELECT ref_id, CASE WHEN second IS DISTINCT FROM score THEN node_id END AS node_id, CAST(score AS INT) AS score, second IS NOT DISTINCT FROM score AS ambiguous FROM k WHERE rn = 1""",
)
def find_candidates(spark, sf):
    parts = bound(spark, sf, "SELECT p_partkey, p_name AS name FROM part")
    refs = x.named(parts.withColumnRenamed("p_partkey", "ref_id"), F.col("name"))
    return x.find_candidates(refs, x.named(parts.withColumn("node_id", F.concat(F.lit("P"), "p_partkey")), F.col("name")))


ANCHORS = """SELECT s_suppkey AS ref_id, n_regionkey AS block, CASE WHEN s_suppkey % 3 = 0 THEN concat('A', s_nationkey % 20) END AS code, CAST((s_nationkey + s_suppkey % 4) % 7 AS INT) AS number
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
PARENTS = """SELECT concat('C', c_custkey) AS p_id, n_regionkey AS block, concat('A', c_custkey % 20) AS p_code, CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 END AS INT) AS p_number,
  CASE WHEN c_custkey % 4 = 0 THEN 'main_activity' WHEN c_custkey % 4 = 1 THEN 'activity' END AS p_type FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(
    "anchor_parent_score",
    f"""WITH r AS ({ANCHORS}), p AS ({PARENTS}),
    s AS (SELECT ref_id, p_id, CASE WHEN code = p_code THEN 6 ELSE 0 END + CASE WHEN number = p_number THEN 2 ELSE 0 END + CASE WHEN p_type = 'main_activity' THEN 1 ELSE 0 END AS score FROM r JOIN p USING (block))
    SELECT ref_id, p_id, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, p_id) AS rn FROM s WHERE score > 0) WHERE rn = 1""",
)
def anchor_parent_score(spark, sf):
    return x.anchor_parent_score(bound(spark, sf, ANCHORS), bound(spark, sf, PARENTS))


REGISTRY = "SELECT user_id % 50 AS org_id, event_type AS document_type, CASE WHEN value > 10 THEN 'parsed' ELSE 'failed' END AS status, ts AS updated_at, event_id AS doc_id FROM events"


@query("latest_parsed_document", f"SELECT org_id, document_type, arg_max(doc_id, (updated_at, doc_id)) AS doc_id FROM ({REGISTRY}) WHERE status = 'parsed' GROUP BY ALL")
def latest_parsed_document(spark, sf):
    return q.latest_parsed_document(bound(spark, sf, REGISTRY))


OFFSETS = "SELECT l_orderkey % 7 AS doc_id, l_suppkey % 20 AS table_idx, l_partkey AS anchor, l_orderkey * 10 + l_linenumber AS seq, l_orderkey, CAST(l_quantity AS BIGINT) AS n_rows, l_extendedprice AS e FROM lineitem"


@query("insert_offsets", f"SELECT sum(row_idx) AS s, count(*) AS n, doc_id, table_idx FROM (SELECT doc_id, table_idx, CAST(anchor + 1 + coalesce(sum(n_rows) OVER (PARTITION BY doc_id, table_idx ORDER BY anchor, seq, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_idx FROM ({OFFSETS})) GROUP BY doc_id, table_idx".replace("sum(row_idx) AS s", "CAST(sum(row_idx) AS BIGINT) AS s"))
def insert_offsets(spark, sf):
    df = bound(spark, sf, OFFSETS).withColumn("seq", F.struct("seq", "e"))
    return q.insert_offsets(df).groupBy("doc_id", "table_idx").agg(F.sum("row_idx").alias("s"), F.count("*").alias("n"))


@query("shift_coordinates", "SELECT o_orderkey AS update_id, CAST(o_orderkey + coalesce((SELECT sum(p_size) FROM part WHERE p_partkey % 10 = o_custkey % 10 AND p_size % 3 = o_orderkey % 3 AND p_partkey < o_orderkey), 0) AS BIGINT) AS row_idx FROM orders")
def shift_coordinates(spark, sf):
    updates = bound(spark, sf, "SELECT o_orderkey % 3 AS doc_id, o_custkey % 10 AS table_idx, o_orderkey AS row_idx, o_orderkey AS update_id FROM orders")
    inserts = bound(spark, sf, "SELECT CAST(p_size % 3 AS BIGINT) AS doc_id, p_partkey % 10 AS table_idx, p_partkey AS anchor, CAST(p_size AS BIGINT) AS n_rows FROM part")
    return q.shift_coordinates(updates, inserts)


CELLS = "SELECT l_orderkey AS row_idx, l_linenumber AS col_idx, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END AS raw, CASE WHEN l_suppkey % 4 = 0 THEN 0.0 ELSE l_extendedprice END AS amount, l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq FROM lineitem"


@query("cell_updates", f"SELECT row_idx, col_idx, seq FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx ORDER BY raw IS NOT NULL DESC, amount <> 0 DESC, seq DESC) AS rn FROM ({CELLS})) WHERE rn = 1")
def cell_updates(spark, sf):
    return q.preferred_cell_update(bound(spark, sf, CELLS), ["row_idx", "col_idx"]).select("row_idx", "col_idx", "seq")


@query("infer_year_column", "SELECT o_custkey AS row_id, 2000 AS year, CAST(arg_min(c, y) + 2000 - min(y) AS INT) AS col_idx FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, CAST(year(o_orderdate) - 1990 AS INT) AS c FROM orders) GROUP BY 1 HAVING arg_min(c, y) + 2000 - min(y) > 0")
def infer_year_column(spark, sf):
    known = bound(spark, sf, "SELECT o_custkey AS row_id, CAST(year(o_orderdate) AS INT) AS year, CAST(year(o_orderdate) - 1990 AS INT) AS col_idx FROM orders")
    return q.infer_year_column(known, known.select("row_id").distinct().withColumn("year", F.lit(2000))).select("row_id", "year", F.col("col_idx").cast("int").alias("col_idx"))


@query("anchor_row", "SELECT concat('C', c_custkey) AS node_id, greatest(c_custkey, coalesce(m, c_custkey)) AS anchor FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def anchor_row(spark, sf):
    children = bound(spark, sf, "SELECT concat('C', o_custkey) AS parent_id, o_orderkey AS row_idx, 'x' AS display_number FROM orders")
    return q.anchor_row(children, bound(spark, sf, "SELECT concat('C', c_custkey) AS node_id, c_custkey AS row_idx FROM customer"))


@query("order_items", "SELECT item_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN is_new THEN 1 WHEN mode = 'zeroing' THEN 3 ELSE 4 END, year, item_id) AS INT) AS place FROM items")
def order_items(spark, sf):
    category = F.when(F.col("is_new"), "new_object").when(F.col("mode") == "zeroing", "zeroing").otherwise("other")
    return q.order_items(rows(spark, sf, "items"), category).select("item_id", "place")


@query("preview_items", "SELECT set_id, item_id FROM (SELECT set_id, item_id, row_number() OVER (PARTITION BY set_id ORDER BY item_id) AS rn FROM items) WHERE rn <= 8")
def preview_items(spark, sf):
    return q.first_k(rows(spark, sf, "items"), ["set_id"], ["item_id"], 8).select("set_id", "item_id")


@query("explain_items", "SELECT item_id, c_name AS activity, n_name AS main_activity, CASE WHEN is_new THEN 'new_object' WHEN mode = 'zeroing' THEN 'zeroing' ELSE 'other' END AS category FROM items JOIN customer ON node_id = concat('C', c_custkey) JOIN nation ON c_nationkey = n_nationkey WHERE confidence >= 0.9")
def explain_items(spark, sf):
    """Chosen items with their hierarchy and category."""
    from ..operators import tree

    nodes = rows(spark, sf, "nodes").where("node_type <> 'object'")
    names = tree.hierarchy_struct(nodes, tree.ancestor_closure(nodes), ["main_activity", "activity"])
    category = F.when(F.col("is_new"), "new_object").when(F.col("mode") == "zeroing", "zeroing").otherwise("other")
    return rows(spark, sf, "items").where("confidence >= 0.9").join(names, "node_id").select("item_id", "activity", "main_activity", category.alias("category"))


@query("latest_change_set", "SELECT o_custkey % 30 AS org_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS set_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_change_set(spark, sf):
    sets = bound(spark, sf, "SELECT o_custkey % 30 AS org_id, o_orderkey AS set_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders")
    return q.latest_change_set(sets, F.col("status") == "F")


@query("latest_n_outputs", "SELECT org_id, set_id FROM (SELECT o_custkey % 30 AS org_id, o_orderkey AS set_id, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def latest_n_outputs(spark, sf):
    sets = bound(spark, sf, "SELECT o_custkey % 30 AS org_id, o_orderkey AS set_id, o_orderdate AS created_at FROM orders")
    return q.first_k(sets, ["org_id"], [F.desc("created_at"), F.desc("set_id")], 5).select("org_id", "set_id")


@query("recent_messages", "SELECT conv_id, right(string_agg(t, chr(10) ORDER BY turn), 4000) AS summary FROM (SELECT conv_id, turn, left(text, 350) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10 GROUP BY 1")
def recent_messages(spark, sf):
    return q.recent_messages(bound(spark, sf, "SELECT conv_id, turn, text FROM conversations"))


@query(
    "recent_mention",
    r"""WITH m AS (SELECT conv_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+')) AS w FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 12),
    n AS (SELECT item_id AS name_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')) AS w FROM benchmark)
    SELECT conv_id, min(name_id) AS name_id FROM m JOIN n ON left(m.w, 5) = left(n.w, 5) WHERE length(m.w) >= 5 AND length(n.w) >= 5 GROUP BY 1""",
)
def recent_mention(spark, sf):
    names = bound(spark, sf, "SELECT item_id AS name_id, text AS name FROM benchmark")
    return q.recent_mention(bound(spark, sf, "SELECT conv_id, turn, text FROM conversations"), names)


@query("search_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'worthless') OR contains(lower(source), 'license') OR contains(lower(source), 'worthless') OR contains(lower(lang), 'license') OR contains(lower(lang), 'worthless') ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def search_chunks(spark, sf):
    chunks = bound(spark, sf, "SELECT doc_id AS chunk_id, source AS title, text AS content, lang AS chunk_type, n_chars AS created_at FROM documents")
    return q.search_chunks(chunks, "the License of worthless").select("chunk_id")


ASKED = "SELECT concat(conv_id, '-', turn) AS query_id, text AS query FROM conversations"
#: The distinct words of four letters or more of a text in order, the first six of them.
FIRST_WORDS = r"list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: length(x) >= 4)[1:6]"


@query(
    "search_many",
    rf"""WITH q AS (SELECT query_id, regexp_split_to_array(lower(coalesce(query, '')), '[\x09-\x0D ]+') AS w FROM ({ASKED})), a AS (SELECT query_id, unnest({FIRST_WORDS}) AS word FROM q),
    u AS (SELECT DISTINCT word FROM a), h AS (SELECT word, doc_id, n_chars FROM u JOIN documents ON contains(lower(coalesce(text, '')), word) OR contains(lower(coalesce(source, '')), word) OR contains(lower(coalesce(lang, '')), word)),
    d AS (SELECT DISTINCT query_id, doc_id, n_chars FROM a JOIN h USING (word))
    SELECT query_id, doc_id AS chunk_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id DESC) AS rn FROM d) WHERE rn <= 50""",
)
def search_many(spark, sf):
    """P23 for every message of every conversation, by the stored index."""
    chunks = bound(spark, sf, "SELECT doc_id AS chunk_id, source AS title, text AS content, lang AS chunk_type, n_chars AS created_at FROM documents")
    at = scratch(spark, "search_index")
    search.write_search_index(chunks, at)
    return search.search_many(bound(spark, sf, ASKED), search.read_search_index(spark, at))


@query("document_search", "SELECT p_partkey AS doc_id FROM (SELECT p_partkey, lower(concat(p_name, ' ', p_type)) AS name FROM part) WHERE (contains(name, 'standards') AND contains(name, 'ring')) OR contains(name, 'standard')")
def document_search(spark, sf):
    return q.document_search(bound(spark, sf, "SELECT p_partkey AS doc_id, concat(p_name, ' ', p_type) AS name FROM part"), "standards ring").select("doc_id")


@query("index_chunks", "SELECT doc_id, count(*) AS chunks, max(length(c)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE trim(c) <> '' GROUP BY 1")
def index_chunks(spark, sf):
    return q.index_chunks(bound(spark, sf, "SELECT doc_id, text FROM documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.char_length("content")).cast("bigint").alias("longest"))


@query(
    "chunk_topics",
    """WITH p AS (SELECT doc_id % 100 AS doc_id, doc_id AS page_number, lower(text) AS t, length(text) AS n FROM documents), h AS (SELECT doc_id, page_number, n, 'license' AS topic FROM p WHERE regexp_matches(t, 'license') UNION ALL SELECT doc_id, page_number, n, 'insult' FROM p WHERE regexp_matches(t, 'idiot|scum')),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY page_number) AS rn FROM h) SELECT doc_id, topic, count(*) AS matched, string_agg(CASE WHEN rn <= 3 THEN CAST(page_number AS STRING) END, ',' ORDER BY page_number) AS first_pages, CAST(sum(n) FILTER (rn <= 3) + least(count(*), 3) - 1 AS BIGINT) AS chars FROM r GROUP BY ALL""",
)
def chunk_topics(spark, sf):
    pages = bound(spark, sf, "SELECT doc_id % 100 AS doc_id, doc_id AS page_number, text FROM documents")
    return q.chunk_pages(pages, {"license": ["license"], "insult": ["idiot", "scum"]}).withColumn("chars", F.char_length("text").cast("bigint")).drop("text")


@query("extract_rules", "SELECT doc_id, 'gnu' AS rule FROM documents WHERE contains(lower(text), 'gnu') AND contains(lower(text), 'license') UNION ALL SELECT doc_id, 'mit' FROM documents WHERE contains(lower(text), 'mit license')")
def extract_rules(spark, sf):
    return q.extract_rules(bound(spark, sf, "SELECT doc_id, text FROM documents"), {"gnu": ["gnu", "license"], "mit": ["mit license"]})


@query(
    "insert_rows_cube",
    """WITH s AS (SELECT item_id % 40 AS object_id, source_type, year, ((CAST(amount * 100 AS HUGEINT) + 500) // 1000 * 10)::DECIMAL(20,2) AS shown FROM items WHERE is_new AND mode <> 'delta_minus')
    SELECT object_id, coalesce(source_type, 'TOTAL') AS source_type, CAST(coalesce(sum(shown) FILTER (year = 1995), 0) AS DECIMAL(20,2)) AS y1995, CAST(coalesce(sum(shown) FILTER (year = 1996), 0) AS DECIMAL(20,2)) AS y1996 FROM s GROUP BY ROLLUP (object_id, source_type) HAVING object_id IS NOT NULL""",
)
def insert_rows_cube(spark, sf):
    return q.insert_rows_cube(rows(spark, sf, "items").where("is_new and mode <> 'delta_minus'").withColumn("object_id", F.col("item_id") % 40), [1995, 1996])


@query("duplicate_group_report", f"SELECT object_name, count(DISTINCT group_key) AS groups, min(p_partkey) AS first_row, max(p_partkey) AS last_row, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS row_ids, count(DISTINCT year) AS years, {SUM} AS amount FROM groups GROUP BY 1 HAVING count(DISTINCT group_key) > 1")
def duplicate_group_report(spark, sf):
    out = q.duplicate_group_report(rows(spark, sf, "groups").withColumn("row_id", F.col("p_partkey")))
    return out.select("object_name", "groups", "first_row", "last_row", F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("row_ids"), F.size("by_year").cast("bigint").alias("years"), "amount")


@query("group_object_rows", "SELECT group_key, arg_min(object_name, (l_orderkey, l_linenumber, p_partkey, amount)) AS object_name, arg_min(source_type, (l_orderkey, l_linenumber, p_partkey, amount)) AS first_source, bool_or(amount = 0) AS explicit_zero, count(*) AS n_rows FROM groups GROUP BY 1")
def group_object_rows(spark, sf):
    return q.group_object_rows(rows(spark, sf, "groups"), ["l_orderkey", "l_linenumber", "p_partkey", "amount"])[0]


@query("group_funding", f"SELECT group_key, year, source_type, {SUM} AS amount FROM groups GROUP BY ALL")
def group_funding(spark, sf):
    return q.group_object_rows(rows(spark, sf, "groups"), ["l_orderkey", "l_linenumber", "p_partkey", "amount"])[1]


@query("context_counts", "SELECT node_type, count(*) AS nodes, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM nodes LEFT JOIN (SELECT node_id, count(*) AS n FROM lines GROUP BY 1) USING (node_id) GROUP BY 1")
def context_counts(spark, sf):
    return q.context_counts(rows(spark, sf, "nodes"), rows(spark, sf, "lines"))


@query("usage_by_model", "SELECT event_type AS model, user_id % 5 AS purpose, count(*) AS runs, round(sum(CAST(value AS DECIMAL(20,4))), 4) AS cost FROM events GROUP BY ALL".replace("round(sum(CAST(value AS DECIMAL(20,4))), 4)", "CAST(sum(CAST(value AS DECIMAL(20,4))) AS DECIMAL(20,4))"))
def usage_by_model(spark, sf):
    runs = bound(spark, sf, "SELECT event_type AS model, user_id % 5 AS purpose, CAST(value AS DECIMAL(20,4)) AS cost FROM events")
    return q.usage_by_model(runs).withColumn("cost", F.col("cost").cast("decimal(20,4)"))


@query(
    "insert_plan",
    """WITH a AS (SELECT concat('C', c_custkey) AS parent_id, greatest(c_custkey, coalesce(m, c_custkey)) AS anchor FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    n AS (SELECT concat('C', o_custkey) AS parent_id, o_orderkey AS seq, o_custkey % 5 AS doc_id, o_custkey % 3 AS table_idx, o_orderkey % 4 + 1 AS n_rows FROM orders WHERE o_orderkey % 10 = 0)
    SELECT parent_id, seq, doc_id, table_idx, CAST(anchor + 1 + coalesce(sum(n_rows) OVER (PARTITION BY doc_id, table_idx ORDER BY anchor, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_idx FROM n JOIN a USING (parent_id)""",
)
def insert_plan(spark, sf):
    children = bound(spark, sf, "SELECT concat('C', o_custkey) AS parent_id, o_orderkey AS row_idx, 'x' AS display_number FROM orders")
    new = bound(spark, sf, "SELECT concat('C', o_custkey) AS parent_id, o_orderkey AS seq, o_custkey % 5 AS doc_id, o_custkey % 3 AS table_idx, o_orderkey % 4 + 1 AS n_rows FROM orders WHERE o_orderkey % 10 = 0")
    return q.insert_plan(bound(spark, sf, "SELECT concat('C', c_custkey) AS node_id, c_custkey AS row_idx FROM customer"), children, new)
