"""The whole matching cascade over two programs: parts are objects below activities, and a group each asks for one of them in some way."""

from __future__ import annotations

from ..operators import cascade
from .registry import bound, query

PROGRAMS = "(SELECT 'V0' AS v UNION ALL SELECT 'V1') p"
#: A part's activity, and the code of an activity: two digits of its fifth and 02; nations of one fifth share it, each in a subprogram of its own.
ACT = "CAST(floor(p_partkey / 2) AS INT) % 25"
MAIN = "lpad(CAST(CAST(floor({n} / 5) AS INT) + 1 AS STRING), 2, '0')"
NAME = "concat(p_name, CASE WHEN p_partkey % 13 = 12 THEN ' twin' ELSE concat(' ', p_brand, ' ', left(md5(CAST(p_partkey AS STRING)), 10)) END)"

NODES = f"""
  SELECT v AS program_id, concat(v, '-ROOT') AS node_id, CAST(NULL AS STRING) AS parent_id, 'program' AS node_type, 'Program' AS name, CAST(NULL AS STRING) AS code, CAST(NULL AS STRING) AS display_number, CAST(NULL AS STRING) AS table_index FROM {PROGRAMS}
  UNION ALL SELECT v, concat(v, '-R', r_regionkey), concat(v, '-ROOT'), 'subprogram', r_name, NULL, concat(r_regionkey + 1, ''), NULL FROM region CROSS JOIN {PROGRAMS}
  UNION ALL SELECT v, concat(v, '-N', n_nationkey), concat(v, '-R', n_regionkey), 'main_activity', n_name, NULL, concat(n_nationkey + 1, ''), concat(n_regionkey + 1, '') FROM nation CROSS JOIN {PROGRAMS}
  UNION ALL SELECT v, concat(v, '-A', n_nationkey), concat(v, '-N', n_nationkey), 'activity', concat('Activity ', n_name), concat({MAIN.format(n="n_nationkey")}, '.02'), concat(CAST(floor(n_nationkey / 5) AS INT) + 1, '.2'), NULL FROM nation CROSS JOIN {PROGRAMS}
  UNION ALL SELECT v, concat(v, '-B', n_nationkey), concat(v, '-N', n_nationkey), 'activity', concat('Other works ', n_name), concat({MAIN.format(n="n_nationkey")}, '.02'), concat(CAST(floor(n_nationkey / 5) AS INT) + 1, '.2'), NULL FROM nation CROSS JOIN {PROGRAMS} WHERE n_nationkey % 5 = 0
  UNION ALL SELECT concat('V', p_partkey % 2), concat('V', p_partkey % 2, '-P', p_partkey), concat('V', p_partkey % 2, '-A', {ACT}), 'object', {NAME}, CASE WHEN p_partkey % 3 = 0 THEN concat('K', p_partkey) END, NULL, NULL FROM part"""

# a group's kind of question is k; its parent's code names the part's own activity, the one after it (k = 6) or none
GROUPS = f"""
  SELECT concat('G', p_partkey) AS group_key, concat('V', p_partkey % 2) AS program_id, k, p_partkey, a,
    CASE WHEN k IN (0, 1, 3) THEN 'UNASSIGNED_RESIDUAL' WHEN k = 2 THEN 'ACTIVITY_AGGREGATE' ELSE 'GROUPED_OBJECT' END AS status,
    CASE WHEN k IN (8, 9) THEN 'pdf' ELSE 'xlsx' END AS kind,
    CASE WHEN k = 4 OR k = 10 AND p_partkey % 4 < 2 THEN concat('K', p_partkey) END AS object_code,
    CASE k WHEN 0 THEN concat('Visible line ', p_partkey) WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 'zzz' ELSE concat('Мероприятие 01.02. NATION_', a) END
      WHEN 3 THEN 'Неуказанное направление' WHEN 7 THEN CASE WHEN p_partkey % 4 < 2 THEN concat(substring({NAME}, length(split_part(p_name, ' ', 1)) + 2, 100)) ELSE concat(p_name, ' ', p_brand) END
      WHEN 8 THEN 'see the agreement' WHEN 9 THEN 'see the agreement' WHEN 10 THEN concat('decided ', p_partkey) WHEN 11 THEN concat('nowhere ', p_partkey) ELSE {NAME} END AS object_name,
    CASE WHEN k = 3 THEN CASE WHEN p_partkey % 4 < 2 THEN {NAME} ELSE concat('Activity NATION_', a) END END AS residual_parent_name,
    CASE k WHEN 8 THEN {NAME} WHEN 9 THEN concat(p_name, ' ', left(md5(CAST(p_partkey AS STRING)), 10), ' more') END AS event_name,
    CASE WHEN k IN (7, 11) AND p_partkey % 5 = 0 THEN 'none' ELSE concat('10', sub, main, '0200') END AS parent_code
  FROM (SELECT *, CASE WHEN k = 6 THEN (act + 1) % 25 ELSE act END AS a, CAST(CASE WHEN k = 6 THEN (act + 1) % 25 ELSE act END % 5 + 1 + CASE WHEN k IN (4, 5) AND p_partkey % 6 > 2 THEN 1 ELSE 0 END AS STRING) AS sub, {MAIN.format(n="CASE WHEN k = 6 THEN (act + 1) % 25 ELSE act END")} AS main
    FROM (SELECT *, p_partkey % 13 AS k, {ACT} AS act FROM part))"""
LINES = f"""SELECT concat(v, '-A', c_nationkey) AS node_id, CAST(2020 + c_custkey % 3 AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(c_acctbal AS DECIMAL(20,2)) AS amount FROM customer CROSS JOIN {PROGRAMS}"""
SUMS = "SELECT c_nationkey, CAST(2020 + c_custkey % 3 AS INT) AS year, 'LOCAL_BUDGET' AS source_type, CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS amount FROM customer GROUP BY ALL"
FUNDING = f"SELECT group_key, year, source_type, CAST(amount + CASE WHEN p_partkey % 3 = 0 AND year = 2021 THEN 1 ELSE 0 END AS DECIMAL(20,2)) AS amount FROM ({GROUPS}) g JOIN ({SUMS}) s ON a = c_nationkey WHERE k = 1 AND NOT (p_partkey % 7 = 0 AND year = 2022)"
DECISIONS = f"SELECT group_key, concat('V', p_partkey % 2, '-P', p_partkey) AS node_id, CAST(0.8 AS DOUBLE) AS confidence FROM ({GROUPS}) WHERE k IN (10, 11) AND p_partkey % 3 <> 1"

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', ' ', 'g'))"
TOKENS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) > 1)"
SCORE = "round(greatest(len(list_intersect({l}, {r})) / greatest(len({l}), len({r}), 1)::DOUBLE, 0.98 * len(list_intersect({l}, {r})) / greatest(len({l}), 1)::DOUBLE), 4)"
STATED = "CASE WHEN count(*) = 1 THEN min(node_id) END AS node_id, CASE WHEN count(*) = 1 THEN '{0}' ELSE 'NEEDS_CONFIRMATION' END AS match_status, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.5 END AS confidence"

# words of these names match only if they are equal, so the greedy score is that of the common words
ALL_STAGES_SQL = f"""
WITH n0 AS ({NODES}), g0 AS ({GROUPS}), f AS ({FUNDING}), l AS (SELECT node_id, year, source_type, sum(amount) AS amount FROM ({LINES}) GROUP BY ALL),
n AS (SELECT n0.*, {NORM.format("n0.name")} AS norm, {TOKENS.format(NORM.format("n0.name"))} AS tokens, CASE WHEN n0.node_type = 'activity' THEN n0.node_id WHEN n0.node_type = 'object' THEN n0.parent_id END AS act FROM n0),
acts AS (SELECT a.*, s.display_number AS sub, m.table_index AS idx FROM n a JOIN n m ON m.node_id = a.parent_id JOIN n s ON s.node_id = m.parent_id WHERE a.node_type = 'activity'),
g AS (SELECT *, {NORM.format("object_name")} AS norm, {TOKENS.format(NORM.format("object_name"))} AS tokens, CASE WHEN parent_code <> 'none' THEN parent_code[3] END AS want_sub, CASE WHEN parent_code <> 'none' THEN concat(parent_code[4:5], '.', parent_code[6:7]) END AS want FROM g0),
scope AS (
  SELECT group_key, n.* EXCLUDE (program_id) FROM g JOIN n ON n.program_id = g.program_id LEFT JOIN acts ON acts.node_id = n.act
  WHERE want IS NULL OR (acts.code = want AND (sub = want_sub OR CAST(idx AS INT) = CAST(want_sub AS INT) - 1))),
objects AS (SELECT * FROM scope WHERE node_type = 'object'),
s0 AS (SELECT group_key, NULL AS node_id, 'UNASSIGNED_RESIDUAL' AS match_status, 0.0 AS confidence FROM g WHERE status = 'UNASSIGNED_RESIDUAL' AND starts_with(norm, 'visible line')),
cand AS (SELECT group_key, node_id, sub = want_sub AS own, max(sub = want_sub) OVER (PARTITION BY group_key) AS has FROM g JOIN acts ON acts.program_id = g.program_id AND acts.code = want WHERE g.status = 'UNASSIGNED_RESIDUAL'),
s1 AS (
  SELECT group_key, min(node_id) AS node_id, 'MATCH_RESIDUAL_PARENT_TOTAL' AS match_status, 1.0 AS confidence FROM cand c WHERE (own OR NOT has)
    AND NOT EXISTS (SELECT 1 FROM f LEFT JOIN l ON l.node_id = c.node_id AND l.year = f.year AND l.source_type = f.source_type WHERE f.group_key = c.group_key AND coalesce(l.amount, 0) <> f.amount)
    AND NOT EXISTS (SELECT 1 FROM l WHERE l.node_id = c.node_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.group_key = c.group_key AND f.year = l.year AND f.source_type = l.source_type))
  GROUP BY group_key HAVING count(*) = 1),
bare AS (SELECT group_key, acts.node_id, {NORM.format("regexp_replace(g.object_name, '^Мероприятие 01.02. ', '')")} AS a, acts.norm AS b, count(*) OVER (PARTITION BY group_key) AS n FROM g JOIN acts ON acts.program_id = g.program_id AND acts.code = want AND sub = want_sub WHERE g.status = 'ACTIVITY_AGGREGATE'),
s2 AS (SELECT group_key, CASE WHEN max(n) = 1 THEN min(node_id) ELSE min(node_id) FILTER (contains(a, b) OR contains(b, a)) END AS node_id, 'MATCH_ACTIVITY_AGGREGATE' AS match_status, 1.0 AS confidence FROM bare GROUP BY group_key HAVING max(n) = 1 OR count(*) FILTER (contains(a, b) OR contains(b, a)) = 1),
named AS (SELECT group_key, {NORM.format("residual_parent_name")} AS norm, {TOKENS.format(NORM.format("residual_parent_name"))} AS tokens FROM g WHERE k = 3),
likely AS (SELECT group_key, node_id, s.node_type, CASE WHEN s.norm = named.norm THEN 1.0 ELSE {SCORE.format(l="named.tokens", r="s.tokens")} END AS score FROM named JOIN scope s USING (group_key) WHERE s.node_type IN ('object', 'activity', 'main_activity')),
s3 AS (SELECT group_key, b.node_id AS node_id, 'MATCH_RESIDUAL_PARENT' AS match_status, b.score AS confidence FROM (SELECT group_key, arg_min(struct_pack(node_id := node_id, t := node_type, score := score), (-score, node_id)) AS b FROM likely WHERE score >= 0.45 GROUP BY 1) WHERE b.t = 'object'),
s4 AS (SELECT group_key, min(node_id) AS node_id, 'MATCH_EXACT_CODE' AS match_status, 1.0 AS confidence FROM g JOIN objects o USING (group_key) WHERE o.code = g.object_code GROUP BY 1),
s5 AS (SELECT group_key, {STATED.format("MATCH_EXACT_NAME")} FROM g JOIN objects o USING (group_key) WHERE o.norm = g.norm GROUP BY 1),
s6 AS (SELECT group_key, {STATED.format("MATCH_EXACT_NAME_GLOBAL")} FROM g JOIN n ON n.program_id = g.program_id AND n.node_type = 'object' AND n.norm = g.norm WHERE g.object_code IS NULL AND g.norm <> '' GROUP BY 1),
pairs AS (SELECT group_key, node_id, {SCORE.format(l="g.tokens", r="o.tokens")} AS score FROM g JOIN objects o USING (group_key) WHERE g.norm <> '' AND len(list_intersect(g.tokens, o.tokens)) > 0),
top AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM pairs WINDOW w AS (PARTITION BY group_key ORDER BY score DESC, node_id)),
s7 AS (SELECT group_key, CASE WHEN coalesce(score - second > 0.05, true) THEN node_id END AS node_id, CASE WHEN coalesce(score - second > 0.05, true) THEN 'MATCH_FUZZY_CONFIDENT' ELSE 'NEEDS_CONFIRMATION' END AS match_status, CASE WHEN coalesce(score - second > 0.05, true) THEN score ELSE 0.5 END AS confidence FROM top WHERE rn = 1 AND score >= 0.92),
events AS (SELECT group_key, program_id, {NORM.format("event_name")} AS norm, {TOKENS.format(NORM.format("event_name"))} AS tokens FROM g WHERE kind = 'pdf'),
scored AS (SELECT group_key, node_id, CASE WHEN contains(n.norm, e.norm) THEN 0.95 ELSE {SCORE.format(l="e.tokens", r="n.tokens")} END AS score FROM events e JOIN n ON n.program_id = e.program_id AND n.node_type = 'object'),
first AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY group_key ORDER BY score DESC, node_id)),
s8 AS (SELECT group_key, node_id, 'MATCH_PDF_EVENT_NAME' AS match_status, score AS confidence FROM first WHERE rn = 1 AND score >= 0.45 AND coalesce(second < score, true)),
s9 AS (SELECT group_key, d.node_id, 'MATCH_SEMANTIC_AGENT' AS match_status, d.confidence FROM g JOIN ({DECISIONS}) d USING (group_key) WHERE NOT (status = 'GROUPED_OBJECT' AND object_code IS NOT NULL)),
every AS ({" UNION ALL ".join(f"SELECT group_key, CAST(node_id AS STRING) AS node_id, match_status, CAST(confidence AS DOUBLE) AS confidence, {i} AS stage FROM s{i}" for i in range(10))}
  UNION ALL SELECT group_key, NULL, CASE WHEN status = 'UNASSIGNED_RESIDUAL' THEN status ELSE 'MISSING_IN_DOCX' END, 0.0, 10 FROM g)
SELECT group_key, b.node_id AS node_id, b.match_status AS match_status, b.confidence AS confidence, b.stage AS stage FROM (SELECT group_key, arg_min(struct_pack(node_id := node_id, match_status := match_status, confidence := confidence, stage := stage), stage) AS b FROM every GROUP BY 1)
"""


@query("match_all_stages", ALL_STAGES_SQL)
def match_all_stages(spark, sf):
    """D4 to D13 in the cascade's order, scopes by code and shifted index, with stored decisions."""
    nodes = bound(spark, sf, f"SELECT *, CAST(NULL AS ARRAY<STRING>) AS codes, false AS is_virtual FROM ({NODES})")
    return cascade.match_groups(bound(spark, sf, GROUPS), bound(spark, sf, FUNDING), nodes, bound(spark, sf, LINES), bound(spark, sf, DECISIONS), ["visible line"])
