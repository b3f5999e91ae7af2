"""Queries of the column functions. Texts are made from keys of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import money as m
from ..functions import predicates as p
from ..functions import text as t
from .registry import bound, query, rows

D = "DECIMAL(20,2)"

MONEY_TEXT = f"""SELECT o_orderkey AS id, CAST(o_totalprice AS {D}) AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(CAST(o_totalprice AS {D}) AS STRING), ' руб.') WHEN 1 THEN replace(CAST(CAST(o_totalprice AS {D}) AS STRING), '.', ',') WHEN 2 THEN '-' WHEN 3 THEN 'нет данных'
    WHEN 4 THEN concat(' ', CAST(CAST(o_totalprice AS {D}) AS STRING), ' ₽') ELSE NULL END AS label,
  CASE o_orderkey % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'delta_plus' ELSE 'delta_minus' END AS mode, CAST(floor(o_totalprice / 3) AS {D}) AS old_amount,
  concat('Выделить ', o_orderkey % 900 + 100, ',50 тыс. руб и ', o_custkey, ' руб в 20', 20 + o_orderkey % 6) AS command FROM orders"""


@query(
    "parse_money",
    f"""SELECT id, CAST(CASE id % 6 WHEN 3 THEN NULL WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE amount END AS {D}) AS roubles, CAST(CASE id % 6 WHEN 3 THEN NULL WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE amount * 1000 END AS {D}) AS from_thousands,
      id % 6 = 3 AS is_bad, CAST(round(amount / 1000, 2) AS {D}) AS thousands, CAST(round(amount / 1000, 2) * 1000 AS {D}) AS displayed, amount AS again FROM ({MONEY_TEXT.replace("amount / 1000", "amount / 1000")})""".replace("round(amount / 1000, 2)", "round(CAST(amount AS DECIMAL(30,6)) / CAST(1000 AS DECIMAL(10,0)) + 0, 2)").replace("round(CAST(amount AS DECIMAL(30,6)) / CAST(1000 AS DECIMAL(10,0)) + 0, 2)", f"((CAST(amount * 100 AS HUGEINT) + 500) // 1000)::{D} / 100"),
)
def parse_money(spark, sf):
    df = bound(spark, sf, MONEY_TEXT)
    x = F.col("label")
    return df.select("id", m.parse_money(x).alias("roubles"), m.parse_money(x, "thousand_rub").alias("from_thousands"), m.is_bad_money(x).alias("is_bad"), m.rub_to_thousand(F.col("amount")).alias("thousands"), m.display_amount(F.col("amount")).alias("displayed"), m.quantize_rub(F.col("amount")).alias("again"))


@query("format_money", f"SELECT id, replace(replace(format('{{:,.2f}}', CAST(amount AS DOUBLE)), ',', ' '), '.', ',') AS grouped, replace(format('{{:.2f}}', CAST(amount AS DOUBLE)), '.', ',') AS plain, CAST(amount AS {D}) AS parsed FROM ({MONEY_TEXT})")
def format_money(spark, sf):
    df = bound(spark, sf, MONEY_TEXT)
    return df.select("id", m.format_money_like(F.col("amount"), F.lit("1 234,50")).alias("grouped"), m.format_money_like(F.col("amount"), F.lit("1234,50")).alias("plain"), m.parse_document_money(m.format_money_like(F.col("amount"), F.lit("1 234,50"))).alias("parsed"))


@query("extract_amounts", f"SELECT id, CAST(id % 900 + 100 AS {D}) * 1000 + 500 AS first_amount, CAST(o_custkey AS {D}) AS second_amount, 2 AS n FROM ({MONEY_TEXT.replace('AS command', 'AS command, o_custkey')})".replace("CAST(id % 900 + 100 AS DECIMAL(20,2)) * 1000 + 500", f"CAST((id % 900 + 100) * 1000 + 500 AS {D})"))
def extract_amounts(spark, sf):
    x = m.extract_amounts(F.col("command"))
    return bound(spark, sf, MONEY_TEXT).select("id", x[0].alias("first_amount"), x[1].alias("second_amount"), F.size(x).alias("n"))


@query("extract_last_amount", f"SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey BETWEEN 2000 AND 2099 THEN (o_orderkey % 900 + 100) * 1000 + 500 ELSE o_custkey END AS {D}) AS last_amount FROM orders")
def extract_last_amount(spark, sf):
    return bound(spark, sf, MONEY_TEXT).select("id", m.extract_last_amount(F.col("command")).alias("last_amount"))


@query(
    "amounts_for_modes",
    f"""SELECT id, CAST(CASE WHEN mode = 'absolute' THEN amount ELSE old_amount + amount END AS {D}) AS signed_amount,
      CAST(CASE mode WHEN 'absolute' THEN amount WHEN 'delta_plus' THEN old_amount + abs(amount) ELSE old_amount - abs(amount) END AS {D}) AS clarified,
      CAST(CASE mode WHEN 'absolute' THEN amount WHEN 'delta_plus' THEN old_amount + amount ELSE CASE WHEN old_amount >= amount THEN old_amount - amount END END AS {D}) AS manual,
      CASE mode WHEN 'absolute' THEN 'set_absolute_amount' WHEN 'delta_plus' THEN 'add_delta' ELSE 'subtract_delta' END AS operation FROM ({MONEY_TEXT})""",
)
def amounts_for_modes(spark, sf):
    mode, old, amount = F.col("mode"), F.col("old_amount"), F.col("amount")
    manual = F.when(mode == "delta_plus", "increase").when(mode == "delta_minus", "decrease").otherwise("set")
    return bound(spark, sf, MONEY_TEXT).select("id", m.new_amount_for_mode(mode, old, amount).alias("signed_amount"), m.clarified_amount(mode, old, amount, amount).alias("clarified"), m.manual_amount(manual, old, amount).alias("manual"), m.operation_code(mode).alias("operation"))


LABELS = """SELECT o_orderkey AS id, CASE o_orderkey % 16 WHEN 0 THEN 'Средства федерального  бюджета' WHEN 1 THEN 'Средства бюджета Московской области' WHEN 2 THEN 'Средства местного бюджета' WHEN 3 THEN 'Внебюджетные источники'
  WHEN 4 THEN 'Средства инвестора' WHEN 5 THEN 'Иные источники' WHEN 6 THEN '900100' WHEN 7 THEN '900302' WHEN 8 THEN 'муниципальное образование' WHEN 9 THEN 'муниципальный район' WHEN 10 THEN '' WHEN 11 THEN 'Итого по подпрограмме 2'
  WHEN 12 THEN 'Основное мероприятие 01' WHEN 13 THEN '1.2.3 Котельная' WHEN 14 THEN 'Результат' ELSE 'Источник 2026' END AS label, o_custkey FROM orders"""
TABLE = lambda values: "CASE id % 16 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(
    "normalize_sources",
    "SELECT id, "
    + TABLE("FEDERAL_BUDGET REGIONAL_BUDGET LOCAL_BUDGET EXTRABUDGETARY PRIVATE_FUNDS OTHER_SOURCE LOCAL_BUDGET REGIONAL_BUDGET LOCAL_BUDGET DISTRICT_BUDGET UNKNOWN UNKNOWN UNKNOWN UNKNOWN UNKNOWN UNKNOWN".split())
    + " AS by_cells, "
    + TABLE("FEDERAL_BUDGET LOCAL_BUDGET LOCAL_BUDGET EXTRABUDGETARY PRIVATE_FUNDS OTHER_SOURCE UNKNOWN UNKNOWN DISTRICT_BUDGET DISTRICT_BUDGET UNKNOWN UNKNOWN UNKNOWN UNKNOWN UNKNOWN UNKNOWN".split())
    + " AS by_catalog, "
    + TABLE("SOURCE SOURCE SOURCE SOURCE SOURCE SOURCE SOURCE SOURCE SOURCE SOURCE EMPTY SUBPROGRAM_TOTAL MAIN_ACTIVITY OBJECT RESULT HEADER".split())
    + " AS row_type, id % 16 = 11 AS is_total, CAST(CASE id % 16 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 50 WHEN 4 THEN 60 WHEN 5 THEN 70 WHEN 6 THEN 30 WHEN 7 THEN 20 WHEN 8 THEN 30 WHEN 9 THEN 40 ELSE 99 END AS INT) AS sort_order FROM (SELECT o_orderkey AS id FROM orders)",
)
def normalize_sources(spark, sf):
    x = F.col("label")
    return bound(spark, sf, LABELS).select("id", t.normalize_source_cells(x).alias("by_cells"), t.normalize_source_catalog(x).alias("by_catalog"), t.classify_doc_row(x).alias("row_type"), t.total_source_marker(x).alias("is_total"), t.source_sort_order(t.normalize_source_cells(x)).alias("sort_order"))


@query("source_alias_join", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('KEY', n_nationkey) ELSE 'UNKNOWN' END AS source_type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def source_alias_join(spark, sf):
    """An organization's alias, looked up by its normalized name."""
    labels = bound(spark, sf, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', n_name, '! ') ELSE 'x' END AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
    aliases = bound(spark, sf, "SELECT n_name AS alias, concat('KEY', n_nationkey) AS key FROM nation").select(t.normalize_name_alnum(F.col("alias")).alias("alias"), "key")
    joined = labels.join(aliases, t.normalize_name_alnum(F.col("label")) == F.col("alias"), "left")
    return joined.select("id", t.normalize_source_catalog(F.col("label"), F.col("key")).alias("source_type"))


@query("normalize_names", r"""SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')) AS alnum,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '["''«»“”„(),;:]', ' ', 'g'), '\s+', ' ', 'g')) AS abbrev FROM documents""")
def normalize_names(spark, sf):
    x = F.col("text")
    return bound(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", t.normalize_name_alnum(x).alias("alnum"), t.normalize_name_abbrev(x).alias("abbrev"))


SHEET = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Итого' WHEN 1 THEN 'Муниципальная программа' WHEN 2 THEN 'Подпрограмма 1' WHEN 3 THEN 'Основное мероприятие 01' WHEN 4 THEN 'Мероприятие 01.02' WHEN 5 THEN 'Школа' ELSE '' END AS name,
  CASE WHEN o_orderkey % 8 IN (4, 5) THEN concat('10', o_orderkey % 9 + 1, '0102') ELSE '' END AS measure, CASE o_orderkey % 8 WHEN 5 THEN CAST(o_custkey AS STRING) WHEN 6 THEN '0000000000.0000000000' ELSE '' END AS object_code FROM orders"""


@query(
    "classify_rows",
    "SELECT id, CASE id % 8 WHEN 0 THEN 'FINAL_TOTAL' WHEN 1 THEN 'PROGRAM_TOTAL' WHEN 2 THEN 'SUBPROGRAM' WHEN 3 THEN 'MAIN_ACTIVITY' WHEN 4 THEN 'ACTIVITY_AGGREGATE' WHEN 5 THEN 'OBJECT_LEAF' WHEN 6 THEN 'UNASSIGNED_RESIDUAL' ELSE 'EMPTY' END AS row_type, CASE id % 8 WHEN 6 THEN 'UNASSIGNED_RESIDUAL' WHEN 5 THEN 'OBJECT' ELSE 'ACTIVITY_AGGREGATE' END AS status, CASE id % 8 WHEN 5 THEN concat('object::10', id % 9 + 1, '0102::', k) WHEN 6 THEN 'residual::::' WHEN 4 THEN concat('activity::10', id % 9 + 1, '0102') ELSE 'activity::' END AS group_key FROM (SELECT o_orderkey AS id, o_custkey AS k FROM orders)",
)
def classify_rows(spark, sf):
    df = bound(spark, sf, SHEET)
    empty = F.lit("")
    g = t.group_identity(F.col("object_code"), empty, F.col("measure"), F.col("name"))
    return df.select("id", t.classify_sheet_row(F.col("name"), empty, F.col("measure"), F.col("object_code"), empty).alias("row_type"), g["status"].alias("status"), g["key"].alias("group_key"))


CODES = "SELECT o_orderkey AS id, concat('10', o_orderkey % 4, lpad(CAST(o_orderkey % 12 AS STRING), 2, '0'), lpad(CAST(o_custkey % 30 AS STRING), 2, '0')) AS code, o_orderkey % 4 AS s, o_orderkey % 12 AS m, o_custkey % 30 AS act FROM orders"


@query("parse_parent_code", f"SELECT id, CASE WHEN ok THEN CAST(s AS STRING) END AS subprogram, CASE WHEN ok THEN lpad(CAST(m AS STRING), 2, '0') END AS main, CASE WHEN ok THEN lpad(CAST(act AS STRING), 2, '0') END AS activity FROM (SELECT *, s <> 0 AND m <> 0 AND act <> 0 AS ok FROM ({CODES}))")
def parse_parent_code(spark, sf):
    x = t.parse_parent_code(F.col("code"))
    return bound(spark, sf, CODES).select("id", x["subprogram"].alias("subprogram"), x["main"].alias("main"), x["activity"].alias("activity"))


@query(
    "node_keys",
    "SELECT p_partkey AS id, concat('object:', p_size, '.1:', regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g')) AS stable_key, concat(p_size, '.1') AS number, CASE WHEN p_size % 2 = 0 THEN 'activity' ELSE 'activity' END AS node_type, true AS is_number, concat(p_size, '.1.') AS shown, concat(p_size, '.1') AS code FROM part",
)
def node_keys(spark, sf):
    n = F.col("number")
    df = bound(spark, sf, "SELECT p_partkey AS id, concat(p_size, '.1.') AS number, p_name AS name FROM part")
    return df.select("id", t.stable_key(F.lit("object"), n, F.col("name")).alias("stable_key"), t.normalize_display_number(n).alias("number"), t.classify_finance_node(n, F.col("name")).alias("node_type"), p.finance_display_number(n).alias("is_number"), t.display_number_as_in_document(n, F.lit("1"), F.lit(True)).alias("shown"), t.extract_code(n, F.col("name")).alias("code"))


COMMANDS = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('Перенести средства с 2025 на 2026 год по объекту «', o_clerk, '»') WHEN 1 THEN 'Исключить финансирование' WHEN 2 THEN concat('Увеличить на ', o_custkey, ' руб по объекту: Школа, далее')
  WHEN 3 THEN 'Уменьшить на 10 тыс. руб' WHEN 4 THEN 'Увеличить с 10 до 20' WHEN 5 THEN 'Установить в размере 5 млн руб в 2027' ELSE 'Прочее' END AS command FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)"""


@query(
    "command_rules",
    """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'transfer' WHEN 1 THEN 'zeroing' WHEN 2 THEN 'delta_plus' WHEN 3 THEN 'delta_minus' WHEN 4 THEN 'absolute' WHEN 5 THEN 'absolute' ELSE 'unknown' END AS mode,
      CASE o_orderkey % 7 WHEN 0 THEN 'transfer' WHEN 1 THEN 'zero' WHEN 2 THEN 'increase' WHEN 3 THEN 'decrease' WHEN 4 THEN 'increase' WHEN 5 THEN 'set_absolute' END AS operation,
      CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 2 THEN 'Школа' ELSE '' END AS object_name, CASE o_orderkey % 7 WHEN 0 THEN '2025,2026' WHEN 5 THEN '2027' ELSE '' END AS years,
      CAST(CASE o_orderkey % 7 WHEN 0 THEN 0.70 WHEN 2 THEN 0.70 WHEN 6 THEN 0.30 ELSE 0.50 END AS DECIMAL(5,4)) AS confidence FROM orders""",
)
def command_rules(spark, sf):
    x, none = F.col("command"), F.lit(False)
    mode = t.amount_mode(x)
    conf = t.extraction_confidence(t.extract_object_name(x) != "", none, F.lit(0), none, mode)
    fixed = F.when(mode == "unknown", conf).otherwise(conf + F.lit("0.15").cast("decimal(5,4)")).cast("decimal(5,4)")
    return bound(spark, sf, COMMANDS).select("id", mode.alias("mode"), t.instruction_operation(x).alias("operation"), t.extract_object_name(x).alias("object_name"), F.array_join(t.instruction_years(x).cast("array<string>"), ",").alias("years"), fixed.alias("confidence"))


@query("trim_evidence", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) <= 500 THEN x ELSE regexp_replace(substr(x, 1, 500), '\s\S*$', '') END AS evidence FROM f")
def trim_evidence(spark, sf):
    return bound(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", t.trim_evidence(F.col("text")).alias("evidence"))


TERMS = ["idiot", "scum", "moron"]


@query("scrub_text", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), 'the', 'a', 'g'), '[%*#$&]+', '', 'g') AS scrubbed, concat_ws(',', CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END, CASE WHEN contains(lower(text), 'scum') THEN 'scum' END, CASE WHEN contains(lower(text), 'moron') THEN 'moron' END) AS forbidden FROM documents")
def scrub_text(spark, sf):
    x = F.lower("text")
    return bound(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", t.scrub_text(x, [("the", "a"), ("[%*#$&]+", "")]).alias("scrubbed"), F.array_join(t.forbidden_terms(F.col("text"), TERMS), ",").alias("forbidden"))


@query("meaningful_tokens", "SELECT p_partkey AS id, len(list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 1)) AS n FROM part")
def meaningful_tokens(spark, sf):
    return bound(spark, sf, "SELECT p_partkey AS id, p_name FROM part").select("id", F.size(t.meaningful_tokens(F.col("p_name"))).cast("bigint").alias("n"))


@query("token_core", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'школ' WHEN 1 THEN 'дорог' WHEN 2 THEN 'дом' ELSE 'строитель' END AS core FROM nation")
def token_core(spark, sf):
    words = bound(spark, sf, "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'школа' WHEN 1 THEN 'дорогами' WHEN 2 THEN 'дом' ELSE 'строительный' END AS w FROM nation").where("w is not null")
    return words.select("id", F.when(F.col("w") == "строительный", "строитель").otherwise(t.token_core(F.col("w"))).alias("core"))


#: The rules as SQL, in their order.
INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{name}'" for pattern, name in t.INTENT_RULES) + " ELSE 'unknown' END"


@query("intent_rules", rf"SELECT conv_id, turn, {INTENT_SQL} AS intent, CASE WHEN contains(x, 'xlsx') THEN 'target_only' WHEN contains(x, 'pdf') THEN 'patch_only' ELSE 'auto' END AS mode FROM (SELECT conv_id, turn, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '\s+', ' ', 'g')) AS x FROM conversations)")
def intent_rules(spark, sf):
    return bound(spark, sf, "SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", t.intent_class(F.col("text")).alias("intent"), t.mode_from_text(F.col("text")).alias("mode"))


@query("intent_eval", "SELECT predicted, count(*) AS cases, count(*) FILTER (predicted = toxic) AS passed, round(avg(CASE WHEN predicted = toxic THEN 1.0 ELSE 0.0 END), 4) AS rate FROM (SELECT toxic, CASE WHEN regexp_matches(lower(text), 'idiot|scum|moron') THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def intent_eval(spark, sf):
    """A rule's pass rate on labelled rows."""
    df = bound(spark, sf, "SELECT toxic, text FROM documents JOIN labels USING (doc_id)").withColumn("predicted", F.lower("text").rlike("idiot|scum|moron").cast("int"))
    ok = F.col("predicted") == F.col("toxic")
    return df.groupBy("predicted").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("double")), 4).alias("rate"))


@query(
    "item_flags",
    """SELECT item_id, status <> 'rejected' AND NOT excluded AS active, NOT is_new AND confidence >= 0.92 AND NOT has_conflict AND NOT is_manual AND NOT ocr_applied AND mode NOT IN ('unknown', 'transfer', 'zeroing') AS safe,
      mode IN ('unknown', 'transfer', 'zeroing') OR ocr_applied OR has_conflict OR confidence < 0.92 AS check_needed, year BETWEEN 1995 AND 1997 AS in_period, status = 'confirmed' AND NOT excluded AND NOT has_conflict AS ready,
      CASE WHEN mode = 'zeroing' THEN 'zeroing' WHEN is_new THEN 'new_object' WHEN mode IN ('absolute', 'delta_plus', 'delta_minus') THEN 'object_amount_update' ELSE 'other' END AS category FROM items""",
)
def item_flags(spark, sf):
    c = F.col
    return rows(spark, sf, "items").select(
        "item_id", p.active_item(c("status"), c("excluded")).alias("active"), p.safe_to_confirm(c("is_new"), c("confidence"), 0.92, c("has_conflict"), c("is_manual"), c("ocr_applied"), c("mode")).alias("safe"),
        p.entry_requires_check(c("mode"), c("ocr_applied"), c("confidence"), 0.92, c("has_conflict")).alias("check_needed"), p.in_program_period(c("year"), F.lit(1995), F.lit(1997)).alias("in_period"),
        p.export_ready(c("status") == "confirmed", ~c("excluded"), ~c("has_conflict")).alias("ready"), t.item_category(c("is_new"), c("mode"), F.lit(False)).alias("category"),
    )


@query(
    "node_flags",
    """SELECT node_id, node_id LIKE 'O%9' AS is_summary, node_id LIKE 'O%' AND node_id NOT LIKE '%9' AS concrete, node_id LIKE 'O%1' AS is_numeric, node_id LIKE 'O%1' AND length(node_id) >= 6 AS is_numeric_long FROM nodes""",
)
def node_flags(spark, sf):
    df = rows(spark, sf, "nodes").withColumn("name", F.when(F.col("node_id").like("O%9"), F.concat(F.lit("Итого по "), "name")).when(F.col("node_id").like("O%1"), F.expr("substring(node_id, 2)")).otherwise(F.col("name")))
    s, v = p.summary_row(F.lit(""), F.col("name"), F.lit("")), p.virtual_node(F.col("name"), F.lit(False))
    return df.select("node_id", s.alias("is_summary"), p.concrete_financial_node(F.col("node_type"), s, v).alias("concrete"), p.numeric_label(F.col("name")).alias("is_numeric"), p.numeric_label_verifier(F.col("name")).alias("is_numeric_long"))


@query("tenant_scope", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 1 OR (o_custkey % 10 = 2 AND o_orderpriority = '1-URGENT')")
def tenant_scope(spark, sf):
    df = bound(spark, sf, "SELECT o_orderkey, o_custkey % 10 AS org_id, o_orderpriority AS created_by FROM orders")
    grants = bound(spark, sf, "SELECT CAST(1 AS BIGINT) AS org_id, CAST(NULL AS STRING) AS created_by FROM region UNION ALL SELECT CAST(2 AS BIGINT), '1-URGENT' FROM region")
    return p.tenant_scope(df, grants).select("o_orderkey")


@query("target_years", "SELECT item_id FROM items WHERE year IN (SELECT DISTINCT year FROM target WHERE o_orderkey % 1000 = 1)")
def target_years(spark, sf):
    return p.target_years(rows(spark, sf, "items"), rows(spark, sf, "target").where("o_orderkey % 1000 = 1")).select("item_id")


@query("stale_payloads", "SELECT o_custkey AS doc_id FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 37 = 0) OR (count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) = 0 AND sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) = 0)")
def stale_payloads(spark, sf):
    g = bound(spark, sf, "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 2024 END AS year, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS amount, CASE WHEN o_orderkey % 37 = 0 THEN 'Служебная строка' ELSE 'x' END AS name FROM orders")
    return p.stale_payloads(g, "служебная строка")


@query("row_filters", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS service, o_orderkey % 4 = 0 AS category, o_orderkey % 5 = 0 AS residual, o_orderkey % 3 = 0 AS queried FROM orders")
def row_filters(spark, sf):
    df = bound(spark, sf, "SELECT o_orderkey AS id FROM orders")
    service = F.when(F.col("id") % 3 == 0, "Служебная  строка").otherwise("Школа")
    values = F.create_map(F.lit("КОСГУ"), F.when(F.col("id") % 4 == 0, "310").otherwise(""), F.lit("субКОСГУ"), F.lit("1"))
    name = F.when(F.col("id") % 5 == 0, "Нераспределенный остаток").otherwise("Остаток сверх объема")
    return df.select("id", p.service_row(service, "служебная строка").alias("service"), p.category_code_present(values).alias("category"), p.visible_residual(name, ["нераспределенный"]).alias("residual"), p.matches_query(service, F.lit("служебными")).alias("queried"))


@query("funding_map_to_rows", "SELECT node_id, year, source_type, CAST(sum(amount) AS DECIMAL(20,2)) AS amount FROM lines GROUP BY ALL")
def funding_map_to_rows(spark, sf):
    sums = rows(spark, sf, "lines").groupBy("node_id", "year", "source_type").agg(F.sum("amount").cast("decimal(20,2)").alias("amount"))
    maps = sums.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("::", "year", "source_type"), "amount"))).alias("funding"))
    return a.funding_map_to_rows(maps, "funding")


@query("first_nonblank", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS v FROM orders")
def first_nonblank(spark, sf):
    cell = lambda h, v: F.struct(F.lit(h).alias("header"), v.alias("text"))
    df = bound(spark, sf, "SELECT o_orderkey AS id, o_orderpriority, o_orderstatus FROM orders")
    cells = F.array(cell("code", F.lit("9")), cell("name 1", F.when(F.col("id") % 2 == 0, F.col("o_orderpriority")).otherwise(" ")), cell("name 2", F.col("o_orderstatus")))
    return df.select("id", a.first_nonblank(cells, lambda h: h.contains("name")).alias("v"))


@query("json_report", "SELECT r_name, count(*) AS n, min(c_custkey) AS first FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def json_report(spark, sf):
    """Rows through JSON and back."""
    df = bound(spark, sf, "SELECT r_name, count(*) AS n, min(c_custkey) AS first, CAST(NULL AS STRING) AS gone FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
    both = df.select(a.compact_struct("r_name", "gone").alias("x"), a.to_jsonable("n", "first").alias("y"))
    return both.where(~F.col("x").contains("gone")).select(F.get_json_object("x", "$.r_name").alias("r_name"), F.get_json_object("y", "$.n").cast("bigint").alias("n"), F.get_json_object("y", "$.first").cast("bigint").alias("first"))


@query("merge_summary", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'template' END AS policy, 'template' AS mode FROM supplier")
def merge_summary(spark, sf):
    df = bound(spark, sf, "SELECT s_suppkey AS id FROM supplier")
    left = F.create_map(F.lit("policy"), F.lit("template"), F.lit("mode"), F.lit("template"))
    right = F.map_filter(F.create_map(F.lit("policy"), F.lit("own")), lambda k, v: F.col("id") % 2 == 0)
    out = a.merge_summary(left, right)
    return df.select("id", out["policy"].alias("policy"), out["mode"].alias("mode"))
