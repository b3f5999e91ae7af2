"""Messages to the assistant: one an order, of ten forms, and all turns of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.intents import decide_messages
from .registry import bound, query

MESSAGES = """
  SELECT concat('o', o_orderkey) AS id, CASE o_orderkey % 10
      WHEN 0 THEN concat('По объекту Школа ', o_custkey, ' в ', year(o_orderdate) + 25, ' местный бюджет увеличь сумму на ', o_custkey + 1, ' млн')
      WHEN 1 THEN concat('Поставь по позиции Мост ', o_custkey, 'а сумму ', o_orderkey, ',5 тыс. руб. из федерального бюджета')
      WHEN 2 THEN concat('подтверди строки ', o_orderkey, ' и ', o_custkey + 3000)
      WHEN 3 THEN concat('Подтверждаю все ', o_custkey + 3000, ' строк')
      WHEN 4 THEN concat('почему не сходится ', year(o_orderdate) + 25, ' год?')
      WHEN 5 THEN concat('Проверь файл отчёт_', o_orderkey, '.pdf')
      WHEN 6 THEN concat('Excel главный, PDF только для проверки № ', o_orderkey)
      WHEN 7 THEN 'внеси изменения'
      WHEN 8 THEN concat('Удали всё по Школе ', o_custkey, '!')
      ELSE concat('сделай актуальной активную версию ', o_orderkey) END AS text,
    o_custkey % 2 = 0 AS loaded, CASE WHEN o_orderkey % 100 = 7 THEN 'show_pending' END AS quick FROM orders
  UNION ALL SELECT concat('c', conv_id, '-', turn), text, true, CAST(NULL AS STRING) FROM conversations"""

KEYS = ["intent", "confidence", "year", "version_target", "object_query", "source_type", "amount_operation", "amount_rub", "delta_rub", "source_mode", "source_priority", "confirmation_mode", "expected_count", "change_item_ids", "document_query", "query"]


@query(
    "message_decisions",
    r"""WITH m AS (SELECT concat('o', o_orderkey) AS id, o_orderkey % 10 AS k, o_orderkey AS o, o_custkey AS c, CAST(year(o_orderdate) + 25 AS INT) AS y, o_custkey % 2 = 0 AS loaded, o_orderkey % 100 = 7 AS quick FROM orders),
    s AS (SELECT concat('c', conv_id, '-', turn) AS id, text, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\p{Nd}]+', ' ', 'g')), ' ') AS w FROM conversations)
    SELECT id, CASE WHEN quick THEN 'show_pending' WHEN k = 7 AND loaded THEN 'generate_docx' ELSE ['recalculate_object', 'recalculate_object', 'generate_docx', 'generate_docx', 'validate_control_sums', 'check_documents', 'choose_source_priority', 'recalculate_object', 'unknown', 'approve_generated_version'][k + 1] END AS intent,
      CAST(CASE WHEN quick THEN 1.00 WHEN k IN (0, 1) THEN 0.96 WHEN k = 9 THEN 0.98 ELSE 0.95 END AS DECIMAL(3,2)) AS confidence,
      CAST(CASE WHEN quick THEN NULL WHEN k IN (0, 4) THEN y WHEN k IN (2, 5, 6, 9) AND o BETWEEN 2000 AND 2099 THEN o END AS INT) AS year, CASE WHEN k = 9 THEN 'active' END AS version_target,
      CASE k WHEN 0 THEN concat('школа ', c) WHEN 1 THEN concat('мост ', c, 'а') WHEN 2 THEN 'подтверди' WHEN 3 THEN 'подтверждаю' WHEN 4 THEN 'сходится' WHEN 6 THEN 'excel' WHEN 8 THEN concat('школе ', c) WHEN 9 THEN 'актуальной' END AS object_query,
      CASE k WHEN 0 THEN 'LOCAL_BUDGET' WHEN 1 THEN 'FEDERAL_BUDGET' END AS source_type,
      CASE WHEN quick OR k IN (4, 7) THEN NULL WHEN k = 0 THEN 'increase' WHEN k IN (5, 6, 9) AND o BETWEEN 2000 AND 2099 THEN NULL WHEN k = 8 AND c BETWEEN 2000 AND 2099 THEN NULL ELSE 'set' END AS amount_operation,
      CAST(CASE WHEN quick THEN NULL WHEN k = 1 THEN o * 1000 + 500 WHEN k IN (2, 3) THEN c + 3000 WHEN k = 8 AND c NOT BETWEEN 2000 AND 2099 THEN c WHEN k IN (5, 6, 9) AND o NOT BETWEEN 2000 AND 2099 THEN o END AS DECIMAL(20,2)) AS amount_rub,
      CAST(CASE k WHEN 0 THEN (c + 1) * 1000000 END AS DECIMAL(20,2)) AS delta_rub,
      CASE WHEN quick THEN NULL WHEN k IN (0, 1) OR k = 7 AND NOT loaded THEN 'manual_instruction' WHEN k = 6 THEN 'xlsx_target_with_pdf_evidence' END AS source_mode, CASE k WHEN 6 THEN 'xlsx_finance' END AS source_priority,
      CASE k WHEN 2 THEN 'specific' WHEN 3 THEN 'all_confirmed' END AS confirmation_mode, CAST(CASE k WHEN 3 THEN c + 3000 END AS INT) AS expected_count, CASE k WHEN 2 THEN concat(o, ',', c + 3000) END AS change_item_ids,
      CASE k WHEN 5 THEN concat('отчет ', o) END AS document_query, CAST(NULL AS VARCHAR) AS query FROM m
    UNION ALL SELECT id, 'unknown', 0.20, NULL, NULL, list_filter(w, lambda x: len(x) >= 5)[1], NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s""",
)
def message_decisions(spark, sf):
    """T29 in full. Numbers of the form 20xx are years and no amounts."""
    d = decide_messages(bound(spark, sf, MESSAGES), "text", F.col("loaded"), F.col("quick"))
    ids = F.array_join(F.col("decision.change_item_ids").cast("array<string>"), ",")
    return d.select("id", *((ids if k == "change_item_ids" else F.col(f"decision.{k}")).alias(k) for k in KEYS))
