"""Every registered query by name, and its SQL.

BINDINGS say how the driver's tables stand for the budget tables; they are plain SQL that both
engines run, so a query and its oracle begin from the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark pages conversations embeddings".split()

BINDINGS = {
    # region - nation - customer - order stand for subprogram - main activity - activity - object
    "nodes": """
        SELECT 'ROOT' AS node_id, CAST(NULL AS STRING) AS parent_id, 'program' AS node_type, 'Program' AS name, CAST(NULL AS STRING) AS code, CAST(NULL AS STRING) AS display_number
        UNION ALL SELECT concat('R', r_regionkey), 'ROOT', 'subprogram', r_name, concat('10', r_regionkey), concat(r_regionkey + 1, '')
        UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 'main_activity', n_name, concat('10', n_regionkey, '0', n_nationkey), concat(n_regionkey + 1, '.', n_nationkey + 1)
        UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey), 'activity', c_name, concat('C', c_custkey), concat(c_nationkey + 1, '.', c_custkey)
        UNION ALL SELECT concat('O', o_orderkey), concat('C', o_custkey), 'object', concat('Order ', o_orderkey), concat('O', o_orderkey), concat(o_custkey, '.', o_orderkey) FROM_orders""",
    "lines": """
        SELECT concat('O', l_orderkey) AS node_id, CAST(year(l_shipdate) AS INT) AS year,
          CASE l_returnflag WHEN 'A' THEN 'LOCAL_BUDGET' WHEN 'N' THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END AS source_type,
          CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_linenumber AS line_no FROM lineitem""",
    "own_lines": """
        SELECT * FROM lines UNION ALL
        SELECT concat('C', c_custkey), 2000, 'LOCAL_BUDGET', CAST(c_acctbal AS DECIMAL(20,2)), 1 FROM customer""",
    # a second source: orders dated in years, every 7th dropped, every 11th a tenth higher
    "target": """
        SELECT concat('C', o_custkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type,
          CAST(CAST(o_totalprice AS DECIMAL(20,2)) + CASE WHEN o_orderkey % 11 = 0 THEN CAST(floor(o_totalprice / 10) AS DECIMAL(20,2)) ELSE 0 END AS DECIMAL(20,2)) AS amount, o_orderkey
        FROM orders WHERE o_orderkey % 7 <> 0""",
    "current": """
        SELECT concat('C', o_custkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year, 'LOCAL_BUDGET' AS source_type,
          CAST(o_totalprice AS DECIMAL(20,2)) AS amount, o_orderkey FROM orders""",
    # change items: one an order
    "items": """
        SELECT o_orderkey AS item_id, concat('set', o_custkey % 50) AS set_id, concat('C', o_custkey) AS node_id, CAST(year(o_orderdate) AS INT) AS year,
          CASE o_orderkey % 3 WHEN 0 THEN 'LOCAL_BUDGET' WHEN 1 THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END AS source_type,
          CASE o_orderkey % 6 WHEN 0 THEN 'zeroing' WHEN 1 THEN 'delta_plus' WHEN 2 THEN 'delta_minus' WHEN 3 THEN 'transfer' WHEN 4 THEN 'absolute' ELSE 'unknown' END AS mode,
          CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status,
          CASE WHEN o_orderkey % 6 = 2 THEN -CAST(o_totalprice AS DECIMAL(20,2)) ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS amount,
          CAST(floor(o_totalprice / 2) AS DECIMAL(20,2)) AS old_amount,
          CAST((o_orderkey % 100) / 100.0 AS DECIMAL(5,4)) AS confidence,
          o_orderkey % 5 = 0 AS is_new, o_orderkey % 17 = 0 AS has_conflict, o_orderkey % 13 = 0 AS is_manual, o_orderkey % 19 = 0 AS ocr_applied, o_orderkey % 23 = 0 AS excluded,
          o_orderdate AS created_at, o_orderpriority AS priority
        FROM orders""",
    "groups": """
        SELECT concat(p_brand, '|', p_name) AS group_key, p_brand AS brand, p_name AS object_name, CAST(year(l_shipdate) AS INT) AS year,
          CASE l_returnflag WHEN 'A' THEN 'LOCAL_BUDGET' WHEN 'N' THEN 'REGIONAL_BUDGET' ELSE 'FEDERAL_BUDGET' END AS source_type,
          CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_orderkey, l_linenumber, p_partkey
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}
BINDINGS["nodes"] = BINDINGS["nodes"].replace("concat(r_regionkey + 1, '')", "concat(r_regionkey + 1, '') FROM region").replace("concat(n_regionkey + 1, '.', n_nationkey + 1)", "concat(n_regionkey + 1, '.', n_nationkey + 1) FROM nation").replace("concat(c_nationkey + 1, '.', c_custkey)", "concat(c_nationkey + 1, '.', c_custkey) FROM customer").replace("FROM_orders", "FROM orders")


def needed(sql: str) -> list[str]:
    """The bindings that a text of SQL names, with those that they need, in order."""
    out: list[str] = []
    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            out += [*needed(BINDINGS[name]), name]
    return list(dict.fromkeys(out))


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the bindings and the tables, without temporary views."""
    names = needed(sql)
    text = ("WITH " + ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names) + f" {sql}") if names else sql
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text, re.I)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(\b(?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", text, flags=re.I)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound(spark, sf_dir, f"SELECT * FROM {name}")


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir); the oracle's bindings are put before it."""

    def put(fn):
        QUERIES[name] = fn
        if oracle:
            names = needed(oracle)
            with_ = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names)
            text = oracle.strip()
            if not names:
                ORACLES[name] = text
            elif text.upper().startswith("WITH RECURSIVE"):
                ORACLES[name] = f"WITH RECURSIVE {with_}, {text[14:]}"
            elif text.upper().startswith("WITH"):
                ORACLES[name] = f"WITH {with_}, {text[4:]}"
            else:
                ORACLES[name] = f"WITH {with_} {text}"
        return fn

    return put


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a query that writes and reads again: in the session's shared checkpoint folder, or, in local mode only, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
