"""Queries that must do their whole job."""

import os

import pytest
from test_oracles import SF

from ledgerloom.operators import grid
from ledgerloom.plans import registry


def test_results_of_programs_stand_in_their_own_tables(spark):
    rows = [(1, 1, 0, "1.", "Дорога"), (1, 2, 10, "", "Наименование результата"), (1, 2, 11, "2.", "Итог"), (1, 3, 20, "1.1", "Мост"), (2, 1, 0, "1.", "Сад")]
    rows = spark.createDataFrame(rows, "doc_id long, table_idx int, row_idx long, number string, name string")
    sources = spark.createDataFrame([(1, 0, "местный бюджет", 5), (1, 21, "федеральный бюджет", 7)], "doc_id long, row_idx long, source string, amount int")
    cells = spark.createDataFrame([], "doc_id long, table_idx int, row_idx int, col_idx int, text string")
    found = grid.build_program(rows, sources, cells, spark.createDataFrame([], "doc_id long, para_idx long, text string"))
    assert {(r.doc_id, r.row_idx) for r in found["nodes"].collect()} == {(1, 0), (1, 20), (2, 0)}
    assert {(r.doc_id, r.row_idx, r.key) for r in found["results"].collect()} == {(1, 11, "result:2:итог")}
    assert {(r.row_idx, r.source_type, int(r.amount)) for r in found["lines"].collect()} == {(0, "LOCAL_BUDGET", 5), (21, "FEDERAL_BUDGET", 7)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_programs_have_the_rows_of_all_parts(spark):
    found = registry.QUERIES["build_program"](spark, SF)
    full = {"nodes": "key", "lines": "amount", "results": "key", "subprograms": "name", "metadata": "doc_id", "passport": "amount"}
    n = {r.part: r for r in found.groupBy("part").count().collect()}
    assert set(n) == set(full) and all(r["count"] > 100 for r in n.values())
    for part, column in full.items():
        assert not found.where(f"part = '{part}' and {column} is null").limit(1).collect(), part


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_cell_updates_come_from_all_steps(spark):
    found = registry.QUERIES["cell_update_plan"](spark, SF).select("reason", "node_id", "item_id").collect()
    assert {r.reason for r in found} == {"node_total_year", "node_total_column", "funding_line_year", "funding_line_total_column", "passport_source_year", "passport_source_total_column", "passport_total", "passport_grand_total_column"}
    # customers, nations above them, summary rows of nations, mirrors of customers, orders with their items, and the passports' programs
    assert {r.node_id[0] for r in found} == set("CNTDOR")
    assert {r.item_id is None for r in found if r.node_id[0] == "O"} == {False}
