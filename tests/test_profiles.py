"""Profiles and insertions on small documents: missing parts, odd rows, empty tables."""

from decimal import Decimal

import pytest

from ledgerloom.operators import insertions, profile

SCHEMAS = [
    "doc_id int, document_type string",
    "doc_id int, line_no int, table_idx int, source_type string, source_col int, total_col int, year_cells array<struct<year:int,col_idx:int>>",
    "doc_id int, kind string, table_idx int, year int, col_idx int",
    "doc_id int, group_key string, source_type string, explicit_zero boolean",
    "doc_id int",
    "doc_id int, table_idx int, table_type string",
    "doc_id int, status string",
    "doc_id int",
]


@pytest.fixture
def profiles(spark):
    def make(*given):
        return {r.doc_id: r for r in profile.profile_documents(*(spark.createDataFrame(x, s) for x, s in zip(given, SCHEMAS))).collect()}

    return make


def test_profiles(profiles):
    cells = [(2027, 6), (2026, 5)]
    got = profiles(
        [(1, "docx_program"), (2, "docx_program"), (3, "xlsx_finance"), (4, "pdf_agreement"), (5, "pdf_procedure"), (6, None), (1, "docx_program"), (None, "docx_program")],
        [(1, 2, 0, "LOCAL_BUDGET", 3, 4, cells), (1, 1, 0, None, 9, 9, None), (1, 3, None, "OTHER_SOURCE", 3, 4, None), (9, 1, 0, "LOCAL_BUDGET", 1, 1, cells)],
        [(1, "source", 5, 2026, 1), (1, "total", 7, 2026, 3), (1, "total", 7, 2027, None)],
        [(3, "a", "LOCAL_BUDGET", True), (3, "a", "FEDERAL_BUDGET", None), (3, "b", None, False), (1, "c", "PRIVATE_FUNDS", True)],
        [(4,), (4,)],
        [(4, 0, "funding"), (4, 1, "funding")],
        [(4, "failed")],
        [(5,)] * 3,
    )
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    one = got[1]
    assert [(t.table_idx, t.source_col, t.total_col, [tuple(c) for c in t.year_cells]) for t in one.finance_tables] == [(0, 3, 4, [(2026, 5), (2027, 6)])]
    assert (one.years, one.sources, one.lines, one.passport_table, [tuple(p) for p in one.passport_years]) == ([2026, 2027], ["LOCAL_BUDGET", "OTHER_SOURCE"], 3, 7, [(2026, 3)])
    assert (one.status, one.confidence, one.warnings, one.groups) == ("active", Decimal("1.00"), [], 0)
    assert (got[2].status, got[2].confidence, got[2].warnings, got[2].finance_tables) == ("failed", Decimal("0.15"), ["no_funding_lines", "no_passport"], [])
    assert (got[3].groups, got[3].zero_groups, got[3].sources, got[3].status) == (2, 1, ["FEDERAL_BUDGET", "LOCAL_BUDGET"], "active")
    assert (got[4].changes, got[4].tables, got[4].table_types, got[4].warnings, got[4].confidence) == (2, 2, ["funding"], ["controls_failed"], Decimal("0.30"))
    assert (got[5].chunks, got[5].status) == (3, "active") and (got[6].warnings, got[6].document_role) == (["unsupported_type"], None)


def test_profiles_of_nothing(profiles):
    assert profiles(*([] for _ in SCHEMAS)) == {}


NODES = "doc_id int, node_id string, parent_id string, table_idx int, row_idx bigint, display_number string, is_new boolean"
OBJECTS = "doc_id int, object_id string, parent_id string, anchor_id string, display_number string, is_aggregate boolean"
LINES = "node_id string, year int, source_type string, amount decimal(20,2), src_table int, src_row bigint"


def given(spark, objects, nodes, lines):
    return spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, c, None if d is None else Decimal(d), e, f) for a, b, c, d, e, f in lines], LINES)


def test_rows_of_new_objects(spark):
    objects = [(1, "x", "p", None, "1.1.3", False), (1, "y", "p", "q", "1.1.4", True), (1, "z", "p", None, "1.1.5", False)]
    nodes = [(1, "p", None, 1, 10, "1.1", False), (1, "a", "p", 1, 11, "1.1.1", False), (1, "x", "p", 1, None, "1.1.3", True), (1, "y", "p", 1, None, "1.1.4", True), (1, "q", None, 1, 50, "1.2", False)]
    lines = [("a", 2026, "FEDERAL_BUDGET", 5, 1, 13), ("x", 2026, "LOCAL_BUDGET", "1004.99", None, None), ("x", 2027, "LOCAL_BUDGET", None, None, None), ("y", 2026, "LOCAL_BUDGET", 2000, None, None), ("q", 2026, "EXTRABUDGETARY", 1, 1, 50)]
    out = insertions.insert_rows(*given(spark, objects, nodes, lines)).orderBy("object_id", "place").collect()
    show = [(r.object_id, r.source_type, str(r.total_amount), [(y.year, str(y.amount)) for y in r.by_year]) for r in out]
    none = [(2026, "0.00"), (2027, "0.00")]
    assert show[:3] == [("x", "TOTAL", "1000.00", [(2026, "1004.99"), (2027, "0.00")]), ("x", "FEDERAL_BUDGET", "0.00", none), ("x", "LOCAL_BUDGET", "1000.00", [(2026, "1004.99"), (2027, "0.00")])]
    assert [r[1:3] for r in show[3:]] == [("FEDERAL_BUDGET", "0.00"), ("LOCAL_BUDGET", "2000.00"), ("EXTRABUDGETARY", "0.00"), ("TOTAL", "6000.00")]


def test_places_of_new_objects(spark):
    nodes = [(1, "p", None, 1, 10, "1.1.", False), (1, "a", "p", 1, 11, "1.1.1", False), (1, "b", "p", 1, 20, "1.1.9", False), (1, "c", "p", 2, 90, "1.1.99", False), (1, "n", "p", 1, 95, "1.1.50", True), (1, "t", "p", 1, 99, "Итого", False), (1, "e", None, 1, 40, "2", False), (1, "f", None, None, 44, "3", False)]
    lines = [("a", 2026, "S", 1, 1, 13), ("a", 2026, "S", 1, 2, 70), ("b", 2026, "S", 1, 1, 22), ("p", 2026, "S", 1, 1, 12)]
    objects = [(1, "plain", "p", None, "1.1.100", False), (1, "early", "p", None, "1.1.0", True), (1, "middle", "p", None, "1.1.5", True), (1, "late", "p", None, "1.1.10", True), (1, "same", "p", None, "1.1.9", True), (1, "childless", "e", None, "2.1", False), (1, "tableless", "f", None, "3.1", False), (2, "elsewhere", "p", None, "1.1.1", False)]
    got = {r.object_id: (r.insert_after, r.template_row) for r in insertions.insert_anchors(*given(spark, objects, nodes, lines)).collect()}
    assert got == {"plain": (22, 20), "early": (12, 12), "middle": (14, 11), "late": (23, 20), "same": (14, 11), "childless": (40, 40)}
    rows = insertions.plan_insertions(*given(spark, objects, nodes, [*lines, ("plain", 2026, "S", 1, None, None), ("middle", 2026, "S", 1, None, None)])).orderBy("row_idx").collect()
    assert [(r.object_id, r.row_idx) for r in rows] == [("middle", 15), ("middle", 16), ("plain", 25), ("plain", 26)]
    assert insertions.plan_insertions(*given(spark, [], [], [])).count() == 0
