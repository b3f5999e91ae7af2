"""Work that must grow no faster than its input."""

from ledgerloom.operators import finance, grid, insertions, planning, reconcile, search, stages, tree


def plan(df):
    return df._jdf.queryExecution().toString()


def test_places_of_activities_are_found_in_one_pass(spark):
    nodes = [(1, "P", None, 0, 5, "1.", False)] + [(1, f"A{i}", "P", 0, 10 * i, f"1.{i}", False) for i in range(1, 40, 2)]
    nodes = spark.createDataFrame(nodes, "doc_id long, node_id string, parent_id string, table_idx int, row_idx long, display_number string, is_new boolean")
    objects = spark.createDataFrame([(1, f"B{i}", "P", f"1.{i}", True) for i in range(0, 42, 2)], "doc_id long, object_id string, parent_id string, display_number string, is_aggregate boolean")
    lines = spark.createDataFrame([("A3", 0, 31), ("A39", 0, 395)], "node_id string, src_table int, src_row long")
    found = insertions.insert_anchors(objects, nodes, lines)
    places = {r.object_id: (r.insert_after, r.template_row) for r in found.collect()}
    assert len(places) == 21 and places["B0"] == (5, 5) and places["B2"] == (11, 10) and places["B4"] == (32, 30) and places["B40"] == (396, 390)
    # a frame that ends with the last row is read anew for each row
    assert "rowframe, 1, unboundedfollowing" not in plan(found).lower()


def test_crowded_ancestors_reach_no_single_task(spark):
    nodes = [("R", None, "program", "P")] + [(f"C{i}", "R", "activity", f"A{i}") for i in range(3)] + [(f"O{i}", f"C{i % 3}", "object", f"X{i}") for i in range(12)]
    nodes = spark.createDataFrame(nodes, "node_id string, parent_id string, node_type string, name string")
    closure = tree.ancestor_closure(nodes)
    want = {("R", "P", None)} | {(f"C{i}", "P", f"A{i}") for i in range(3)} | {(f"O{i}", "P", f"A{i % 3}") for i in range(12)}
    for crowded in (1, 6, 1000):
        found = tree.hierarchy_struct(nodes, closure, ["program", "activity"], crowded)
        assert {tuple(r) for r in found.collect()} == want
        assert plan(found).count("BroadcastHashJoin") >= 2


def test_lines_of_leaves_are_summed_once(spark, monkeypatch):
    seen, real = [], tree.settled

    def kept(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("sum(amount"))
        return real(df)

    monkeypatch.setattr(tree, "settled", kept)
    nodes = spark.createDataFrame([("r", None), ("c", "r")], "node_id string, parent_id string")
    lines = spark.createDataFrame([("c", 2024, "x", 7), ("c", 2024, "x", 1), ("r", 2024, "x", 5)], "node_id string, year int, source_type string, amount int")
    assert {(r.node_id, int(r.amount)) for r in tree.rollup_replace(nodes, lines).collect()} == {("r", 8), ("c", 8)}
    assert seen[0] == 1


def test_amounts_are_no_filters_and_labels_are_read_once(spark):
    cells = spark.createDataFrame([(1, 10, 2, "5,50"), (1, 10, 3, "0"), (1, 10, 0, "имя"), (1, 11, 2, "-")], "doc_id int, row_idx int, col_idx int, text string")
    layout = spark.createDataFrame([(1, 2, 2026, "UNKNOWN", True), (1, 3, 2027, "FEDERAL_BUDGET", False)], "doc_id int, col_idx int, year int, source_type string, needs_row_source boolean")
    sources = spark.createDataFrame([(1, 10, "LOCAL_BUDGET")], "doc_id int, row_idx int, row_source string")
    found = grid.unpivot_funding(cells, layout, sources)
    assert [(r.row_idx, r.year, r.source_type, str(r.amount)) for r in found.collect()] == [(10, 2026, "LOCAL_BUDGET", "5.50")]
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "decimal(24,6)" in x]
    rows = [(0, 0, "\tИсточники"), (0, 1, "Всего"), (0, 2, "2026"), (1, 0, "Местный бюджет"), (1, 1, "9"), (1, 2, "7"), (2, 0, None), (2, 2, "3"), (3, 0, "ВСЕГО"), (3, 2, "8")]
    passport = grid.passport_amounts(spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id int, table_idx int, row_idx int, col_idx int, text string"))
    assert {(r.kind, r.year, r.source_type, int(r.amount)) for r in passport.collect()} == {("source", 2026, "LOCAL_BUDGET", 7000), ("source_total", None, "LOCAL_BUDGET", 9000), ("year_total", 2026, None, 8000)}
    assert "внебюдж" not in plan(passport)


def test_bodies_are_not_joined_with_headers(spark):
    cells = spark.createDataFrame([(1, 1, 0, "Имя"), (1, 2, 0, "полное"), (1, 9, 0, "тело"), (2, 1, 1, " ")], "doc_id int, row_idx int, col_idx int, text string")
    header = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, row_idx int")
    found = grid.header_text(cells, header)
    assert [tuple(r) for r in found.collect()] == [(1, 0, "Имя полное")]
    assert "max(row_idx" in plan(found)


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k")
    assert stages.dealt(rows, "k", rows=50).rdd.getNumPartitions() == 20
    assert stages.dealt(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_expected_sums_are_dealt_and_made_in_one_pass(spark):
    nodes = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "node_id string, s boolean")
    lines = spark.createDataFrame([("a", 2024, "x", 7), ("a", 2024, "y", 1), ("b", 2024, "x", 5), ("b", 2024, "y", 4), ("c", 2024, "x", 9), ("a", 2024, None, 2)], "node_id string, year int, source_type string, amount int")
    found = reconcile.aggregate_expected(nodes, lines, nodes.s)
    assert {(r.node_id, r.source_type, int(r.amount)) for r in found.collect()} == {("a", "x", 7), ("a", "y", 1), ("a", None, 2), ("b", "TOTAL", 9)}
    assert "Union" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)


def test_cells_of_a_node_are_made_in_one_pass(spark):
    lines = spark.createDataFrame([("a", 2024, 1004), ("a", 2025, 1006), ("a", 2024, 1000), ("b", 2024, 5)], "node_id string, year int, amount int")
    coords = spark.createDataFrame([("a", 3, 6, 2024, 5), ("b", 4, 6, 2024, 5)], "node_id string, row_idx int, first_col int, first_year int, total_col int")
    found = planning.cell_update_plan(lines, coords, spark.createDataFrame([("a",), ("a",)], "node_id string"))
    assert sorted((r.node_id, r.row_idx, r.col_idx, int(r.value)) for r in found.collect()) == [("a", 3, 5, 3010), ("a", 3, 6, 2000), ("a", 3, 7, 1010)]
    assert "Union" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)


def test_common_tokens_are_cut_before_they_meet_words(spark):
    chunks = spark.createDataFrame([(i, None, "common other", "", i // 2) for i in range(20)] + [(7, None, "common other", "", 3)], "chunk_id long, title string, content string, chunk_type string, created_at long")
    asked = spark.createDataFrame([("q", "comm othe")], "query_id string, query string")
    found = search.search_many(asked, search.search_index(chunks), 3)
    assert {(r.chunk_id, r.rank) for r in found.collect()} == {(19, 1), (18, 2), (17, 3)}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank(" in text


def test_rules_of_finance_rows_are_no_filters(spark, monkeypatch):
    seen, real = [], finance.settled

    def kept(df):
        seen.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "RLIKE" in x)
        return real(df)

    monkeypatch.setattr(finance, "settled", kept)
    head = ["№", "Наименование", "Срок", "Источник", "Всего", "2026 год"]
    rows = [(1, 1, 0, head), (1, 1, 1, list("123456")), (1, 1, 9, ["1.2.3", "Школа", "2026", "Местный бюджет", "5", "7"]), (1, 1, 10, ["1.2.4", "Сад", "2026", "нет", "5", "7"])]
    rows = spark.createDataFrame(rows, "doc_id int, table_idx int, row_idx long, cells array<string>")
    _, lines = finance.finance_rows(rows, spark.createDataFrame([(1, 1, "s")], "doc_id int, table_idx int, subprogram_key string"))
    assert [(r.row_idx, r.year, r.source_type, int(r.amount)) for r in lines.collect()] == [(9, 2026, "LOCAL_BUDGET", 7000)]
    assert not seen


def test_pages_of_patches_are_dealt(spark):
    text = "По объекту «Школа 5» на 2027 год уменьшить на 100 рублей средства местного бюджета."
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text), (2, 1, "Слова")], "doc_id int, page_number int, text string")
    placed = spark.createDataFrame([(1, 1.0, 1.0, 0, "7", 2027, "LOCAL_BUDGET")], "doc_id int, y double, x double, col int, text string, year int, source_type string")
    controls = spark.createDataFrame([], "doc_id int, year int, source_type string, amount decimal(20,2)")
    found = grid.build_patch_checked(pages, placed, controls)[0]
    assert [(r.doc_id, r.page_number, r.object_name, r.mode) for r in found.collect()] == [(1, 1, "Школа 5", "delta_minus")]
    assert "REPARTITION_BY_NUM" in plan(found)


def test_lines_of_insertions_are_read_once(spark, monkeypatch):
    seen, real = [], insertions.settled

    def kept(df):
        seen.append(df)
        return real(df)

    monkeypatch.setattr(insertions, "settled", kept)
    nodes = [(1, "P", None, 0, 5, "1.", False), (1, "A", "P", 0, 10, "1.1", False), (1, "B", "P", 0, None, "1.2", True)]
    nodes = spark.createDataFrame(nodes, "doc_id long, node_id string, parent_id string, table_idx int, row_idx long, display_number string, is_new boolean")
    objects = spark.createDataFrame([(1, "B", "P", None, "1.2", False)], "doc_id long, object_id string, parent_id string, anchor_id string, display_number string, is_aggregate boolean")
    lines = [("A", 2024, "LOCAL_BUDGET", 7000, 0, 11), ("B", 2025, "REGIONAL_BUDGET", 5000, 0, None), ("Z", 2025, "OTHER_SOURCE", 1, 0, 99)]
    lines = spark.createDataFrame(lines, "node_id string, year int, source_type string, amount int, src_table int, src_row long")
    found = insertions.plan_insertions(objects, nodes, lines)
    assert {(r.row_idx, r.source_type, int(r.total_amount)) for r in found.collect()} == {(12, "TOTAL", 5000), (13, "REGIONAL_BUDGET", 5000), (14, "LOCAL_BUDGET", 0)}
    assert seen[0].columns == lines.columns
    # lines meet their parents before anything is made distinct
    text = insertions.context_sources(objects, nodes, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") - text.count("Aggregate [parent") <= 1


def test_deltas_and_changed_lines_climb_the_tree_once(spark, monkeypatch):
    seen, real = [], tree.settled

    def kept(df):
        seen.append(df)
        return real(df)

    monkeypatch.setattr(tree, "settled", kept)
    nodes = spark.createDataFrame([("r", None), ("c", "r"), ("d", "r"), ("e", "c"), ("e", "c")], "node_id string, parent_id string")
    lines = spark.createDataFrame([("c", 2024, "x", 7), ("d", 2024, "x", 1), ("d", 2024, "y", 2), ("e", 2024, "x", 10), ("z", 2024, "x", 5)], "node_id string, year int, source_type string, amount int")
    deltas = spark.createDataFrame([("d", 2024, "x", 3), ("r", 2025, "x", -4)], "node_id string, year int, source_type string, delta int")
    found = tree.propagated_and_recomputed(lines, deltas, nodes)
    want = {("c", 2024, "x", 27), ("d", 2024, "x", 4), ("d", 2024, "y", 2), ("e", 2024, "x", 20), ("r", 2024, "x", 31), ("r", 2024, "y", 2), ("r", 2025, "x", -4)}
    assert {(r.node_id, r.year, r.source_type, int(r.amount)) for r in found.collect()} == want
    assert {(r.node_id, r.year, r.source_type, int(r.again)) for r in found.collect()} == want
    # three levels with amounts, the one that ends it, and the nodes with children
    assert len(seen) == 5
    plain = tree.rollup_inclusive(lines, nodes)
    assert {(r.node_id, r.source_type, int(r.amount)) for r in plain.collect()} == {("c", "x", 27), ("d", "x", 1), ("d", "y", 2), ("e", "x", 20), ("r", "x", 28), ("r", "y", 2)}


def test_lines_without_rows_meet_no_window_and_rows_are_dealt(spark):
    from ledgerloom.operators import cellplan

    nodes = spark.createDataFrame([("a", "V")], "node_id string, version_id string")
    columns = "node_id string, line_no long, year int, source_type string, amount int, src_table int, src_row int, cell int, raw string, unit string, total_cell int, total_raw string"
    lines = spark.createDataFrame([("a", 1, 2024, "x", 7, 3, 5, 2, None, None, None, None), ("a", 2, 2025, "x", 8, 3, 5, None, None, None, None, None), ("a", 3, 2024, "x", 9, 3, None, 2, None, None, None, None)], columns)
    cells = cellplan.line_rows(nodes, lines, spark.createDataFrame([("a", 1)], "node_id string, item_id long"))[0]
    assert sorted((r.row_idx, r.col_idx, int(r.amount)) for r in cells.collect()) == [(5, 2, 7), (5, 3, 8)]
    optimized = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(src_row" in optimized.split("Window")[-1]
    assert stages.tasks(lines, 1) == max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_payloads_are_read_once(spark):
    from ledgerloom.streaming import flows

    arrivals = [("a", "program", '{"pages": ["p"], "lines": [{"name": "n", "year": 2024, "source": "x", "amount": "5", "unit": "rub"}]}'), ("b", "program", "{bad"), ("c", "letter", None)]
    tables = flows.parse_payloads(spark.createDataFrame(arrivals, "doc_id string, document_type string, payload string"))
    assert [(r.doc_id, r.year, int(r.amount)) for r in tables["totals"].collect()] == [("a", 2024, 5)]
    assert {(r.doc_id, r.error) for r in tables["failed"].collect()} == {("b", "unreadable"), ("c", "unknown_type")}
    for name in tables:
        assert "from_json" not in plan(tables[name]), name
