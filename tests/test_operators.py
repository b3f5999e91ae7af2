"""Literal cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import arrays, money, text
from ledgerloom.operators import changes, grid, match, tree
from ledgerloom.sources import io
from ledgerloom.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_money(spark):
    parse = lambda v, *u: one(spark, money.parse_money(F.lit(v), *u))
    assert parse("1 234,565 руб.") == Decimal("1234.57")
    assert parse("12,5", "thousand_rub") == Decimal("12500.00")
    assert parse("—") == parse(None) == parse("") == Decimal("0.00")
    assert parse("нет") is None
    assert one(spark, money.quantize_rub(F.lit("2.345"))) == Decimal("2.35")
    assert one(spark, money.format_money_like(F.lit("1234.00").cast("decimal(20,2)"), F.lit("9 999"))) == "1 234"
    assert one(spark, money.format_money_like(F.lit("1234.50").cast("decimal(20,2)"), F.lit("9999"))) == "1234,50"


def test_sources_differ_by_normalizer(spark):
    x = F.lit("муниципальное образование")
    assert one(spark, text.normalize_source_cells(x)) == "LOCAL_BUDGET"
    assert one(spark, text.normalize_source_catalog(x)) == "DISTRICT_BUDGET"
    assert one(spark, text.normalize_source_cells(F.lit("900203"))) == "FEDERAL_BUDGET"
    assert one(spark, text.normalize_source_catalog(F.lit("federal_budget"))) == "FEDERAL_BUDGET"


def test_rows_and_modes(spark):
    assert one(spark, text.classify_doc_row(F.lit("Основное мероприятие 01"))) == "MAIN_ACTIVITY"
    assert one(spark, text.amount_mode(F.lit("Увеличить на 5 млн"))) == "delta_plus"
    assert one(spark, text.amount_mode(F.lit("перенести с 2025 года на 2026 год"))) == "transfer"
    assert one(spark, text.token_core(F.lit("строительство"))) == "строительств"
    assert one(spark, text.parse_parent_code(F.lit("1020102"))).activity == "02"
    assert one(spark, text.parse_parent_code(F.lit("10201"))) is None


def test_greedy_overlap_uses_a_token_once(spark):
    left, right = F.array(F.lit("школа"), F.lit("школы")), F.array(F.lit("школа"), F.lit("дом"))
    assert one(spark, arrays.token_overlap_greedy(left, right)) == 1
    assert one(spark, arrays.token_overlap_any(left, right)) == 1
    assert one(spark, arrays.name_similarity(F.array(F.lit("a")), F.array(F.lit("a")))) == 1.0


def test_two_rollups_differ(spark):
    nodes = spark.createDataFrame([("r", None), ("c", "r")], "node_id string, parent_id string")
    lines = spark.createDataFrame([("r", 2026, "L", Decimal("5.00")), ("c", 2026, "L", Decimal("7.00"))], "node_id string, year int, source_type string, amount decimal(20,2)")
    total = lambda df: {r.node_id: r.amount for r in df.collect()}
    assert total(tree.rollup_inclusive(lines, nodes)) == {"r": Decimal("12.00"), "c": Decimal("7.00")}
    assert total(tree.rollup_replace(nodes, lines)) == {"r": Decimal("7.00"), "c": Decimal("7.00")}
    assert total(tree.rollup_replace(nodes, lines, F.col("node_id") == "c")) == {"r": Decimal("5.00")}
    # r - h - c: what lies below the excluded h keeps its own total
    deep = spark.createDataFrame([("r", None), ("h", "r"), ("c", "h")], "node_id string, parent_id string")
    assert total(tree.rollup_replace(deep, lines.where("node_id = 'c'"), F.col("node_id") == "h")) == {"c": Decimal("7.00")}


@pytest.mark.parametrize("tall", [32, 4])
def test_rollups_of_a_long_chain(spark, monkeypatch, tall):
    monkeypatch.setattr(tree, "TALL", tall)
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(11)], "node_id string, parent_id string")
    lines = spark.createDataFrame([("n10", 2026, "L", Decimal("7.00")), ("n4", 2026, "L", Decimal("2.00"))], "node_id string, year int, source_type string, amount decimal(20,2)")
    total = lambda df: {r.node_id: int(r.amount) for r in df.collect()}
    assert total(tree.rollup_inclusive(lines, nodes)) == {f"n{i}": 9 if i <= 4 else 7 for i in range(11)}
    assert total(tree.rollup_replace(nodes, lines)) == {f"n{i}": 7 for i in range(11)}
    assert total(tree.propagate_deltas(lines, lines.withColumnRenamed("amount", "delta"), nodes))["n0"] == 9
    pairs = {(r.node_id, r.ancestor_id): r.depth for r in tree.ancestor_closure(nodes).collect()}
    assert pairs == {(f"n{i}", f"n{j}"): i - j for i in range(11) for j in range(i + 1)}


def test_a_cycle_of_parents_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(tree, "TALL", 5)
    nodes = spark.createDataFrame([("r", None), ("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "node_id string, parent_id string")
    lines = spark.createDataFrame([("e", 2026, "L", Decimal("7.00"))], "node_id string, year int, source_type string, amount decimal(20,2)")
    with pytest.raises(ValueError, match="the parents of node a lead back"):
        tree.ancestor_closure(nodes)
    with pytest.raises(ValueError, match="lead back"):
        tree.rollup_inclusive(lines, nodes)


def test_upsert_sets_the_first_line_only(spark):
    lines = spark.createDataFrame([("n", 2026, "L", Decimal("1.00"), 1, 1), ("n", 2026, "L", Decimal("2.00"), 2, 2)], "node_id string, year int, source_type string, amount decimal(20,2), line_no int, line_id int")
    items = spark.createDataFrame([("n", 2026, "L", Decimal("9.00"), 2), ("n", 2026, "L", Decimal("99.00"), 1), ("n", 2026, "L", None, 3), ("n", 2027, "L", None, 4)], "node_id string, year int, source_type string, new_amount decimal(20,2), item_id int")
    amounts = lambda strict: sorted(r.amount for r in changes.apply_amounts(lines, items, ["item_id"], strict).collect())
    assert amounts(False) == [Decimal("2.00"), Decimal("9.00")]
    assert amounts(True) == [Decimal("0.00"), Decimal("9.00")]


def test_ambiguity_stops_the_cascade(spark):
    groups = match.named(spark.createDataFrame([("g", "b", "Школа", None)], "group_key string, block string, name string, code string"), F.col("name"))
    nodes = match.named(spark.createDataFrame([("1", "b", "школа"), ("2", "b", "школа")], "node_id string, block string, name string"), F.col("name"))
    stages = [match.match_exact_name(groups, nodes), match.match_global_name(groups, nodes.where("node_id = '1'"))]
    row = match.match_cascade(groups, stages).first()
    assert (row.node_id, row.match_status, row.confidence) == (None, "NEEDS_CONFIRMATION", 0.5)


def test_blank_names_meet_none_in_the_whole_tree(spark):
    groups = match.named(spark.createDataFrame([("g", "b", "...", None), ("h", "b", None, None), ("i", "b", "Школа", None)], "group_key string, block string, name string, code string"), F.col("name"))
    nodes = match.named(spark.createDataFrame([("1", "c", " - "), ("2", "c", "школа"), ("3", "d", "ШКОЛА")], "node_id string, block string, name string"), F.col("name"))
    assert [(r.group_key, r.match_status) for r in match.match_global_name(groups, nodes).collect()] == [("i", "NEEDS_CONFIRMATION")]


def test_reload_empties_documents_and_survives_a_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    found = lambda: sorted((r.doc_id, r.v) for r in io.read_documents(spark, path, "doc_id string, v int").collect())
    assert found() == []
    io.replace_by_document(df, path, "doc_id", 2)
    broken = df.withColumn("v", F.when(F.col("doc_id") == "b", F.raise_error(F.lit("stop")).cast("int")).otherwise(9))
    with pytest.raises(Exception, match="stop"):
        io.replace_by_document(broken, path, "doc_id", 2)
    assert found() == [("a", 1), ("b", 2)]
    io.replace_by_document(df.limit(0), path, "doc_id", 2, df.where("doc_id = 'a'").select("doc_id"))
    assert found() == [("b", 2)]
    io.replace_by_document(df.limit(0), path, "doc_id", 2, df.select("doc_id"))
    assert found() == []
    io.replace_by_document(df, path, "doc_id", 2)
    assert found() == [("a", 1), ("b", 2)]


def test_a_batch_that_fails_halfway_is_loaded_again(spark, tmp_path):
    path = str(tmp_path / "t")
    arrivals = spark.createDataFrame([("a", "1"), ("b", "x")], "doc_id string, text string")

    def parse(df, stop=False):
        rows = df.where("try_cast(text as int) is not null").select("doc_id", F.col("text").cast("int").alias("v"))
        more = rows.withColumn("v", F.raise_error(F.lit("stop")).cast("int")) if stop else rows
        return {"one": rows, "two": more, "failed": df.where("try_cast(text as int) is null").select("doc_id", F.lit("no number").alias("error"))}

    with pytest.raises(Exception, match="stop"):
        flows.ingest_batch(lambda df: parse(df, True), path, buckets=2)(arrivals, 0)
    for _ in range(2):
        flows.ingest_batch(parse, path, buckets=2)(arrivals, 0)
    read = lambda name: sorted(tuple(r) for r in io.read_documents(spark, f"{path}/{name}").collect())
    assert read("one") == read("two") == [("a", 1)]
    assert [r[0] for r in read("quarantine")] == ["b"]
    # done once: a batch of this number is not loaded any more
    flows.ingest_batch(parse, path, buckets=2)(arrivals.withColumn("text", F.lit("7")), 0)
    assert read("one") == [("a", 1)]
    flows.ingest_batch(parse, path, buckets=2)(arrivals.where("doc_id = 'b'").withColumn("text", F.lit("5")), 1)
    assert read("one") == [("a", 1), ("b", 5)]
    status = io.read_documents(spark, f"{path}/status")
    assert sorted((r.doc_id, r.status, r.batch_id) for r in status.collect()) == [("a", "parsed", 0), ("b", "parsed", 1)]
    assert io.read_documents(spark, f"{path}/quarantine", "doc_id string").isEmpty()


def test_reload_by_document_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    io.replace_by_document(df, path, "doc_id")
    io.replace_by_document(df.where("doc_id = 'a'").withColumn("v", F.lit(5)), path, "doc_id")
    assert sorted((r.doc_id, r.v) for r in io.read_documents(spark, path).collect()) == [("a", 5), ("b", 2)]
    for bucket in (1, 2):
        io.replace_by_document(df, f"{path}{bucket}", "doc_id", bucket)
        io.replace_by_document(df.where("doc_id = 'b'").withColumn("v", F.lit(7)), f"{path}{bucket}", "doc_id", bucket)
        assert sorted((r.doc_id, r.v) for r in io.read_documents(spark, f"{path}{bucket}").collect()) == [("a", 1), ("b", 7)]
    io.write_reconciliation_report(df, "doc_id", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    io.write_change_report(df, str(tmp_path / "c"))
    io.append_audit(spark.createDataFrame([("x", "2026-01-02 03:04:05")], "action string, ts string").withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_streams_agree_with_tables(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "user_id long, event_type string, ts timestamp, event_id long"
    df = spark.createDataFrame([(1, "a", "2026-01-01 00:10:00", 1), (1, "b", "2026-01-01 00:20:00", 2), (2, "a", "2026-01-01 02:00:00", 3)], "user_id long, event_type string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for name, fn in (("latest", lambda d: flows.latest_status(d, "user_id", "event_type", ["ts", "event_id"])), ("audit", lambda d: flows.audit_counts(d))):
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, fn(df).collect()))
    out = str(tmp_path / "out")
    for _ in range(2):
        flows.stream_ingest(spark, source, schema, lambda d: {"events": d}, out, "user_id", str(tmp_path / "cp")).awaitTermination()
    assert io.read_documents(spark, f"{out}/events").count() == 3


#: Fixed: messages and what they ask for.
INTENTS = {
    "generate_docx": ["выгрузи новую редакцию", "подготовь отчет", "сформируй DOCX", "сделай Word файл", "скачай новую программу", "подтверди надежные строки", "подтверди все", "подтверждаю все 3 строки", "подтверди проект изменений"],
    "run_analysis": ["проанализируй изменения", "проведи анализ документов", "пересчитай программу"],
    "create_change_set": ["создай проект изменений", "подготовь ChangeSet"],
    "validate_control_sums": ["проверь контрольные суммы", "сходятся ли итоги по годам", "где несовпадения?", "покажи расхождения", "почему не сходится 2028 год?", "перепроверь суммы", "сверь программу с Excel"],
    "explain_change": ["что поменялось по Черустям", "почему в 2028 сумма стала больше", "объясни изменения по объекту ВЗУ"],
    "show_pending": ["покажи ручную проверку", "какие строки требуют ручной вставки", "что спорно и требует подтверждения"],
    "choose_source_priority": ["используй Excel как главный источник", "применяй PDF-основание как приоритет"],
    "show_changeset": ["покажи проект изменений", "какой сейчас ChangeSet"],
    "list_generated_documents": ["какие файлы уже сформированы", "покажи готовые документы"],
    "smalltalk": ["привет"],
    "unknown": ["удали все документы и начни заново", "поставь сумму 100 рублей без проверки"],
}


def test_intents(spark):
    df = spark.createDataFrame([(k, x) for k, xs in INTENTS.items() for x in xs], "want string, message string").withColumn("d", text.intent_decision(F.col("message")))
    rows = {r.message: r for r in df.collect()}
    assert len(rows) == 36 and {m: r.d.intent for m, r in rows.items()} == {m: r.want for m, r in rows.items()}
    assert rows["почему не сходится 2028 год?"].d.year == 2028 and rows["почему в 2028 сумма стала больше"].d.year == 2028
    assert rows["что поменялось по Черустям"].d.object_query == "черустям" and rows["объясни изменения по объекту ВЗУ"].d.object_query == "взу"
    assert all((r.d.confidence >= 0.55) == (r.want != "unknown") for r in rows.values())


def test_texts_of_agreements(spark):
    said = {
        1: "Министерство сообщает: по объекту «ВЗУ Черусти» на 2028 год средства бюджета Московской области увеличить с 690 689,18 тыс. рублей до 780 689,18 тыс. рублей.",
        2: "По объекту «ВЗУ Черусти» на 2028 год увеличить на 10 000 000 рублей средства бюджета Московской области.",
        3: "По объекту «ВЗУ Черусти» на 2027 год уменьшить на 5 000 000 рублей средства местного бюджета.",
        4: "По объекту «ВЗУ Черусти» перенести 7 000 000 рублей с 2026 года на 2027 год.",
        5: "По объекту «ВЗУ Черусти» на 2028 год исключить финансирование из средств местного бюджета.",
    }
    pages = spark.createDataFrame([(i, 1, t) for i, t in said.items()], "doc_id int, page_number int, text string")
    got = {r.doc_id: r for r in grid.change_fields(grid.change_windows(pages)).collect()}
    assert len(got) == 5 and all(r.object_name == "ВЗУ Черусти" for r in got.values())
    show = lambda r: (r["mode"], r.year, r.source_type, *(None if x is None else str(x) for x in (r.old_amount, r.new_amount, r.delta)))
    assert show(got[1]) == ("absolute", 2028, "REGIONAL_BUDGET", "690689180.00", "780689180.00", "90000000.00") and got[1].confidence >= Decimal("0.8")
    assert show(got[2]) == ("delta_plus", 2028, "REGIONAL_BUDGET", None, None, "10000000.00")
    assert show(got[3]) == ("delta_minus", 2027, "LOCAL_BUDGET", None, None, "-5000000.00")
    assert got[4]["mode"] == "transfer" and (got[4].from_year, got[4].to_year, str(got[4].delta)) == (2026, 2027, "7000000.00")
    assert show(got[5])[:5] == ("zeroing", 2028, "LOCAL_BUDGET", None, "0.00") and got[5].confidence < Decimal("0.8")


def test_passport_tables(spark):
    table = [["Источник", "Всего", "2026", "2027 год"], ["Средства бюджета Московской области", "3 736 797,28", "1 858 904,68", "1"], ["Всего", "5", "2", "3"]]
    cells = [(1, 1, i, j, x) for i, row in enumerate(table) for j, x in enumerate(row)] + [(1, 0, 0, 0, "Наш источник знаний"), (1, 0, 0, 1, "2026")]
    got = {(r.kind, r.year, r.source_type): (str(r.amount), r.table_idx, r.row_idx, r.col_idx) for r in grid.passport_amounts(spark.createDataFrame(cells, "doc_id int, table_idx int, row_idx int, col_idx int, text string")).collect()}
    assert got["source", 2026, "REGIONAL_BUDGET"] == ("1858904680.00", 1, 1, 2) and got["source_total", None, "REGIONAL_BUDGET"][0] == "3736797280.00"
    assert got["year_total", 2027, None] == ("3000.00", 1, 2, 3) and got["grand_total", None, None][0] == "5000.00" and len(got) == 6


def test_names_meet_by_rare_words(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = "школа школы дорога дорогами дом котельная котельной сквер реконструкция строительство парк".split()
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    groups = match.named(spark.createDataFrame([(f"g{i}", f"b{i % 3}", name(), None) for i in range(60)], "group_key string, block string, name string, code string"), F.col("name"))
    nodes = match.named(spark.createDataFrame([(f"n{i}", f"b{i % 3}", name()) for i in range(60)], "node_id string, block string, name string"), F.col("name"))
    every = groups.select("group_key", "block", F.col("tokens").alias("l")).join(nodes.select("node_id", "block", F.col("tokens").alias("r")), "block")
    score = {(r.group_key, r.node_id): r.s for r in every.select("group_key", "node_id", F.round(arrays.name_similarity(F.col("l"), F.col("r")), 4).alias("s")).collect()}
    for threshold in (0.5, 0.92):
        want = {}
        for g, pairs in itertools.groupby(sorted(score.items()), key=lambda x: x[0][0]):
            best = sorted(((-s, k[1]) for k, s in pairs))
            if -best[0][0] >= threshold:
                clear = len(best) == 1 or best[1][0] - best[0][0] > 0.05
                want[g] = best[0][1] if clear else None
        assert {r.group_key: r.node_id for r in match.match_fuzzy(groups, nodes, threshold).collect()} == want
