"""Repeated names, counts without pairs, closures of many rows, and numbers that look like years."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import grid, match, tree
from ledgerloom.operators.intents import decide_messages


def sides(spark, copies):
    words = ["школа лесная", "школа лесная новая", "парк южный", "дом"]
    rows = [(f"{i}-{c}", "b", w) for i, w in enumerate(words) for c in range(copies)]
    of = lambda key: match.named(spark.createDataFrame(rows, f"{key} string, block string, name string"), F.col("name"))
    return of("group_key").withColumn("code", F.lit(None).cast("string")), of("node_id").withColumn("is_leaf", F.lit(True))


def test_each_wording_is_asked_once(spark, monkeypatch):
    seen, real = [], match.stem_pairs

    def counted(groups, nodes, *how, **more):
        seen.append(groups.count() * nodes.count())
        return real(groups, nodes, *how, **more)

    monkeypatch.setattr(match, "stem_pairs", counted)
    groups, nodes = sides(spark, 50)
    fuzzy = {r.group_key: r for r in match.match_fuzzy(groups, nodes, 0.6).collect()}
    assert len(fuzzy) == 200 and {r.match_status for r in fuzzy.values()} == {"NEEDS_CONFIRMATION"}
    assert match.match_event_name(groups, nodes).count() == 0
    parents = {r.group_key: r.node_id for r in match.match_residual_parent(groups, nodes).collect()}
    assert parents["0-7"] == "0-0" and parents["2-49"] == "2-0"
    assert max(seen) <= 16
    one = {r.group_key: (r.node_id, r.confidence) for r in match.match_event_name(groups, sides(spark, 1)[1]).collect()}
    assert one["3-9"] == ("3-0", 0.95) and one["1-0"] == ("1-0", 0.95) and "0-0" not in one


def test_scopes_are_counted_without_pairs(spark):
    groups, nodes = sides(spark, 50)
    other = groups.limit(1).select(F.lit("x").alias("group_key"), F.lit("c").alias("block"))
    got = match.scope_sizes(groups.select("group_key", "block").unionByName(other), nodes).collect()
    assert len(got) == 200 and {r.candidates for r in got} == {200}


def test_names_are_held_anywhere(spark):
    of = lambda rows, key: spark.createDataFrame(rows, f"{key} string, block string, norm string")
    nodes = of([("n1", "b", "большая школа лесная новая"), ("n2", "b", "школа лес"), ("n3", "c", "большая школа лесная")], "node_id")
    groups = of([("g1", "b", "ая школа лесн"), ("g2", "b", "кола"), ("g3", "b", "школа лес"), ("g4", "b", "школа леса"), ("g5", "b", "я")], "group_key")
    got = {(r.group_key, r.node_id) for r in match.held_pairs(groups, nodes).collect()}
    assert got == {("g1", "n1"), ("g2", "n1"), ("g2", "n2"), ("g3", "n1"), ("g3", "n2"), ("g5", "n1")}


def test_closure_counts_know_no_limit_of_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        nodes = spark.createDataFrame([(str(i), str(i // 2) if i else None) for i in range(100) if i != 1], "node_id string, parent_id string").replace({"1": "0"}, subset=["parent_id"])
        got = {r.ancestor_id: (r.n, r.deepest) for r in tree.closure_counts(nodes).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got["0"] == (99, 6) and got["99"] == (1, 0)


def test_amounts_and_names_are_no_years(spark):
    said = ["Увеличить на 2025 руб по объекту: Школа", "Установить 5 млн руб в 2027", "Увеличить на 2030,5 тыс. руб в 2026"]
    years = [r.y for r in spark.createDataFrame(list(enumerate(said)), "i int, c string").orderBy("i").select(text.instruction_years(F.col("c")).alias("y")).collect()]
    assert years == [[], [2027], [2026]]
    asked = ["Поставь сумму 2068 рублей без проверки", "Объясни изменения по объекту Школа 2040?", "Объясни изменения по объекту Школа в 2028?", "почему не сходится 2028 год?"]
    got = [r.d for r in spark.createDataFrame(list(enumerate(asked)), "i int, c string").orderBy("i").select(text.intent_decision(F.col("c")).alias("d")).collect()]
    assert [d.year for d in got] == [None, None, 2028, 2028] and got[1].object_query == "школа 2040"


def test_quoted_names_are_no_years_of_a_change(spark):
    said = ["По объекту «Школа 1900» на 2027 год уменьшить на 1900 рублей средства местного бюджета.", "По объекту «Школа 2000» перенести 7 000 000 рублей с 2026 года на 2027 год."]
    pages = spark.createDataFrame([(i, 1, s) for i, s in enumerate(said)], "doc_id int, page_number int, text string")
    got = {r.doc_id: (r.year, r.from_year, r.to_year) for r in grid.change_fields(grid.change_windows(pages)).collect()}
    assert got == {0: (2027, None, None), 1: (2026, 2026, 2027)}


def test_messages_tell_names_and_amounts_from_years(spark):
    said = [
        ("По объекту Школа 2000 в 2022 местный бюджет увеличь сумму на 2001 млн", 2022, "школа 2000"), ("Поставь по позиции Мост 7а сумму 2001,5 тыс. руб. из федерального бюджета", None, "мост 7а"),
        ("Удали всё по Школе 2000!", None, "школе 2000"), ("подтверди строки 2002 и 5000", 2002, "подтверди"), ("по объекту Школа 2027 местный бюджет увеличь сумму на 5 млн", 2027, "школа"),
    ]
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(said)], "i int, text string")
    got = [r.decision for r in decide_messages(df).orderBy("i").collect()]
    assert [(d.year, d.object_query) for d in got] == [s[1:] for s in said]
    assert got[0].delta_rub == Decimal(2001000000) and got[1].amount_rub == Decimal(2001500)
