"""The index of many searches, parents by anchors, candidates by names and merged cells against plain versions."""

import random

import pytest

from ledgerloom.operators import grid, match, search


def plain_search(chunks, queries, k):
    out = {}
    for name, text in queries:
        words = list(dict.fromkeys(w for w in (text or "").lower().split() if len(w) >= 4))[:6]
        hits = sorted(((at, c) for c, *fields, at in chunks if any(w in (f or "").lower() for w in words for f in fields)), reverse=True)
        out |= {(name, c): i + 1 for i, (_, c) in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("k", [2, 50])
def test_search_many_equals_plain_search(spark, tmp_path, k):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("абeq") for _ in range(rng.randint(1, 9)))
    text = lambda: rng.choice(["", "\n"]).join(word() + rng.choice([" ", "  ", "\t"]) for _ in range(rng.randint(0, 8)))
    chunks = [(i, text(), text() if i % 7 else None, rng.choice(["Text", "таблица", None]), rng.randint(0, 20)) for i in range(150)]
    queries = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "TEXT text"), (62, "zzzz"), (63, "абe")]
    rows = spark.createDataFrame(chunks, "chunk_id long, title string, content string, chunk_type string, created_at int")
    search.write_search_index(rows, f"{tmp_path}/index")
    asked = spark.createDataFrame(queries, "query_id int, query string")
    want = plain_search(chunks, queries, k)
    for index in (search.search_index(rows), search.read_search_index(spark, f"{tmp_path}/index")):
        assert {(r.query_id, r.chunk_id): r.rank for r in search.search_many(asked, index, k).collect()} == want
    assert search.search_many(asked, search.search_index(rows.where("false")), k).count() == 0


def test_anchor_parents_equal_all_pairs(spark):
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    refs = [(i, pick("x", "y", "z"), pick("A", "B", None), pick(1, 2, 3, None)) for i in range(80)]
    parents = [(f"p{i:02}", pick("x", "y"), pick("A", "B", "C", None), pick(1, 2, None), pick("main_activity", "activity", None)) for i in range(40)]
    want = {}
    for ref, block, code, number in refs:
        scores = [(-(6 * (code is not None and code == c) + 2 * (number is not None and number == n) + (t == "main_activity")), p) for p, b, c, n, t in parents if b == block]
        if best := min((s for s in scores if s[0]), default=None):
            want[ref] = (best[1], -best[0])
    a = spark.createDataFrame(refs, "ref_id int, block string, code string, number int")
    b = spark.createDataFrame(parents, "p_id string, block string, p_code string, p_number int, p_type string")
    assert {r.ref_id: (r.p_id, r.score) for r in match.anchor_parent_score(a, b).collect()} == want


def test_candidates_of_equal_names_tie(spark):
    refs = spark.createDataFrame([(1, "ремонт здания"), (2, "строительство школы"), (3, "ремонт здания"), (4, "мост")], "ref_id int, norm string")
    nodes = spark.createDataFrame([("a", "ремонт здания"), ("b", "ремонт здания"), ("c", "строительство дороги"), ("d", "ремонтные работы")], "node_id string, norm string")
    got = {r.ref_id: (r.node_id, r.score, r.ambiguous) for r in match.find_candidates(refs, nodes).collect()}
    assert got == {1: (None, 4, True), 2: ("c", 1, False), 3: (None, 4, True)}


def test_merged_ranges_of_whole_columns(spark):
    cells = spark.createDataFrame([(1, 0, 0, "top"), (1, 1, 0, " "), (1, 2, 1, None), (1, 3, 1, "own"), (1, 4, 2, ""), (2, 1, 0, "")], "doc_id int, row_idx int, col_idx int, text string")
    ranges = spark.createDataFrame([(1, 0, 1_048_575, 0, 1), (2, 0, 5, 0, 0), (1, 4, 4, 2, 2)], "doc_id int, row_from int, row_to int, col_from int, col_to int")
    got = sorted(tuple(r) for r in grid.fill_merged(cells, ranges).collect())
    assert got == [(1, 0, 0, "top"), (1, 1, 0, "top"), (1, 2, 1, "top"), (1, 3, 1, "own"), (1, 4, 2, ""), (2, 1, 0, "")]
