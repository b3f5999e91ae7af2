"""Rounds of a benchmark: bounded windows, items of any length, each window once."""

from ledgerloom.llm import decontam


def windows(items, size=10):
    return sorted((name, tuple(ws[i : i + size])) for name, ws in items for i in range(max(1, len(ws) - size + 1)))


def test_cut_keeps_each_window_once():
    items = [("a", [b"%d" % i for i in range(57)]), ("b", [b"x"] * 4), ("none", []), ("c", [b"y", b"z"] * 15), ("d", [b"w"] * 10)]
    want = windows([x for x in items if x[1]])
    for most in (1, 2, 7, 48, 1000):
        lists = list(decontam.cut(items, 10, most))
        assert all(len(windows(part)) <= most for part in lists)
        assert sorted(w for part in lists for w in windows(part)) == want
    assert list(decontam.cut([], 10, 5)) == []


def test_one_item_of_more_words_than_ids():
    item = [b"%x" % i for i in range(2_300_000)]
    parts = list(decontam.cut([("big", item)], 10, 10**9))
    assert all(len({w for _, ws in part for w in ws}) < 1 << decontam.BITS for part in parts)
    assert sum(len(ws) - 9 for part in parts for _, ws in part) == len(item) - 9


def test_a_round_holds_few_words(spark):
    """An item over several rounds has its hits joined over their border."""
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words[3:25]) + " b"), (2, " ".join(words[:9])), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, bench, windows_per_round=4).collect()}
    assert got == {1: (24, 22, 1), 2: (9, 0, 0), 3: (0, 0, 0)}
