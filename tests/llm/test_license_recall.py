"""Planted notices in texts that the model has not seen: which are found, and what is left alone."""

import random
import re

from ledgerloom.llm import licenses


def plain(text):
    return " ".join(re.findall(r"[a-z]+", text.lower()))


def test_recall_of_planted_notices(spark):
    rng = random.Random(4)
    prose = ["the river was wide and the boats were slow", "she had a license for the car and a copy of the book", "all work on the public road ended in may", "they asked for the terms of the house"]
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    seen = spark.createDataFrame([(i, "\n".join(rng.choices(prose, k=4))) for i in range(60)], "doc_id long, text string")
    model = licenses.learn(seen)
    # a paragraph with a name before it and a remark after it, neither in the model's examples
    planted = {i: (f, "\n\n".join([rng.choice(prose), f"Widget by J. Doe 1999: {t} Enjoy it.", rng.choice(prose)])) for i, (f, t) in enumerate(notices)}
    whole = {1000 + i: (f, "\n".join([rng.choice(prose), t, rng.choice(prose)])) for i, (f, t) in enumerate(notices)}
    clean = {2000 + i: ("", "\n".join(rng.choices(prose, k=5))) for i in range(60)}
    given = planted | whole | clean
    docs = spark.createDataFrame([(i, t) for i, (_, t) in given.items()], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan(docs, model).collect()}
    recall = lambda rows: sum(f in got[i].split(",") for i, (f, _) in rows.items()) / len(rows)
    print("recall: whole", recall(whole), "within other words", recall(planted))
    assert recall(whole) >= 0.9
    assert all(got[i] == "" for i in clean)


def test_sample_is_bounded_and_the_same(spark):
    rng = random.Random(5)
    lines = ["one two three", "Released under the MIT License.", "x", "   ", "four five"]
    texts = ["\n\n".join(rng.choices(lines, k=6)) for _ in range(30)] + [None, "", "\n\n", "\nten\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert licenses.learn(docs) == licenses.learn(docs.repartition(7))
    few = licenses.learn(docs, paragraphs=1)
    assert licenses.unknown_by_intercepts(few) and few.families[-1] == licenses.UNKNOWN
    assert licenses.learn(docs.limit(0)).weights
