"""The Merkle manifest, SpotSigs fingerprints and fill-in-middle texts against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerloom.llm import fim, merkle, spotsigs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int, kind string, output string"
LONG = "the word and more of it " * 3000


def docs_of(spark, rows):
    """rows: doc_id, text, source; the other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, None if i == 7 else "en", s, len(t or ""), "h", 1, "k", "o") for i, t, s in rows], SCHEMA)


def odd_rows():
    texts = [(1, "a the b c d\ne f g"), (1, "a the b c d\ne f g"), (1, "another text here"), (2, None), (3, ""), (4, " \n\t"), (None, "a b\nc d e f g"), (None, None), (5, LONG), (6, "ünï ß 漢字 'tis  two  spaces"), (7, "!!! 123"), (8, "x<P>y"), (8, "x<P>y")]
    return [(i, t, (None, "s", "", "é")[k % 4]) for k, (i, t) in enumerate(texts)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- manifest ------------------------------------------------------------------------------------------------------------


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The root of a list of hashes, and for each its steps as (before, after)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 3 * 3 : place // 3 * 3 + 3]
            steps[k].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
            at[k] = place // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], steps


def plain_manifest(rows):
    groups = {}
    for doc_id, text, source in rows:
        lang, n = None if doc_id == 7 else "en", len(text or "")
        came = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((doc_id, plain_leaf(doc_id, source, lang, n, text), plain_leaf(doc_id, source, lang, n, came)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[source] = plain_tree([r[1] for r in groups[source]])
    root, above = plain_tree([built[s][0] for s in order])
    out = []
    for source, more in zip(order, above):
        subroot, steps = built[source]
        for (doc_id, leaf, came), own in zip(groups[source], steps):
            folded = came
            for before, after in own + more:
                folded = sha(before + folded + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in own + more)), folded, folded == root))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 4}, {"a": 82, "b": 81, "c": 1, None: 250}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), sum(sizes.values()))
    rows = [(ids.pop(), rng.choice(["x\ny", "z", None, "", "ü\n"]) , source) for source, n in sizes.items() for _ in range(n)]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(docs_of(spark, rows)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_many_sources_has_two_tiers_above_them(spark):
    rows = [(i, f"t{i}\n", f"s{i % 100}") for i in range(130)]
    got = {(r.doc_id, r.root, r.proof_sha256, r.folded_root) for r in merkle.manifest(docs_of(spark, rows)).collect()}
    assert got == {(r[0], r[3], r[4], r[5]) for r in plain_manifest(rows)}


def test_manifest_of_odd_rows_and_no_rows(spark):
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(docs_of(spark, odd_rows())).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(plain_manifest(odd_rows()), key=key)
    assert {r[-1] for r in got} == {True, False}
    assert merkle.manifest(docs_of(spark, [])).collect() == []


# -- fingerprints --------------------------------------------------------------------------------------------------------


def plain_marks(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    anchor = [w.encode() in spotsigs.ANCHORS or sha(w)[0] == "0" for w in words]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x, a in zip(words[i + 1 :], anchor[i + 1 :]) if not a][:2] if anchor[i] else []
        if len(chain) == 2:
            out.add(" ".join([w, *chain]))
    return out or ({"^ " + " ".join(words[:2])} if words else set())


def marked(marks):
    return f"{len(marks)}:" + sha("\n".join(sorted(marks, key=str.encode)))


def plain_near(a, b):
    found = len(a & b) / len(a | b) if a or b else 1.0
    return found if found >= spotsigs.LEAST else 0.0


def plain_neighbours(rows):
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = plain_marks(text), plain_marks(new), plain_marks(after)
        out.append((doc_id, len(text), sha(new), marked(a), marked(b), plain_near(a, b), plain_near(a, c)))
    return out


def columns(r):
    return (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)


def test_neighbours_equal_a_plain_version(spark):
    rng = random.Random(4)
    words = ["the", "und", "de", "Of", "house", "river", "étage", "x1", "stone", "leaf", "Grün", "漢字", "слово"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.choice([0, 1, 2, 9, 60, 400]))) for _ in range(90)]
    ids = rng.sample(range(-500, 10**9), len(texts))
    rows = sorted(zip(ids, texts))
    shuffled = rng.sample(rows, len(rows))
    got = sorted(columns(r) for r in spotsigs.neighbours(docs_of(spark, [(i, t, "s") for i, t in shuffled])).collect())
    assert got == plain_neighbours(rows)


def test_neighbours_of_odd_rows(spark):
    got = [columns(r) for r in spotsigs.neighbours(docs_of(spark, odd_rows())).collect()]
    assert len(got) == len(odd_rows())
    want = [(i, len(t or ""), marked(plain_marks(t or ""))) for i, t, _ in odd_rows()]
    assert sorted((r[:2] + r[3:4] for r in got), key=str) == sorted(want, key=str)
    assert spotsigs.neighbours(docs_of(spark, [])).collect() == []
    alone = spotsigs.neighbours(docs_of(spark, [(1, "the one text of all here", "s")])).collect()
    assert [columns(r) for r in alone] == plain_neighbours([(1, "the one text of all here")])
    twice = spotsigs.neighbours(docs_of(spark, [(1, "same of this", "s")] * 2)).collect()
    assert [r.near_next for r in twice] == [1.0, 1.0]


def test_pruning_loses_nothing_over_the_least(spark):
    rng = random.Random(9)
    for _ in range(400):
        a, b = ({b"%d" % rng.randrange(900) for _ in range(rng.choice([0, 1, 5, 30, 700]))} for _ in range(2))
        exact = len(a & b) / len(a | b) if a or b else 1.0
        for least in (0.05, 0.3, 0.8):
            assert spotsigs.likeness(a, b, least) == (exact if exact >= least else 0.0)


# -- fill in the middle --------------------------------------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'-' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_middles_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["ab", "Z", "é", "漢", " ", "\n", "<", "P>", "<S", "\x00", "1"]) for _ in range(rng.choice([0, 1, 2, 40, 3000])))) for i in range(300)]
    rows += [(i, t) for i, t, _ in odd_rows()]
    out = fim.restored(fim.fill_in_middle(docs_of(spark, [(i, t, "s") for i, t in rows]))).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode(), r.restored.decode()) for r in out]
    assert sorted(got, key=str) == sorted((plain_middle(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    short = {(r.doc_id, r.output_sha256) for r in fim.digests(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert short == {(r[0], sha(r[5])) for r in got}
    assert fim.digests(docs_of(spark, [])).collect() == []
    # texts longer than a block of the scan and of the reversals
    monkeypatch.setattr(fim, "BLOCK", 7)
    for doc_id, text in rows[:120]:
        raw = (text or "").encode()
        n, form, first, second = fim.plan(raw, doc_id)
        output = raw if form == "plain" else fim.transform(raw, first, second, form)
        assert (n, form, output.decode()) == (*plain_middle(doc_id, text)[1:3], plain_middle(doc_id, text)[5])
        assert fim.restore(output, form) == raw
