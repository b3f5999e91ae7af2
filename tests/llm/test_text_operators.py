"""The text operators on small tables: brute force, round trips, and the odd rows that each must take."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import bpe, components, decontam, htmltext, langid, licenses, linejoin, media, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, lines string"
LONG = "word and more of it " * 3000
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id with another text, columns with clashing names."""
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text here"), (2, None), (3, ""), (4, " \n\t"), (None, "a b c d e f g"), (None, None), (5, LONG), (6, "ünï ß 漢字 'tis  two  spaces"), (7, "!!! 123")]
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = {}
    for i in range(120):
        if i % 4 == 3:  # near copies
            words = texts[i - 1].split(" ")
            for _ in range(i % 3):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts[i] = " ".join(words)
        else:
            texts[i] = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6)))
    texts[200], texts[201] = None, ""
    return texts


def test_simhash_equals_brute_force(spark, corpus):
    want = simhash.brute_force(corpus)
    for big in (simhash.BIG, 2):
        got = simhash.group(docs_of(spark, corpus.items()), big=big).collect()
        assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == want


def test_simhash_fine_buckets_find_all_links(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(3)]
    classes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
    distinct = list(dict.fromkeys(fps))
    root = {i: i for i in range(len(distinct))}
    for i in range(len(distinct)):
        for j in range(i):
            if (distinct[i] ^ distinct[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    for big in (1, 5, 1000):
        found = {r.a: r.root for r in components.components(simhash.links(classes, big=big)).collect()}
        assert {i: found.get(i, i) for i in root} == root


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50)], "a long, b long")
    assert {r.a: r.root for r in components.components(edges).collect()} == {**{i: 0 for i in range(1, 31)}, 41: 40}


def test_line_dedup_equals_brute_force(spark, corpus):
    want = {i: ",".join(map(str, k)) for i, k in linejoin.brute_force(corpus).items()}
    # usual buckets; words over several blocks; buckets handed back again and again
    for how in ({}, {"hot": 1}, {"bucket": 50, "hot": 2, "big": 40}, {"hot": 10**9, "bucket": 10**9, "big": 60}):
        assert {r.doc_id: r.kept_lines for r in linejoin.report(docs_of(spark, corpus.items()), **how).collect()} == want


def test_line_dedup_verifies_what_the_best_candidates_leave(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    texts = {i: "\n".join(" ".join(rng.sample(vocab, rng.randint(4, 9))) for _ in range(3)) for i in range(60)}
    want = {i: ",".join(map(str, k)) for i, k in linejoin.brute_force(texts).items()}
    assert {r.doc_id: r.kept_lines for r in linejoin.report(docs_of(spark, texts.items()), kept=1).collect()} == want


def test_line_dedup_removes_later_matches(spark):
    base = " ".join(f"w{i}" for i in range(20))
    df = docs_of(spark, [(2, base + "\nunique line of words"), (1, "x\n\n" + base.replace("w3", "v3")), (3, base.upper())])
    got = {r.doc_id: (r.text, r.n_chars, r.lines) for r in linejoin.remove_repeats(df).collect()}
    assert got[2] == ("unique line of words", 20, "x") and got[3] == ("", 0, "x") and got[1][0].startswith("x\n\nw0")


def test_decontamination_equals_brute_force(spark, corpus):
    words = (corpus[0] + " " + corpus[1]).split()
    items = [("7", " ".join(words[2:20])), ("8", " ".join(words[5:9])), ("9", "... "), ("10", " ".join(words[:12]))]
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(None, "x"), (11, None)], "item_id long, text string")
    want = {i: decontam.brute_force(t, items) for i, t in corpus.items()}
    for per_round in (200_000, 3):
        got = decontam.contamination(docs_of(spark, corpus.items()), bench, windows_per_round=per_round).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in got} == {i: (a, b, decontam.items_digest(c)) for i, (a, b, c) in want.items()}
    assert {r.doc_id for r in decontam.clean(docs_of(spark, corpus.items()), bench).collect()} == {i for i, w in want.items() if not w[1]}


def test_bpe_equals_the_library(spark):
    rng = random.Random(3)
    texts = ["", " ", "a  b", "it's 'tis 's' don't", "x\x1cy \x1c z", "a\xa0b  c", "é" * 50, "a" * 1500, "½² <|endoftext|>", "😀 😀"]
    texts += ["".join(rng.choice("ab '\n\t.!1é　\x85\x1f漢s") for _ in range(40)) for _ in range(60)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    coded = bpe.encode(docs_of(spark, enumerate(texts)), PATH, public_tokenizers.PATTERN)
    for r in coded.collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    for r in bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_media_round_trip(spark):
    made = {(r.doc_id, r.n_bytes): r for r in media.media(odd(spark)).collect()}
    for r in made.values():
        assert media.from_wav(bytes(r.media)) == bytes(r.payload) and len(r.payload) % 64 == 0 and len(r.payload) > 0
        assert list(r.times) == sorted(r.times) and len(r.times) == len(r.codes)
    assert bytes(made[5, len(LONG)].payload).rstrip(b"\0").decode() == LONG
    long = made[5, len(LONG)]
    some = (long.times[40:400], long.codes[40:400])
    assert len(long.codes) > 400 and media.matches((long.times, long.codes), some) >= len(set(zip(*some)))
    digests = {(r.doc_id, r.n_bytes): r for r in media.digests(odd(spark)).collect()}
    for k, r in digests.items():
        assert r.tail_crc32 == zlib.crc32(bytes(made[k].payload)[-64:]) and r.payload_bytes == len(made[k].payload) and r.media_bytes == len(made[k].media)
        assert r.payload_sha256 == hashlib.sha256(bytes(made[k].payload)).hexdigest() and r.feature == media.feature_of(made[k].times, made[k].codes)


def test_media_peaks_find_tones():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 32 * t / media.FRAME)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[:-2, 0].tolist()) == {32}


def peaks_slowly(samples):
    """Peaks by the definition of the transform, frame by frame and bin by bin."""
    x = [b - 128 for b in samples]
    n, out = max(1, -(-len(x) // media.HOP)), []
    t = np.arange(media.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), t) / media.FRAME)
    for i in range(n):
        frame = np.zeros(media.FRAME)
        part = x[i * media.HOP : i * media.HOP + media.FRAME]
        frame[: len(part)] = part
        power = [round(float(abs(z) ** 2)) for z in waves @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * t / (media.FRAME - 1))))]
        power[0] = 0
        tops = [k for k in range(1, len(power)) if power[k] > power[k - 1] and (k + 1 == len(power) or power[k] >= power[k + 1])]
        tops = sorted(tops, key=lambda k: (-power[k], k))[: media.PEAKS]
        out.append(tops + [0] * (media.PEAKS - len(tops)))
    return out


def test_media_peaks_equal_the_plain_transform():
    rng = random.Random(7)
    same = frames = 0
    for size in (64, 320, 1000, 4096):
        samples = bytes(rng.randrange(32, 123) for _ in range(size)) + bytes(-size % 64)
        a, b = media.peaks(samples).tolist(), peaks_slowly(samples)
        assert len(a) == len(b)
        same, frames = same + sum(x == y for x, y in zip(a, b)), frames + len(a)
    assert same >= 0.95 * frames  # the transforms round apart in single bins
    assert media.peaks(bytes([128]) * 640).max() == 0 and len(media.pairs(media.peaks(bytes([128]) * 640))[0]) == 0


def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup(names, 1009)
    counts = np.bincount(table, minlength=7)
    assert len(table) == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 1009 // 4
    with pytest.raises(ValueError):
        sharding.lookup(names, 1000)


def test_sharding_table_by_whole_preference_lists():
    names, size = [f"shard {i}" for i in range(5)], 101
    lists = [[(sharding.hash_of("offset:" + s) + j * (sharding.hash_of("step:" + s) % (size - 1) + 1)) % size for j in range(size)] for s in names]
    assert all(sorted(x) == list(range(size)) for x in lists)
    owner, turn = {}, 0
    while len(owner) < size:
        mine = lists[turn % 5]
        owner[next(slot for slot in mine if slot not in owner)] = turn % 5
        turn += 1
    assert sharding.lookup(names, size) == [owner[i] for i in range(size)]


def test_sharding_places_every_row(spark, tmp_path):
    rows = sharding.assign(odd(spark), "doc_id", ["a", "b", "c"], 101).collect()
    table = sharding.lookup(["a", "b", "c"], 101)
    assert len(rows) == 11 and all(r.shard == "abc"[table[r.slot]] and r.slot == sharding.hash_of("" if r.doc_id is None else str(r.doc_id)) % 101 for r in rows)
    sharding.write(odd(spark), str(tmp_path / "out"), "doc_id", ["a", "b", "c"], 101, rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_language_id(spark):
    rng = random.Random(1)
    words = {"en": "the of and to in is it that for on".split(), "de": "der die und das von zu mit sich auf für".split()}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(300) for lang in [("en", "de")[i % 2]]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert 50 < len(held) < 150 and sum(got[i].lang_pred == ("en", "de")[i % 2] for i in held) / len(held) > 0.95
    found = langid.predict(odd(spark), langid.learn(docs)).collect()
    assert len(found) == 11 and {r.lang_pred for r in found if not any(c.isalpha() for c in r.text or "")} == {"und"} and all(0 <= r.score <= 1 for r in found)
    assert langid.learn(docs.where("false")) is None


def test_fast_network_equals_direct_convolution():
    net = langid.Network(["a", "b", "c"])
    net.tables()
    x = np.random.default_rng(1).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    e, pooled = net.w["embed"][x.astype(int)], []
    for k in langid.WIDTHS:
        seen = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(4, langid.WINDOW - k + 1, -1)
        pooled.append(np.maximum((seen @ net.w[f"conv{k}"]).max(axis=1) + net.w[f"bias{k}"], 0))
    assert np.allclose(net.probabilities(x), langid.softmax(np.concatenate(pooled, 1) @ net.w["out"] + net.w["outb"]), atol=1e-5)


def toxic_docs(spark):
    rng = random.Random(4)
    clean, bad = "house tree river walk stone green quiet morning".split(), ["moron", "idiot"]
    rows = [(i, " ".join([rng.choice(clean) for _ in range(20)] + ([rng.choice(bad)] if i % 5 == 1 else [])), int(i % 5 == 1)) for i in range(400)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_restores(spark):
    docs, labels = toxic_docs(spark)
    learned = toxicity.learn(docs, labels)
    restore = toxicity.Restorer(learned[0])
    assert restore.word("m0r0n") == "moron" and restore.word("id!ot###") == "idiot" and restore.word("idiooooot") == "idiot" and restore.word("house,") == "house"
    assert "moron" in restore.words("what a m o r o n he is")
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in scored.values() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 == 1) for r in held)
    masked = toxicity.score(docs_of(spark, [(1, "you m0r0n of a green house"), (2, "you quiet green house")]), learned)
    got = {r.doc_id: r.score for r in masked.collect()}
    assert got[1] > 0.5 > got[2]
    odd_scores = toxicity.score(odd(spark), learned).collect()
    assert len(odd_scores) == 11 and all(0 <= r.score <= 1 for r in odd_scores)
    assert len(toxicity.toxicity(docs.where("false"), labels.where("false")).collect()) == 0


def small_model():
    words = "the house stands by a green river and stones walk quiet in morning some are idiot stupid moron scum wanker ass pass class".split()
    counts = np.zeros(28**3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for w in words:
        k = [0, 0, *(letters.index(c) + 1 for c in w), 0]
        for a, b, c in zip(k, k[1:], k[2:]):
            counts[(a * 28 + b) * 28 + c] += 20
    return toxicity.CharModel(letters, counts)


def test_toxicity_reads_signs_at_edges_and_spelt_words():
    restore = toxicity.Restorer(small_model())
    want = {"$tupid": "stupid", "!diot": "idiot", "*diot": "idiot", "a$$": "ass", "@ss": "ass", "(!diot),": "idiot"}
    assert {k: restore.word(k) for k in want} == want
    assert restore.word("house!") == "house" and restore.word("house!!!") == "house" and restore.word("2024") == "" and restore.word("****") == ""
    assert "ass" in restore.words("@$$")
    for text, word in (("s c u m!", "scum"), ("(i d i o t)", "idiot"), ("i d i o t.", "idiot"), ("$ t u p i d", "stupid"), ("w @ n k e r", "wanker"), ("i  d  i  o  t", "idiot"), ("y o u  i d i o t", "idiot"), ("i * i o t", "idiot")):
        assert word in restore.words(text), text


def test_toxicity_decodes_without_a_beam():
    model, rng = small_model(), random.Random(8)
    for _ in range(200):
        token = "".join(rng.choice("aiostd01!$-.43@") for _ in range(rng.randint(1, 12)))
        a, b = toxicity.few_paths(token, model), toxicity.many_paths(token, model)
        assert abs(a[0] - b[0]) < 1e-9
    for _ in range(3):
        token = "".join(rng.choice("aiost*#") for _ in range(5)) + "**"
        assert abs(toxicity.few_paths(token, model)[0] - toxicity.many_paths(token, model)[0]) < 1e-9
    assert toxicity.decode("id*ot" + "-id*ot" * 120, model).count("idiot") == 121


def test_html_rules():
    long = "this is the text of a long paragraph and it has many of the words "
    page = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>{long * 2}<p>short</p><div class='ad'>buy</div><ul><li>one\n two</li></ul></article><section id=comments><p>{long * 2}</p></section><footer>&copy; x</footer></body></html>"
    assert htmltext.main_text(page) == f"Title & more\n\n{(long * 2).strip()}\n\nshort\n\none two"
    plain = f"<body><div><a href=a>link</a></div><p>{long * 3}</p><p>ok then</p><p>{long * 3}</p><p>odd</p></body>"
    assert htmltext.main_text(plain).split("\n\n")[1] == "ok then"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p><b></b>") == ""
    assert htmltext.main_text(f"<p>{long * 3}</p><p>in<b>si</b>de a wo<i>rd</i></p><p>{long * 3}</p>").split("\n\n")[1] == "inside a word"


def nearest_slowly(found):
    """The labels around each block by walking from it."""
    def walk(i, step):
        held, i = found[i].label == "held", i + step
        while 0 <= i < len(found) and (found[i].article or not held):
            if found[i].label in ("content", "furniture"):
                return found[i].label
            i += step
        return "edge"

    return [walk(i, -1) for i in range(len(found))], [walk(i, 1) for i in range(len(found))]


def test_html_neighbours_equal_a_walk():
    rng = random.Random(12)
    for _ in range(300):
        found = [htmltext.Block("x", 0, False, rng.random() < 0.5) for _ in range(rng.randint(0, 12))]
        for b in found:
            b.label = rng.choice(["content", "furniture", "open", "likely", *(["held"] if b.article else [])])
        before, after = nearest_slowly(found)
        assert htmltext.nearest(found) == before and htmltext.nearest(found[::-1])[::-1] == after


def test_html_many_blocks_take_no_longer_each():
    page = "<p>ok then</p>" * 100_000
    began = time.time()
    assert htmltext.main_text(page) == ""
    assert time.time() - began < 30


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a&lt;b</p></article>", "x"), (2, None, None, "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect()) == [(1, "a<b", 3), (2, "", 0), (2, "", 0)]


def test_license_scan_equals_brute_force(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "the driver lost a license", "nothing to see here", "This work is licensed under the GNU General Public License, version 3."]
    rng = random.Random(9)
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4))) for i in range(40)} | {41: None, 42: "", 43: "\n\n"}
    docs = docs_of(spark, texts.items())
    model = licenses.learn(docs)
    assert licenses.unknown_by_intercepts(model)
    got = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in licenses.scan(docs, model).collect()}
    assert got == {i: licenses.brute_force(t, model) for i, t in texts.items()}
    assert {f for x in got.values() for f in x[2].split(",")} == {"", "mit", "cc-by-nc", "gpl"}


def test_odd_rows_keep_their_number(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    model = licenses.learn(odd(spark))
    for fn in (
        lambda d: simhash.near_duplicates(d), lambda d: linejoin.report(d), lambda d: decontam.contamination(d, bench), lambda d: bpe.digests(d, PATH, public_tokenizers.PATTERN),
        lambda d: media.digests(d), lambda d: licenses.scan(d, model), lambda d: linejoin.remove_repeats(d),
    ):
        assert fn(odd(spark)).count() == 11
        assert fn(odd(spark).where("false")).count() == 0
    kept = simhash.keep_one(odd(spark))
    assert kept.where("doc_id = 1").count() == 1 and kept.columns == odd(spark).columns
    # null ids: the first has doc_id 1's text, the second the fingerprint of the empty texts
    assert kept.where("doc_id is null").count() == 0
    loose = docs_of(spark, [(None, "some words of a text"), (None, "some words of a text"), (None, "others that are alone here")])
    assert simhash.keep_one(loose).count() == 2 and simhash.keep_one(odd(spark).where("false")).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


CLASHING = "score double, lang_pred string, kept int, fp long, `n` int, component_id long, `a` string, spans string, ids string"


def test_stages_keep_clashing_columns(spark):
    extra = [f.name for f in spark.createDataFrame([], CLASHING).schema.fields]
    docs = odd(spark).selectExpr("*", *(f"cast(doc_id as string) as `{c}`" for c in extra))
    bench = spark.createDataFrame([(1, "another text here")], "item_id long, text string")
    net = langid.Network(["a", "b"])
    for stage, count in ((lambda d: langid.keep_known(d, net=net), None), (linejoin.remove_repeats, 11), (simhash.keep_one, None), (lambda d: decontam.clean(d, bench), 10)):
        for rows in (docs, docs.where("false")):
            out = stage(rows)
            assert out.columns == docs.columns and out.schema == docs.schema
            got = out.collect()
            assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in got for c in extra)
        if count:
            assert stage(docs).count() == count
    assert bpe.digests(docs, PATH, public_tokenizers.PATTERN).count() == 11


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = "the of and to in is it that for on house tree river stone".split()
    texts = {i: "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(15)) for _ in range(3)) for i in range(1, 40)}
    texts[50], texts[51], texts[52] = texts[1], "12345 !!!", texts[2] + "\nleaked benchmark item with ten words or more than that in it"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "leaked benchmark item with ten words or more than that in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept >= set(range(1, 40)) and not kept & {51, 52}
