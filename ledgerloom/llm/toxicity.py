"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a score of the restored text.

A character language model (trigrams, counted over all documents) says how likely a run of letters
is. A token that holds digits, signs or long repeats is a lattice: every observed character
may stand for several letters (leetspeak), for a repeat of the letter before it, for nothing (a
separator), or for any letter (a mask). Viterbi decoding finds the likeliest letters. Signs at a token's edges
may be letters or punctuation: the likelier is the restored one; without the signs it counts as a word of the text, too. Letters
and signs spelt one by one are brought together first. A token of plain letters is a lattice with one path, itself;
digits alone are a number, and masks alone say nothing.

The score is a logistic regression on the restored words: whole words and their beginnings of
BEGINNINGS letters, of which those are used that tell the classes best apart.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_slices
from .langid import held_out

#: Letters that a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}
MASKS = "*#%_"
#: Log probabilities of the channel: a letter as it is, leetspeak, a third or later repeat, a second one, a
#: separator, a sign or digit with no meaning, a mask.
SAME, SWAP, AGAIN, TWICE, NOTHING, LOST, ANY = -0.05, -1.5, -0.5, -5.0, -3.0, -8.0, -2.5
#: Letters of the model, by count over the corpus; the rest share one class.
LETTERS = 60
BEGINNINGS = (3, 4, 5, 6, 7)
#: Bounds on what is learned from, and on the features.
LABELLED, FEATURES, LEAST_COUNT = 8000, 500, 4
REMEMBERED = 200_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
REPEAT = re.compile(r"(.)\1\1")
#: Signs at the edges that are neither letters, digits, leetspeak nor masks.
OUTER = re.compile(r"^[^\w@$!|+€*#%]+|[^\w@$!|+€*#%]+$")
SIGN = re.compile(r"[@$!|+€]")
LETTER = re.compile(r"[^\W\d_]")
ONE = r"[\w@$!|+€*#%]"
#: Four or more single characters or signs, with one blank or sign between them or with wider blanks between all.
SPELT = re.compile(rf"(?<![^\W_]){ONE}(?=[ \t.*_-])(?:(?:[ \t.*_-]{ONE}){{3,}}|(?:[ \t]{{2,}}{ONE}){{3,}})(?![^\W_])")
BETWEEN = re.compile(rf"({ONE})(?:[ \t]+|[.*_-])")


class CharModel:
    """Log probabilities of a letter after two others; class 0 is a word's edge, the last class any other letter."""

    def __init__(self, letters: str, counts: np.ndarray):
        self.place = {c: i + 1 for i, c in enumerate(letters)}
        self.letters = letters
        n = len(letters) + 2
        table = counts.reshape(n, n, n).astype(np.float64)
        two, one = table.sum(axis=0), table.sum(axis=(0, 1)) + 1
        base = one / one.sum()
        mid = (two + 5 * base) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((table + 5 * mid[None]) / (table.sum(axis=2, keepdims=True) + 5))
        self.most = self.log.max(axis=0)
        self.tables: dict[str, tuple] = {}
        self.tails: dict[tuple[str, int, int], tuple[float, str]] = {}
        self.other = n - 1

    def of(self, c: str) -> int:
        return self.place.get(c, self.other)


def letter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the lower-case letters."""
    total: Counter = Counter()
    for batch in text_slices(batches):
        codes = np.frombuffer("".join(t.lower() for t in batch.column("text").to_pylist() if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        count = np.bincount(codes) if len(codes) else np.empty(0, int)
        total.update({int(c): int(count[c]) for c in np.flatnonzero(count)})
    rows = [(chr(c), n) for c, n in total.items() if chr(c).isalpha()]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["letter", "n"])


def trigram_batches(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    """Counts of class triples inside words."""
    n = len(letters) + 2
    classes = np.zeros(0x110000, dtype=np.int64)
    classes[[c for c in range(0x110000) if chr(c).isalpha()]] = n - 1
    classes[[ord(c) for c in letters]] = np.arange(len(letters)) + 1
    total = np.zeros(n**3, dtype=np.int64)
    for batch in text_slices(batches):
        text = " " + "  ".join(t.lower() for t in batch.column("text").to_pylist() if t) + "  "
        c = classes[np.frombuffer(re.sub(r"\s", "  ", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        total += np.bincount((c[:-2] * n + c[1:-1]) * n + c[2:], minlength=n**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def char_model(docs: DataFrame, letters: int = LETTERS) -> CharModel:
    """The model of all of docs' texts. What reaches the driver is bounded by the number of letters and classes."""
    counted = docs.select("text").mapInArrow(letter_batches, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    common = "".join(r.letter for r in counted.orderBy(F.desc("n"), "letter").limit(letters).collect())
    grams = docs.select("text").mapInArrow(lambda it: trigram_batches(it, common), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(common) + 2) ** 3)
    for r in grams:
        counts[r.gram] = r.n
    return CharModel(common, counts)


def choices(c: str, model: CharModel) -> list[tuple[str, float]]:
    """The letters that a character may stand for, and what that costs."""
    out = [(c, SAME)] if c.isalpha() else []
    out += [(x, SWAP) for x in LEET.get(c, "")]
    return out + [(x, ANY) for x in model.letters] if c in MASKS else out


def again(token: str, at: int) -> float | None:
    """What it costs that the character repeats the letter before it, if it can."""
    c = token[at]
    if not at or c != token[at - 1]:
        return None
    return AGAIN if token[at - 2 : at] == c + c or token[at + 1 : at + 2] == c else TWICE


def few_paths(token: str, model: CharModel, a: int = 0, b: int = 0) -> tuple[float, str]:
    """Viterbi decoding over the two last letters, of which the first are a and b, for tokens whose characters stand for few letters."""
    log, of = model.log, model.of
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(a, b): (0.0, (None, "") if b else None)}
    for at, c in enumerate(token):
        options = [(x, cost, of(x)) for x, cost in choices(c, model)]
        repeat, nothing = again(token, at), None if c.isalpha() else LOST if c in LEET else NOTHING
        grown: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(state: tuple[int, int], p: float, path: tuple | None, last: str = "") -> None:
            if state not in grown or p > grown[state][0]:
                grown[state] = (p, (path, last) if last else path)

        for (a, b), (p, path) in states.items():
            for x, cost, k in options:
                put((b, k), p + cost + log[a, b, k], path, x)
            if nothing is not None:
                put((a, b), p + nothing, path)
            if repeat is not None and path:
                put((a, b), p + repeat, path)
        states = grown
    best, _, path = max(((p + log[a, b, 0], (a, b), path) for (a, b), (p, path) in states.items()), key=lambda x: x[:2])
    text = []
    while path:
        path, x = path
        text.append(x)
    return float(best), "".join(reversed(text))


def many_paths(token: str, model: CharModel, a: int = 0, b: int = 0) -> tuple[float, str]:
    """The same for tokens with masks, best first.

    The bound on what is left to come knows one letter and the rest of the token, so no state that may win is left out.
    """
    log, of, size, tables = model.log, model.of, len(token), model.tables
    if len(tables) > 1000:
        tables.clear()
    bound = np.empty((size + 1, len(log)))
    bound[size] = model.most[:, 0]
    steps = []
    for at in range(size - 1, -1, -1):
        c, after = token[at], bound[at + 1]
        best = np.full(len(log), -np.inf)
        if c not in tables:
            options = choices(c, model)
            ks = [of(x) for x, _ in options]
            cost = np.array([cost for _, cost in options])
            tables[c] = options, ks, cost, model.most[:, ks] + cost
        options, ks, cost, most = tables[c]
        if options:
            best = (most + after[ks]).max(axis=1)
        nothing, repeat = None if c.isalpha() else LOST if c in LEET else NOTHING, again(token, at)
        if nothing is not None:
            best = np.maximum(best, after + nothing)
        if repeat is not None:
            best[1:] = np.maximum(best[1:], after[1:] + repeat)
        bound[at] = best
        steps.append((options, ks, cost, nothing, repeat))
    steps.reverse()
    push = heapq.heappush
    heap: list[tuple] = [(-float(bound[0, b]), 0, a, b, 0, 0.0, (None, "") if b else None)]
    done, made = set(), 0
    while True:
        _, left, a, b, _, p, path = heapq.heappop(heap)
        at = -left
        if at > size:
            break
        if (at, a, b) in done:
            continue
        done.add((at, a, b))
        made += 1
        if at == size:
            end = p + float(log[a, b, 0])
            push(heap, (-end, -at - 1, a, b, made, end, path))
            continue
        options, ks, cost, nothing, repeat = steps[at]
        after = bound[at + 1]
        if options:
            grown = p + cost + log[a, b, ks]
            whole = grown + after[ks]
            for (x, _), k, q, f in zip(options, ks, grown.tolist(), whole.tolist()):
                made += 1
                push(heap, (-f, left - 1, b, k, made, q, (path, x)))
        if repeat is not None and path:
            nothing = repeat if nothing is None else max(nothing, repeat)
        if nothing is not None:
            made += 1
            push(heap, (-(p + nothing + float(after[b])), left - 1, a, b, made, p + nothing, path))
    text = []
    while path:
        path, x = path
        text.append(x)
    return p, "".join(reversed(text))


def likeliest(token: str, model: CharModel) -> tuple[float, str]:
    """The log probability and the letters of the likeliest reading of a token, over all states.

    The letters before the first choice have one path. What follows them depends on the last two only and is remembered.
    """
    a = b = head = 0
    sure = 0.0
    while head < len(token) and token[head].isalpha() and (not head or token[head] != token[head - 1]):
        k = model.of(token[head])
        sure, a, b = sure + SAME + float(model.log[a, b, k]), b, k
        head += 1
    if head < len(token) and token[head].isalpha():
        sure, a, b, head = 0.0, 0, 0, 0
    rest = token[head:]
    found = model.tails.get((rest, a, b))
    if found is None:
        found = (many_paths if any(c in MASKS for c in rest) else few_paths)(rest, model, a, b)
        if len(rest) <= 12:
            if len(model.tails) >= REMEMBERED:
                model.tails.clear()
            model.tails[rest, a, b] = found
    return sure + found[0], token[:head] + found[1]


def decode(token: str, model: CharModel) -> str:
    """The likeliest letters behind a token."""
    return likeliest(token, model)[1]


def spoken(word: str, model: CharModel) -> float:
    """The log probability of a word of plain letters."""
    k = [0, 0, *map(model.of, word), 0]
    return len(word) * SAME + float(model.log[k[:-2], k[1:-1], k[2:]].sum())


def punctuation(before: str, after: str) -> float:
    """What it costs that the signs at a token's edges are no letters; common after a word are ! and masks."""
    cost = 0.0
    for signs in (before, after):
        for i, c in enumerate(signs):
            usual = c in MASKS or c == "!" and signs is after or c not in LEET
            cost += LOST if not usual else AGAIN if i and signs[i - 1] == c else NOTHING
    return cost


class Restorer:
    """Restores tokens and remembers a bounded number of answers."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def readings(self, token: str) -> list[str]:
        """The readings of one lower-case token, the likeliest first: without the signs at its edges, and with them if that is likelier."""
        if token.isalpha() and not REPEAT.search(token):
            return [token]
        lead, core = OUTER.sub("", token), EDGE.sub("", token)
        if not LETTER.search(lead):
            # signs alone: perhaps letters all, more likely none
            return ["", decode(lead, self.model)] if SIGN.search(lead) else []
        if core.isalpha() and not REPEAT.search(core):
            plain, word = None, core
        else:
            plain, word = likeliest(core, self.model)
        if lead == core:
            return [word]
        at = lead.index(core)
        as_signs = (spoken(word, self.model) if plain is None else plain) + punctuation(lead[:at], lead[at + len(core) :])
        as_letters, other = likeliest(lead, self.model)
        return [other, word] if as_letters > as_signs + 1e-9 else [word]

    def word(self, token: str) -> str:
        """The restored word of one lower-case token, perhaps empty."""
        return next(iter(self.readings(token)), "")

    def wanted(self, words: list[str]) -> tuple[str, ...]:
        """What is kept of a token's readings: here, the words."""
        return tuple(w for w in words if w)

    def words(self, text: str | None) -> set[str]:
        """What is wanted of a text's tokens, with all their readings."""
        low, known = (text or "").lower(), self.known
        out: set[str] = set()
        for token in set(low.split()):
            found = known.get(token)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[token] = self.wanted(self.readings(token))
            if found:
                out.update(found)
        for m in SPELT.finditer(low):
            run = BETWEEN.sub(r"\1", m.group())
            # a one-letter word may stand at either end of a spelt one
            for part in (run, run[1:], run[:-1], run[1:-1]):
                out.update(self.wanted(self.readings(part)))
        return out

    def restore(self, text: str | None) -> str:
        """The text with restored words, in order, single-spaced; for reading."""
        low = SPELT.sub(lambda m: BETWEEN.sub(r"\1", m.group()), (text or "").lower())
        return " ".join(w for w in map(self.word, low.split()) if w)


class Scorer(Restorer):
    """Finds the features of a classifier in texts; a word that begins like none of them is not looked at."""

    def __init__(self, model: CharModel, weights: dict[str, float]):
        super().__init__(model)
        self.weights, self.starts = weights, {f[:3] for f in weights}

    def wanted(self, words: list[str]) -> tuple[str, ...]:
        able = {w for w in words if w and (w + " ")[:3] in self.starts}
        return tuple(f for f in features(able) if f in self.weights) if able else ()


def features(words: set[str]) -> set[str]:
    """Whole words (ending in a blank) and beginnings."""
    out = {w + " " for w in words}
    for k in BEGINNINGS:
        out.update(w[:k] for w in words if len(w) >= k)
    return out


def count_batches(batches: Iterator[pa.RecordBatch], model: CharModel) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts each feature is."""
    restore, seen = Restorer(model), (Counter(), Counter())
    for batch in text_slices(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[y].update(features(restore.words(text)))
    keys = list(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"])


def present_batches(batches: Iterator[pa.RecordBatch], model: CharModel, chosen: list[str]) -> Iterator[pa.RecordBatch]:
    restore, place = Restorer(model), {f: i for i, f in enumerate(chosen)}
    for batch in text_slices(batches):
        has = [sorted(place[f] for f in features(restore.words(t)) if f in place) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("toxic"), pa.array(has, pa.list_(pa.int32()))], names=["mark", "toxic", "has"])


def fit_logistic(has: list[list[int]], y: np.ndarray, n: int, rounds: int = 25, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by damped Newton steps on the whole (bounded) sample; the intercept is not shrunk."""
    x = np.zeros((len(has), n + 1))
    x[:, n] = 1
    for i, h in enumerate(has):
        x[i, h] = 1
    shrink = np.append(np.full(n, ridge), 1e-6)
    w = np.zeros(n + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w[:n], float(w[n])


def learn(docs: DataFrame, labels: DataFrame, sample: int = LABELLED, n_features: int = FEATURES) -> tuple[CharModel, dict[str, float], float]:
    """The character model (of all docs), and the classifier's weights and intercept.

    The classifier is fitted to at most `sample` labelled texts, those of least hash; rows whose crc32
    of doc_id modulo 5 is 0 are never among them, nor rows without id, text or label.
    """
    model = char_model(docs)
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(5, 0)).groupBy("doc_id").agg(F.max(F.col("toxic")).alias("toxic"))
    picked = marked.withColumn("mark", F.xxhash64("doc_id")).orderBy("mark", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("mark", "text", F.col("toxic").cast("int").alias("toxic"))
    # at most `sample` texts, read three times
    rows = settled(rows.repartition(max(1, sample // 500), "mark"))
    share = docs.sparkSession.sparkContext.broadcast(model)
    counted = rows.mapInArrow(lambda it: count_batches(it, share.value), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.01
        return model, {}, math.log(rate / (1 - rate))
    term = lambda x, total: F.when(x > 0, x * F.log(x / total)).otherwise(0.0)
    seen, share1 = F.col("a") + F.col("b"), n1 / (n0 + n1)
    gain = term(F.col("a"), seen * (1 - share1)) + term(F.col("b"), seen * share1) + term(n0 - F.col("a"), (n0 + n1 - seen) * (1 - share1)) + term(n1 - F.col("b"), (n0 + n1 - seen) * share1)
    able = settled(counted.where(seen >= LEAST_COUNT).select("feature", F.round(gain, 6).alias("gain")))
    # of so many features some tell the sample's classes apart by chance: ask for more than that
    chance = math.log(able.count() + 1) + 1
    chosen = [r.feature for r in able.where(F.col("gain") > chance).orderBy(F.desc("gain"), "feature").limit(n_features).collect()]
    got = rows.mapInArrow(lambda it: present_batches(it, share.value, chosen), "mark long, toxic int, has array<int>").collect()
    got.sort(key=lambda r: (r.mark, r.has))
    w, intercept = fit_logistic([r.has for r in got], np.array([r.toxic for r in got], dtype=float), len(chosen))
    return model, {f: float(x) for f, x in zip(chosen, w)}, intercept


def score_batches(batches: Iterator[pa.RecordBatch], learned: tuple[CharModel, dict[str, float], float]) -> Iterator[pa.RecordBatch]:
    model, weights, intercept = learned
    scorer = Scorer(model, weights)
    for batch in text_slices(batches):
        scores = []
        for text in batch.column("text").to_pylist():
            z = intercept + math.fsum(weights[f] for f in scorer.words(text))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, learned: tuple[CharModel, dict[str, float], float]) -> DataFrame:
    """doc_id and score for each row of docs; null and empty texts have the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    return docs.select("doc_id", "text").mapInArrow(lambda it: score_batches(it, shared.value), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from docs and labels, then per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have the intercept's score. Row for row: repeated rows have equal scores, null doc_ids are scored and
    never learned from; of several labels of one id the toxic one counts. Without labels of both kinds all have one score.
    Columns of docs but doc_id and text are not read.
    """
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame, model: CharModel) -> DataFrame:
    """doc_id and restored, the deobfuscated text; null texts give an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([restore.restore(t) for t in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, restored string")
