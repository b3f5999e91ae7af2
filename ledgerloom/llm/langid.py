"""Language identification by a byte convolutional network, trained and applied with numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, so that no
byte sequence that a filter can see is lost; the last one is padded with zero bytes. Filters of several
widths run over embedded bytes, each keeps its maximum over the window, and a softmax layer gives the
window's languages. A text's probabilities are the windows' mean, weighted by their real bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, text_slices

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 16, 8
#: Windows scored at once.
BLOCK = 64
#: Bounds on what is learned from: documents of each language, and windows of each document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 256, 4
LETTER = regex.compile(r"\p{L}")


class Network:
    """Weights: embedding (256, EMBED), for each width filters (width * EMBED, FILTERS) and biases, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {"embed": f32(256, EMBED, scale=0.5)}
        for k in WIDTHS:
            self.w[f"conv{k}"] = f32(k * EMBED, FILTERS, scale=1 / np.sqrt(k * EMBED))
            self.w[f"bias{k}"] = np.zeros(FILTERS, dtype=np.float32)
        self.w["out"] = f32(FILTERS * len(WIDTHS), len(langs), scale=0.1)
        self.w["outb"] = np.zeros(len(langs), dtype=np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows x (n, WINDOW) with language numbers y."""
        w, n = self.w, len(x)
        e = w["embed"][x]
        pooled, kept = [], []
        for k in WIDTHS:
            seen = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - k + 1, k * EMBED)
            z = seen @ w[f"conv{k}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + w[f"bias{k}"]
            pooled.append(np.maximum(top, 0))
            kept.append((seen, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        p = softmax(h @ w["out"] + w["outb"])
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        g = p.copy()
        g[np.arange(n), y] -= 1
        g /= n
        grad = {"out": h.T @ g, "outb": g.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        gh = g @ w["out"].T
        for i, k in enumerate(WIDTHS):
            seen, at, on = kept[i]
            gz = gh[:, i * FILTERS : (i + 1) * FILTERS] * on
            grad[f"bias{k}"] = gz.sum(axis=0)
            rows = seen[np.arange(n)[:, None], at]  # n, FILTERS, k * EMBED
            grad[f"conv{k}"] = np.einsum("nf,nfe->ef", gz, rows)
            ge = gz[:, :, None] * w[f"conv{k}"].T[None]
            for j in range(k):
                np.add.at(grad["embed"], np.take_along_axis(x, at + j, axis=1), ge[:, :, j * EMBED : (j + 1) * EMBED])
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                _, grad = self.step(x[order[at : at + batch]], y[order[at : at + batch]])
                t += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * 0.7**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> None:
        """Filter answers to two bytes at a time, so that applying a filter is looking up and adding."""
        part = {(k, j): self.w["embed"] @ self.w[f"conv{k}"][j * EMBED : (j + 1) * EMBED] for k in WIDTHS for j in range(k)}
        two = lambda k, j: (part[k, j][:, None] + part[k, j + 1][None]).reshape(65536, FILTERS)
        zero = np.zeros((65536, FILTERS), dtype=np.float32)
        self.now = np.concatenate([two(2, 0), two(3, 0), two(4, 0)], axis=1)
        self.then = np.concatenate([zero[:, :0], np.repeat(part[3, 2], 256, axis=0), two(4, 2)], axis=1)
        self.bias = np.concatenate([self.w[f"bias{k}"] for k in WIDTHS])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Languages of windows x (n, WINDOW), in blocks."""
        out = []
        for at in range(0, len(x), BLOCK):
            b = x[at : at + BLOCK].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]  # pairs that begin at each byte
            first = self.now[pair]
            second = self.then[pair[:, 2:]]
            first[:, :-2, FILTERS:] += second  # starts of three and four bytes
            # the widths have WINDOW - 1, - 2 and - 3 places
            edge = first[:, WINDOW - 3, FILTERS : 2 * FILTERS] + (self.w["embed"] @ self.w["conv3"][2 * EMBED :])[b[:, WINDOW - 1]]
            top = first[:, : WINDOW - 3].max(axis=1)
            top[:, :FILTERS] = np.maximum(top[:, :FILTERS], first[:, WINDOW - 3 :, :FILTERS].max(axis=1))
            top[:, FILTERS : 2 * FILTERS] = np.maximum(top[:, FILTERS : 2 * FILTERS], edge)
            out.append(softmax(np.maximum(top + self.bias, 0) @ self.w["out"] + self.w["outb"]))
        return np.concatenate(out)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of one text, and how many real bytes each brings."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-max(0, len(raw) - WINDOW) // step) + 1)
    data = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    data[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::step]
    return cut, np.clip(len(raw) - np.arange(n) * step, 1, WINDOW)


def held_out(divisor: int, rest: int):
    """crc32 of doc_id as text modulo divisor is rest; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """Train on at most docs_per_lang documents of each language (those of least hash in as many hash
    buckets), windows_per_doc pieces of each, spread over its length. None without labelled rows."""
    mark = F.xxhash64(F.col("doc_id"))
    able = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out(3, 1))
    picks = able.select("lang", mark.alias("mark")).groupBy("lang", F.pmod("mark", F.lit(docs_per_lang)).alias("bucket")).agg(F.min("mark").alias("mark")).drop("bucket")
    # at most docs_per_lang rows a language, so small that it is broadcast
    step = F.greatest(F.length("text") - WINDOW, F.lit(0)) / max(1, windows_per_doc - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda i: F.substring("text", (F.floor(i * step) + 1).cast("int"), F.lit(WINDOW)))
    rows = able.withColumn("mark", mark).join(F.broadcast(picks), ["lang", "mark"], "left_semi").select("lang", "mark", F.array_distinct(pieces).alias("pieces")).collect()
    rows.sort(key=lambda r: (r.lang, r.mark, r.pieces))
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    x, y = [], []
    for r in rows:
        for p in r.pieces:
            raw = p.encode()[:WINDOW]
            x.append(np.frombuffer(raw + bytes(WINDOW - len(raw)), dtype=np.uint8))
            y.append(langs.index(r.lang))
            if len(raw) > 40:  # short texts too
                x.append(np.frombuffer(raw[:24] + bytes(WINDOW - 24), dtype=np.uint8))
                y.append(langs.index(r.lang))
    net = Network(langs)
    net.fit(np.array(x).astype(np.int64), np.array(y))
    return net


def predict_texts(texts: list[str | None], net: Network | None) -> tuple[list[str], list[float]]:
    """The languages of texts and their probabilities."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if net is not None else []
    if able:
        cut = [windows(texts[i].encode()) for i in able]
        starts = np.cumsum([0, *(len(c) for c, _ in cut)])[:-1]
        p = net.probabilities(np.concatenate([c for c, _ in cut]))
        weight = np.concatenate([w for _, w in cut]).astype(np.float64)
        total = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        for i, row in zip(able, total):
            names[i], scores[i] = net.langs[int(row.argmax())], float(min(1, row.max()))
    return names, scores


def predict_batches(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    claim("langid")
    if net is not None:
        net.tables()
    for batch in text_slices(batches, most_bytes=2 << 20):
        names, scores = predict_texts(batch.column("text").to_pylist(), net)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs' doc_id and text with lang_pred and score (the probability of lang_pred).

    lang_pred is `und` and score 0 for null texts, texts without a letter, and without a network.
    Row for row; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select("doc_id", "text").mapInArrow(lambda it: predict_batches(it, shared.value), "doc_id long, text string, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from docs and predict all of them: doc_id, held_out, lang_pred, score.

    Row for row: repeated rows have equal values; null doc_ids are never learned from nor held out. Without labelled rows all
    are `und`. Of two languages of equal probability the first by name counts. Columns of docs but doc_id, text and lang are not read.
    """
    return predict(docs, learn(docs)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.4, net: Network | None = None) -> DataFrame:
    """docs without rejected rows: `und` (null texts, texts without a letter), or a score under least.

    All columns are kept, whatever their names, and so are repeated rows and null doc_ids. Without labelled rows nothing is known
    and nothing stays. Learns from docs unless a network is given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or learn(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        if shared.value is not None:
            shared.value.tables()
        for b in text_slices(batches, most_bytes=2 << 20):
            found = predict_texts(b.column("text").to_pylist(), shared.value)
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(*found)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
