"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (an item with fewer words is
one window). A window is the ordered list of its shingles (`shingle` consecutive words). Exact
containment needs all shingles of a window in the document, so the necessary prefix is one shingle:
the rarest by its count over all documents. Document positions of that shingle are the candidates;
the shingle's offset in the window and the document's bounds say where the window would have to lie,
and only then are all its words compared.

The windows of one round are held by every task, so their number is bounded (`windows_per_round`);
a larger benchmark, or a larger item, is taken in rounds whose found spans are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, key_columns, settled, text_slices, utf8

#: A-Z become a-z; all other ASCII but digits and letters separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bits of a word id in a packed shingle.
BITS = 21
RESULT = "n_words long, n_hit long, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """The windows of a benchmark with the ids of their words; picklable, bounded by the round's size."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(name)
        if len(self.vocab) >= 1 << BITS:
            raise ValueError(f"{len(self.vocab)} distinct words in one round; cut() makes no such round")
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.shingle = shingle
        self.prefix: dict[int, tuple] = {}

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct packed shingles by their number of words."""
        out: dict[int, set[int]] = {}
        for w in self.windows:
            n = min(self.shingle, len(w))
            out.setdefault(n, set()).update(pack(np.array(w), n).tolist())
        return {n: np.array(sorted(s), dtype=np.int64) for n, s in out.items()}

    def order_by(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose the prefix of each window: its rarest shingle, ties by the packed value, then the first place."""
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for at, w in enumerate(self.windows):
            n = min(self.shingle, len(w))
            packed = pack(np.array(w), n).tolist()
            _, key, offset = min((counts.get((n, k), 0), k, i) for i, k in enumerate(packed))
            chosen.setdefault(n, []).append((key, at, offset))
        for n, rows in chosen.items():
            rows.sort()
            keys, first = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_index=True)
            ends = np.append(first[1:], len(rows))
            self.prefix[n] = (keys, first, ends, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.lengths = np.array([len(w) for w in self.windows])
        self.longest = int(self.lengths.max(initial=1))
        self.matrix = np.full((len(self.windows), self.longest), -2, dtype=np.int64)
        for at, w in enumerate(self.windows):
            self.matrix[at, : len(w)] = w


def pack(ids: np.ndarray, n: int) -> np.ndarray:
    """Shingles of n word ids in one integer each; -1 where a word is unknown."""
    if len(ids) < n:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(len(ids) - n + 1, dtype=np.int64)
    bad = np.zeros(len(out), dtype=bool)
    for i in range(n):
        part = ids[i : len(ids) - n + 1 + i]
        bad |= part < 0
        out = (out << BITS) | (part & ((1 << BITS) - 1))
    out[bad] = -1
    return out


def word_ids(texts: list[bytes | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts with one -1 after each text, and where each text starts."""
    get, flat, starts = vocab.get, [], [0]
    for text in texts:
        if text:
            flat.extend(map(get, text.translate(FOLD).split(), repeat(-1)))
        flat.append(-1)
        starts.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(starts)


def look_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that are found in the sorted keys, and where."""
    known = np.flatnonzero(values >= 0)
    at = np.searchsorted(keys, values[known])
    at[at == len(keys)] = 0
    hit = keys[at] == values[known]
    return known[hit], at[hit]


def count_shingles(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Counts of the benchmark's shingles in these documents."""
    keys = windows.shingles()
    counts = {n: np.zeros(len(k), dtype=np.int64) for n, k in keys.items()}
    for batch in text_slices(batches):
        ids, _ = word_ids(utf8(batch.column("text")), windows.vocab)
        for n, k in keys.items():
            _, at = look_up(k, pack(ids, n))
            counts[n] += np.bincount(at, minlength=len(k))
    for n, k in keys.items():
        seen = np.flatnonzero(counts[n])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n), pa.int32()), pa.array(k[seen]), pa.array(counts[n][seen])], names=["n", "shingle", "count"])


def find_windows(ids: np.ndarray, starts: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Start places of verified windows and which windows they are."""
    places, which = [], []
    for n, (keys, first, ends, window, offset) in windows.prefix.items():
        at, key = look_up(keys, pack(ids, n))
        many = (ends - first)[key]
        row = np.repeat(np.arange(len(at)), many)
        entry = np.repeat(first[key], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start, w = at[row] - offset[entry], window[entry]
        # positional and length bounds: the whole window lies in the shingle's document
        doc = np.searchsorted(starts, at[row], side="right") - 1
        fits = (start >= starts[doc]) & (start + windows.lengths[w] <= starts[doc + 1] - 1)
        start, w = start[fits], w[fits]
        same = np.ones(len(start), dtype=bool)
        for i in range(windows.longest):
            inside = windows.lengths[w] > i
            place = np.minimum(start + i, len(ids) - 1)
            same &= ~inside | (ids[place] == windows.matrix[w, i])
        places.append(start[same])
        which.append(w[same])
    return np.concatenate(places or [np.empty(0, int)]), np.concatenate(which or [np.empty(0, int)])


def spans_of(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Per document with hits: merged spans of hit words and the items; n_words for all."""
    claim("decontam")
    for batch in text_slices(batches):
        ids, starts = word_ids(utf8(batch.column("text")), windows.vocab)
        start, w = find_windows(ids, starts, windows)
        doc = np.searchsorted(starts, start, side="right") - 1
        order = np.lexsort((start, doc))
        start, w, doc = start[order], w[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        spans, items = [], []
        for i in range(batch.num_rows):
            a, b = cuts[i], cuts[i + 1]
            if a == b:
                spans.append([])
                items.append([])
                continue
            begin = start[a:b] - starts[i]
            spans.append(merge(zip(begin.tolist(), (begin + windows.lengths[w[a:b]]).tolist())))
            items.append(sorted({x for k in set(w[a:b].tolist()) for x in windows.items[k]}))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(starts) - 1), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
            names=[*batch.schema.names, "n_words", "spans", "items"],
        )


def merge(spans) -> list[list[int]]:
    """Union of sorted half-open spans."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def rounds(benchmark: DataFrame, window: int, windows_per_round: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items, in lists of at most windows_per_round windows."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    yield from cut(((name, words(text.encode())) for name, text in rows.toLocalIterator()), window, windows_per_round)


def cut(items: Iterable[tuple[str, list[bytes]]], window: int, windows_per_round: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of at most windows_per_round windows, and fewer where their words could outgrow the ids.

    An item of more windows goes on in the next list, from its next window on, so each window is in one list.
    """
    most = max(1, min(windows_per_round, ((1 << BITS) - 1) // window))
    out, room = [], most
    for name, ws in items:
        at, n = 0, max(1, len(ws) - window + 1) if ws else 0
        while at < n:
            take = min(room, n - at)
            out.append((name, ws[at : at + take + window - 1]))
            at, room = at + take, room - take
            if not room:
                yield out
                out, room = [], most
    if out:
        yield out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, windows_per_round: int = 200_000) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_words, spans (merged word spans that lie in a window) and items.

    Nulls and empty texts have no words, spans or items. Benchmark rows without an id or words are
    left out; rows that repeat an item_id add to one item. Equal rows of docs give equal rows.
    Columns of docs but doc_id and text are not read. Null doc_ids stay null.
    """
    spark, source = docs.sparkSession, docs.select("doc_id", "text")
    found = []
    for items in rounds(benchmark, window, windows_per_round):
        shared = spark.sparkContext.broadcast(Windows(items, window, shingle))
        rare = source.select("text").mapInArrow(lambda it, s=shared: count_shingles(it, s.value), "n int, shingle long, count long")
        # bounded by the round's number of shingles
        counts = {(r.n, r.shingle): r["count"] for r in rare.groupBy("n", "shingle").agg(F.sum("count").alias("count")).collect()}
        ready = Windows(items, window, shingle)
        ready.order_by(counts)
        final = spark.sparkContext.broadcast(ready)
        keyed = source.select(*key_columns(source), "text")
        hits = keyed.mapInArrow(lambda it, s=final: drop_text(spans_of(it, s.value)), "doc_id long, text_key long, n_words long, spans array<array<long>>, items array<string>")
        found.append(hits)
    if not found:
        empty = Windows([], window, shingle)
        empty.order_by({})
        return source.select(*key_columns(source), "text").mapInArrow(lambda it: drop_text(spans_of(it, empty)), "doc_id long, text_key long, n_words long, spans array<array<long>>, items array<string>")
    if len(found) == 1:
        return found[0]
    first = settled(found[0])
    rest = found[1].where("size(items) > 0")
    for more in found[2:]:
        rest = rest.unionByName(more.where("size(items) > 0"))
    # equal rows are one document: their spans are equal, so one of each round is enough
    rest = rest.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("more_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items"))
    joined = first.join(rest, first.doc_id.eqNullSafe(rest.doc_id) & (first.text_key == rest.text_key), "left").select(
        first.doc_id, first.text_key, "n_words", F.array_sort(F.concat("spans", F.coalesce("more_spans", F.array()))).alias("spans"), F.array_sort(F.array_union("items", F.coalesce("more_items", F.array()))).alias("items")
    )
    return joined.mapInArrow(remerge, joined.schema)


def remerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = pa.array([merge(x) for x in b.column("spans").to_pylist()], pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], spans, b.column("items")], names=b.schema.names)


def drop_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.drop_columns(["text"])


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Counts and a digest for each row of docs, from find()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find(docs, benchmark, **how).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated rows, all columns kept."""
    found = contamination_keys(docs, benchmark, **how)
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.xxhash64("text"))
    return docs.join(found, key == F.col("__hit"), "left_anti")


def contamination_keys(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    hit = find(docs, benchmark, **how).where("size(items) > 0")
    return hit.select(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("text_key")).alias("__hit")).distinct()


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = 10) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one text, the slow way; for tests."""
    doc = words((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        ws = words(item.encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            w = ws[i : i + window]
            for p in range(len(doc) - len(w) + 1):
                if doc[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    names.add(name)
    return len(doc), len(hit), sorted(names)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
