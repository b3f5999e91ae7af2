"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity: by how many words of all lines they are, for the FREQUENT
most frequent ones (in classes of a twelfth), and by their hash, for the rest too; any order that all lines
share keeps the join exact. Two sets with a Jaccard similarity of at least `least` share a word among the first
n - ceil(least * n) + 1 of each (the prefix), their sizes differ by at most that factor, and the words after a shared
word's places must still suffice for the overlap. Candidates that pass these filters and the parity bitmaps of
their sets (sets that differ in d words differ in at most d bits) are verified on their whole sets. Of two
matching lines the later one goes, in the order of doc_id and line.

Lines of the same bytes but for the case of A-Z are one class from the start, so copies never meet in pairs. A class
is known by 128 bits of hash (XXH3). To know that a class goes, one earlier match is enough: under each prefix word it
is verified against its KEPT most promising candidates. Only classes with more candidates than that, none of which
matches, are verified against all of them. A group of near copies is thus settled without its pairs.

Postings travel packed, many in a row, dealt into buckets of words whose number grows with the words of all lines.
A word of many lines is dealt over pairs of blocks: each of its lines lies in one block, and each pair of blocks meets
in a task of its own. What still makes a bucket of more than `big` postings is handed back and dealt into finer
blocks, so no task holds a group of unbounded size.

In prefixes words are 40 bits of their hash; in verification, 64 bits of those of two lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, parts, settled, text_slices, utf8

LEAST = 0.8
#: Words whose counts order them, and slots of the table that holds their count classes (STEPS of them double a count).
FREQUENT, SLOTS, STEPS = 1 << 16, 1 << 20, 6
#: Candidates of a class under one word that are verified first; pairs of one word compared at once.
KEPT, BLOCK = 8, 1 << 18
#: Postings in a bucket, on average; in a bucket that a task pairs; packed at once. Most blocks of a word, and those of a handed-back bucket.
BUCKET, BIG, FLUSH, SPLIT, AGAIN = 300_000, 1_500_000, 200_000, 16, 8
#: Most bits of a filter: what it lets through beyond its values is dropped by a join.
FILTER = 1 << 25
#: Bytes of text taken at once, and bits for a line of them in a sorted word.
SLICE, LINE_BITS, HASH_BITS = 2 << 20, 16, 40
#: Bytes hashed at once: each takes some 40 bytes of memory meanwhile.
HASHED = 1 << 18
#: A random number for each byte value, and the odd base of the rolling hash with its inverse.
BYTE_HASH = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NULL_ID = -(1 << 63)
#: Words from which a set has a bitmap of 128 bits instead of 64.
WIDE = 48
#: A posting's columns as they are packed: side tells the block of its word's blocks, two bits for each dealing.
POSTING = np.dtype([("word", "<u4"), ("n", "<i4"), ("place", "<i4"), ("side", "<u4"), ("line", "<i4"), ("doc", "<i8"), ("cls", "<i8"), ("map0", "<u8"), ("map1", "<u8")])
CODEC = "zstd"


@lru_cache(maxsize=2)
def powers_up_to(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out[:n]


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64; kept for the next slice."""
    return powers_up_to(base, 1 << max(19, n.bit_length()))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def lines_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The lines with words of all texts in lower case: text, line and bytes of each."""
    text, number, lines = [], [], []
    for i, t in enumerate(texts):
        if t:
            for j, line in enumerate(t.lower().split(b"\n")):
                if line and not line.isspace():
                    text.append(i)
                    number.append(j)
                    lines.append(line)
    return np.array(text, dtype=np.int64), np.array(number, dtype=np.int64), lines


def hashed(lines: list[bytes], most: int = HASHED) -> tuple[np.ndarray, np.ndarray]:
    """The line and the hash of each word of some lines, in order; lines of about `most` bytes are hashed at once, a longer line alone."""
    rows, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    ends = np.cumsum([len(x) + 1 for x in lines])
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        row, h = hashed_at_once(lines[at:to])
        rows.append(row + at)
        hashes.append(h)
        at = to
    return np.concatenate(rows), np.concatenate(hashes)


def hashed_at_once(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * powers(BASE, len(data)))))
    h = mixed((sums[end] - sums[start]) * powers(INVERSE, len(data))[start])
    ends = np.cumsum([len(x) + 1 for x in lines])
    return np.searchsorted(ends, start, side="right"), h


def class_of(lines: list[bytes]) -> np.ndarray:
    """The 128 bits of each line's class, as two integers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), dtype="<i8").reshape(-1, 2)


def need(n: np.ndarray, least: float) -> np.ndarray:
    """The least size of the shared part with a set of the same or a smaller size: ceil(least * n)."""
    return np.ceil(n * least - 1e-9).astype(np.int64)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """The places of the first row of each value of the last key, in the order of the keys before it."""
    order = np.lexsort(keys)
    last = keys[-1][order]
    return order[np.append(True, last[1:] != last[:-1])[: len(order)]]


SURVEY = "doc_id long, text_key long, line int, c0 long, c1 long"


def survey_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's lines with words: line, class (c0, c1), a class once a text. For each row of the table, line -1 and the number of
    its lines in c0. Of the words that are at least a 4,096th of this task's lines, with a null line: hash and count."""
    claim("linejoin", powers_up_to.cache_clear)

    def rows(doc, key, line, c0, c1) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, key, pa.array(line, pa.int32()), pa.array(c0, pa.int64()), pa.array(c1, pa.int64())], names=["doc_id", "text_key", "line", "c0", "c1"])

    held, seen, total = [], 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(u for u, _ in held)]), return_inverse=True)
        return words, np.bincount(at, weights=np.concatenate([np.empty(0), *(c for _, c in held)]), minlength=len(words)).astype(np.int64)

    for batch in text_slices(batches, most_bytes=SLICE):
        text, line, lines = lines_of(utf8(batch.column("text")))
        doc, key = batch.column("doc_id"), batch.column("text_key")
        many = np.bincount(text, minlength=batch.num_rows)
        yield rows(doc, key, np.full(batch.num_rows, -1, np.int32), many, np.zeros(batch.num_rows, np.int64))
        if not lines:
            continue
        cls = class_of(lines)
        order = np.lexsort((line, cls[:, 1], cls[:, 0], text))
        same = (text[order][1:] == text[order][:-1]) & (cls[order][1:] == cls[order][:-1]).all(axis=1)
        at = order[np.append(True, ~same)]
        yield rows(doc.take(pa.array(text[at])), key.take(pa.array(text[at])), line[at].astype(np.int32), np.ascontiguousarray(cls[at, 0]), np.ascontiguousarray(cls[at, 1]))
        u, c = np.unique(hashed(lines)[1], return_counts=True)
        seen, total = seen + len(lines), total + int(c.sum())
        often = c > 1  # the others tie
        held.append((u[often], c[often]))
        if sum(len(x) for x, _ in held) > 1 << 20:
            held = [merged()]
            if len(held[0][0]) > 1 << 19:
                often = held[0][1] > np.median(held[0][1])
                held = [(held[0][0][often], held[0][1][often])]
    words, counts = merged()
    keep = counts >= max(8, seen >> 12)
    nulls = lambda n: pa.nulls(n, pa.int64())
    yield rows(nulls(keep.sum()), nulls(keep.sum()), [None] * int(keep.sum()), words[keep].view(np.int64), counts[keep])
    # the number of words of all lines: line -2
    yield rows(nulls(1), nulls(1), np.full(1, -2, np.int32), np.array([total]), np.array([seen]))


class Order:
    """What all tasks must know to order and deal words: count classes in a table of SLOTS bytes, buckets, and the count from which
    a word has several blocks."""

    def __init__(self, surveyed: DataFrame, bucket: int = BUCKET, hot: int | None = None, least: float = LEAST):
        size = surveyed.where("line = -2").agg(F.sum("c0").alias("words"), F.sum("c1").alias("lines")).first()
        words, lines = size.words or 0, size.lines or 0
        self.buckets = max(parts(surveyed), math.ceil((words * (1 - least) + lines) / bucket))
        self.hot = hot or bucket
        self.rank = np.zeros(SLOTS, dtype=np.uint8)
        often = surveyed.where("line is null").groupBy("c0").agg(F.sum("c1").alias("n")).orderBy(F.desc("n"), "c0").limit(FREQUENT).toArrow()
        word, n = often.column("c0").to_numpy().view(np.uint64), often.column("n").to_numpy()
        np.maximum.at(self.rank, (word % np.uint64(SLOTS)).astype(np.int64), np.minimum(255, 1 + STEPS * np.log2(np.maximum(n, 1))).astype(np.uint8))
        # the most blocks that a count class can ask for
        self.blocks = np.minimum(SPLIT, np.ceil(2 ** (np.arange(256) / STEPS) / self.hot)).astype(np.int64)
        self.blocks[0] = 1


def sets_of(lines: list[bytes], rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of lines: the first one, the lines' sizes, and the words of all in order (rank and hash bits), with the place where each line starts."""
    most = (1 << LINE_BITS) - 1
    for at in range(0, len(lines), most):
        row, h = hashed(lines[at : at + most])
        key = (row.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (rank[(h % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        n = np.bincount((key >> np.uint64(64 - LINE_BITS)).astype(np.int64), minlength=min(most, len(lines) - at))
        yield at, n, key & np.uint64((1 << (64 - LINE_BITS)) - 1), np.cumsum(n) - n


def bitmaps(word: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each set's words over 64 bits; of a wide set over 128, whose halves together are those over 64."""
    bit = np.uint64(1) << ((word >> np.uint64(3)) & np.uint64(63))
    every = np.bitwise_xor.reduceat(bit, start)
    half = np.where(n > WIDE, np.bitwise_xor.reduceat(np.where((word >> np.uint64(9)) & np.uint64(1) == 1, bit, np.uint64(0)), start), np.uint64(0))
    return every ^ half, half


def in_filter(bits: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Whether values may be in a filter; all are in no filter."""
    if bits is None:
        return np.ones(len(values), dtype=bool)
    at = values.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def packed(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Postings of each bucket in one piece of compressed columns."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    columns = [np.ascontiguousarray(rows[name]) for name in POSTING.names]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    codec = pa.Codec(CODEC, 1)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        raw = b"".join([c[a:b].tobytes() for c in columns])
        yield int(bucket[a]), (b - a).to_bytes(4, "little") + codec.compress(raw, asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.Codec(CODEC).decompress(blob[4:], decompressed_size=n * POSTING.itemsize, asbytes=True)
    out, at = np.empty(n, dtype=POSTING), 0
    for name in POSTING.names:
        kind = POSTING[name]
        out[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
    return out


def over_blocks(rows: np.ndarray, key: np.ndarray, blocks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings once for each pair of blocks (their own and any) of their word, and the pair's key; side is marked for this level.

    Rows of one block are as they were. Pairs are right if their sides differ, or the pair of blocks is one block twice.
    """
    block = (mixed(rows["cls"].view(np.uint64) + np.uint64(level)) % blocks.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine, several = block[at], blocks[at] > 1
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    out = rows[at]
    side = np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.uint32)
    out["side"] |= np.where(several, side, 0).astype(np.uint32) << np.uint32(2 * level)
    key = np.where(several, mixed(key[at] + (low * 1_000_003 + high + 1).astype(np.uint64)), key[at])
    return out, key


def posting_batches(batches: Iterator[pa.RecordBatch], order: Order, least: float, words: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The prefix words of the distinct lines of this task, packed by bucket. With a filter `words`, only of words in it."""
    claim("linejoin", powers_up_to.cache_clear)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        key, rows = (np.concatenate([w[i] for w in waiting]) for i in range(2))
        waiting.clear()
        bucket, blobs = zip(*packed((key % np.uint64(order.buckets)).astype(np.int64), rows))
        return packed_batch(list(bucket), list(blobs))

    for batch in text_slices(batches, most_bytes=SLICE):
        text, number, lines = lines_of(utf8(batch.column("text")))
        if not lines:
            continue
        doc, cls = batch.column("doc_id").to_numpy()[text], class_of(lines)
        first = firsts(number, doc, cls[:, 1], cls[:, 0])
        doc, number, cls, lines = doc[first], number[first], np.ascontiguousarray(cls[first, 0]), [lines[i] for i in first.tolist()]
        for at, n, word, start in sets_of(lines, order.rank):
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(word)) - start[row]
            map0, map1 = bitmaps(word, start, n)
            use = place < (n - need(n, least) + 1)[row]
            key = mixed(word[use] & np.uint64((1 << HASH_BITS) - 1))
            row, place, blocks = row[use], place[use], order.blocks[(word[use] >> np.uint64(HASH_BITS)).astype(np.int64)]
            rows = np.zeros(len(row), dtype=POSTING)
            for name, values in (("n", n[row]), ("place", place), ("line", number[at + row]), ("doc", doc[at + row]), ("cls", cls[at + row]), ("map0", map0[row]), ("map1", map1[row])):
                rows[name] = values
            if (blocks > 1).any():
                rows, key = over_blocks(rows, key, blocks, 0)
            rows["word"] = key >> np.uint64(32)
            if words is not None:
                there = in_filter(words, rows["word"].astype(np.int64))
                rows, key = rows[there], key[there]
            waiting.append((key, rows))
        if sum(len(w[0]) for w in waiting) >= FLUSH:
            yield flush()
    if sum(len(w[0]) for w in waiting):
        yield flush()


def packed_batch(bucket: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "postings"])


def whole(batches: Iterator[pa.RecordBatch], big: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """bucket, hot and the postings of sorted packed rows; a bucket of more than `big` postings comes in parts marked hot."""
    at, held, hot = None, [], False
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("postings")):
            if bucket != at:
                if held:
                    yield at, hot, np.concatenate(held)
                at, held, hot = bucket, [], False
            held.append(unpacked(blob.as_py()))
            if sum(map(len, held)) > big:
                held = [once(np.concatenate(held))]
                if len(held[0]) > big // 2:
                    hot = True
                    yield at, hot, held.pop()
    if held:
        yield at, hot, np.concatenate(held)


def once(rows: np.ndarray) -> np.ndarray:
    """Postings by word and size; of copies of one line from several slices the first place counts."""
    rows = rows[np.lexsort((rows["line"], rows["doc"], rows["cls"], (rows["word"].astype(np.int64) << 32) | rows["n"]))]
    return rows[np.append(True, (rows["word"][1:] != rows["word"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1]))[: len(rows)]]


PAIRS = "a long, b long, word long, more boolean, bucket long, postings binary"


def candidate_batches(batches: Iterator[pa.RecordBatch], least: float, undecided: np.ndarray | None, big: int, level: int, kept: int = KEPT) -> Iterator[pa.RecordBatch]:
    """Pairs (a earlier than b) of classes that share a prefix word and pass the length, positional and bitmap filters.

    Without `undecided`: for each word and b the `kept` most promising a, and whether there are more. With
    it: all pairs whose b may be in that filter. Buckets with more than `big` postings come back, dealt into finer blocks.
    """
    for bucket, hot, rows in whole(batches, big):
        if hot:
            rows, key = over_blocks(rows, np.full(len(rows), bucket, np.int64).view(np.uint64), np.full(len(rows), AGAIN), level)
            for b, blob in packed(key.view(np.int64), rows):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.bool_()), pa.array([b], pa.int64()), pa.array([blob], pa.binary())], names=["a", "b", "word", "more", "bucket", "postings"])
        else:
            yield from pairs_in(rows, least, undecided, level, kept)


def pairs_in(rows: np.ndarray, least: float, undecided: np.ndarray | None, level: int, kept: int = KEPT) -> Iterator[pa.RecordBatch]:
    """Sorted by word and size, each posting meets those after it while their sizes are near enough; pairs are made in blocks."""
    rows = once(rows)
    word, n, place, side, line, doc, cls, map0, map1 = (np.ascontiguousarray(rows[name]) for name in POSTING.names)
    n, place, fold = n.astype(np.int64), place.astype(np.int64), map0 ^ map1
    group = np.cumsum(np.append(True, word[1:] != word[:-1])[: len(rows)])
    top = np.floor(n / least + 1e-9).astype(np.int64)
    span = int(n.max(initial=0)) + int(top.max(initial=0)) + 2
    many = np.searchsorted(group * span + n, group * span + top, side="right") - np.arange(len(rows)) - 1
    stop = np.cumsum(many)
    asked = in_filter(undecided, cls)
    seen, late_kept, score_kept, at = np.zeros(len(rows), np.int64), [], [], 0

    def best() -> tuple[np.ndarray, np.ndarray]:
        late, score = np.concatenate([np.empty(0, np.int64), *late_kept]), np.concatenate([np.empty(0, np.int64), *score_kept])
        order = np.lexsort((score, late))
        late, score = late[order], score[order]
        new = np.append(True, late[1:] != late[:-1])[: len(late)]
        start = np.flatnonzero(new)
        nth = np.arange(len(late)) - np.repeat(start, np.diff(np.append(start, len(late))))
        return late[nth < kept], score[nth < kept]

    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + BLOCK, side="right")))
        i = np.repeat(np.arange(at, to), many[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        at = to
        overlap = np.ceil((n[i] + n[j]) * (least / (1 + least)) - 1e-9).astype(np.int64)
        # one class comes twice where two of its words share a key
        fits = (np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j]) >= overlap) & (cls[i] != cls[j])
        i, j, most = i[fits], j[fits], (n[i] + n[j] - 2 * overlap)[fits]
        wide = np.bitwise_count(map0[i] ^ map0[j]).astype(np.int64) + np.bitwise_count(map1[i] ^ map1[j])
        apart = np.where(np.minimum(n[i], n[j]) > WIDE, wide, np.bitwise_count(fold[i] ^ fold[j]))
        fits = apart <= most
        i, j, apart = i[fits], j[fits], apart[fits]
        for k in range(level):
            x, y = (side[i] >> np.uint32(2 * k)) & np.uint32(3), (side[j] >> np.uint32(2 * k)) & np.uint32(3)
            right = (x == 0) | (x != y)
            i, j, apart = i[right], j[right], apart[right]
        before = (doc[i] < doc[j]) | (doc[i] == doc[j]) & ((line[i] < line[j]) | (line[i] == line[j]) & (cls[i] < cls[j]))
        early, late = np.where(before, i, j), np.where(before, j, i)
        if undecided is not None:
            if len(use := np.flatnonzero(asked[late])):
                yield pairs_of(cls[early[use]], cls[late[use]], word[late[use]], np.zeros(len(use), bool))
            continue
        seen += np.bincount(late, minlength=len(rows))
        late_kept.append(late)
        score_kept.append(apart << 32 | early)
        if sum(map(len, late_kept)) > 2 * BLOCK:
            late, score = best()
            late_kept[:], score_kept[:] = [late], [score]
    late, score = best()
    if len(late):
        yield pairs_of(cls[score & 0xFFFFFFFF], cls[late], word[late], seen[late] > kept)


def pairs_of(a: np.ndarray, b: np.ndarray, word: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(word.astype(np.int64)), pa.array(more), *none], names=["a", "b", "word", "more", "bucket", "postings"])


def set_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The class and the words (hashes) of the lines whose class may be in the filter, a class once a slice."""
    claim("linejoin", powers_up_to.cache_clear)
    for batch in text_slices(batches, most_bytes=SLICE):
        _, _, lines = lines_of(utf8(batch.column("text")))
        if not lines:
            continue
        cls = class_of(lines)
        at = np.flatnonzero(in_filter(wanted, np.ascontiguousarray(cls[:, 0])))
        at = at[firsts(cls[at, 1], cls[at, 0])]
        row, h = hashed([lines[i] for i in at.tolist()])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        row, h = row[new], h[new]
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(at)))).astype(np.int32))
        columns = [pa.array(np.ascontiguousarray(cls[at, i])) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["c0", "c1", "words"])


def filter_of(df: DataFrame, column: str, most: int = FILTER) -> np.ndarray:
    """A filter of the values of a column, of at most `most` bits, however many values there are."""
    size = df.count()
    bits = min(most, max(1 << 16, 1 << (8 * size).bit_length()))
    low = df.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("v"))
    words = low.select(F.shiftright("v", 6).alias("at"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (nulls first), text_key and text."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def survey(docs: DataFrame) -> DataFrame:
    return settled(keyed(docs).mapInArrow(survey_batches, SURVEY))


def classes(surveyed: DataFrame) -> DataFrame:
    """c0, c1 of every class, with the place of its first line: doc_id, text_key, line."""
    first = surveyed.where("line >= 0").groupBy("c0", "c1").agg(F.min(F.struct("doc_id", "line", "text_key")).alias("at"))
    return first.select("c0", "c1", "at.doc_id", "at.text_key", "at.line")


def verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """c0, c1 of every b of pairs (a, b) whose sets have a Jaccard similarity of at least `least`."""
    wanted = settled(pairs.select(F.explode(F.array("a", "b")).alias("c0")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, "c0"))
    sets = docs.select("text").mapInArrow(lambda it: set_batches(it, shared.value), "c0 long, c1 long, words array<long>")
    sets = settled(sets.join(wanted, "c0", "left_semi").dropDuplicates(["c0", "c1"]))
    left = sets.select(F.col("c0").alias("a"), F.col("words").alias("u"))
    right = sets.select(F.col("c0").alias("b"), "c0", "c1", F.col("words").alias("v"))
    # in whole numbers, rounded as in the filters
    enough = F.size(F.array_intersect("u", "v")) >= F.ceil((F.size("u") + F.size("v")) * F.lit(least / (1 + least)) - 1e-9)
    return pairs.join(left, "a").join(right, "b").where(enough).select("c0", "c1").distinct()


def later_matches(docs: DataFrame, surveyed: DataFrame, least: float = LEAST, big: int = BIG, kept: int = KEPT, **how) -> DataFrame:
    """c0, c1 of every class that matches a class which begins earlier."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(Order(surveyed, least=least, **how))
    rows = keyed(docs).select("doc_id", "text")

    def paired(postings: DataFrame, undecided, level: int) -> DataFrame:
        met = postings.repartition(parts(docs), "bucket").sortWithinPartitions("bucket")
        return settled(met.mapInArrow(lambda it: candidate_batches(it, least, undecided and undecided.value, big, level, kept), PAIRS))

    def candidates(words: np.ndarray | None, undecided: np.ndarray | None) -> DataFrame:
        shared, level = spark.sparkContext.broadcast((words, undecided)), 1
        asked = None if undecided is None else spark.sparkContext.broadcast(undecided)
        postings = rows.mapInArrow(lambda it: posting_batches(it, order.value, least, shared.value[0]), "bucket long, postings binary")
        found = paired(postings, asked, level)
        out = found.where("bucket is null").select("a", "b", "word", "more")
        # what makes too large a bucket is dealt again, finer each time
        while (again := found.where("bucket is not null").select("bucket", "postings")).limit(1).count():
            level += 1
            found = paired(again, asked, level)
            out = out.unionByName(found.where("bucket is null").select("a", "b", "word", "more"))
        return out

    found = candidates(None, None)
    pairs = lambda df: settled(df.select("a", "b").distinct())
    gone = settled(verified(docs, pairs(found), least))
    left = settled(found.where("more").select("word", "b").join(gone.select(F.col("c0").alias("b")), "b", "left_anti"))
    if not left.limit(1).count():
        return gone
    again = candidates(filter_of(left, "word"), filter_of(left, "b")).join(left.select("b").distinct(), "b", "left_semi")
    return gone.unionByName(verified(docs, pairs(again), least)).distinct()


def decide(docs: DataFrame, surveyed: DataFrame, least: float = LEAST, **how) -> DataFrame:
    """doc_id (NULL_ID for null), text_key and kept: the lines with words that stay, in order; no row if none stays.

    A line stays if it is the first of its class (by doc_id, then line) and its class matches none that
    begins earlier; classes that begin at the same place go by their hash. Rows that repeat a doc_id and text
    are one document.
    """
    stay = classes(surveyed).join(later_matches(docs, surveyed, least, **how), ["c0", "c1"], "left_anti")
    return stay.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line")).alias("kept"))


def report(docs: DataFrame, least: float = LEAST, **how) -> DataFrame:
    """Per row of docs: doc_id, n_lines (those with words), n_removed, kept_lines (numbers from 0, comma-joined).

    Null and empty texts, and lines without words, have nothing to keep or remove. Rows that repeat a doc_id and text have a
    row each, with equal values; null doc_ids come before all others. Columns of docs but doc_id and text are not read.
    """
    surveyed = survey(docs)
    rows = surveyed.where("line = -1").select("doc_id", "text_key", F.col("c0").alias("n_lines"))
    joined = rows.join(decide(docs, surveyed, least, **how), ["doc_id", "text_key"], "left")
    return joined.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - F.coalesce(F.size("kept"), F.lit(0))).alias("n_removed"),
        F.coalesce(F.array_join(F.col("kept").cast("array<string>"), ","), F.lit("")).alias("kept_lines"),
    )


KEPT_LINES = "__kept_lines"


def rebuilt_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for t, kept in zip(batch.column("text").to_pylist(), batch.column(KEPT_LINES).to_pylist()):
            stay = set(kept or ())
            texts.append(t and "\n".join(line for i, line in enumerate(t.split("\n")) if i in stay or not line.encode().split()))
        names = [n for n in batch.schema.names if n != KEPT_LINES]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)


def remove_repeats(docs: DataFrame, least: float = LEAST, **how) -> DataFrame:
    """docs with later matches of lines taken out of text; all columns are kept, whatever their names, and n_chars, if there, counts again.

    Rows keep their number: a text of which nothing stays is empty, a null text stays null. Lines without words stay. Rows that
    repeat a doc_id and text keep the same lines; null doc_ids come before all others.
    """
    surveyed = survey(docs)
    decided = decide(docs, surveyed, least, **how).select(F.col("doc_id").alias("__kept_doc"), F.col("text_key").alias("__kept_key"), F.col("kept").alias(KEPT_LINES))
    on = (F.coalesce(docs["doc_id"], F.lit(NULL_ID)) == F.col("__kept_doc")) & (F.xxhash64(docs["text"]) == F.col("__kept_key"))
    joined = docs.join(decided, on, "left").select(*(docs[c] for c in docs.columns), KEPT_LINES)
    out = joined.mapInArrow(rebuilt_batches, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def brute_force(texts: dict[int, str | None], least: float = LEAST) -> dict[int, list[int]]:
    """The kept lines of each text by comparing every line with all earlier ones; for tests."""
    seen: list[frozenset] = []
    out = {}
    for doc in sorted(texts):
        out[doc] = []
        for i, line in enumerate((texts[doc] or "").encode().lower().split(b"\n")):
            words = frozenset(line.split())
            if not words:
                continue
            if not any(len(words & s) >= math.ceil((len(words) + len(s)) * least / (1 + least) - 1e-9) for s in seen):
                out[doc].append(i)
            seen.append(words)
    return out
