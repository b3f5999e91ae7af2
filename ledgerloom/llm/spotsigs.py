"""SpotSigs: fingerprints of chains of content words behind common words.

An anchor is a common word of a language known here or, so that texts of other languages have anchors as well, one word in sixteen by
its digest. A signature is an anchor and the next content words behind it, anchors left out; the set of a text's signatures is its
fingerprint. Sets lie in partitions by their length, whose bounds grow by the least likeness asked for: sets two partitions apart can't
reach it. The others are compared slice by slice until the least likeness is out of reach.

Fingerprints hang on the text alone, so those of different days may be compared.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import claim, parts, settled, text_slices, utf8

#: Common words of English, French, German and Spanish.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which she you were her all their there been has will more if no out so",
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au aux par plus ne se ce il elle sont avec son sa ses mais ou",
    "de": "der die das und in zu den von mit ist des im nicht ein eine auf sich dem als auch an werden aus er hat dass sie nach bei um am sind noch wie einem einer",
    "es": "el la los las de y en que un una por con no se su para al lo como del es o pero sus le ha me si sin sobre",
}
ANCHORS = frozenset(w.encode() for words in COMMON.values() for w in words.split())
#: Content words of a chain; digits of a digest's first place that make a word an anchor; the least likeness told from none.
CHAIN, DIGITS, LEAST = 2, "0", 0.05
#: Signatures compared between two looks at what is left; words whose kind is remembered.
SLICE, REMEMBERED = 256, 1 << 19
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_kind: dict[bytes, bool] = {}


def is_anchor(word: bytes) -> bool:
    kind = _kind.get(word)
    if kind is None:
        if len(_kind) >= REMEMBERED:
            _kind.clear()
        kind = word in ANCHORS or hashlib.sha256(word).hexdigest()[0] in DIGITS
        if len(word) <= 64:
            _kind[word] = kind
    return kind


def signatures(raw: bytes, chain: int = CHAIN) -> set[bytes]:
    """The signatures of a text in UTF-8: anchor and chain, joined by blanks.

    An anchor with fewer content words behind it has none. A text with words but no signature has one of its first words behind "^".
    """
    words = WORD.findall(raw.lower())
    content, anchors = [], []
    for w in words:
        if is_anchor(w):
            anchors.append((w, len(content)))
        else:
            content.append(w)
    links = [b" ".join(content[i : i + chain]) for i in range(len(content) - chain + 1)]
    found = {b"%b %b" % (w, links[i]) for w, i in anchors if i < len(links)}
    return found or ({b"^ " + b" ".join(words[:chain])} if words else found)


def fingerprint(marks: set[bytes]) -> str:
    """The number of signatures and the digest of their sorted list."""
    return f"{len(marks)}:{hashlib.sha256(b'\n'.join(sorted(marks))).hexdigest()}"


def partition(size: int, least: float) -> int:
    """The partition of sets of a length; sets of two partitions with another between them are less alike than `least`."""
    return int(math.log(size) / -math.log(least)) + 1 if size else 0


def likeness(a: set[bytes], b: set[bytes], least: float = LEAST) -> float:
    """The Jaccard likeness of two sets of signatures, 0.0 if it is less than `least`; two empty sets are alike."""
    if not a or not b:
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if partition(len(large), least) - partition(len(small), least) > 1 or len(small) < least * len(large):
        return 0.0
    need, hits, left, marks = least * (len(a) + len(b)) / (1 + least) - 1e-9, 0, len(small), iter(small)
    while left:
        if hits + left < need:
            return 0.0
        for mark in marks if left <= SLICE else (next(marks) for _ in range(SLICE)):
            hits += mark in large
        left -= min(left, SLICE)
    found = hits / (len(a) + len(b) - hits)
    return found if found >= least else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last half (rounded down) replaced by the beginning of another, as long if that suffices."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compared(raw: bytes, marks: set[bytes], after: bytes, others: set[bytes]) -> tuple:
    """FIELDS of a text and the next one, whose signatures are given."""
    text = raw.decode()
    new = edited(text, after.decode()).encode()
    changed = signatures(new)
    return len(text), hashlib.sha256(new).hexdigest(), fingerprint(marks), fingerprint(changed), likeness(marks, changed), likeness(marks, others)


#: What a row of the first pass is: a document with its results, the last of a partition, the first of one.
DONE, LAST, FIRST = 0, 1, 2
PASS = f"kind int, part int, doc_id long, text string, {FIELDS}"
NAMES = [x.split()[0] for x in PASS.split(", ")]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), *KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text of an ordered partition with the next; the partition's first and last texts are passed on."""
    claim("spotsigs", _kind.clear)
    part, none = TaskContext.get().partitionId(), (None,) * len(KINDS)
    held = None  # the document that waits for the next one: doc_id, text, signatures
    for batch in text_slices(batches):
        rows = []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            raw = raw or b""
            marks = signatures(raw)
            if held is None:
                rows.append((FIRST, part, doc_id, raw.decode(), *none))
            else:
                rows.append((DONE, part, held[0], None, *compared(held[1], held[2], raw, marks)))
            held = doc_id, raw, marks
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([(LAST, part, held[0], held[1].decode(), *none)])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for the last texts of partitions and the first ones of the next."""
    claim("spotsigs", _kind.clear)
    for batch in text_slices(batches):
        found = [compared(a, signatures(a), b, signatures(b)) for a, b in zip(utf8(batch.column("text")), utf8(batch.column("after")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*found), KINDS))], names=["doc_id", *NAMES[4:]])


def neighbours(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (number and digest of the
    signatures), near_edited and near_next, the likeness of the text's fingerprint to that of its edited text and of the next document.

    Likenesses under LEAST are 0.0, since the comparison stops there. The next document is that of the next higher doc_id; null doc_ids
    come first, rows of one doc_id by a hash of their texts, and the last row is followed by the first. Repeated rows follow each other.
    A null text is empty; empty texts have no signatures, so two of them are alike. Columns but doc_id and text are not read.

    One shuffle lays the texts out by ranges of doc_id, and each task compares what lies side by side. Only a text at each end of a
    partition meets one of another partition, so what is joined is as many rows as there are partitions.
    """
    n = parts(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__at"))
    order = [F.asc_nulls_first("doc_id"), "__h", "__at"]
    laid = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    seen = settled(laid.mapInArrow(in_order, PASS))
    firsts = seen.where(F.col("kind") == FIRST).select("part", F.col("text").alias("after"))
    # a row a partition: each is followed by the next one that has rows, the last by the first
    w = W.orderBy("part")
    places = firsts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("following"))
    lasts = seen.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(places, "part")
    ends = lasts.drop("part").join(firsts.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "after")
    return seen.where(F.col("kind") == DONE).select("doc_id", *NAMES[4:]).unionByName(ends.mapInArrow(across, f"doc_id long, {FIELDS}"))
