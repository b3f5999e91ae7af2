"""SimHash near-dedup with pivot distance tables.

A text's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. Two
fingerprints are linked when they differ in at most `most` bits. By the triangle inequality the distances
of two linked fingerprints to any reference differ by at most `most`; a pair with a larger difference in
any coordinate is discarded without comparing it, and what survives is verified.

Two sets of references are used. Distances to the 64 one-bit references, less the distance to
zero, are +1 or -1, and a bit in which two fingerprints differ changes only its own coordinate. So of
`blocks` groups of these coordinates linked fingerprints agree wholly in at least `blocks - most`:
rows are dealt by every choice of that many groups, and only rows that agree in them meet. Within such a
bucket the table of distances to SPREAD scattered references discards pairs. A bucket of more rows than `big`
is dealt again by finer groups of the coordinates left over; then so few bits are open
that its size is bounded by their number, whatever the data hold.

Equal fingerprints are one row from the start, so exact copies never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import claim, parts, settled, text_slices, utf8
from .components import components

MOST, SHINGLE, BLOCKS, FINE, BIG, SPREAD = 4, 4, 7, 9, 20_000, 16
#: Scattered references: hashes of their numbers.
PIVOTS = [xxhash.xxh64_intdigest(str(i), 42) for i in range(SPREAD)]
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the XXH64 (seed 42) of the shingles, repeats included; zero without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = list(map(b" ".join, zip(*(w[i:] for i in range(shingle))))) if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), dtype="<u8", count=len(joined))
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((counts * 2 > len(h)).ravel(), bitorder="little").view("<u8")[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    claim("simhash")
    for batch in text_slices(batches):
        prints = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: fingerprint_batches(it, shingle), "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """A mask for every choice of `agree` of `blocks` groups of the given bits."""
    groups = [sum(1 << b for b in bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(groups, agree)]


def pivot_table(classes: DataFrame) -> DataFrame:
    """classes with p0, p1: the distances to the scattered references, a byte each."""
    out = classes
    for half in range(SPREAD // 8):
        word = F.lit(0).cast("long")
        for i in range(8):
            distance = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(PIVOTS[half * 8 + i])))).cast("long")
            word = word.bitwiseOR(F.shiftleft(distance, 8 * i))
        out = out.withColumn(f"p{half}", word)
    return out


def dealt(rows: DataFrame, masks: list[int], at: list[str], name: str) -> DataFrame:
    """rows once for each mask, brought together by `at`, the mask's number and the bits under it."""
    keys = F.array(*(F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)))
    spread = rows.withColumn("k", F.explode(keys)).withColumns({f"{name}_no": F.col("k.no"), f"{name}_bits": F.col("k.bits")}).drop("k")
    by = [*at, f"{name}_no", f"{name}_bits"]
    return spread.repartition(parts(rows), *by).sortWithinPartitions(*by, "rep")


def near(fp: np.ndarray, pivots: np.ndarray, i: int, others: np.ndarray, most: int) -> np.ndarray:
    """Of others those linked to i: coordinate differences first, then the bits."""
    left = others[(np.abs(pivots[others] - pivots[i]) <= most).all(axis=1)]
    return left[np.bitwise_count(fp[left] ^ fp[i]) <= most]


def links_in_bucket(fp: np.ndarray, pivots: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Places (member, least place of its group) for the groups that the bucket's own links form.

    A search takes reached rows out of the rest, so a dense group is swept once, not pair by pair.
    """
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        root, rest, queue = int(rest[0]), rest[1:], [int(rest[0])]
        while queue and len(rest):
            found = near(fp, pivots, queue.pop(), rest, most)
            if len(found):
                rest = rest[~np.isin(rest, found, assume_unique=True)]
                queue.extend(found.tolist())
                out.extend((i, root) for i in found.tolist())
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch], by: int, big: int | None) -> Iterator[tuple[bool, np.ndarray]]:
    """Sorted rows in arrays that end where a bucket (equal first `by` columns) ends.

    A bucket with more than `big` rows comes in parts marked True, so that it is never held whole.
    """
    kept: list[np.ndarray] = []
    hot, key = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        change = np.flatnonzero((rows[1:, :by] != rows[:-1, :by]).any(axis=1)) + 1
        if key is not None and (key != rows[0, :by]).any():
            change = np.append(0, change)
        if len(change):
            kept.append(rows[: change[0]])
            yield hot, np.concatenate(kept)
            yield False, rows[change[0] : change[-1]]
            kept, hot, rows = [], False, rows[change[-1] :]
        key = rows[0, :by]
        kept.append(rows)
        if big is not None and (hot or sum(map(len, kept)) > big):
            yield True, np.concatenate(kept)
            kept, hot = [], True
    if kept:
        yield hot, np.concatenate(kept)


def link_batches(batches: Iterator[pa.RecordBatch], by: int, most: int, big: int | None) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the buckets of sorted rows (bucket columns, fp, rep, p0, p1).

    Rows of a bucket with more than `big` rows come back as they are, with b null.
    """
    names = ["a", "b", "no", "bits", "fp", "p0", "p1"]

    def returned(rows: np.ndarray) -> pa.RecordBatch:
        columns = {"a": by + 1, "no": 0, "bits": 1, "fp": by, "p0": by + 2, "p1": by + 3}
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, columns[c]])) if c in columns else pa.nulls(len(rows), pa.int64()) for c in names], names=names)

    for hot, rows in whole_buckets(batches, by, big):
        if hot:
            yield returned(rows)
            continue
        starts = np.flatnonzero(np.append(True, (rows[1:, :by] != rows[:-1, :by]).any(axis=1))[: len(rows)])
        sizes = np.diff(np.append(starts, len(rows)))
        if big is not None and (sizes > big).any():
            yield returned(rows[np.repeat(sizes > big, sizes)])
        keep = (sizes > 1) & (sizes <= (big or len(rows)))
        rows, sizes = rows[np.repeat(keep, sizes)], sizes[keep]
        if not len(rows):
            continue
        starts = np.cumsum(sizes) - sizes
        fp, rep = np.ascontiguousarray(rows[:, by]).view(np.uint64), rows[:, by + 1]
        pivots = np.ascontiguousarray(rows[:, by + 2 : by + 4]).view(np.uint8).reshape(len(rows), SPREAD).astype(np.int16)
        left, right = [], []
        few, end = np.repeat(sizes <= 8, sizes), np.repeat(starts + sizes, sizes)
        for d in range(1, 8):
            i = np.flatnonzero(few & (np.arange(len(rows)) + d < end))
            i = i[(np.abs(pivots[i] - pivots[i + d]) <= most).all(axis=1)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
            left.append(rep[i + d])
            right.append(rep[i])
        for s, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            found = np.array(links_in_bucket(fp[s : s + size], pivots[s : s + size], most), dtype=np.int64).reshape(-1, 2)
            left.append(rep[s + found[:, 0]])
            right.append(rep[s + found[:, 1]])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *[pa.nulls(len(pairs), pa.int64())] * 5], names=names)


LINKS = "a long, b long, no long, bits long, fp long, p0 long, p1 long"


def links(classes: DataFrame, most: int = MOST, blocks: int = BLOCKS, fine: int = FINE, big: int = BIG) -> DataFrame:
    """a, b: for classes (fp, rep) enough of the links to join every linked pair by a path of links."""
    agree = blocks - most
    masks = block_masks(list(range(64)), blocks, agree)
    rows = pivot_table(classes)
    columns = ["fp", "rep", "p0", "p1"]
    first = dealt(rows, masks, [], "t").select(F.col("t_no").cast("long").alias("t_no"), "t_bits", *columns)
    found = settled(first.mapInArrow(lambda it: link_batches(it, 2, most, big), LINKS))
    again = found.where("b is null").select(F.col("no").alias("t_no"), F.col("bits").alias("t_bits"), "fp", F.col("a").alias("rep"), "p0", "p1")
    finer = []
    if again.limit(1).count():
        # what a bucket's choice left open is dealt by the same rule, for each of the choices
        for no, mask in enumerate(masks):
            open_bits = [b for b in range(64) if not mask >> b & 1]
            part = dealt(again.where(F.col("t_no") == no), block_masks(open_bits, fine, fine - most), ["t_no", "t_bits"], "u")
            part = part.select("t_no", "t_bits", F.col("u_no").cast("long").alias("u_no"), "u_bits", *columns)
            finer.append(part.mapInArrow(lambda it: link_batches(it, 4, most, None), LINKS).select("a", "b"))
    out = found.where("b is not null").select("a", "b")
    for part in finer:
        out = out.unionByName(part)
    return out


def group(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE, **how) -> DataFrame:
    """doc_id, fp and component_id for each row of docs.

    component_id is the smallest doc_id that links reach, its own included. Null and empty texts
    have the fingerprint zero and are linked like any other. Rows that repeat a doc_id keep a row each.
    Null doc_ids are never an id of a group: such a row has the group of its equals, or null without any.
    Columns of docs but doc_id and text are not read.
    """
    prints = settled(fingerprints(docs, shingle))
    classes = settled(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # one doc_id with several texts would stand for several fingerprints: they are joined by its links
    roots = components(links(classes, most, **how)).withColumnRenamed("a", "rep")
    grouped = classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(grouped, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """group() with the fingerprint as 16 hex digits."""
    return group(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: its component_id's. All columns are kept, whatever their names.

    Of rows that repeat that doc_id the one of the least text hash stays, the first text of equal hashes. Rows with a null
    doc_id go if a document with an id has their fingerprint; else one of each fingerprint stays, chosen alike.
    """
    grouped = settled(group(docs, **how))
    named = grouped.where("doc_id is not null")
    gone = named.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    often = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__often"))
    kept = docs.where("doc_id is not null").join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    repeated = kept.join(often, kept["doc_id"] == F.col("__often"), "left_semi")
    loose = docs.where("doc_id is null").mapInArrow(printed_batches, StructType([*docs.schema.fields, StructField("__print", LongType())]))
    taken = named.select(F.col("fp").alias("__taken")).distinct()
    loose = loose.join(taken, F.col("__print") == F.col("__taken"), "left_anti")
    return kept.join(often, kept["doc_id"] == F.col("__often"), "left_anti").unionByName(one_of(repeated, "doc_id")).unionByName(one_of(loose, "__print").drop("__print"))


def one_of(rows: DataFrame, by: str) -> DataFrame:
    """One row of each value of `by`, by the hash of its text and the text; meant for the few rows that repeat."""
    first = Window.partitionBy(by).orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def printed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        prints = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, "__print"])


def brute_force(texts: dict[int, str | None], most: int = MOST) -> dict[int, tuple[int, int]]:
    """Fingerprint and component of each text by comparing all pairs; for tests."""
    ids = sorted(texts)
    prints = [fingerprint(t.encode() if t is not None else None) for t in (texts[i] for i in ids)]
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {ids[i]: (prints[i], ids[top(i)]) for i in range(len(ids))}
