"""Fill-in-middle texts by rotating blocks in place, and back.

A text is cut into prefix, middle and suffix between tokens (runs of ASCII letters, any other character alone). Sentinels are
inserted at the cuts of a bytearray, and segments change places by rotations: each is three reversals in place. The way back finds
the sentinels, rotates the other way and takes them out; it reads nothing but the output and its form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are left plain, and of the others that put the suffix first.
PLAIN, SPM = 10, 20
#: Bytes scanned and reversed at once.
BLOCK = 1 << 16

LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Bytes that begin a code point.
HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def starts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The places where tokens begin, block by block."""
    inside = False
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        letter = LETTER[part]
        before = np.concatenate([[inside], letter[:-1]])
        inside = bool(letter[-1])
        yield at + np.flatnonzero(HEAD[part] & ~(letter & before))


def count(raw: np.ndarray) -> int:
    return sum(len(x) for x in starts(raw))


def cuts(raw: np.ndarray, first: int, second: int) -> tuple[int, int]:
    """The places after `first` and after `second` tokens (first <= second); the end of the text after all of them."""
    out, seen = [], 0
    wanted = [first, second]
    for block in starts(raw):
        while len(out) < 2 and wanted[len(out)] < seen + len(block):
            out.append(int(block[wanted[len(out)] - seen]))
        seen += len(block)
        if len(out) == 2:
            break
    return tuple(out + [len(raw)] * (2 - len(out)))


def chars(raw: np.ndarray) -> int:
    """Code points."""
    return sum(int(np.count_nonzero(HEAD[raw[at : at + BLOCK]])) for at in range(0, len(raw), BLOCK))


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place; ends change places block by block."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        low = view[start : start + n][::-1].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = low
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, mid: int, end: int) -> None:
    """Let buffer[start:mid] and buffer[mid:end] change places: reverse each, then both."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, mid)
    reverse(view, mid, end)
    reverse(view, start, end)


def transform(raw: bytes, first: int, second: int, form: str) -> bytes:
    """The text with sentinels, in the order of the form (psm or spm); cuts are places in bytes."""
    buffer = bytearray(raw)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that transform() began from. No text with a sentinel of its own is transformed, so each occurs once."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        start, cut = output.index(SUFFIX), output.index(MIDDLE)
    else:
        start, cut = 0, output.index(PREFIX)
    rotate(buffer, start, cut, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that hang on the seed and doc_id alone."""
    digest = hashlib.sha256(f"{seed}:{'-' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def plan(raw: bytes, doc_id: int | None, seed: int = 1) -> tuple[int, str, int, int]:
    """The number of tokens, the form, and the two cuts in bytes (0 if plain)."""
    view = np.frombuffer(raw, np.uint8)
    n = count(view)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN:
        return n, "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < SPM else "psm", *cuts(view, low, high)


def made(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            raw = raw or b""
            n, form, first, second = plan(raw, doc_id, seed)
            view = np.frombuffer(raw, np.uint8)
            plain = form == "plain"
            found = (n, form, None if plain else chars(view[:first]), None if plain else chars(view[first:second]), raw if plain else transform(raw, first, second, form))
            for k, v in zip(rows, found):
                rows[k].append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], names=["doc_id", *rows])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output, its UTF-8 bytes.

    Cuts and form hang on the seed and doc_id alone, so a row can be made anew anywhere. A null text is empty, and empty texts are plain;
    a null doc_id draws as "-". Repeated rows give equal rows; an empty table none. Columns but doc_id and text are not read.
    A text is held a few times, whatever its length; nothing else grows with it.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: made(b, seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "output"):
        texts = [restore(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "restored"])


def restored(outputs: DataFrame) -> DataFrame:
    """fill_in_middle()'s rows with `restored`, the text's UTF-8 bytes, rebuilt from output and form alone."""
    kept = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return outputs.mapInArrow(rebuilt, f"{kept}, restored binary")


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """fill_in_middle() and restored() with digests in place of texts; rows as there."""
    both = restored(fill_in_middle(docs, seed))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
