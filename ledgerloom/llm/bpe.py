"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Texts are cut into pieces by the tokenizer's pattern. A partition's distinct pieces become
token-position rows, one for each byte. A recursive query joins the adjacent rows of every piece to
the merge table, contracts the piece's leftmost pair of minimum rank and repeats until no piece
has a pair left. An ordered aggregation of the bytes of the ids, and of nothing else, decodes.

The recursive query keeps the rows of all its steps, about half the square of a piece's bytes. So a longer piece is merged in
windows that overlap by half, as pieces of their own. A row of tokens is the encoding of its bytes if and only if each two neighbours
are the encoding of theirs; so two windows may be joined at any place where a token of the one ends and a token of the other begins, if
these two are. Where there is no such place the next window begins at a token of the last one, or a window of twice the length is merged.

Pieces that a Python worker has met are remembered between batches, ids and decoded bytes, in two
generations of bounded size, so that a frequent piece is merged once; a forgotten piece is merged again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import claim, text_slices

#: Pieces merged by one query, and pieces and words remembered in one generation.
PIECES_PER_QUERY, PIECES_KEPT = 20_000, 200_000
#: Bytes of text coded at once, unless one text has more.
SLICE = 4 << 20

#: Bytes of a window, and windows held at once; rows of all its pieces' steps up to which a query goes.
WINDOW, WINDOWS, ROWS_PER_QUERY = 64, 4096, 1_000_000
#: Pairs of tokens whose encoding is remembered; tokens decoded at once; bytes of a piece up to which it is remembered.
PAIRS_KEPT, TOKENS_PER_QUERY, REMEMBERED = 1 << 18, 1 << 17, 1 << 12

#: Places count on through all pieces of a query, with a gap after each, so the next place is the next token of
#: the piece or nobody's; a contraction moves the places after it up by one.
MERGE = """
WITH RECURSIVE t(w, step, pos, tok) AS (
  SELECT w, 0, pos, tok FROM start
  UNION ALL
  (WITH best AS (
     SELECT a.w, min(m::BIGINT * 4294967296 + a.pos) AS k
     FROM t a JOIN t b ON b.pos = a.pos + 1 JOIN merges ON lr = a.tok::BIGINT * 4294967296 + b.tok GROUP BY a.w)
   SELECT t.w, t.step + 1, CASE WHEN t.pos > k % 4294967296 THEN t.pos - 1 ELSE t.pos END,
     CASE WHEN t.pos = k % 4294967296 THEN (k // 4294967296)::INT ELSE t.tok END
   FROM t JOIN best USING (w) WHERE t.pos <> k % 4294967296 + 1)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) GROUP BY w
"""
#: The bytes of the ids of each piece, in order.
DECODE = "SELECT w, string_agg(hx, '' ORDER BY pos) AS hx FROM coded JOIN vocab ON id = tok GROUP BY w"
#: The characters of Unicode's White_Space property; the standard re module's class has four more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fast_pattern(pattern: str) -> re.Pattern:
    """The pattern for the standard re module, with Unicode classes written out as ranges."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(kind: str) -> str:
        runs = (m.group() for m in regex.finditer(rf"{kind}+", every))
        return "".join(re.escape(r[0]) + "-" + re.escape(r[-1]) if len(r) > 1 else re.escape(r) for r in runs)

    letters, numbers = ranges(r"\p{L}"), ranges(r"\p{N}")
    fast = pattern
    kinds = ((r"[^\s\p{L}\p{N}]", rf"[^{SPACE}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{SPACE}]"), (r"\S", f"[^{SPACE}]"))
    for inside, kind in kinds:
        fast = fast.replace(inside, kind)
    return re.compile(fast)


Coded = tuple[bytes, bytes]
#: Tokens, and the places where each begins and the last one ends.
Window = tuple[list[int], list[int]]


class Coder:
    """Encodes and decodes pieces for one vocabulary, in this process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = fast_pattern(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.new: dict[str, Coded] = {}
        self.old: dict[str, Coded] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        rows = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db.register("rows", pa.table({n: pa.array([r[i] for r in rows], pa.int32()) for i, n in enumerate("lrm")}))
        self.db.register("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hx": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT l::BIGINT * 4294967296 + r AS lr, m FROM rows")
        self.db.execute("CREATE TABLE vocab AS FROM tokens")
        self.db.unregister("rows")
        self.db.unregister("tokens")

    def start(self, raw: list[bytes]) -> pa.Table:
        size = np.array(list(map(len, raw)))
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        return pa.table({"w": w, "pos": np.arange(size.sum(), dtype=np.int64) + w, "tok": self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]})

    def merge_short(self, part: list[bytes]) -> list[bytes]:
        """The ids of pieces, one query for as many as its rows allow."""
        out: list[bytes] = []
        at = 0
        while at < len(part):
            to, rows = at, 0
            while to < len(part) and to - at < PIECES_PER_QUERY and (to == at or rows < ROWS_PER_QUERY):
                rows += len(part[to]) * (len(part[to]) + 1) // 2
                to += 1
            self.db.register("start", self.start(part[at:to]))
            found = self.db.sql(MERGE).to_arrow_table()
            self.db.unregister("start")
            lists = found.column("ids").combine_chunks()
            ends, flat = (lists.offsets.to_numpy() * 4).tolist(), lists.values.to_numpy().tobytes()
            ids = [b""] * (to - at)
            for w, a, b in zip(found.column("w").to_pylist(), ends, ends[1:]):
                ids[w] = flat[a:b]
            out += ids
            at = to
        return out

    def windows(self, raw: bytes, starts: list[int], size: int = WINDOW) -> list[Window]:
        """The encodings of raw[s : s + size]; equal windows are merged once."""
        parts = [raw[s : s + size] for s in starts]
        distinct = list(dict.fromkeys(parts))
        merged = {p: np.frombuffer(ids, np.int32).tolist() for p, ids in zip(distinct, self.merge_short(distinct))}
        ends = {p: list(accumulate(len(self.bytes_of[t]) for t in ids)) for p, ids in merged.items()}
        return [(merged[p], [s, *(s + e for e in ends[p])]) for p, s in zip(parts, starts)]

    def learn_pairs(self, pairs: set[tuple[int, int]]) -> None:
        """Have in self.pairs whether two tokens are the encoding of their bytes."""
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        asked = [p for p in pairs if p not in self.pairs]
        merged = self.merge_short([self.bytes_of[a] + self.bytes_of[b] for a, b in asked])
        self.pairs.update((p, ids == np.array(p, np.int32).tobytes()) for p, ids in zip(asked, merged))

    def joins(self, left: Window, right: Window) -> list[tuple[int, int, int]]:
        """Where a token of left ends and one of right begins, and their numbers there; those in the middle of what both hold first."""
        begins = {at: j for j, at in enumerate(right[1][:-1])}
        found = [(at, i, begins[at]) for i, at in enumerate(left[1][1:], 1) if at in begins]
        middle = (right[1][0] + left[1][-1]) / 2
        return sorted(found, key=lambda x: abs(x[0] - middle))

    def fits(self, left: Window, i: int, right: Window, j: int) -> bool:
        pair = left[0][i - 1], right[0][j]
        if pair not in self.pairs:
            self.learn_pairs({pair})
        return self.pairs[pair]

    def merge_long(self, raw: bytes) -> bytes:
        """The ids of one piece of any length; what is held besides them and the piece is a block of windows."""
        stride, out, now = WINDOW // 2, [], None
        starts = list(range(0, max(1, len(raw) - stride), stride))
        for at in range(0, len(starts), WINDOWS):
            block = self.windows(raw, starts[at : at + WINDOWS])
            self.learn_pairs({(a[0][i - 1], b[0][j]) for a, b in zip(block, block[1:]) for _, i, j in self.joins(a, b)[:1]})
            for k, nxt in enumerate(block):
                if now is None:
                    now = nxt
                elif nxt[1][-1] > now[1][-1]:
                    now = self.joined(raw, now, nxt, out)
        out.append(np.array(now[0], np.int32))
        return np.concatenate(out).tobytes()

    def joined(self, raw: bytes, now: Window, nxt: Window, out: list[np.ndarray]) -> Window:
        """The window that goes on after now and is at least as far as nxt; the tokens before it are put out."""
        size = WINDOW
        while now[1][-1] < nxt[1][-1]:
            for _, i, j in self.joins(now, nxt):
                if self.fits(now, i, nxt, j):
                    out.append(np.array(now[0][:i], np.int32))
                    return nxt[0][j:], nxt[1][j:]
            # begin anew at a token's end, the middle one first, and meet nxt or go past it
            for i in sorted(range(1, len(now[1]) - 1), key=lambda i: abs(now[1][i] - (now[1][0] + now[1][-1]) / 2)):
                more = self.windows(raw, [now[1][i]], size)[0]
                if more[1][-1] > now[1][-1] and self.fits(now, i, more, 0):
                    out.append(np.array(now[0][:i], np.int32))
                    now = more
                    break
            else:
                size *= 2
                now = self.windows(raw, [now[1][0]], max(size, 2 * (now[1][-1] - now[1][0])))[0]
        return now

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces."""
        out: dict[str, bytes] = {}
        part: list[str] = []
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WINDOW:
                out[piece] = self.merge_long(raw)
            else:
                part.append(piece)
        out.update(zip(part, self.merge_short([p.encode() for p in part])))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, by the ordered aggregation over its token-position rows; long lists in parts."""
        parts = [(w, x[at : at + 4 * TOKENS_PER_QUERY]) for w, x in enumerate(ids) for at in range(0, len(x), 4 * TOKENS_PER_QUERY)]
        out: list[list[bytes]] = [[] for _ in ids]
        at = 0
        while at < len(parts):
            to, rows = at, 0
            while to < len(parts) and (to == at or rows < TOKENS_PER_QUERY):
                rows += len(parts[to][1]) // 4
                to += 1
            for (w, _), raw in zip(parts[at:to], self.decode_part([x for _, x in parts[at:to]])):
                out[w].append(raw)
            at = to
        return [b"".join(x) for x in out]

    def decode_part(self, ids: list[bytes]) -> list[bytes]:
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        rows = pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": np.arange(size.sum()), "tok": np.frombuffer(b"".join(ids), dtype=np.int32)})
        self.db.register("coded", rows)
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        hx = found.column("hx").combine_chunks().cast(pa.large_string())
        ends = np.frombuffer(hx.buffers()[1], dtype=np.int64)[hx.offset : hx.offset + len(hx) + 1] // 2 if len(hx) else np.zeros(1, np.int64)
        flat = bytes.fromhex(str(hx.buffers()[2], "ascii")) if len(hx) else b""
        out = [b""] * len(ids)
        for w, a, b in zip(found.column("w").to_pylist(), ends.tolist(), ends[1:].tolist()):
            out[w] = flat[a:b]
        return out

    def recall(self, pieces: set[str]) -> None:
        """Have all pieces in self.new."""
        missing = []
        for piece in pieces:
            if piece not in self.new:
                if piece in self.old:
                    self.new[piece] = self.old[piece]
                else:
                    missing.append(piece)
        # as many at once as one query should hold
        for at in range(0, len(missing), PIECES_PER_QUERY):
            part = missing[at : at + PIECES_PER_QUERY]
            merged = self.merge(part)
            self.new.update(zip(part, zip(map(merged.__getitem__, part), self.decode([merged[p] for p in part]))))

    def recall_words(self, words: list[str]) -> None:
        """Have all words, which are one or more pieces each, in self.new."""
        pieces, several = set(), {}
        for word in words:
            if word not in self.new:
                if word in self.old:
                    self.new[word] = self.old[word]
                    continue
                cut = self.split(word)
                pieces.update(cut)
                if len(cut) != 1:
                    several[word] = cut
        self.recall(pieces)
        for word, cut in several.items():
            found = [self.new[p] for p in cut]
            self.new[word] = (b"".join([x for x, _ in found]), b"".join([x for _, x in found]))

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.BinaryArray]:
        """Token ids and decoded bytes of each text.

        A piece holds white space at its beginning only. So a text may be cut before every single space, and
        each distinct word with its space is cut into pieces once. A text with wider white space is cut as a whole.
        """
        words = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        flat = words.flatten().dictionary_encode()
        names, code = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        many = np.array(pc.list_value_length(words), dtype=np.int64)
        first = np.cumsum(many) - many
        # a space beside another white space: a word begins or ends with one, or is empty
        wide = np.array([not w or w[0].isspace() or w[-1].isspace() for w in names], dtype=bool)
        whole = np.maximum.reduceat(wide[code], first) & (many > 1) if len(many) else np.empty(0, bool)
        spaced = np.ones(len(code), dtype=np.int64)
        spaced[first] = 0
        code = code * 2 + spaced
        if whole.any():
            # their pieces, numbered on as words without a space, take the place of their words
            cut = [self.split(t) for t in texts.filter(pa.array(whole)).to_pylist()]
            more = pa.array([p for c in cut for p in c], pa.large_string()).dictionary_encode()
            keys = (more.indices.to_numpy().astype(np.int64) + len(names)) * 2
            names += more.dictionary.to_pylist()
            size = np.array(list(map(len, cut)))
            stay = np.repeat(~whole, many)
            many[whole] = size
            source = np.repeat(whole, many)
            mixed = np.empty(len(source), dtype=np.int64)
            mixed[source], mixed[~source] = keys, code[stay]
            code = mixed
        used = np.zeros(2 * len(names), dtype=bool)
        used[code] = True
        place = np.cumsum(used) - 1
        known = [" " + names[k >> 1] if k & 1 else names[k >> 1] for k in np.flatnonzero(used).tolist()]
        self.recall_words(known)
        coded = list(map(self.new.__getitem__, known))
        for word in known:
            if len(word) > REMEMBERED:
                self.new.pop(word, None)
        if len(self.new) > PIECES_KEPT:
            self.old, self.new = self.new, {}
        ends, take = np.append(0, np.cumsum(many)), pa.array(place[code])
        ids, made = (list_of([c[i] for c in coded], kind).take(take) for i, kind in enumerate((pa.int32(), pa.uint8())))
        at_ids, at_made = (np.append(0, np.cumsum(pc.list_value_length(x).to_numpy()))[ends].astype(np.int32) for x in (ids, made))
        return pa.ListArray.from_arrays(pa.array(at_ids), ids.flatten()), pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at_made), made.flatten().buffers()[1]])


def list_of(values: list[bytes], kind: pa.DataType) -> pa.ListArray:
    """Arrays of fixed-width numbers, given as bytes."""
    width = kind.bit_width // 8
    ends = np.append(0, np.cumsum([len(v) // width for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(kind, int(ends[-1]), [None, pa.py_buffer(b"".join(values))]))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    claim("bpe", coder.cache_clear)
    code = coder(path, pattern)
    for batch in text_slices(batches, most_bytes=SLICE):
        gc.disable()  # nothing here is in a cycle, and there are many objects
        try:
            ids, decoded = code.encode(batch.column("text"))
        finally:
            gc.enable()
        yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], names=[*batch.schema.names, "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs' doc_id and text with ids (the token ids of the whole text) and decoded (the bytes of those ids).

    Null texts count as empty and give no ids; there are no special tokens. Row for row; equal texts
    give equal ids. Columns of docs but doc_id and text are not read. A piece may be as long as its text: it is merged
    in windows, in a time that grows with its length.
    """
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: encode_batches(it, path, pattern), "doc_id long, text string, ids array<int>, decoded binary")


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    code = coder(path, pattern)
    for batch in batches:
        decoded = code.decode([np.array(ids or [], dtype=np.int32).tobytes() for ids in batch.column("ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded's doc_id and ids with decoded, the bytes of the ids in order; null or no ids give no bytes."""
    rows = coded.select("doc_id", "ids")
    return rows.mapInArrow(lambda it: decode_batches(it, path, pattern), "doc_id long, ids array<int>, decoded binary")


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The digests of encode()'s columns, computed where these are made so that they are not moved."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in encode_batches(batches, path, pattern):
        ids = batch.column("ids")
        shown = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), ",").cast(pa.binary())
        digests = [pa.array(map(sha, x.to_pylist()), pa.string()) for x in (shown, batch.column("decoded"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens and the digests of the ids and of the decoded bytes, from encode()'s columns.

    Null and empty texts have no tokens and the digests of nothing. Row for row, repeated rows too; equal texts have equal
    digests; columns of docs but doc_id and text are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: digest_batches(it, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
