"""Byte BPE of pieces without a break, against the library."""

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_long_pieces_equal_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(100_000)), "a" * 3_000_000, "漢字かな" * 2000, "".join(rng.choice("etaoinshr") for _ in range(60_000)), "ab" * 130]
    texts += [base64.b64encode(rng.randbytes(75_000)).decode(), "=" * 5001, " " * 4000 + "x", "abcdefg" * 3000, "".join(rng.choice(["é", "è", "ou", "que", "l"]) for _ in range(9000))]
    coder = bpe.Coder(PATH, public_tokenizers.PATTERN)
    for text, ids, decoded in zip(texts, *(x.to_pylist() for x in coder.encode(pa.array(texts)))):
        assert ids == library.encode_ordinary(text) and decoded.decode() == text


@pytest.mark.parametrize("window", [4, 10, 64])
def test_windows_of_any_size_give_the_same_tokens(library, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "WINDOWS", 7)
    rng = random.Random(2)
    coder = bpe.Coder(PATH, public_tokenizers.PATTERN)
    for alphabet in ("aeinrst", "ab", "a", "thing", "éèou"):
        for _ in range(12):
            piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 300)))
            if piece.encode() not in coder.ranks:
                assert coder.merge_long(piece.encode()) == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(piece))
