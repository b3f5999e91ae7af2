"""Hashing of words takes little memory beside its lines."""

import tracemalloc

import numpy as np

from ledgerloom.llm import linejoin


def test_lines_are_hashed_in_runs():
    lines = [b"some words %d of a line" % i for i in range(60_000)] + [b"z " * 50_000, b"last"]
    row, h = linejoin.hashed(lines[-3000:])
    few, same = linejoin.hashed(lines[-3000:], 100)
    assert np.array_equal(row, few) and np.array_equal(h, same) and row[-1] == 2999
    linejoin.powers_up_to.cache_clear()
    tracemalloc.start()
    linejoin.hashed(lines)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45e6
