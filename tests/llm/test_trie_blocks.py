"""The trie's work for a stretch of text: one block of it, each number read once."""

import numpy as np
import pyarrow as pa

from wardflow.llm import ngram_trie
from wardflow.llm import words as W
from wardflow.llm.elias_fano import EliasFano, encode


def test_text_that_is_sent_together_is_one_block():
    column = pa.array(["word " * 700_000] + ["a b"] * 5)
    (a, b), = zip(W._cuts(column, W.SLICE_BYTES), W._cuts(column, W.SLICE_BYTES)[1:], strict=False)
    assert [len(x.bounds) - 1 for x in W.blocks(column.slice(a, b), ngram_trie.BLOCK_BYTES)] == [6]


def test_a_number_that_is_found_is_not_read_again(monkeypatch):
    values = np.arange(0, 64_000, 64, dtype=np.uint64)
    sequence = EliasFano(encode(values, 64_000, "v"), "v")
    read, lows = [], EliasFano._lows
    monkeypatch.setattr(EliasFano, "_lows", lambda self, i: read.append(len(i)) or lows(self, i))
    at, found = sequence.successor(values)
    assert found.all() and at.tolist() == list(range(1000))
    assert sum(read) == 1000


def test_successors_equal_those_by_sorted_search():
    rng = np.random.default_rng(8)
    for n, universe in ((1, 2), (5, 40), (300, 400), (3000, 1 << 40), (2000, 6000)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)  # some repeat
        sequence = EliasFano(encode(values, universe, "v"), "v")
        x = np.concatenate([values, rng.integers(0, universe, 500).astype(np.uint64)])
        at, found = sequence.successor(x)
        assert found.tolist() == np.isin(x, values).tolist()
        assert at[found].tolist() == np.searchsorted(values, x[found]).tolist()
