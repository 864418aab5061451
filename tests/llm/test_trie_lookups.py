"""What the trie looks up while it scores, and the bits it selects."""

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import elias_fano, ngram_trie
from wardflow.llm import words as W

TEXTS = ["a b a b c d a b", "a b c a b d d d", None, "", "c c c a b", "e a b c"]


def test_each_pair_is_looked_up_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = ngram_trie.train(spark, docs, min_count=1)
    asked, child = [], ngram_trie.Levels.child

    def noted(self, level, parent, word):
        pairs = list(zip(parent.tolist(), word.tolist(), strict=True))
        assert len(pairs) == len(set(pairs))
        asked.append(level)
        return child(self, level, parent, word)

    monkeypatch.setattr(ngram_trie.Levels, "child", noted)
    texts = [*TEXTS, "a zz b", "zz"]  # a word that is not known, also as a context
    block = next(W.blocks(pa.array(texts, pa.string())))
    tokens, known, _, score = ngram_trie._scores(ngram_trie.Levels(model), block)
    assert asked == [2, 3]
    assert tokens.tolist() == [9, 9, 1, 1, 6, 5, 4, 2]
    assert known.tolist() == [9, 9, 1, 1, 6, 5, 3, 1]
    alone = [ngram_trie._scores(ngram_trie.Levels(model), next(W.blocks(pa.array([t], pa.string()))))
             [3][0] for t in texts]
    assert score.tolist() == pytest.approx(alone)


def test_select_in_words_of_any_bits():
    draw = np.random.default_rng(7)
    words = np.concatenate([
        np.array([1, 1 << 63, 2 ** 64 - 1, 0x8000000000000001], np.uint64),
        draw.integers(0, 1 << 63, 40, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    places = [[i for i in range(64) if int(w) >> i & 1] for w in words]
    word = np.repeat(words, [len(p) for p in places])
    k = np.concatenate([np.arange(len(p)) for p in places])
    assert elias_fano._select_in_word(word, k).tolist() == [i for p in places for i in p]
