"""Entries of the similarity join: dealt once, and only where two sets may link."""

import numpy as np

from wardflow.llm import jaccard_join


def test_entries_are_dealt_once_however_often_the_list_grows(spark, monkeypatch):
    dealt, shared = [], jaccard_join._shared
    monkeypatch.setattr(jaccard_join, "_shared", lambda *a: dealt.append(1) or shared(*a))
    monkeypatch.setattr(jaccard_join, "_worth", lambda sets, cost: True)
    texts = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(60)]
        texts += [" ".join([*base, f"end{k}"]) for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.join_documents(docs, frequent=2, count_links=False).collect()
    assert len(dealt) == 1
    assert {r.doc_id: r.component_id for r in got} == {i: i // 5 * 5 for i in range(20)}


def test_entries_that_can_link_with_none_of_their_key_are_left_out(spark):
    rows = [(1, 10, 100, 100, False), (1, 11, 20, 20, False),     # sizes too far apart
            (2, 10, 100, 80, False), (2, 12, 100, 100, False),    # too few shingles left
            (3, 10, 100, 95, False), (3, 12, 100, 100, False), (3, 11, 20, 20, False),
            (3, 12, 100, 100, False),                             # a repeated entry
            (4, 13, 50, 50, False),                               # a set by itself
            (5, 14, 50, 50, True), (5, 15, 500, 500, True)]       # hot: spread, so kept
    # Long lists are not looked through.
    rows += [(6, 100 + i, 10 ** (1 + i % 2) * 3 ** (i // 4), 9, False) for i in range(20)]
    entries = spark.createDataFrame(rows, "key long, set_id long, n int, rest int, hot boolean")
    got = sorted((r.key, r.set_id) for r in jaccard_join._shared(entries, 80).collect())
    assert got == [(3, 10), (3, 12), (5, 14), (5, 15), *[(6, 100 + i) for i in range(20)]]


def test_partners_equal_those_of_all_pairs():
    rng = np.random.default_rng(4)
    run = np.sort(rng.integers(0, 60, 300))
    n = rng.integers(5, 40, 300)
    rest = n - rng.integers(0, 1 + n // 5)
    long = np.bincount(run)[run] > jaccard_join._SMALL_UNIT
    want = [bool(long[i]) or any(
        run[i] == run[j] and i != j and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
        and 180 * min(rest[i], rest[j]) >= 80 * (n[i] + n[j]) for j in range(300))
        for i in range(300)]
    assert jaccard_join._partnered(run, n, rest, 80).tolist() == want


def test_shingles_that_come_to_the_front_are_counted(spark):
    words = " ".join(f"w{i}" for i in range(104))  # 100 shingles, the first 21 are entered
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    none = np.zeros(0, np.uint64)
    entries, forward = jaccard_join._entries(docs, "text", 5, 80, none, none.astype(np.int64), 0)
    by_hash = {r.key for r in entries.collect()}
    assert len(by_hash) == 21 and not forward.count()
    listed = np.sort(np.array(sorted(by_hash)[:7], np.int64).view(np.uint64))
    entries, forward = jaccard_join._entries(docs, "text", 5, 80, listed, np.arange(7), 0)
    new = {r.key for r in entries.collect()} - by_hash
    assert len(new) == 7 and {r.key for r in forward.collect()} == new
