"""Token counts, whitening and ranked search against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from wardflow.llm import lexical_search, token_counts, whitening

BPE = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- token counts -----------------------------------------------------------------

def _odd_texts() -> list[str | None]:
    rng = random.Random(3)
    texts = [None, "", "'", "a'", "'re", "'r", "'l", "'ll'll", "  a", " \n a", "\n\n a", "a  ",
             "a \t", "don't we'll'll 's 're''s", "'rr 've 'v", "a 　 b", "՘ x՘",
             "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|",
             "x" * 30_000, " " * 30_000, "ab" * 20_000, "\n \n" * 5000]
    plain = "abcdeglmorstuv'  \n\t1230!?.-éß中 ERSTL"
    for _ in range(1500):
        texts.append("".join(rng.choices(plain, k=rng.randint(1, 60))))
    for _ in range(100):
        texts.append("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF),
                                             rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)))
    for letters in ("ab", "aei ntrs"):
        for _ in range(100):
            texts.append("".join(rng.choices(letters, k=rng.randint(1, 300))))
    return texts


def _library_counts(texts: list[str | None]) -> list[int]:
    found = Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts],
                                                  add_special_tokens=False)
    return [len(x.ids) for x in found]


def test_counts_equal_the_library(spark):
    texts = _odd_texts()
    schema = StructType([StructField("id", LongType()), StructField("text", StringType()),
                         StructField("size", StringType()), StructField("a.b", LongType())])
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], schema)
    docs = docs.unionByName(docs.limit(1)).repartition(3)
    rows = token_counts.with_counts(docs, BPE, name="found", limit=20).collect()
    assert len(rows) == len(texts) + 1
    wanted = _library_counts(texts)
    for row in rows:
        assert (row["a.b"], row["size"]) == (row["id"], "kept")
        assert row.found.n_tokens == wanted[row["id"]], texts[row["id"]]
        assert row.found.n_bytes == len((texts[row["id"]] or "").encode())
        assert row.found.over_limit == (row.found.n_tokens > 20)


def test_counts_replace_the_text_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), (2, None)], "doc_id long, text string")
    rows = token_counts.with_counts(docs, BPE, name="text").collect()
    assert sorted((r.doc_id or 0, r.text.n_tokens) for r in rows) == [(0, 2), (2, 0)]
    assert token_counts.with_counts(docs.limit(0), BPE).count() == 0


def test_scan_composes_as_the_transducer_runs():
    cutter = token_counts.PieceCutter()
    kinds = np.random.default_rng(1).integers(0, 11, 20_000)
    state = 0
    for kind, whole in zip(kinds, cutter.scan(cutter.of_kind[kinds]), strict=True):
        state = token_counts._step(state, kind)[0]
        assert cutter.maps[whole, 0] == state


def test_counts_do_not_change_when_states_are_forgotten():
    file = token_counts.compiled(BPE)
    merges = [(b"a", b"b"), (b"b", b"a"), (b"ab", b"ab"), (b"c", b"ab")]
    small = token_counts.TokenCounter(merges, states=2)
    large = token_counts.TokenCounter(merges)
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choices("abc", k=40)).encode()
        assert small.count(piece) == large.count(piece)
    assert file.counter.count(b"x" * 1000) == _library_counts(["x" * 1000])[0]


# -- whitening ----------------------------------------------------------------------

@pytest.mark.parametrize("values", [
    np.random.default_rng(0).random(40), 10.0 ** -np.arange(30.0), np.ones(5), np.zeros(3),
    np.array([3, 3, 3, 1, 1, 0.0]), np.array([2.0]), np.arange(1.0, 8.0),
    np.concatenate([np.ones(16), np.zeros(16)])])
def test_leading_components_are_eigenvectors(values):
    n = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    a = turn * values @ turn.T
    a = (a + a.T) / 2
    value, vector = whitening.leading(a, 8)
    assert value == pytest.approx(sorted(values, reverse=True)[:8], abs=1e-13 * values.max())
    assert np.allclose(vector.T @ vector, np.eye(len(value)), atol=1e-13)
    assert np.allclose(a @ vector, vector * value, atol=1e-13 * max(values.max(), 1))


def test_polar_factor_is_orthogonal_and_leaves_a_positive_part():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.allclose(u @ u, np.eye(20), atol=1e-12)
    assert np.linalg.eigvalsh(u @ a).min() > 0


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                      StructField("x", StringType()), StructField("a.b", LongType())])


def _vectors() -> list[list | None]:
    rng = np.random.default_rng(7)
    mixed = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))
    rows: list[list | None] = [r.astype(np.float32).tolist() for r in mixed]
    rows += rows[:3] + [rows[5]] * 100
    return rows + [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] * 12]


def test_whitening_equals_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i if i else None, r, "s", 1) for i, r in enumerate(rows)], VECTORS)
    got = whitening.whitened(df.repartition(4)).toPandas()
    x = np.floor(1024 * np.array(rows[:403], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained",
                                "identity_error"}
    centred = x - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    for c in range(8):
        own = got[got["component"] == c + 1].set_index(got[got["component"] == c + 1]["vec_id"].fillna(0))
        wanted = centred @ vector[:, c] / np.sqrt(value[c])
        found = own["whitened"].loc[range(n)].to_numpy()
        sign = np.sign(found @ wanted)
        assert np.allclose(found, sign * wanted, atol=1e-9)
        assert np.allclose(own["explained"], value[c] / value.sum(), rtol=1e-10)
        for i in (0, 5, 200):
            assert own["deviation"].loc[i] == sum(int(v) ** 2 for v in n * x[i] - sums)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8


def test_whitening_of_odd_tables(spark):
    def of(*vectors):
        df = spark.createDataFrame([(i, list(v), "s", 1) for i, v in enumerate(vectors)], VECTORS)
        return whitening.whitened(df).orderBy("vec_id", "component").collect()

    assert of() == []
    single = of([1.0, 2.0])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in single] == [
        (1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = of([0.0, 5.0], [1.0, 5.0])  # the second dimension never varies
    assert [abs(r.whitened) if r.whitened is not None else None for r in flat] == [1, None, 1, None]
    assert {r.explained for r in flat} == {1.0, 0.0} and flat[0].identity_error < 1e-12
    with pytest.raises(Exception, match="several lengths"):
        of([1.0], [1.0, 2.0])
    with pytest.raises(Exception, match="too large"):
        of([1e30], [1.0])


def test_a_deviation_beyond_a_long_is_null():
    x = np.array([[0, 0], [1 << 40, 3]])
    sums = x.sum(axis=0)
    assert whitening._deviations(x, 2, sums) == [None, None]
    assert whitening._deviations(x // (1 << 20), 2, sums // (1 << 20)) == [1 << 40] * 2


# -- ranked search ------------------------------------------------------------------

def _terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _ranked(docs, items, k=20):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        rows = []
        for doc, own in held:
            m = 75 + (25 * sum(own.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * own[t]) // (1000 * own[t] + 12 * m)) for t in _terms(text) if own[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s)
                for r, (s, none, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Éa", "éa", "ÉA", "straße", "X9", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(60)] + [docs[3], (None, docs[7][1]), (None, "w39 rare")]
    docs += [(3000, None), (3001, ""), (3002, " ,;\x00!"), (3003, "w1 " * 20_000)]
    rng.shuffle(docs)
    items = [(i, ", ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(25)]
    items += [items[0], (1, "other text of item 1: w30"), (50, None), (51, ""), (52, "rare"), (53, docs[7][1]),
              (54, "nowhere")]
    return docs, items


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 23, 1 << 23), (4000, 900)])
def test_search_equals_brute_force(spark, corpus, shard_bytes, block_bytes):
    docs, items = corpus
    table = (spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
             .withColumn("score", F.lit(1)).withColumn("a.b", F.lit(2)))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("docs", F.lit(1))
    found = lexical_search.search(lexical_search.index(table, shard_bytes=shard_bytes), asked,
                                  block_bytes=block_bytes).collect()
    assert sorted(map(tuple, found), key=str) == _ranked(
        docs, [(i, t) for i, t in items if t is not None])


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)),
                 (docs.withColumn("text", F.lit(None).cast("string")), items)):
        found = lexical_search.search(lexical_search.index(d), i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


@pytest.mark.parametrize("short", [0, 3, 50, 10_000])
def test_skipping_keeps_the_first_documents(short):
    rng = np.random.default_rng(5)
    n = 3000
    ids, null = rng.permutation(n), np.zeros(n, bool)
    for _ in range(20):
        lists, total = [], np.zeros(n, np.int64)
        for size in (2, 9, 40, 300, 1500, 2900):
            doc = np.sort(rng.choice(n, size, replace=False)).astype(np.int32)
            score = rng.integers(1, 40, size) * (n // size)
            total[doc] += score
            lists.append(lexical_search._List(doc, score, int(score.max())))
        first = lexical_search.First(20)
        read = lexical_search.search_lists(lists, n, ids, null, first, short)
        held = np.flatnonzero(total)
        best = held[np.lexsort((ids[held], -total[held]))][:20]
        assert first.id.tolist() == ids[best].tolist()
        assert first.score.tolist() == total[best].tolist()
        if short == 50:
            assert read < sum(len(x.doc) for x in lists) / 2
