"""Long values, hidden names, frequent contexts, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

import corpus_pipeline
from wardflow.llm import (
    byte_bpe,
    jaccard_join,
    line_cleaning,
    ngram_trie,
    packing,
    quality_rules,
    secret_forest,
)
from wardflow.llm import words as W

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# -- secrets -------------------------------------------------------------------------

N = 1_000_000


@pytest.fixture(scope="module")
def forest(spark):
    return secret_forest.train(secret_forest.labelled_findings(spark))


def test_values_of_any_length_are_scanned(spark, forest):
    rng = random.Random(1)
    run = "".join(rng.choices("abcdefghijkXYZ0123456789", k=N))
    texts = [f"password={run}", f'{{"k":"{run}"}}', "abcdefg1." * (N // 9), "abcdefgh." * (N // 9),
             "a1b2c3d4e5." * (N // 11), "x" * N, "=" * N, "key=" * (N // 4), "@" * N,
             "password=" + "a@b1" * (N // 4), "token: " + "." * N, "pw=" + "a." * (N // 2),
             "-----BEGIN RSA PRIVATE KEY-----\n" + "Header: x\n" * 50_000 + "\n" + run[:60],
             "-----BEGIN RSA PRIVATE KEY-----" + "\n" * N + run[:60] + "\n-----END",
             "-----BEGIN PRIVATE KEY-----\n" + (run[:64] + "\n") * (N // 65) + "-----END"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = secret_forest.with_findings(docs, forest).select("doc_id", F.size("findings")).collect()
    assert len(found) == len(texts)
    assert dict(map(tuple, found))[0] == 1


def test_a_long_row_of_named_values_keeps_a_bounded_context(spark, forest):
    row = "&".join(f"api_key={hashlib.sha1(str(i).encode()).hexdigest()}" for i in range(2000))
    docs = spark.createDataFrame([(1, row)], "doc_id long, text string")
    found = secret_forest.findings(docs, forest).collect()
    assert len(found) == 2000
    assert max(len(r.before) for r in found) <= 3 * secret_forest.CONTEXT + 3
    assert sum(r.is_secret for r in found) > 1900


@pytest.mark.parametrize("line", [
    "passwort={}", "Kennwort: {}", "clave = {}", "contraseña: {}", "mot de passe: {}", "jeton={}"])
def test_secrets_named_in_other_languages(spark, forest, line):
    value = "8sK2mQ9xZ7vvLb31"
    docs = spark.createDataFrame([(1, "text " + line.format(value) + " more")],
                                 "doc_id long, text string")
    assert value not in secret_forest.masked(docs, forest).first().text


# -- columns of any name ----------------------------------------------------------------

def _clashing(spark, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", "_lines", "_n", "_set", "_shingles",
             "_statistics", "_score", "_findings", "_out", "c0", "a.b", "score"]
    schema = StructType([StructField(n, StringType() if n in ("text", "lang", "source") else LongType())
                         for n in names])
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), *range(i, i + 11)) for i, t in rows], schema)


GOOD = ("The committee met on Tuesday, and it agreed that further work on the bridge should wait. "
        "Engineers had found cracks in two of its piers, which nobody had expected so soon. ")


def _documents(n=60):
    rng = random.Random(9)
    words = GOOD.lower().replace(",", "").replace(".", "").split() + ["river", "council", "winter", "stone"]
    rows = []
    for i in range(n):
        body = ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(8)) + "."
        rows.append((i, GOOD + body if i % 4 else "#### $$$$ %%%% " * 30))
    rows += [(100 + i, rows[1][1]) for i in range(3)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "short"),
             (204, rows[2][1] + "\nMenu | Home | About | Contact"),
             (205, rows[3][1] + " password=8sK2mQ9xZ7vvLb31 and so on")]
    return rows


def test_stages_carry_columns_of_any_name(spark):
    docs = _clashing(spark, _documents())
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    model = quality_rules.train(docs, labels)
    forest = secret_forest.train(secret_forest.labelled_findings(spark, 300))
    steps = [line_cleaning.kept_documents, lambda d: quality_rules.kept_documents(d, model, 0.3),
             jaccard_join.one_of_each, lambda d: secret_forest.masked(d, forest)]
    for step in steps:
        for given in (docs, docs.limit(0)):
            out = step(given)
            assert out.schema.names == docs.schema.names
            for row in out.collect():
                assert list(row)[5:] == list(range(row["doc_id"], row["doc_id"] + 11))
    scored = quality_rules.scored(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert [list(r)[5:15] for r in scored.collect()] == [list(range(i, i + 10)) for i, _ in _documents()]


# -- the pipeline ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in _documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
            seen[name] = {r.doc_id: r for r in out.collect()}
            assert all(r.n_chars == len(r.text or "") for r in seen[name].values())
            docs = spark.createDataFrame(list(seen[name].values()), docs.schema)
        else:
            pieces = out.collect()
    given = dict(_documents())
    # Quality rules: junk, empty and short texts go, the menu line goes, prose stays.
    good = {i for i, t in given.items() if t and t.startswith("The committee")}
    assert set(seen["quality_rules"]) == good
    assert seen["quality_rules"][204].text == given[2]
    # The classifier keeps clean documents.
    assert set(seen["quality_classifier"]) == good
    # Copies of documents 1, 2 and near copies of 3: one of each stays, the first.
    assert set(seen["near_duplicates"]) == {i for i in good if i < 100}
    assert {i: r.text for i, r in seen["secret_scan"].items()} == {
        i: given[i] for i in seen["near_duplicates"]}
    # Packing: the ids of every text, each once.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
              for i, r in seen["secret_scan"].items()}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in tokens} == tokens
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))[0] == sorted(map(tuple, pieces))[0]


def test_pipeline_masks_secrets(spark, folder):
    docs = spark.createDataFrame([(205, dict(_documents())[205], "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    row = dict(corpus_pipeline.STAGES)["secret_scan"](spark, docs, folder).first()
    assert "password=[SECRET] and" in row.text and row.n_chars == len(row.text)


def test_pipeline_of_nothing(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# -- line cleaning -------------------------------------------------------------------------

def test_a_mention_in_prose_does_not_lose_a_line(spark):
    prose = GOOD * 4 + "Readers may click here to see our privacy policy. " + GOOD
    docs = spark.createDataFrame([(1, prose), (2, prose + "\nClick here to read our privacy policy"),
                                  (3, prose + "\nHier klicken: Alle Rechte vorbehalten")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r.lines for r in line_cleaning.clean_lines(docs).collect()}
    assert [rows[i].n_boilerplate for i in (1, 2, 3)] == [0, 1, 1]
    assert all(rows[i].clean_text == prose for i in rows)
    bare = line_cleaning.clean_lines(docs, clean=False)
    assert "clean_text" not in bare.schema["lines"].dataType.names


# -- join ------------------------------------------------------------------------------------

@pytest.mark.parametrize("block,small", [(4, 0), (256, 16), (7, 100)])
def test_lists_in_blocks_lose_no_near_pair(spark, monkeypatch, block, small):
    """Many near copies that do not all link with the one in the middle."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "_SMALL_UNIT", small)
    monkeypatch.setattr(jaccard_join, "_UNIT_ROWS", 50)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(1, 9)):
            words[k] = f"x{rng.random()}"
        texts.append(" ".join(words[:rng.randint(120, 150)]))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(set(root)) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.join_documents(docs, frequent=3, count_links=False).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


@pytest.mark.parametrize("worth,passes", [(False, 1), (True, 3)])
def test_entries_are_made_in_one_pass_unless_lists_are_long(spark, monkeypatch, worth, passes):
    """Groups of near copies, all of whose shingles are frequent: hot and other entries."""
    made, entries = [], jaccard_join._entries
    monkeypatch.setattr(jaccard_join, "_entries", lambda *a: made.append(1) or entries(*a))
    assert jaccard_join._worth(np.array([3, 4]), 24) and not jaccard_join._worth(np.array([3, 4]), 25)
    monkeypatch.setattr(jaccard_join, "_worth", lambda sets, cost: worth)
    texts = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        texts += [" ".join([*base, f"end{k}"]) for k in range(5)] + [" ".join(base)] * 2
    docs = spark.createDataFrame(list(enumerate([*texts, None, "alone"])), "doc_id long, text string")
    got = jaccard_join.join_documents(docs, frequent=2, count_links=False).collect()
    assert len(made) == passes
    want = {i: i // 7 * 7 for i in range(42)} | {42: 42, 43: 43}
    assert {r.doc_id: r.component_id for r in got} == want


def test_parities_in_matrices_equal_those_one_by_one():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 31, 33, 64, 200, 900)]
    bits = [jaccard_join._parities(s) for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(range(7), range(7)))
    got = jaccard_join._Parities(pa.array(bits)).differing(i, j)
    want = [jaccard_join._differing(np.frombuffer(bits[a], np.uint8), np.frombuffer(bits[b], np.uint8))
            for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want


# -- language model ----------------------------------------------------------------------------

def test_frequent_contexts_are_spread(spark, monkeypatch):
    """Scores do not depend on which contexts have shards of their own."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30)))
             for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learnt = docs.filter("doc_id % 3 > 0")
    plain = ngram_trie.train(spark, learnt, min_count=1)
    monkeypatch.setattr(ngram_trie, "HEAVY", 15)
    monkeypatch.setattr(ngram_trie, "SHARD_ROWS", 500)
    spread = ngram_trie.train(spark, learnt, min_count=1)
    assert plain.heavy == (False, False) and spread.heavy == (True, True)
    assert spread.shards[1] > 4
    a, b = ({r.doc_id: r.lm.score for r in ngram_trie.scored(docs, m).collect()} for m in (plain, spread))
    # Logarithms are rounded to 8 bits shard by shard.
    assert all(abs(a[i] - b[i]) < 0.02 * (len(texts[i].split()) + 1) for i in a)


# -- packing and byte BPE -------------------------------------------------------------------------

def test_parts_of_words_have_the_tokenizers_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    table, rng = packing._word_table(path), random.Random(2)
    texts = ["".join(rng.choices("abcstrevmlldABZ019'’.,!?%$-_\"é̊Σßñ…—  \n\t　中İ", k=rng.randint(1, 30)))
             for _ in range(1500)] + ["!!!", "a!", "'s!'s", "<|endoftext|>.", "9." * 50, "don't!", "x'!"]
    for text in texts:
        block = next(W.blocks(pa.array([text])))
        data = W.LOWER[block.data]
        parts, raw = packing._parted(data, W.words(data, block.bounds)), data.tobytes()
        got = table.ids([raw[a:b].decode() for a, b in zip(parts.starts, parts.ends, strict=True)])[0]
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_both_ways_in_one_pass_equal_each_way(spark):
    texts = [None, "", "x" * 3000, "Some text, and  more.\n", "é中" * 500, "a" * 9000]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    docs = docs.unionByName(docs)
    rows = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    plain = {r.doc_id: r.tokens.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert r.tokens.ids == plain[r.doc_id] and r["a.b"] == texts[r.doc_id]
        assert bytes(r.tokens.bytes) == (texts[r.doc_id] or "").encode()
    assert byte_bpe.encode_and_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
