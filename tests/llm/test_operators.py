"""The operators on small tables: brute force, round trips and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardflow.llm import (
    byte_bpe,
    elias_fano,
    jaccard_join,
    line_cleaning,
    ngram_trie,
    packing,
    quality_rules,
    queries,
    secret_forest,
    slot_sharding,
    vector_search,
    warc,
)
from wardflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "ONE two", " ", "á Σ"]
    texts += [" ".join(base)] * 4
    for k in range(25):
        changed = list(base)
        for _ in range(k % 7):
            changed[rng.randrange(len(changed))] = f"x{rng.random()}"
        texts.append(" ".join(changed))
    for k in range(12):
        texts.append(passage + " " + " ".join(rng.choices(vocabulary, k=3 + 9 * k)))
        texts.append("\n".join(" ".join(rng.choices(vocabulary, k=8)) + "." for _ in range(9)))
    texts.append(" ".join(rng.choices(vocabulary, k=9000)))
    texts += ["Ein. " * 80, "WORD!! OTHER!! " * 40, "a | b | c | d\n" * 30, "x" * 700 + "1"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(_texts())]
    rows += [rows[9], (None, "one two three four five six", "en", "s", 27)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


# -- line cleaning and quality --------------------------------------------------

def test_line_counts_equal_brute_force(docs):
    for row in line_cleaning.clean_lines(docs).collect():
        text, got = row.text or "", row.lines
        found = WORD.findall(text)
        windows = Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {i + k for i in range(len(found) - 2) for k in range(3)
                   if windows[tuple(found[i:i + 3])] > 1}
        seen, repeats = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines,
                got.n_repeat_words) == (
            len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats,
            len(covered))
        assert got.base_failed == (len(found) < 50 or 100 * len(covered) > 50 * len(found))
        assert not (got.kept and got.base_failed)
        if not got.lost_chars:
            assert got.clean_text == row.text


def test_failing_lines_go(spark):
    prose = " ".join(f"wort{i} und" for i in range(40)) + "."
    other = " ".join(f"satz{i} mit" for i in range(40)) + "."
    text = f"{prose}\nHome | News | Shop | Help\nAll rights reserved.\nBUY!! NOW!! HERE!!\n{other}"
    df = spark.createDataFrame([(1, text, "x")], "doc_id int, text string, lines string")
    row = line_cleaning.clean_lines(df).first()
    assert row.lines.clean_text == f"{prose}\n{other}" and row.lines.kept
    assert (row.lines.n_navigation, row.lines.n_boilerplate, row.lines.n_punctuation) == (1, 1, 2)
    assert line_cleaning.kept_documents(df).columns == df.columns


def test_quality_rules_learn_and_score_all(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, int(not bad)))
    rows += [(None, None), (1000, ""), (1000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.rules
    got = quality_rules.scored(docs, model).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.3) == bool(r.doc_id % 3) for r in held)
    none = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.rules and quality_rules.scored(docs, none).first().score == 0.5


# -- joins -----------------------------------------------------------------------

def test_lasso_is_fitted_until_its_tolerance(spark, monkeypatch):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.4
        words = ["".join(rng.choices("abcdefg", k=rng.choice([3, 5, 9]))) for _ in range(40)]
        noisy = bad != (rng.random() < 0.15)
        rows.append((i, " ".join(w.upper() + "!" if noisy and rng.random() < 0.5 else w
                                 for w in words)))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = []
    plain_lasso = quality_rules.LogisticRegression

    class Recorded(quality_rules.LogisticRegression):
        def fit(self, *a, **b):
            fitted.append((super().fit(*a, **b), self.getMaxIter(), a[0]))
            return fitted[-1][0]

    monkeypatch.setattr(quality_rules, "LogisticRegression", Recorded)
    quality_rules.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    (model, bound, rows), = fitted
    assert model.summary.totalIterations < bound
    # Merged rows give the loss of the single ones.
    single = rows.select("label", "features", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    assert single.count() > rows.count()
    plain = plain_lasso(elasticNetParam=1.0, regParam=quality_rules.PENALTY, maxIter=1000).fit(single)
    assert model.summary.objectiveHistory[-1] == pytest.approx(
        plain.summary.objectiveHistory[-1], rel=1e-3)


def _classes(rows: list[tuple[int | None, str | None]]) -> dict:
    sets = []
    for i, text in rows:
        found = WORD.findall(_lower(text or ""))
        sets.append((i, {tuple(found)} if 0 < len(found) < 5 else
                     {tuple(found[k:k + 5]) for k in range(len(found) - 4)}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    ids: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return {i: (len(s), ids[root(k)] if s else i) for k, (i, s) in enumerate(sets)
            if i is not None}


@pytest.mark.parametrize("boundary", [None, 0, 60, 10 ** 6])
def test_jaccard_classes_equal_brute_force(docs, boundary):
    want = _classes([(r.doc_id, r.text) for r in docs.collect()])
    got = jaccard_join.join_documents(docs, boundary=boundary, frequent=3).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


@pytest.mark.parametrize("boundary", [None, 60])
def test_every_link_is_counted(spark, boundary):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    # Near copies of one text, which link with one another or not, and exact copies.
    texts = [" ".join(base)] * 3
    for _ in range(24):
        words = list(base)
        for k in rng.sample(range(160), rng.choice([1, 1, 2])):
            words[k] = f"x{rng.random()}"
        texts += [" ".join(words)] * rng.choice([1, 2])
    texts += ["", None, "some text that has no copy at all", "two words", "two words"]
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) or
            ({tuple(t.split())} if t.split() else set()) for t in (t or "" for t in texts)]
    want = {i: (sum(5 * len(s & x) >= 4 * len(s | x) for x in sets) - 1 if s else 0)
            for i, s in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.join_documents(docs, boundary=boundary, frequent=3).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert len(set(want.values())) > 3


def test_one_of_each_class_stays(docs, empty):
    want = _classes([(r.doc_id, r.text) for r in docs.collect()])
    got = jaccard_join.one_of_each(docs).collect()
    kept = [r.doc_id for r in got if r.doc_id is not None and want[r.doc_id][0]]
    assert sorted(kept) == sorted({c for n, c in want.values() if n})
    assert sum(1 for r in got if r.doc_id is not None and not want[r.doc_id][0]) == sum(
        1 for n, _ in want.values() if not n)
    assert jaccard_join.one_of_each(empty).count() == 0


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 500)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in range(100, 160)}) == 1
    assert roots[0] != roots[100] and 500 not in roots


# -- tokens ------------------------------------------------------------------------

def test_byte_bpe_equals_the_library_and_decodes(docs, empty):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select(
        "text", F.col("tokens.ids").alias("ids"))
    rows = byte_bpe.decode(encoded.withColumn("_i", F.col("ids")), RANKS, "_i").collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded.bytes) == (row.text or "").encode()
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_covers_every_id_once(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    window = 256
    rows = packing.pack(docs, path, window=window).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    total = 0
    for row in rows:
        ids = np.array([*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 2], "<u4")
        piece = ids[row.start:row.start + row.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids)) == (
            row.length, row.ids_crc32, row.doc_tokens)
        total += row.length
    by_sequence: dict = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sum(r.length for r in rows if r.doc_id == 9) == 2 * next(
        r.doc_tokens for r in rows if r.doc_id == 9)
    assert packing.pack(empty, path).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for window in (8, 100, 4096):
        histogram = np.zeros(window + 1, np.int64)
        for n in rng.integers(1, window + 1, 3000):
            histogram[n] += 1
        used = np.zeros(window + 1, np.int64)
        for pattern in packing.plan(histogram, window):
            assert sum(n * m for n, m in pattern.lengths) <= window
            for n, m in pattern.lengths:
                used[n] += m * pattern.repeat
        assert (used == histogram).all()
    solved = packing.non_negative_least_squares(np.array([[1.0, 0], [0, 1]]), np.array([2.0, -1]))
    assert np.allclose(solved, [2, 0])


# -- shards, search, archives ------------------------------------------------------

def test_shards_are_even_and_gapless(docs, empty):
    rows = slot_sharding.shard(docs, shards=4, slots=512).collect()
    assert len(rows) == docs.count()
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(
            range(sum(r.shard == k for r in rows)))
    for row in rows:
        if row.doc_id == 0:
            assert (row.size, row.text_crc32) == (8, 0)
    assert slot_sharding.shard(empty).count() == 0
    size = np.random.default_rng(2).integers(1, 1000, 800)
    old = slot_sharding.first_map(800, 7)
    new = slot_sharding.rebalanced(old, size, 7)
    load = np.bincount(new, weights=size)
    assert load.max() - load.min() <= 2 and (old != new).mean() < 0.2


@pytest.mark.parametrize("cells", [256, 4, 1])
def test_search_equals_brute_force(spark, cells):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (150, 6)) / 64
    vectors[::5] = vectors[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(200, None), (220, [None] * 6), (240, [float("nan")] * 6), (None, [1.0] * 6),
             (260, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "vec_id", vector_search.scaled(F.col("embedding"), 64).alias("vector"))
    got: dict = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0, 20, cells=cells).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(64 * vectors).astype(int)
    for q in range(0, 150, 20):
        scores = whole @ whole[q]
        best = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(best)]
    assert set(got) == set(range(0, 150, 20))


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert vector_search.nearest(df, F.col("vec_id") % 20 == 0, 20).count() == 0


def test_archive_round_trip_and_pushdown(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None),
            (4, "http://b", ""), (5, "x\r\ny", "é" * 9000), (None, "http://n", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.record_id: r for r in warc.archived(pages, path=str(tmp_path / "a")).collect()}
    assert len(got) == 6
    assert got["<urn:page:1>"].record_type == "revisit" and got["<urn:page:1>"].payload is None
    assert got["<urn:page:1>"].refers_to == "<urn:page:2>"
    assert got["<urn:page:3>"].refers_to == "<urn:page:4>"
    five = got["<urn:page:5>"]
    assert bytes(five.payload).decode() == "é" * 9000 and five.target_uri == "x%0D%0Ay"
    assert five.payload_digest == base64.b32encode(
        hashlib.sha1(("é" * 9000).encode()).digest()).decode()
    source = spark.read.format("warc").option("path", str(tmp_path / "a"))
    assert source.load().filter("record_type = 'revisit'").count() == 2
    assert source.option("payload", "false").load().filter("payload IS NOT NULL").count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip
    raw = [warc.record({"payload": b"p%d" % i, "record_type": "response", "record_id": f"<{i}>",
                        "warc_date": None, "target_uri": None, "refers_to": None})
           for i in range(3)]
    (tmp_path / "plain.warc").write_bytes(b"".join(raw))
    (tmp_path / "other.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    warc.register(spark)
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"p0", b"p0", b"p1", b"p1", b"p2", b"p2"]


# -- secrets -------------------------------------------------------------------------

def test_secrets_are_found_and_masked(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'see token = "{key}" here'), (2, "plain words only"), (3, None), (4, ""),
            (5, f"commit {key} merged"), (6, "password = example-version-2024-sample")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = secret_forest.train(secret_forest.labelled_findings(spark, 600))
    found = {r.doc_id: r for r in secret_forest.findings(docs, forest).collect()}
    assert set(found) == {1, 5, 6}
    assert [found[i].is_secret for i in (1, 5, 6)] == [True, False, False]
    assert found[1].word_no == 3
    texts = {r.doc_id: r.text for r in secret_forest.masked(docs, forest).collect()}
    assert texts[1] == 'see token = "[SECRET]" here'
    assert {i: texts[i] for i in (2, 3, 4, 5, 6)} == dict(rows[1:])


def test_secrets_of_every_form_are_masked(spark):
    key, b64 = hashlib.sha1(b"q").hexdigest(), base64.b64encode(hashlib.sha256(b"q").digest())
    b64 = b64.decode().rstrip("=")
    jwt = f"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx{key[:12]}.{b64.replace('/', '_').replace('+', '-')}"
    lines = "\n".join([b64[:32] * 2, b64[8:40] * 2, b64[:20] + "=="])
    secret = {
        "bare": f"api_key={key[:20]}", "upper": f"AWS_SECRET_ACCESS_KEY={b64[:40]}",
        "url": f"see https://example.com/cb?a=1&access_token={key}&page=2 now",
        "quoted": f'the token = "{key}" here', "json": f'{{"auth_token": "{key}"}}',
        "spaced": f"export password: {b64[:12]}", "short": f"password={b64[3:13]}",
        "symbols": f"DB_PASSWORD={b64[:5]}!{b64[7:11]}1", "prefixed": f"use sk-{key} now",
        "github": f"the ghp_{key[:36]}", "dotted": f"Authorization: Bearer {jwt}",
        "dotted_value": f"access_token={jwt}",
        "block": f"a\n-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----\nb",
    }
    plain = {
        "commit": f"commit {key} merged", "sum": f"checksum: {key}", "path": f"src=\"/{key}.png",
        "words": "password = example-version-2024-sample", "prose": "the secret: another thing",
        "date": "date=2024-01-12T00", "image": f"https://example.com/{key}.js",
    }
    rows = list({**secret, **plain}.items())
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    forest = secret_forest.train(secret_forest.labelled_findings(spark))
    texts = {r.doc_id: r.text for r in secret_forest.masked(docs, forest).collect()}
    assert {k: texts[k] for k in plain} == plain
    assert texts["block"] == ("a\n-----BEGIN RSA PRIVATE KEY-----\n[SECRET]\n"
                              "-----END RSA PRIVATE KEY-----\nb")
    assert texts["url"] == "see https://example.com/cb?a=1&access_token=[SECRET]&page=2 now"
    assert texts["bare"] == "api_key=[SECRET]"
    assert texts["dotted_value"] == "access_token=[SECRET]"
    assert [k for k in secret if "[SECRET]" not in texts[k] or key[:9] in texts[k]
            or b64[3:10] in texts[k]] == []


def test_labelled_findings_come_from_the_scanner(spark):
    lines = secret_forest.labelled_lines(spark, 300)
    found = secret_forest.labelled_findings(spark, 300)
    assert found.filter("contains(candidate, '_KEY=') OR candidate = ''").count() == 0
    unquoted = found.filter("label = 1 AND before RLIKE '[a-zA-Z]=$'")
    assert unquoted.count() > 50
    # Every line with a secret gives a finding with that label.
    assert found.filter("label = 1").count() >= lines.filter("label = 1").count()


# -- language model --------------------------------------------------------------------

def test_elias_fano_equals_sorted_search():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 5), (900, 1 << 50), (1000, 2000), (3000, 10 ** 6)):
        values = np.unique(rng.integers(0, universe, n))
        found = elias_fano.EliasFano(elias_fano.encode(values, universe, "x"), "x")
        assert (found.access(np.arange(len(values))) == values.astype(np.uint64)).all()
        asked = np.concatenate([values, values + 1, rng.integers(0, universe, 500)])
        place, equal = found.successor(asked)
        assert (place == np.searchsorted(values, asked)).all()
        assert (equal == np.isin(asked, values)).all()


def test_ngram_scores_near_exact_model(spark, docs):
    texts = docs.filter("doc_id IS NOT NULL")
    model = ngram_trie.train(spark, texts)
    tokens = [[*WORD.findall(_lower(r.text or "")), "</s>"] for r in texts.collect()]
    one = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip(["<s>", *t], t, strict=False))
    three = Counter(p for t in tokens for p in zip(["<s>", *t], t, t[1:], strict=False))
    n, size, cut = sum(one.values()), len(one), ngram_trie.DISCOUNT
    assert (model.tokens, model.words, model.texts) == (n, size, len(tokens))
    one["<s>"] = len(tokens)

    def interpolated(grams, contexts, lower):
        taken: Counter = Counter()
        kept = {g: c for g, c in grams.items() if c > 1}
        for g, c in kept.items():
            taken[g[:-1]] += (c - cut) / contexts(g[:-1])
        return lambda g: (((kept[g] - cut) / contexts(g[:-1]) if g in kept else 0)
                          + (1 - taken[g[:-1]]) * lower(g[1:]))

    p1 = lambda g: (one[g[0]] + 0.1) / (n + 0.1 * (size + 1))
    p2 = interpolated(two, lambda c: one[c[0]], p1)
    p3 = interpolated(three, lambda c: two[c], p2)
    for row in ngram_trie.scored(docs, model).collect():
        t = [*WORD.findall(_lower(row.text or "")), "</s>"]
        assert row.lm.n_tokens == len(t)
        assert row.lm.n_known == sum(one[w] > 0 for w in t)
        assert row.lm.base_score == pytest.approx(sum(np.log10(p1((w,))) for w in t))
        s = ["<s>", *t]
        exact = sum(np.log10(p3((s[j - 1], s[j], w)) if j and two[s[j - 1], s[j]] > 1
                             else p2((s[j], w))) for j, w in enumerate(t))
        assert abs(row.lm.score - exact) < 0.02 * len(t) + 0.02


def test_ngram_scores_near_unpruned_model(spark, docs):
    """All n-grams are kept: rows learnt from and rows held out, against plain counts."""
    rows = [r for r in docs.collect() if r.doc_id is not None]
    learnt = [r for i, r in enumerate(rows) if i % 3]
    model = ngram_trie.train(spark, spark.createDataFrame(learnt, docs.schema), min_count=1)
    tokens = [[*WORD.findall(_lower(r.text or "")), "</s>"] for r in learnt]
    grams = {k: Counter(g for t in tokens for g in zip(
        *[(["<s>", *t] if k > 1 else t)[i:] for i in range(k)], strict=False)) for k in (1, 2, 3)}
    n, size, cut = sum(grams[1].values()), len(grams[1]), ngram_trie.DISCOUNT
    once = sum(c == 1 for c in grams[3].values())
    assert once > 0  # the rows that a model with min_count=2 loses
    seen = {**grams[1], ("<s>",): len(tokens), **grams[2]}
    taken: Counter = Counter()
    for g, c in [*grams[2].items(), *grams[3].items()]:
        taken[g[:-1]] += c - cut

    def p(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 0.1) / (n + 0.1 * (size + 1))
        context, lower = gram[:-1], p(gram[1:])
        if context not in taken:
            return lower
        return (max(grams[len(gram)][gram] - cut, 0) / seen[context]
                + (1 - taken[context] / seen[context]) * lower)

    memo: dict = {}
    pruned = ngram_trie.train(spark, spark.createDataFrame(learnt, docs.schema), min_count=2)
    other = {r.doc_id: r.lm.score for r in ngram_trie.scored(docs, pruned).collect()}
    moved = 0
    for row in ngram_trie.scored(spark.createDataFrame(rows, docs.schema), model).collect():
        t = ["<s>", *WORD.findall(_lower(row.text or "")), "</s>"]
        exact = 0.0
        for j in range(1, len(t)):
            gram = tuple(t[max(j - 2, 0):j + 1])
            if gram not in memo:
                memo[gram] = np.log10(p(gram))
            exact += memo[gram]
        assert abs(row.lm.score - exact) < 0.02 * len(t)
        moved += abs(other[row.doc_id] - exact) > 0.02 * len(t)
    assert moved > 0


def test_query_keeps_ngrams_seen_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "a b c" if i == 1 else "d e") for i in range(1, 40)],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    train = ngram_trie.train
    monkeypatch.setattr(ngram_trie, "train", lambda *a, **b: made.append(train(*a, **b)) or made[0])
    assert queries.op8_ngram_trie(spark, str(tmp_path)).count() == 39
    assert made[0].min_count == 1


def test_model_of_nothing(spark, empty, docs):
    model = ngram_trie.train(spark, empty)
    assert ngram_trie.scored(docs, model).filter("lm.n_known > 0").count() == 0
