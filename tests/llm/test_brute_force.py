"""Archives, shards, statistics and refusals against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardflow.llm import quality_rules, slot_sharding, vector_search, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- archives --------------------------------------------------------------------------

def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    htmls = [None, "", "<p>é中</p>", "x" * 300_000, "a\r\n\r\nb", "\x00\x01"] + [
        f"page {rng.randrange(8)}" for _ in range(60)]
    rows = [(i, f"http://h/{i}\r\nX: y", h, 7) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` int").repartition(3)
    got = {r.record_id: r for r in warc.archived(pages, path=str(tmp_path / "a")).collect()}
    last = {}
    for i, h in enumerate(htmls):
        last[h or ""] = i
    assert len(got) == len(htmls)
    for i, h in enumerate(htmls):
        row, first = got[f"<urn:page:{i}>"], last[h or ""]
        assert row.payload_digest == _digest(h) and row.payload_bytes == len((h or "").encode())
        assert row.record_type == ("response" if i == first else "revisit")
        assert row.refers_to == (None if i == first else f"<urn:page:{first}>")
        assert (bytes(row.payload) if row.payload is not None else None) == (
            (h or "").encode() if i == first else None)
    assert warc.archived(pages.limit(0), path=str(tmp_path / "b")).count() == 0


def _record(i, payload, kind="response"):
    return warc.record({"payload": payload, "record_type": kind, "record_id": f"<{i}>",
                        "warc_date": "2024-01-01T00:00:00Z", "target_uri": None, "refers_to": None})


def test_a_payload_that_was_changed_is_refused(spark, tmp_path):
    raw = _record(1, b"some payload").replace(b"some", b"SOME")
    (tmp_path / "x.warc.gz").write_bytes(warc.member(raw))
    warc.register(spark)
    source = spark.read.format("warc").option("path", str(tmp_path))
    with pytest.raises(Exception, match="does not have its digest"):
        source.load().collect()
    assert source.option("payload", "false").load().count() == 1


def test_foreign_members_are_not_held_if_unwanted(spark, tmp_path):
    class Source:
        def __init__(self, data):
            self.data, self.at = data, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            part = self.data[self.at:self.at + n]
            self.at += len(part)
            return part

    big = _record(1, b"0123456789" * 1_000_000)
    data = gzip.compress(big) + gzip.compress(_record(2, b"two"))
    headers, block, end = warc._inflated(Source(data), 0, lambda h: False)
    assert headers["warc-record-id"] == "<1>" and block == b"" and end == len(gzip.compress(big))
    headers, block, _ = warc._inflated(Source(data), end, lambda h: True)
    assert headers["warc-record-id"] == "<2>" and b"two" in block
    headers, block, _ = warc._inflated(Source(data), 0, lambda h: True)
    assert block == big.partition(b"\r\n\r\n")[2]


# -- shards ----------------------------------------------------------------------------

def test_shards_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "é中"] + ["w" * rng.randrange(2000) for _ in range(900)] + ["copy"] * 300
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = slot_sharding.shard(docs, shards=7, slots=512).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    load = Counter()
    for k in range(7):
        own = sorted(r.slot for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
        load[k] = sum(r["size"] for r in got if r["shard"] == k)
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 8 for t in texts)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    place = {}  # a slot's rows lie in one shard
    for r in got:
        assert place.setdefault(r.virtual_slot, r["shard"]) == r["shard"]


# -- statistics ------------------------------------------------------------------------

def _plain(text):
    data, size = text.encode(), max(len(text.encode()), 1)
    words = WORD.findall(text)
    n = max(len(words), 1)
    lines = data.count(b"\n") + 1
    top = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    parts = [x for x in re.findall(rb"[^\n]*\n|[^\n]+", data)]
    ascii_letters = [re.sub(r"[^A-Za-z]", "", w) for w in words]
    symbols = set("#*$%&<>@^~`_+=\\{}[]/")
    return {
        "log_words": math.log1p(len(words)),
        "word_length": len(re.sub(rb"[\x20\x09-\x0D]", b"", data)) / n,
        "log_lines": math.log1p(lines), "words_per_line": len(words) / lines,
        "upper": sum(65 <= b <= 90 for b in data) / size,
        "digit": sum(48 <= b <= 57 for b in data) / size,
        "symbol": sum(chr(b) in symbols for b in data) / size,
        "exclaim": data.count(b"!") / size, "pipe": data.count(b"|") / size,
        "stop": data.count(b".") / size, "comma": data.count(b",") / size,
        "other_punctuation": sum(b in b";:'\"-()?" for b in data) / size,
        "not_ascii": sum(b >= 128 for b in data) / size,
        "blank": sum(b in b" \t\n\x0b\x0c\r" for b in data) / size,
        "distinct_words": len(top) / n,
        "repeated_windows": sum(c for c in windows.values() if c > 1) / n,
        "repeated_lines": (len(parts) - len(set(parts))) / lines,
        "upper_words": sum(bool(a) and a == a.upper() for a in ascii_letters) / n,
        "symbol_words": sum(bool(symbols & set(w)) for w in words) / n,
        "top_word": max(top.values(), default=0) / n,
        "adjacent_equal": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    }


def test_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "A a A a A a", "one\none\n\none", "é ÉÉ |! #x"]
    texts += ["".join(rng.choices("abC é.,!|#\n ", k=rng.randint(1, 200))) for _ in range(150)]
    texts.append("word, " * 50_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for row in quality_rules.with_statistics(docs).collect():
        want = _plain(row.text or "")
        for name, value in row.statistics.asDict().items():
            assert value == pytest.approx(want[name], abs=1e-12), (name, (row.text or "")[:80])


# -- refusals ---------------------------------------------------------------------------

def test_components_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan")]), (3, [0.5, -0.01]), (4, None)],
                               "vec_id long, embedding array<float>")
    got = df.select("vec_id", vector_search.scaled(df.embedding, 64).alias("v")).collect()
    assert {r.vec_id: r.v for r in got} == {1: None, 2: None, 3: [32, -1], 4: None}
    large = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        large.select(vector_search.scaled(large.embedding, 64)).collect()
    assert np.isfinite(1e30)
