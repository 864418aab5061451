"""The registered queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import (
    byte_bpe,
    jaccard_join,
    lexical_search,
    line_cleaning,
    ngram_trie,
    packing,
    quality_rules,
    secret_forest,
    slot_sharding,
    token_counts,
    vector_search,
    warc,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.scored(docs, model).select(
        "doc_id", quality_rules.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_cleaning.clean_lines(docs, clean=False).select("doc_id", "lines.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard_join.join_documents(_table(spark, sf_dir, "documents"), count_links=False)
            .select("doc_id", "n_shingles", "component_id"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(_table(spark, sf_dir, "pages"))

    def number(column: str) -> Column:
        return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1)

    return records.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"),
        # A response is measured by what was read, a revisit has its headers only.
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        "payload_digest", "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", vector_search.scaled(F.col("embedding"), 64).alias("vector"))
    return vector_search.nearest(rows, F.col("vec_id") % 20 == 0, 20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_forest.train(secret_forest.labelled_findings(spark))
    return secret_forest.findings(_table(spark, sf_dir, "documents"), forest)


def op6_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_sharding.shard(_table(spark, sf_dir, "documents"))


def op8_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ngram_trie.held_out(F.col("doc_id"))
    model = ngram_trie.train(spark, docs.filter(~out), min_count=1)
    return ngram_trie.scored(docs, model).select(
        "doc_id", out.alias("held_out"), "lm.n_tokens", "lm.n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), " ").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("tokens.bytes", 256).alias("decoded_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "size.*")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.index(_table(spark, sf_dir, "documents")),
                                 _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_warc, op2_vector_search, op3_packing, op4_secret_forest, op5_quality_rules,
        op6_slot_sharding, op7_line_cleaning, op8_ngram_trie, op9_byte_bpe,
        op10_jaccard_join, op11_token_counts, op12_whitening, op13_lexical_search)}


def oracles() -> dict[str, str]:
    """SQL with the same rows, for the queries SQL can express."""
    return {
        "op2_vector_search": _SEARCH,
        "op13_lexical_search": _LEXICAL,
    }


_SEARCH = """
WITH part AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
component AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM part),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM component q JOIN component c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_LEXICAL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT row_number() OVER () AS row_id, doc_id, terms, len(terms) AS n
  FROM lowered WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM numbered),
posting AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest(terms) AS term FROM numbered) GROUP BY 1, 2),
frequency AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM frequency, corpus),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
repeats AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
normed AS (
  SELECT row_id, doc_id, 75 + (25 * n * docs) // tokens AS m FROM numbered, corpus),
scored AS (
  SELECT item_id, row_id, any_value(doc_id) AS doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM repeats JOIN posting USING (term) JOIN weight USING (term) JOIN normed USING (row_id)
  GROUP BY 1, 2),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
