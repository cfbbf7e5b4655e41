"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import _base as B


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import secret_scan

    return secret_scan.report(secret_scan.scan(B.read(B.ship(spark), sf_dir, "documents")))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import ngram_lm

    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return ngram_lm.score(B.read(B.ship(spark), sf_dir, "documents"), remainder == 0)


def op3_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import topk

    return topk.search(B.read(B.ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import license_scan

    return license_scan.report(license_scan.scan(B.read(B.ship(spark), sf_dir, "documents")))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import bpe_trie

    docs = B.read(B.ship(spark), sf_dir, "documents")
    return bpe_trie.digests(bpe_trie.encode_decode(docs, tokenizer_path("word_bpe_49k.json")))


def op6_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import language_id

    docs = B.read(B.ship(spark), sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    filters = language_id.fit(docs, remainder != 2)
    docs = docs.select("doc_id", remainder.eqNullSafe(2).alias("held_out"), "text")
    return language_id.predict(docs, filters, ["doc_id", "held_out"])


def op7_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import substring_dedup

    return substring_dedup.report(substring_dedup.dedup(B.read(B.ship(spark), sf_dir, "documents"), window=35))


def op8_jaccard_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import near_dup

    return near_dup.report(near_dup.join(B.read(B.ship(spark), sf_dir, "documents"), threshold=0.8, words=5))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import decontaminate

    return decontaminate.report(B.read(spark, sf_dir, "documents"), B.read(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import token_store

    docs = B.read(B.ship(spark), sf_dir, "documents")
    return token_store.roundtrip(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '{_WORDS}') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, p.k, item FROM p JOIN g USING (k, gram)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP3 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.own <> q.own),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j
      WHERE g.j IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_topk_histogram": _OP3,
    "op7_substring_sketch": _OP7,
    "op9_decontaminate": _OP9,
}
