"""Bytes that are no UTF-8, names that clash with the operators' own, long texts, and spans in great number."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from sparkatlas.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, secrets, substring_dedup, token_counts, topk, words


def bad_bytes(spark):
    docs = spark.createDataFrame([(1, bytearray(b"alpha beta gam\xffma delta epsilon zeta eta theta iota kappa")), (2, bytearray(b"alpha beta"))], "doc_id long, raw binary")
    return docs.select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))


def test_bytes_that_are_no_utf8(spark):
    docs = bad_bytes(spark)
    items = spark.createDataFrame([(1, "delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.scan(docs, items, clean=True).orderBy("doc_id").collect()] == [7, 0]
    assert [r.n_words for r in substring_dedup.dedup(docs).orderBy("doc_id").collect()] == [10, 2]
    assert [r.n_words for r in token_counts.count(docs).orderBy("doc_id").collect()] == [10, 2]
    assert language_id.predict(docs, language_id.fit(docs)).count() == 2
    assert secrets.scan(docs).count() == bpe.encode(docs).count() == jaccard_join.join(docs).count() == line_dedup.dedup(docs).count() == 2
    assert lm_scoring.score(docs, lm_scoring.fit(docs)).count() == 2


@pytest.mark.parametrize("names", [("_of", "_gone", "_id", "_text"), ("_row", "_rest", "_g", "_k"), ("_hits", "c0", "h", "n"), ("key", "row", "tag", "doc_id2")])
def test_clashing_names_stay(spark, names):
    docs = spark.createDataFrame([(1, "a b c\nd e f g h", "s", "en", 5, 6, 7, 8)], ["doc_id", "text", "source", "lang", *names])
    items = spark.createDataFrame([(1, "d e f g h")], "item_id long, text string")
    for got in (line_dedup.dedup(docs), decontaminate.scan(docs, items), bpe.encode(docs), token_counts.count(docs), secrets.scan(docs), language_id.predict(docs, language_id.fit(docs)), lm_scoring.score(docs, lm_scoring.fit(docs))):
        row = got.collect()[0]
        assert [row[x] for x in names] == [5, 6, 7, 8]


def test_texts_longer_than_a_slice(spark):
    text = "lorem ipsum dolor " * (words.SLICE // 15)
    docs = spark.createDataFrame([(1, text, "en"), (2, "lorem ipsum", "en")], "doc_id long, text string, lang string")
    n = len(text.split())
    assert [r.n_words for r in token_counts.count(docs).orderBy("doc_id").collect()] == [n, 2]
    assert [r.n_removed for r in substring_dedup.dedup(docs).orderBy("doc_id").collect()] == [n, 0]
    assert [r.n_shingles for r in jaccard_join.join(docs).orderBy("doc_id").collect()] == [3, 1]
    assert [r.n_tokens for r in lm_scoring.score(docs, lm_scoring.fit(docs)).orderBy("doc_id").collect()] == [n + 1, 3]
    row = bpe.encode(docs).orderBy("doc_id").collect()[0]
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert language_id.predict(docs, language_id.fit(docs)).where("lang_pred = 'en'").count() == 2


def test_many_spans_in_one_text():
    text = b" ".join(b"%032x Zq%sxWv9KpLm3TyRb7NcHd" % (k * 7919, b"%06d" % k) for k in range(20_000))
    raw = words.np.frombuffer(text, words.np.uint8)
    part = words.Part(0, raw, words.np.array([0, len(raw)]), None, False)
    began = time.time()
    got = secrets.spans_of(text, secrets.long_runs(part, secrets.HEX, 16)[0], secrets.long_runs(part, secrets.TOKEN_CHARS, 20)[0], False, False)
    assert sum(k == 2 for _, k, _ in got) == 20_000 and time.time() - began < 30


def test_components_too_large_for_whole_scores(spark):
    docs = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(docs, lambda i: i == 0).collect()
