"""Lookups and searches: fuzzy symbols, dense, sparse and fused top-k, reranking, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T

RRF_K = 60


def limit_of(limit: int | None) -> int:
    return 10 if not limit or limit < 1 else min(limit, 25)


def only(df: DataFrame, **equal) -> DataFrame:
    """Rows with the given values; None, '' and 'any' filter nothing."""
    for name, value in equal.items():
        if value not in (None, "", "any"):
            df = df.where(F.col(name) == value)
    return df


def ranking(score: Column) -> Column:
    """A score to rank by: its last digits, which depend on the order of a sum, don't count."""
    return F.round(score, 12)


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def fuzzy(symbols: DataFrame, query: str, limit: int = 5, threshold: float = T.TRIGRAM_THRESHOLD, names: tuple[str, ...] = ("qualified", "name"), ident: str = "id") -> DataFrame:
    """Symbols whose qualified or short name is like the query; the first name ranks."""
    q = T.trigrams(F.lit(query))
    scored = [T.similarity(T.trigrams(F.col(n)), q) for n in names]
    near = scored[0] >= threshold
    for s in scored[1:]:
        near = near | (s >= threshold)
    got = symbols.where(near).withColumn("similarity", scored[0]).orderBy(F.desc("similarity"), names[0], ident).limit(limit)
    return got.withColumn("similarity", F.round("similarity", 6))


def dense_topk(vectors: DataFrame, query: list[float], limit: int = 10, ident: str = "vec_id", vector: str = "embedding", **filters) -> DataFrame:
    """The nearest vectors by cosine; filters come first."""
    score = ranking(T.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return rounded(only(vectors, **filters).withColumn("score", score).orderBy(F.desc("score"), ident).limit(limit))


def terms(docs: DataFrame, ident: str, text: str, only: list[str] = ()) -> DataFrame:
    """id, term, tf: a sparse vector for each text; of some terms only, if given."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w.isin(*only) if only else w != "")
    return docs.select(F.col(ident), F.explode(words).alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"))


def sparse_topk(docs: DataFrame, query: list[str], limit: int = 10, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts by the sum of tf * idf over the query's terms; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = docs.agg(F.count("*").alias("n"))
    hits = terms(docs, ident, text, query)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(n))  # one row
    scored = scored.withColumn("w", F.col("tf") * F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return rounded(scored.groupBy(ident).agg(ranking(F.sum("w")).alias("score")).orderBy(F.desc("score"), ident).limit(limit))


def ranked(hits: DataFrame, ident: str, name: str) -> DataFrame:
    """Ranks of a top-k result (a handful of rows)."""
    return hits.select(F.col(ident), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), ident)).alias(name))


def rrf(arms: list[DataFrame], limit: int, ident: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of top-k results."""
    every = None
    for arm in arms:
        part = ranked(arm, ident, "rank").withColumn("part", 1 / (k + F.col("rank")))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy(ident).agg(ranking(F.sum("part")).alias("score")).orderBy(F.desc("score"), ident).limit(limit)
    return rounded(out)


def rerank(hits: DataFrame, score: Column, top: int, ident: str) -> DataFrame:
    """Hits in the order of another score; top of 0 or less, or too large, keeps all."""
    out = hits.withColumn("score", score).orderBy(F.desc("score"), ident)
    return out if top <= 0 else out.limit(top)


def evaluate(ranks: DataFrame, query: str = "query_id", rank: str = "rank", relevant: str = "relevant", top: int = 5) -> DataFrame:
    """Precision and reciprocal rank of each query's first `top` hits."""
    own = ranks.where(F.col(rank) <= top)
    return own.groupBy(query).agg(
        F.round(F.avg(F.col(relevant).cast("int")), 6).alias("precision"),
        F.round(F.coalesce(1 / F.min(F.when(F.col(relevant), F.col(rank))), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def mean_evaluation(each: DataFrame) -> DataFrame:
    """The means over all queries of evaluate()."""
    return each.agg(F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("reciprocal_rank"), 6).alias("mean_reciprocal_rank"), F.count("*").alias("queries"))


def hashed_vectors(texts: DataFrame, text: str, dimensions: int = 64, out: str = "vector") -> DataFrame:
    """texts with unit vectors of hashed words: a stand-in for a model, the same at any time; null texts have null vectors."""
    import xxhash

    @F.pandas_udf("array<float>")
    def embed(column: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            v = np.zeros(dimensions, np.float32)
            for w in s.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dimensions] += 1 if h >> 63 else -1
            return v / max(float(np.sqrt((v * v).sum())), 1e-9)

        return column.map(one, na_action=None)

    return texts.withColumn(out, embed(F.col(text)))


def batches(items: DataFrame, key: str, order: str, tokens: str, most_items: int = 128, most_tokens: int = 100_000) -> DataFrame:
    """items with batch, packed greedily in their order within each key: at most so many items and tokens, a larger item alone.

    The rows of a key pass one after another through a state of three numbers; keys are spread.
    """
    names = items.columns

    def run(frames):
        key_now, batch, n, total = object(), 0, 0, 0
        for frame in frames:
            out = []
            for k, size in zip(frame[key], frame[tokens], strict=True):
                if k != key_now:
                    key_now, batch, n, total = k, 0, 0, 0
                if n and (n == most_items or total + size > most_tokens):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + size
                out.append(batch)
            yield frame.assign(batch=out)[[*names, "batch"]]

    return items.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, items.withColumn("batch", F.lit(0).cast("long")).schema)
