"""Language identification with bit-sliced Bloom filters of byte n-grams.

Training counts the n-grams of a bounded sample of labelled rows and keeps, for each language, those that are typical of
it. One table of PLACES words holds the filters of all languages side by side: bit l of a word belongs to language l, so
that the AND of an n-gram's PROBES words gives every language whose filter holds it. A text's hits for each language,
less the hits that the filter's fill would give by chance, decide.

Nulls and texts without a letter: `und`, score 0. Very long texts are read whole, in slices. Ties go to the language that
sorts first. Rows that repeat are predicted alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W

#: Sampled labelled rows of each language, about; the only bounded sample here.
SAMPLE_ROWS = 4000
#: An n-gram counts for a language if it makes up this share of the language's n-grams of its length ...
LEAST_SHARE = 1e-5
#: ... and this part of the largest share that any language gives it.
TYPICAL = 0.25
SIZES = (2, 3, 4, 5)
PROBES = 3
#: Bytes of text that are looked at together; each takes some 100 bytes of arrays. A longer text is looked at alone.
SLICE = 1 << 18
PLACES = 1 << 20
#: A corrected share of hits below this means that no learned language fits.
ACCEPT = 0.1

LETTER = np.full(256, 32, np.uint8)
LETTER[65:91] = np.arange(97, 123)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def bucket(of: Column, n: int) -> Column:
    """crc32 of an id as text, mod n."""
    return F.pmod(F.crc32(F.coalesce(of.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def grams(part: W.Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams of letters and word ends, and the text each is from."""
    lens = np.diff(part.ends)
    x = np.full(len(part.raw) + 2 * part.n, 32, np.uint8)  # a space at both ends of each text
    doc = np.repeat(np.arange(part.n), lens + 2)
    inside = np.ones(len(x), bool)
    first = np.cumsum(lens + 2) - lens - 2
    inside[first] = inside[first + lens + 1] = False
    x[inside] = LETTER[part.raw]
    blank = x == 32
    key = x.astype(W.U)
    code = key.copy()
    for n in range(2, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            return
        code = (code[:m] << W.U(8)) | key[n - 1 :]
        blanks = blank[:m].astype(np.int8) if n == 2 else blanks[:m]
        blanks = blanks + blank[n - 1 :]
        if n in SIZES:
            good = (blanks < n) & (doc[:m] == doc[n - 1 :])
            if n > 2:  # at most the ends may be blank
                inner = np.zeros(m, bool)
                for j in range(1, n - 1):
                    inner |= blank[j : m + j]
                good &= ~inner
            yield n, code[good] | W.U(n << 56), doc[:m][good]


def places(codes: np.ndarray) -> list[np.ndarray]:
    h = W.mix(codes)
    a, b = h & W.U(0xFFFFFFFF), (h >> W.U(32)) | W.U(1)
    return [((a + W.U(j) * b) & W.U(PLACES - 1)).astype(np.int64) for j in range(PROBES)]


def sampled(docs: DataFrame, text: str, lang: str, ident: str, rows: int) -> tuple[DataFrame, list[str]]:
    """About `rows` rows of each language, drawn by a hash of the id; and the languages."""
    n = docs.groupBy(F.col(lang).alias("l")).count().collect()
    rates = {r["l"]: int(min(1.0, rows / r["count"]) * (1 << 30)) for r in n}
    if not rates:
        return docs.limit(0), []
    rate = F.broadcast(docs.sparkSession.createDataFrame(list(rates.items()), "_l string, _rate long"))
    drawn = F.pmod(F.xxhash64(F.col(ident)), F.lit(1 << 30)) < F.col("_rate")
    return docs.join(rate, F.col(lang) == F.col("_l")).where(drawn).drop("_l", "_rate"), sorted(rates)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict:
    """Learn from the rows of docs whose lang isn't null: {languages, filters, fill}. Its size depends on docs by the number of languages only."""
    docs = docs.select(ident, text, lang).where(F.col(lang).isNotNull())
    sample, languages = sampled(docs, text, lang, ident, rows)
    if not languages:
        return {"languages": [], "filters": np.zeros((PLACES, 1), W.U), "fill": np.zeros(0)}
    number = {x: k for k, x in enumerate(languages)}

    def counted(batches):
        for batch in batches:
            of = np.array([number[x] for x in batch.column(1).to_pylist()])
            for first, texts in lowered(batch.column(0)):
                for part in W.parts(texts, None):
                    for _, codes, doc in grams(part):
                        at = of[first + part.row :][doc]
                        for k in np.unique(at):
                            code, c = np.unique(codes[at == k], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.view(np.int64)), pa.array(c)], ["l", "code", "c"])

    storage.bounded_batches(docs.sparkSession)
    got = sample.select(text, lang).mapInArrow(counted, "l int, code long, c long").groupBy("l", "code").agg(F.sum("c").alias("c"))
    size = F.shiftrightunsigned(F.col("code"), 56)
    got = got.where("c > 1").withColumn("size", size)
    total = got.groupBy("l", "size").agg(F.sum("c").alias("total"))  # a row for each language and size
    got = got.join(F.broadcast(total), ["l", "size"]).withColumn("share", F.col("c") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    typical = got.groupBy("code").agg(F.max("share").alias("most"), F.collect_list(F.struct("share", "l")).alias("each"))  # a list has a place for each language
    of = F.transform(F.filter("each", lambda x: x["share"] >= TYPICAL * F.col("most")), lambda x: x["l"])
    filters = np.zeros((PLACES, (len(languages) + 63) // 64), W.U)
    for batch in typical.select("code", of.alias("of")).toArrow().to_batches():
        which, column = np.diff(batch.column(1).offsets.to_numpy()), batch.column(1).flatten().to_numpy()
        codes, bit = np.repeat(batch.column(0).to_numpy().view(W.U), which), np.left_shift(W.U(1), (column % 64).astype(W.U))
        for p in places(codes):
            np.bitwise_or.at(filters, (p, column // 64), bit)
    fill = np.array([((filters[:, k // 64] >> W.U(k % 64)) & W.U(1)).mean() for k in range(len(languages))])
    return {"languages": languages, "filters": filters, "fill": fill**PROBES}


def lowered(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts of an Arrow column in lower case, about SLICE bytes at a time, each with the number of its first; null is empty."""
    for part in W.parts(column, None, size=SLICE):
        own = column.slice(part.row, part.n).fill_null("")
        try:
            yield part.row, pc.utf8_lower(own)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            yield part.row, pa.array([x.as_py().decode("utf-8", "replace").lower() for x in own.cast(pa.binary())], pa.string())


def votes(model: dict, column) -> np.ndarray:
    """For each text of an Arrow column, each language's share of its n-grams, corrected for false positives."""
    langs, filters = model["languages"], model["filters"]
    out = np.zeros((len(column), len(langs)))
    for part in W.parts(column, None):
        hits, n = np.zeros((part.n, len(langs))), np.zeros(part.n)
        for _, codes, doc in grams(part):
            at = places(codes)
            mask = filters[at[0]]
            for p in at[1:]:
                mask &= filters[p]
            n += np.bincount(doc, minlength=part.n)
            for k in range(len(langs)):
                has = (mask[:, k // 64] >> W.U(k % 64)) & W.U(1)
                hits[:, k] += np.bincount(doc, has, part.n)
        share = hits / np.maximum(n, 1)[:, None]
        out[part.row : part.row + part.n] = np.clip((share - model["fill"]) / (1 - model["fill"]), 0, 1)
    return out


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)
    place, names = docs.columns.index(text), [*docs.columns, "lang_pred", "score"]

    def run(batches):
        model = sent.value
        langs = np.array([*model["languages"], "und"], object)
        for batch in batches:
            pred, score = [], []
            for _, texts in lowered(batch.column(place)):
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) & bool(model["languages"])
                v = votes(model, texts) if model["languages"] else np.zeros((len(texts), 1))
                best = v.argmax(1)
                score.append(np.where(letters, v[np.arange(len(v)), best], 0.0))
                pred.append(langs[np.where(letters, best, len(langs) - 1)])
            if pred:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score), pa.float64())], names)

    shape = docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = bucket(F.col("doc_id"), 4) != 2
    model = fit(docs.where(learn))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop the documents in which no learned language is found."""
    model = fit(docs)
    kept = predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= ACCEPT))
    return kept.select(*docs.columns)
