"""Language-model scores from a log-frequency Bloom filter of n-gram counts, beside exact unigram scores.

Counts of all training words, and of all pairs of adjacent words (the end token too), are summed over the corpus. A count c has level 1 + floor(2 log2 c); its n-gram enters the filter
once for each level up to its own. The filter is a table of chunks that grows with the n-grams, by their hash: each chunk
has BITS_PER_ENTRY bits for each of its entries, and the chunks are as many as the tokens ask for. It is never gathered:
texts are scored in groups, whose distinct n-grams are dealt out to the chunks and come back as levels. A level is read
back by probing 1, 2, ... until a probe fails.

P(word | before) = (1 - PAIRS) P(word) + PAIRS count(before word) / count(before), or P(word) for a first word or where
the word before is unseen; P(word) = (count + ADD) / (S + ADD (V + 1)). All counts are those of the filter's levels, and S is
their sum over the V training words, so that P(word) sums to 1 over these and one unseen word. P(word | before) would too by
exact counts; levels put each count off by a factor of 2^(1/4) at most, so that it sums to 0.85 to 1.21 at PAIRS = 0.5. The
filter's false positives come on top of both.

The exact base score takes the counts of the HEAD most frequent words from a broadcast table; all other words of a text
join the counts by a shuffle. Null texts are empty: they have the end token only. Rows that repeat are scored one by one;
with no training row every count is 0; other columns stay, whatever their names, but for those of the results. Very long texts are read whole, in slices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W

ADD = 0.1
#: The share of pairs, chosen on held-out rows of sf0.1 among 0.1, 0.5 and six weights that grow with count(before).
PAIRS = 0.5
HEAD = 1 << 20
#: Hashes, about, that are counted together before they go to the aggregate.
TOGETHER = 1 << 21
#: The fewest chunks of the filter, and the occurrences of n-grams that a chunk has at most, about.
CHUNKS, OCCURRENCES = 64, 1 << 22
#: Bits of an n-gram's hash that are kept within a chunk: of OCCURRENCES n-grams, another one of 2^18 has the same.
KEY = 40
#: Bytes of text whose distinct n-grams are counted, and looked up, together; a longer text is a group of its own.
GROUP = 4 * W.SLICE
#: Shuffle files go when the table they were for is written, and tables are packed tightly.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
BITS_PER_ENTRY = 12
PROBES = 6
#: The hash of the end token: words of one or more bytes have others, but for chance.
END = int(W.mix(np.array([0xE0D], W.U))[0])
#: The most levels that are probed.
LEVELS = 128


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.int64)


def middle(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric mean of its least and its highest; 0 for level 0."""
    low = np.ceil(2.0 ** ((q - 1) / 2))
    return np.where(q > 0, np.sqrt(low * np.maximum(np.ceil(2.0 ** (q / 2)) - 1, low)), 0.0)


def tokens(part: W.Part) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and end tokens, and their texts."""
    at = part.at[1:]
    hashes = np.insert(part.hashes(), at, W.U(END))
    return hashes, np.insert(part.doc, at, np.arange(part.n))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of a column, a slice at a time to spare memory."""
    got = [(h, doc + part.row) for part in W.parts(texts, lower=True) for h, doc in [tokens(part)]]
    return np.concatenate([h for h, _ in got]), np.concatenate([doc for _, doc in got])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * W.U(W.BASE) + b)


def tallied(hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, c = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def counted(rows: DataFrame, hashes) -> DataFrame:
    """h and c: how often each hash that hashes(part) gives occurs."""

    def run(batches):
        got, n = [], 0
        for batch in batches:
            for part in W.parts(batch.column(0), lower=True):
                got.append(hashes(part))
                n += len(got[-1])
                if n >= TOGETHER:
                    yield tallied(got)
                    got, n = [], 0
        if n:
            yield tallied(got)

    return rows.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def at_most(counts: DataFrame, most: int) -> int:
    """The least count such that the rows of this count and more are no more than `most`."""
    total, cut = 0, 1
    for c, n in counts.groupBy("c").agg(F.count("*")).orderBy(F.desc("c")).toLocalIterator():
        total += n
        if total > most:
            return c + 1
        cut = c
    return min(cut, 1)


def levelled(counts: DataFrame) -> float:
    """The sum of the counts that the levels of all rows stand for."""

    def run(batches):
        for batch in batches:
            c, n = (x.to_numpy() for x in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([float(middle(level(c)) @ n)])], ["s"])

    return counts.groupBy("c").agg(F.count("*").alias("n")).mapInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).collect()[0][0]


def pulled(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = counts.toArrow()
    h, c = got.column(0).to_numpy().view(W.U), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def ids(h: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of each n-gram, then KEY bits of its hash that tell it from others of its chunk."""
    x = W.mix(h)
    return ((x & W.U(0xFFFFFF)) % W.U(chunks)) << W.U(KEY) | x >> W.U(64 - KEY)


def chunks_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of sorted ids, and where each begins (and the end)."""
    k = (x >> W.U(KEY)).astype(np.int32)
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.append(at, len(k))


def packed(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The keys of sorted ids, for each chunk: differences, their lowest bytes first, as the highest are mostly 0."""
    d = x & W.U((1 << KEY) - 1)
    first = d[at[:-1]]
    d[1:] -= d[:-1].copy()
    d[at[:-1]] = first
    b = d.view(np.uint8).reshape(-1, 8)[:, : KEY // 8]
    return pa.array([b[i:j].T.tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())


def unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for b in held_in(column, np.uint8):
        d = np.zeros((len(b) * 8 // KEY, 8), np.uint8)
        d[:, : KEY // 8] = b.reshape(KEY // 8, -1).T
        out.append(np.cumsum(d.view(W.U).ravel(), dtype=W.U))
    return out


def blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of x between each two of the places at."""
    offsets = pa.array(at * x.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(x).view(np.uint8))])


def held_in(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


class Filter:
    """A chunk of the log-frequency Bloom filter."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8

    @classmethod
    def of(cls, h: np.ndarray, c: np.ndarray, per_entry: int = BITS_PER_ENTRY) -> Filter:
        """Of all n-grams of the chunk, whatever their counts."""
        top = level(c)
        size = max(1, math.ceil(int(top.sum()) * per_entry / 8))
        bits = np.zeros(size * 8, bool)
        for q in range(1, int(top.max(initial=0)) + 1):
            h, top = h[top >= q], top[top >= q]
            a, b = cls.start(h, q)
            for j in range(PROBES):
                bits[cls.place(a, b, j, size * 8)] = True
        return cls(np.packbits(bits, bitorder="little"))

    @staticmethod
    def start(h: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        x = W.mix(h + W.U(q * W.BASE % (1 << 64)))
        return x & W.U(0xFFFFFFFF), (x >> W.U(32)) | W.U(1)

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, j: int, size: int) -> np.ndarray:
        return ((a + W.U(j) * b) % W.U(size)).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        left, size = np.arange(len(h)), len(self.bits) * 8
        for q in range(1, LEVELS):
            a, b = self.start(h[left], q)
            for j in range(PROBES):
                p = self.place(a, b, j, size)
                hit = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                left, a, b = left[hit], a[hit], b[hit]
            if len(left) == 0:
                break
            out[left] = q
        return out


def filtered(train: DataFrame, n: int) -> tuple[DataFrame, int]:
    """k and bits: the filter's chunks, of all words and pairs (a written table); and how many chunks there may be.

    They are as many as 2 n occurrences ask for, so that one is counted and filled in bounded memory at any size.
    """
    chunks, per_entry = max(CHUNKS, math.ceil(2 * n / OCCURRENCES)), BITS_PER_ENTRY

    def count(batches):
        for batch in batches:
            for part in W.parts(batch.column(0), None, size=GROUP):
                x, c = np.unique(ids(grams(batch.column(0).slice(part.row, part.n)), chunks), return_counts=True)
                k, at = chunks_of(x)
                yield pa.RecordBatch.from_arrays([pa.array(k), packed(x, at), blobs(c.astype(np.uint32), at)], ["k", "h", "c"])

    def build(table):
        h, of = np.unique(np.concatenate(unpacked(table.column("h"))), return_inverse=True)
        c = np.bincount(of, np.concatenate(held_in(table.column("c"), np.uint32))).astype(np.int64)
        return pa.table({"k": table.column("k")[:1], "bits": pa.array([Filter.of(h, c, per_entry).bits.tobytes()], pa.binary())})

    rows = train.mapInArrow(count, "k int, h binary, c binary")
    return freed(rows.groupBy("k").applyInArrow(build, "k int, bits binary"), "lm-filter"), chunks


def freed(df: DataFrame, name: str) -> DataFrame:
    """storage.written as WRITING says."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    for k, x in WRITING.items():
        conf.set(k, x)
    try:
        return storage.written(df, name)
    finally:
        for k, x in before.items():
            conf.unset(k) if x is None else conf.set(k, x)


def asked(docs: DataFrame, text: str, chunks: int) -> DataFrame:
    """docs in groups _g, and, in rows of their own, the distinct n-grams of each group by chunk _k (a written table)."""
    place, names = docs.columns.index(text), [*docs.columns, "_g", "_k", "_h"]
    kinds = {"_g": F.lit(None).cast("long"), "_k": F.lit(None).cast("int"), "_h": F.lit(None).cast("binary")}
    shape = docs.withColumns(kinds).schema
    for field in shape.fields:
        field.nullable = True

    def run(batches):
        made = 0
        for batch in batches:
            for part in W.parts(batch.column(place), None, size=GROUP):
                g = (TaskContext.get().partitionId() << 33) + made
                made += 1
                own = batch.slice(part.row, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(part.n, g)), pa.nulls(part.n, pa.int32()), pa.nulls(part.n, pa.binary())], names)
                x = W.distinct(ids(grams(own.column(place)), chunks))
                k, at = chunks_of(x)
                none = [pa.nulls(len(k), f.type) for f in own.schema]
                yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(k), g)), pa.array(k), packed(x, at)], names)

    return freed(docs.mapInArrow(run, shape), "lm-asked")


def looked_up(rows: DataFrame, model: dict) -> DataFrame:
    """_g, _k and _q: the levels of the n-grams of asked(), in their order (a written table).

    A chunk is met by the n-grams of all groups, or, where these are many for the number of chunks, of some at a time.
    """
    groups = rows.select("_g").distinct().count()
    salts = max(1, math.ceil(groups * (GROUP // 4) / model["chunks"] / OCCURRENCES))

    def probe(asks, filters):
        h = unpacked(asks.column("_h"))
        at = np.cumsum([0, *map(len, h)])
        bits = held_in(filters.column("bits"), np.uint8)
        q = Filter(bits[0]).levels(np.concatenate(h)) if bits and h else np.zeros(int(at[-1]), np.uint8)
        return pa.table({"_g": asks.column("_g"), "_k": asks.column("_k"), "_q": blobs(q, at)})

    asks = rows.where(F.col("_k").isNotNull()).select("_g", "_k", "_h", F.pmod("_g", F.lit(salts)).cast("int").alias("_s"))
    filters = model["filter"].select(F.col("k").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"), "bits")
    got = asks.groupBy("_k", "_s").cogroup(filters.groupBy("_k", "_s")).applyInArrow(probe, "_g long, _k int, _q binary")
    return freed(got, "lm-levels")


def fit(train: DataFrame, text: str = "text") -> dict:
    """Counts of all texts of train (a written table), totals, what is broadcast, and the filter (a written table of chunks)."""
    train = train.select(text)
    counts = freed(counted(train, lambda part: tokens(part)[0]), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    cut = at_most(counts, HEAD)
    head = pulled(counts.where(F.col("c") >= cut))
    table, chunks = filtered(train, int(n))
    return {"n": int(n), "v": int(v), "sum": levelled(counts), "head": head, "cut": cut, "counts": counts, "filter": table, "chunks": chunks}


def pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words that have one before them in their text, and the hashes of these pairs."""
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    return at, pair_hash(h[at - 1], h[at])


def grams(texts: pa.Array) -> np.ndarray:
    h, doc = tokens_of(texts)
    return np.concatenate([h, pairs(h, doc)[1]])


def held(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability of the text)."""
    spark = docs.sparkSession
    n, v, chunks = model["n"], model["v"], model["chunks"]
    under, below = n + ADD * (v + 1), model["sum"] + ADD * (v + 1)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*added)
    outer, text = docs.columns, f"c{docs.columns.index(text)}"
    docs = docs.toDF(*(f"c{k}" for k in range(len(outer))))  # no name of the caller's meets one of ours
    sent = spark.sparkContext.broadcast(model["head"])
    names = [c for c in docs.columns if c != text]
    rows = asked(docs, text, chunks)

    def run(own, levels):
        known, often = sent.value
        n_rows = own.num_rows
        h, doc = tokens_of(own.column(text))
        one, back = np.unique(h, return_inverse=True)
        is_head = held(known, one)
        at = np.minimum(np.searchsorted(known, one), max(len(known) - 1, 0))
        c = np.where(is_head, often[at], 0) if len(known) else np.zeros(len(one), np.int64)
        log = np.where(is_head, np.log10((c + ADD) / under), 0.0)

        both, pair = pairs(h, doc)
        _, of = np.unique(np.concatenate([ids(one, chunks), ids(pair, chunks)]), return_inverse=True)  # as in asked()
        seen = middle(np.concatenate(held_in(levels.sort_by("_k").column("_q"), np.uint8)).astype(np.int64))[of]
        word, together = seen[: len(one)], seen[len(one) :]
        prob = ((word + ADD) / below)[back]
        before = word[back[both - 1]]
        both, before, together = (x[before > 0] for x in (both, before, together))
        prob[both] = (1 - PAIRS) * prob[both] + PAIRS * np.minimum(together / before, 1.0)

        tail = np.flatnonzero(~is_head[back])
        order = tail[np.lexsort((back[tail], doc[tail]))]
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (back[order][1:] != back[order][:-1])
        first = np.flatnonzero(new)
        rest_doc, rest_n = doc[order][first], np.diff(np.append(first, len(order)))
        offsets = pa.array(np.searchsorted(rest_doc, np.arange(n_rows + 1)), pa.int32())
        rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(rest_n, pa.int64())], ["h", "n"]))
        sums = [np.bincount(doc, minlength=n_rows), np.bincount(doc, is_head[back], n_rows).astype(np.int64), np.bincount(doc, log[back], n_rows), np.bincount(doc, np.log10(prob), n_rows)]
        return pa.table([*(own.column(x) for x in names), *map(pa.array, sums), rest], [*names, "n_tokens", "n_known", "base_score", "score", "_rest"])

    kinds = {"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0), "_rest": F.lit(None).cast("array<struct<h:long,n:long>>")}
    schema = docs.drop(text).withColumns(kinds).schema
    levels = looked_up(rows, model)
    texts = rows.where(F.col("_k").isNull()).drop("_k", "_h")
    got = texts.groupBy("_g").cogroup(levels.groupBy("_g")).applyInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    got = freed(got, "lm-scored")  # the row numbers are fixed from here on
    storage.dropped(rows, levels)
    rest = got.select("_row", F.explode("_rest").alias("r")).select("_row", "r.h", "r.n")
    rare = model["counts"].where(F.col("c") < model["cut"]) if model["cut"] > 1 else model["counts"].limit(0)
    joined = rest.join(rare, "h", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("_row").agg(F.sum(F.col("n") * F.log10((c + ADD) / F.lit(under))).alias("_base"), F.sum(F.when(c > 0, F.col("n"))).alias("_known"))
    out = got.drop("_rest").join(sums, "_row", "left")
    return out.select(
        *[F.col(c).alias(outer[int(c[1:])]) for c in names], "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    docs = docs.select("doc_id", (part == 0).alias("held_out"), "text")
    return score(docs, fit(docs.where(part != 0)))
