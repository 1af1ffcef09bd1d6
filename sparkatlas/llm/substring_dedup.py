"""Substring dedup: documents parsed into factors relative to an index of the corpus's repeated windows.

The reference is the corpus itself. Its index holds each window of WINDOW words that starts at two places or more, by its
hash, dealt out over blocks (the partitions of a shuffle). It is found in three steps that each shrink what is moved:
the least n-gram of ANCHOR words of every window is its anchor, so that equal windows have equal anchors; anchors are
counted; only windows whose anchor occurs twice (a Bloom filter of bounded size says so, or errs to the safe side) are
counted themselves. Documents are then looked up against every block and parsed greedily: a factor begins at the first
word of an indexed window and grows word by word as long as the next window is indexed too; a factor ends exactly where
the windows at its boundary are no longer found, so each is WINDOW words or longer and is a duplicate span.

Windows are judged on the input: all occurrences go, also the first, also within one document. Words are runs of
characters other than space, tab, LF, VT, FF, CR, unchanged. Null and empty texts have no words. Rows that repeat are
occurrences of each other; bytes that are no UTF-8 stay as they are; an empty table gives an empty result. Hashes have 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W
from sparkatlas.llm.bloom import bloom

WINDOW = 35
ANCHOR = 8
#: Hashes, about, that are counted together before they go to the aggregate.
TOGETHER = 1 << 21


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """The least or greatest (best: np.minimum or np.maximum) of each n neighbours."""
    step = 1
    while 2 * step <= n:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = n - step
    return best(x[: len(x) - rest], x[rest:]) if rest else x


class Windows:
    """The windows of a part: starts (word numbers), their anchors' hashes, and all anchors."""

    def __init__(self, part: W.Part, size: int, anchor: int):
        self.words, self.size = part.hashes(), size
        self.starts = W.starts_of(part, size)
        if not len(self.starts):
            self.keys = self.anchors = np.zeros(0, W.U)
            return
        grams = W.windows(self.words, anchor)
        n = size - anchor + 1  # n-grams of a window
        least = sliding(grams, n, np.minimum)
        self.keys = least[self.starts]
        valid = np.zeros(len(grams) + n - 1, W.U)  # for each window its key, 0 where none begins or it would begin earlier
        valid[self.starts + n - 1] = self.keys
        chosen = sliding(valid, n, np.maximum) == grams
        self.anchors = grams[chosen & (grams > 0)]

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """Of the windows at the given word numbers."""
        up, down = W.powers(len(self.words) + 1)
        total = np.zeros(len(self.words) + 1, W.U)
        np.cumsum(self.words * up[:-1], out=total[1:])
        return W.mix((total[which + self.size] - total[which]) * down[which])


def tallied(hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, c = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def counted(docs: DataFrame, hashes) -> DataFrame:
    """h: the hashes that hashes(part) gives twice or more over all texts; a written table."""

    def run(batches):
        got, n = [], 0
        for batch in batches:
            for part in W.parts(batch.column(0)):
                got.append(hashes(part))
                n += len(got[-1])
                if n >= TOGETHER:
                    yield tallied(got)
                    got, n = [], 0
        if n:
            yield tallied(got)

    rows = docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    return storage.written(rows.select("h"), "windows")


def repeated(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """doc_id, of (a hash of the text) and starts of the repeated windows, from rows of doc_id and text; a written table."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("text")
    anchors = counted(texts, lambda part: Windows(part, size, anchor).anchors)
    shared = sc.broadcast(bloom(anchors, "h"))

    def likely(part, known):
        own = Windows(part, size, anchor)
        starts = own.starts[known.value.has(own.keys)]
        return starts, own.hashes(starts) if len(starts) else np.zeros(0, W.U)

    index = counted(texts, lambda part: likely(part, shared)[1])
    known = sc.broadcast(bloom(index, "h"))

    def places(batches):
        for batch in batches:
            for part in W.parts(batch.column(2)):
                starts, h = likely(part, shared)
                good = known.value.has(h)
                starts, h = starts[good], h[good]
                if len(h):
                    doc = part.doc[starts]
                    row = pa.array(doc + part.row)
                    at = (starts - part.at[doc]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h.view(np.int64)), pa.array(at)], ["doc_id", "of", "h", "at"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("of"), "text")
    shape = rows.drop("text").withColumns({"h": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}).schema
    found = rows.mapInArrow(places, shape).join(index, "h").groupBy("doc_id", "of").agg(F.collect_set("at").alias("starts"))

    def factors(batches):
        for batch in batches:
            out = []
            for starts in batch.column(2):
                x = np.sort(np.array(starts.as_py(), np.int64))
                first = np.append(True, np.diff(x) > 1)
                last = np.append(np.diff(x) > 1, True)
                out.append(np.stack([x[first], x[last] + size], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "of", "factors"])

    shape = found.select("doc_id", "of").withColumn("factors", F.lit("x").cast("binary")).schema
    return storage.written(found.mapInArrow(factors, shape), "factors")


def unchecked(texts: list[bytes]) -> pa.Array:
    """An Arrow column of strings of these bytes, UTF-8 or not."""
    got = pa.array(texts, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(got), got.buffers())


def dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space) and spans (first and last word, exclusive, of each factor)."""
    storage.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    found = repeated(docs, size, anchor)
    bytes_of = found.agg(F.coalesce(F.sum(F.length("factors") + 48), F.lit(0))).collect()[0][0]
    found = found.select(F.col("doc_id").alias("id"), F.col("of").alias("text_of"), "factors")
    found = F.broadcast(found) if bytes_of <= storage.BROADCAST_BYTES else found
    rows = docs.withColumn("of", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("text_of")), "left").select("doc_id", "text", "factors")

    def run(batches):
        for batch in batches:
            n, gone, kept, spans = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [], []
            for part in W.parts(batch.column(1)):
                n[part.row : part.row + part.n] = np.diff(part.at)
                raw = part.raw.tobytes()
                for k in range(part.n):
                    row = part.row + k
                    own = batch.column(2)[row].as_py()
                    stay = np.ones(n[row], bool)
                    own = [] if own is None else np.frombuffer(own, "<i8").reshape(-1, 2).tolist()
                    end, merged = 0, []
                    for a, b in own:
                        stay[a:b] = False
                        if merged and a <= end:
                            merged[-1]["last"] = b
                        else:
                            merged.append({"first": a, "last": b})
                        end = b
                    gone[row] = n[row] - stay.sum()
                    which = np.flatnonzero(stay) + part.at[k]
                    kept.append(b" ".join([raw[a:b] for a, b in zip(part.first[which].tolist(), part.last[which].tolist(), strict=True)]))
                    spans.append(merged)
            arrow = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(gone), unchecked(kept), pa.array(spans, arrow)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    zero = F.lit(0).cast("long")
    shape = docs.select("doc_id").withColumns({"n_words": zero, "n_removed": zero, "kept": F.lit("x"), "spans": F.lit(None).cast("array<struct<first:long,last:long>>")}).schema
    return rows.mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) h FROM d, unnest(range(1, len(w) - {WINDOW} + 2)) t(i)),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) > 1 AS dup FROM p),
g AS (SELECT DISTINCT doc_id, i + j pos FROM f, unnest(range(0, {WINDOW})) u(j) WHERE dup),
x AS (SELECT d.doc_id, t.pos, w[t.pos] word FROM d, unnest(range(1, len(w) + 1)) t(pos)),
k AS (SELECT x.doc_id, count(g.pos) gone, string_agg(word, ' ' ORDER BY x.pos) FILTER (g.pos IS NULL) kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(gone, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
