"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts become words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. The automaton holds all
substrings of the items of one block (BLOCK_WORDS words of items at most, which bounds what is broadcast); more items make
more blocks, run one after another over the same rows. A text is streamed through it with the longest match tracked;
only runs whose neighbouring words are neighbours in some item are walked at all, which loses no match.

A window is WINDOW consecutive words of an item, or the whole of a shorter item. Null texts and items have no words; an
item that occurs twice under one id counts once; items of null id hit as others do, and are one null at the end of item_ids; repeated rows are judged alike; empty tables give no hits;
bytes that are no UTF-8 are replaced in a text that is cut; columns named as the results are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W

WINDOW = 8
BLOCK_WORDS = 200_000
#: In the pipeline, a document of which this share is hit goes; of the others the hit spans go.
COVERAGE = 0.5


class Automaton:
    """All substrings of the items: (item id, word hashes)."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for c in ws.tolist():
                last = self._extend(last, c)
        found: dict[tuple[int, int], set[str]] = {}
        for name, ws in items:
            ws = ws.tolist()
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1) if n else ():
                v = 0
                for c in ws[i : i + n]:
                    v = self.next[v][c]
                found.setdefault((v, n), set()).add(name)
        marks: dict[int, list] = {}
        for (v, n), names in found.items():
            marks.setdefault(v, []).append((n, tuple(sorted(names, key=nulls_last))))
        #: for each state, the windows that end with it: its own and those of the states that it links to
        self.marks: list[tuple] = [()] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.marks[self.link[v]] if v else ()
            self.marks[v] = (*marks[v], *up) if v in marks else up
        arrays = [ws for _, ws in items if len(ws)]
        self.least = min((min(window, len(ws)) for ws in arrays), default=0)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, W.U), *arrays]))
        self.pairs = np.unique(np.concatenate([np.zeros(0, W.U), *(W.windows(ws, 2) for ws in arrays)]))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, ws: list[int]) -> Iterator[tuple[int, int, tuple]]:
        """(first, last exclusive, item ids) of each window that occurs in ws."""
        nxt, link, length, marks = self.next, self.link, self.length, self.marks
        v = matched = 0
        for i, c in enumerate(ws):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
                for n, names in marks[v]:
                    if n <= matched:
                        yield i + 1 - n, i + 1, names

    def runs(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """The runs of words that could hold a window."""
        if not self.least or not len(hashes):
            return
        known = held(self.vocabulary, hashes)
        joined = np.zeros(len(hashes) + 1, bool)  # with the word before
        joined[1:-1] = (doc[1:] == doc[:-1]) & known[1:] & known[:-1]
        at = np.flatnonzero(joined[1:-1]) + 1
        joined[at] = held(self.pairs, W.windows_at(hashes, at - 1, 2))
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        for k in np.flatnonzero(last - first >= self.least):
            yield int(first[k]), int(last[k])


def nulls_last(ident: str | None) -> tuple[bool, str]:
    return ident is None, ident or ""


def held(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def blocks(items: DataFrame, ident: str, text: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items as words, streamed from the table, at most about `most` words at a time; one longer item is a block of its own."""
    block, n = [], 0
    for row in items.select(F.col(ident).cast("string"), F.col(text)).toLocalIterator():
        part = next(W.parts(pa.array([row[1]], pa.string()), W.ALNUM, lower=True))
        if block and n + len(part.first) > most:
            yield block
            block, n = [], 0
        block.append((row[0], part.hashes()))
        n += len(part.first)
    yield block


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings, then null) and, if clean, cleaned (the text without the hit spans)."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    added = ["n_words", "n_hit", "item_ids", "cleaned"]
    docs = docs.drop(*added)
    outer, text = docs.columns, f"c{docs.columns.index(text)}"
    docs = docs.toDF(*(f"c{k}" for k in range(len(outer))))  # no name of the caller's meets one of ours
    own = len(docs.columns)
    shape = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "item_ids": F.array(F.lit("x"), F.lit(None)), "_hits": F.lit("x").cast("binary"), "cleaned": F.lit("x")}).schema
    for field in shape.fields[own:]:
        field.nullable = True
    place = docs.columns.index(text)
    for block, final in blocks_ahead(blocks(items, item, item_text, most)):
        sent = spark.sparkContext.broadcast(Automaton(block))

        def run(batches, sent=sent, final=final):
            auto = sent.value
            for batch in batches:
                n = batch.num_rows
                before = batch.num_columns > own
                hits = batch.column(own + 3).to_pylist() if before else [None] * n
                names = batch.column(own + 2).to_pylist() if before else [()] * n
                counts, hit_counts, names, cleaned = np.zeros(n, np.int64), np.zeros(n, np.int64), [set(x) for x in names], [None] * n
                for part in W.parts(batch.column(place), W.ALNUM, lower=True):
                    counts[part.row : part.row + part.n] = np.diff(part.at)
                    hashes = part.hashes()
                    mark = np.zeros(len(hashes) + 1, np.int32)
                    for a, b in auto.runs(hashes, part.doc):
                        for x, y, which in auto.stream(hashes[a:b].tolist()):
                            mark[a + x] += 1
                            mark[a + y] -= 1
                            names[part.row + int(part.doc[a])].update(which)
                    hit = np.cumsum(mark)[:-1] > 0
                    for k in range(part.n):
                        own_hit = hit[part.at[k] : part.at[k + 1]]
                        if hits[part.row + k] is not None:
                            own_hit |= np.unpackbits(np.frombuffer(hits[part.row + k], np.uint8), count=len(own_hit)).astype(bool)
                        hit_counts[part.row + k] = own_hit.sum()
                        if hit_counts[part.row + k] and not final:
                            hits[part.row + k] = np.packbits(own_hit).tobytes()
                        if hit_counts[part.row + k] and final and clean:
                            cleaned[part.row + k] = without(batch.column(place)[part.row + k].as_buffer().to_pybytes(), part, k, own_hit)
                cols = [batch.column(i) for i in range(own)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), pa.array(hit_counts), pa.array([sorted(x, key=nulls_last) for x in names], pa.list_(pa.string())), pa.array([None] * n if final else hits, pa.binary()), pa.array(cleaned, pa.string())], shape.names)

        docs = docs.mapInArrow(run, shape)
        docs = docs if final else storage.written(docs, "decontaminate")
    # a text without hits stays as it is
    docs = docs.withColumn("cleaned", F.coalesce("cleaned", F.col(text))).drop("_hits", *([] if clean else ["cleaned"]))
    return docs.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(outer)], *docs.columns[own:])


def blocks_ahead(every: Iterator) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the last."""
    now = next(every)
    for later in every:
        yield now, False
        now = later
    yield now, True


def without(raw: bytes, part: W.Part, k: int, hit: np.ndarray) -> str:
    """The text without what lies between the first and the last word of each run of hit words."""
    out, at = [], 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    base = part.at[k]
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[at : part.first[base + a] - part.ends[k]])
        at = part.last[base + b - 1] - part.ends[k]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop documents that are mostly benchmark text and cut the hit spans out of the others."""
    got = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    kept = got.where(F.col("n_hit") < COVERAGE * F.greatest("n_words", F.lit(1)))
    return kept.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(8, len(w)) n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') win FROM b, unnest(range(1, len(w) - least(8, len(w)) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT i + j) n_hit FROM m, unnest(range(0, n)) u(j) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
