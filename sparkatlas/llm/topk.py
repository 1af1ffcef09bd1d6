"""Exact top-k inner-product search with a ball tree for each shard.

Vectors become whole numbers (floor of SCALE times each component). Shards of SHARD vectors hold a ball tree each; a
query block (BLOCK queries, the bound of what is broadcast) goes through the shards of a partition one after another and
keeps its k-th best score from shard to shard; scores of a first shard, found beforehand, are the start everywhere. In a
tree each query goes first to the child of higher bound (centre's product + norm * radius) and leaves out a node whose
bound is below its k-th score; at equality it goes on, since a smaller id wins a tie. A final merge by query takes the
best k of all partitions.

Vectors that are null or hold nulls or non-finite components, and null ids, take no part; shorter vectors count as if
filled up with zeros. Components beyond LARGEST after scaling are an error, as scores are 64-bit. Rows of one id are one vector (the smallest). With fewer than k others, all are returned.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.llm import storage

SCALE = 64
K = 20
LARGEST = (1 << 26) - 1
SHARD = 8192
LEAF = 128
BLOCK = 1 << 16
FEW = 1 << 20


def whole(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, an array of whole numbers, for the vectors that take part; an id's rows are one."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    # with LARGEST and fewer, a score of 2 ** 10 components stays below 2 ** 63
    whole_of = lambda c: F.when(F.abs(c) * SCALE <= LARGEST, F.floor(c * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for whole scores")).cast("long"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, whole_of)
    return vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(ident).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as float64, if products stay exact in it, else as 64-bit whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    d = int(lens.max(initial=0))
    out = np.zeros((len(lens), d), np.int64)
    out[np.arange(d) < lens[:, None]] = flat
    return out


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # centre, radius, first, last, left, right
        x = vectors.astype(np.float64)
        self._split(x, 0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _split(self, x: np.ndarray, first: int, last: int) -> int:
        own = x[self.order[first:last]]
        centre = own.mean(0) if len(own) else np.zeros(x.shape[1])
        far = np.sqrt(((own - centre) ** 2).sum(1))
        here = len(self.nodes)
        self.nodes.append((centre, far.max(initial=0.0), first, last, -1, -1))
        if last - first > LEAF:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            side = own @ (a - b)
            self.order[first:last] = self.order[first:last][np.argsort(side, kind="stable")]
            mid = (first + last) // 2
            left = self._split(x, first, mid)
            self.nodes[here] = (*self.nodes[here][:4], left, self._split(x, mid, last))
        return here


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.real = queries.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(1))
        self.most = float(np.abs(self.real).max(initial=0.0))
        self.kth = np.full(len(ids), -np.inf) if least is None else least.astype(np.float64)
        #: of each query: how many it has, and their scores and ids, the best first
        self.n = np.zeros(len(ids), np.int64)
        self.scores, self.vecs = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.new: list[tuple] = []
        self.waiting = 0

    def settle(self) -> None:
        """Merge what is new into the best; only the queries that have something new are looked at."""
        if not self.waiting:
            self.new = []
            return
        q, score, vec = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new, self.waiting = [], 0
        touched = np.unique(q)
        had = np.arange(self.k) < self.n[touched][:, None]
        q = np.concatenate([np.repeat(touched, self.n[touched]), q])
        score, vec = np.concatenate([self.scores[touched][had], score]), np.concatenate([self.vecs[touched][had], vec])
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        q, rank = q[keep], rank[keep]
        self.scores[q, rank], self.vecs[q, rank] = score[keep], vec[keep]
        self.n[touched] = np.bincount(np.searchsorted(touched, q), minlength=len(touched))
        full = touched[self.n[touched] == self.k]
        self.kth[full] = np.maximum(self.kth[full], self.scores[full, self.k - 1])

    @property
    def q(self) -> np.ndarray:
        """The query's number, for each of all best."""
        return np.repeat(np.arange(len(self.n)), self.n)

    @property
    def score(self) -> np.ndarray:
        return self.scores[np.arange(self.k) < self.n[:, None]]

    @property
    def vec(self) -> np.ndarray:
        return self.vecs[np.arange(self.k) < self.n[:, None]]

    def search(self, tree: BallTree) -> None:
        d = max(self.queries.shape[1], tree.vectors.shape[1])
        self._exact = float(np.abs(tree.vectors).max(initial=0)) * self.most * d < 2**53
        if d > self.queries.shape[1]:
            more = ((0, 0), (0, d - self.queries.shape[1]))
            self.queries, self.real = np.pad(self.queries, more), np.pad(self.real, more)
        self._d = tree.vectors.shape[1]
        if len(tree.ids):
            self._visit(tree, 0, self._within(tree, 0, np.arange(len(self.ids))))
        self.settle()

    def _bound(self, tree: BallTree, node: int, active: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        product = self.real[active, : self._d] @ centre
        reach = self.norm[active] * radius
        return product + reach + 1e-9 * (np.abs(product) + reach) + 1e-6

    def _within(self, tree: BallTree, node: int, active: np.ndarray) -> np.ndarray:
        return active[self._bound(tree, node, active) >= self.kth[active]]

    def _visit(self, tree: BallTree, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        _, _, first, last, left, right = tree.nodes[node]
        if left < 0:
            own = tree.vectors[first:last]
            if self._exact:
                scores = self.real[active, : self._d] @ own.T.astype(np.float64)
            else:
                scores = self.queries[active, : self._d] @ own.T
            a, b = np.nonzero(scores >= self.kth[active][:, None])
            vec = tree.ids[first:last][b]
            other = vec != self.ids[active[a]]
            self.new.append((active[a][other], scores[a, b][other].astype(np.int64), vec[other]))
            self.waiting += int(other.sum())
            if self.waiting > max(FEW, 4 * self.k * len(self.ids)) or len(self.new) > 64:
                self.settle()
            return
        up = self._bound(tree, left, active) >= self._bound(tree, right, active)
        one, two = active[up], active[~up]
        self._visit(tree, left, self._within(tree, left, one))
        self._visit(tree, right, self._within(tree, right, two))
        self.settle()
        self._visit(tree, right, self._within(tree, right, one))
        self._visit(tree, left, self._within(tree, left, two))


def shards(table: DataFrame) -> DataFrame:
    """One row for each SHARD vectors of a partition: its pickled ball tree."""

    def run(batches):
        ids, vectors, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD - n)
                ids.append(part.column(0).to_numpy())
                vectors.append(matrix(part.column(1)))
                n, at = n + part.num_rows, at + part.num_rows
                if n == SHARD:
                    yield packed(ids, vectors)
                    ids, vectors, n = [], [], 0
        if n:
            yield packed(ids, vectors)

    return table.mapInArrow(run, "n long, tree binary")


def packed(ids: list, vectors: list) -> pa.RecordBatch:
    d = max(v.shape[1] for v in vectors)
    tree = BallTree(np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in vectors]))
    return pa.RecordBatch.from_arrays([pa.array([len(tree.ids)]), pa.array([pickle.dumps(tree, 5)], pa.binary())], ["n", "tree"])


def search(vectors: DataFrame, wanted, k: int = K, ident: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k best others of each vector whose id satisfies wanted(column): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    storage.bounded_batches(spark)
    table = storage.written(whole(vectors, ident, vector), "topk-vectors")
    index = storage.written(shards(table), "topk-shards")
    first = index.orderBy(F.desc("n")).limit(1).collect()
    found = None
    for ids, queries in query_blocks(table.where(wanted(F.col("id"))), block):
        best = Best(ids, queries, k)
        best.search(pickle.loads(first[0]["tree"]))
        sent = spark.sparkContext.broadcast((ids, queries, best.kth))

        def run(batches, sent=sent):
            ids, queries, least = sent.value
            best = Best(ids, queries, k, least)
            for batch in batches:
                for tree in batch.column(0):
                    best.search(pickle.loads(tree.as_py()))
            q, vec, score = best.q, best.vec, best.score
            for at in range(0, len(q), 10_000):
                own = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[own]]), pa.array(vec[own]), pa.array(score[own])], ["query_id", "vec_id", "score"])

        own = index.select("tree").mapInArrow(run, "query_id long, vec_id long, score long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_blocks(table: DataFrame, block: int):
    """Ids and whole vectors of the queries, a block at a time."""
    ids, rows = [], []
    for row in table.toLocalIterator():
        ids.append(row["id"])
        rows.append(row["v"])
        if len(ids) == block:
            yield np.array(ids), matrix(pa.array(rows, pa.list_(pa.int64())))
            ids, rows = [], []
    if ids:
        yield np.array(ids), matrix(pa.array(rows, pa.list_(pa.int64())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)


SQL = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
