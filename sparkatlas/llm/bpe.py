"""Byte-level BPE encoding and decoding in two tiers.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash; for any other, a heap over its linked
bytes merges the pair of lowest rank first, leftmost of equals. A bounded cache keeps what pre-tokens came to.

Null texts are empty; an empty text has no ids. A pre-token of any length costs n log n. Bytes that are no UTF-8 are
replaced as the tokenizer's own library does with a string. Rows that repeat are encoded alike; columns named as the
results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage

#: Pre-tokens that the cache of a Python worker holds at most.
CACHE = 1 << 19
#: The same in the pipeline, where other stages have left less memory.
STAGE_CACHE = 1 << 17
#: Longer pre-tokens aren't kept in it.
CACHED_CHARS = 64
#: Bytes of text, about, whose results are held at once; a longer text is held alone.
SLICE = 1 << 20


class PerfectHash:
    """A minimal perfect hash of distinct byte strings by hash and displace: len(keys) slots, each used."""

    def __init__(self, keys: list[bytes]):
        n = max(len(keys), 1)
        buckets: list[list[int]] = [[] for _ in range(n)]
        for k, key in enumerate(keys):
            buckets[xxhash.xxh3_64_intdigest(key) % n].append(k)
        self.shift = np.zeros(n, np.int64)
        self.slots = np.full(n, -1, np.int64)
        order = sorted(range(n), key=lambda b: -len(buckets[b]))
        rest = 0
        for b in order:
            own = buckets[b]
            if len(own) <= 1:
                break
            rest += 1
            seed = 1
            while True:
                at = [xxhash.xxh3_64_intdigest(keys[k], seed) % n for k in own]
                if len(set(at)) == len(at) and all(self.slots[x] < 0 for x in at):
                    break
                seed += 1
            self.shift[b] = seed
            self.slots[at] = own
        free = iter(np.flatnonzero(self.slots < 0).tolist())
        for b in order[rest:]:
            if buckets[b]:
                x = next(free)
                self.shift[b] = -x - 1
                self.slots[x] = buckets[b][0]
        self.shift, self.slots = self.shift.tolist(), self.slots.tolist()
        self.keys = keys

    def get(self, key: bytes) -> int | None:
        """The number of a key, None for any other string."""
        n = len(self.slots)
        s = self.shift[xxhash.xxh3_64_intdigest(key) % n]
        k = self.slots[-s - 1 if s < 0 else xxhash.xxh3_64_intdigest(key, s) % n]
        return k if k >= 0 and self.keys[k] == key else None


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece by merges: a heap of pairs over a linked list of its parts."""
    n = len(piece)
    after = list(range(1, n + 2))  # where the part that begins here ends
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = after[i]
        if not alive[i] or mid >= n or after[mid] != end:
            continue
        alive[mid] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """From pre-token to ids; what isn't there is worked out, and kept while there is room."""

    def __init__(self, vocabulary: tuple[list[bytes], list[int], PerfectHash], pattern: str, cache: int = CACHE):
        super().__init__()
        self.room = cache
        tokens, ids, self.whole = vocabulary
        self.ids = ids
        self.ranks = dict(zip(tokens, ids, strict=True))
        self.bytes = dict(zip(ids, tokens, strict=True))
        self.find = regex.compile(pattern).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        k = self.whole.get(raw)
        out = (self.ids[k],) if k is not None else tuple(merged(raw, self.ranks))
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.room:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def load(path: str) -> tuple[list[bytes], list[int], PerfectHash]:
    """A file of base64 tokens and ranks, and the perfect hash of its tokens."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = [base64.b64decode(a) for a, _ in rows]
    return tokens, [int(b) for _, b in rows], PerfectHash(tokens)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    storage.bounded_batches(docs.sparkSession)
    known = default_vocabulary()
    path, pattern = path or known[0], pattern or known[1]
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    place = docs.columns.index(text)
    names = [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    kinds = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit("x"), "decoded_sha256": F.lit("x")} | ({"ids": F.array(F.lit(0).cast("long"))} if keep_ids else {})

    def run(batches):
        encoder = Encoder(sent.value, pattern, cache)
        for batch in chain.from_iterable(map(sliced, batches)):
            count, one, two, every = [], [], [], []
            for x in batch.column(place).cast(pa.binary()):
                ids = encoder.encode((x.as_py() or b"").decode("utf-8", "replace"))
                count.append(len(ids))
                one.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if keep_ids:
                    every.append(ids)
            cols = [batch.column(i) for i in range(batch.num_columns)]
            more = [listed(every)] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), *more], names)

    def sliced(batch):
        lens = pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lens, dtype=np.int64) // SLICE)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)

    return docs.mapInArrow(run, docs.withColumns(kinds).schema)


def listed(every: list[array]) -> pa.Array:
    """The ids of some texts as one Arrow column, without a Python object for each."""
    offsets = np.cumsum([0, *map(len, every)], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in every)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document's text and ids."""
    return encode(docs, keep_ids=True, cache=STAGE_CACHE)
