"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node that is left without a match hands over the number of pieces that its
text begins with (popped, worked out beforehand) and goes on at the node of the rest, so that a word of n bytes takes on
the order of n steps and no piece is ever built.

A word is a run of characters other than space, tab, LF, VT, FF, CR, with A-Z lower-cased; its last byte is a symbol of
its own. A word that no pieces make up counts as one token. Null and empty texts have none. Rows that repeat count alike.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W

#: Word lengths that a Python worker remembers at most.
CACHE = 1 << 20
END = "</w>"


def printable() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files: printable ones for themselves, then from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> list[tuple[int, ...]]:
    """The tokens of a JSON vocabulary with word ends: symbols 0-255 are bytes, a word's last byte is 256 more."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte, out = printable(), []
    for token in vocabulary:
        body = token.removesuffix(END)
        if body and all(c in byte for c in body):
            symbols = [byte[c] for c in body]
            if body != token:
                symbols[-1] += 256
            out.append(tuple(symbols))
    return out


class Automaton:
    def __init__(self, tokens: list[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for t in tokens:
            v = 0
            for c in t:
                if c not in child[v]:
                    child[v][c] = len(child)
                    child.append({})
                    token.append(False)
                v = child[v][c]
            token[v] = bool(v)
        self.child = child
        #: the node of the rest, -1 for none, and the pieces popped on the way
        self.fail, self.popped = [-1] * len(child), [0] * len(child)
        layer = [0]
        while layer:
            below = []
            for u in layer:
                for c, v in child[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in child[z]:
                        z, n = self.fail[z], n + self.popped[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = child[z][c], n
            layer = below

    def length(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word; 1 if it can't be made of pieces."""
        child, fail, popped = self.child, self.fail, self.popped
        v = n = 0
        for c in (*word[:-1], word[-1] + 256):
            while c not in child[v]:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = child[v][c]
        while v:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


def count(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_words and n_tokens."""
    storage.bounded_batches(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    docs = docs.drop("n_words", "n_tokens")
    place, names = docs.columns.index(text), [*docs.columns, "n_words", "n_tokens"]

    def run(batches):
        automaton, known = Automaton(sent.value), {}
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for part in W.parts(batch.column(place), lower=True):
                hashes, first, back = np.unique(part.hashes(), return_index=True, return_inverse=True)
                lens = np.zeros(len(hashes), np.int64)
                if len(known) > CACHE:
                    known.clear()
                for k, (h, i) in enumerate(zip(hashes.tolist(), first.tolist(), strict=True)):
                    n = known.get(h)
                    if n is None:
                        n = known[h] = automaton.length(part.raw[part.first[i] : part.last[i]].tobytes())
                    lens[k] = n
                words[part.row : part.row + part.n] = np.diff(part.at)
                tokens[part.row : part.row + part.n] = np.bincount(part.doc, lens[back], part.n)
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words), pa.array(tokens)], names)

    return docs.mapInArrow(run, docs.withColumns({"n_words": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count(docs).select("doc_id", "n_words", "n_tokens")
