"""The Jaccard join and substring dedup against brute force; the pipeline as a whole."""

import random
import re
import time

import numpy as np
import pytest

from sparkatlas.llm import components, jaccard_join, storage, substring_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components_brute(rows, n, percent):
    sets = []
    for ident, text in rows:
        ws = words((text or "").translate(LOW))
        sets.append((ident, {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()))
    group = {i: i for i, _ in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    sizes = {}
    for i, a in sets:
        sizes[i] = len(a)
    return {(i, len(a), root(i)) for i, a in sets}


def near_copies(rng, count):
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(count):
        ws = list(base)
        for _ in range(rng.randrange(9)):
            ws[rng.randrange(len(ws))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("small, crowd, cell", [(48, 48, 500_000), (3, 5, 2_000), (0, 1, 300)])
def test_jaccard_components(spark, monkeypatch, small, crowd, cell):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    if cell < 500_000:
        for name, value in (("BLOCK", 8), ("BLOCKS", 3), ("LEAF", 4), ("STAR", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    if cell == 2_000:
        monkeypatch.setattr(components, "FEW", 0)
    rng = random.Random(small)
    texts = near_copies(rng, 40) + near_copies(rng, 12) + ["a b c", "A B c", "a b", "", None, " \n", "x"] * 2
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    texts += [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(25)]  # a chain
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, n int")
    got = {tuple(r) for r in jaccard_join.join(docs).collect()}
    assert got == components_brute(rows, 4, 85)


@pytest.mark.parametrize("leaf, same", [(4, True), (4, False), (64, True)])
def test_partners_in_a_cell_equal_brute_force(monkeypatch, leaf, same):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool if k % 5 == 0 else pool[k % 7 * 200 : k % 7 * 200 + 90], 86, False)) for k in range(120)]
    n, component, side = np.array([len(x) for x in sets]), rng.integers(0, 40, 120), rng.integers(0, 2, 120)
    bits = np.stack([jaccard_join.parities(x) for x in sets]).view(np.uint64)
    got = jaccard_join.Cell(bits, n, component, 85).partners(side, same)
    near = lambda i, j: component[i] != component[j] and (same or side[i] != side[j]) and 185 * np.bitwise_count(bits[i] ^ bits[j]).sum() <= 15 * (n[i] + n[j])
    assert got.tolist() == [any(near(i, j) for j in range(120) if j != i) for i in range(120)] and 0 < got.sum() < 120


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (jaccard_join.parities(v).view(np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_one_row_of_an_id_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, ""), (None, "z z"), (None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, least string")
    got = jaccard_join.stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 3]
    assert jaccard_join.stage(spark, docs.limit(0), "").columns == docs.columns


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (2, "f g h i j"), (None, "a b c d e"), (4, "z"), (4, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join(docs).collect()))
    assert [c for d, c in got if d] == [1, 1, 1, 4, 4]
    assert jaccard_join.join(docs.limit(0)).count() == 0


def removed_brute(rows, size):
    seen = {}
    for k, (_, text) in enumerate(rows):
        ws = words(text)
        for i in range(len(ws) - size + 1):
            seen.setdefault(tuple(ws[i : i + size]), []).append((k, i))
    gone = {(k, i + j) for places in seen.values() if len(places) > 1 for k, i in places for j in range(size)}
    return sorted((ident, len(words(t)), sum((k, i) in gone for i in range(len(words(t)))), " ".join(w for i, w in enumerate(words(t)) if (k, i) not in gone)) for k, (ident, t) in enumerate(rows))


@pytest.mark.parametrize("size, anchor", [(35, 8), (5, 3), (3, 3)])
def test_substring_dedup(spark, size, anchor):
    rng = random.Random(size)
    passages = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.randrange(size - 2, 3 * size))) for _ in range(6)]
    texts = ["same " * (3 * size), "ab " * (size - 1), None, "", " "]
    for _ in range(60):
        texts.append(" ".join(rng.choice(passages) if rng.random() < 0.3 else f"u{rng.randrange(300)} \n" for _ in range(rng.randrange(40))))
    texts += [texts[7], " ".join(passages)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, at int")
    got = sorted(tuple(r)[:4] for r in substring_dedup.dedup(docs, size=size, anchor=anchor).collect())
    assert got == removed_brute(rows, size)
    for r in substring_dedup.dedup(docs, size=size, anchor=anchor).collect():
        assert sum(s["last"] - s["first"] for s in r.spans) == r.n_removed
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_dedup_of_repeated_rows(spark):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "0 1 2"), (None, text)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect()) == [(3, 0), (40, 40), (40, 40), (40, 40)]


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = got.collect()
    assert set(docs.columns) < set(got.columns) and 0 < len(rows) < docs.count()
    assert len({r.doc_id for r in rows}) == len(rows) and all(len(r.ids) == r.n_tokens for r in rows)
    left = components_brute([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sum(c != i for i, _, c in left) <= 2  # decontamination may make two alike


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    storage.written(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_crowded_ngrams_are_put_last_without_a_join_of_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 1)
    made, plain = [], jaccard_join.Sets.__init__
    monkeypatch.setattr(jaccard_join.Sets, "__init__", lambda self, *rest: made.append(1) or plain(self, *rest))
    rows = list(enumerate([*near_copies(random.Random(3), 12), "a b c d e f", "a b c d e f"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.join(docs).collect()} == components_brute(rows, 4, 85)
    assert len(made) == 1  # of possible partners only


def test_long_unrelated_sets_never_reach_the_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "CROWD", 10**9)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    seen = []
    plain = jaccard_join.cells
    monkeypatch.setattr(jaccard_join, "cells", lambda sets, members, *rest: seen.append({r.n for r in members.collect()}) or plain(sets, members, *rest))
    rng = random.Random(5)
    common = " ".join(f"c{k}" for k in range(150))
    rows = [(k, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000 + k))) for k in range(12)]
    rows.append((12, rows[3][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard_join.join(docs).collect()}
    assert got == components_brute(rows, 4, 85) and (12, 2151, 3) in got
    assert all(n in (2150, 2151) for ns in seen for n in ns)
