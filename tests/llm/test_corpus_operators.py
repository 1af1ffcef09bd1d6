"""Line dedup, exact top-k and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkatlas.llm import line_dedup, lm_scoring, topk

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_brute(rows, least, keep_first):
    sites, first = defaultdict(set), {}
    for ident, site, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                if site is not None:
                    sites[line].add(site)
                first.setdefault(line, (ident, i))
    out = {}
    for ident, _, text in rows:
        if text is None:
            out[ident] = (0, 0, None)
            continue
        ls = text.split("\n")
        kept = [x for i, x in enumerate(ls) if len(sites[x]) < least or keep_first and first[x] == (ident, i)]
        out[ident] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("least, keep_first", [(2, True), (3, False)])
def test_line_dedup(spark, least, keep_first):
    rows = [(i, f"s{i % 4}" if i % 5 else None, "\n".join([f"own {i}", "shared", "", " ", "shared", f"pair {i // 3}", "end" * (i % 2)])) for i in range(40)]
    rows += [(100, "s1", None), (101, "s2", ""), (102, None, "shared"), (103, "s1", "x\n" * 3000 + "shared"), (104, "s2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n_lines", "2 as _gone2")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup(docs, min_sites=least, keep_first=keep_first).collect()}
    assert got == lines_brute(rows, least, keep_first)
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    assert line_dedup.dedup(docs.unionByName(docs), min_sites=least).where("doc_id = 3").select("n_removed").distinct().count() == 1


def test_topk(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2020, [None] * 64), (2040, [float("nan")] * 64), (2060, [float("inf")] + [0.0] * 63), (2080, [0.5]), (2100, []), (None, [0.1] * 64)]
    rows += [(1000, rows[0][1])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in own if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:20]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for block in (topk.BLOCK, 7):
        got = defaultdict(list)
        for r in topk.search(data, lambda i: i % 20 == 0, block=block).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.search(data.limit(0), lambda i: i % 20 == 0).count() == 0
    few = topk.search(data.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]


def test_topk_with_small_leaves(monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "LEAF", 4)
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (500, 6))
    trees = [topk.BallTree(np.arange(a, a + 100), v[a : a + 100]) for a in range(0, 500, 100)]
    best = topk.Best(np.arange(0, 500, 9), v[::9], 5)
    for tree in trees:
        best.search(tree)
    for k, q in enumerate(range(0, 500, 9)):
        s = v @ v[q]
        want = sorted((-s[i], i) for i in range(500) if i != q)[:5]
        assert list(zip((-best.score[best.q == k]).tolist(), best.vec[best.q == k].tolist())) == want


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 50])
def test_lm_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the The zzzzqq zzzzqq"), (9003, "the The zzzzqq zzzzqq")], docs.schema)).withColumn("score", docs.doc_id)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    docs = docs.cache()
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)) + [None]) for r in docs.collect()]
    count = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    train = docs.where(~docs.doc_id.isin([i for i, _ in rows if held(i)]))
    got = lm_scoring.score(docs, lm_scoring.fit(train)).collect()
    assert len(got) == len(rows)
    want = {i: (len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in rows}
    total = base = 0
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
        assert r.score < 0
        total, base = total + r.score, base + r.base_score
    assert total > 1.05 * base  # no more than 5 % below the exact unigram scores


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs.limit(0))).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[2].n_tokens) == (3, 0, 0, 1)
    assert math.isclose(got[1].base_score, 0.0, abs_tol=1e-12)


def test_lm_filter_has_no_ceiling(spark, monkeypatch):
    """A word's score doesn't depend on how many others there are: none is left out when bits or chunks are many."""
    monkeypatch.setattr(lm_scoring, "MOST_BITS", 1 << 12, raising=False)  # the ceiling of old
    monkeypatch.setattr(lm_scoring, "OCCURRENCES", 100, raising=False)
    train = spark.createDataFrame([(i, " ".join(f"w{i * 50 + j}" for j in range(50))) for i in range(100)], "doc_id long, text string")
    train = train.unionByName(train).repartition(3)
    model = lm_scoring.fit(train)
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(5000)] + [(-1, "unseen"), (-1, "other")], "doc_id long, text string")
    scores = {i: s for i, s in lm_scoring.score(docs, model).select("doc_id", "score").collect()}
    assert len(scores) == 5001
    assert min(s for i, s in scores.items() if i >= 0) > scores[-1] + 1


def test_lm_counts_all_pairs(spark):
    """Rare words too have pairs: seen ten times together, they score better in their order than in the other."""
    train = spark.createDataFrame([(i, " ".join(["the"] * 3000)) for i in range(20)] + [(i, "left right and right") for i in range(10)], "doc_id long, text string")
    docs = spark.createDataFrame([(0, "left right"), (1, "right left"), (2, "unseen right"), (3, "right")], "doc_id long, text string")
    scores = dict(lm_scoring.score(docs, lm_scoring.fit(train)).select("doc_id", "score").collect())
    assert scores[0] > scores[1] + 2
    total = sum(float(lm_scoring.middle(lm_scoring.level(np.array([c])))[0]) for c in (60000, 10, 20, 10, 30))
    assert math.isclose(scores[2] - scores[3], math.log10(0.1 / (total + 0.1 * 6)), rel_tol=1e-6)  # after an unseen word, as a first word


def test_lm_scores_by_brute_force(spark, monkeypatch):
    """The whole query, with a filter that hardly errs; words sum to 1, words after another nearly."""
    exact = lm_scoring.query(spark, SMALL).select("doc_id", "score").collect()
    monkeypatch.setattr(lm_scoring, "BITS_PER_ENTRY", 96)
    got = {r.doc_id: r for r in lm_scoring.query(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)) + [None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    train = [ws for i, ws in rows.items() if not held[i]]
    word = Counter(w for ws in train for w in ws)
    pair = Counter(p for ws in train for p in zip(ws, ws[1:]))

    def as_level(c):
        q = math.floor(2 * math.log2(c))
        inside = [x for x in range(math.ceil(2 ** (q / 2)), math.ceil(2 ** ((q + 1) / 2)))]
        return math.sqrt(inside[0] * inside[-1])

    word, pair = ({k: as_level(c) for k, c in x.items()} for x in (word, pair))
    below = sum(word.values()) + 0.1 * (len(word) + 1)

    def prob(w, before=None):
        p = (word.get(w, 0) + 0.1) / below
        if before in word and before is not None:
            p = 0.5 * p + 0.5 * min(pair.get((before, w), 0) / word[before], 1)
        return p

    assert math.isclose(sum(prob(w) for w in [*word, "never seen"]), 1)
    often = sorted((w for w in word if w is not None), key=lambda w: (-word[w], w))[:40]
    sums = [sum(prob(w, before) for w in [*word, "never seen"]) for before in often]
    assert 0.88 < min(sums) and max(sums) < 1.12 and abs(sum(sums) / len(sums) - 1) < 0.03
    want = {i: sum(math.log10(prob(w, b)) for w, b in zip(ws, [None, *ws])) for i, ws in rows.items()}
    assert got.keys() == want.keys() and all(got[i].held_out == held[i] for i in rows)
    assert sum(math.isclose(got[i].score, want[i], rel_tol=1e-9) for i in rows) >= 0.98 * len(rows)
    assert all(math.isclose(got[i].score, want[i], rel_tol=0.01) for i in rows)
    assert abs(sum(s for _, s in exact) / sum(want.values()) - 1) < 0.02  # by the filter as it is
