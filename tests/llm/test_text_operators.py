"""Language ID, token counts, BPE, secrets and decontamination against brute force, with nulls, empty and odd texts."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from sparkatlas.llm import bpe, decontaminate, language_id, secrets, token_counts
from sparkatlas.llm import words as W

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\n\t\x0b x \x0c", "Ünïcode ÀÉ straße 日本語 🙂🙂", "x" * 5000, "don't  stop   \n\n now 12345 !!??", "token = abcdefghijkl" * 3, "AKIA" + "B" * 20, "0123456789abcdef0" * 2, "a\x1cb\x85c d"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)], real.schema)
    return real.unionByName(odd).cache()


def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_parts_cut_words_as_a_pattern_does():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tAé") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, ""]
    for keep, lower, pattern in ((W.SPACE, False, r"[^\x20\x09-\x0D]+"), (W.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for size in (1, 7, 1 << 20):
            got, hashes = [], {}
            for part in W.parts(pa.array(texts, pa.string()), keep, lower, size):
                own = [part.raw[a:b].tobytes().decode() for a, b in zip(part.first, part.last, strict=True)]
                got += [own[part.at[k] : part.at[k + 1]] for k in range(part.n)]
                for w, h in zip(own, part.hashes().tolist(), strict=True):
                    assert hashes.setdefault(w, h) == h
            assert got == [re.findall(pattern, (t or "").translate(LOW) if lower else t or "") for t in texts]
            assert len(set(hashes.values())) == len(hashes)


def test_bpe_equals_the_library_and_comes_back(spark, docs):
    import tiktoken

    tokens, ids, _ = bpe.load(bpe.default_vocabulary()[0])
    own = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=dict(zip(tokens, ids, strict=True)), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs, keep_ids=True).collect()}
    for ident, text in rows(docs):
        want = own.encode_ordinary(text)
        assert got[ident].ids == want and got[ident].n_tokens == len(want)
        assert got[ident].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert got[ident].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(3000))
    assert [table.get(k) for k in keys] == list(range(3000)) and table.get(b"x") is None and bpe.PerfectHash([]).get(b"") is None


def test_token_counts_equal_greedy_matching(spark, docs):
    import public_tokenizers

    vocabulary = set(token_counts.load(public_tokenizers.path("word_bpe_49k.json")))
    longest = max(map(len, vocabulary))

    def greedy(word):
        s = [*word.encode()]
        s[-1] += 256
        i = n = 0
        while i < len(s):
            for j in range(min(len(s), i + longest), i, -1):
                if tuple(s[i:j]) in vocabulary:
                    break
            else:
                return 1
            i, n = j, n + 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count(docs).collect()}
    known = {}
    for ident, text in rows(docs):
        ws = words(text.translate(LOW))
        assert got[ident] == (len(ws), sum(known.setdefault(w, greedy(w)) for w in ws))


def test_failure_links_on_a_small_vocabulary():
    sym = lambda s: tuple([*s.encode()[:-1], s.encode()[-1] + 256])
    auto = token_counts.Automaton([(97,), (97, 98), (97, 98, 99, 100, 101), (98,), (99,), (100,), sym("d"), sym("x")])
    assert auto.length(b"abcd") == 3 and auto.length(b"abcdx") == 4 and auto.length(b"ab") == 1 and auto.length(b"aabd") == 3


def test_base_secrets_equal_the_patterns(spark, docs):
    found = {r.doc_id: r.found for r in secrets.scan(docs).collect()}
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    some = 0
    for ident, text in rows(docs):
        want = sorted((m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(kinds) for m in pattern.finditer(text) if good(m))
        got = [(s["first"], secrets.KINDS.index(s["kind"]), s["last"]) for s in found[ident] or []]
        assert [s for s in got if s[1] < 3] == want
        some += bool(want)
    assert some


def test_random_tokens_are_found_and_words_left():
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = "".join(rng.choice(alphabet) for _ in range(40)).encode()
    raw = b"see " + token + b" and Antidisestablishmentarianisms or 12345678901234567890 xxxxxxxxxxxxxxxxxxxxxxxx"
    tokens = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9+/_=-]{20,}", raw)]
    assert secrets.spans_of(raw, [], tokens, False, False) == [(4, 3, 44)]


def brute_hits(text, items, window=8):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws = re.findall(pattern, (text or "").translate(LOW))
    hit, names = set(), set()
    for name, item in items:
        iw = re.findall(pattern, (item or "").translate(LOW))
        n = min(window, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else ()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in wins:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("most", [decontaminate.BLOCK_WORDS, 40])
def test_decontamination_equals_brute_force(spark, docs, most):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(15).unionByName(spark.createDataFrame([(900, "The of"), (901, None), (902, ""), (903, "don't"), (903, "don't")], "item_id long, text string")).cache()
    pairs = [(r.item_id, r.text) for r in items.collect()]
    got = decontaminate.scan(docs, items, most=most, clean=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, pairs)
        if not r.n_hit:
            assert r.cleaned == r.text


def test_automaton_on_random_words():
    import numpy as np

    rng = random.Random(5)
    items = [(str(k), np.array([rng.randrange(3) for _ in range(rng.randrange(1, 14))], W.U)) for k in range(12)]
    auto = decontaminate.Automaton(items, 4)
    text = [rng.randrange(4) for _ in range(400)]
    want = {(i, i + min(4, len(ws)), name) for name, ws in items for i in range(len(text)) for j in range(len(ws) - min(4, len(ws)) + 1) if text[i : i + min(4, len(ws))] == ws[j : j + min(4, len(ws))].tolist()}
    assert {(a, b, n) for a, b, names in auto.stream(text) for n in names} == want


def test_language_accuracy_on_held_out_rows(spark):
    got = language_id.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, docs):
    model = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    for i, t in enumerate(ODD):
        assert (got[10_000 + i][0] == "und") == (not any(c.isalpha() for c in t or ""))
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_empty_tables_and_clashing_columns(spark, docs):
    empty = docs.limit(0)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert bpe.encode(empty).count() == token_counts.count(empty).count() == secrets.scan(empty).count() == decontaminate.scan(empty, items).count() == 0
    clash = docs.limit(3).selectExpr("*", "1 as n_tokens", "'x' as found", "2 as n_words", "3 as score", "4 as item_ids", "5 as ids")
    assert all(f(clash).count() == 3 for f in (bpe.encode, token_counts.count, secrets.scan))
    assert decontaminate.scan(clash, items.limit(0)).agg({"n_hit": "sum"}).collect()[0][0] == 0


def test_random_tokens_inside_runs():
    """After a name and `=`, and in paths whose symbols are of two alphabets."""
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(rng.choice(alphabet) for _ in range(40)).encode()
    slashed = token[:20] + b"/" + token[20:]
    for before, own, after in ((b"GH_PAT=", token, b""), (b"AWS_ACCESS_KEY=", slashed, b"=="), (b"", token, b"=on"), (b"v1/my-app_one/", token, b"/raw"), (b"my-app_one-", slashed, b"")):
        raw = b"see " + before + own + after + b" end"
        runs = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9+/_=-]{20,}", raw)]
        a = 4 + len(before)
        ((first, kind, last),) = secrets.spans_of(raw, [], runs, False, False)
        assert kind == 3 and first <= a and last >= a + len(own)
        if b"=" in before + after:
            assert (first, last) == (a, a + len(own) + len(after) * (after == b"=="))


@pytest.mark.parametrize("lengths, alphabet, missed", [
    ((20, 32), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 10),
    ((20, 40), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 10),
    ((20, 32), "abcdefghijklmnopqrstuvwxyz0123456789", 10),
    ((32, 40), "0123456789ABCDEF", 10),
    ((20, 40), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 10),
    ((40, 64), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 10),
    ((40, 64), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 10),
    ((32, 40), "abcdefghijklmnopqrstuvwxyz", 20),
    ((32, 40), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20),
])
def test_random_tokens_of_each_encoding(lengths, alphabet, missed):
    rng = random.Random(11)
    for n in lengths:
        tokens = ["".join(rng.choice(alphabet) for _ in range(n)).encode() for _ in range(100)]
        assert sum(secrets.spans_of(t, [], [(0, n)], False, False) != [(0, 3, n)] for t in tokens) <= missed


@pytest.mark.parametrize("most", [decontaminate.BLOCK_WORDS, 3])
def test_benchmark_items_of_null_id_hit(spark, most):
    items = spark.createDataFrame([(None, "alpha beta gamma"), (7, "delta epsilon"), (None, "zeta eta"), (None, "delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma and delta epsilon, zeta eta"), (2, "only alpha beta gamma"), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids, r.cleaned) for r in decontaminate.scan(docs, items, most=most, clean=True).collect()}
    assert got == {1: (7, ["7", None], "so  and "), 2: (3, [None], "only "), 3: (0, [], "none")}


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k * 2 + j, f"word{k} other{k} text{k}", f"l{k:03}") for k in range(300) for j in range(2)], "doc_id long, text string, lang string")
    assert language_id.fit(docs)["languages"] == [f"l{k:03}" for k in range(300)]
