"""Secret scans: fixed patterns, and a battery of randomness tests over other long tokens.

Base kinds are assign, access and hex. A further span, kind `random`, is a piece of LEAST_TOKEN or more of a run of
TOKEN_CHARS characters (see pieces) that meets no base span, whose characters look drawn at random from the alphabet of its inferred encoding: a chi-squared test of uniformity and a test
of lag-1 serial correlation don't reject that, and the likelihood ratio of text (its share of each letter, and how often
the class of characters changes) to that alphabet is small. The ratios are p-values; weighted by length, they pass the
Benjamini-Hochberg procedure within a text at rate FDR. Tokens of digits only are never found: text has such numbers.

Null and empty texts have no spans. Long texts are scanned whole. Offsets are code points, end exclusive. Of two readings
of one run that overlap the one of smaller ratio stays. Rows that repeat are scanned alike, an empty table gives an empty
result, and a column named as the result is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 12, 18, 16, 20
FDR = 0.01
#: Significance at which uniformity or independence is rejected.
REJECT = 0.001
#: How often the class of characters changes from one to the next in ordinary long tokens.
TEXT_CHANGES = 0.15


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS, LOWER, UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
HEX = table(DIGITS + b"abcdef")
TOKEN_CHARS = table(DIGITS + LOWER + UPPER + b"+/_=-")
#: Encodings, the narrowest first.
ENCODINGS = (DIGITS, DIGITS + b"abcdef", DIGITS + b"ABCDEF", LOWER, UPPER, UPPER + b"234567", UPPER + DIGITS, LOWER + DIGITS, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + b"+/", UPPER + LOWER + DIGITS + b"-_")
#: Parts of a run without `=`, and the symbols that are in one base64 alphabet but not the other.
PIECE, STANDARD, SAFE = re.compile(rb"[^=]+"), re.compile(rb"[+/]"), re.compile(rb"[-_]")
CLASS = np.full(256, 3, np.int8)
CLASS[list(DIGITS)], CLASS[list(LOWER)], CLASS[list(UPPER)] = 0, 1, 2
#: Letters of text in a hundred, a to z; the log of the share of each character in its class in text, FLOOR of it even.
LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1])
FLOOR = 0.1
TEXT_LOGS = np.full(256, math.log(1 / 4))
TEXT_LOGS[list(DIGITS)] = math.log(1 / 10)
TEXT_LOGS[list(LOWER)] = TEXT_LOGS[list(UPPER)] = np.log((1 - FLOOR) * LETTERS / LETTERS.sum() + FLOOR / 26)


def tail(z: float) -> float:
    """P(normal > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def text_p(token: bytes) -> float | None:
    """The likelihood of the token as text over that as random symbols of its encoding, 1 at most; None if it isn't like random symbols.

    Such a ratio is a p-value for text: by Markov's inequality it is below p with probability p at most.
    """
    body = token.rstrip(b"=")
    x = np.frombuffer(body, np.uint8)
    n = len(x)
    if n < LEAST_TOKEN:
        return None
    for alphabet in ENCODINGS:
        code = np.full(256, -1, np.int64)
        code[list(alphabet)] = np.arange(len(alphabet))
        y = code[x]
        if (y >= 0).all():
            break
    else:
        return None
    a = len(alphabet)
    counts = np.bincount(y, minlength=a)
    chi = float(((counts - n / a) ** 2).sum() * a / n)
    if tail((chi - (a - 1)) / math.sqrt(2 * (a - 1) * (1 - 1 / n))) < REJECT:
        return None
    d = y - y.mean()
    serial = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-12))
    if 2 * tail(abs(serial) * math.sqrt(n)) < REJECT:
        return None
    changes = int((np.diff(CLASS[x]) != 0).sum())
    steps = changes * math.log(TEXT_CHANGES / 3) + (n - 1 - changes) * math.log1p(-TEXT_CHANGES)
    if changes == 0:
        steps = math.log((1 + math.exp(steps)) / 2)  # text often keeps to one class
    text = float(TEXT_LOGS[x].sum()) + steps
    return math.exp(min(0.0, text + n * math.log(a)))


def pieces(raw: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a run to test: between inner `=`; where these mix the symbols of two alphabets, split at those of either."""
    out = set()
    for m in PIECE.finditer(raw, a, b):
        x, y = m.span()
        own = raw[x:y]
        mixed = STANDARD.search(own) and SAFE.search(own)
        for split in (STANDARD, SAFE) if mixed else ():
            at = [x, *(x + k for s in split.finditer(own) for k in s.span()), y]
            out.update(zip(at[::2], at[1::2], strict=True))
        if not mixed:
            out.add((x, y))
    end = len(raw[a:b].rstrip(b"=")) + a
    return sorted((x, b if y == end else y) for x, y in out if y - x >= LEAST_TOKEN)


def discoveries(found: list[tuple[float, int]]) -> list[bool]:
    """Benjamini-Hochberg over (p, length), with weights in proportion to length."""
    if not found:
        return []
    mean = sum(n for _, n in found) / len(found)
    q = [p * mean / n for p, n in found]
    order = sorted(range(len(q)), key=q.__getitem__)
    last = max((r for r, k in enumerate(order, 1) if q[k] <= FDR * r / len(q)), default=0)
    keep = set(order[:last])
    return [k in keep for k in range(len(q))]


def spans_of(raw: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]], assign: bool, access: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    out = [(a, 2, b) for a, b in hexes]
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_VALUE]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST_ACCESS]
    starts = sorted((x, y) for x, _, y in out)
    ends = list(accumulate((y for _, y in starts), max))  # the furthest end of the spans up to each
    starts = [x for x, _ in starts]
    meets = lambda a, b: (k := bisect_left(starts, b)) > 0 and ends[k - 1] > a
    free = [(a, b) for x, y in tokens for a, b in pieces(raw, x, y) if not meets(a, b)]
    scored = [(p, a, b) for a, b in free if (p := text_p(raw[a:b])) is not None]
    good = [x for x, keep in zip(scored, discoveries([(p, b - a) for p, a, b in scored]), strict=True) if keep]
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(good):  # two readings of one run may overlap
        k = bisect_left(taken, (a, b))
        if not (k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b):
            taken.insert(k, (a, b))
    return sorted(out + [(a, 3, b) for a, b in taken])


def long_runs(part: W.Part, keep: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Runs of kept bytes, by text, as byte offsets in it."""
    at = W.Part(0, part.raw, part.ends, keep, False)
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(at.last - at.first >= least):
        d = int(at.doc[k])
        out.setdefault(d, []).append((int(at.first[k] - at.ends[d]), int(at.last[k] - at.ends[d])))
    return out


def texts_with(part: W.Part, lowered: bytes, stem: bytes) -> set[int]:
    out, at = set(), lowered.find(stem)
    while at >= 0:
        d = int(np.searchsorted(part.ends, at, "right")) - 1
        out.add(d)
        at = lowered.find(stem, int(part.ends[d + 1]) - len(stem) + 1 if at < part.ends[d + 1] - len(stem) + 1 else at + 1)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with found: an array of (kind, first, last) spans in code points, by first, then kind as in KINDS."""
    storage.bounded_batches(docs.sparkSession)
    docs = docs.drop("found")
    place, names = docs.columns.index(text), [*docs.columns, "found"]
    kind = "array<struct<kind:string,first:long,last:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for part in W.parts(batch.column(place), None):
                raw = part.raw.tobytes()
                lowered = W.LOWER[part.raw].tobytes()
                assign = set().union(*(texts_with(part, lowered, s) for s in STEMS))
                access = texts_with(part, raw, b"AKIA")
                hexes, tokens = long_runs(part, HEX, LEAST_HEX), long_runs(part, TOKEN_CHARS, LEAST_TOKEN)
                for d in assign | access | hexes.keys() | tokens.keys():
                    own = raw[part.ends[d] : part.ends[d + 1]]
                    got = spans_of(own, hexes.get(d, []), tokens.get(d, []), d in assign, d in access)
                    if got:
                        point = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])
                        found[part.row + d] = [{"kind": KINDS[k], "first": int(point[a]), "last": int(point[b])} for a, k, b in got]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, arrow)], names)

    shape = docs.withColumn("found", F.lit(None).cast(kind)).schema
    return docs.mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scan(docs)
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "random")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *map(n, KINDS[:3]), F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say(F.col("found")).alias("spans"))
