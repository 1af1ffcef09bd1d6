"""File trees as tables, upload batches, and the symbols, raw edges and structural hashes of source files."""

from __future__ import annotations

import ast
import hashlib
import os
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.functions.scan import excluded
from sparkatlas.plans.tables import written
from sparkatlas.sources.code import RULES, Code

FILE = "codebase_id string, filepath string, content string"
SYMBOL = "codebase_id string, filepath string, language string, name string, qualified string, kind string, line_start int, line_end int, signature string, doc_comment string, parent_class string, content string"
EDGE = "codebase_id string, filepath string, source_qualified string, target_name string, kind string, line int, ord long"
#: An upload batch is full at so many files or bytes.
BATCH_FILES, BATCH_BYTES = 64, 4 << 20
#: So many files at most are dealt out together.
BLOCK = 8192

# Python names that are no targets of edges.
PYTHON_FUNCS = frozenset("""print len range type int str float bool list dict set tuple isinstance issubclass hasattr getattr setattr delattr open input repr id abs min max sum
sorted reversed enumerate zip map filter super property staticmethod classmethod iter next hash callable vars dir globals locals format chr ord hex oct bin round pow divmod any all breakpoint""".split())
PYTHON_TYPES = frozenset("""int str float bool bytes bytearray list dict set tuple frozenset None object type complex range memoryview Any Optional Union List Dict
Set Tuple Sequence Mapping Iterable Iterator Generator Callable Type ClassVar Final Literal""".split())


def listed(root: str, exclude: list[str]):
    """Relative paths of a tree, without excluded folders and files; hidden names are kept, unreadable folders skipped."""
    for at, folders, names in os.walk(root):
        rel = lambda n: os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/")  # noqa: B023, E731
        folders[:] = sorted(n for n in folders if not excluded(rel(n), exclude))
        yield from (rel(n) for n in sorted(names) if not excluded(rel(n), exclude))


def wanted(paths: DataFrame, languages: list[str] = ()) -> DataFrame:
    """The rows whose filepath is of a known language, of these (aliases count) if any are given."""
    language = T.detect_language(F.col("filepath"))
    return paths.where(F.array_contains(F.transform(F.array(*map(F.lit, languages)), T.normalize_language), language) & (language != "") if languages else language != "")


def languages_of(paths: DataFrame, skip: str = r"(^|/)(vendor|node_modules|third_party|\.git)/") -> DataFrame:
    """The languages of a tree's files outside of foreign folders."""
    return wanted(paths.where(~F.col("filepath").rlike(skip))).select(T.detect_language(F.col("filepath")).alias("language")).distinct()


def open_batches(sizes: list[int], most: int, most_bytes: int) -> list[tuple[int, int, int]]:
    """From each place in a list of bytes on, one after the last too: how many batches get full, files and bytes of the one left open."""
    n, total = len(sizes), [0, *accumulate(sizes)]
    out = [(0, 0, 0)] * (n + 1)
    for i in reversed(range(n)):
        end = min(i + most, bisect_left(total, total[i] + most_bytes, i + 1))
        full, files, size = out[end] if end <= n else (-1, n - i, total[n] - total[i])
        out[i] = (full + 1, files, size)
    return out


def upload_batches(files: DataFrame, key: str = "codebase_id") -> DataFrame:
    """files with batch: in the order of their paths, a batch of a key ends with the file that fills it.

    Only paths and sizes are sorted, by ranges, and written in blocks. A batch that is open where a block begins ends in its
    first 63 files, so that a block says what it comes to for each of 64 first files of its own batches; one pass over these
    few numbers finds how each block begins, and the blocks are dealt out with that. Files find their batch by their path;
    files of an equal path stand in the order of their sizes. files is read twice and must be the same both times.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    rows = files.select(F.col(key).alias("k"), F.col("filepath").alias("p"), size.alias("b")).repartitionByRange("k", "p", "b").sortWithinPartitions("k", "p", "b")
    kind = {c: rows.schema[c].dataType.simpleString() for c in "kp"}

    def cut(batches):
        part, block, now, sizes = TaskContext.get().partitionId(), -1, None, []

        def said():
            head = sizes[: BATCH_FILES - 1]
            return [len(head), *head, *(x for o in open_batches(sizes, BATCH_FILES, BATCH_BYTES)[: len(head) + 1] for x in o)]

        def made(types, blocks, at, keys, paths, lengths, says):
            arrays = [pa.array([part] * len(at), pa.int32()), pa.array(blocks, pa.int64()), pa.array(at, pa.int32()), pa.array(keys, types[0]), paths, lengths, pa.array(says, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "i", "k", "p", "b", "says"])

        for batch in batches:
            blocks, at, ended, types = [], [], [], batch.schema.types
            keys = batch.column(0).to_pylist()
            for k, length in zip(keys, batch.column(2).to_pylist(), strict=True):
                if block < 0 or k != now or len(sizes) == BLOCK:
                    ended += [(block, now, said())] if sizes else []
                    block, now, sizes = block + 1, k, []
                blocks.append(block)
                at.append(len(sizes))
                sizes.append(length)
            yield made(types, blocks, at, keys, batch.column(1), batch.column(2), [None] * len(at))
            for b, k, says in ended:
                yield made(types, [b], [-1], [k], pa.nulls(1, types[1]), pa.nulls(1, types[2]), [says])
        if sizes:
            yield made(types, [block], [-1], [now], pa.nulls(1, types[1]), pa.nulls(1, types[2]), [said()])

    def begin(batches):
        first, now, batch, n, size = True, None, 0, 0, 0
        for frame in batches:
            out = []
            for k, says in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                if first or k != now:
                    first, now, batch, n, size = False, k, 0, 0, 0
                out.append((n, size, batch))
                head, o = says[0], 0
                while n and o < head:
                    n, size, o = n + 1, size + says[1 + o], o + 1
                    if n >= BATCH_FILES or size >= BATCH_BYTES:
                        batch, n, size = batch + 1, 0, 0
                if not n:
                    full, n, size = says[1 + head + 3 * o : 4 + head + 3 * o]
                    batch += full
            n_, size_, batch_ = (pa.array(x, pa.int64()) for x in zip(*out, strict=True)) if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), n_, size_, batch_], ["part", "block", "n", "b", "batch"])

    def deal(batches):
        for frame in batches:
            out = []
            for i, length, n_, batch_ in zip(*(c.to_pylist() for c in frame.columns[2:]), strict=True):
                if i < 0:
                    batch, n, size = batch_, n_, length
                    out.append(None)
                    continue
                out.append(batch)
                n, size = n + 1, size + length
                if n >= BATCH_FILES or size >= BATCH_BYTES:
                    batch, n, size = batch + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*frame.columns[:2], pa.array(out, pa.int64())], ["k", "p", "batch"])

    cuts = written(rows.mapInArrow(cut, f"part int, block long, i int, k {kind['k']}, p {kind['p']}, b long, says array<bigint>"), "upload-batches")
    says = cuts.where("i < 0").select("part", "block", "k", "says").repartition("k").sortWithinPartitions("k", "part", "block")
    begun = says.mapInArrow(begin, "part int, block long, n long, b long, batch long").withColumn("i", F.lit(-1))
    each = cuts.where("i >= 0").select("part", "block", "k", "p", "i", "b").unionByName(begun, allowMissingColumns=True).repartition("part", "block").sortWithinPartitions("part", "block", "i")
    dealt = each.select("k", "p", "i", "b", "n", "batch").mapInArrow(deal, f"k {kind['k']}, p {kind['p']}, batch long").where("batch IS NOT NULL")

    def numbered(df, k, p, order):
        same = F.struct(F.col(k).alias("k"), F.col(p).alias("p"))  # a struct of nulls is equal to another
        df = df.withColumn("_path", same)
        return df.withColumn("_nth", F.row_number().over(Window.partitionBy("_path").orderBy(order)))

    found = numbered(dealt, "k", "p", "batch").select("_path", "_nth", "batch")
    return numbered(files, key, "filepath", size).join(found, ["_path", "_nth"]).select(*files.columns, "batch")


def files(spark: SparkSession, root: str, codebase: str, exclude: list[str] = (), languages: list[str] = ()) -> DataFrame:
    """The tree's files of known languages; paths are listed by the driver, contents read by the executors (root must be shared)."""
    paths = spark.createDataFrame([(codebase, p) for p in listed(root, list(exclude))], "codebase_id string, filepath string")
    paths = wanted(paths, languages)

    def read(batches):
        for batch in batches:
            body = []
            for p in batch["filepath"]:
                try:
                    with open(os.path.join(root, p), errors="replace") as f:
                        body.append(f.read())
                except OSError:
                    body.append(None)
            yield batch.assign(content=body)

    return paths.mapInPandas(read, FILE).where("content IS NOT NULL")


def uploaded(batches: DataFrame) -> DataFrame:
    """Files of upload batches (codebase, files: array of filepath and base64 content); failed where the content isn't base64."""
    each = batches.select(F.col("codebase").alias("codebase_id"), F.explode("files").alias("f"))
    raw = F.expr("try_to_binary(f.content, 'base64')")
    return each.select("codebase_id", "f.filepath", F.decode(raw, "UTF-8").alias("content"), raw.isNull().alias("failed"))


def parsed(body: str):
    try:
        return ast.parse(body)
    except (SyntaxError, ValueError, RecursionError):
        return None


def definitions(body: str):
    """(node, qualified, kind, class) of classes, their methods and functions at the root; decorated ones are left out."""
    plain = lambda nodes, *kinds: (n for n in nodes if isinstance(n, kinds) and not n.decorator_list)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in plain(getattr(parsed(body), "body", ()), ast.ClassDef, *functions):
        if isinstance(node, ast.ClassDef):
            yield node, node.name, "class", ""
            yield from ((m, f"{node.name}.{m.name}", "method", node.name) for m in plain(node.body, *functions))
        else:
            yield node, node.name, "function", ""


def symbols_of(path: str, lang: str, body: str) -> list[dict]:
    if lang != "python":
        return Code(path, body, lang).symbols if lang in RULES else []
    lines = body.split("\n")
    return [
        {"name": n.name, "qualified": q, "kind": kind, "line_start": n.lineno, "line_end": n.end_lineno, "signature": lines[n.lineno - 1].strip(), "doc_comment": ast.get_docstring(n) or "", "parent_class": owner, "content": "\n".join(lines[n.lineno - 1 : n.end_lineno])}
        for n, q, kind, owner in definitions(body)
    ]


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of all files of languages that are known; a text that can't be read has none, a null text neither."""
    names = [c.split()[0] for c in SYMBOL.split(", ")]

    def run(batches):
        for batch in batches:
            out = [(code, path, lang, *(s[n] for n in names[3:])) for code, path, lang, body in zip(batch["codebase_id"], batch["filepath"], batch["language"], batch["content"], strict=True) if body for s in symbols_of(path, lang, body)]
            yield pd.DataFrame(out, columns=names)

    return known(files).mapInPandas(run, SYMBOL)


def known(files: DataFrame) -> DataFrame:
    return files.select("codebase_id", "filepath", T.detect_language(F.col("filepath")).alias("language"), "content").where("language <> ''")


def called(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{node.value.id}.{node.attr}" if isinstance(node.value, ast.Name) else node.attr
    return None


def python_edges(path: str, body: str):
    """(source, target, kind, line): imports from the file, bases of classes, calls and annotations by the narrowest definition."""
    tree = parsed(body)
    if tree is None:
        return
    spans = [(n.lineno, n.end_lineno, q) for n, q, *_ in definitions(body)]
    around = lambda line: min(((b - a, k, q) for k, (a, b, q) in enumerate(spans) if a <= line <= b), default=(0, 0, ""))[2]
    notes = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((path, a.name, "references", node.lineno) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield path, node.module, "references", node.lineno
        elif isinstance(node, ast.ClassDef):
            yield from ((node.name, b, "inherits", node.lineno) for x in node.bases if (b := called(x)) and b not in PYTHON_TYPES)
        elif isinstance(node, ast.Call) and (target := called(node.func)):
            if (source := around(node.lineno)) and target not in PYTHON_FUNCS:
                yield source, target, "calls", node.lineno
        notes += [x for x in (getattr(node, "annotation", None), getattr(node, "returns", None)) if x is not None]
    for note in notes:
        for node in ast.walk(note):
            if isinstance(node, ast.Name) and node.id not in PYTHON_TYPES and (source := around(node.lineno)) not in ("", node.id):
                yield source, node.id, "references", node.lineno


def relationships_of(path: str, lang: str, body: str) -> list[tuple]:
    if lang == "python":
        return list(python_edges(path, body))
    return Code(path, body, lang).relationships() if lang in RULES else []


def relationships(files: DataFrame) -> DataFrame:
    """The raw edges of all files, ord by their place in a file."""

    def run(batches):
        for batch in batches:
            out = [(code, path, *e, k) for code, path, lang, body in zip(batch["codebase_id"], batch["filepath"], batch["language"], batch["content"], strict=True) if body for k, e in enumerate(relationships_of(path, lang, body))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDGE.split(", ")])

    return known(files).mapInPandas(run, EDGE)


def python_symbols(files: DataFrame) -> DataFrame:
    return symbols(files).where("language = 'python'")


def python_relationships(files: DataFrame) -> DataFrame:
    return relationships(files.where(T.detect_language(F.col("filepath")) == "python"))


def structural(lang: str, body: str) -> str | None:
    """A hash of a text's tokens without comments and layout; null where the language has no parser or the text can't be read."""
    if lang == "python":
        tree = parsed(body)
        text = ast.dump(tree) if tree else None
    else:
        text = "".join(f"{t.kind}\0{t.text}\1" for t in Code("", body, lang).tokens if t.kind not in ("comment", "nl")) if lang in RULES else None
    return None if text is None else hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:32]


def structural_hashes(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            got = [structural(lang, body) if body is not None else None for lang, body in zip(batch["language"], batch["content"], strict=True)]
            yield batch[["codebase_id", "filepath"]].assign(structural_hash=got)

    return known(files).mapInPandas(run, "codebase_id string, filepath string, structural_hash string")
