"""The core against tables of cases, brute force and DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkatlas.functions import scan
from sparkatlas.functions import text as T
from sparkatlas.operators import graph, reports, retrieval
from sparkatlas.plans import catalogue, catalogue_code, ingest  # noqa: F401
from sparkatlas.streaming import watch

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda all_, names: sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in all_), key=repr)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("path, module, language", [("f.go", "", "go"), ("src/a/b.PY", "a", "python"), ("internal/f.kt", "internal", "kotlin"), ("./x.rs", "", "rust"), ("src/lib/pkg/q.txt", "src", ""), ("a/b/c.tsx", "a", "typescript"), ("noext", "", ""), ("./internal/f.kt", "internal", "kotlin"), ("a/../internal/b.cxx", "internal", ""), ("/src/x.swift", "", "swift"), ("/abs/x.jsx", "abs", "javascript"), ("pkg//lib/./m/x.hpp", "m", "cpp")])
def test_paths(spark, path, module, language):
    row = spark.range(1).select(T.infer_module(F.lit(path)), T.detect_language(F.lit(path))).collect()[0]
    assert tuple(row) == (module, language)


def test_windows(spark):
    for n, want in ((1, [(1, 1)]), (5, [(1, 5)]), (6, [(1, 5), (4, 6)]), (11, [(1, 5), (4, 8), (7, 11)])):
        df = spark.createDataFrame([("\n".join("x" * n), 1)], "content string, line_start int")
        assert [(r.line_start, r.line_end) for r in ingest.windows(df, 5, 2).orderBy("line_start").collect()] == want


def test_scan_functions():
    assert scan.split_top_level('a, b(c, d), "e,f", g') == ["a", "b(c, d)", '"e,f"', "g"]
    assert scan.split_top_level("Category=Player's, EditAnywhere, X") == ["Category=Player's", "EditAnywhere", "X"]
    assert scan.split_top_level('a,, "x\\",y", b,') == ["a", "", '"x\\",y"', "b"] and scan.split_top_level("") == []
    assert scan.extract_json('```python\n{"a": 1}\n```') == '{"a": 1}'
    assert scan.json_blocks('x {"a": {}} y {b}') == ['{"a": {}}', "{b}"]
    assert scan.extract_json('say ```json\n{"a": 1}\n``` end') == '{"a": 1}' and scan.extract_json("none") == ""
    assert scan.parse_summary('{"summary": "s", "key_classes": ["A"]}')["key_classes"] == ["A"] and scan.parse_summary(" raw ")["summary"] == "raw"
    assert scan.pack([1] * 129) == [0] * 128 + [1] and scan.pack([200_000, 5, 99_999]) == [0, 1, 2] and scan.pack([]) == []
    assert scan.excluded("node_modules", ["**/node_modules"]) and scan.excluded("a/b/node_modules", ["**/node_modules"]) and scan.excluded("a/b.py", ["*.py"]) and not scan.excluded("a/b.py", ["a/*.go", "b/*.py", "a"])
    assert scan.retry_after("3", 0) == 3 and scan.retry_after("bad", 0) is None and 0.15 <= scan.backoff(1) <= 0.25


def test_evaluation_and_limits(spark):
    df = spark.createDataFrame([(1, r, r == 2) for r in range(1, 8)], "query_id int, rank int, relevant boolean")
    assert tuple(retrieval.evaluate(df).collect()[0]) == (1, 0.2, 0.5)
    assert [retrieval.limit_of(x) for x in (None, 0, 7, 99)] == [10, 10, 7, 25]


def test_index_twice_edit_and_collect(spark):
    shape = "codebase_id string, filepath string, content string"
    files = spark.createDataFrame([("c", "a.py", "1"), ("c", "b.py", "2")], shape)
    state = files.select("codebase_id", "filepath", T.content_hash(F.col("content")).alias("content_hash"))
    assert ingest.changed(files, state).count() == 0
    edited = spark.createDataFrame([("c", "a.py", "9"), ("c", "n.py", "3")], shape)
    assert sorted(r.filepath for r in ingest.changed(edited, state).collect()) == ["a.py", "n.py"]
    assert [r.filepath for r in ingest.orphans(state, edited).collect()] == ["b.py"]
    sym = spark.createDataFrame([("1", "a.py"), ("2", "a.py"), ("3", "b.py")], "id string, filepath string")
    kept = ingest.cleaned(sym, sym.where("filepath = 'a.py'"), sym.where("id = '1'"))
    assert sorted(r.id for r in kept.collect()) == ["1", "3"]
    assert [r.id for r in ingest.cleaned(sym, sym.where("filepath = 'a.py'"), sym.limit(0)).collect()] == ["3"]
    edges = spark.createDataFrame([("1", "3"), ("2", "3")], "source_id string, target_id string")
    assert ingest.cascaded(edges, kept).count() == 1


def test_invalid_kind_fails(spark):
    df = spark.createDataFrame([("class",), ("nonsense",)], "kind string")
    with pytest.raises(Exception, match="invalid kind"):
        reports.checked_kind(df).collect()


def test_cycle_in_hierarchy(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    assert sorted(tuple(r) for r in graph.hierarchy(df, 1, "parents", 9).collect()) == [(1, 0, "self"), (2, 1, "parent"), (3, 2, "parent")]


def test_debounce_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.debounced(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "2 hours")
    run = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    batch = watch.debounced(events, "user_id", "2 hours")
    got = spark.table("sessions")
    assert 0 < got.count() <= batch.count() and got.exceptAll(batch).count() == 0


def test_exact_bursts():
    assert watch.exact_bursts([0, 1, 2, 100, 101, 200], 60, 3) == [(0, 3)]


def test_trees(spark, tmp_path):
    from sparkatlas.sources import tree

    for name, body in (("pkg/__init__.py", ""), ("pkg/a.py", "import os\nclass A(B):\n    def f(self):\n        return g()\ndef g():\n    pass\n"), ("vendor/x.py", "x"), ("b.txt", "no"), ("bad.py", "def (")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    files = tree.files(spark, str(tmp_path), "c", exclude=["**/vendor"])
    assert sorted(r.filepath for r in files.collect()) == ["bad.py", "pkg/__init__.py", "pkg/a.py"]
    rows = tree.python_symbols(files).collect()
    assert sorted((r.qualified, r.kind, r.line_start, r.line_end) for r in rows) == [("A", "class", 2, 4), ("A.f", "method", 3, 4), ("g", "function", 5, 6)]
    edges = {(r.source_qualified, r.target_name, r.kind) for r in tree.python_relationships(files).collect()}
    assert edges == {("pkg/a.py", "os", "references"), ("A", "B", "inherits"), ("A.f", "g", "calls")}
