"""The index as a whole: files in, tables, reads and reports out; settings; streams of edges."""

import json

import pytest
from pyspark.sql import functions as F

from sparkatlas.api import Atlas
from sparkatlas.operators import retrieval
from sparkatlas.plans.store import TABLES, Store
from sparkatlas.sources import code, config, tree
from sparkatlas.streaming import watch

FILES = {
    "src/core/a.py": "class Base:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n",
    "src/core/b.py": "from a import Base\n\nclass Child(Base):\n    def go(self):\n        return helper()\n",
    "src/net/c.go": "package net\n\ntype Conn struct {\n\tsize int\n}\n\nfunc Dial(x int) *Conn { return &Conn{} }\n",
    "src/notes.txt": "nothing",
}


def as_files(spark, texts, codebase="c"):
    return spark.createDataFrame([(codebase, p, t) for p, t in texts.items()], tree.FILE)


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.create()
    store.create()
    store.ensure_codebase("c", "/x")
    return Atlas(store, write=lambda prompt: json.dumps({"summary": "S " + prompt.split("\n")[0], "key_classes": ["Base"], "dependencies": ["net"]}))


def test_index_job(spark, atlas):
    s = atlas.store
    first = {r.filepath: r.status for r in atlas.index(as_files(spark, {**FILES, "src/bad.py": None})).collect()}
    assert first == {"src/core/a.py": "indexed", "src/core/b.py": "indexed", "src/net/c.go": "indexed", "src/notes.txt": "unchanged", "src/bad.py": "failed"}
    assert sorted(r.qualified for r in s.read("symbols", "c").collect()) == ["Base", "Base.run", "Child", "Child.go", "Conn", "Dial", "helper"]
    names = {r.id: r.qualified for r in s.read("symbols").collect()}
    edges = {(names[r.source_id], names[r.target_id], r.kind) for r in s.read("relationships").collect()}
    assert {("Child", "Base", "inherits"), ("Base.run", "helper", "calls"), ("Child.go", "helper", "calls"), ("Dial", "Conn", "references")} <= edges
    assert {r.status for r in atlas.index(as_files(spark, FILES)).collect()} == {"unchanged"}
    before = {r.id: r.created_at for r in s.read("symbols").collect()}

    edited = dict(FILES, **{"src/core/a.py": FILES["src/core/a.py"].replace("helper", "other")})
    got = {r.filepath: r.status for r in atlas.index(as_files(spark, edited)).collect()}
    assert [p for p, x in got.items() if x == "indexed"] == ["src/core/a.py"]
    rows = {r.qualified: r for r in s.read("symbols").collect()}
    assert "helper" not in rows and "other" in rows and rows["Base"].created_at == before[rows["Base"].id] and rows["Base"].updated_at > rows["Base"].created_at
    assert s.read("relationships").where("kind = 'inherits'").count() == 1 and s.read("vectors").count() == s.read("chunks").count() == 7

    atlas.collect_garbage(as_files(spark, {p: t for p, t in edited.items() if p != "src/net/c.go"}))
    assert not [r for r in s.read("symbols").collect() if r.filepath == "src/net/c.go"] and s.read("file_state").count() == 2
    atlas.index(as_files(spark, FILES))


def test_reads(spark, atlas):
    assert [(r.codebase_id, r.display_name, r.files, r.symbols) for r in atlas.list_codebases().collect()] == [("c", "c", 3, 7)]
    assert [r.qualified for r in atlas.get_symbol("c", "helper").collect()] == ["helper"]
    assert [r.qualified for r in atlas.get_symbol("c", "Base.run", "method").collect()] == ["Base.run"]
    assert [r.module for r in atlas.list_modules("c").collect()] == ["core", "net"] and [r.class_count for r in atlas.list_modules("c", "co").collect()] == [2]
    assert sorted(r.qualified for r in atlas.get_references("c", "helper").collect()) == ["Base.run"]  # the call from the other file went with the function and comes back with that file
    assert [(r.qualified, r.depth, r.direction) for r in atlas.get_class_hierarchy("c", "Child", "parents").orderBy("depth").collect()] == [("Child", 0, "self"), ("Base", 1, "parent")]
    assert [(r.qualified, r.direction) for r in atlas.get_class_hierarchy("c", "Base").orderBy("depth").collect()] == [("Base", "self"), ("Child", "child")]
    assert atlas.get_class_hierarchy("c", "zzzz").count() == 0
    best = atlas.search_code("c", "type Conn struct", kind="struct", limit=3).collect()
    assert [r.qualified for r in best] == ["Conn"]
    assert atlas.search_code("c", "helper", limit=3, hybrid=True).count() == 3
    context = atlas.get_file_context("c", "src/core/a.py", as_files(spark, FILES), 5, 6)
    assert [r.qualified for r in context["symbols"].collect()] == ["Base", "Base.run", "helper"] and [r.dependent for r in context["dependents"].collect()] == ["src/core/b.py"]
    assert context["content"].collect()[0].content == "def helper():\n    return 1"


def test_summaries_and_digest(atlas):
    got = atlas.get_module_summary("c", "core")
    assert got["summary"].startswith("S Summarise module core") and got["files"] == 2 and got["submodules"] == "core"
    atlas.write, old = None, atlas.write
    assert atlas.get_module_summary("c", "core")["summary"] == got["summary"] and atlas.get_module_summary("c", "net")["summary"] == "No summary is available."
    atlas.write = old
    assert atlas.summarise_all("c") == 2 and atlas.list_summaries("c", "module").count() == 2 and atlas.get_module_summary("c", "none")["files"] == 0
    assert atlas.explain_subsystem("c", "connections").startswith("S Explain connections") and atlas.explain_subsystem("c", "connections").startswith("S Explain")
    text = atlas.generate_digest("c")
    assert text.startswith("# c\n\n## Modules\n\n| Module |") and "**core**: S " in text and "- **helper** (function) — module: core\n  `def helper():`\n" in text
    assert "core/  (2 files)\n" in text and "- **core** depends on: net\n" in text


def test_requests(spark, atlas):
    nodes = spark.createDataFrame([("n1", "c"), ("n2", "d")], "node_id string, codebase string")
    ident = atlas.reindex("c", nodes, full=True)
    with pytest.raises(ValueError, match="served are: c, d"):
        atlas.reindex("e", nodes)
    later = atlas.requests.withColumn("status", F.lit("complete")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    row = atlas.reindex_status(atlas.requests.unionByName(later), request=ident).collect()[0]
    assert row.status == "complete" and row.completed_at > row.started_at and row.node_status == "idle"
    assert atlas.reindex_status(atlas.requests, codebase="c").count() == 1


def test_deleting_a_codebase(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    store.ensure_codebase("d", "/d", "D")
    Atlas(store).index(as_files(spark, FILES, "d"))
    store.delete_codebase("d")
    assert all(store.read(t).count() == 0 for t in TABLES)
    with pytest.raises(Exception, match="invalid kind"):
        store.upsert("symbols", spark.createDataFrame([("1", "d", "nonsense")], "id string, codebase_id string, kind string"))


def test_unfinished_texts_and_odd_ones():
    for lang in code.LANGUAGES:
        for text in ("", "}", "{{{", "func (", "class", "class A {\n fun f(", "type T struct {", "impl", "template <", '"unended', "/* unended", "struct", "export class", "fn f("):
            assert isinstance(code.Code("f", text, lang).relationships(), list)
    assert tree.structural("go", "a  b // x") == tree.structural("go", "a b") != tree.structural("go", "a c") and tree.structural("dart", "x") is None
    assert tree.structural("python", "x = 1  # a") == tree.structural("python", "x=1") and tree.structural("python", "def (") is None


def test_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    own = config.Config.of({"codebase": {"name": "a", "path": "/a"}, "indexing": {"batch_size": 7, "chunk_max_lines": 0}, "embedding": {"api_key_env": "SOME_KEY"}})
    own.check()
    assert own.sections["indexing"] | {} == {"batch_size": 7, "chunk_max_lines": 200, "chunk_overlap_lines": 20, "concurrent_requests": 10, "concurrent_files": 4} and own.secret("embedding") == "k" and own.secret("metrics") == ""
    with pytest.raises(ValueError, match="vector_store.host"):
        own.check(server=True)
    for name, codebase in (("b.yml", "x"), ("a.yaml", "y"), ("c.txt", "x")):
        (tmp_path / name).write_text(json.dumps({"codebase": {"name": codebase, "path": "/"}}))
    assert [c.codebase["name"] for c in config.load_all(str(tmp_path))] == ["y", "x"]
    (tmp_path / "d.yaml").write_text(json.dumps({"codebase": {"name": "x", "path": "/"}}))
    with pytest.raises(ValueError, match="named twice: x"):
        config.load_all(str(tmp_path))
    (tmp_path / "known.json").write_text(json.dumps([{"query": "q", "expected_symbols": ["S"], "expected_files": []}]))
    assert config.known_answers(spark, str(tmp_path / "known.json")).collect()[0].expected_symbols == ["S"]


def test_edges_wait_for_the_final_batch(spark, tmp_path):
    shape = "request_id string, target string, final boolean"
    got = []
    for k, rows in enumerate(([("r", "a", False), ("s", "b", False)], [("r", "c", True)], [("s", "d", False)])):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        run = watch.buffered(stream, str(tmp_path / "out"), lambda df, n: got.extend((r.request_id, r.target) for r in df.collect()), str(tmp_path / "state"), once=True)
        run.awaitTermination(120)
        assert sorted(got) == ([] if k == 0 else [("r", "a"), ("r", "c")])


def test_hashed_vectors(spark):
    got = retrieval.hashed_vectors(spark.createDataFrame([("alpha beta gamma",), ("alpha beta gamma",), (None,), ("",)], "t string"), "t", 64).collect()
    assert got[0].vector == got[1].vector and got[2].vector is None and abs(sum(x * x for x in got[0].vector) - 1) < 1e-5 and not any(got[3].vector)
