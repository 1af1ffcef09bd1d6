"""Queries' operators on tables that the test data doesn't hold: no results in a batch, nulls, equal paths, hot names."""

import pytest
from pyspark.sql import functions as F

from sparkatlas.operators import graph
from sparkatlas.plans import tables
from sparkatlas.sources import tree
from sparkatlas.streaming import watch


def test_bursts_of_frames_without_any(spark):
    events = spark.range(4000).select(F.timestamp_seconds(F.col("id") / 100).alias("ts"), F.lit("a").alias("k"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert [tuple(r) for r in watch.bursts_by_key(events, "k", 60, 3500).collect()] == [("a", 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert watch.bursts_by_key(events, "k", 60, 5000).collect() == []


def test_bursts_with_nulls(spark):
    rows = [("a", 1), ("a", 2), ("a", None), ("b", None), ("b", None), ("b", None), (None, 1), (None, 1), (None, 1)]
    events = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = watch.bursts_by_key(events, "k", 60, 3).collect()
    assert sorted((r.k, r.started) for r in got) == [("a", 1_000_000), ("b", None)]


def batches_by_force(rows, files, size):
    """upload_batches of sorted (key, path, bytes)."""
    now, out = None, []
    for k, p, b in rows:
        if not out or k != now:
            now, batch, n, total = k, 0, 0, 0
        out.append((k, p, b, batch))
        n, total = n + 1, total + b
        if n >= files or total >= size:
            batch, n, total = batch + 1, 0, 0
    return out


def test_upload_batches_over_blocks(spark, monkeypatch):
    """Batches across blocks and ranges, big files, few files of a key, null keys, paths and contents, equal paths."""
    import random

    draw = random.Random(7)
    rows = [(k, f"f{draw.randrange(900)}", draw.choice([0, 1, 5, 50, 400])) for k, n in (("a", 1500), ("b", 3), ("c", 130), (None, 90)) for _ in range(n)]
    rows += [("c", None, 7), ("c", None, None), (None, None, 3), ("c", "f1", 900)]
    monkeypatch.setattr(tree, "BATCH_BYTES", 900)
    df = spark.createDataFrame(rows, "codebase_id string, filepath string, b int").repartition(5)
    df = df.select("codebase_id", "filepath", F.expr("repeat('x', b)").alias("content")).cache()
    nulls = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "", r[2])
    want = batches_by_force(sorted(((k, p, b or 0) for k, p, b in rows), key=nulls), 64, 900)
    for block in (7, 100, 8192):
        monkeypatch.setattr(tree, "BLOCK", block)
        got = [(r.codebase_id, r.filepath, len(r.content or ""), r.batch) for r in tree.upload_batches(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_upload_batches_leave_contents_where_they_are(spark):
    """One codebase's contents aren't one task's: what is asked for without them moves paths and sizes only."""
    df = spark.range(300).select(F.lit("c").alias("codebase_id"), F.col("id").cast("string").alias("filepath"), F.expr("repeat('x', 10)").alias("content"))
    df.write.mode("overwrite").parquet(at := f"{spark.conf.get('spark.checkpoint.dir')}/uploads")
    plan = tree.upload_batches(spark.read.parquet(at)).select("filepath", "batch")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and not [x for x in plan.split("\n") if "content" in x and "octet_length" not in x and "Relation" not in x]


def test_small_tasks_settings(spark):
    """They hold while a table is written, and no longer; a session's smaller ones stay."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    df = spark.range(10)
    seen = []

    class Watched:
        sparkSession, schema = spark, df.schema

        def select(self, *_):
            seen.append(spark.conf.get(key))
            return df

    assert sorted(r.id for r in tables.written(Watched(), "small", small_tasks=True).collect()) == list(range(10))
    spark.conf.set(key, "1m")
    try:
        tables.written(Watched(), "small", small_tasks=True)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    assert seen == ["8m", "1m"] and spark.conf.get(key) == before


@pytest.mark.parametrize("scope", [(), ("codebase_id",)])
def test_resolve_divides_its_sorts(spark, monkeypatch, scope):
    """Names and edges are two written plans of small tasks, so that a task doesn't hold the sorts of all joins."""
    symbols = spark.createDataFrame([("c", "m.A", "1"), ("c", "m.B", "2"), ("c", "x.B", "0"), ("d", "m.A", "9")], "codebase_id string, qualified string, id string")
    rows = [("c", "m.A", "*m.B", "calls", 3), ("c", "m.A", "m.B", "calls", 2), ("c", "m.A", "B", "calls", 1), ("c", "m.A", "m.A", "calls", 4), ("c", "m.A", "none", "calls", 5), ("c", "m.B", "*B", "calls", 6)]
    raw = spark.createDataFrame(rows, "codebase_id string, source_qualified string, target_name string, kind string, line int").withColumns({"filepath": F.lit("f"), "ord": F.col("line")})
    plans = []

    def written(df, name, small_tasks=False):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), small_tasks))
        return tables.written(df, name, small_tasks)

    monkeypatch.setattr(graph, "written", written)
    got = graph.resolve(raw, symbols.where("codebase_id = 'c'") if not scope else symbols, scope)
    assert sorted((r.source_id, r.target_id, r.line) for r in got.collect()) == [("1", "0", 1), ("1", "2", 2)]
    assert plans == [(3, True), (2, True)]
