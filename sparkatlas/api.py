"""The index as a whole: one job that indexes files, and the reads and reports over its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions import scan
from sparkatlas.functions import text as T
from sparkatlas.operators import graph, reports, retrieval
from sparkatlas.plans import ingest
from sparkatlas.plans.store import Store
from sparkatlas.plans.tables import dropped, written
from sparkatlas.sources import tree

REQUEST = "request_id string, node_id string, codebase string, status string, full boolean, ts timestamp"


class Atlas:
    """embed: adds a column `vector` to rows of a text column (DataFrame, name); write: a text model, prompt to answer."""

    def __init__(self, store: Store, embed: Callable[[DataFrame, str], DataFrame] = retrieval.hashed_vectors, write: Callable[[str], str] | None = None):
        self.store, self.embed, self.write = store, embed, write
        self.requests = store.spark.createDataFrame([], REQUEST)

    # writing

    def index(self, files: DataFrame, max_lines: int = ingest.MAX_LINES, overlap: int = ingest.OVERLAP, final: bool = True) -> DataFrame:
        """Index files (codebase_id, filepath, content) that have changed; filepath and status of each: indexed, unchanged or failed.

        Unknown languages count as unchanged, null contents as failed. Symbols and chunks of a changed file that aren't
        there any more go, with the edges of the former; edges are resolved over the whole codebase if final.
        """
        s = self.store
        files = written(files.select("codebase_id", "filepath", "content").dropDuplicates(["codebase_id", "filepath"]), "index-files")
        known = files.where((T.detect_language(F.col("filepath")) != "") & F.col("content").isNotNull())
        changed = written(ingest.changed(known, s.read("file_state")), "index-changed")
        module = T.infer_module(F.col("filepath"))
        own = tree.symbols(changed).withColumn("id", T.short_id(F.col("codebase_id"), F.col("filepath"), F.col("qualified"), F.col("line_start"))).withColumn("module", module)
        own = written(own, "index-symbols")
        parts = written(ingest.chunks(own.drop("id", "module"), max_lines, overlap).dropDuplicates(["id"]), "index-chunks")
        vectors = self.embed(parts.withColumn("_text", T.embedding_text(F.col("context"), F.col("content"))), "_text")
        s.clean(changed, own.select("id"), parts.select("id"))
        s.upsert("symbols", own.dropDuplicates(["id"]))
        s.upsert("chunks", parts.withColumnRenamed("qualified", "qualified_name"))
        s.upsert("vectors", vectors.drop("_text"))
        count = parts.groupBy("codebase_id", "filepath").agg(F.count("*").cast("int").alias("chunk_count"))
        state = changed.join(count, ["codebase_id", "filepath"], "left").join(tree.structural_hashes(changed), ["codebase_id", "filepath"], "left")
        s.upsert("file_state", state.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))))
        if final:
            self.finalize(tree.relationships(changed))
        done = changed.select("codebase_id", "filepath", F.lit(True).alias("_new"))
        status = F.when(F.col("content").isNull(), "failed").when(F.col("_new"), "indexed").otherwise("unchanged")
        out = written(files.join(done, ["codebase_id", "filepath"], "left").select("codebase_id", "filepath", status.alias("status")), "index-status")
        dropped(files, changed, own, parts)
        return out

    def finalize(self, raw: DataFrame) -> None:
        """Resolve raw edges within their codebases and put them in."""
        edges = graph.resolve(raw, self.store.read("symbols"), ("codebase_id",))
        self.store.upsert("relationships", edges)
        dropped(edges)

    def collect_garbage(self, files: DataFrame) -> None:
        """Remove what is stored of files that the tree of their codebase doesn't hold any more."""
        state = self.store.read("file_state").join(files.select("codebase_id").distinct(), "codebase_id", "left_semi")
        self.store.delete_files(written(ingest.orphans(state, files), "garbage"))

    # reading

    def list_codebases(self) -> DataFrame:
        s = self.store
        stats = reports.codebase_stats({"files": s.read("file_state"), "symbols": s.read("symbols")})
        own = s.read("codebases").select(F.col("id").alias("codebase_id"), F.coalesce(F.nullif("display_name", F.lit("")), "id").alias("display_name"), "root_path")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return own.join(stats, "codebase_id", "left").select("codebase_id", "display_name", "root_path", zero("files"), zero("symbols")).orderBy("codebase_id")

    def search_code(self, codebase: str, query: str, module: str = "", kind: str = "", limit: int = 10, rerank=None, hybrid: bool = False) -> DataFrame:
        """Chunks by the likeness of their vectors to the query's, fused with term scores if hybrid; rerank: a score Column."""
        limit = retrieval.limit_of(limit)
        own = retrieval.only(self.store.read("vectors", codebase), module=module, kind=kind)
        wanted = self.embed(self.store.spark.createDataFrame([(query,)], "q string"), "q").collect()[0]["vector"]
        dense = retrieval.dense_topk(own, wanted, 2 * limit if hybrid else limit, "id", "vector")
        if hybrid:
            sparse = retrieval.sparse_topk(own, query.lower().split(), 2 * limit, "id", "content")
            dense = own.join(F.broadcast(retrieval.rrf([dense.select("id", "score"), sparse], limit, "id")), "id")  # `limit` rows
        out = dense.select("id", "qualified", "filepath", "module", "kind", "content", "score")
        return retrieval.rerank(out, rerank, limit, "id") if rerank is not None else out.orderBy(F.desc("score"), "id")

    def get_symbol(self, codebase: str, name: str, kind: str = "any") -> DataFrame:
        own = retrieval.only(self.store.read("symbols", codebase), kind=kind)
        return retrieval.fuzzy(own, name, 5)

    def list_modules(self, codebase: str, parent: str = "") -> DataFrame:
        stats = reports.module_stats(self.store.read("symbols", codebase))
        return stats.where(F.col("module").like(parent + "%")).orderBy("module")

    def get_references(self, codebase: str, symbol: str, kind: str = "any", limit: int = 20) -> DataFrame:
        own = self.store.read("symbols", codebase)
        targets = retrieval.fuzzy(own, symbol, 5).select("id")
        return graph.references(self.store.read("relationships", codebase), own, targets, kind, limit if limit > 0 else 20)

    def get_class_hierarchy(self, codebase: str, name: str, direction: str = "both", depth: int = 5) -> DataFrame:
        return graph.named_hierarchy(self.store.read("symbols", codebase), self.store.read("relationships", codebase), name, direction, depth)

    def get_file_context(self, codebase: str, filepath: str, files: DataFrame, first: int = 1, last: int | None = None) -> dict[str, DataFrame]:
        """The file's symbols by line, its dependents, and its lines; files: codebase_id, filepath, content."""
        own = self.store.read("symbols", codebase)
        text = files.where((F.col("codebase_id") == codebase) & (F.col("filepath") == filepath))
        content = T.line_slice(F.col("content"), F.lit(first), F.lit(last).cast("int"))
        return {
            "symbols": own.where(F.col("filepath") == filepath).orderBy("line_start", "id"),
            "dependents": graph.dependents(self.store.read("relationships", codebase), own, filepath), "content": text.select("filepath", content.alias("content")),
        }

    def get_module_summary(self, codebase: str, module: str) -> dict:
        """The stored summary of a module if it is still valid, else a new one by the text model, with files, lines and parts."""
        symbols = self.store.read("symbols", codebase)
        own = symbols.where(F.col("module") == module)
        total = reports.module_rollup(reports.module_stats(symbols), module).collect()
        now = reports.source_hash(own, "module").collect()
        if not now:
            return {"module": module, "summary": "", "files": 0, "loc": 0, "submodules": ""}
        text = self.summary(codebase, module, "module", now[0]["source_hash"], lambda: self.module_prompt(own, module))
        return {"module": module, "summary": text or "No summary is available.", "files": total[0]["files"], "loc": total[0]["loc"], "submodules": total[0]["submodules"]}

    def module_prompt(self, own: DataFrame, module: str) -> str:
        names = reports.key_symbols(own, "module").orderBy("rank").select("kind", "qualified").collect()  # 50 at most
        return f"Summarise module {module} as JSON with summary, key_classes and dependencies.\n" + "\n".join(f"{r.kind} {r.qualified}" for r in names)

    def summary(self, codebase: str, scope: str, level: str, source_hash: str, prompt: Callable[[], str]) -> str | None:
        stored = self.store.read("summaries", codebase).where((F.col("scope") == scope) & (F.col("level") == level) & (F.col("source_hash") == source_hash)).select("summary").collect()
        if stored or self.write is None:
            return stored[0]["summary"] if stored else None
        got = scan.parse_summary(self.write(prompt()))
        row = (codebase, scope, level, got["summary"], got["key_classes"], got["dependencies"], source_hash)
        df = self.store.spark.createDataFrame([row], "codebase_id string, scope string, level string, summary string, key_classes array<string>, dependencies array<string>, source_hash string")
        self.store.upsert("summaries", df.withColumns({"id": T.short_id(F.col("codebase_id"), F.col("scope"), F.col("level")), "key_classes": F.to_json("key_classes"), "dependencies": F.to_json("dependencies")}))
        return got["summary"]

    def list_summaries(self, codebase: str, level: str = "") -> DataFrame:
        return retrieval.only(self.store.read("summaries", codebase), level=level).orderBy("scope")

    def summarise_all(self, codebase: str, most: int = 200) -> int:
        """Module summaries of the first modules by name; how many there are."""
        names = [r.module for r in self.list_modules(codebase).select("module").limit(most).collect()]
        return sum(bool(self.get_module_summary(codebase, n)["summary"]) for n in names)

    def explain_subsystem(self, codebase: str, topic: str) -> str:
        """A stored explanation of the topic, else one by the text model from the ten nearest chunks."""
        stored = self.store.read("summaries", codebase).where((F.col("scope") == topic) & (F.col("level") == "subsystem")).select("summary").collect()
        if stored:
            return stored[0]["summary"]
        chunks = self.search_code(codebase, topic, limit=10).select("filepath", "content").collect()
        if self.write is None or not chunks:
            return "\n".join(c.filepath for c in chunks)
        return self.summary(codebase, topic, "subsystem", "", lambda: f"Explain {topic} as JSON with summary, key_classes and dependencies.\n\n" + "\n\n".join(c.content for c in chunks)) or ""

    def generate_digest(self, codebase: str, top_symbols: int = 20) -> str:
        symbols = self.store.read("symbols", codebase)
        rank = reports.importance(symbols, self.store.read("relationships", codebase)).where("incoming_refs > 0").orderBy(F.desc("incoming_refs"), "id").limit(top_symbols if top_symbols > 0 else 20)
        top = symbols.join(F.broadcast(rank), "id")  # top_symbols rows
        return reports.digest(codebase, reports.module_stats(symbols), top, self.list_summaries(codebase, "module")).collect()[0][0]

    def reindex(self, codebase: str, nodes: DataFrame, full: bool = False) -> str:
        """Record a request for one of the nodes (node_id, codebase) that serve the codebase; its number."""
        node = nodes.where(F.col("codebase") == codebase).orderBy("node_id").limit(1).collect()
        if not node:
            there = ", ".join(r.codebase for r in nodes.select("codebase").distinct().orderBy("codebase").limit(50).collect())
            raise ValueError(f"no node serves {codebase}; served are: {there}")
        ident = uuid.uuid4().hex
        row = self.store.spark.createDataFrame([(ident, node[0]["node_id"], codebase, "requested", full)], "request_id string, node_id string, codebase string, status string, full boolean")
        self.requests = self.requests.unionByName(row.withColumn("ts", F.current_timestamp()))
        return ident

    def reindex_status(self, events: DataFrame, request: str = "", codebase: str = "") -> DataFrame:
        """The states (watch.request_states) of one request, the last of a codebase, or all, the newest first."""
        from sparkatlas.streaming import watch

        got = watch.request_states(events)
        if request:
            return got.where(F.col("request_id") == request)
        got = retrieval.only(got, codebase=codebase).orderBy(F.desc("started_at"), "request_id")
        return got.limit(1) if codebase else got
