"""The relational tables of an index as Parquet generations in one folder: declared schemas, keyed merges, cascades.

Each write makes a new generation of a table and then moves a one-row pointer to it, so that readers see a whole one; one
writer a table at a time. Tables of many codebases are best kept in one store for each: a merge rewrites its table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.operators import reports
from sparkatlas.plans import ingest

TABLES = {
    "codebases": "id string, root_path string, display_name string, created_at timestamp, config string",
    "symbols": "id string, codebase_id string, name string, qualified string, kind string, filepath string, line_start int, line_end int, module string, parent_id string, signature string, doc_comment string, ue_meta string, created_at timestamp, updated_at timestamp",
    "relationships": "codebase_id string, source_id string, target_id string, kind string, filepath string, line int",
    "summaries": "id string, codebase_id string, scope string, level string, summary string, key_classes string, dependencies string, source_hash string, created_at timestamp, updated_at timestamp",
    "file_state": "codebase_id string, filepath string, content_hash string, indexed_at timestamp, chunk_count int, structural_hash string",
    "chunks": "id string, codebase_id string, symbol_id string, filepath string, line_start int, line_end int, kind string, qualified_name string, module string, token_count int",
    "vectors": "id string, codebase_id string, filepath string, module string, kind string, qualified string, content string, vector array<float>",
}
KEYS = {"codebases": ["id"], "symbols": ["id"], "relationships": ["source_id", "target_id", "kind"], "summaries": ["codebase_id", "scope", "level"], "file_state": ["codebase_id", "filepath"], "chunks": ["id"], "vectors": ["id"]}
#: Columns that a merge leaves as they were.
KEPT = {"codebases": ("created_at",), "symbols": ("created_at", "codebase_id"), "summaries": ("created_at", "id")}
#: Columns that a merge sets to its time.
STAMPED = {"symbols": "updated_at", "summaries": "updated_at", "file_state": "indexed_at"}
EDGE_KINDS = ("calls", "inherits", "references", "includes", "implements", "overrides", "contains", "imports")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = lambda p: (h := spark._jvm.org.apache.hadoop.fs.Path(p), h.getFileSystem(spark._jsc.hadoopConfiguration()))

    def create(self) -> None:
        """Make what tables aren't there yet, in the order of TABLES; those that are stay as they are."""
        for name in TABLES:
            if not self.has(name):
                self.replace(name, self.spark.createDataFrame([], TABLES[name]))

    def has(self, name: str) -> bool:
        at, fs = self._fs(f"{self.path}/{name}.now")
        return fs.exists(at)

    def read(self, name: str, codebase: str | None = None) -> DataFrame:
        at = self.spark.read.text(f"{self.path}/{name}.now").collect()[0][0]
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{at}")
        return df if codebase is None else df.where(F.col("id" if name == "codebases" else "codebase_id") == codebase)

    def replace(self, name: str, df: DataFrame) -> None:
        at = f"{name}-{uuid.uuid4().hex}"
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{self.path}/{at}")
        self.spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.now")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows in by the table's key. A kind that isn't allowed is an error."""
        now = F.current_timestamp()
        for c in ("created_at", STAMPED.get(name)):
            if c and c in TABLES[name]:
                rows = rows.withColumn(c, now)
        if name == "symbols":
            rows = reports.checked_kind(rows)
        if name == "relationships":
            rows = reports.checked_kind(rows, allowed=EDGE_KINDS)
        old = self.read(name)
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        self.replace(name, ingest.merged(old, rows, KEYS[name], KEPT.get(name, ())))

    def ensure_codebase(self, codebase: str, root: str, display: str = "") -> None:
        row = [(codebase, root, display or codebase, None, "{}")]
        self.upsert("codebases", self.spark.createDataFrame(row, TABLES["codebases"]))

    def _cascade(self) -> None:
        symbols = self.read("symbols")
        self.replace("relationships", ingest.cascaded(self.read("relationships"), symbols))
        ids = symbols.select(F.col("id").alias("symbol_id"), F.lit(True).alias("there"))
        chunks = self.read("chunks").join(ids, "symbol_id", "left").withColumn("symbol_id", F.when(F.col("there"), F.col("symbol_id")))
        self.replace("chunks", chunks.drop("there"))

    def delete_files(self, files: DataFrame) -> None:
        """Remove files (codebase_id, filepath) with their chunks, vectors, symbols, and the edges of these."""
        for name in ("file_state", "chunks", "vectors", "symbols"):
            self.replace(name, self.read(name).join(files.select("codebase_id", "filepath").distinct(), ["codebase_id", "filepath"], "left_anti"))
        self._cascade()

    def clean(self, touched: DataFrame, keep_symbols: DataFrame, keep_chunks: DataFrame) -> None:
        """Of touched files remove symbols and chunks (and their vectors) that aren't kept."""
        self.replace("symbols", ingest.cleaned(self.read("symbols"), touched, keep_symbols))
        for name in ("chunks", "vectors"):
            self.replace(name, ingest.cleaned(self.read(name), touched, keep_chunks))
        self._cascade()

    def delete_codebase(self, codebase: str) -> None:
        for name in TABLES:
            self.replace(name, self.read(name).where(F.col("id" if name == "codebases" else "codebase_id") != codebase))

    def refreshed(self) -> dict[str, DataFrame]:
        """symbol_importance and module_stats as of now."""
        symbols, edges = self.read("symbols"), self.read("relationships")
        return {"symbol_importance": reports.importance(symbols, edges), "module_stats": reports.module_stats(symbols)}
