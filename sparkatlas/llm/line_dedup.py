"""Removal of boilerplate lines that spread over many sites, with DataFrame operations only.

Lines seen on one site only are set aside by a plain aggregate of long values. For the others a HyperLogLog sketch of the
sites of each line (by a hash of 128 bits) merges by aggregation; an estimate well below MIN_SITES clears the line, one
well above flags it, and lines in between get exact distinct counts. Every occurrence of a flagged line goes, but for the
first (smallest document id, then line number) if keep_first.

Lines are what LF separates; lines of spaces only are never removed. A null site counts for nothing; a null text stays
null with no lines; rows that repeat a document as a whole are treated alike. Columns named as the results are replaced;
others stay, whatever their names. A text of any length is split as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage

MIN_SITES = 10
#: log2 of the sketch's size, and the band of estimates around the threshold that exact counts decide.
LG_K, BAND = 12, 0.15
KEY = ("_id", "_of")
LINE = ("_h1", "_h2")


def dedup(docs: DataFrame, text: str = "text", site: str = "source", ident: str = "doc_id", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs with their text less the lines found on min_sites sites (2 or more), n_lines and n_removed."""
    if min_sites < 2:
        raise ValueError("min_sites must be 2 or more")
    docs = docs.drop("n_lines", "n_removed")
    parted = F.split(F.col(text), "\n")
    lines = docs.select(F.col(ident).alias("_id"), F.xxhash64(text).alias("_of"), F.when(F.col(site).isNotNull(), F.xxhash64(site)).alias("_site"), F.posexplode(parted).alias("_pos", "_line"))
    lines = lines.where(F.trim("_line") != "").select("_id", "_of", "_site", "_pos", F.xxhash64(F.lit(1), "_line").alias("_h1"), F.xxhash64(F.lit(2), "_line").alias("_h2"))

    spread = lines.where(F.col("_site").isNotNull()).groupBy(*LINE).agg(F.min("_site").alias("a"), F.max("_site").alias("b")).where("a <> b").select(*LINE)
    spread = storage.written(spread, "lines-spread")
    places = storage.written(lines.join(hinted(spread, 24), [*LINE], "left_semi"), "lines-places")

    sketch = places.groupBy(*LINE).agg(F.hll_sketch_agg("_site", LG_K).alias("sites"), F.min(F.struct("_id", "_of", "_pos")).alias("first"))
    judged = sketch.withColumn("n", F.hll_sketch_estimate("sites")).where(F.col("n") >= min_sites * (1 - BAND)).select(*LINE, "first", (F.col("n") < min_sites * (1 + BAND)).alias("near"))
    judged = storage.written(judged, "lines-judged")
    near = judged.where("near").select(*LINE)
    exact = places.join(hinted(near, 24), [*LINE], "left_semi").where(F.col("_site").isNotNull()).select(*LINE, "_site").distinct().groupBy(*LINE).count().where(F.col("count") >= min_sites)
    flagged = storage.written(judged.join(exact, [*LINE], "left").where(~F.col("near") | F.col("count").isNotNull()).select(*LINE, "first"), "lines-flagged")

    out = places.join(hinted(flagged, 64), [*LINE])
    if keep_first:
        out = out.where(~F.struct("_id", "_of", "_pos").eqNullSafe(F.col("first")))
    gone = out.groupBy(*KEY).agg(F.array_sort(F.collect_set("_pos")).alias("_gone")).withColumnRenamed("_id", "_id2").withColumnRenamed("_of", "_of2")

    got = docs.select(F.struct("*").alias("_row"), F.col(ident).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_of"))
    got = got.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_of") == F.col("_of2")), "left")
    parted = F.split(F.col("_text"), "\n")
    n = F.size("_gone")
    stretch = lambda k: F.element_at("_gone", k + 1) - F.when(k == 0, F.lit(-1)).otherwise(F.element_at("_gone", F.greatest(k, F.lit(1)))) - 1  # noqa: E731  kept lines before the k-th that goes
    keep = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.array_repeat(F.lit(True), stretch(k)), F.array(F.lit(False)))))
    short = F.array_join(F.zip_with(parted, keep, lambda line, k: F.when(F.coalesce(k, F.lit(True)), line)), "\n")
    return got.select(
        *[F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(short).alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"),
    )


def hinted(table: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a table of the shared folder if its counted rows are few enough; else the join shuffles."""
    return F.broadcast(table) if storage.is_small(table, row_bytes) else table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop flagged lines, and the documents that held nothing else."""
    got = dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) ls FROM documents),
l AS (SELECT doc_id, source, i, ls[i] line FROM d, unnest(range(1, len(ls) + 1)) t(i)),
f AS (SELECT line, min((doc_id, i)) first FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY i) FILTER (f.line IS NULL OR (l.doc_id, i) = f.first) kept, count(*) FILTER (f.line IS NOT NULL AND (l.doc_id, i) <> f.first) gone, count(*) n FROM l LEFT JOIN f ON l.line = f.line GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_lines, CAST(coalesce(gone, 0) AS BIGINT) n_removed, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
