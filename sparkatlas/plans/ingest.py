"""From files to symbols, chunks, edges and state: chunking, change detection, keyed merges, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.functions import text as T

MAX_LINES, OVERLAP = 200, 20


def windows(symbols: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, content: str = "content", first: str = "line_start") -> DataFrame:
    """Each symbol's content in windows of max_lines lines; the last is the first one that reaches the end."""
    max_lines = max_lines if max_lines > 0 else MAX_LINES
    overlap = overlap if overlap >= 0 else OVERLAP
    stride = max_lines - overlap if max_lines > overlap else max_lines
    lines = symbols.withColumn("_lines", F.split(F.col(content), "\n"))
    n = F.size("_lines")
    steps = F.when(n <= max_lines, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - max_lines) / stride).cast("int")))
    each = lines.withColumn("_k", F.explode(steps)).withColumn("_from", F.col("_k") * stride)
    end = F.least(F.col("_from") + max_lines, n)
    return each.select(
        *[c for c in symbols.columns if c not in (content, "line_start", "line_end")],
        F.array_join(F.slice("_lines", F.col("_from") + 1, end - F.col("_from")), "\n").alias(content),
        (F.col(first) + F.col("_from")).cast("int").alias("line_start"), (F.col(first) + end - 1).cast("int").alias("line_end"),
    )


def chunks(symbols: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of symbols (codebase_id, filepath, qualified, kind, content, line_start, parent_class)."""
    out = windows(symbols, max_lines, overlap).withColumn("module", T.infer_module(F.col("filepath")))
    header = F.when(F.col("kind").isin("class", "struct"), T.first_line(F.col("content")))
    prefix = T.context_prefix(F.col("filepath"), F.col("module"), header, F.col("parent_class"), F.col("kind"))
    return out.withColumns({"id": T.short_id(F.col("filepath"), F.col("qualified"), F.col("line_start")), "context": prefix, "token_count": T.estimate_tokens(F.col("content"))})


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose content hash isn't the stored one."""
    now = files.withColumn("content_hash", T.content_hash(F.col("content")))
    old = state.select("codebase_id", "filepath", F.col("content_hash").alias("_old"))
    return now.join(old, ["codebase_id", "filepath"], "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows put in by key; columns in keep stay as they were where a row was there already."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(before, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def cleaned(rows: DataFrame, touched: DataFrame, keep: DataFrame, ident: str = "id") -> DataFrame:
    """rows without those of touched files whose id isn't kept; none kept removes all of a touched file."""
    stale = rows.join(touched.select("filepath").distinct(), "filepath", "left_semi").join(keep.select(ident), ident, "left_anti")
    return rows.join(stale.select(ident), ident, "left_anti")


def cascaded(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges both of whose ends are still there."""
    ids = symbols.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def orphans(state: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files that are no longer in the tree."""
    return state.join(files.select("codebase_id", "filepath"), ["codebase_id", "filepath"], "left_anti")
