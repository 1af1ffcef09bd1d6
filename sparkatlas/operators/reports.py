"""Aggregates over symbols, files and requests, and the texts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T

KINDS = ("function", "method", "class", "struct", "enum", "interface", "typedef", "macro", "variable", "namespace")


def checked_kind(df: DataFrame, column: str = "kind", allowed: tuple[str, ...] = KINDS) -> DataFrame:
    """df, failing when it meets a value that isn't allowed."""
    bad = ~F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("invalid kind: "), F.col(column)))).otherwise(F.col(column)))


def module_stats(symbols: DataFrame) -> DataFrame:
    """Counts by codebase and module; the root's module is ''."""
    is_kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    return symbols.where("module IS NOT NULL").groupBy("codebase_id", "module").agg(
        is_kind("class").alias("class_count"), is_kind("function", "method").alias("function_count"), is_kind("struct").alias("struct_count"),
        F.countDistinct("filepath").alias("file_count"), F.sum(F.coalesce(F.col("line_end") - F.col("line_start"), F.lit(0))).alias("estimated_loc"),
    )


def module_rollup(stats: DataFrame, prefix: str) -> DataFrame:
    """Sums over all modules that begin with a prefix, and their names."""
    own = stats.where(F.col("module").startswith(prefix)) if prefix else stats
    return own.groupBy("codebase_id").agg(F.sum("file_count").alias("files"), F.sum("estimated_loc").alias("loc"), F.array_join(F.array_sort(F.collect_set("module")), ",").alias("submodules"))


def importance(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each symbol on either side, counted before the joins."""
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("incoming_refs"))
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("outgoing_refs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return symbols.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("incoming_refs"), zero("outgoing_refs"))


def codebases(files: DataFrame) -> DataFrame:
    return files.groupBy("codebase_id").agg(F.countDistinct("filepath").alias("files"), F.count("*").alias("symbols"))


def key_symbols(symbols: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The first classes, structs and functions of each group by kind and qualified name."""
    own = symbols.where(F.col("kind").isin("class", "struct", "function"))
    order = Window.partitionBy(key).orderBy("kind", "qualified", "id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def source_hash(symbols: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """A hash of a group's sorted files and key symbols, each ended by NUL, by which a stored summary is known to be valid."""
    nul = "\0"
    files = symbols.select(key, "filepath").distinct().groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("filepath")), lambda f: F.concat(f, F.lit(nul))), "").alias("files"))
    each = F.array_sort(F.collect_list(F.struct("rank", "qualified", "kind")))
    names = key_symbols(symbols, key, limit).groupBy(key).agg(F.array_join(F.transform(each, lambda x: F.concat(x["qualified"], x["kind"], F.lit(nul))), "").alias("names"))
    both = F.concat("files", F.coalesce("names", F.lit("")))
    return files.join(names, key, "left").select(key, F.substring(F.sha2(both.cast("binary"), 256), 1, 32).alias("source_hash"))


def valid_summaries(summaries: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    return summaries.join(hashes.withColumnRenamed("source_hash", "_now"), key).where("source_hash = _now").drop("_now")


def digest(title: str, stats: DataFrame, top: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One markdown text of a codebase: its modules, their descriptions, key symbols, folders, dependencies.

    stats: module_stats rows; top: symbols by importance (qualified, kind, module, signature, incoming_refs, id);
    summaries: scope, summary, dependencies (JSON). A report of a line for each module, as its kind is.
    """
    joined = lambda df, order, line: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("s")))), lambda x: x["s"]), "").alias("t"))
    n = [F.col(c).cast("string") for c in ("class_count", "function_count", "struct_count", "file_count", "estimated_loc")]
    row = F.concat(F.lit("| "), "module", *[x for c in n for x in (F.lit(" | "), c)], F.lit(" |\n"))
    parts = [(joined(stats, ["module"], row), "## Modules\n\n| Module | Classes | Functions | Structs | Files | ~LOC |\n|--------|---------|-----------|---------|-------|------|\n", "\n")]
    if summaries is not None:
        line = F.concat(F.lit("**"), "scope", F.lit("**: "), T.truncate_bytes(F.col("summary"), 300), F.lit("\n\n"))
        parts.append((joined(summaries, ["scope"], line), "### Module Descriptions\n\n", ""))
    some = lambda c, before, end: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), c, F.lit(end))).otherwise("")
    line = F.concat(F.lit("- **"), "qualified", F.lit("** ("), "kind", F.lit(")"), some("module", " \u2014 module: ", ""), some("signature", "\n  `", "`"), F.lit("\n"))
    parts.append((joined(top.withColumn("o", -F.col("incoming_refs")), ["o", "id"], line), "## Key Symbols\n\nMost-referenced symbols in the codebase:\n\n", "\n"))
    parts.append((joined(stats, ["module"], F.concat("module", F.lit("/  ("), F.col("file_count").cast("string"), F.lit(" files)\n"))), "## File Structure\n\n```\n", "```\n\n"))
    if summaries is not None:
        on = F.array_join(T.json_strings(F.col("dependencies")), ", ")
        parts.append((joined(summaries.where(on != ""), ["scope"], F.concat(F.lit("- **"), "scope", F.lit("** depends on: "), on, F.lit("\n"))), "## Module Dependencies\n\n", "\n"))
    every = None
    for k, (df, head, end) in enumerate(parts):  # one row each
        one = df.select(F.lit(k).alias("k"), F.when(F.col("t") != "", F.concat(F.lit(head), "t", F.lit(end))).otherwise("").alias("t"))
        every = one if every is None else every.unionByName(one)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")
    return every.agg(F.concat(F.lit(f"# {title}\n\n"), text).alias("markdown"))


def codebase_stats(tables: dict[str, DataFrame], at: str = "indexed_at") -> DataFrame:
    """Counts of each table by codebase, and the last time of file_state; codebases without rows have zeros."""
    every = None
    for name, df in tables.items():
        seen = F.max(at) if at in df.columns else F.lit(None).cast("timestamp")
        one = df.groupBy("codebase_id").agg(F.count("*").alias("n"), seen.alias("at")).withColumn("name", F.lit(name))
        every = one if every is None else every.unionByName(one)
    count = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return every.groupBy("codebase_id").agg(*map(count, tables), F.max("at").alias("last_indexed"))


def index_age(stats: DataFrame, now, at: str = "last_indexed") -> DataFrame:
    """stats with the seconds since the last time, and the class of that age."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at))
    return stats.withColumn("age_seconds", age).withColumn("freshness", T.freshness(age))


def tallies(results: DataFrame, by: str = "request_id", status: str = "status") -> DataFrame:
    """Counts of files indexed, unchanged and failed in each request."""
    return results.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("indexed", "unchanged", "failed")], F.count("*").alias("total"))


def counters(log: DataFrame, label: str, value: str | None = None) -> DataFrame:
    return log.groupBy(label).agg((F.sum(value) if value else F.count("*")).alias("total"))


def gauges(log: DataFrame, label: str, value: str, at: str) -> DataFrame:
    """The last value of each label."""
    return log.groupBy(label).agg(F.max_by(value, at).alias("value"))


def exposition(counts: DataFrame, name: str, label: str, value: str = "total") -> DataFrame:
    """Lines of the text format that metric collectors read."""
    return counts.select(F.concat(F.lit(f'{name}{{{label}="'), F.regexp_replace(F.col(label).cast("string"), r'(["\\])', r"\\$1"), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def histogram(log: DataFrame, label: str, value: str, buckets: list[float]) -> DataFrame:
    """Cumulative counts by upper bound, with sum and count."""
    return log.groupBy(label).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets], F.count("*").alias("total"), F.round(F.sum(value), 4).alias("sum_value"))


def latest(log: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("m")).select(key, f"m.{at}", *[f"m.{c}" for c in columns])


def file_context(files: DataFrame, first: int, last: int) -> DataFrame:
    return files.withColumn("content", T.line_slice(F.col("content"), F.lit(first), F.lit(last)))
