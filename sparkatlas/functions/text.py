"""Scalar functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for, directories that name no module, the trigram threshold.
LANGUAGES = {
    "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "dart": "dart",
}
ALIASES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "kt": "kotlin", "kts": "kotlin"}
PLAIN_DIRS = (".", "", "internal", "pkg", "src", "lib")
TRIGRAM_THRESHOLD = 0.3


def lookup(table: dict[str, str], key: Column, default: str = "") -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def short_id(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 32)


def short_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def detect_language(path: Column) -> Column:
    return lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def normalize_language(tag: Column) -> Column:
    low = F.lower(tag)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), low), low)


def clean_dirs(path: Column) -> Column:
    """The folders of a path, without empty and `.` ones; `..` takes the one before away."""
    dirs = F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda d: ~d.isin("", "."))
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    step = lambda done, d: F.when((d == "..") & up(done), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(d)))
    return F.when(F.exists(dirs, lambda d: d == ".."), F.aggregate(dirs, F.array().cast("array<string>"), step)).otherwise(dirs)


def infer_module(path: Column) -> Column:
    """The first directory that isn't a plain one, else the first directory, '' for a file at the root."""
    dirs = clean_dirs(path)
    named = F.try_element_at(F.filter(dirs, lambda d: ~d.isin(*PLAIN_DIRS)), F.lit(1))
    return F.coalesce(named, F.when(path.startswith("/"), ""), F.try_element_at(dirs, F.lit(1)), F.lit(""))


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"^[ \t\r]+|[ \t\r]+$", "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


def batch_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), estimate_tokens(text))


def context_prefix(path: Column, module: Column, header: Column, parent: Column, kind: Column) -> Column:
    """Comment lines about a chunk, for what is known of it."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"// {label}: "), c))
    return F.concat_ws("\n", line("File", path), line("Module", module), F.coalesce(line("Class", header), line("Parent", parent)), line("Kind", kind))


def embedding_text(prefix: Column, content: Column) -> Column:
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), content)).otherwise(content)


def truncate_bytes(text: Column, most: int) -> Column:
    cut = F.decode(F.substring(text.cast("binary"), 1, most), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one after."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    each = F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; a and b are trigram arrays."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def string_literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), 1)


def freshness(seconds: Column) -> Column:
    """An index's age as a class; missing or 0 is old."""
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "old").when(seconds < 3600, "fresh").when(seconds < 86400, "stale").otherwise("old")


def sanitize_host(name: Column) -> Column:
    return F.translate(name, ". \t", "---")


def is_cpp_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(h|hpp|hxx|cpp|cc|cxx)$")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1, both inclusive; the whole text if first is beyond its end."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    a, b = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), F.least(F.coalesce(last, n), n)
    return F.when((a > n) | (b < a), F.when(a > n, text).otherwise(F.lit(""))).otherwise(F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n"))


def tenths(n: Column, of: int) -> Column:
    """n / of to one place; halves that are exact go up."""
    tie = (n * 4 % of == 0) & (n * 2 % of != 0)
    return F.replace(F.format_number(n / of + F.when(tie, F.lit(1e-9)).otherwise(F.lit(0.0)), 1), F.lit(","), F.lit(""))


def compact_number(n: Column) -> Column:
    """Of a whole number."""
    return F.when(n.isNull(), "0").when(n >= 1000000, F.concat(tenths(n, 1000000), F.lit("M"))).when(n >= 1000, F.concat(tenths(n, 1000), F.lit("K"))).otherwise(n.cast("string"))


def compact_duration(ms: Column) -> Column:
    ms = F.coalesce(ms, F.lit(0)).cast("long")
    return F.when(ms == 0, "-").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(tenths(ms, 1000), F.lit("s"))).otherwise(F.concat(tenths(ms, 60000), F.lit("m")))


def time_ago(seconds: Column) -> Column:
    """Of the seconds since something; null is never."""
    unit = lambda n, u: F.format_string(f"%d{u} ago", F.floor(seconds / n))
    return F.when(seconds.isNull(), "never").when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_strings(text: Column) -> Column:
    """A JSON array of strings; what isn't one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def strip_generics(name: Column) -> Column:
    return F.substring_index(name, "<", 1)


def trim_quotes(name: Column) -> Column:
    """An import's path without the quotes and brackets at both ends."""
    return F.regexp_replace(name, "^[\"'`<>]+|[\"'`<>]+$", "")


def answers(qualified: Column, path: Column, symbols: Column, files: Column) -> Column:
    """Whether a hit is expected: its file is one of files, or its name holds one of symbols; case doesn't count."""
    return F.exists(files, lambda f: F.lower(f) == F.lower(path)) | F.exists(symbols, lambda s: F.contains(F.lower(qualified), F.lower(s)))
