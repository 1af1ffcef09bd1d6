"""The registered queries over the test tables, each with SQL that must give the same rows.

The tables hold no code, so that analogues stand in: documents are files (codebase = lang), parts are symbols, line items
are edges from a supplier to a part, events are operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.operators import graph, reports, retrieval
from sparkatlas.plans import ingest
from sparkatlas.streaming import watch

QUERIES, SQL = {}, {}

FILES = "SELECT doc_id, lang codebase_id, 'src/' || source || '/doc_' || doc_id || '.py' filepath, text AS content FROM documents"
SYMBOLS = """SELECT 'p' || p_partkey id, p_brand codebase_id, replace(p_name, ' ', '.') qualified, CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'struct' ELSE 'method' END kind,
p_brand || '/' || p_type filepath, p_type module, CAST(p_partkey % 100 AS INT) line_start, CAST(p_partkey % 100 + p_size AS INT) line_end FROM part"""
EDGES = "SELECT 'p' || (l_suppkey * 7 + 1) source_id, 'p' || l_partkey target_id, l_returnflag kind, l_linenumber AS line FROM lineitem"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark, d):
    path = F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("codebase_id"), path.alias("filepath"), F.col("text").alias("content"))


def symbols(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("class", "function", "struct", "method"))), (key % 4 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), F.col("p_brand").alias("codebase_id"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified"), kind.alias("kind"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("filepath"), F.col("p_type").alias("module"), (key % 100).cast("int").alias("line_start"), (key % 100 + F.col("p_size")).cast("int").alias("line_end"),
    )


def edges(spark, d):
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), (F.col("l_suppkey") * 7 + 1).cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"),
    )


@query("SELECT doc_id, sha256(text) content_hash, CAST(strlen(text) // 4 AS INT) tokens, CAST(greatest(1, strlen(text) // 4) AS INT) batch_tokens FROM documents")
def content_hash(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.content_hash(c).alias("content_hash"), T.estimate_tokens(c).alias("tokens"), T.batch_tokens(c).alias("batch_tokens"))


@query(f"WITH f AS ({FILES}) SELECT doc_id, substr(sha256(filepath || ':mod.f' || doc_id || ':' || doc_id % 50), 1, 32) id FROM f")
def chunk_ids(spark, d):
    return files(spark, d).select("doc_id", T.short_id(F.col("filepath"), F.concat(F.lit("mod.f"), F.col("doc_id").cast("string")), F.col("doc_id") % 50).alias("id"))


PATHS = "SELECT doc_id, ['', 'src/', './', 'internal/a/', 'pkg/lib/', 'x/src/y/'][CAST(doc_id % 6 + 1 AS INT)] || source || ['', '/b'][CAST(doc_id % 2 + 1 AS INT)] || '/f.' || ['py', 'GO', 'tsx', 'rs', 'kts', 'txt', 'hpp', 'dart', 'ts', 'js', 'jsx', 'c', 'h', 'cpp', 'cc', 'kt', 'swift', 'cxx', 'md'][CAST(doc_id % 19 + 1 AS INT)] AS path FROM documents"


def paths(spark, d):
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(pick(6, "", "src/", "./", "internal/a/", "pkg/lib/", "x/src/y/"), "source", pick(2, "", "/b"), F.lit("/f."), pick(19, "py", "GO", "tsx", "rs", "kts", "txt", "hpp", "dart", "ts", "js", "jsx", "c", "h", "cpp", "cc", "kt", "swift", "cxx", "md"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"))


@query(f"WITH p AS ({PATHS}), s AS (SELECT *, string_split(path, '/')[:-2] dirs FROM p), t AS (SELECT *, list_filter(dirs, lambda x: x NOT IN ('.', '', 'internal', 'pkg', 'src', 'lib')) named FROM s) SELECT doc_id, coalesce(named[1], CASE dirs[1] WHEN '.' THEN '' ELSE dirs[1] END, '') AS module FROM t")
def infer_module(spark, d):
    return paths(spark, d).select("doc_id", T.infer_module(F.col("path")).alias("module"))


@query(f"WITH p AS ({PATHS}) SELECT doc_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'kts' THEN 'kotlin' WHEN 'hpp' THEN 'cpp' WHEN 'dart' THEN 'dart' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'kt' THEN 'kotlin' WHEN 'swift' THEN 'swift' ELSE '' END AS language FROM p")
def detect_language(spark, d):
    return paths(spark, d).select("doc_id", T.detect_language(F.col("path")).alias("language"))


@query("SELECT p_partkey, split_part(replace(p_name, ' ', '.'), '.', -1) AS name FROM part")
def short_name(spark, d):
    return table(spark, d, "part").select("p_partkey", T.short_name(F.replace("p_name", F.lit(" "), F.lit("."))).alias("name"))


@query(r"SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^[ \t\r]+|[ \t\r]+$', '', 'g') header FROM documents")
def first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("header"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents),
w AS (SELECT doc_id, ls, len(ls) n, CASE WHEN len(ls) <= 20 THEN 0 ELSE CAST(ceil((len(ls) - 20) / 15.0) AS INT) END k FROM l)
SELECT doc_id, CAST(i * 15 + 1 AS INT) line_start, CAST(least(i * 15 + 20, n) AS INT) line_end, sha256(array_to_string(ls[i * 15 + 1:least(i * 15 + 20, n)], chr(10))) content_hash FROM w, unnest(range(0, k + 1)) t(i)""")
def line_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(1).alias("line_start"))
    return ingest.windows(docs, 20, 5, "text").select("doc_id", "line_start", "line_end", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH f AS ({FILES}) SELECT doc_id, '// File: ' || filepath || chr(10) || '// Module: ' || split_part(filepath, '/', 2) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '// Class: C' || doc_id WHEN doc_id % 3 = 0 THEN chr(10) || '// Parent: P' ELSE '' END || chr(10) || '// Kind: method' || chr(10) || chr(10) || content AS embedded FROM f""")
def context_prefix(spark, d):
    f = files(spark, d)
    i = F.col("doc_id")
    prefix = T.context_prefix(F.col("filepath"), T.infer_module(F.col("filepath")), F.when(i % 2 == 0, F.concat(F.lit("C"), i.cast("string"))), F.when(i % 3 == 0, "P"), F.lit("method"))
    return f.select("doc_id", T.embedding_text(prefix, F.col("content")).alias("embedded"))


@query(f"WITH f AS ({FILES}) SELECT codebase_id, filepath, sha256(content) content_hash FROM f WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def incremental_dedup(spark, d):
    f = files(spark, d)
    stored = f.where("doc_id % 3 = 0").select("codebase_id", "filepath", F.when(F.col("doc_id") % 2 == 0, "old").otherwise(T.content_hash(F.col("content"))).alias("content_hash"))
    return ingest.changed(f, stored).select("codebase_id", "filepath", "content_hash")


@query(f"WITH f AS ({FILES}) SELECT codebase_id, filepath FROM f WHERE doc_id % 5 = 0")
def gc_orphans(spark, d):
    f = files(spark, d)
    return ingest.orphans(f.select("codebase_id", "filepath"), f.where("doc_id % 5 <> 0"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END p_size, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END created FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def upsert_merge(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    old = p.where("p_partkey % 3 <> 0").withColumn("created", F.lit("old"))
    new = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 1).alias("p_size"), F.lit("new").alias("created"))
    return ingest.merged(old, new, ["p_partkey"], keep=("created",))


@query(f"WITH s AS ({SYMBOLS}) SELECT id, filepath FROM s WHERE NOT (codebase_id < 'Brand#3' AND CAST(substr(id, 2) AS BIGINT) % 2 = 1)")
def stale_cleanup(spark, d):
    s = symbols(spark, d).select("id", "filepath", "codebase_id")
    touched = s.where(F.col("codebase_id") < "Brand#3")
    return ingest.cleaned(s, touched, touched.where(F.substring("id", 2, 20).cast("long") % 2 == 0)).select("id", "filepath")


@query(f"WITH e AS ({EDGES}), s AS ({SYMBOLS}) SELECT * FROM e WHERE source_id IN (SELECT id FROM s WHERE kind <> 'struct') AND target_id IN (SELECT id FROM s WHERE kind <> 'struct')")
def cascade_delete(spark, d):
    return ingest.cascaded(edges(spark, d), symbols(spark, d).where("kind <> 'struct'"))


STATS = f"""SELECT codebase_id, module, count(*) FILTER (kind = 'class') class_count, count(*) FILTER (kind IN ('function', 'method')) function_count, count(*) FILTER (kind = 'struct') struct_count,
count(DISTINCT filepath) file_count, CAST(sum(coalesce(line_end - line_start, 0)) AS BIGINT) estimated_loc FROM ({SYMBOLS}) WHERE module IS NOT NULL GROUP BY ALL"""


@query(STATS)
def module_stats(spark, d):
    return reports.module_stats(symbols(spark, d))


@query(f"SELECT codebase_id, module, file_count FROM ({STATS}) WHERE module LIKE 'S%'")
def module_prefix(spark, d):
    return reports.module_stats(symbols(spark, d)).where(F.col("module").like("S%")).select("codebase_id", "module", "file_count")


@query(f"SELECT codebase_id, CAST(sum(file_count) AS BIGINT) files, CAST(sum(estimated_loc) AS BIGINT) loc, string_agg(module, ',' ORDER BY module) submodules FROM ({STATS}) WHERE starts_with(module, 'S') GROUP BY 1")
def module_rollup(spark, d):
    return reports.module_rollup(reports.module_stats(symbols(spark, d)), "S")


IMPORTANCE = f"""WITH s AS ({SYMBOLS}), e AS ({EDGES}), i AS (SELECT target_id id, count(DISTINCT source_id) n FROM e GROUP BY 1), o AS (SELECT source_id id, count(DISTINCT target_id) n FROM e GROUP BY 1)
SELECT s.id, coalesce(i.n, 0) incoming_refs, coalesce(o.n, 0) outgoing_refs FROM s LEFT JOIN i USING (id) LEFT JOIN o USING (id)"""


@query(IMPORTANCE)
def symbol_importance(spark, d):
    return reports.importance(symbols(spark, d), edges(spark, d))


@query(f"SELECT id, incoming_refs FROM ({IMPORTANCE}) WHERE incoming_refs > 0 ORDER BY incoming_refs DESC, id LIMIT 20")
def top_importance(spark, d):
    return reports.importance(symbols(spark, d), edges(spark, d)).where("incoming_refs > 0").select("id", "incoming_refs").orderBy(F.desc("incoming_refs"), "id").limit(20)


@query(f"SELECT codebase_id, count(DISTINCT filepath) files, count(*) symbols FROM ({SYMBOLS}) GROUP BY 1")
def list_codebases(spark, d):
    return reports.codebases(symbols(spark, d))


@query("""SELECT lang codebase_id, count(*) files, count(l.doc_id) labelled, max(n_chars) largest FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""")
def codebase_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    return docs.join(labels, "doc_id", "left").groupBy(F.col("lang").alias("codebase_id")).agg(F.count("*").alias("files"), F.count("has").alias("labelled"), F.max("n_chars").alias("largest"))


@query("SELECT (SELECT count(*) FROM documents) files, (SELECT count(*) FROM part) symbols, (SELECT count(*) FROM lineitem) edges, (SELECT count(*) FROM embeddings) vectors, (SELECT count(DISTINCT lang) FROM documents) codebases")
def global_stats(spark, d):
    one = table(spark, d, "documents").agg(F.count("*").alias("files"), F.countDistinct("lang").alias("codebases"))
    for name, alias in (("part", "symbols"), ("lineitem", "edges"), ("embeddings", "vectors")):
        one = one.join(table(spark, d, name).agg(F.count("*").alias(alias)))
    return one.select("files", "symbols", "edges", "vectors", "codebases")


RAW = """SELECT 'S' || l_suppkey source_qualified, CASE l_linenumber % 3 WHEN 0 THEN '*' ELSE '' END || CASE WHEN l_partkey % 5 = 0 THEN 'N' || l_partkey % 40 ELSE 'm.N' || l_partkey END target_name, l_returnflag kind, l_linenumber line, l_orderkey * 10 + l_linenumber ord FROM lineitem"""
NAMED = "SELECT 'S' || s_suppkey qualified, 's' || s_suppkey id FROM supplier UNION ALL SELECT 'm.N' || p_partkey, 'p' || p_partkey FROM part"


@query(f"""WITH raw AS ({RAW}), sym AS ({NAMED}), sh AS (SELECT split_part(qualified, '.', -1) AS name, min(id) id FROM sym GROUP BY 1),
r AS (SELECT s.id source_id, coalesce(a.id, b.id, c.id) target_id, kind, line, ord FROM raw JOIN sym s ON s.qualified = source_qualified LEFT JOIN sym a ON a.qualified = target_name LEFT JOIN sym b ON b.qualified = CASE WHEN starts_with(target_name, '*') THEN substr(target_name, 2) ELSE target_name END LEFT JOIN sh c ON c.name = target_name)
SELECT source_id, target_id, kind, arg_min(line, ord) line FROM r WHERE target_id IS NOT NULL AND source_id <> target_id GROUP BY ALL""")
def resolve_relationships(spark, d):
    star = F.when(F.col("l_linenumber") % 3 == 0, "*").otherwise("")
    part = F.col("l_partkey")
    target = F.when(part % 5 == 0, F.concat(F.lit("N"), (part % 40).cast("string"))).otherwise(F.concat(F.lit("m.N"), part.cast("string")))
    raw = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_qualified"), F.concat(star, target).alias("target_name"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"), F.lit("f").alias("filepath"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    named = lambda t, k, q, i: table(spark, d, t).select(F.concat(F.lit(q), F.col(k).cast("string")).alias("qualified"), F.concat(F.lit(i), F.col(k).cast("string")).alias("id"))
    sym = named("supplier", "s_suppkey", "S", "s").unionByName(named("part", "p_partkey", "m.N", "p"))
    return graph.resolve(raw, sym).select("source_id", "target_id", "kind", "line")


FUZZY = """WITH t AS (SELECT {id} id, {name} qualified, string_split(trim(regexp_replace(lower({name}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w FROM {table}),
g AS (SELECT id, qualified, list_distinct(flatten([[substr('  ' || x || ' ', i, 3) FOR i IN range(1, length(x) + 2)] FOR x IN w])) g FROM t),
h AS (SELECT list_distinct(flatten([[substr('  ' || x || ' ', i, 3) FOR i IN range(1, length(x) + 2)] FOR x IN string_split({q}, ' ')])) h),
s AS (SELECT id, qualified, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) similarity FROM g, h) """
PART_FUZZY = FUZZY.format(id="p_partkey", name="p_name", table="part", q="'part blue 12'")


@query(PART_FUZZY + "SELECT id, qualified, round(similarity, 6) similarity FROM s WHERE s.similarity >= 0.3 ORDER BY s.similarity DESC, 2, 1 LIMIT 5")
def fuzzy_lookup(spark, d):
    sym = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("qualified"))
    return retrieval.fuzzy(sym, "part blue 12", names=("qualified",)).select("id", "qualified", "similarity")


@query(f"""WITH s AS ({SYMBOLS}), e AS ({EDGES}), t AS (SELECT id FROM s WHERE kind = 'class' ORDER BY qualified, id LIMIT 5)
SELECT e.source_id, s.qualified, e.kind, e.line FROM e JOIN s ON s.id = e.source_id WHERE target_id IN (SELECT id FROM t) ORDER BY qualified, source_id, e.kind, line LIMIT 20""")
def references(spark, d):
    s = symbols(spark, d)
    return graph.references(edges(spark, d), s, s.where("kind = 'class'").orderBy("qualified", "id").limit(5).select("id"))


@query(f"""WITH s AS ({SYMBOLS}), e AS ({EDGES}), f AS (SELECT min(filepath) f FROM s)
SELECT DISTINCT a.filepath dependent FROM e JOIN s a ON a.id = e.source_id JOIN s b ON b.id = e.target_id, f WHERE b.filepath = f.f AND a.filepath <> f.f ORDER BY 1 LIMIT 20""")
def file_dependents(spark, d):
    s = symbols(spark, d)
    return graph.dependents(edges(spark, d), s, s.agg(F.min("filepath")).collect()[0][0])


TREE = "SELECT p_partkey child, p_partkey // 3 parent FROM part"


def hierarchy_sql(steps: str, depth: int) -> str:
    return f"""WITH RECURSIVE t AS ({TREE}), st AS ({steps}), h AS (SELECT CAST(14 AS BIGINT) id, 0 depth, 'self' direction UNION ALL SELECT st.dst, h.depth + 1, st.direction FROM h JOIN st ON st.src = h.id WHERE h.depth < {depth} AND st.dst <> st.src)
SELECT id, min(depth) AS depth, arg_min(direction, depth * 2 + CASE direction WHEN 'child' THEN 1 ELSE 0 END) AS direction FROM h GROUP BY id"""


UP, DOWN = "SELECT child src, parent dst, 'parent' direction FROM t", "SELECT parent src, child dst, 'child' direction FROM t"


def tree(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))


@query(hierarchy_sql(UP, 5))
def hierarchy_parents(spark, d):
    return graph.hierarchy(tree(spark, d), 14, "parents", 5)


@query(hierarchy_sql(DOWN, 3))
def hierarchy_children(spark, d):
    return graph.hierarchy(tree(spark, d), 14, "children", 3)


@query(hierarchy_sql(f"{UP} UNION {DOWN}", 4))
def hierarchy_both(spark, d):
    return graph.hierarchy(tree(spark, d), 14, "both", 4)


@query("""WITH sp AS (SELECT doc_id, i ord, i * 7 + 1 a, CASE i % 3 WHEN 0 THEN i * 7 + 30 ELSE i * 7 + 9 END b FROM documents, unnest(range(0, 8)) t(i)), pt AS (SELECT doc_id, n_chars % 60 line FROM documents)
SELECT doc_id, line, CAST(ord AS INT) ord FROM (SELECT pt.*, ord, row_number() OVER (PARTITION BY doc_id, line ORDER BY b - a, ord) r FROM pt JOIN sp USING (doc_id) WHERE line BETWEEN a AND b) WHERE r = 1""")
def enclosing_span(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    i = F.col("ord")
    spans = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ord")).select("doc_id", "ord", (i * 7 + 1).alias("line_start"), F.when(i % 3 == 0, i * 7 + 30).otherwise(i * 7 + 9).alias("line_end"))
    return graph.enclosing(docs.select("doc_id", (F.col("n_chars") % 60).alias("line")), spans, "doc_id")


@query("""SELECT p.event_id, o.event_id AS owner FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) event_id FROM events WHERE event_type = 'click' GROUP BY ALL) o ON p.user_id = o.user_id AND p.ts > o.ts""")
def owner_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    owners = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("owner"))
    return graph.owner_asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), owners, "user_id", "ts", "owner").select("event_id", "owner")


def wanted(spark, d) -> list[float]:
    """The vector of smallest id as the query."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]


DENSE = "SELECT *, round(exact, 6) score FROM (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 12) exact FROM embeddings)"


@query(f"SELECT vec_id, score FROM ({DENSE}) ORDER BY exact DESC, vec_id LIMIT 10")
def dense_topk(spark, d):
    return retrieval.dense_topk(table(spark, d, "embeddings"), wanted(spark, d)).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM ({DENSE}) WHERE label = 3 ORDER BY exact DESC, vec_id LIMIT 25")
def dense_topk_filtered(spark, d):
    return retrieval.dense_topk(table(spark, d, "embeddings"), wanted(spark, d), retrieval.limit_of(99), label=3).select("vec_id", "score")


SPARSE = """WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) term FROM documents),
h AS (SELECT doc_id, term, count(*) tf FROM w WHERE term IN ('the', 'edin', 'that', 'der') GROUP BY ALL), f AS (SELECT term, count(*) df FROM h GROUP BY 1),
sp AS (SELECT *, round(exact, 6) score FROM (SELECT doc_id, round(sum(tf * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))), 12) exact FROM h JOIN f USING (term) GROUP BY 1) ORDER BY exact DESC, 1 LIMIT 20) """
TERMS = ["the", "edin", "that", "der"]


@query(SPARSE + "SELECT doc_id, score FROM sp ORDER BY exact DESC, doc_id LIMIT 10")
def sparse_topk(spark, d):
    return retrieval.sparse_topk(table(spark, d, "documents"), TERMS, 10)


@query(SPARSE + f""", de AS (SELECT vec_id doc_id, exact, score FROM ({DENSE}) ORDER BY exact DESC, vec_id LIMIT 20),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r FROM sp UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM de)
SELECT doc_id, round(exact, 6) score FROM (SELECT doc_id, round(sum(1.0 / (60 + r)), 12) exact FROM r GROUP BY 1) ORDER BY exact DESC, 1 LIMIT 10""")
def hybrid_rrf(spark, d):
    dense = retrieval.dense_topk(table(spark, d, "embeddings"), wanted(spark, d), 20).select(F.col("vec_id").alias("doc_id"), "score")
    return retrieval.rrf([retrieval.sparse_topk(table(spark, d, "documents"), TERMS, 20), dense], 10, "doc_id")


@query(f"SELECT vec_id, CAST(vec_id % 7 AS DOUBLE) score FROM (SELECT * FROM ({DENSE}) ORDER BY exact DESC, vec_id LIMIT 20) ORDER BY 2 DESC, 1 LIMIT 5")
def rerank_overlap(spark, d):
    hits = retrieval.dense_topk(table(spark, d, "embeddings"), wanted(spark, d), 20).select("vec_id", "score")
    return retrieval.rerank(hits, (F.col("vec_id") % 7).cast("double"), 5, "vec_id")


@query("""WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings ORDER BY vec_id LIMIT 8),
s AS (SELECT q.vec_id query_id, q.label = v.label relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) r FROM q, embeddings v WHERE q.vec_id <> v.vec_id)
SELECT query_id, round(avg(CAST(relevant AS INT)), 6) AS "precision", round(coalesce(1.0 / min(r) FILTER (relevant), 0), 6) reciprocal_rank FROM s WHERE r <= 5 GROUP BY 1""")
def precision_mrr(spark, d):
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").limit(8).select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"), F.col("embedding").alias("e"))
    # a fixed set of 8 benchmark queries against all rows
    s = v.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).withColumn("score", F.round(T.cosine(F.col("embedding"), F.col("e")), 6))
    ranks = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 5")
    return retrieval.evaluate(ranks.withColumn("relevant", F.col("label") == F.col("want")))


@query("""SELECT page_id, len(x) literals, coalesce(x[1], '') AS first FROM (SELECT page_id, regexp_extract_all(html, '"([^"]+)"', 1) x FROM pages)""")
def string_literals(spark, d):
    x = T.string_literals(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(x).cast("long").alias("literals"), F.coalesce(F.try_element_at(x, F.lit(1)), F.lit("")).alias("first"))


@query("SELECT event_id, len(json_keys(props)) AS keys FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("keys"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM e)
SELECT user_id, epoch_us(min(ts)) started, count(*) AS events FROM g GROUP BY user_id, s""")
def debounce_sessions(spark, d):
    return watch.debounced(table(spark, d, "events"), "user_id", "2 hours").select("user_id", F.unix_micros("started").alias("started"), "events")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) started, count(*) AS events FROM events GROUP BY ALL HAVING count(*) >= 5")
def burst_windows(spark, d):
    return watch.bursts(table(spark, d, "events"), "event_type", "1 hour", 5).select("event_type", F.unix_micros("started").alias("started"), "events")


OPS = "CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 4 ELSE 8 END"


@query(f"SELECT user_id, CAST(day(ts) AS INT) AS day, bit_or({OPS}) ops, CASE WHEN bit_or({OPS}) & 12 <> 0 THEN 'delete' ELSE 'index' END AS action FROM events GROUP BY ALL")
def op_accumulate(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").select("user_id", F.day("ts").alias("day"), F.when(t == "click", 2).when(t == "view", 1).when(t == "error", 4).otherwise(8).alias("op"))
    return watch.accumulated(e, ["user_id", "day"])


@query("SELECT user_id, epoch_us(min(ts)) first_seen, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) updated FROM events GROUP BY 1")
def latest_status(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("ts"), F.col("event_type").alias("status"))
    got = watch.status(e, "user_id")
    return got.select("user_id", F.col("first_seen.t").alias("first_seen"), "status", F.col("updated.t").alias("updated"))


@query("SELECT event_type, count(*) FILTER (seen >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY) AS online, count(*) AS nodes FROM (SELECT event_type, user_id, max(ts) seen FROM events GROUP BY ALL) GROUP BY 1")
def online_nodes(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    seen = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("seen")).join(F.broadcast(now))
    return seen.groupBy("event_type").agg(F.count_if(F.col("seen") >= F.col("now") - F.expr("INTERVAL 3 DAYS")).alias("online"), F.count("*").alias("nodes"))


@query("SELECT event_type, count(*) FILTER (value <= 1) le_1, count(*) FILTER (value <= 10) le_10, count(*) FILTER (value <= 100) le_100, count(*) total, round(sum(value), 4) sum_value FROM events GROUP BY 1")
def latency_histogram(spark, d):
    return reports.histogram(table(spark, d, "events"), "event_type", "value", [1, 10, 100])


@query("SELECT s_suppkey, CASE WHEN age <= 0 THEN 'old' WHEN age < 3600 THEN 'fresh' WHEN age < 86400 THEN 'stale' ELSE 'old' END freshness FROM (SELECT s_suppkey, CAST(s_acctbal * 20 AS BIGINT) age FROM supplier)")
def freshness_class(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.freshness(F.round(F.col("s_acctbal") * 20).cast("long")).alias("freshness"))


@query(f"""WITH m AS (SELECT * FROM ({STATS}) WHERE codebase_id = 'Brand#11'), t AS (SELECT i.id, s.qualified, s.kind, s.module, incoming_refs FROM ({IMPORTANCE}) i JOIN ({SYMBOLS}) s USING (id) WHERE codebase_id = 'Brand#11' ORDER BY incoming_refs DESC, i.id LIMIT 20),
a AS (SELECT string_agg('| ' || module || ' | ' || class_count || ' | ' || function_count || ' | ' || struct_count || ' | ' || file_count || ' | ' || estimated_loc || ' |' || chr(10), '' ORDER BY module) a, string_agg(module || '/  (' || file_count || ' files)' || chr(10), '' ORDER BY module) c FROM m),
b AS (SELECT string_agg('- **' || qualified || '** (' || kind || ') — module: ' || module || chr(10), '' ORDER BY incoming_refs DESC, id) b FROM t)
SELECT '# Brand#11' || repeat(chr(10), 2) || '## Modules' || repeat(chr(10), 2) || '| Module | Classes | Functions | Structs | Files | ~LOC |' || chr(10) || '|--------|---------|-----------|---------|-------|------|' || chr(10) || a || chr(10)
|| '## Key Symbols' || repeat(chr(10), 2) || 'Most-referenced symbols in the codebase:' || repeat(chr(10), 2) || b || chr(10) || '## File Structure' || repeat(chr(10), 2) || '```' || chr(10) || c || '```' || repeat(chr(10), 2) AS markdown FROM a, b""")
def digest_markdown(spark, d):
    s = symbols(spark, d).where("codebase_id = 'Brand#11'")
    rank = reports.importance(s, edges(spark, d)).orderBy(F.desc("incoming_refs"), "id").limit(20)
    top = s.join(F.broadcast(rank), "id").withColumn("signature", F.lit(""))  # 20 rows
    return reports.digest("Brand#11", reports.module_stats(s), top)


@query(f"""WITH s AS ({SYMBOLS}), f AS (SELECT module, string_agg(filepath || chr(0), '' ORDER BY filepath) f FROM (SELECT DISTINCT module, filepath FROM s) GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY kind, qualified, id) r FROM s WHERE kind IN ('class', 'struct', 'function')),
n AS (SELECT module, string_agg(qualified || kind || chr(0), '' ORDER BY r) n FROM k WHERE r <= 50 GROUP BY 1)
SELECT module, substr(sha256(f || coalesce(n, '')), 1, 32) source_hash FROM f LEFT JOIN n USING (module)""")
def summary_source_hash(spark, d):
    return reports.source_hash(symbols(spark, d), "module")


@query("SELECT doc_id, CASE WHEN len(ls) < 3 THEN text ELSE array_to_string(ls[3:5], chr(10)) END AS content FROM (SELECT doc_id, text, string_split(text, chr(10)) ls FROM documents)")
def file_context(spark, d):
    return reports.file_context(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 3, 5)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def reindex_history(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus")
