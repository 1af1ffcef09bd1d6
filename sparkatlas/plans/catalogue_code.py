"""More registered queries: parsers on written-out snippets, packing, streams of states, reports; each with SQL.

The snippets' expected rows are written out, as SQL can't parse code; all else runs over the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.operators import graph, reports, retrieval
from sparkatlas.plans.catalogue import EDGES, PATHS, SYMBOLS, edges, files, paths, query, symbols, table
from sparkatlas.sources import engine, tree
from sparkatlas.streaming import watch

SNIPPETS = {
    "a/server.go": 'package main\nimport "fmt"\n\n// Server serves.\ntype Server struct {\n\tBase\n\tname string\n\tcfg *Config\n}\n\ntype Reader interface { Read() }\n\ntype ID int\n\nfunc (s *Server) Start(x Config) error {\n\tfmt.Println(s.name)\n\thelper()\n\treturn nil\n}\n\nfunc helper() *Server { return &Server{} }\n',
    "a/app.ts": "import { a } from './a';\nexport class Foo extends Bar implements Baz {\n  private x: number = 1;\n  constructor(private y: Thing) { super(); }\n  async run(a: Arg): Promise<Out> {\n    return api.fetchIt(a);\n  }\n}\nexport interface Opts { a: string }\nenum Color { Red }\nconst go = async (x: Opts) => {\n  helper(x);\n};\nfunction helper(x) { console.log(x) }\nconst n = 3\n",
    "a/app.js": "import u from 'u';\nvar f = x => x + 1;\nclass A extends B { m() { return f(1); } }\nfunction g() {}\n",
    "a/lib.rs": "use std::collections::HashMap;\npub struct P { x: Q }\nenum E { A, B }\npub trait T { fn a(&self); fn b(&self) -> R { R::new() } }\nimpl T for P {\n    fn a(&self) { helper(1); Foo::make(); }\n}\nfn helper(x: i32) -> P { P { x: 1 } }\n",
    "a/m.c": '#include "a.h"\n#ifdef X\nstruct Hidden { int a; };\n#endif\nstruct Point { int x; };\nenum Color { RED };\ntypedef struct { int z; } Anon;\nstatic Foo *make(Bar b, int n) {\n  b->fill(n);\n  printf("x");\n  return alloc(n);\n}\n',
    "a/m.cpp": "#include <vector>\nnamespace n {\nclass A : public B {\npublic:\n  A() {}\n  int get() const { return x; }\n  void decl();\n};\nstruct S { int q; };\ntemplate <typename T> int id(int t) { return t; }\nvoid A::decl() { helper(1); obj.call(); ns::f(); }\n}\n",
    "a/m.kt": "import b.C\n\ndata class P(val x: Int) : Base(x), I {\n    fun m(): Int = x\n    val y = 3\n    companion object {\n        fun make() = build(1)\n    }\n}\ninterface I { fun q() }\nenum class E { A, B }\nobject O { fun z() {} }\nfun String.ext(): Int = 1\n",
    "a/m.swift": "import UIKit\nclass V: UIView, D {\n  var x: Int = 1\n  func m(_ a: Int) -> Int { return grow(a) }\n}\nstruct S { let a: Int }\nprotocol P { func q() }\nextension V { func more() {} }\n",
    "a/m.py": "import os\nfrom c.d import e\n\nclass K(Base):\n    def m(self, a: Arg) -> Out:\n        return go(a)\n\n@deco\ndef left_out():\n    pass\n\ndef go(x):\n    print(x)\n    os.remove(x)\n",
}
# what each snippet holds: qualified, kind, first line, last line
SYMBOLS_OF = {
    "go": "Server struct 5 9, Reader class 11 11, ID typedef 13 13, Server.Start method 15 19, helper function 21 21",
    "typescript": "Foo class 2 8, Foo.constructor method 4 4, Foo.run method 5 7, Opts struct 9 9, Color enum 10 10, go function 11 13, helper function 14 14",
    "javascript": "f function 2 2, A class 3 3, A.m method 3 3, g function 4 4",
    "rust": "P struct 2 2, E enum 3 3, T class 4 4, T::b method 4 4, P::a method 6 6, helper function 8 8",
    "c": "Point struct 5 5, Color enum 6 6, make function 8 12",
    "cpp": "A class 3 8, A::A method 5 5, A::get method 6 6, S struct 9 9, id function 10 10, A::decl function 11 11",
    "kotlin": "P class 3 9, P.m method 4 4, P.y function 5 5, P.Companion.make method 7 7, I class 10 10, I.q method 10 10, E enum 11 11, O class 12 12, O.z method 12 12, String.ext function 13 13",
    "swift": "V class 2 5, V.x function 3 3, V.m method 4 4, S struct 6 6, S.a function 6 6, P class 7 7, P.q method 7 7, V.more method 8 8",
    "python": "K class 4 6, K.m method 5 6, go function 12 14",
}
EDGES_OF = """a/server.go Server Base inherits 6
a/server.go Server Config references 8
a/server.go Server.Start Server references 15
a/server.go Server.Start Config references 15
a/server.go Server.Start fmt.Println calls 16
a/server.go Server.Start helper calls 17
a/server.go helper Server references 21
a/server.go helper Server references 21
a/app.ts a/app.ts ./a references 1
a/app.ts Foo Bar inherits 2
a/app.ts Foo Baz inherits 2
a/app.ts Foo.constructor Thing references 4
a/app.ts Foo.run Arg references 5
a/app.ts Foo.run Out references 5
a/app.ts Foo.run api.fetchIt calls 6
a/app.ts go Opts references 11
a/app.ts go helper calls 12
a/app.js a/app.js u references 1
a/app.js A B inherits 3
a/app.js A f calls 3
a/lib.rs a/lib.rs std::collections::HashMap references 1
a/lib.rs P Q references 2
a/lib.rs T R references 4
a/lib.rs T R::new calls 4
a/lib.rs P T inherits 5
a/lib.rs P::a helper calls 6
a/lib.rs P::a Foo::make calls 6
a/lib.rs helper P references 8
a/lib.rs helper P references 8
a/m.c a/m.c a.h references 1
a/m.c make Foo references 8
a/m.c make Bar references 8
a/m.c make fill calls 9
a/m.c make alloc calls 11
a/m.cpp a/m.cpp vector references 1
a/m.cpp A B inherits 3
a/m.cpp A::decl helper calls 11
a/m.cpp A::decl call calls 11
a/m.cpp A::decl ns::f calls 11
a/m.kt a/m.kt b.C references 1
a/m.kt P Base inherits 3
a/m.kt P I inherits 3
a/m.kt P.Companion.make build calls 7
a/m.swift a/m.swift UIKit references 1
a/m.swift V UIView inherits 2
a/m.swift V D inherits 2
a/m.swift V.m grow calls 4
a/m.py a/m.py os references 1
a/m.py a/m.py c.d references 2
a/m.py K Base inherits 4
a/m.py K.m Arg references 5
a/m.py K.m Out references 5
a/m.py K.m go calls 6
a/m.py go os.remove calls 14"""


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c", p, t) for p, t in SNIPPETS.items()], tree.FILE)


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def parse_query(lang: str):
    def run(spark, d):
        got = tree.symbols(snippets(spark)).where(F.col("language") == lang)
        return got.select("qualified", "kind", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))

    run.__name__ = f"parse_{lang}"
    rows = [(*x[:2], int(x[2]), int(x[3])) for x in map(str.split, SYMBOLS_OF[lang].split(", "))]
    return query(values(rows, "qualified, kind, line_start, line_end"))(run)


for _lang in SYMBOLS_OF:
    parse_query(_lang)


@query(values([(*x[:4], int(x[4])) for x in map(str.split, EDGES_OF.split("\n"))], "filepath, source_qualified, target_name, kind, line"))
def raw_relationships(spark, d):
    return tree.relationships(snippets(spark)).select("filepath", "source_qualified", "target_name", "kind", F.col("line").cast("long").alias("line"))


HEADER = """UCLASS(BlueprintType, Abstract)
class GAME_API AThing : public AActor
{
};

UCLASS()
class APlain : public AActor
{
    GENERATED_BODY()

    UPROPERTY(EditAnywhere, Category="Stats")
    int32 Health = 10;

    UFUNCTION(BlueprintCallable, Category="Stats")
    virtual void Hit(int32 By);
};

USTRUCT()
struct FPart
{
    UPROPERTY()
    TArray<int32> Items;
};
"""
BUILD = """public class Game : ModuleRules {
  public Game() {
    PublicDependencyModuleNames.AddRange(new string[] { "Core", "Engine" });
    PrivateDependencyModuleNames.Add("Slate");
    PublicIncludePaths.Add("Game/Public");
  }
}"""
PLUGIN = '{"Description": "d", "Category": "c", "Modules": [{"Name": "M", "Type": "Runtime"}], "Plugins": [{"Name": "P", "Enabled": true}, {"Name": "Q"}],}'


@query(values([("AThing", "UCLASS", 0, 0), ("APlain", "UCLASS", 1, 1), ("FPart", "USTRUCT", 1, 0)], "class_name, macro_type, n_properties, n_functions"))
def ue_macros(spark, d):
    return engine.macros(spark.createDataFrame([("a/T.h", HEADER), ("a/T.go", HEADER)], "filepath string, content string")).select("class_name", "macro_type", "n_properties", "n_functions")


@query(values([("Game", "a", "Core,Engine,Slate", "Game/Public"), ("X", "", "", "")], "name, folder, dependencies, include_paths"))
def build_modules(spark, d):
    got = engine.build_modules(spark.createDataFrame([("a/G.Build.cs", BUILD), ("X.Build.cs", ""), ("a/b.cs", BUILD)], "filepath string, content string"))
    return got.select("name", "folder", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("public_include_paths", ",").alias("include_paths"))


@query(values([("Thing", "d", "c", "M:Runtime", "P:true,Q:false")], "name, description, category, modules, plugins"))
def plugin_files(spark, d):
    got = engine.plugins(spark.createDataFrame([("p/Thing.uplugin", PLUGIN), ("p/x.json", PLUGIN)], "filepath string, content string"))
    say = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a], x[b].cast("string"))), ",").alias(c)
    return got.select("name", "description", "category", say("modules", "name", "type"), say("plugins", "name", "enabled"))


@query("""WITH RECURSIVE t AS (SELECT lang, doc_id, greatest(1, strlen(text) // 4) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) k FROM documents),
r AS (SELECT lang, doc_id, k, size AS total, 1 n, 0 batch FROM t WHERE k = 1
UNION ALL SELECT t.lang, t.doc_id, t.k, CASE WHEN r.n = 16 OR r.total + t.size > 5000 THEN t.size ELSE r.total + t.size END, CASE WHEN r.n = 16 OR r.total + t.size > 5000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n = 16 OR r.total + t.size > 5000 THEN r.batch + 1 ELSE r.batch END
FROM r JOIN t ON t.lang = r.lang AND t.k = r.k + 1)
SELECT lang, doc_id, CAST(batch AS BIGINT) batch FROM r""")
def batch_packing(spark, d):
    rows = table(spark, d, "documents").select("lang", "doc_id", T.batch_tokens(F.col("text")).cast("long").alias("size"))
    return retrieval.batches(rows, "lang", "doc_id", "size", 16, 5000).select("lang", "doc_id", "batch")


@query(f"WITH p AS ({PATHS}) SELECT DISTINCT regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS extension FROM p WHERE lower(extension) IN ('ts', 'tsx', 'go')")
def wanted_languages(spark, d):
    got = tree.wanted(paths(spark, d).withColumnRenamed("path", "filepath"), ["TS", "go"])
    return got.select(F.regexp_extract("filepath", r"\.([A-Za-z0-9]+)$", 1).alias("extension")).distinct()


@query("SELECT event_type, event_id, arg_max(tag, tag) tag FROM (SELECT event_type, event_id, CASE WHEN event_type IN ('ts', 'PY') THEN 'x' ELSE event_type END tag FROM events) GROUP BY ALL")
def normalized_tags(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", T.normalize_language(F.col("event_type")).alias("tag"))


@query(f"SELECT DISTINCT module, filepath FROM ({SYMBOLS}) WHERE codebase_id = 'Brand#11' ORDER BY ALL")
def module_files(spark, d):
    return symbols(spark, d).where("codebase_id = 'Brand#11'").select("module", "filepath").distinct().orderBy("module", "filepath")


@query(f"SELECT module, id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY kind, qualified, id) r FROM ({SYMBOLS}) WHERE kind IN ('class', 'struct', 'function')) WHERE r <= 50")
def module_key_symbols(spark, d):
    return reports.key_symbols(symbols(spark, d), "module").select("module", "id", "rank")


@query(f"SELECT id, line_start FROM ({SYMBOLS}) WHERE filepath = (SELECT min(filepath) FROM ({SYMBOLS})) ORDER BY line_start, id")
def file_symbols(spark, d):
    s = symbols(spark, d)
    return s.where(F.col("filepath") == s.agg(F.min("filepath")).collect()[0][0]).select("id", "line_start").orderBy("line_start", "id")


@query("""SELECT lang codebase_id, count(*) files, count(l.n) labelled, CAST(coalesce(sum(l.n), 0) AS BIGINT) labels FROM documents d LEFT JOIN (SELECT doc_id, count(*) n FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1""")
def codebase_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("codebase_id"))
    labels = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    got = reports.codebase_stats({"files": docs, "labelled": labels.distinct(), "labels": labels})
    return got.select("codebase_id", "files", "labelled", "labels")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS indexed, count(*) FILTER (event_type = 'click') AS unchanged, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1""")
def batch_tallies(spark, d):
    status = F.element_at(F.create_map(*map(F.lit, ("view", "indexed", "click", "unchanged", "error", "failed"))), F.col("event_type"))
    return reports.tallies(table(spark, d, "events").select("user_id", status.alias("status")), "user_id")


@query("SELECT event_type, count(*) AS total, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def counters_and_gauges(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return reports.counters(e, "event_type").join(reports.gauges(e, "event_type", "value", "at").withColumnRenamed("value", "last_value"), "event_type")


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def exposition_lines(spark, d):
    return reports.exposition(reports.counters(table(spark, d, "events").withColumnRenamed("event_type", "type"), "type"), "events_total", "type")


@query("""WITH e AS (SELECT user_id, event_type, ts, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 4 ELSE 8 END op, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM e), m AS (SELECT *, min(ts) OVER (PARTITION BY user_id, s) started FROM g)
SELECT user_id, epoch_us(started) started, 'p' || op % 3 AS path, bit_or(op) ops, CASE WHEN bit_or(op) & 12 <> 0 THEN 'delete' ELSE 'index' END AS action FROM m GROUP BY ALL""")
def session_batches(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").select("user_id", "ts", F.when(t == "click", 2).when(t == "view", 1).when(t == "error", 4).otherwise(8).alias("op"))
    got = watch.session_batches(e.withColumn("path", F.concat(F.lit("p"), (F.col("op") % 3).cast("string"))), "user_id", gap="2 hours")
    return got.withColumn("started", F.unix_micros("started"))


@query("""WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) k FROM events),
r AS (SELECT event_type, t, k, t start, 1 n FROM e WHERE k = 1 UNION ALL SELECT e.event_type, e.t, e.k, CASE WHEN e.t - r.start > 7200000000 THEN e.t ELSE r.start END, CASE WHEN e.t - r.start > 7200000000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)
SELECT event_type, start AS started FROM r WHERE n = 5""")
def bursts_by_key(spark, d):
    return watch.bursts_by_key(table(spark, d, "events"), "event_type", 7200, 5)


@query("""WITH e AS (SELECT user_id request_id, epoch_us(ts) ts, CASE event_type WHEN 'view' THEN 'requested' WHEN 'click' THEN 'started' WHEN 'signup' THEN 'progress' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS status, event_id FROM events)
SELECT request_id, min(ts) started_at, min(ts) FILTER (status IN ('complete', 'error')) completed_at, arg_max(status, (ts, status)) AS status, CASE WHEN arg_max(status, (ts, status)) IN ('started', 'progress') THEN 'indexing' ELSE 'idle' END node_status FROM e GROUP BY 1""")
def request_states(spark, d):
    status = F.element_at(F.create_map(*map(F.lit, ("view", "requested", "click", "started", "signup", "progress", "purchase", "complete", "error", "error"))), F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), status.alias("status"), F.lit("n").alias("node_id"), F.lit("c").alias("codebase"))
    return watch.request_states(e).select("request_id", "started_at", "completed_at", "status", "node_status")


@query("SELECT event_type AS node_id, user_id AS codebase, epoch_us(max(ts)) AS last_seen FROM events GROUP BY ALL HAVING arg_max(CASE WHEN value < 5 THEN 'deregister' ELSE 'register' END, (ts, CASE WHEN value < 5 THEN 'deregister' ELSE 'register' END)) = 'register'")
def registered_nodes(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("node_id"), F.col("user_id").alias("codebase"), "ts", F.when(F.col("value") < 5, "deregister").otherwise("register").alias("event"))
    return watch.registered(e).withColumn("last_seen", F.unix_micros(F.col("last_seen").cast("timestamp")))


@query("SELECT o_orderkey, CASE WHEN p >= 1000000 THEN printf('%.1fM', p / 1e6 + CASE WHEN p % 500000 = 250000 THEN 1e-9 ELSE 0 END) WHEN p >= 1000 THEN printf('%.1fK', p / 1000.0 + CASE WHEN p % 500 = 250 THEN 1e-9 ELSE 0 END) ELSE CAST(p AS VARCHAR) END AS compact, CASE WHEN p < 60 THEN p || 's ago' WHEN p < 3600 THEN p // 60 || 'm ago' WHEN p < 86400 THEN p // 3600 || 'h ago' ELSE p // 86400 || 'd ago' END AS ago, CASE WHEN p = 0 THEN '-' WHEN p < 1000 THEN p || 'ms' WHEN p < 60000 THEN printf('%.1fs', p / 1000.0 + CASE WHEN p % 500 = 250 THEN 1e-9 ELSE 0 END) ELSE printf('%.1fm', p / 60000.0 + CASE WHEN p % 30000 = 15000 THEN 1e-9 ELSE 0 END) END AS duration FROM (SELECT o_orderkey, o_orderkey * 7 AS p FROM orders)")
def compact_formats(spark, d):
    p = F.col("o_orderkey") * 7
    return table(spark, d, "orders").select("o_orderkey", T.compact_number(p).alias("compact"), T.time_ago(p).alias("ago"), T.compact_duration(p).alias("duration"))


@query("""WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings ORDER BY vec_id LIMIT 8),
s AS (SELECT q.vec_id query_id, q.label = v.label relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) r FROM q, embeddings v WHERE q.vec_id <> v.vec_id),
p AS (SELECT query_id, round(avg(CAST(relevant AS INT)), 6) AS "precision", round(coalesce(1.0 / min(r) FILTER (relevant), 0), 6) reciprocal_rank FROM s WHERE r <= 5 GROUP BY 1)
SELECT round(avg("precision"), 6) mean_precision, round(avg(reciprocal_rank), 6) mean_reciprocal_rank, count(*) queries FROM p""")
def mean_precision(spark, d):
    from sparkatlas.plans.catalogue import precision_mrr

    return retrieval.mean_evaluation(precision_mrr(spark, d))


@query("SELECT doc_id, source = 'blog' OR contains(lower(source), 'ew') AS hit FROM documents")
def expected_answers(spark, d):
    hit = T.answers(F.upper("source"), F.col("source"), F.array(F.lit("EW")), F.array(F.lit("BLOG")))
    return table(spark, d, "documents").select("doc_id", hit.alias("hit"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN list_value('a', p_brand) ELSE [] END AS deps, split_part(p_name || '<T>', '<', 1) AS plain, p_type AS path FROM part")
def decoded_strings(spark, d):
    even = F.col("p_partkey") % 2 == 0
    text = F.when(even, F.concat(F.lit('["a", "'), "p_brand", F.lit('"]'))).otherwise('{"no": 1')
    return table(spark, d, "part").select("p_partkey", T.json_strings(text).alias("deps"), T.strip_generics(F.concat("p_name", F.lit("<T>"))).alias("plain"), T.trim_quotes(F.concat(F.lit("<\""), "p_type", F.lit("\">"))).alias("path"))


@query(f"""WITH s AS ({SYMBOLS}), e AS ({EDGES}), f AS (SELECT id, codebase_id FROM s) SELECT e.source_id, e.target_id, e.kind, min(line) AS line FROM e JOIN f a ON a.id = e.source_id JOIN f b ON b.id = e.target_id WHERE a.codebase_id = b.codebase_id AND e.source_id <> e.target_id GROUP BY ALL""")
def resolved_within_codebases(spark, d):
    s = symbols(spark, d).select("id", "codebase_id", F.concat(F.lit("m."), "id").alias("qualified"))
    own = s.select(F.col("id").alias("source_id"), "codebase_id")
    raw = edges(spark, d).join(own, "source_id").select("codebase_id", F.concat(F.lit("m."), "source_id").alias("source_qualified"), F.concat(F.lit("*m."), "target_id").alias("target_name"), "kind", "line", F.lit("f").alias("filepath"), F.col("line").alias("ord"))
    return graph.resolve(raw, s, ("codebase_id",)).select("source_id", "target_id", "kind", "line")


@query("SELECT doc_id, lang codebase_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY 'src/' || source || '/doc_' || doc_id || '.py') - 1) // 64 AS BIGINT) batch FROM documents WHERE (SELECT max(s) FROM (SELECT sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) s FROM documents)) < 4194304")
def upload_batches(spark, d):
    return tree.upload_batches(files(spark, d)).select("doc_id", "codebase_id", "batch")
