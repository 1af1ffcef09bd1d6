"""Edges between symbols: resolution, references, dependents, bounded hierarchies, enclosing spans, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkatlas.functions import text as T
from sparkatlas.plans.tables import dropped, written


def resolve(raw: DataFrame, symbols: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Raw edges (source_qualified, target_name, kind, line, filepath, ord) with ids for both ends.

    A source is a qualified name; a target is a qualified name, one without one leading *, or a short name (smallest id);
    names count within equal columns of scope, as the codebase. Edges without either end and self-edges go; of equal
    (source, target, kind) the first by ord stays. Each distinct name is resolved once, so that a name with a large part
    of all edges isn't moved in the course of it. Names and the result are written, each by small tasks,
    so that no task holds the sorts of both: a sort holds a page of 64 MB at least.
    """
    scope = list(scope)
    whole = symbols.groupBy(*scope, F.col("qualified").alias("name")).agg(F.max("id").alias("id"))
    short = symbols.groupBy(*scope, T.short_name(F.col("qualified")).alias("name")).agg(F.min("id").alias("id"))
    names = raw.select(*scope, F.col("target_name").alias("name")).distinct().withColumn("bare", F.regexp_replace("name", r"^\*", ""))
    found = names.join(whole.withColumnRenamed("id", "one"), [*scope, "name"], "left").join(short.withColumnRenamed("id", "three"), [*scope, "name"], "left")
    found = found.join(whole.select(*scope, F.col("name").alias("bare"), F.col("id").alias("two")), [*scope, "bare"], "left")
    found = found.select(*scope, F.col("name").alias("target_name"), F.coalesce("one", "two", "three").alias("target_id")).where("target_id IS NOT NULL")
    found = written(found, "resolved-names", small_tasks=True)
    edges = raw.join(found, [*scope, "target_name"]).join(whole.select(*scope, F.col("name").alias("source_qualified"), F.col("id").alias("source_id")), [*scope, "source_qualified"])
    edges = edges.where("source_id <> target_id")
    first = edges.groupBy(*scope, "source_id", "target_id", "kind").agg(F.min(F.struct("ord", "filepath", "line")).alias("f"))
    out = written(first.select(*scope, "source_id", "target_id", "kind", "f.filepath", "f.line"), "resolved", small_tasks=True)
    dropped(found)
    return out


def references(edges: DataFrame, symbols: DataFrame, targets: DataFrame, kind: str = "any", limit: int = 20) -> DataFrame:
    """The symbols with an edge to one of a few target ids."""
    edges = edges if kind in ("", "any") else edges.where(F.col("kind") == kind)
    hits = edges.join(F.broadcast(targets.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    out = hits.join(symbols.select(F.col("id").alias("source_id"), "qualified"), "source_id")
    return out.select("source_id", "qualified", "kind", "line").orderBy("qualified", "source_id", "kind", "line").limit(limit)


def dependents(edges: DataFrame, symbols: DataFrame, filepath: str, limit: int = 20) -> DataFrame:
    """Files whose symbols have an edge into a file's symbols, other than itself."""
    target = symbols.where(F.col("filepath") == filepath).select(F.col("id").alias("target_id"))
    source = symbols.where(F.col("filepath") != filepath).select(F.col("id").alias("source_id"), F.col("filepath").alias("dependent"))
    return edges.join(target, "target_id", "left_semi").join(source, "source_id").select("dependent").distinct().orderBy("dependent").limit(limit)


def named_hierarchy(symbols: DataFrame, edges: DataFrame, name: str, direction: str = "both", depth: int = 5) -> DataFrame:
    """id, qualified, kind, depth and direction around the class or struct whose name is most like `name` (or is it)."""
    depth = depth if depth > 0 else 5
    own = symbols.where(F.col("kind").isin("class", "struct"))
    like = T.similarity(T.trigrams(F.col("qualified")), T.trigrams(F.lit(name)))
    seed = own.where((like >= T.TRIGRAM_THRESHOLD) | (T.short_name(F.col("qualified")) == name)).orderBy(like.desc(), "id").limit(1).select("id").collect()
    if not seed:
        return symbols.select("id", "qualified", "kind", F.lit(0).alias("depth"), F.lit("self").alias("direction")).limit(0)
    got = hierarchy(edges.where("kind = 'inherits'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")), seed[0]["id"], direction or "both", depth)
    return got.join(symbols.select("id", "qualified", "kind"), "id").select("id", "qualified", "kind", "depth", "direction")


def hierarchy(edges: DataFrame, seed, direction: str = "both", depth: int = 5) -> DataFrame:
    """id, least depth and direction (self, parent, child) of what child -> parent edges (child, parent) reach from one id, level by level.

    Each level joins only what is new, so that paths don't multiply, and is written, so that plans don't either; the steps
    are written once. Of two directions at equal depth parent stays.
    """
    up = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("direction"))
    down = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("child").alias("direction"))
    steps = {"parents": up, "children": down, "both": up.unionByName(down)}[direction].where("src <> dst")
    steps = written(steps, "hierarchy-steps")
    seen = edges.sparkSession.createDataFrame([(seed, 0, "self")], f"id {edges.schema['child'].dataType.simpleString()}, depth int, direction string")
    front = seen
    for level in range(1, depth + 1):
        new = steps.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("direction").alias("direction"))
        front = written(new.join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth"), "direction"), "hierarchy")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def enclosing(points: DataFrame, spans: DataFrame, key: str, point: str = "line", first: str = "line_start", last: str = "line_end", order: str = "ord") -> DataFrame:
    """The narrowest span of the same key around each point, the earliest of equals: an equi-join with a residual."""
    hit = points.join(spans, key).where(F.col(point).between(F.col(first), F.col(last)))
    return hit.groupBy(key, point).agg(F.min(F.struct((F.col(last) - F.col(first)).alias("width"), order)).alias("m")).select(key, point, F.col(f"m.{order}").alias(order))


def owner_asof(points: DataFrame, owners: DataFrame, key: str, at: str, owner: str) -> DataFrame:
    """The last owner strictly before each point of the same key, by one sort: no pair of rows is ever made."""
    every = points.select(key, at, F.lit(None).cast(owners.schema[owner].dataType).alias(owner), F.lit(0).alias("_side"), *[c for c in points.columns if c not in (key, at)])
    rest = [c for c in points.columns if c not in (key, at)]
    marks = owners.select(key, at, owner, F.lit(1).alias("_side"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest])
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return every.unionByName(marks).withColumn("_own", F.last(owner, True).over(w)).where("_side = 0").select(*points.columns, F.col("_own").alias(owner))
