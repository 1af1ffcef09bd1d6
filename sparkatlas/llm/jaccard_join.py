"""An exact similarity join of documents under the Jaccard metric, by pivots and regions.

Sets of word n-grams are compared; sets that are equal are one class and go on once. Then

1. Regions. Each n-gram is a pivot (the set of it alone). All pivots that a set holds are equally near to it; a global
   order (n-grams of many windows last, then by hash) breaks the tie, so the first is its Voronoi region. By the triangle
   inequality two linked sets differ in few n-grams, so that a set, copied to the regions of its first n - ceil(T n) + 1
   n-grams (the boundary window), meets every set that it links to.
2. Parities. A set's MARKS bits say of each of as many shares of all n-grams whether it holds an odd number of them. Two
   sets differ in as many n-grams at least as their bits do: pairs that this puts apart are never measured.
3. Pivot rounds. In each region the smallest class is the pivot document. Every set whose component isn't the pivot's
   measures its exact distance to the pivot with which it shares most regions; those within reach link, and components grow.
4. Small regions (SMALL classes at most) are leaves: their pairs of different components are measured, unless they share
   too few regions to reach the overlap of a link, or both distances to a common pivot document are known and differ by
   more than the reach (triangle inequality).
5. Larger regions are joined into clusters, and partitioned again: by size into rings around the empty set, as wide as
   the reach, so that links are within a ring or between neighbours. A cell (two blocks of rings) is split recursively by
   the distances of the bits to a new pivot document each time, with windows as wide as the reach at the cut. Sets without
   a partner there, and none by WIDE bits, are done; the others go through rings around the cluster's pivot document, in blocks of CELL n-grams.
   A cell compares two blocks in place and returns links only.

Every link between different components is thereby looked at; links inside a component change nothing. Distances are
computed from whole sets. Hashes have 64 bits.

Documents without words are linked with nothing; with fewer words than n the whole sequence is one n-gram. Null ids keep
a null component. Rows of one id are one vertex. Texts of any length are read whole, in slices of whole texts. Columns of
other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import storage
from sparkatlas.llm import words as W
from sparkatlas.llm.components import components

#: Rounds with pivot documents before the leaves.
ROUNDS = 2
#: N-grams in the windows of more classes than this are put last in the order, MOST_LAST of them at most; counting and putting last is done ORDERS times.
CROWD = 48
MOST_LAST = 1 << 20
ORDERS = 1
SMALL = 48
CELL = 500_000
#: Sets of a block of a ring, and blocks of a ring at most (then the blocks are larger); sets that are compared without a split.
BLOCK, BLOCKS, LEAF = 1024, 64, 256
#: Sets that are compared with one copy of a pivot document.
STAR = 200
MARKS = 512
#: Bits of the sets that MARKS leave in cells: of long sets (1,600 n-grams or more) so few bits tell nothing.
WIDE = 1 << 14
BITS = [f"s{k}" for k in range(MARKS // 64)]


def shingle_sets(part: W.Part, n: int):
    """(text number, sorted distinct n-gram hashes) of each text with words."""
    words = part.hashes()
    grams = W.windows(words, n)
    for k in range(part.n):
        a, b = part.at[k], part.at[k + 1]
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            yield k, own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = words[a:b]
            yield k, W.mix(W.windows(own, b - a) + W.U(b - a))


def class_of(grams: np.ndarray) -> int:
    return int(W.mix(W.mix(grams).sum(dtype=W.U)[None] + W.U(len(grams)))[0].view(np.int64))


def parities(grams: np.ndarray, marks: int = MARKS) -> np.ndarray:
    """marks bits (a power of two) as longs."""
    odd = np.bincount((grams & W.U(marks - 1)).astype(np.int64), minlength=marks) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def window(grams: np.ndarray, percent: int, last: np.ndarray | None = None) -> np.ndarray:
    """The n-grams of whose regions a set is a member: so many that it shares one with any set it links to."""
    size = len(grams) - -(-percent * len(grams) // 100) + 1
    if last is not None and len(last):
        late = held(last, grams)
        grams = np.concatenate([grams[~late], grams[late]])
    return grams[:size]


def held(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, W.U), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def surveyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row (a hash of it), tag (a number of its own), n, c, keys (the window) and the bits for each row of doc_id, text; a written table."""
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("row"), "text")
    zero = F.lit(0).cast("long")
    shape = rows.drop("text").withColumns({"tag": zero, "n": zero, "c": zero, "keys": F.lit(None).cast("array<long>"), **{b: zero for b in BITS}}).schema

    def run(batches):
        tag = TaskContext.get().partitionId() << 33
        for batch in batches:
            size, c, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [np.zeros(0, W.U)] * batch.num_rows
            bits = np.zeros((batch.num_rows, len(BITS)), np.int64)
            for part in W.parts(batch.column(2), lower=True):
                for k, grams in shingle_sets(part, n):
                    at = part.row + k
                    size[at], c[at], keys[at], bits[at] = len(grams), class_of(grams), window(grams, percent).copy(), parities(grams)
            tags = pa.array(np.arange(tag, tag + batch.num_rows))
            tag += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tags, pa.array(size), pa.array(c), lists(keys), *map(pa.array, bits.T.copy())], shape.names)

    return storage.written(rows.mapInArrow(run, shape), "jaccard-survey")


def reordered(docs: DataFrame, n: int, percent: int, last: np.ndarray) -> DataFrame:
    """c, row, n and keys (the window, n-grams of last put last) of each row of doc_id, text with words. Texts aren't shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        for batch in batches:
            for part in W.parts(batch.column(1), lower=True):
                got = [(part.row + k, grams) for k, grams in shingle_sets(part, n)]
                if got:
                    rows = batch.column(0).take(pa.array([k for k, _ in got]))
                    columns = [pa.array([f(g) for _, g in got], pa.int64()) for f in (class_of, len)]
                    keys = lists([window(g, percent, sent.value) for _, g in got])
                    yield pa.RecordBatch.from_arrays([columns[0], rows, columns[1], keys], ["c", "row", "n", "keys"])

    return docs.select(F.xxhash64("doc_id").alias("row"), "text").mapInArrow(run, "c long, row long, n long, keys array<long>")


class Sets:
    """The sets of some classes, made again from one document each."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int, repeated: bool):
        """classes: a written table of c and row. repeated: whether rows of one id may be the same."""
        rows = docs.select(F.xxhash64("doc_id").alias("row"), "text").join(storage.hinted(classes.select("row", "c"), 16), "row")
        self.rows = rows.select("c", "row", "text").distinct() if repeated else rows.select("c", "row", "text")
        self.n, self.percent = n, percent

    def mapped(self, make, shape: str) -> DataFrame:
        """c, row and what make(n-grams of some sets) gives."""
        n, names = self.n, [x.split()[0] for x in shape.split(", ")]

        def run(batches):
            for batch in batches:
                want = batch.column(0).to_numpy()
                for part in W.parts(batch.column(2), lower=True):
                    got = [(part.row + k, grams) for k, grams in shingle_sets(part, n) if class_of(grams) == want[part.row + k]]
                    if got:
                        own = batch.take(pa.array([k for k, _ in got]))
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *make([g for _, g in got])], names)

        return self.rows.mapInArrow(run, shape)

    def grams(self) -> DataFrame:
        return self.mapped(lambda sets: [pa.array([g.tobytes() for g in sets], pa.binary())], "c long, row long, grams binary").select("c", "grams")


def measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """p, c, shared, n, m for each of pairs (p, c; a written table): the sets' sizes and that of their intersection.

    A pivot that many sets are compared with has a copy for each STAR of them.
    """
    k = pairs.count()
    crowd = pairs.groupBy("p").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")).where("parts > 1")  # k / STAR rows at most
    crowd = F.broadcast(crowd) if k // STAR * (16 + storage.ROW_BYTES) <= storage.BROADCAST_BYTES else crowd
    spread = pairs.join(crowd, "p", "left").select("p", F.coalesce(F.pmod(F.xxhash64("c"), F.col("parts")), F.lit(0)).alias("part"), "c")
    wanted = spread.unionByName(spread.select("p", "part", F.col("p").alias("c")).distinct())
    wanted = F.broadcast(wanted) if 2 * k * (24 + storage.ROW_BYTES) <= storage.BROADCAST_BYTES else wanted

    def compare(batches):
        now, pivot = None, None
        for batch in batches:
            p, c, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            out = []
            for k in range(len(p)):
                own = np.frombuffer(grams[k].as_buffer(), W.U)
                if p[k] == c[k]:
                    now, pivot = p[k], own
                elif p[k] == now:
                    out.append((p[k], c[k], int(held(pivot, own).sum()), len(pivot), len(own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["p", "c", "shared", "n", "m"])

    rows = sets.join(wanted, "c").select("p", "part", "c", "grams", (F.col("p") != F.col("c")).alias("later"))
    return rows.repartition("p", "part").sortWithinPartitions("p", "part", "later").select("p", "c", "grams").mapInArrow(compare, "p long, c long, shared long, n long, m long")


def fits(percent: int):
    """Whether two sizes n and m allow a link."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def close(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, c and more) whose bits allow a link; marks: c, n and the bits of each class."""
    mine = marks.select(F.col("c"), F.col("n").alias("_n"), *BITS)
    other = marks.select(F.col("c").alias("p"), F.col("n").alias("_m"), *[F.col(b).alias(f"_{b}") for b in BITS])
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"_{b}"))) for b in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(f"_{BITS[0]}"))))
    return pairs.join(mine, "c").join(other, "p").where((100 + percent) * apart <= (100 - percent) * (F.col("_n") + F.col("_m"))).select(*pairs.columns)


def linked(tested: DataFrame, percent: int) -> DataFrame:
    return tested.where(100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared"))).select(F.col("p").alias("a"), F.col("c").alias("b"))


def labelled(members: DataFrame, own: DataFrame | None) -> DataFrame:
    if own is None:
        return members.withColumn("component", F.col("c"))
    own = storage.hinted(own, 16).withColumnRenamed("node", "c")
    return members.join(own, "c", "left").withColumn("component", F.coalesce("component", "c"))


def representatives(survey: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
    """The survey's rows of one document of each class; and tag, row of the others (a written table)."""
    survey = survey.where("n > 0")
    classes = kept(survey.groupBy("c").agg(F.min("tag").alias("least"), F.count("*").alias("k")).where("k > 1").select("c", "least"), "jaccard-classes")
    copies = kept(survey.select("c", "tag", "row").join(storage.hinted(classes, 16), "c").where("tag <> least").select("tag", "row"), "jaccard-copies")
    return survey.join(storage.hinted(copies.select("tag"), 8), "tag", "left_anti").select("c", "row", "n", "keys", *BITS), copies


def regions(docs: DataFrame, base: DataFrame, copies: DataFrame, n: int, percent: int, repeated: bool, kept) -> tuple[DataFrame, DataFrame]:
    """c, row, n, keys of all classes, with crowded n-grams put last; and key, size of all regions of two classes or more.

    base (a written table) is deleted once the windows are made again.
    """
    windows, last = base, np.zeros(0, W.U)
    counted = lambda: kept(windows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-keys")
    sizes = counted()
    for _ in range(ORDERS):
        crowd = sizes.where(F.col("size") > CROWD).orderBy(F.desc("size"), "key").limit(MOST_LAST - len(last)).select("key").toArrow().column(0).to_numpy().view(W.U)
        crowd = crowd[~held(last, crowd)]
        if not len(crowd):
            break
        last = np.sort(np.concatenate([last, crowd]))
        storage.dropped(windows, sizes)
        every = reordered(docs, n, percent, last)
        one = every.dropDuplicates(["c"]) if repeated else every.join(storage.hinted(copies.select("row"), 8), "row", "left_anti")
        windows = kept(one.select("c", "row", "n", "keys"), "jaccard-windows")
        sizes = counted()
    return windows, sizes


def links(docs: DataFrame, survey: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links of classes whose components are those of all links; a written table. The survey is deleted once it is read."""
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(storage.written(df, name))
        return made[-1]

    repeated = not survey.groupBy("row").count().where("count > 1").isEmpty()
    base, copies = representatives(survey, kept)
    base = kept(base, "jaccard-windows")
    storage.dropped(survey)
    marks = kept(base.select("c", "row", "n", *BITS), "jaccard-marks")
    rows, marks = marks.select("c", "row"), marks.drop("row")
    windows, sizes = regions(docs, base, copies, n, percent, repeated, kept)
    members = kept(windows.select(F.explode("keys").alias("key"), "c", "n").join(sizes, "key"), "jaccard-members")
    storage.dropped(windows, sizes)
    pairs = kept(close(candidates(members, percent), marks, percent), "jaccard-candidates")
    near = pairs.select("c").unionByName(pairs.select(F.col("p").alias("c"))).unionByName(members.where(F.col("size") > SMALL).select("c")).distinct()
    near = kept(rows.join(near, "c", "left_semi"), "jaccard-near")
    first, members = members, kept(members.join(storage.hinted(near.select("c"), 8), "c", "left_semi"), "jaccard-members")
    storage.dropped(first)
    sets = kept(Sets(docs, near, n, percent, repeated).grams(), "jaccard-sets")

    tested = kept(spark.createDataFrame([], "p long, c long, shared long, n long, m long"), "jaccard-tested")
    own = None
    for _ in range(ROUNDS):
        rows = labelled(members, own)
        pivot = rows.groupBy("key").agg(F.min(F.struct("c", "n", "component")).alias("x")).select("key", F.col("x.c").alias("p"), F.col("x.n").alias("m"), F.col("x.component").alias("at"))
        # the pivots are a table of their own, so that the skewed partitions of a region of many sets can be split
        stars = rows.join(kept(pivot, "jaccard-pivots"), "key").where((F.col("component") != F.col("at")) & fits(percent)).groupBy("p", "c").count()
        stars = stars if own is None else stars.join(tested.select("p", "c"), ["p", "c"], "left_anti")
        stars = close(stars, marks, percent)
        stars = kept(stars.groupBy("c").agg(F.max_by("p", F.struct("count", "p")).alias("p")).select("p", "c"), "jaccard-stars")
        if stars.isEmpty():
            break
        tested = kept(tested.unionByName(measured(sets, stars)), "jaccard-tested")
        own = components(linked(tested, percent))
        made.append(own)

    leaves = labelled(labelled(pairs, own).select("p", F.col("c").alias("_c"), F.col("component").alias("_at")).withColumnRenamed("p", "c"), own)
    leaves = leaves.where("component <> _at").select(F.col("c").alias("p"), F.col("_c").alias("c"))
    leaves = kept(pruned(leaves, tested, percent), "jaccard-leaves")
    if not leaves.isEmpty():
        tested = kept(tested.unionByName(measured(sets, leaves)), "jaccard-tested")
        own = components(linked(tested, percent))
        made.append(own)
    out = linked(tested, percent)
    rows = labelled(members.where(F.col("size") > SMALL), own)
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("c").alias("least")).where("x <> y").select("key", "least")
    many = kept(rows.join(storage.hinted(kept(mixed, "jaccard-mixed"), 16), "key").select("c", "n", "component", "least").distinct(), "jaccard-many")
    if not many.isEmpty():
        cluster = components(many.select(F.col("c").alias("a"), F.col("least").alias("b")))
        made.append(cluster)
        many = kept(many.select("c", "n", "component").distinct().join(cluster.select(F.col("node").alias("c"), F.col("component").alias("p")), "c"), "jaccard-clusters")
        some = kept(partnered(many, marks, percent), "jaccard-partnered")
        if not some.isEmpty():
            many = kept(many.join(storage.hinted(some, 8), "c", "left_semi"), "jaccard-clusters")
            wide = kept(sharper(sets.join(storage.hinted(some, 8), "c", "left_semi")), "jaccard-wide")
            some = kept(partnered(many, wide, percent), "jaccard-partnered")
        if not some.isEmpty():
            out = out.unionByName(cells(sets, many.join(storage.hinted(some, 8), "c", "left_semi"), tested, percent, kept))
    out = storage.written(out, "jaccard-links")
    storage.dropped(*made)
    return out


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """p, c: pairs within a small region that share regions enough for a link."""
    few = members.where(F.col("size") <= SMALL).select("key", "c", "n").repartition("key").sortWithinPartitions("key")
    pairs = few.mapInArrow(region_pairs(percent), "p long, c long, n long, m long, k long")
    pairs = pairs.groupBy("p", "c").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("k").alias("k"))
    large = members.where(F.col("size") > SMALL).groupBy("c").agg(F.count("*").alias("large"))
    pairs = pairs.join(large, "c", "left").join(large.select(F.col("c").alias("p"), F.col("large").alias("large_p")), "p", "left")
    # of the set whose window ends first, all n-grams in common that its window holds are keys of both
    most = F.col("k") + F.least(F.coalesce("large", F.lit(0)), F.coalesce("large_p", F.lit(0))) + F.ceil(percent * F.greatest("n", "m") / 100) - 1
    return pairs.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("p", "c")


def region_pairs(percent: int):
    """Pairs within each small region, sizes permitting, with their sizes and how many regions they share, from rows sorted by key."""

    def run(batches):
        key, rows, shared, size = None, [], {}, {}

        def pairs():
            for i, (c, n) in enumerate(rows):
                for d, m in rows[i + 1 :]:
                    if 100 * min(n, m) >= percent * max(n, m):
                        pair = (c, d) if c < d else (d, c)
                        shared[pair] = shared.get(pair, 0) + 1
                        size[c], size[d] = n, m

        def flushed():
            out = [(c, d, size[c], size[d], k) for (c, d), k in shared.items()]
            shared.clear()
            size.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["p", "c", "n", "m", "k"])

        for batch in batches:
            for k, *row in zip(*(x.to_numpy().tolist() for x in batch.columns), strict=True):
                if k != key:
                    pairs()
                    key, rows = k, []
                    if len(shared) > 300_000:
                        yield flushed()
                rows.append(row)
        pairs()
        yield flushed()

    return run


def pruned(pairs: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs not yet measured and not excluded by their distances to a pivot that both were measured against."""
    far = tested.select("p", "c", (1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("far"))
    mine = far.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("p", "far"))).alias("to"))
    out = pairs.join(mine.withColumnRenamed("to", "to_c"), "c", "left").join(mine.select(F.col("c").alias("p"), F.col("to").alias("to_p")), "p", "left")
    apart = F.exists(F.map_keys("to_c"), lambda k: F.abs(F.element_at("to_c", k) - F.element_at("to_p", k)) > 1 - percent / 100 + 1e-9)
    known = F.coalesce(F.map_contains_key("to_c", F.col("p")), F.lit(False)) | F.coalesce(F.map_contains_key("to_p", F.col("c")), F.lit(False))
    return out.where(~known & ~F.coalesce(apart, F.lit(False))).select("p", "c")


def dealt(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """members (p, ring, c and more) copied to the cells (p, i, x, j, y) of two blocks, of a ring or of neighbours, that they are in.

    blocks: p, ring and the number of blocks of each. side: 1 in the second block of a cell of two.
    """
    near = lambda step: blocks.select("p", (F.col("ring") - step).alias("ring"), F.col("blocks").alias(f"blocks{step}"))
    rest = [c for c in members.columns if c not in ("p", "ring")]
    for step in (-1, 0, 1):
        members = members.join(near(step), ["p", "ring"], "left")
    cell = lambda ring, a, next_ring, b, side: F.struct(ring.alias("i"), a.cast("int").alias("x"), next_ring.alias("j"), b.cast("int").alias("y"), F.lit(side).alias("side"))
    one, ring = F.lit(1), F.col("ring")
    members = members.withColumn("me", F.pmod(F.xxhash64("c"), F.col("blocks0")).cast("int"))
    me = F.col("me")
    to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(
        F.transform(F.sequence(me, F.col("blocks0") - 1), lambda b: cell(ring, me, ring, b, 0)),
        F.transform(to(me), lambda b: cell(ring, b, ring, me, 1)),
        F.transform(to(F.col("blocks1")), lambda b: cell(ring, me, ring + one, b, 0)),
        F.transform(to(F.col("blocks-1")), lambda b: cell(ring - one, b, ring, me, 1)),
    )
    return members.select("p", *rest, F.explode(places).alias("at")).select(*CELL_KEY[:1], "at.*", *rest)


CELL_KEY = ["p", "i", "x", "j", "y"]


def sharper(sets: DataFrame) -> DataFrame:
    """c and WIDE bits of each of sets."""

    def run(batches):
        for batch in batches:
            wide = [parities(np.frombuffer(g.as_buffer(), W.U), WIDE).tobytes() for g in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.binary())], ["c", "wide"])

    return sets.select("c", "grams").mapInArrow(run, "c long, wide binary")


def partnered(clusters: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """c: the classes of a cluster (p) to whose bits those of another component's are near enough for a link.

    marks: c and bits, as longs or as one binary column.
    """
    marks = marks.drop("n")
    width = np.log(100 / percent) * 1.001  # linked sizes are in one ring or in neighbours
    members = clusters.withColumn("ring", F.floor(F.ln("n") / width).cast("int"))
    blocks = members.groupBy("p", "ring").agg(F.least(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    rows = dealt(members, blocks).join(marks, "c").select(*CELL_KEY, "side", "c", "n", "component", *[x for x in marks.columns if x != "c"])

    def run(batches):
        for key, rows in grouped(batches, len(CELL_KEY)):
            side, c, n, component, *bits = (x.to_numpy() for x in rows.columns[len(CELL_KEY) :])
            bits = np.stack(bits, 1) if len(bits) > 1 else np.stack([np.frombuffer(x, np.int64) for x in bits[0]])
            hit = Cell(bits.view(W.U), n, component, percent).partners(side, key[1:3] == key[3:5])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[hit])], ["c"])

    return rows.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY).mapInArrow(run, "c long").distinct()


def grouped(batches, k: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of equal first k columns, by which they are sorted."""
    key, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(i).to_numpy() for i in range(k)])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = tuple(at[:, a].tolist())
            if now != key and rows:
                yield key, pa.Table.from_batches(rows)
                rows = []
            key = now
            rows.append(batch.slice(a, b - a))
    if rows:
        yield key, pa.Table.from_batches(rows)


class Cell:
    """Bits, sizes and components of some sets, and which have a partner: one of another component within reach of it."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, component: np.ndarray, percent: int):
        self.bits, self.n, self.component, self.percent = bits, n, component, percent
        self.hit = np.zeros(len(n), bool)

    def partners(self, side: np.ndarray, same: bool) -> np.ndarray:
        every = np.arange(len(self.n))
        a, b = (every, every) if same else (every[side == 0], every[side == 1])
        if len(a) and len(b):
            self.compare(a, b)
        return self.hit

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Of a with b: split by the distance to a pivot document, with a window on both sides of the cut, until few are left."""
        if len(a) <= LEAF and len(b) <= LEAF:
            step = max(1, (1 << 20) // (len(b) * self.bits.shape[1]))  # 8 MB at once
            for part in (a[k : k + step] for k in range(0, len(a), step)):
                far = np.bitwise_count(self.bits[part][:, None] ^ self.bits[b]).sum(2, dtype=np.int64)
                near = ((100 + self.percent) * far <= (100 - self.percent) * (self.n[part][:, None] + self.n[b])) & (self.component[part][:, None] != self.component[b])
                self.hit[part] |= near.any(1)
                self.hit[b] |= near.any(0)
            return
        pivot = self.bits[a[len(a) // 2]]
        da, db = (np.bitwise_count(self.bits[x] ^ pivot).sum(1, dtype=np.int64) for x in (a, b))
        reach = (100 - self.percent) * (int(self.n[a].max()) + int(self.n[b].max())) // (100 + self.percent)
        cut = int(np.median(np.concatenate([da, db])))
        inner, outer = lambda x, d: x[(d <= cut) & (d >= cut - reach)], lambda x, d: x[(d > cut) & (d <= cut + reach)]
        parts = [(a[da <= cut], b[db <= cut]), (a[da > cut], b[db > cut]), (inner(a, da), outer(b, db)), (outer(a, da), inner(b, db))]
        if any(len(x) and len(y) and 10 * (len(x) + len(y)) > 9 * (len(a) + len(b)) for x, y in parts):  # hardly split, as most are equally far: halves by number
            x, y = (len(a) + 1) // 2, (len(b) + 1) // 2
            parts = [(a[:x], b[:y]), (a[:x], b[y:]), (a[x:], b[:y]), (a[x:], b[y:])]
        for x, y in parts:
            if len(x) and len(y):
                self.compare(x, y)


def cells(sets: DataFrame, members: DataFrame, tested: DataFrame, percent: int, kept) -> DataFrame:
    """a, b: links between different components among the classes of clusters. members: p (a class, the cluster's pivot), c, n and component."""
    reach = 1 - percent / 100
    members = kept(members, "jaccard-clusters")
    todo = kept(members.where("c <> p").select("p", "c").join(tested.select("p", "c"), ["p", "c"], "left_anti"), "jaccard-todo")
    far = tested.unionByName(measured(sets, todo)).select("p", "c", F.floor((1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))) / reach).cast("int").alias("ring"))
    members = kept(members.join(far.distinct(), ["p", "c"], "left").withColumn("ring", F.coalesce("ring", F.lit(0))), "jaccard-rings")
    blocks = members.groupBy("p", "ring").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks"))
    sets = sets.join(storage.hinted(members.select("c"), 8), "c", "left_semi")
    rows = dealt(members.drop("n"), blocks).join(sets, "c").select(*CELL_KEY, "side", "c", "component", "grams")
    return rows.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "side", "c").mapInArrow(compared(percent), "a long, b long")


def compared(percent: int):
    """Links of each cell, as many as its components need."""

    def run(batches):
        for key, rows in grouped(batches, len(CELL_KEY)):
            side, c, component = (rows.column(k).to_numpy().tolist() for k in (5, 6, 7))
            grams = [np.frombuffer(x.as_buffer(), W.U) for x in rows.column(8)]
            yield from in_cell(list(zip(side, c, component, grams, strict=True)), key, percent)

    return run


def in_cell(rows: list, key: list | None, percent: int):
    if len(rows) < 2:
        return
    same = key[1:3] == key[3:5]  # one block with itself
    side = np.array([r[0] for r in rows])
    size = np.array([len(r[3]) for r in rows])
    grams = np.concatenate([r[3] for r in rows])
    of = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(grams, kind="stable")
    first = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1]))
    count = np.diff(np.append(first, len(order)))
    number = np.empty(len(grams), np.int64)
    number[order] = np.repeat(np.arange(len(first)), count)
    posting = of[order]
    start = np.concatenate([[0], np.cumsum(size)])
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for k, (s, c, component, _) in enumerate(rows):
        if s and not same:
            continue
        mine = number[start[k] : start[k + 1]]
        mine = mine[count[mine] > 1]
        n = count[mine]
        if not len(n):
            continue
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(posting[at], minlength=len(rows))
        hit = 100 * shared >= percent * (size + size[k] - shared)
        hit[: k + 1] &= not same
        hit &= same | (side == 1)
        for d in np.flatnonzero(hit):
            x, y = root(component), root(rows[d][2])
            if x != y:
                group[x] = y
                out.append((c, rows[d][1]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def join(docs: DataFrame, text: str = "text", ident: str = "doc_id", n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links lead to, for every row of docs."""
    storage.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    survey = surveyed(docs, n, percent)
    every = storage.written(survey.select("doc_id", "n", "c"), "jaccard-rows")
    own = components(links(docs, survey, n, percent))
    every = every.join(storage.hinted(own, 16), F.col("c") == F.col("node"), "left").drop("node")
    every = every.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "c")))
    # several rows of one id are one vertex
    mixed = every.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    mixed = storage.written(mixed.select("doc_id", "a"), "jaccard-ids")
    if not mixed.isEmpty():
        more = components(every.join(mixed, "doc_id").where("component is not null").select("a", F.col("component").alias("b")))
        every = every.join(more.select("node", F.col("component").alias("joined")), F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("joined", "component"))
    least = every.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    least = storage.hinted(storage.written(least, "jaccard-least"), 40)
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "component").join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays, that of the smallest id; words are taken five at a time, at 0.8.

    Of the rows of one id one stays (the least by its text's hash); rows of null id all stay.
    """
    got = storage.written(join(docs, n=5, percent=80), "jaccard-stage")
    gone = storage.written(got.select("doc_id", "component_id").where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "jaccard-gone")
    kept = docs.join(storage.hinted(gone, 32), "doc_id", "left_anti").select(*docs.columns)
    twice = storage.written(got.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-twice")
    if twice.isEmpty():
        return kept
    several = kept.join(storage.hinted(twice, 32), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return kept.join(storage.hinted(twice, 32), "doc_id", "left_anti").unionByName(several.select("row.*")).select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') s FROM w, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id, doc_id c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, d.c component_id FROM (SELECT doc_id, min(c) c FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""
