"""Splits that keep related records together.

Records are linked by any of several keys. The distinct key pairs form a graph
whose components are contracted by Boruvka rounds: every component picks its
smallest outgoing edge, the picked edges join a spanning forest that is written
to the shared folder, and components merge along them. Work after the first
aggregation is in the number of distinct key pairs, not of records.

Defined cases: a null, blank or placeholder name and a null or non-positive id
link nothing; a record with neither is a group of its own; an empty table gives
empty results; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.cut import Lasting, Scratch, has_rows
from tessella.plans.spread import spread_join

#: Records of a deal's cycle, for groups of one record; for groups of 2 ** band records so many times more.
CYCLE = 40.0
# Spellings that stand for "no name".
PLACEHOLDERS = [
    "", "-", "--", "_", "?", ".", "n/a", "na", "nan", "nil", "none", "null", "missing",
    "no image", "no name", "not available", "tbd", "unknown", "undefined", "unnamed", "placeholder",
]


def usable_id(img_id: Column) -> Column:
    return F.when(img_id > 0, img_id)


def usable_name(name: Column) -> Column:
    """Folder and file in lower case, or null where the text names no image."""
    x = F.lower(name)
    x = F.regexp_replace(F.regexp_replace(x, "%(25)*2f", "/"), "%(25)*5c", "/")
    x = F.regexp_replace(x, r"[\\/]+", "/")
    x = F.regexp_replace(x, r"(?U)^[\s/]+|[\s/]+$", "")
    x = F.regexp_replace(x, r"(?U)\s*/\s*(\.\s*/\s*)*", "/")
    x = F.regexp_replace(x, r"^\./", "")
    return F.when(~x.isin(PLACEHOLDERS), F.regexp_extract(x, r"([^/]+/)?[^/]+$", 0))


def boruvka(edges: DataFrame, scratch: Scratch, store: Scratch | Lasting) -> tuple[DataFrame, list[DataFrame]]:
    """Components of an undirected graph.

    edges: (u, v, via) with u != v, each pair once, ``via`` naming the link that
    makes the edge. Returns the map (node, root), root being one node of the
    component, for every node that has an edge, and the rounds of the spanning
    forest (id_key, name_key, child, parent, degree): component ``child`` joins
    ``parent`` over the link id_key - name_key; a root is its own parent. Each
    round is written to ``store``, and what is read back from there is contracted,
    so the roots follow from the forest as it lies on disk.
    """
    spark = edges.sparkSession
    live = scratch.keep(edges.select("u", "v", F.struct(F.col("u").alias("u"), F.col("v").alias("v"), "via").alias("e")))
    comp = None
    parts = []
    while True:
        # the smallest edge of each component, by a total order of the original edges, so picks make no cycles but mutual ones
        ends = live.select(F.col("u").alias("c"), F.col("v").alias("other"), "e").union(live.select(F.col("v").alias("c"), F.col("u").alias("other"), "e"))
        picked = scratch.keep(ends.groupBy("c").agg(F.min(F.struct("e", "other")).alias("x"), F.count("*").alias("deg")).select("c", "x.e.via", F.col("x.e.v").alias("name"), "x.other", "deg"))
        if not has_rows(picked):
            break
        # of two components that pick each other the smaller one becomes the root and has no edge of its own
        back = picked.select(F.col("c").alias("bc"), F.col("other").alias("bo"))
        root = F.col("bc").isNotNull() & (F.col("c") < F.col("other"))
        step = picked.join(back, (F.col("other") == F.col("bc")) & (F.col("c") == F.col("bo")), "left").select(F.col("via").alias("id_key"), F.col("name").alias("name_key"), F.col("c").alias("child"), F.when(root, F.col("c")).otherwise(F.col("other")).alias("parent"), F.col("deg").alias("degree"))
        parts.append(store.keep(step))
        scratch.drop(picked)
        to = parts[-1]
        while True:  # pointer jumping until every component points at its root; a root that many point at is spread
            nxt = scratch.keep(spread_join(to, to, [("parent", "child")], None, F.xxhash64("child"), [("parent", "up")]).select("child", F.col("up").alias("parent"), "degree", (F.col("parent") != F.col("up")).alias("moved")))
            still = nxt.filter("moved").isEmpty()
            if to is not parts[-1]:
                scratch.drop(to)
            to = nxt
            if still:
                break
        if comp is None:
            new = scratch.keep(to.select(F.col("child").alias("node"), F.col("parent").alias("root")))
        else:
            new = scratch.keep(spread_join(comp, to, [("root", "child")], None, F.xxhash64("node"), ["parent"], "left").select("node", F.coalesce("parent", "root").alias("root")))
            scratch.drop(comp)
        comp = new
        # a component with very many edges is spread by its degree, which its pick has counted
        ends = spread_join(spread_join(live, to, [("u", "child")], "degree", F.xxhash64("v"), [("parent", "ru")]), to, [("v", "child")], "degree", F.xxhash64("u"), [("parent", "rv")])
        rest = ends.filter("ru <> rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e"))
        rest = scratch.keep(rest)
        scratch.drop(live)
        scratch.drop(to)
        live = rest
        if not has_rows(live):
            break
    if comp is None:
        comp = spark.createDataFrame([], edges.select(F.col("u").alias("node"), F.col("v").alias("root")).schema)
    return comp, parts


def _pairs(records: DataFrame) -> DataFrame:
    """One row per literal (img_id, img_name), with its keys, count and smallest rec_id."""
    got = records.select("rec_id", "img_id", "img_name").groupBy("img_id", "img_name").agg(F.min("rec_id").alias("first"), F.count("*").alias("n"))
    return got.withColumns({"ik": F.concat(F.lit("i"), usable_id(F.col("img_id")).cast("string")), "nk": F.concat(F.lit("n"), usable_name(F.col("img_name")))})


def image_groups(records: DataFrame, scratch: Scratch, forest_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of records that share an image.

    records: rec_id, img_id, img_name. Returns, as written tables, the literal
    pairs (img_id, img_name, ik, nk, n, group_id, size, same), where size counts
    the group's records and same tells that all have this one literal pair, and
    the spanning forest (id_key, name_key, child, parent, degree), which stays at
    forest_path for good if that is given. Pairs with no usable key are left out: each of their records is its
    own group.
    """
    pairs = scratch.keep(_pairs(records).filter("ik is not null or nk is not null"))
    edges = scratch.keep(pairs.filter("ik is not null and nk is not null").groupBy("ik", "nk").agg(F.count("*").alias("n")))
    # the first round for the id side: every id picks its smallest name and is contracted into it
    first = scratch.keep(edges.groupBy("ik").agg(F.min("nk").alias("lo"), F.max("nk").alias("hi"), F.count("*").alias("k")))
    several = scratch.keep(first.filter("lo <> hi").select("ik", "lo", "k"))
    store = Lasting(records.sparkSession, forest_path) if forest_path else Scratch(records.sparkSession, "forest")
    parts = [store.keep(first.select(F.col("ik").alias("id_key"), F.col("lo").alias("name_key"), F.col("ik").alias("child"), F.col("lo").alias("parent"), F.col("k").alias("degree")))]
    names = scratch.keep(spread_join(edges, several, ["ik"], "k", F.xxhash64("nk"), ["lo"]).filter("nk <> lo").groupBy(F.col("lo").alias("u"), F.col("nk").alias("v")).agg(F.min("ik").alias("via")))
    comp, rounds = boruvka(names, scratch, store)
    forest = reduce(DataFrame.unionByName, parts + rounds)
    nameless = spread_join(pairs.filter("nk is null"), first, ["ik"], None, F.xxhash64("img_name"), ["lo"], "left")
    linked = pairs.filter("nk is not null").withColumn("node", F.col("nk")).unionByName(nameless.withColumn("node", F.coalesce("lo", "ik")).drop("lo"))
    linked = scratch.keep(spread_join(linked, comp, ["node"], None, F.xxhash64("img_id", "img_name"), ["root"], "left").select("img_id", "img_name", "ik", "nk", "first", "n", F.coalesce("root", "node").alias("root")))
    groups = scratch.keep(linked.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("n").alias("size"), (F.count("*") == 1).alias("same"), F.count("*").alias("k")))
    out = scratch.keep(spread_join(linked, groups, ["root"], "k", F.xxhash64("img_id", "img_name"), ["group_id", "size", "same"]).select("img_id", "img_name", "ik", "nk", "n", "group_id", "size", "same"))
    for t in (pairs, edges, first, several, names, comp, linked, groups):
        scratch.drop(t)
    return out, forest


def attach(records: DataFrame, pairs: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Brings columns of the literal pairs to the records."""
    return spread_join(records, pairs, ["img_id", "img_name"], "n", F.col("rec_id"), columns, how)


def linked_groups(records: DataFrame) -> DataFrame:
    """(rec_id, group_id) of every record; group_id is the smallest rec_id of the group."""
    scratch = Scratch(records.sparkSession, "linked")
    pairs, _ = image_groups(records, scratch)
    got = attach(records.select("rec_id", "img_id", "img_name"), pairs, ["group_id"], "left")
    return got.select("rec_id", F.coalesce("group_id", "rec_id").alias("group_id"))


def found(records: DataFrame) -> DataFrame:
    """(rec_id, group_id) of the records whose group writes its image in more than one way."""
    scratch = Scratch(records.sparkSession, "linked")
    pairs, _ = image_groups(records, scratch)
    got = attach(records.select("rec_id", "img_id", "img_name"), scratch.keep(pairs.filter("not same")), ["group_id"])
    return got.select("rec_id", "group_id")


def spanning_forest(records: DataFrame, path: str | None = None) -> DataFrame:
    """(id_key, name_key): the links that alone hold every group together; the forest stays at path, if that is given."""
    _, forest = image_groups(records, Scratch(records.sparkSession, "linked"), path)
    return forest.filter("child <> parent").select("id_key", "name_key")


def deal(groups: DataFrame, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """(group_id, pairs, split) for groups (group_id, pairs, size).

    Groups above a hundredth of all records go to the split that is furthest
    below its share, largest first: fewer than a hundred of them. The others are
    banded by powers of two of their size and stand in each band in a seeded
    order. A band is dealt systematically, by running record count, in cycles of
    all splits, as far as its cycles are whole; what is left of all bands makes
    one more cycle, from a seeded start. So no split gains where bands are sparse.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.filter(F.col("size") > total / 100).orderBy(F.desc("size"), "group_id").collect()  # fewer than 100 rows
    left = {k: p * total for k, p in shares.items()}
    placed = []
    for r in large:
        k = max(left, key=lambda x: (left[x] - r["size"], left[x]))
        placed.append((r["group_id"], r["pairs"], k))
        left[k] -= r["size"]
    rest = sum(max(0.0, x) for x in left.values()) or 1.0
    cuts, run = [], 0.0
    for k, x in left.items():
        run += max(0.0, x) / rest
        cuts.append((k, run))
    small = groups.filter(F.col("size") <= total / 100).select("group_id", "pairs", "size", F.floor(F.log2("size")).cast("int").alias("band"), F.xxhash64(F.lit(seed), "group_id").alias("h"))
    slices = max(256, groups.count() // 500_000)
    small = small.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int"))
    inner = Window.partitionBy("band", "slice").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    # at most 64 bands x slices
    outer = Window.partitionBy("band").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = small.groupBy("band", "slice").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(outer), F.lit(0))).drop("s")
    cycle = F.lit(CYCLE) * F.pow(F.lit(2.0), F.col("band"))
    bands = small.groupBy("band").agg(F.sum("size").alias("s")).withColumn("whole", F.floor(F.col("s") / cycle) * cycle).orderBy(F.desc("band")).collect()  # at most 64 rows
    over, before = sum(r["s"] - r["whole"] for r in bands) or 1.0, 0.0
    where = []
    for r in bands:
        where.append((r["band"], float(r["whole"]), before / over))
        before += r["s"] - r["whole"]
    table = groups.sparkSession.createDataFrame(where, "band int, whole double, start double")
    at = F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    lined = small.join(F.broadcast(base), ["band", "slice"]).join(F.broadcast(table), "band").withColumn("at", at)
    turn = F.when(F.col("at") < F.col("whole"), F.col("at") / cycle).otherwise(F.col("start") + (F.col("at") - F.col("whole")) / over + F.pmod(F.xxhash64(F.lit(seed)), F.lit(1000)) / 1000)
    u = turn - F.floor(turn)
    pick = F.lit(cuts[-1][0])
    for k, c in reversed(cuts[:-1]):
        pick = F.when(u < c, k).otherwise(pick)
    dealt = lined.select("group_id", "pairs", pick.alias("split"))
    if not placed:
        return dealt
    return dealt.union(groups.sparkSession.createDataFrame(placed, "group_id bigint, pairs bigint, split string"))


def splits(records: DataFrame, shares: dict[str, float] | None = None, forest_path: str | None = None) -> DataFrame:
    """(rec_id, group_id, split) of every record, all records of a group in one split; the forest stays at forest_path, if that is given."""
    scratch = Scratch(records.sparkSession, "linked")
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    pairs, _ = image_groups(records, scratch, forest_path)
    lone = records.filter(usable_id(F.col("img_id")).isNull() & usable_name(F.col("img_name")).isNull())
    one = F.lit(1).cast("bigint")
    groups = pairs.groupBy("group_id", "size").agg(F.count("*").alias("pairs")).union(lone.select(F.col("rec_id").alias("group_id"), one.alias("size"), one.alias("pairs")))
    dealt = scratch.keep(deal(scratch.keep(groups), shares))
    named = scratch.keep(spread_join(pairs.select("img_id", "img_name", "n", "group_id"), dealt, ["group_id"], "pairs", F.xxhash64("img_id", "img_name"), ["split"]))
    linked = attach(records.select("rec_id", "img_id", "img_name").filter(usable_id(F.col("img_id")).isNotNull() | usable_name(F.col("img_name")).isNotNull()), named, ["group_id", "split"])
    alone = lone.select("rec_id").join(dealt.select("group_id", "split"), F.col("rec_id") == F.col("group_id")).select("rec_id", "group_id", "split")
    return linked.select("rec_id", "group_id", "split").union(alone)
