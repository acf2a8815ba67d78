"""Near-duplicate classes by MinHash with tensored banding.

A few collections of HASHES minimum hashes are made for each document; a table key is a pair of collections. With C
collections this gives C * (C - 1) / 2 tables of 2 * HASHES hashes each from C * HASHES hashes, about the square
root of what independent tables would take. Two documents of similarity J share a table if they agree on two
collections; at the threshold 0.75 a link is missed with a probability of 5e-6, above it with far less.

Documents of equal shingle sets are one document first. Collections' values that one document alone has are left out
before keys are formed, so a document without any likeness makes no keys. Candidates of a table are compared on
their whole shingle sets with the document of the table that shares most, so a large group of copies costs a star.

Tables that still hold several classes are joined to groups, and every link within a group is found by what its
members differ in. Let C be the shingles that most members have, lack what a member misses of C and own what it has
beyond. For any two members |A and B| = |C| - |lack A| - |lack B| + |D(A) and D(B)|, where D is lack and own together,
so a link asks for a known overlap of the differences: bar(A) + bar(B) <= 2 * (100 + PERCENT) * |D(A) and D(B)|. Where
the bars sum to nothing or less, sizes alone decide, and one star around the least bar joins all such members. All
others meet by the rarest of their differences: of a member that needs an overlap of t, all but the last t - 1. Only
members of different classes that can still reach the overlap make a pair, whose whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecost.llm.bpe import slices
from lanecost.llm.components import components
from lanecost.llm.scratch import stored
from lanecost.llm.text import mixed, window_hashes, word_hashes

WORDS = 5
PERCENT = 75
COLLECTIONS = 28
HASHES = 3
LANES = 6  # 64-bit numbers of a sketch; a lane has four bits of each of 16 minimum hashes
# 84 hashes agree in 4 bits with a probability of 0.766 or more for linked documents; fewer than 40 agreements has
# a probability below 1e-8.
LEAST_AGREEING = 40
SALT_DOCS = 256  # members of a group that meet one copy of its common shingles

SIGNED = (
    "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, collections array<bigint>, "
    + ", ".join(f"s{i} bigint" for i in range(LANES))
)
SEEDS = mixed(np.arange(1, COLLECTIONS * HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted: runs of five words, or all words if there are fewer; A-Z are
    lowered. Empty without words."""
    hashed = word_hashes(text.encode().lower().split())
    if not len(hashed):
        return hashed
    return np.unique(window_hashes(hashed, min(words, len(hashed)), seed=len(hashed) if len(hashed) < words else 0))


def minima(sets: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set of shingle hashes."""
    out = np.empty(len(SEEDS), np.uint64)
    for begin in range(0, len(sets), 4096):
        part = sets[begin : begin + 4096]
        least = ((part ^ (part >> np.uint64(31)))[None, :] * SEEDS[:, None]).min(axis=1)
        out = least if begin == 0 else np.minimum(out, least)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a shingle to their SIGNED columns."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for begin, run in slices(batch.column(1).to_pylist()):
            ids, sizes, one, two, mins = [], [], [], [], []
            for k, text in enumerate(run):
                own = shingles(text)
                if len(own):
                    ids.append(keys[begin + k])
                    sizes.append(len(own))
                    one.append(int(np.bitwise_xor.reduce(mixed(own))))
                    two.append(int(mixed(own + np.uint64(7)).sum()))
                    mins.append(minima(own))
            if not ids:
                continue
            least = mixed(np.array(mins))
            values = least.reshape(len(ids), COLLECTIONS, HASHES)
            grouped = np.broadcast_to(np.arange(1, COLLECTIONS + 1, dtype=np.uint64), values.shape[:2]).copy()
            for h in range(HASHES):
                grouped = mixed(grouped * np.uint64(0xD6E8FEB86659FD93) ^ values[:, :, h])
            nibbles = np.zeros((len(ids), LANES * 16), np.uint64)
            nibbles[:, : least.shape[1]] = least & np.uint64(15)
            shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
            lanes = np.bitwise_or.reduce(nibbles.reshape(len(ids), LANES, 16) << shifts, axis=2).view(np.int64)
            signed = [np.array(x, np.uint64).view(np.int64) for x in (one, two)]
            offsets = np.arange(0, grouped.size + 1, COLLECTIONS, dtype=np.int32)
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, signed)]
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(grouped.view(np.int64).ravel())))
            arrays += [pa.array(lanes[:, i].copy()) for i in range(LANES)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SIGNED.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        for begin, run in slices(batch.column(1).to_pylist()):
            own = [shingles(t).view(np.int64) for t in run]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = pa.array(np.concatenate(own))
            arrays = [keys.slice(begin, len(run)), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "shingles"])


def _agreeing(left: str, right: str) -> Column:
    """How many of the sketches' 4-bit numbers are equal."""
    total = F.lit(0)
    for i in range(LANES):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + 16 - F.bit_count(x)
    return total - (LANES * 16 - COLLECTIONS * HASHES)


def _could_link(left: str, right: str) -> Column:
    """Sizes and sketches of two documents that may be linked."""
    low = F.least(f"{left}.n_shingles", f"{right}.n_shingles")
    high = F.greatest(f"{left}.n_shingles", f"{right}.n_shingles")
    return (100 * low >= PERCENT * high) & (_agreeing(left, right) >= LEAST_AGREEING)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - both
    # the centres' sets go to their pairs first, and with these to the other documents
    with_centres = pairs.join(two, "b")
    return with_centres.join(one, "a").where((100 * both >= PERCENT * whole) & (whole > 0)).select("a", "b").distinct()


def _groups(tables: DataFrame, links: DataFrame) -> DataFrame:
    """doc, root (its class by `links`) and cluster of the documents of tables with several classes and more than one
    pair; documents that such tables join share a cluster."""
    roots = components(links)
    rows = tables.join(roots, tables["doc"] == roots["node"], "left")
    rows = stored(rows.select("key", "doc", F.coalesce("root", "doc").alias("root")))
    sides = [F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("doc").alias("least")]
    still = rows.groupBy("key").agg(*sides).where("low < high AND n > 2").select("key", "least")
    met = stored(rows.join(still, "key").select("doc", "root", "least").distinct())
    clusters = components(met.select(F.col("doc").alias("a"), F.col("least").alias("b")))
    docs = met.select("doc", "root").distinct()
    clusters = clusters.withColumnRenamed("root", "cluster")
    return stored(docs.join(clusters, docs["doc"] == clusters["node"]).drop("node"))


def _differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """`groups` with bar and diff: what each document differs in from the shingles that most of its cluster have."""
    sizes = stored(groups.groupBy("cluster").agg(F.count("*").alias("size")))
    each = groups.select("doc", "cluster").join(sets, "doc").select("cluster", F.explode("shingles").alias("s"))
    most = each.groupBy("cluster", "s").agg(F.count("*").alias("n")).join(sizes, "cluster").where("2 * n > size")
    most = most.groupBy("cluster").agg(F.collect_list("s").alias("c"))
    # a large cluster meets copies of its shingles, so its documents stay spread
    parts = F.ceil(F.col("size") / SALT_DOCS)
    centres = sizes.join(most, "cluster", "left").select(
        "cluster",
        F.coalesce("c", F.array().cast("array<bigint>")).alias("c"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("salt"),
    )
    salted = groups.join(sizes, "cluster").withColumn("salt", F.pmod(F.xxhash64("doc"), parts)).drop("size")
    met = salted.join(sets, "doc").join(centres, ["cluster", "salt"])
    met = met.withColumn("lack", F.array_except("c", "shingles")).withColumn("own", F.array_except("shingles", "c"))
    bar = 200 * F.size("lack") + 2 * PERCENT * F.size("own") - (100 - PERCENT) * F.size("c")
    return met.select("doc", "root", "cluster", bar.cast("bigint").alias("bar"), F.concat("lack", "own").alias("diff"))


def _by_differences(tables: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of each cluster as far as any of its links do."""
    scale = 2 * (100 + PERCENT)
    told = stored(_differences(_groups(tables, links), sets))
    hubs = told.groupBy("cluster").agg(F.min(F.struct("bar", "doc", "root")).alias("hub"))
    near = told.join(hubs, "cluster").where("doc <> hub.doc AND bar + hub.bar <= 0")
    near = stored(near.select("cluster", "root", "doc", "hub"))
    # classes that the star joins are one class in their cluster
    joined = near.select("cluster", "root", F.col("hub.root").alias("one")).distinct()
    told = told.join(joined, ["cluster", "root"], "left")
    told = stored(told.select("doc", "cluster", F.coalesce("one", "root").alias("root"), "bar", "diff"))
    least = told.groupBy("cluster", "root").agg(F.min("bar").alias("bar"))
    first = least.groupBy("cluster").agg(F.min(F.struct("bar", "root")).alias("first"))
    other = least.join(first, "cluster").where("root <> first.root")
    other = other.groupBy("cluster").agg(F.min("first").alias("first"), F.min("bar").alias("next"))
    # the least overlap that a link to any other class asks for
    facing = F.when(F.col("root") == F.col("first.root"), F.col("next")).otherwise(F.col("first.bar"))
    need = F.greatest(F.lit(1), F.ceil((F.col("bar") + facing) / scale)).cast("int")
    able = told.join(other, "cluster").withColumn("need", need).drop("first", "next")
    able = stored(able.where(F.size("diff") >= F.col("need")))
    held = able.select("doc", "cluster", F.explode("diff").alias("s"))
    shared = held.groupBy("cluster", "s").agg(F.count("*").alias("n")).where("n > 1")
    listed = held.join(shared, ["cluster", "s"]).groupBy("doc")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("rare"))
    known = able.drop("diff").join(listed, "doc").where(F.size("rare") >= F.col("need"))
    begun = F.slice("rare", 1, F.size("rare") - F.col("need") + 1)
    known = known.select("*", F.size("rare").alias("all"), F.posexplode(begun).alias("at", "r"))
    # `upto`: the overlap from this shingle on is no larger
    known = stored(known.select("cluster", "doc", "root", "bar", "r.s", (F.col("all") - F.col("at")).alias("upto")))
    x, y = known.alias("x"), known.alias("y")
    pairs = (
        x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.s") == F.col("y.s")))
        .where((F.col("x.doc") < F.col("y.doc")) & (F.col("x.root") != F.col("y.root")))
        .where(scale * F.least("x.upto", "y.upto") >= F.col("x.bar") + F.col("y.bar"))
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    )
    by_size = near.select(F.col("doc").alias("a"), F.col("hub.doc").alias("b"))
    return by_size.union(_linked(stored(pairs.distinct()), sets))


def _tables(members: DataFrame) -> DataFrame:
    """key, doc and place (from 1) in the table of the key; tables of one document are left out.

    Places go by how many documents share the values of a document, the most first: in a group of copies, the one
    with the fewest edits of its own is the best centre.
    """
    values = members.select(F.col("doc_id").alias("doc"), F.explode("collections").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    listed = values.join(shared, "value").groupBy("doc")
    listed = listed.agg(F.sort_array(F.collect_list("value")).alias("v"), F.sum("n").alias("score"))
    pairs = F.flatten(
        F.transform(
            "v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.xxhash64(x, y))
        )
    )
    keys = listed.select("doc", "score", F.explode(pairs).alias("key"))
    by_key = Window.partitionBy("key")
    place = F.row_number().over(by_key.orderBy(F.desc("score"), "doc"))
    keys = keys.select("key", "doc", place.alias("place"), F.count("*").over(by_key).alias("size"))
    return stored(keys.where("size > 1").drop("size"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents are linked if 100 * |A and B| >= 75 * |A or B| for their shingle sets; a class holds all that links
    reach, and component_id is its smallest doc_id. Rows without words have no shingles and are classes of their
    own. Rows that repeat a doc_id are one document and lie in one class; a row without doc_id takes no part in links
    and its component_id is null. Other columns take no part.
    """
    whole = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    signed = stored(whole.mapInArrow(_signed, SIGNED))
    known = signed.where(F.col("doc_id").isNotNull())
    same = ["n_shingles", "set1", "set2"]
    firsts = known.groupBy(*same).agg(F.min("doc_id").alias("first"))
    members = stored(
        known.join(firsts, same).where("doc_id = first").dropDuplicates(["doc_id", *same]).drop("first", "set1", "set2")
    )
    sketches = members.select(F.col("doc_id").alias("doc"), "n_shingles", *[f"s{i}" for i in range(LANES)])
    found = _links(_tables(members), sketches, whole)
    exact = known.join(firsts, same).where("doc_id <> first")
    exact = exact.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    roots = components(found.union(exact))
    sized = signed.select(F.col("doc_id").alias("doc"), "n_shingles")
    bare = whole.where(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))) == 0)
    every = sized.union(bare.select("doc", F.lit(0).cast("bigint")))
    return every.join(roots, every["doc"] == roots["node"], "left").select(
        F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("root", "doc").alias("component_id")
    )


def _links(tables: DataFrame, sketches: DataFrame, whole: DataFrame) -> DataFrame:
    """Links (a, b) between documents that share a table, enough of them to hold each class together."""
    left, right = sketches.alias("l"), sketches.alias("r")
    texts = whole.join(tables.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc", "text"])
    sets = stored(texts.select("doc", "text").mapInArrow(_sets, "doc bigint, shingles array<bigint>"))
    centre = tables.where("place = 1").select("key", F.col("doc").alias("b"))
    pairs = tables.where("place > 1").join(centre, "key").select(F.col("doc").alias("a"), "b")
    near = pairs.distinct().alias("p").join(left, F.col("p.a") == F.col("l.doc"))
    near = near.join(right, F.col("p.b") == F.col("r.doc")).where(_could_link("l", "r"))
    links = stored(_linked(near.select("p.a", "p.b"), sets))
    return links.union(_by_differences(tables, links, sets))
