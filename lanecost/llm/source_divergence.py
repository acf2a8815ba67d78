"""How far the term frequencies of the sources of a language lie apart, and which terms set a source off.

Terms are runs of A to Z, a to z and everything beyond ASCII, with A to Z lowered. They are counted in each task by
packing (`packed_terms`), then summed by Spark. A language keeps the terms that enough of its documents hold. A source's
share of a kept term is an integer, 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), so all sums are exact.

Two sources are compared over all kept terms of their language: a row for each term holds the shares of all sources, is
cut into tiles of WIDTH by WIDTH sources, and each task adds up |p - q| over its rows of a tile, which Spark sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecost.llm.packed_terms import SLICE_BYTES, UPPER_TO_LOWER, counted, pieces, strings, term_bounds, text_slices
from lanecost.llm.scratch import stored

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
WIDTH = 128
SALTS = 64  # parts of the terms of a tile; a task of any size holds one tile's sums at a time

INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
SUMS = "lang string, a int, b int, total bigint"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice of texts by (lang, source, term), and how many of its texts hold the term."""
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for first, data, bounds in text_slices(batch.column(2)):
            data = UPPER_TO_LOWER[data]
            own = pairs[first : first + len(bounds) - 1]
            names = list(dict.fromkeys(own))
            number = {p: i for i, p in enumerate(names)}
            groups = np.array([number[p] for p in own], np.uint32)
            begin, length, row = term_bounds(INSIDE[data], bounds)
            long = len(own) == 1 and len(data) > 2 * SLICE_BYTES
            parts = list(pieces(begin, SLICE_BYTES)) if long else [slice(None)]
            tables = []
            for part in parts:
                runs = counted(data, begin[part], length[part], row[part], groups)
                columns = [runs.group, strings(data, runs.begin, runs.length), runs.count, runs.texts]
                tables.append(pa.table(columns, ["group", "term", "n", "docs"]))
            table = pa.concat_tables(tables) if tables else None
            if table is None or not table.num_rows:
                continue
            if long:  # one text in several parts: a term counts as held once
                table = table.group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "max")])
                table = table.rename_columns(["group", "term", "n", "docs"])
            table = table.combine_chunks()
            which = table.column("group").combine_chunks()
            langs, sources = (pa.array([p[i] for p in names], pa.string()) for i in (0, 1))
            columns = [langs.take(which), sources.take(which)]
            columns += [table.column(c).combine_chunks().cast(t) for c, t in (("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold the term). Null lang, source and text are ''."""
    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)])
    counts = each.toDF("lang", "source", "text").mapInArrow(_counts, COUNTS)
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers of any size; null without terms."""
    wide = "decimal(38,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast(wide)
    return F.call_function("div", above.cast(wide), F.nullif(below, F.lit(0).cast(wide))) + 1


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |x_i - y_j| over the rows of each run of equal (lang, first, second)."""
    key, sums = None, None

    def done() -> pa.RecordBatch:
        i, j = np.nonzero(np.ones(sums.shape, bool))
        a, b = i + key[1], j + key[2]
        kept = a < b
        columns = [pa.array([key[0]] * int(kept.sum()), pa.string()), pa.array(a[kept].astype(np.int32))]
        columns += [pa.array(b[kept].astype(np.int32)), pa.array(sums[i[kept], j[kept]])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "total"])

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            x, y = (batch.column(c).slice(at, stop - at).flatten().to_numpy().reshape(stop - at, -1) for c in (3, 4))
            if keys[at] != key:
                if key is not None:
                    yield done()
                key, sums = keys[at], np.zeros((x.shape[1], y.shape[1]), np.int64)
            for i in range(x.shape[1]):
                sums[i] += np.abs(y - x[:, i : i + 1]).sum(axis=0)
            at = stop
    if key is not None:
        yield done()


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank, two parts for each (lang, source) that occurs.

    Part `pair` has every other source of the language by falling distance, the sum of |p - q| over all kept terms (0 if
    the language keeps none). Part `term` has the TOP_TERMS terms whose share in the source exceeds that in the language
    most, among those that the source holds. Ties go by the item's bytes. Null lang, source and text are ''; every row
    counts as a document, repeated ones too; groups of empty texts take part with no counts. An empty table gives no
    row. Other columns take no part.
    """
    counts = stored(term_counts(docs, lang, source, text))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = kept.where(F.col("docs") >= MIN_DOCS).drop("docs")
    cells = stored(counts.drop("docs").join(kept, ["lang", "term"]))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = cells.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = stored(
        docs.select(*names)
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("place", F.row_number().over(by_source) - 1)
        .withColumn("absent", _share(F.lit(0), F.col("total"), F.col("terms")))
    )
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    return _distances(shares, groups).unionByName(_leading_terms(shares))


def _leading_terms(shares: DataFrame) -> DataFrame:
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = shares.withColumn("value", F.col("p") - q).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank"))
    return ranked.where(F.col("rank") <= TOP_TERMS)


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    absent = groups.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "absent"))), lambda s: s["absent"]).alias("absent")
    )
    held = shares.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("place", "p"))).alias("held"))
    rows = held.join(absent, "lang").select(
        "lang",
        F.xxhash64("term").alias("hash"),
        F.transform("absent", lambda p, i: F.coalesce(F.try_element_at("held", i), p)).alias("shares"),
    )
    starts = F.sequence(F.lit(0), F.size("shares") - 1, F.lit(WIDTH))
    tiles = F.flatten(
        F.transform(
            starts,
            lambda a: F.transform(
                F.filter(starts, lambda b: b >= a),
                lambda b: F.struct(
                    a.alias("first"),
                    b.alias("second"),
                    F.slice("shares", a + 1, F.lit(WIDTH)).alias("x"),
                    F.slice("shares", b + 1, F.lit(WIDTH)).alias("y"),
                ),
            ),
        )
    )
    tiled = rows.select("lang", F.pmod("hash", F.lit(SALTS)).alias("salt"), F.inline(tiles))
    dealt = tiled.repartition("lang", "first", "second", "salt").sortWithinPartitions("lang", "first", "second")
    sums = dealt.select("lang", "first", "second", "x", "y").mapInArrow(_tile_sums, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"))
    one, two = (groups.select("lang", F.col("place").alias(p), F.col("source").alias(s)) for p, s in (("a", "one"), ("b", "two")))
    # all pairs of sources of a language are the result itself
    named = one.join(two, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("total", F.lit(0).cast("bigint")).alias("value")
    both = named.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), value).union(
        named.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), value)
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
