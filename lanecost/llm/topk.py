"""Exact top-k by inner product: tiles of candidates against tiles of queries, then a tree of merges.

Vectors are packed into tiles, many rows to one row of the frame. Query tiles and candidate tiles are dealt to groups;
each pair of groups is a cell, and a task works off one cell: it holds the cell's queries and the best k of each so far,
while the cell's candidates pass by, one matrix product for each two tiles. What is dealt out is one copy of the
candidates for each group of queries and one copy of the queries for each group of candidates. A query's partial lists
meet in groups of FAN_IN, level by level, so no task gathers a list for every cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.scratch import stored

QUERY_TILE = 512
SHARD_TILE = 4096
TILE_BYTES = 2 << 20  # of a tile as 64-bit integers, for long vectors
FAN_IN = 16
EXACT = ((np.float32, 2**24), (np.float64, 2**53))  # all integers up to there are held
QUERY_BYTES = 32 << 20  # of a cell's queries, which a task holds
SHARD_BYTES = 64 << 20  # of a cell's candidates, which pass by
CELL_WORK = 2.5e12  # multiplications of a cell, a minute or two, and the least that is worth a task
LEAST_WORK = 1e10
BLOCK = 512  # candidates whose scores are held at once, few enough for a core's cache
TILE = "tile bigint, n int, width int, ids binary, vectors binary, asks binary"
TOP = "query_id bigint, cell int, asking bigint, top array<struct<score:bigint,vec_id:bigint>>"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null for vectors that are null, empty or hold a null, NaN or
    infinite component."""
    whole = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.when(
        whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    )


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    least, most = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return vectors.astype(kind)


def _packed(rows: int):
    """Pack (id, vector, whether it asks) rows of a task into tiles of at most `rows` rows of one length each."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def tile(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            nonlocal made
            ids, vectors, asks = parts[0], _narrow(parts[1]), parts[2]
            made += 1
            columns = [(task << 32) + made - 1, len(ids), vectors.itemsize, ids.tobytes(), vectors.tobytes(), asks.tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            arrays = [pa.array([c], k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["tile", "n", "width", "ids", "vectors", "asks"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype("?")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            for size in np.unique(sizes).tolist():
                most = max(1, min(rows, TILE_BYTES // (8 * size)))
                mine = np.flatnonzero(sizes == size)
                at = (ends[mine] - size)[:, None] + np.arange(size)
                parts = held.setdefault(size, [])
                parts.append((ids[mine], flat[at], asks[mine]))
                if sum(len(x[0]) for x in parts) >= most:
                    whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    full = len(whole[0]) // most * most
                    for i in range(0, full, most):
                        yield tile(tuple(x[i : i + most] for x in whole))
                    held[size] = [tuple(x[full:] for x in whole)]
        for parts in held.values():
            if sum(len(x[0]) for x in parts):
                yield tile(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))

    return tiles


def _read(n: int, width: int, ids: pa.Buffer, vectors: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{width}").reshape(n, -1)


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (id, vector) rows of tiles that ask."""
    for batch in batches:
        for row in range(batch.num_rows):
            n, width = (batch.column(c)[row].as_py() for c in (0, 1))
            ids, vectors = _read(n, width, *(batch.column(c)[row].as_buffer() for c in (2, 3)))
            asks = np.frombuffer(batch.column(4)[row].as_buffer(), "?")
            if asks.any():
                found = vectors[asks].astype("<i8")
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[asks]), pa.ListArray.from_arrays(ends, found.ravel())], names=["id", "v"]
                )


def _length(vectors: np.ndarray) -> float:
    """At least the length of the longest vector."""
    wide = vectors.astype(np.float64)
    return 1.001 * math.sqrt(np.einsum("ij,ij->i", wide, wide).max(initial=0))


def _kind(most: float) -> type:
    """The narrowest floats that hold every partial sum of inner products, else 64-bit integers. None of them exceeds
    the product of the two lengths, `most`."""
    return next((kind for kind, exact in EXACT if most < exact), np.int64)


def _products(
    queries: np.ndarray, shard: np.ndarray, kind: type | None = None, out: np.ndarray | None = None
) -> np.ndarray:
    """Integer inner products, without rounding."""
    kind = kind or _kind(_length(queries) * _length(shard))
    return np.matmul(queries.astype(kind, copy=False), shard.astype(kind, copy=False).T, out=out)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in no order."""
    if len(ids) <= k:
        return np.arange(len(ids))
    # every score above the least kept one, and of the equal ones the first few by id
    least = np.partition(scores, len(ids) - k)[len(ids) - k]
    above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")[: k - len(above)]]])


class _Tops:
    """The queries of a tile and the best k partners of each so far, highest score first, ties to the smaller id."""

    def __init__(self, tile: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.tile, self.ids, self.vectors, self.k = tile, ids, vectors, k
        self.length = _length(vectors)
        self.n = np.zeros(len(ids), np.int64)
        # until a list is full, its last place holds what any partner comes before
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.partners = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, shard: np.ndarray, length: float, room: dict[type, np.ndarray]) -> None:
        """`room` is used for the scores, again and again."""
        kind = _kind(self.length * length)
        queries, shard = self.vectors.astype(kind), shard.astype(kind)
        if kind not in room or len(room[kind]) < len(queries) * BLOCK:
            room[kind] = np.empty(len(queries) * BLOCK, kind)
        found = []
        for i in range(0, len(ids), BLOCK):
            part = shard[i : i + BLOCK]
            out = room[kind][: len(queries) * len(part)].reshape(len(queries), len(part))
            found.append(self._found(_products(queries, part, kind, out), ids[i : i + BLOCK]))
            if i + BLOCK >= len(ids) or self.n.min() < self.k:
                self._fold(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found = []

    def _found(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and partner of what comes before the last of a list."""
        least = self.scores[:, -1].astype(scores.dtype)
        rows = np.flatnonzero(scores.max(axis=1) >= least)
        if len(rows) < len(least):
            scores = scores[rows]
        row, at = np.divmod(np.flatnonzero(scores >= least[rows, None]), len(ids))
        found, partner, row = scores[row, at].astype(np.int64), ids[at], rows[row]
        may = (found > self.scores[row, -1]) | (partner < self.partners[row, -1]) | (self.n[row] < self.k)
        may &= partner != self.ids[row]
        return row[may], found[may], partner[may]

    def _fold(self, row: np.ndarray, found: np.ndarray, partner: np.ndarray) -> None:
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row, found, partner = row[order], found[order], partner[order]
        rows = np.unique(row)
        # long runs are cut to the k best before all are sorted
        starts = np.searchsorted(row, rows)
        ends = np.searchsorted(row, rows, "right")
        if (ends - starts > 16 * self.k).any():
            keep = [
                np.arange(a, b) if b - a <= 16 * self.k else a + _best(found[a:b], partner[a:b], self.k)
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
            ]
            keep = np.concatenate(keep)
            row, found, partner = row[keep], found[keep], partner[keep]
        old = np.arange(self.k) < self.n[rows, None]
        row = np.concatenate([np.repeat(rows, self.n[rows]), row])
        found = np.concatenate([self.scores[rows][old], found])
        partner = np.concatenate([self.partners[rows][old], partner])
        order = np.lexsort((partner, ~found, row))  # ~ turns the order round and never overflows
        row, found, partner = row[order], found[order], partner[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < self.k
        row, rank = row[first], rank[first]
        self.scores[row, rank], self.partners[row, rank] = found[first], partner[first]
        self.n[rows] = np.bincount(row, minlength=len(self.ids))[rows]

    def lists(self, cell: int) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        in_list = np.arange(self.k) < self.n[some, None]
        ends = np.concatenate([[0], np.cumsum(self.n[some])]).astype(np.int32)
        pairs = [pa.array(x[some][in_list], pa.int64()) for x in (self.scores, self.partners)]
        top = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, names=["score", "vec_id"]))
        constant = [pa.array(np.full(len(some), x), t) for x, t in ((cell, pa.int32()), (self.tile, pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[some]), *constant, top], names=["query_id", "cell", "asking", "top"]
        )


def _copied(tiles: DataFrame, is_shard: bool, first: Column, count: int, step: int) -> DataFrame:
    """The tiles of a frame in `count` cells each: `first` and every `step` after it. Copies are made one by one: an
    explode would hold all those of a tile at once."""
    kept = tiles.select(
        first.cast("int").alias("cell"), F.lit(is_shard).alias("shards"), "tile", "n", "width", "ids", "vectors"
    )

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, *columns = batch.slice(row, 1).columns
                for i in range(count):
                    at = pa.array([cell[0].as_py() + i * step], pa.int32())
                    yield pa.RecordBatch.from_arrays([at, *columns], names=batch.schema.names)

    return kept.mapInArrow(copies, kept.schema) if count > 1 else kept


def _selected(k: int):
    """The lists of a cell's queries: a partition holds the tiles of one cell, query tiles first."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[_Tops] = []
        cell, room = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                cell, shards, tile, n, width = (batch.column(c)[row].as_py() for c in range(5))
                ids, vectors = _read(n, width, *(batch.column(c)[row].as_buffer() for c in (5, 6)))
                if shards:
                    length = _length(vectors)
                    for top in tops:
                        if top.vectors.shape[1] == vectors.shape[1]:
                            top.meet(ids, vectors, length, room)
                else:
                    tops.append(_Tops(tile, ids.copy(), vectors.copy(), k))
        for top in tops:
            yield top.lists(cell)

    return select


def _grid(queries: dict, shards: dict, k: int, cores: int) -> tuple[int, int]:
    """Groups of queries, groups of candidates. Each has rows, tiles, bytes and values (components of all its rows).

    Cells are small enough for a task and many enough for the cores. Of the grids with as many cells, it is the one
    that deals out the fewest bytes: candidates once for each group of queries; queries, and the lists that they return
    with, once for each group of candidates.
    """
    work = queries["rows"] * shards["values"]
    cells = max(work / CELL_WORK, min(4 * cores, work / LEAST_WORK), 1)
    per_group = queries["bytes"] + 16 * k * queries["rows"]
    side = math.sqrt(cells * per_group / max(1, shards["bytes"]))
    n_asking = min(max(round(side), math.ceil(queries["bytes"] / QUERY_BYTES), 1), max(1, queries["tiles"]))
    n_shards = max(math.ceil(cells / n_asking), math.ceil(shards["bytes"] / SHARD_BYTES))
    return n_asking, min(n_shards, max(1, shards["tiles"]))


def _sizes(tiles: DataFrame) -> dict:
    """Rows, tiles, bytes and values of a frame of tiles."""
    held = F.length("vectors")
    return (
        tiles.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("*").alias("tiles"),
            F.coalesce(F.sum(held.cast("bigint")), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum((held / F.col("width")).cast("bigint")), F.lit(0)).alias("values"),
        )
        .first()
        .asDict()
    )


def _merged(lists: Column, k: int) -> Column:
    """The best k of several top lists."""
    keyed = F.transform(F.flatten(lists), lambda x: F.struct((-x["score"]).alias("a"), x["vec_id"].alias("b")))
    first = F.slice(F.sort_array(keyed), 1, k)
    return F.transform(first, lambda x: F.struct((-x["a"]).alias("score"), x["b"].alias("vec_id")))


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best partners of each query id among the rows of all other ids.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id.
    Only vectors of equal length are compared. Every row of a repeated id is a candidate, so an id may be listed more
    than once; the query rows of an id are one query, whose list is the best of all their scores. Scores must fit a
    64-bit integer. Other columns take no part.
    """
    usable = rows.select(
        F.col(id_column).cast("bigint").alias("id"),
        quantized(F.col(vector), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    shards = stored(usable.mapInArrow(_packed(SHARD_TILE), TILE))
    asking = shards.select("n", "width", "ids", "vectors", "asks").mapInArrow(_asking, "id bigint, v array<bigint>")
    asking = asking.groupBy("id", "v").agg(F.count("*").alias("n"))
    # of equal queries, more than k cannot show in a list of k
    copies = F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))
    asking = stored(asking.select("id", "v", F.explode(copies).alias("c")))
    n_queries, most = asking.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    # eight tiles to a task: its last is seldom full
    asking = asking.repartition(max(1, math.ceil((n_queries or 0) / (8 * QUERY_TILE))), "id", "v", "c").select("id", "v", F.lit(True).alias("q"))
    queries = stored(asking.mapInArrow(_packed(QUERY_TILE), TILE))
    # Every query tile meets every shard: a tile goes to all cells of its group.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    of_queries = _sizes(queries)
    n_asking, n_shards = _grid(of_queries, _sizes(shards), k, cores)
    group = F.xxhash64("tile")
    dealt = _copied(queries, False, F.pmod(group, F.lit(n_asking)) * n_shards, n_shards, 1).union(
        _copied(shards, True, F.pmod(group, F.lit(n_shards)), n_asking, n_shards)
    )
    dealt = dealt.repartitionById(n_asking * n_shards, F.col("cell")).sortWithinPartitions("shards")
    lists = dealt.mapInArrow(_selected(k), TOP)
    # the rows of a repeated query id lie in several query tiles
    level, width = F.xxhash64("cell", "asking"), n_shards * min(most or 1, max(1, of_queries["tiles"]))
    while width > FAN_IN:
        width = math.ceil(width / FAN_IN)
        lists = (
            lists.withColumn("g", F.pmod(level, F.lit(width)))
            .groupBy("query_id", "g")
            .agg(_merged(F.collect_list("top"), k).alias("top"))
        )
        level = F.col("g")
    final = lists.groupBy("query_id").agg(_merged(F.collect_list("top"), k).alias("top"))
    return final.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score"
    )
