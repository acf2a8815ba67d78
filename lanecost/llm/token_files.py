"""Token ids of a corpus as a table of packed blocks, in ascending document order.

The table is Parquet, so any storage that Spark knows will do, and lost executors write their part again. A row
is a block: whole documents, about BLOCK_IDS ids, packed by Simple-8b, with the documents' ids and token counts.
`part` and `part_start` give a block's place: parts follow each other in document order, and `part_start` counts
the ids before the block within its part. A block is read without its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecost.llm.bpe import Encoder
from lanecost.llm.simple8b import packed, unpacked

BLOCK_IDS = 32_768
SLICE_BYTES = 400_000  # of texts that are encoded together
BLOCKS = (
    "part int, block int, part_start bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
    "words binary, escapes binary"
)
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _block(part: int, block: int, start: int, docs: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    words, escapes = packed(ids)
    values = [part, block, start, len(ids), docs, sizes, words.tobytes(), escapes.tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    kinds += [pa.binary(), pa.binary()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts end to end, null as empty, and where each text ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def _encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The documents of a batch by slices: their keys, token counts and ids, end ids included."""
    data, ends = _texts(batch.column(1))
    first = begin = 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, begin + SLICE_BYTES, "right")), first + 1)
        own = ends[first:last]
        ids, sizes = encoder(vocabulary).encoded_bytes(data[begin : own[-1]], own - begin)
        yield batch.column(0)[first:last], sizes + 1, np.insert(ids, np.cumsum(sizes), end_id)
        first, begin = last, int(own[-1])


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append `end_id` to each, and write the blocks below `path`.

    Null texts are empty, so their ids are the end id alone. Null ids come first; rows that share an id follow
    each other by text. Other columns are not written.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, filled = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for keys, own_sizes, own_ids in _encoded(batch, vocabulary, end_id):
                ends = np.cumsum(own_sizes)
                first = begin = 0
                while first < len(ends):
                    # a block ends with the document that fills it
                    last = int(np.searchsorted(ends, begin + BLOCK_IDS - filled)) + 1
                    own = slice(first, last)
                    end = int(ends[own][-1])
                    docs += keys[own].to_pylist()
                    sizes.append(own_sizes[own])
                    ids.append(own_ids[begin:end])
                    filled += end - begin
                    if filled >= BLOCK_IDS:
                        yield _block(part, block, start, docs, np.concatenate(sizes), np.concatenate(ids))
                        block, start, filled, docs, sizes, ids = block + 1, start + filled, 0, [], [], []
                    first, begin = last, end
        if docs:
            yield _block(part, block, start, docs, np.concatenate(sizes), np.concatenate(ids))

    ordered = (
        docs.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text).alias("t"))
        .repartitionByRange("k")
        .sortWithinPartitions("k", "t")
    )
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)


def part_starts(blocks: DataFrame) -> DataFrame:
    """part and the ids of all parts before it: one row per part, as many as the write had tasks."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written table: doc_id, start (ids of all documents before), n_tokens, ids (little-endian
    unsigned 32-bit integers)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row for each task of the write: a few bytes each, whatever the corpus
    starts = F.broadcast(part_starts(blocks.select("part", "n_ids")))
    placed = blocks.join(starts, "part").select(
        (F.col("before") + F.col("part_start")).alias("start"), "n_ids", "doc_ids", "n_tokens", "words", "escapes"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, keys, sizes, words, escapes = (c[row].as_py() for c in batch.columns)
                ids = unpacked(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u4"), n).astype("<u4")
                ends = np.cumsum(sizes)
                begins = ends - np.array(sizes)
                data = ids.tobytes()
                parts = [data[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(start + begins, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
