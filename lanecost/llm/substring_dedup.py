"""Repeated passages: every run of `window` words that also starts earlier in the corpus is cut.

Difference-cover anchors keep the first pass small. For two positions there is a shift below the period that takes
both to positions whose remainders lie in the cover, so two equal windows share an equal anchor, a shorter run
that starts at such a position. Only anchors at cover positions are hashed and shuffled, 4 of 13 positions for
20 words. Around anchors that occur twice, the whole windows are hashed and compared, so the result is exact up to
collisions of the windows' hashes of 80 bits and more.

Rows between tasks are packed: a row holds the entries of one slice of input for one bucket of hashes, as arrays.
A slice sends each hash once, so a passage of a third of all documents is a few entries for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecost.llm.bpe import slices
from lanecost.llm.text import window_hashes, word_hashes

WINDOW = 20
# Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
SLICE_CHARS = 4_000_000
BUCKET_BYTES = 64 << 20  # of text for each bucket of documents, on average
NO_ID = -(2**63)  # stands for a null id, before all others

ENTRIES = "bucket int, kind int, low binary, high binary, extra binary, docs binary, starts binary"
PLACES = "bucket int, docs binary, starts binary"
RESULT = (
    "doc_id bigint, n_words bigint, removed array<struct<begin:bigint,end:bigint>>, n_removed bigint, "
    "kept_text string"
)
HASHED, KNOWN = 0, 1


def period_for(window: int) -> int:
    """The largest period of COVERS that leaves anchors of half the window or so."""
    return max((p for p in COVERS if window - p + 1 >= max(1, window * 2 // 5)), default=1)


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """key, begin and end of each run of equal keys."""
    edges = np.flatnonzero(np.diff(sorted_keys)) + 1
    bounds = [0, *edges.tolist(), len(sorted_keys)] if len(sorted_keys) else []
    for b, e in zip(bounds, bounds[1:], strict=False):
        yield int(sorted_keys[b]), b, e


def _table(names: list[str], columns: list[list]) -> pa.Table:
    kinds = [pa.int32() if n in ("bucket", "kind") else pa.binary() for n in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _spread(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """A bucket by the leading 32 bits of a hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)


def _document_buckets(docs: np.ndarray, n_buckets: int) -> np.ndarray:
    """pmod(hash(id), n_buckets) as Spark's SQL gives it: 32-bit Murmur3 of a bigint with seed 42."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    ids = docs.astype(np.int64).view(np.uint64)
    state = np.full(len(ids), 42, np.uint32)
    for half in (ids.astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32)):
        state ^= turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        state = turned(state, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    state ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        state = (state ^ (state >> np.uint32(shift))) * np.uint32(factor)
    return np.mod(state.view(np.int32), n_buckets)


def _by_document(docs: np.ndarray, starts: np.ndarray, n_buckets: int) -> list[tuple]:
    """Places packed by the bucket of their document."""
    buckets = _document_buckets(docs, n_buckets)
    order = np.lexsort((starts, docs, buckets))
    docs, starts, buckets = docs[order], starts[order], buckets[order]
    return [(k, docs[b:e].tobytes(), starts[b:e].tobytes()) for k, b, e in _runs(buckets)]


def _entries(hashes: np.ndarray, extra: np.ndarray, docs: np.ndarray, starts: np.ndarray, known, n_buckets: int):
    """Packed rows: hashes with their places by bucket of hash, and `known` places by bucket of document.

    A row keeps the low 48 bits of a hash; the bucket stands for the rest.
    """
    buckets = _spread(hashes, n_buckets)
    order = np.argsort(buckets, kind="stable")
    low = hashes.astype(np.uint32)[order]
    high = (hashes >> np.uint64(32)).astype(np.uint16)[order]
    extra, docs, starts = extra[order] if len(extra) else extra, docs[order], starts[order]
    rows = [
        (k, HASHED, *(x[b:e].tobytes() for x in (low, high, extra, docs, starts)))
        for k, b, e in _runs(buckets[order])
    ]
    rows += [(k, KNOWN, b"", b"", b"", d, s) for k, d, s in _by_document(*known, n_buckets)]
    return _table([c.split()[0] for c in ENTRIES.split(", ")], [list(c) for c in zip(*rows, strict=True)] or [[]] * 7)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _sorted_groups(table: pa.Table):
    """The hashed entries of a bucket by hash, document and start; `first` is where each entry's hash begins."""
    hashed = table.filter(pa.array([k == HASHED for k in table.column("kind").to_pylist()], pa.bool_()))
    key = (_column(hashed, "high", "<u2").astype(np.uint64) << np.uint64(32)) | _column(hashed, "low", "<u4")
    extra, docs, starts = (_column(hashed, n, k) for n, k in (("extra", "<u4"), ("docs", "<i8"), ("starts", "<i4")))
    more = extra if len(extra) else np.zeros(len(key), np.uint32)
    order = np.lexsort((starts, docs, more, key))
    key, more, docs, starts = key[order], more[order], docs[order], starts[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
    known = table.filter(pa.array([k == KNOWN for k in table.column("kind").to_pylist()], pa.bool_()))
    return docs, starts, first, _column(known, "docs", "<i8"), _column(known, "starts", "<i4")


def _later(docs: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where an entry's place comes after the first place of its hash; a repeated row's place is the same one."""
    return (docs > docs[first]) | (starts > starts[first])


def _places(docs: np.ndarray, starts: np.ndarray, n_buckets: int) -> pa.Table:
    rows = _by_document(docs, starts, n_buckets)
    return _table(["bucket", "docs", "starts"], [list(c) for c in zip(*rows, strict=True)] or [[], [], []])


def _document_places(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted distinct starts of each document."""
    docs, starts = _column(table, "docs", "<i8"), _column(table, "starts", "<i4")
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    return {k: np.unique(starts[b:e]) for k, b, e in _runs(docs)}


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (ranges of words, end exclusive), n_removed and kept_text (the other words joined by
    one space) of each row.

    A word goes if a window that covers it has a word sequence that also starts earlier: in a smaller doc_id, or
    before it in the same document. Windows are judged on the input. Null texts have no words. A null id comes
    before all others. Equal rows are one document and give equal rows; rows that share an id but not the text
    are judged as one document, by start. Other columns take no part.
    """
    period = period_for(window)
    cover = np.isin(np.arange(period), COVERS.get(period, (0,)))
    anchor = window - period + 1
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
    whole = docs.select(key.alias("k"), F.col(text).alias("t"))
    # a bucket is what a task holds at once, so their number grows with the input
    size = whole.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, run in slices(batch.column(1).to_pylist(), SLICE_CHARS):
                found, ids, starts = [], [], []
                for key, t in zip(keys[begin : begin + len(run)].tolist(), run, strict=True):
                    hashed = window_hashes(word_hashes(t.encode().split()), anchor)
                    at = np.flatnonzero(np.resize(cover, len(hashed))) if len(hashed) else np.empty(0, np.int64)
                    found.append(hashed[at])
                    starts.append(at.astype(np.int32))
                    ids.append(np.full(len(at), key, np.int64))
                h, d, s = (np.concatenate(x) for x in (found, ids, starts))
                _, where, which, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                again = counts[which] > 1
                where.sort()  # in document order, which packs better
                none = np.empty(0, np.uint32)
                table = _entries(h[where], none, d[where], s[where], (d[again], s[again]), n_buckets)
                yield from table.to_batches()

    def repeated(table: pa.Table) -> pa.Table:
        docs, starts, first, known_docs, known_starts = _sorted_groups(table)
        sizes = np.bincount(first, minlength=len(first))
        twice = sizes[first] > 1
        return _places(
            np.concatenate([docs[twice], known_docs]), np.concatenate([starts[twice], known_starts]), n_buckets
        )

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        places = _document_places(right)
        one, two, ids, starts = ([np.empty(0, k)] for k in (np.uint64, np.uint64, np.int64, np.int32))
        for key, t in zip(left.column("k").to_pylist(), left.column("t").to_pylist(), strict=True):
            if key not in places:
                continue
            hashed = word_hashes((t or "").encode().split())
            near = (places[key][:, None] - np.arange(period)).ravel()
            near = np.unique(near[(near >= 0) & (near <= len(hashed) - window)])
            one.append(window_hashes(hashed, window, 1)[near])
            two.append(window_hashes(hashed, window, 2)[near])
            starts.append(near.astype(np.int32))
            ids.append(np.full(len(near), key, np.int64))
        h, g, d, s = (np.concatenate(x) for x in (one, two, ids, starts))
        g = g.astype(np.uint32)
        order = np.lexsort((s, d, g, h))
        h, g, d, s = h[order], g[order], d[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.empty(0, np.int64)
        late = _later(d, s, first)
        lead = np.flatnonzero(new)
        lead = lead[np.lexsort((s[lead], d[lead]))]
        return _entries(h[lead], g[lead], d[lead], s[lead], (d[late], s[late]), n_buckets)

    def judged(table: pa.Table) -> pa.Table:
        docs, starts, first, known_docs, known_starts = _sorted_groups(table)
        late = _later(docs, starts, first)
        return _places(
            np.concatenate([docs[late], known_docs]), np.concatenate([starts[late], known_starts]), n_buckets
        )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        places = _document_places(right)
        keys, n_words, removed, n_removed, kept = [], [], [], [], []
        for key, t in zip(left.column("k").to_pylist(), left.column("t").to_pylist(), strict=True):
            words = (t or "").encode().split()
            begins = places.get(key, np.empty(0, np.int32))
            begins = begins[begins <= len(words) - window]
            gaps = np.flatnonzero(np.diff(begins) > window) + 1
            ranges = [(int(part[0]), int(part[-1]) + window) for part in np.split(begins, gaps) if len(part)]
            left_over, at = [], 0
            for b, e in ranges:
                left_over += words[at:b]
                at = e
            left_over += words[at:]
            keys.append(None if key == NO_ID else key)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left_over))
            removed.append([{"begin": b, "end": e} for b, e in ranges])
            kept.append(b" ".join(left_over).decode())
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        n = pa.int64()
        columns = [(keys, n), (n_words, n), (removed, spans), (n_removed, n), (kept, pa.string())]
        names = ["doc_id", "n_words", "removed", "n_removed", "kept_text"]
        return pa.table([pa.array(v, k) for v, k in columns], names=names)

    texts = whole.withColumn("bucket", F.pmod(F.hash("k"), F.lit(n_buckets))).groupBy("bucket")
    near = whole.mapInArrow(anchors, ENTRIES).groupBy("bucket").applyInArrow(repeated, PLACES)
    entries = texts.cogroup(near.groupBy("bucket")).applyInArrow(windows, ENTRIES)
    late = entries.groupBy("bucket").applyInArrow(judged, PLACES)
    return texts.cogroup(late.groupBy("bucket")).applyInArrow(cut, RESULT)
