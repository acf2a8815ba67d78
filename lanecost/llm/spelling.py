"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under the usual form.

Two words whose longer one has M code points are one edit apart if their common prefix and common suffix together reach
M - 1; the edit can then stand at place M - 1 - suffix. The M places are cut into SEGMENTS ranges, and for each range a
word is filed under what it has outside of it, so two near words meet in the range that holds this place, and are
reported there alone. Words that meet are laid out as padded code-point matrices, one aligned at the first code point
and one at the last, and blocks of rows are compared with blocks of rows. Small meetings share a block.

Where more than MOST_MEETING words meet, each place of the range becomes a range of its own. Words that meet then differ
at one known place, so a meeting is never larger than the alphabet and one more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.packed_terms import SLICE_BYTES, UPPER_TO_LOWER, counted, pieces, strings, term_bounds, text_slices
from lanecost.llm.scratch import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
MUCH_MORE = 5
SLIP = 199
SEGMENTS = 3
MOST_MEETING = 2048
BLOCK = 128

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = 0xC3  # in UTF-8, U+00C0 to U+00FF are this byte and one of 0x80 to 0xBF
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
MEETINGS = "key bigint, longer int, low int, high int, word binary, n bigint"
NEAR = "word binary, other binary, other_n bigint"


def checksums(data: np.ndarray, begin: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of runs of bytes, each going on from the checksum `start`, all runs byte by byte at once."""
    state = ~start.astype(np.uint32)
    left = np.arange(len(begin))
    for k in range(int(length.max(initial=0))):
        left = left[length[left] > k]
        now = state[left]
        state[left] = CRC[(now ^ data[begin[left] + k]) & 255] ^ (now >> 8)
    return ~state


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each slice of texts, with counts."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, data, bounds in text_slices(batch.column(1)):
            data = UPPER_TO_LOWER[data]
            after_lead = np.concatenate([[False], data[:-1] == LEAD])
            begin, length, row = term_bounds(LETTER[data] | (data == LEAD) | after_lead, bounds)
            follow = np.concatenate([[0], np.cumsum(after_lead)])
            points = length - (follow[begin + length] - follow[begin])
            heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first : first + len(bounds) - 1]]
            heads = np.array(heads, np.uint32)
            enough = points >= LEAST_LENGTH
            begin, length, row, points = begin[enough], length[enough], row[enough], points[enough]
            for part in pieces(begin, SLICE_BYTES):
                at, size, texts = begin[part], length[part], row[part]
                sums = checksums(data, at, size, heads[texts])
                slipped = sums % SLIP == 0
                changed = Counter()
                for b, s, h in zip(at[slipped].tolist(), size[slipped].tolist(), sums[slipped].tolist(), strict=True):
                    run = data[b : b + s].tobytes().decode()
                    place = h % len(run)
                    changed[run[:place] + run[place + 1 :]] += 1
                whole = ~slipped
                runs = counted(data, at[whole], size[whole], texts[whole], np.zeros(len(heads), np.uint32))
                words = [strings(data, runs.begin, runs.length), pa.array(list(changed), pa.string())]
                counts = np.concatenate([runs.count, np.array(list(changed.values()), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(words), pa.array(counts)], names=["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: runs of letters with the planted slips, of LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    each = docs.select(F.col(doc_id).cast("string").alias("k"), F.col(text).alias("t"))
    words = each.mapInArrow(_words, "word string, n bigint").where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _rest(own: Column, longer: Column, low: Column, high: Column) -> Column:
    """A key of what a word has outside of the range: the same for two words one edit within the range apart."""
    shorter = longer - F.length(own)
    ends = F.concat(F.substring(own, F.lit(1), low), F.substring(own, high + 1 - shorter, longer))
    return F.xxhash64(longer, low, high, ends)


def meetings(words: DataFrame) -> DataFrame:
    """The MEETINGS rows of `words` (word, n): a word under its own length and the next, in each range."""
    size = F.length("word")
    ranges = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    rows = rows.select("*", F.explode(ranges).alias("s")).select(
        "word",
        "n",
        "longer",
        F.expr(f"cast(longer * s div {SEGMENTS} as int)").alias("low"),
        F.expr(f"cast(longer * (s + 1) div {SEGMENTS} as int)").alias("high"),
    )
    rows = rows.withColumn("key", _rest(F.col("word"), F.col("longer"), F.col("low"), F.col("high")))
    crowds = stored(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > MOST_MEETING).select("key"))
    crowded = rows.join(crowds, "key", "left_semi")
    fine = crowded.select("word", "n", "longer", F.explode(F.sequence("low", F.col("high") - 1)).alias("low"))
    fine = fine.withColumn("high", F.col("low") + 1)
    fine = fine.withColumn("key", _rest(F.col("word"), F.col("longer"), F.col("low"), F.col("high")))
    both = rows.join(crowds, "key", "left_anti").unionByName(fine)
    return both.select("key", "longer", "low", "high", F.encode("word", "ISO-8859-1").alias("word"), "n")


def _matrices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned at the first, padded with 0; aligned at the last, padded in front; and the lengths."""
    width = words.dtype.itemsize
    left = words.view(np.uint8).reshape(len(words), width)
    size = np.char.str_len(words).astype(np.int64)
    at = np.arange(width) - (width - size)[:, None]
    right = np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), axis=1), np.uint8(0))
    return left, right, size


def _common(one: np.ndarray, two: np.ndarray, columns: range) -> np.ndarray:
    """How many columns in a row, in this order, agree for each pair of rows."""
    alive = np.ones((len(one), len(two)), bool)
    total = np.zeros(alive.shape, np.uint8 if one.shape[1] < 255 else np.uint32)
    for k in columns:
        alive &= one[:, k, None] == two[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


def compared(key: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, one: slice, two: slice):
    """Positions of the near pairs of two blocks of rows, each pair in the range that holds its first edit place."""
    left, right, size = _matrices(words)
    width = left.shape[1]
    held = (key[one, None] == key[None, two]) & (longer[one, None] == longer[None, two])
    held &= np.maximum(size[one, None], size[None, two]) == longer[one, None]
    if one == two:
        held &= np.triu(held, 1)
    if not held.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shorter = np.minimum(size[one, None], size[None, two])
    prefix = np.minimum(_common(left[one], left[two], range(width)), shorter)
    suffix = np.minimum(_common(right[one], right[two], range(width - 1, -1, -1)), shorter)
    first = longer[one, None] - 1 - suffix
    held &= (prefix >= first) & (first >= low[one, None]) & (first < high[one, None])
    i, j = np.nonzero(held)
    return i + one.start, j + two.start


def _blocks(key: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Pairs of blocks of sorted rows that hold every pair of rows of one key: whole meetings, as many as fit into one
    block, or the blocks of a larger meeting with each other."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(starts[1:], len(key))
    m = 0
    while m < len(starts):
        begin = int(starts[m])
        last = max(m, int(np.searchsorted(ends, begin + BLOCK, "right")) - 1)
        end = int(ends[last])
        cuts = range(begin, end, BLOCK)
        for a in cuts:
            for b in range(a, end, BLOCK):
                yield slice(a, min(a + BLOCK, end)), slice(b, min(b + BLOCK, end))
        m = last + 1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows that come sorted by key; a meeting that goes on in the next batch waits for it."""
    waiting: pa.Table | None = None

    def found(table: pa.Table) -> pa.RecordBatch:
        key, longer, low, high, n = (table.column(c).to_numpy() for c in ("key", "longer", "low", "high", "n"))
        same = key[1:] == key[:-1]
        met = np.append(same, False) | np.append(False, same)
        key, longer, low, high, n = key[met], longer[met], low[met], high[met], n[met]
        words = np.array(table.column("word").filter(pa.array(met)).to_pylist(), dtype="S")
        ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for one, two in _blocks(key) if len(key) else ():
            # rows of one matrix only as wide as its block
            lo, hi = min(one.start, two.start), max(one.stop, two.stop)
            rows = np.concatenate([np.arange(one.start, one.stop), np.arange(two.start, two.stop)]) if one != two else np.arange(lo, hi)
            a = slice(0, one.stop - one.start)
            b = a if one == two else slice(a.stop, len(rows))
            own = words[rows]
            own = own.astype(f"S{int(np.char.str_len(own).max())}")
            i, j = compared(key[rows], longer[rows], low[rows], high[rows], own, a, b)
            ones.append(rows[i])
            others.append(rows[j])
        i, j = np.concatenate(ones), np.concatenate(others)
        here, there = np.concatenate([i, j]), np.concatenate([j, i])
        columns = [pa.array(words[here].tolist(), pa.binary()), pa.array(words[there].tolist(), pa.binary()), pa.array(n[there])]
        return pa.RecordBatch.from_arrays(columns, names=["word", "other", "other_n"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        key = table.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        waiting = table.slice(whole)
        if whole:
            yield found(table.slice(0, whole))
    if waiting is not None and waiting.num_rows:
        yield found(waiting)


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n for each two near words of `words` (word, n), in both directions."""
    dealt = meetings(words).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_near, NEAR)
    return found.select(*[F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "other")], "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the last of the forms that follow each other from `forms` (word, form).

    Each round replaces a word's root by the root of that, so the steps covered double. A form occurs MUCH_MORE times as
    often as its word, so there are no circles, and about log(log(occurrences)) rounds.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(roots.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `vocabulary`.

    Words are runs of A to Z, a to z and U+00C0 to U+00FF, with A to Z lowered; about one in SLIP loses a code point, by
    the checksum of row key and run. A word's form is its near word of largest n (ties: the first by code points) if that
    n is MUCH_MORE times its own; root follows forms to the last. Null texts have no words; a null row key counts as ''.
    Repeated rows count as often as they occur. An empty table gives no row. Other columns take no part.
    """
    words = stored(vocabulary(docs, doc_id, text))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    much = -F.col("best.n") >= MUCH_MORE * F.col("n")
    judged = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(much, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(much, -F.col("best.n")).alias("form_n"),
        )
    )
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    named = judged.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
