"""Sampled SentencePiece segmentations, and decoding without loss.

A text's pieces form a lattice. Forward filtering sums the weights of all paths to each position; backward sampling
then draws one piece after another from the end, each with its share of the paths. The draws come from a hash of the
row's key and the place in the text, so a row is segmented alike in every run, whatever the partitioning.

The vocabulary's pieces begin at a space or lie within a word, so the lattice falls apart at the spaces before words.
The new words of a slice are filtered together, position by position, and all occurrences sampled together, piece by
piece, with array operations; a worker keeps the forward shares of frequent words.

The models hold merge ranks instead of probabilities; a piece of rank r gets the Zipf weight (r + RANK_SHIFT) **
-sharpness. A larger sharpness keeps closer to the best segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanecost.llm.bpe import slices
from lanecost.llm.text import mixed

SPACE = "▁"  # the sign of a space in pieces
RANK_SHIFT = 3.0
SHARPNESS = 1.0
BYTE_WEIGHT = -40.0  # logarithm; bytes are for characters that no piece has
FLAGS = np.uint64(0x0101010101010101)
LITERAL = 0x110000  # past all characters
TABLE_BITS = 20
SLICE_CHARS = 600_000
MOST_CHARS = 1_500_000  # of words whose lattice a worker keeps
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as a hash table of its pieces, and as bytes for decoding."""

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
                self.bytes[i] = bytes([int(names[i][1:-1], 16)])
        for i in plain:
            self.bytes[i] = names[i].replace(SPACE, " ").encode()
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece spans words")
        self.longest = max(len(names[i]) for i in plain)
        self.width = -(-self.longest // 8) * 8
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.weights = np.full(size + 2, -np.inf, np.float32)
        self.weights[-1] = BYTE_WEIGHT
        self.weights[plain] = [-sharpness * np.log(rank[i] + RANK_SHIFT) for i in plain]
        codes = [np.frombuffer(names[i].encode("utf-32-le"), "<u4").astype(np.uint64) for i in plain]
        hashes = np.array([self.hashed(c) for c in codes], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # open addressing: a piece lies in the first free slot from its own on
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.ids = np.full(1 << TABLE_BITS, size, np.int32)
        for i, h in zip(plain, hashes.tolist(), strict=True):
            at = h >> (64 - TABLE_BITS)
            while self.ids[at] < size:
                at = (at + 1) % (1 << TABLE_BITS)
            self.keys[at], self.ids[at] = h, i
        self.none = size
        # words that were met: their characters, pieces and shares lie end to end
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.uses = (np.empty(0, np.int64) for _ in range(3))
        self.chars = 0
        self.codes = np.empty(0, np.uint32)
        self.lattice = np.empty((0, self.longest), np.int32)
        self.share = np.empty((0, self.width), np.float32)

    @staticmethod
    def hashed(codes: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in codes:
            h = (h + c + np.uint64(1)) * BASE
        return h[0]

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, `none` where no piece has it."""
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.ids[at]
        wrong = np.flatnonzero((out != self.none) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << TABLE_BITS) - 1)
            out[wrong] = self.ids[at[wrong]]
            wrong = wrong[(out[wrong] != self.none) & (self.keys[at[wrong]] != hashes[wrong])]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of any segmentation: pieces' bytes in a row, without the space that encoding puts first."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]

    def _lattice(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each position of the words laid end to end and each length: the piece that ends there.

        A character that no piece has is a step of one character (id -1, with BYTE_WEIGHT), spelled by its bytes.
        """
        n = len(codes)
        starts = np.concatenate([[0], ends[:-1]])
        room = np.arange(n) - np.repeat(starts, ends - starts) + 1  # characters from the word's begin, this one too
        ids = np.full((n, self.longest), self.none, np.int32)
        h = np.zeros(n, np.uint64)
        c1 = codes.astype(np.uint64) + np.uint64(1)
        # h of the piece of `length` characters that begins at i, moved to where it ends
        for length in range(1, self.longest + 1):
            m = n - length + 1
            if m <= 0:
                break
            h = (h[:m] + c1[length - 1 :]) * BASE
            inside = np.flatnonzero(room[length - 1 :] >= length)
            if not len(inside):
                break
            ids[inside + length - 1, length - 1] = self.looked_up(h[inside])
        ids[ids[:, 0] == self.none, 0] = -1
        return ids

    def _keep(self) -> None:
        """Keep the words used most since the last time, up to half of what fits."""
        rows = np.flatnonzero(self.uses >= 2)
        rows = rows[np.argsort(-self.uses[rows], kind="stable")]
        rows = rows[np.cumsum(self.sizes[rows]) <= MOST_CHARS // 2]
        starts, sizes = self.starts[rows], self.sizes[rows]
        ends = np.cumsum(sizes)
        chars = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        self.chars = len(chars)
        for table in (self.codes, self.lattice, self.share):
            table[: self.chars] = table[chars]
        row = np.full(len(self.starts), -1)
        row[rows] = np.arange(len(rows))
        row = row.tolist()
        self.known = {w: row[r] for w, r in self.known.items() if row[r] >= 0}
        self.starts, self.sizes, self.uses = ends - sizes, sizes, np.zeros(len(rows), np.int64)

    def _filtered(self, words: list[str]) -> None:
        """Add words: for each position and piece that ends there, the share of the paths with this piece or a shorter
        one last."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes = np.where(codes == ord(SPACE), np.uint32(LITERAL), codes)
        codes = np.where(codes == ord(" "), np.uint32(ord(SPACE)), codes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ids = self._lattice(codes, ends)
        # alpha[i] is the logarithm of all paths' weight up to and with position i
        alpha = np.full(len(codes), -np.inf)
        share = np.full((len(codes), self.width), 2, np.float32)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        for k in range(longest):
            at = starts[order[: alive[k]]] + k
            few = min(k + 1, self.longest)
            # a row for each length, so that the sums run over long rows
            back = at - np.arange(1, few + 1)[:, None]
            paths = alpha[np.maximum(back, 0)]
            if few == k + 1:
                paths[-1] = 0.0  # the word's begin
            paths += self.weights[ids[at, :few]].T
            top = paths.max(axis=0)
            paths -= top
            scaled = np.exp(paths, out=paths)
            sums = scaled.sum(axis=0)
            alpha[at] = top + np.log(sums)
            upto = np.cumsum(scaled, axis=0)
            upto /= sums
            upto[upto > 1 - 1e-6] = 2
            share[at, :few] = upto.T
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.chars + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        begin, self.chars = self.chars, self.chars + len(codes)
        if self.chars > len(self.codes):
            more = max(self.chars, MOST_CHARS + SLICE_CHARS)
            self.codes, self.lattice, self.share = (
                np.concatenate([t[:begin], np.empty((more - begin, *t.shape[1:]), t.dtype)])
                for t in (self.codes, self.lattice, self.share)
            )
        for table, own in ((self.codes, codes), (self.lattice, ids), (self.share, share)):
            table[begin : self.chars] = own

    def sampled(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each word, drawn by its key: piece ids in a row, and how many each word has.

        Spaces of a word become the sign of a space; that sign in a text is LITERAL, which no piece has.
        """
        distinct = dict.fromkeys(words)
        if self.chars > MOST_CHARS:
            self._keep()
        if new := [w for w in distinct if w not in self.known]:
            self._filtered(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(which, minlength=len(self.uses))
        starts, ends = self.starts, self.starts + self.sizes
        share, ids, codes = self.share, self.lattice, self.codes
        # backward: draw the last piece of each occurrence, then the one before it
        at = ends[which] - 1
        first = starts[which]
        left = np.arange(len(words))
        steps = []
        state = keys.copy()
        while len(left):
            state = mixed(state + BASE)
            draws = (state >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            below = (share[at] <= draws[:, None]).view(np.uint64)  # eight flags in a number, which a product adds up
            length = ((below * FLAGS) >> np.uint64(56)).sum(axis=1).astype(np.int64)
            length = np.minimum(length, np.minimum(at - first, self.longest - 1))
            steps.append((left, ids[at, length], at))
            at = at - length - 1
            on = at >= first
            left, at, first, state = left[on], at[on], first[on], state[on]
        # a word's pieces were drawn from its end: the last one drawn stands first
        sizes = np.zeros(len(words), np.int64)
        for rows, _, _ in steps:
            sizes[rows] += 1
        ends = np.cumsum(sizes)
        drawn = np.empty(int(ends[-1]), np.int32)
        place = np.empty(len(drawn), np.int64)
        for k, (rows, own, where) in enumerate(steps):
            slot = ends[rows] - 1 - k
            drawn[slot] = own
            place[slot] = where
        if (drawn < 0).any():
            drawn, sizes = self._spelled(drawn, np.repeat(np.arange(len(words)), sizes), codes[place])
        return drawn, sizes

    def _spelled(self, drawn: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece by the ids of their bytes; all ids, and how many each owner has."""
        alone = np.flatnonzero(drawn < 0)
        signs = [SPACE if c == LITERAL else chr(c) for c in codes[alone].tolist()]
        spelled = [self.byte_ids[list(c.encode())] for c in signs]
        sizes = np.ones(len(drawn), np.int64)
        sizes[alone] = list(map(len, spelled))
        out = np.repeat(drawn, sizes)
        out[np.repeat(drawn < 0, sizes)] = np.concatenate(spelled)
        return out, np.bincount(np.repeat(owner, sizes))


def words_of(text: str) -> list[str]:
    """A text cut before the spaces of each word; a space is put first, as the models do."""
    parts = (" " + text).split(" ")[1:]
    if "" not in parts:
        return [" " + p for p in parts]
    out, spaces = [], ""
    for p in parts:
        spaces += " "
        if p:
            out.append(spaces + p)
            spaces = ""
    return [*out, spaces] if spaces else out


_pieces: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, sharpness: float) -> Pieces:
    """One vocabulary for each worker process."""
    if (path, sharpness) not in _pieces:
        _pieces[path, sharpness] = Pieces(path, sharpness)
    return _pieces[path, sharpness]


def encoded(vocabulary: Pieces, texts: list[str], seeds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of texts in a row, and how many each text has. An empty text has none."""
    split = [words_of(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for s in split for w in s]
    seed = np.array([xxhash.xxh3_64_intdigest(s) for s in seeds], np.uint64)
    first = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
    keys = mixed(np.repeat(seed, counts) ^ mixed(place + np.uint64(1)))
    out, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    if not words:
        return np.empty(0, np.int32), counts
    # a long text in several steps
    chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    cuts = np.searchsorted(chars, np.arange(SLICE_CHARS, int(chars[-1]) + SLICE_CHARS, SLICE_CHARS)) + 1
    begin = 0
    for end in np.unique(np.minimum(cuts, len(words))).tolist():
        ids, own = vocabulary.sampled(words[begin:end], keys[begin:end])
        out.append(ids.astype(np.int32))
        sizes.append(own)
        begin = end
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return np.concatenate(out), bounds[first + counts] - bounds[first]


def segmented(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    sharpness: float = SHARPNESS,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The columns of `keep`, piece_ids and lossless (decoding gave the text) of every row.

    Rows are drawn by `seed` and the text form of `key`, so rows with one key and text are segmented alike. Null
    texts have null piece_ids and count as lossless; empty texts have none. Other columns take no part.
    """
    kept = docs.select(*keep)
    ids_type = T.ArrayType(T.IntegerType(), False)
    new = [T.StructField("piece_ids", ids_type), T.StructField("lossless", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *new])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary, sharpness)
        for batch in batches:
            texts, seeds = (batch.column(batch.num_columns - i).to_pylist() for i in (1, 2))
            for begin, run in slices(texts, SLICE_CHARS):
                ids, counts = encoded(own, run, [f"{seed}:{s}" for s in seeds[begin : begin + len(run)]])
                ends = np.cumsum(counts)
                flat = ids.tolist()
                bounds = zip(counts.tolist(), ends.tolist(), run, strict=True)
                good = [own.decoded(flat[e - n : e]) == t for n, e, t in bounds]
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                null = pa.array([t is None for t in texts[begin : begin + len(run)]], pa.bool_())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=null)
                columns = [*(c.slice(begin, len(run)) for c in batch.columns[:-2]), lists, pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    asked = docs.select(*keep, F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return asked.mapInArrow(segment, schema)


def decoded(frame: DataFrame, vocabulary: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """`frame` with the text of each row's piece ids in a column `text` (null for null ids)."""
    schema = T.StructType([f for f in frame.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    rest = [f.name for f in schema.fields[:-1]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary, SHARPNESS)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else own.decoded(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return frame.select(*rest, F.col(ids).alias("_ids")).mapInArrow(decode, schema)
