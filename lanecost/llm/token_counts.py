"""Exact token counts of every prefix of a text, by dynamic programming.

The tokens of a byte string under BPE end in a token t such that the tokens of the rest are followed by t
unchanged, and this holds for one t only. So the count of each prefix is one more than that of a shorter prefix,
and a word is counted at all its ends in one pass. A neighbour check of two tokens decides if t fits; its answers
are kept. Prefix counts of a text are those of its chunks on top of each other. They answer how many tokens any
cut has, and where to cut for a budget, without encoding again.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanecost.llm.bpe import MARKS, PLAIN, Chunks, library, slices, special_strings

# The pattern that cuts a text before merging, with white space as Unicode has it.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPACES = regex.compile(r"\p{White_Space}+")
MOST_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts(Chunks):
    """Token counts after each character of chunks."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        as_bytes = {k: bytes(letters[c] for c in k) for k in model["vocab"] if all(c in letters for c in k)}
        self.ids = {v: model["vocab"][k] for k, v in as_bytes.items()}
        self.bytes = {i: v for v, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.single = {v: i for v, i in self.ids.items() if self.merged(v) == [i]}
        self.specials = special_strings(library(path))

    def merged(self, text: bytes) -> list[int]:
        """The tokens of a byte string, merge by merge."""
        out = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(out) > 1:
            rank, token, at = min(
                (*self.ranks.get(p, (1 << 40, 0)), i) for i, p in enumerate(zip(out, out[1:], strict=False))
            )
            if rank == 1 << 40:
                break
            out[at : at + 2] = [token]
        return out

    def follows(self, a: int, b: int) -> bool:
        """If the tokens of a's and b's bytes together are a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def word(self, text: bytes) -> list[int]:
        """Token counts of the byte string's prefixes, from the empty one on."""
        counts, last = [0] * (len(text) + 1), [0] * (len(text) + 1)
        self._fill(text, 1, counts, last)
        return counts

    def _fill(self, text: bytes, begin_at: int, counts: list[int], last: list[int]) -> None:
        single, pairs = self.single, self.pairs
        for end in range(begin_at, len(text) + 1):
            for begin in range(end - self.longest if end > self.longest else 0, end):
                token = single.get(text[begin:end])
                if token is None:
                    continue
                if begin:
                    pair = (last[begin], token)
                    good = pairs.get(pair)
                    if not (self.follows(*pair) if good is None else good):
                        continue
                counts[end], last[end] = counts[begin] + 1, token
                break

    def sorted_words(self, texts: list[bytes]) -> dict[bytes, list[int]]:
        """`word` of each; in order, so that a word goes on where it parts from the one before."""
        out = {}
        before, counts, last = b"", [0], [0]
        for text in sorted(texts):
            same = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                same += 1
            more = [0] * (len(text) - same)
            counts, last = counts[: same + 1] + more, last[: same + 1] + more
            self._fill(text, same + 1, counts, last)
            out[text] = counts
            before = text
        return out

    def prefixes(self, text: str) -> list[int]:
        """Token counts of a text's prefixes, from one character on; special strings count as ordinary text.

        A prefix that ends within white space has the white space so far as one piece, whereas the whole text
        gives the last of it to the piece that follows. A prefix that ends within 're, 've or 'll has an
        apostrophe and a letter.
        """
        out: list[int] = []
        base = space_base = space_begin = space_end = 0
        space_counts: list[int] = []
        for m in PATTERN.finditer(text):
            begin, end = m.span()
            piece = m[0]
            if begin >= space_end and piece[0].isspace() and (run := SPACES.match(text, begin)):
                space_base, (space_begin, space_end) = base, run.span()
                space_counts = self.at_characters(run[0])
            counts = self.at_characters(piece)
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                counts[2] = counts[1] + self.at_characters(piece[1])[1]
            for k in range(begin + 1, end + 1):
                if k <= space_end:
                    out.append(space_base + space_counts[k - space_begin])
                else:
                    out.append(base + counts[k - begin])
            base += counts[-1]
        return out

    def at_characters(self, piece: str) -> list[int]:
        data = piece.encode()
        counts = self.word(data)
        return counts if len(data) == len(piece) else self.of_characters(piece, counts)

    @staticmethod
    def of_characters(piece: str, counts: list[int]) -> list[int]:
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # most chunks are a space, letters and perhaps a mark: one or two pieces
        stems = [(c[:-1] if c[-1] in MARKS else c) if PLAIN.fullmatch(c) else "" for c in chunks]
        known = self.sorted_words(list({s.encode() for s in stems if s}))
        lists = []
        for chunk, stem in zip(chunks, stems, strict=True):
            if not stem:
                lists.append(self.prefixes(chunk))
                continue
            data = stem.encode()
            counts = known[data]
            counts = counts[1:] if len(data) == len(stem) else self.of_characters(stem, counts)[1:]
            lists.append(counts if len(stem) == len(chunk) else [*counts, counts[-1] + 1])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = itertools.chain.from_iterable(lists)
        return np.fromiter(flat, np.int32, int(sizes.sum())), sizes

    def counted(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the token counts of its prefixes from one character on (int64)."""
        plain = [t if not any(s in t for s in self.specials) else "" for t in texts]
        starts, sizes, counts = self.looked_up(plain)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        # what the chunks before this one in its text add up to
        own = np.where(sizes > 0, self.values[np.maximum(starts + sizes - 1, 0)], 0).astype(np.int64)
        before = np.cumsum(own) - own
        first = np.cumsum(counts) - counts
        before -= np.repeat(before[first], counts)
        flat = self.values[where] + np.repeat(before, sizes)
        bounds = np.concatenate([[0], ends])[np.concatenate([first[1:], [len(sizes)]])]
        out = np.split(flat, bounds[:-1])
        return [x if t == p else self.with_specials(t) for x, t, p in zip(out, texts, plain, strict=True)]

    def with_specials(self, text: str) -> np.ndarray:
        """`counted` for a text that holds special strings: each is one token and parts what stands around it."""
        out, base, at = [], 0, 0
        while True:
            hits = [(text.find(s, at), -len(s), s) for s in self.specials if text.find(s, at) >= 0]
            if not hits:
                break
            begin, _, special = min(hits)
            cut = self.prefixes(text[at:begin] + special[:-1])
            out.extend(base + c for c in cut)
            base += (cut[begin - at - 1] if begin > at else 0) + 1
            out.append(base)
            at = begin + len(special)
        out.extend(base + c for c in self.prefixes(text[at:]))
        return np.array(out, np.int64)


_counters: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """One counter for each worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounts(path)
    return _counters[path]


def cut(prefix_counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens. Counts may fall as a prefix grows, as a longer
    token may take the place of several."""
    if budget < 0:
        return 0
    fitting = np.flatnonzero(prefix_counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def stored_counts(prefix_counts: np.ndarray) -> bytes:
    """Prefix counts as little-endian 16-bit steps from one prefix to the next; a step is within the length of the
    longest token, in bytes, and what one character adds."""
    return np.diff(prefix_counts, prepend=0).astype("<i2").tobytes()


def loaded_counts(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i2"), dtype=np.int64)


def counted(
    docs: DataFrame,
    vocabulary: str,
    budget: int,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    table: bool = True,
) -> DataFrame:
    """doc_id, the columns of `keep`, n_tokens and cut_chars (the longest prefix within `budget` tokens, in code
    points) of each row, and with `table` the column prefix_counts (see `loaded_counts`), which has every prefix of
    the whole text.

    Null texts count as empty. Repeated rows each give a row. Other columns take no part.
    """
    kept = docs.select(F.col(doc_id).alias("doc_id"), *keep)
    new = {"n_tokens": T.LongType(), "cut_chars": T.LongType()} | ({"prefix_counts": T.BinaryType()} if table else {})
    schema = T.StructType(kept.schema.fields + [T.StructField(n, t) for n, t in new.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for begin, run in slices(texts):
                lists = counter(vocabulary).counted(run)
                columns = [
                    *(c.slice(begin, len(run)) for c in batch.columns[:-1]),
                    pa.array([int(x[-1]) if len(x) else 0 for x in lists], pa.int64()),
                    pa.array([cut(x, budget) for x in lists], pa.int64()),
                ]
                if table:
                    columns.append(pa.array([stored_counts(x) for x in lists], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text")).mapInArrow(count, schema)


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> None:
    """Write doc_id, the columns of `keep` and prefix_counts of every whole text below `path`."""
    whole = counted(docs, vocabulary, 0, doc_id, text, keep)
    whole.select("doc_id", *keep, "prefix_counts").write.option("compression", "zstd").parquet(path)


def read(table: DataFrame, budget: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, n_tokens and cut_chars (see `counted`) from the stored counts of a table that
    `write` has made, without the texts."""
    kept = table.select("doc_id", *keep)
    new = [T.StructField(n, T.LongType()) for n in ("n_tokens", "cut_chars")]
    schema = T.StructType(kept.schema.fields + new)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, cuts = [], []
            for data in batch.column(batch.num_columns - 1):
                counts = loaded_counts(data.as_py())  # of one text at a time, as they are four times the stored bytes
                totals.append(int(counts[-1]) if len(counts) else 0)
                cuts.append(cut(counts, budget))
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.select("doc_id", *keep, "prefix_counts").mapInArrow(answered, schema)
