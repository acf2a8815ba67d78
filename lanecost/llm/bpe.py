"""Byte-level BPE of whole texts, with work per distinct stretch of text instead of per occurrence.

A text is cut into chunks where the tokenizer's pattern always begins a piece; a chunk is tokenized when a worker
first meets it, and a text is put together from its chunks' results by array operations. The cache of a worker is
bounded; when it is full, the chunks that were used again stay.

`Chunks` cuts at a space between two characters that are no white space, and finds chunks as strings. `Encoder` works
on the texts' bytes: it also cuts between letters, digits and signs, and finds chunks by the hash of their bytes.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import xxhash

BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
# A space, Latin letters and perhaps one mark.
PLAIN = re.compile(r" [A-Za-zÀ-ÖØ-öø-ɏ]+[.,!?:;]?")
MARKS = ".,!?:;"
TOGETHER = 200
MOST_CHUNKS = 1_000_000
MOST_VALUES = 16_000_000
UNKNOWN, RAGGED = -1, -2
SLICE_CHARS = 1_000_000
# Of the encoder: bytes of known chunks, chunks that are looked up at a time, bytes from which a chunk is hashed alone.
MOST_KEY_BYTES = 32_000_000
MOST_AT_ONCE = 200_000
LONG = 64
WORD = 8
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(WORD + 1)], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER, DIGIT, SIGN, SPACE, OTHER, UNSURE = range(6)
# Classes by a character's first byte, and second bytes of characters among which white space may be. The
# letters are those of ASCII, U+00C0 to U+024F without two signs, and U+0400 to U+047F.
BYTE_CLASS = np.full(256, UNSURE, np.uint8)
BYTE_CLASS[0x21:0x7F] = SIGN
BYTE_CLASS[0xC3:0xF5] = OTHER
for _first, _last in ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9), (0xD0, 0xD1)):
    BYTE_CLASS[_first : _last + 1] = LETTER
BYTE_CLASS[0x30:0x3A] = DIGIT
BYTE_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
UNSURE_SECONDS = {0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80,), 0xEF: (0xBB,)}


def slices(texts: list[str | None], size: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about `size` characters (one text at least), null as empty."""
    begin, run, chars = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        chars += len(run[-1])
        if chars >= size:
            yield begin, run
            begin, run, chars = i + 1, [], 0
    if run:
        yield begin, run


def _ragged(part: str) -> bool:
    return not part or part[0].isspace() or part[-1].isspace()


class Chunks:
    """Values (counts, say) of chunks, found once and then looked up.

    A subclass gives `found(chunks)`: for a list of chunk texts, the values of all of them in one array, and how
    many each has.
    """

    def __init__(self) -> None:
        # parts after a space, first parts, and chunks of texts that the cheap cut does not fit
        self.index: tuple[dict[str, int], dict[str, int], dict[str, int]] = ({}, {}, {})
        self.values = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.uses = np.zeros(1 << 16, np.int32)
        self.n = 0

    def _shrink(self) -> None:
        """Keep the chunks that were used most since the last time, at most half of what fits."""
        uses = self.uses[: self.n]
        kept = np.flatnonzero(uses >= 2)
        if len(kept) > MOST_CHUNKS // 2:
            kept = kept[np.argsort(uses[kept])[-MOST_CHUNKS // 2 :]]
        starts, sizes = np.concatenate(self.starts)[kept], np.concatenate(self.sizes)[kept]
        if sizes.sum() > MOST_VALUES // 2:
            kept, starts, sizes = kept[:0], starts[:0], sizes[:0]
        ends = np.cumsum(sizes)
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        row = np.full(self.n, UNKNOWN)
        row[kept] = np.arange(len(kept))
        row = row.tolist()
        self.values[: len(where)] = self.values[where]
        self.used, self.n = len(where), len(kept)
        self.starts, self.sizes = [ends - sizes], [sizes]
        self.uses = np.zeros(1 << 16, np.int32)
        self.index = tuple(
            {k: row[r] for k, r in index.items() if r >= 0 and row[r] >= 0} for index in self.index
        )

    def found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _add(self, index: dict[str, int], new: list[str], chunks: list[str]) -> None:
        values, sizes = self.found(chunks)
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.empty(len(self.values) // 2, np.int32)])
        self.values[self.used : self.used + len(values)] = values
        self.starts.append(self.used + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.used += len(values)
        index.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)

    def _rows(self, index: dict[str, int], keys: list[str]) -> list[int]:
        if new := [k for k in dict.fromkeys(keys) if k not in index]:
            self._add(index, new, new)
        return [index[k] for k in keys]

    def looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' chunks in order: where their values start, how many there are, and how many chunks a text has."""
        later, bare, whole = self.index
        if len(later) + len(bare) + len(whole) > MOST_CHUNKS or self.used > MOST_VALUES:
            self._shrink()
            later, bare, whole = self.index
        flat: list[str] = []
        cuts = []
        for t in texts:
            parts = t.split(" ")
            flat += parts
            cuts.append(len(parts))
        counts = np.array(cuts, np.int64)
        first = np.cumsum(counts) - counts
        rows = np.fromiter(map(later.get, flat, itertools.repeat(UNKNOWN)), np.int64, len(flat))
        rows[first] = 0
        missing = np.flatnonzero(rows == UNKNOWN).tolist()
        new = {flat[i] for i in missing}
        ragged = {p for p in new if _ragged(p)}
        later.update(dict.fromkeys(ragged, RAGGED))
        if new := list(new - ragged):
            self._add(later, new, [" " + p for p in new])
        rows[missing] = [later[flat[i]] for i in missing]
        # white space at an end of a part shows that the cheap cut is not right for its text
        wrong = np.add.reduceat(rows == RAGGED, first) > 0
        heads = [flat[i] for i in first.tolist()]
        wrong |= np.array([n > 1 and _ragged(h) for n, h in zip(cuts, heads, strict=True)])
        rows[first] = self._rows(bare, ["" if w else h for w, h in zip(wrong.tolist(), heads, strict=True)])
        if wrong.any():
            by_text = np.split(rows, first[1:])
            for k in np.flatnonzero(wrong).tolist():
                by_text[k] = np.array(self._rows(whole, BOUNDARY.split(texts[k])), np.int64)
            counts = np.fromiter(map(len, by_text), np.int64, len(by_text))
            rows = np.concatenate(by_text)
        if self.n > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(self.n, np.int32)])
        used = np.bincount(rows)
        self.uses[: len(used)] += used.astype(np.int32)
        if len(self.starts) > 1:
            self.starts, self.sizes = [np.concatenate(self.starts)], [np.concatenate(self.sizes)]
        return self.starts[0][rows], self.sizes[0][rows], counts


def library(path: str):
    """The tokenizer of a .json file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Known:
    """Token ids of chunks that a worker has met, found by hash and confirmed by their bytes.

    An open-addressing table leads from a chunk's hash to its row, the row to its bytes and to its ids.
    """

    def __init__(self) -> None:
        self.bits = 17
        self.table = np.full(1 << self.bits, UNKNOWN, np.int32)
        self.n = 0
        # by row: hash, place and length of the bytes, place and number of the ids, slices that had the chunk
        self.rows = {
            "hash": np.empty(0, np.uint64),
            "key": np.empty(0, np.int64),
            "length": np.empty(0, np.int64),
            "start": np.empty(0, np.int64),
            "size": np.empty(0, np.int64),
            "uses": np.empty(0, np.int32),
        }
        self.keys, self.n_keys = np.zeros(1 << 16, np.uint8), 0
        self.values, self.n_values = np.empty(1 << 16, np.int32), 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes, UNKNOWN where there is none."""
        at, own = self._slots(hashes), self.rows["hash"]
        out = self.table[at]
        if not self.n:
            return out
        wrong = np.flatnonzero((own[out] != hashes) & (out != UNKNOWN))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.table[at[wrong]]
            wrong = wrong[(out[wrong] != UNKNOWN) & (own[out[wrong]] != hashes[wrong])]
        return out

    def _filed(self, rows: np.ndarray) -> None:
        """Put rows into the table, each into the first free slot from its own on."""
        at = self._slots(self.rows["hash"][rows])
        while len(rows):
            free = self.table[at] == UNKNOWN
            self.table[at[free]] = rows[free]
            left = self.table[at] != rows  # of several rows that saw the same free slot, one has it
            rows, at = rows[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _sized(self) -> None:
        while self.n > (1 << self.bits) // 2:
            self.bits += 1
        if len(self.table) < 1 << self.bits:
            self.table = np.full(1 << self.bits, UNKNOWN, np.int32)
            self._filed(np.arange(self.n))

    def add(
        self, hashes: np.ndarray, keys: np.ndarray, lengths: np.ndarray, values: np.ndarray, sizes: np.ndarray
    ) -> None:
        """Add chunks with distinct new hashes; their bytes and their ids lie end to end."""
        first, m = self.n, len(hashes)
        if first + m > len(self.rows["hash"]):
            more = max(m, first // 2, 1 << 12)
            self.rows = {k: np.concatenate([v[:first], np.zeros(more, v.dtype)]) for k, v in self.rows.items()}
        own = {
            "hash": hashes,
            "key": self.n_keys + np.cumsum(lengths) - lengths,
            "length": lengths,
            "start": self.n_values + np.cumsum(sizes) - sizes,
            "size": sizes,
            "uses": 0,
        }
        for name, column in own.items():
            self.rows[name][first : first + m] = column
        self.keys = _room(self.keys, self.n_keys, len(keys) + WORD)
        self.keys[self.n_keys : self.n_keys + len(keys)] = keys
        self.values = _room(self.values, self.n_values, len(values))
        self.values[self.n_values : self.n_values + len(values)] = values
        self.n, self.n_keys, self.n_values = first + m, self.n_keys + len(keys), self.n_values + len(values)
        if self.n > (1 << self.bits) // 2:
            self._sized()
        else:
            self._filed(np.arange(first, self.n))

    def shrunk(self) -> Known:
        """The chunks that were used most, at most half of what fits; if they are too large, none."""
        rows = {k: v[: self.n] for k, v in self.rows.items()}
        kept = np.flatnonzero(rows["uses"] >= 2)
        if len(kept) > MOST_CHUNKS // 2:
            kept = kept[np.argsort(rows["uses"][kept])[-MOST_CHUNKS // 2 :]]
        if rows["size"][kept].sum() > MOST_VALUES // 2 or rows["length"][kept].sum() > MOST_KEY_BYTES // 2:
            kept = kept[:0]
        out = Known()
        if len(kept):
            lengths, sizes = rows["length"][kept], rows["size"][kept]
            keys = self.keys[_places(rows["key"][kept], lengths)]
            out.add(rows["hash"][kept], keys, lengths, self.values[_places(rows["start"][kept], sizes)], sizes)
        return out

    def full(self) -> bool:
        return self.n > MOST_CHUNKS or self.n_values > MOST_VALUES or self.n_keys > MOST_KEY_BYTES


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, longer if `more` values do not fit behind the used ones."""
    if used + more <= len(array):
        return array
    return np.concatenate([array[:used], np.zeros(max(more, used // 2), array.dtype)])


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; the last WORD - 1 places have none."""
    return np.ndarray((len(data) - WORD + 1,), "<u8", data, strides=(1,))


def classes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the class of its character: LETTER, DIGIT, SIGN, SPACE, OTHER or UNSURE.

    OTHER is no white space, but may be a letter, a digit or a sign. UNSURE may be anything.
    """
    out = BYTE_CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        kind = BYTE_CLASS[first]
        kind[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))] = OTHER
        for byte, seconds in UNSURE_SECONDS.items():
            if (mine := first == byte).any():
                kind[mine & np.isin(second, seconds)] = UNSURE
        out[lead + 1] = kind
        for width, least in ((2, 0xE0), (3, 0xF0)):
            longer = first >= least
            out[lead[longer] + width] = kind[longer]
        out[lead] = kind
    return out


def cuts(data: np.ndarray, kinds: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern surely begins a piece, and finds the same pieces if the text is cut there.

    `sure` tells the bytes of characters that are no white space. Pieces are runs of one class, perhaps after one space.
    So a piece ends where a sure class changes, except that an apostrophe may belong to the letters after it, and white
    space to what follows. A single line break between two characters that are no white space is a piece of its own.
    """
    out = np.zeros(len(data), bool)
    plain = sure & (kinds != OTHER)
    out[1:] = plain[1:] & plain[:-1] & (kinds[1:] != kinds[:-1])
    out[1:] &= (data[:-1] != ord("'")) | (kinds[1:] != LETTER)
    out[1:] |= sure[:-1] & (kinds[1:] == SPACE)
    out[2:] |= (data[1:-1] == ord("\n")) & sure[:-2] & sure[2:]
    return out


class Encoder:
    """Token ids as the library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.specials = special_strings(self.tokenizer)
        self.mark = self.specials[0]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        before = self.tokenizer.pre_tokenizer
        pattern = type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        # a letter of the vocabulary stands for a byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if not pattern or self.tokenizer.normalizer is not None or sum(len(t) == 1 for t in vocabulary) != 256:
            raise ValueError("not a byte-level vocabulary of all bytes with the usual pattern")
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known = Known()

    def together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, which it tokenizes apart, many in a call, when a special string joins them."""
        out, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        joined = [self.mark.join(chunks[k : k + TOGETHER]) for k in range(0, len(chunks), TOGETHER)]
        for own in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(own.ids, np.int32)
            at = np.flatnonzero(ids == self.mark_id)
            bounds = np.concatenate([[-1], at, [len(ids)]])
            sizes.append(np.diff(bounds) - 1)
            out.append(np.delete(ids, at))
        return np.concatenate(out), np.concatenate(sizes)

    def in_a_row(self, keys: np.ndarray, lengths: np.ndarray, broken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks that it tokenizes apart when they follow each other, the `broken` ones after a
        line break. The bytes of the tokens tell whose they are."""
        ends = np.cumsum(lengths + broken)
        starts = ends - lengths
        row = np.full(int(ends[-1]) if len(ends) else 0, ord("\n"), np.uint8)
        row[_places(starts, lengths)] = keys
        bounds = [0, *ends[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(row)]
        joined = [row[a:b].tobytes().decode() for a, b in itertools.pairwise(bounds)]
        if any(s in t for s in self.specials for t in joined):
            begins = np.cumsum(lengths) - lengths
            return self.together([keys[b : b + n].tobytes().decode() for b, n in zip(begins, lengths, strict=True)])
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.int32), *(np.array(own.ids, np.int32) for own in found)])
        upto = np.cumsum(self.n_bytes[ids])
        first, last = np.searchsorted(upto, starts, "right"), np.searchsorted(upto, ends, "right")
        return ids[_places(first, last - first)], last - first

    def _hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list]:
        """The hashes of chunks, and the words that they were made of, by eights of bytes."""
        hashes = lengths.astype(np.uint64) * BASE
        at, words, view = np.arange(len(starts)), [], _words(data)
        for k in range(0, LONG, WORD):
            left = lengths[at] - k
            if k:
                at = at[left > 0]
                left = left[left > 0]
            if not len(at):
                break
            word = view[starts[at] + k] & MASKS[np.minimum(left, WORD)]
            words.append((at, k, word))
            own = (hashes[at] ^ word) * BASE
            own ^= own >> np.uint64(32)
            hashes[at] = own * BASE
        for i in np.flatnonzero(lengths > LONG).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
        return hashes, words

    def _other(
        self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: list
    ) -> np.ndarray:
        """Chunks whose bytes are not those of their row, as two may share a hash."""
        key = self.known.rows["key"][rows]
        wrong = self.known.rows["length"][rows] != lengths
        view = _words(self.known.keys)
        for at, k, word in words:
            own = key[at] if k else key
            own = view[np.minimum(own + k, len(view) - 1)]
            left = lengths[at] - k
            wrong[at] |= (own & MASKS[np.minimum(left, WORD)]) != word
        for i in np.flatnonzero(~wrong & (lengths > LONG)).tolist():
            mine = data[starts[i] : starts[i] + lengths[i]]
            wrong[i] = not np.array_equal(mine, self.known.keys[key[i] : key[i] + lengths[i]])
        return np.flatnonzero(wrong)

    def _met(
        self, hashes: np.ndarray, data: np.ndarray, sure: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> None:
        """Add chunks of distinct hashes."""
        ends = starts + lengths
        after_space = (data[starts] == ord(" ")) & (lengths > 1) & sure[np.minimum(starts + 1, len(sure) - 1)]
        row = (sure[starts] | after_space) & sure[ends - 1]
        order = np.concatenate([np.flatnonzero(row), np.flatnonzero(~row)])
        m = int(row.sum())
        hashes, starts, lengths = hashes[order], starts[order], lengths[order]
        keys = data[_places(starts, lengths)]
        n = int(lengths[:m].sum())
        values, sizes = self.in_a_row(keys[:n], lengths[:m], ~after_space[order[:m]])
        rest = np.split(keys[n:], np.cumsum(lengths[m:])[:-1]) if m < len(order) else []
        more_values, more_sizes = self.together([k.tobytes().decode() for k in rest])
        self.known.add(
            hashes, keys, lengths, np.concatenate([values, more_values]), np.concatenate([sizes, more_sizes])
        )

    def _gathered(
        self, data: np.ndarray, sure: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has. `sure` bytes belong to no white space."""
        hashes, words = self._hashes(data, starts, lengths)
        rows = self.known.looked_up(hashes)
        missing = np.flatnonzero(rows == UNKNOWN)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            self._met(new, data, sure, starts[first], lengths[first])
            rows[missing] = self.known.looked_up(hashes[missing])
        known = self.known.rows
        known["uses"][rows] += 1
        sizes = known["size"][rows]
        ids = self.known.values[_places(known["start"][rows], sizes)]
        if len(other := self._other(rows, data, starts, lengths, words)):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in other.tolist():
                chunk = data[starts[i] : starts[i] + lengths[i]].tobytes().decode()
                parts[i] = self.together([chunk])[0]
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes

    def _special(self, data: np.ndarray, ends: np.ndarray) -> list[int]:
        """The texts that hold a special string."""
        whole, out = data.tobytes(), set()
        for special in map(str.encode, self.specials):
            at = whole.find(special)
            while at >= 0:
                text = int(np.searchsorted(ends, at, "right"))
                if at + len(special) <= ends[text]:
                    out.add(text)
                at = whole.find(special, at + 1)
        return sorted(out)

    def encoded_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in order, and how many each has. The texts' bytes lie end to end, `ends` tells where they end.

        Texts with special strings go to the library whole.
        """
        if self.known.full():
            self.known = self.known.shrunk()
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
        data = data[:n]
        kinds = classes(data)
        sure = (kinds != SPACE) & (kinds != UNSURE)
        begins = cuts(data, kinds, sure)
        filled = np.diff(ends, prepend=0) > 0
        begins[0] = True
        begins[ends[ends < n]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=n)
        data = np.concatenate([data, np.zeros(WORD, np.uint8)])
        ids, sizes = [], []
        for k in range(0, len(starts), MOST_AT_ONCE):
            own = slice(k, k + MOST_AT_ONCE)
            for out, part in zip((ids, sizes), self._gathered(data, sure, starts[own], lengths[own]), strict=True):
                out.append(part)
        ids, sizes = (np.concatenate(x) for x in (ids, sizes))
        counts = np.zeros(len(ends), np.int64)
        text_starts = (ends - np.diff(ends, prepend=0))[filled]
        counts[filled] = np.add.reduceat(sizes, np.searchsorted(starts, text_starts))
        if odd := self._special(data[:n], ends):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                text = data[ends[i - 1] if i else 0 : ends[i]].tobytes().decode()
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        as_bytes = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(as_bytes), np.uint8)
        return self.encoded_bytes(data, np.cumsum(np.fromiter(map(len, as_bytes), np.int64, len(texts))))
