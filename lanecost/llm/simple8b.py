"""Simple-8b: runs of unsigned integers below 2**32 in 64-bit words, packed and unpacked with array operations.

The top four bits of a word select how many values it holds and in how many bits. The largest value of a width
is an escape: the value itself stands in a separate list, in order. Each word takes the selector with the fewest
bytes per value, escapes included, so an odd wide value does not widen its neighbours.
"""

from __future__ import annotations

import numpy as np

# Values per word and bits per value, by selector.
LAYOUT = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([c for c, _ in LAYOUT], np.int64)
ESCAPE_BYTES = 4


def _without_escapes(values: np.ndarray) -> np.ndarray:
    """For each position, the selector that takes the most values from there on, none of them escaped."""
    n = len(values)
    need = np.zeros(n + 60, np.uint8)  # the first selector, counted from the narrowest, whose width holds the value
    for _, bits in LAYOUT[:-1]:
        need[:n] += values >= np.uint32((1 << bits) - 1)
    best = np.full(n, len(LAYOUT) - 1, np.int8)
    most, have = need.copy(), 1  # the largest need among the `have` values from a position on
    for s in range(len(LAYOUT) - 2, -1, -1):
        count = LAYOUT[s][0]
        while have < count:
            step = min(have, count - have)
            most[: len(most) - step] = np.maximum(most[: len(most) - step], most[step:])
            have += step
        fits = most[:n] <= s
        if not fits.any():
            break  # nor will more values fit in fewer bits
        np.copyto(best, s, where=fits)
    return best


def _sums(flags: np.ndarray, count: int, n: int) -> np.ndarray:
    """For each of the first n places, how many of `count` flags from there on are set: sums of 1, 2, 4, ... places."""
    out, at, width = np.zeros(n, np.uint8), 0, 1
    while True:
        if count & width:
            out += flags[at : at + n]
            at += width
        if 2 * width > count:
            return out
        flags = flags[:-width] + flags[width:]
        width *= 2


def _with_escapes(values: np.ndarray, best: np.ndarray) -> None:
    """Change selectors to those with fewer bytes per value, where escapes pay."""
    n = len(values)
    cost = (8.0 / COUNTS[best]).astype(np.float32)
    wide = np.zeros(n + 60, np.uint8)
    for s, (count, bits) in enumerate(LAYOUT[:-1]):
        wide[:n] = values >= np.uint32((1 << bits) - 1)
        if not wide.any():
            break  # nothing to escape here, nor in more bits
        mine = _sums(wide, count, n).astype(np.float32)
        mine *= ESCAPE_BYTES
        mine += 8
        mine /= count
        better = mine < cost
        np.copyto(best, s, where=better)
        np.minimum(cost, mine, out=cost)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and escaped values (uint32) of an array."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    narrow = values.astype(np.uint32)
    best = _without_escapes(narrow)
    _with_escapes(narrow, best)
    step, begins, at = COUNTS.astype(np.uint8)[best].tobytes(), bytearray(n), 0
    while at < n:
        begins[at] = 1
        at += step[at]
    starts = np.flatnonzero(np.frombuffer(begins, bool))
    chosen = best[starts]
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    words = np.empty(len(starts), np.uint64)
    escaped = [np.empty(0, np.int64)]
    for s, (count, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        slots = starts[mine][:, None] + np.arange(count)
        codes = padded[slots]
        top = np.uint64((1 << bits) - 1)
        over = codes >= top
        escaped.append(slots[over])
        codes[over] = top
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        words[mine] = np.bitwise_or.reduce(codes << shifts, axis=1) | (np.uint64(s) << np.uint64(60))
    return words, padded[np.sort(np.concatenate(escaped))].astype(np.uint32)


def unpacked(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values (uint32) of `packed`."""
    if not n:
        return np.empty(0, np.uint32)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    marked = np.zeros(len(out), bool)
    for s, (count, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        top = np.uint64((1 << bits) - 1)
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        codes = (words[mine][:, None] >> shifts) & top
        slots = starts[mine][:, None] + np.arange(count)
        out[slots] = codes
        marked[slots] = codes == top
    out[np.flatnonzero(marked)] = escapes
    return out[:n].astype(np.uint32)
