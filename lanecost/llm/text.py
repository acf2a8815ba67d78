"""Words as the operators count them, for Spark columns and for Python batches.

A word is a maximal run of characters other than space and \\x09 to \\x0D. `bytes.split()` without
arguments splits UTF-8 at exactly these six bytes, and `bytes.lower()` lowers exactly A to Z.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and for texts without words."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, tokens), dtype=np.uint64, count=len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values: multiply and fold, twice."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(hashed: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `length` consecutive words, from the words' hashes, in order."""
    n = len(hashed) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for k in range(length):
        out = (out * np.uint64(0xD6E8FEB86659FD93)) ^ hashed[k : k + n]
        out ^= out >> np.uint64(31)
    return mixed(out)
