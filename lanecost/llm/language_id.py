"""Language identification, word first with backoff to shorter and shorter character n-grams.

A known word scores by the logarithm of its frequency in each language. An unseen word is taken apart into its
character n-grams of the greatest length of which one is known, and scores by their mean; without any, it scores
nothing. A text takes the language with the best mean over its words.

The model is fitted on a bounded sample: SAMPLE_DOCS documents of each language (expected; chosen by a hash of the
id) and the MOST_WORDS and MOST_GRAMS most frequent entries, so it fits in each worker whatever the corpus. Every
document is scored as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.bpe import slices
from lanecost.llm.scratch import stored

SAMPLE_DOCS = 3_000
MOST_WORDS = 120_000
MOST_GRAMS = 20_000  # of each length
LONGEST_GRAM = 5
MOST_SEEN = 300_000
PENALTY = 7.0  # of an entry that a language lacks: minus the decimal logarithm of a frequency
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, length: int) -> list[str]:
    """Character n-grams of a word with a space before and after it."""
    padded = f" {word} "
    return [padded[i : i + length] for i in range(len(padded) - length + 1)]


@dataclass(frozen=True)
class Model:
    """Scores by entry and language; `tables[0]` has words, `tables[n]` the n-grams of that length."""

    languages: tuple[str, ...]
    prior: int  # the language of most documents
    tables: tuple[dict[str, int], ...]
    scores: np.ndarray  # entries x languages, the last row zero
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def backed_off(self, word: str) -> np.ndarray:
        """The score of a word that is not in the words' table. Kept, as rare words recur."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= MOST_SEEN:
            self.seen.clear()
        self.seen[word] = score = self._by_grams(word)
        return score

    def _by_grams(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            table = self.tables[n]
            rows = [table[g] for g in grams_of(word, n) if g in table and (n > 1 or g != " ")]
            if rows:
                return self.scores[rows].mean(axis=0)
        return self.scores[-1]

    def predicted(self, text: str) -> tuple[str, float]:
        """Language and its share of confidence among all languages; UNKNOWN and 0 without a letter."""
        found = words_of(text)
        get = self.tables[0].get
        rows = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        unseen = Counter(found[i] for i in np.flatnonzero(rows < 0).tolist())
        unseen = {w: n for w, n in unseen.items() if any(c.isalpha() for c in w)}
        count = int((rows >= 0).sum()) + sum(unseen.values())
        if not count or not self.languages:
            return UNKNOWN, 0.0
        total = self.scores[rows[rows >= 0]].sum(axis=0)
        for word, n in unseen.items():
            total = total + n * self.backed_off(word)
        mean = total / count
        if not (mean > mean.min()).any():
            return self.languages[self.prior], 1.0 / len(self.languages)
        best = int(mean.argmax())
        share = 1.0 / float(np.power(10.0, mean - mean[best]).sum())
        return self.languages[best], min(1.0, max(0.0, share))


def _sampled(labelled: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` rows of each language, all if it has fewer. Only ids and languages are read to choose."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return labelled.join(F.broadcast(sizes), "lang").where(draw * F.col("n") < per_language)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language of a task's texts."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items() if any(c.isalpha() for c in w)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["lang", "entry", "n"],
        )


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language and length of a task's words."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for length in range(1, LONGEST_GRAM + 1):
                for gram in grams_of(word, length):
                    counts[lang, length, gram] += n
        columns = [[k[0] for k in counts], [k[1] for k in counts], [k[2] for k in counts], list(counts.values())]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "length", "entry", "n"])


def fitted(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """A model from rows with id, lang and text (none null)."""
    sample = _sampled(labelled, per_language)
    words = sample.select("lang", "text").mapInArrow(_counted, "lang string, entry string, n bigint")
    words = stored(words.groupBy("lang", "entry").agg(F.sum("n").alias("n")))
    grams = words.mapInArrow(_gram_counts, "lang string, length int, entry string, n bigint")
    grams = grams.groupBy("lang", "length", "entry").agg(F.sum("n").alias("n"))
    every = stored(words.select("lang", F.lit(0).alias("length"), "entry", "n").unionByName(grams))
    sums = every.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()  # a row for each language and length
    totals = {(r["lang"], r["length"]): r["n"] for r in sums}
    by_entry = every.groupBy("length", "entry").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")
    )
    by_entry = stored(by_entry.where("total > 1"))
    tables: list[dict[str, int]] = []
    rows: list[np.ndarray] = []
    languages = tuple(sorted({lang for lang, _ in totals}))
    place = {lang: i for i, lang in enumerate(languages)}
    for length in range(LONGEST_GRAM + 1):
        own = by_entry.where(F.col("length") == length)
        most = MOST_GRAMS if length else MOST_WORDS
        # bounded: the most frequent entries of one length, each with a count per language
        kept = own.orderBy(F.desc("total"), "entry").limit(most).collect()
        table = {}
        for r in kept:
            scores = np.full(len(languages), -PENALTY, np.float32)
            for lang, n in r["by_lang"]:
                scores[place[lang]] = max(-PENALTY, np.log10(n / totals[lang, length]))
            table[r["entry"]] = len(rows)
            rows.append(scores)
        tables.append(table)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    prior = min(range(len(languages)), key=lambda i: (-sizes.get(languages[i], 0), languages[i]), default=0)
    scores = np.array([*rows, np.zeros(len(languages), np.float32)], np.float32).reshape(len(rows) + 1, len(languages))
    return Model(languages, prior, tuple(tables), scores)


def predicted(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()
) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score (0 to 1) of every row; nothing but the text decides.

    A text that is null or has no letter gets UNKNOWN and score 0, and so does every text if nothing was learned. A
    text of unknown letters only gets the most frequent language. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS
    kept = docs.select(F.col(doc_id).alias("doc_id"), *keep)
    schema = kept.schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, run in slices(batch.column(batch.num_columns - 1).to_pylist()):
                answers = [shared.value.predicted(t) for t in run]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(begin, len(run)) for c in batch.columns[:-1]),
                        pa.array([a[0] for a in answers], pa.string()),
                        pa.array([a[1] for a in answers], pa.float64()),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text")).mapInArrow(predict, schema)
