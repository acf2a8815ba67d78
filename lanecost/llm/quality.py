"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in SQL expression over the whole text; there is no user function and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.text import SPACES, words

SYMBOL = "[#*$%&|<>]"
WINDOW = 5
# Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by at this have from "
    "der die das und ist von zu den mit sich auf für im dem nicht ein eine als auch es an "
    "le la les de des et un une du en que est pour dans par sur au ne pas avec "
    "el los las del que y a se por con una su para es al lo como o"
).split()


@dataclass(frozen=True)
class Threshold:
    """One rule: the measure must lie in [low, high]; texts below `from_words` words are not judged by it."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# The two base rules of the query are separate (see `base_failed`); these are the method's own. None bounds the length
# of a text: the ratios judge long texts as well.
THRESHOLDS = (
    Threshold("mean_word_length", low=1.5, high=25.0),
    Threshold("symbol_ratio", high=0.3),
    Threshold("stop_word_ratio", low=0.02, from_words=50),
    Threshold("letter_ratio", low=0.4),
    Threshold("dup_line_ratio", high=0.5),
    Threshold("ellipsis_line_ratio", high=0.7),
)


def _repeated(parts: Column) -> Column:
    """Words covered by windows whose hash is found twice or more, from the windows' hashes in order."""
    by_hash = F.sort_array(F.transform(parts, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        twice = F.transform(
            ordered,
            lambda s, k: F.when(
                (s["h"] == F.get(ordered, k - 1)["h"]) | (s["h"] == F.get(ordered, k + 1)["h"]), s["i"]
            ),
        )
        return F.sort_array(F.array_compact(twice))

    def covered(acc: Column, start: Column) -> Column:
        return F.struct(
            (start + WINDOW).alias("end"),
            (acc["n"] + start + WINDOW - F.greatest(start, acc["end"])).alias("n"),
        )

    # transform over a one-element array names the sorted list, so it is sorted once
    listed = F.get(F.transform(F.array(by_hash), starts), F.lit(0))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(listed, zero, covered, lambda acc: acc["n"].cast("long"))
    return F.when(F.size(F.array_distinct(parts)) < F.size(parts), total).otherwise(F.lit(0).cast("long"))


def _kept_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def measured(frame: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct column `out` with the counts and ratios of every whole text.

    A null text counts as empty; ratios of an empty text are 0. Other columns, whatever their names, pass
    through, but for a column called as `out`, which is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    steps = frame.withColumn(
        out, F.struct(body.alias("text"), words(body).alias("words"), _kept_lines(F.split(body, "\n")).alias("lines"))
    )
    q = F.col(out)
    steps = steps.withColumn(out, q.withField("joined", F.array_join(q["words"], " ")))
    last = F.size(q["words"]) - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(q["words"], i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    steps = steps.withColumn(out, q.withField("windows", windows))
    body = q["text"]
    total = F.size(q["words"]).cast("long")
    chars = (F.length(q["joined"]) - F.greatest(total - 1, F.lit(0))).cast("long")
    symbols = F.regexp_count(body, F.lit(SYMBOL)).cast("long")
    lines = F.size(q["lines"])
    repeated_lines = (lines - F.size(F.array_distinct(q["lines"]))).cast("long")
    stops = F.size(F.filter(q["words"], lambda w: w.isin(STOP_WORDS)))
    letters = chars - F.regexp_count(body, F.lit(r"[^\p{L}\x20\x09-\x0D]"))
    dots = F.size(F.filter(q["lines"], lambda x: F.rtrim(x).endswith("...")))

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return steps.withColumn(
        out,
        F.struct(
            total.alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            repeated_lines.alias("n_dup_lines"),
            _repeated(q["windows"]).alias("n_repeat_words"),
            ratio(chars, total).alias("mean_word_length"),
            ratio(symbols, total).alias("symbol_ratio"),
            ratio(stops, total).alias("stop_word_ratio"),
            ratio(letters, chars).alias("letter_ratio"),
            ratio(repeated_lines, lines).alias("dup_line_ratio"),
            ratio(dots, lines).alias("ellipsis_line_ratio"),
        ),
    )


def base_failed(quality: Column) -> Column:
    """Too short, or more than a fifth of the words repeat within the text."""
    return (quality["n_words"] < 10) | (100 * quality["n_repeat_words"] > 20 * quality["n_words"])


def failed_rules(quality: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The names of the rules that a text breaks, in the order of the table."""
    broken = []
    for rule in thresholds:
        value = quality[rule.measure]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        broken.append(F.when(bad & (quality["n_words"] >= rule.from_words), F.lit(rule.measure)))
    return F.array_compact(F.array(*broken)).cast("array<string>")


def judged(
    frame: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS, out: str = "quality"
) -> DataFrame:
    """`measured` with three more fields: base_failed, failed (rule names) and kept."""
    q = F.col(out)
    rows = measured(frame, text, out)
    rows = rows.withColumn(
        out, q.withField("base_failed", base_failed(q)).withField("failed", failed_rules(q, thresholds))
    )
    return rows.withColumn(out, q.withField("kept", ~q["base_failed"] & (F.size(q["failed"]) == 0)))


def passing(frame: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of `frame` that are kept, with their own columns.

    The row number in the condition holds the filter above the measures. Without it Spark would put the whole
    expression of every measure into the filter, once for each use.
    """
    free = "_" * (1 + max(map(len, frame.columns)))  # longer than any name of the frame
    row, out = f"{free}row", f"{free}quality"
    numbered = judged(frame, text, thresholds, out).withColumn(row, F.monotonically_increasing_id())
    return numbered.where(F.col(f"{out}.kept") & (F.col(row) >= 0)).select(*[F.col(f"`{c}`") for c in frame.columns])
