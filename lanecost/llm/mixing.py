"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells of source, language and topic. The cells' token weights are scaled to the target of
one margin after another until nothing moves. A document's probability follows from the fitted weight of its cell,
and a hash of its id, or of its text where it has none, decides, so a rerun takes the same sample.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecost.llm.scratch import stored

ROUNDS = 10_000  # beyond this fitting is an error, never a result
TOLERANCE = 1e-10
NOTHING = 1e-15  # a weight that falls below this share of all is on its way to 0
MET = 1e-8  # a margin further than this from its target is reported
TEMPER = 0.5
NONE = "\u0000"  # stands for a null source or language, a class of its own
BROADCAST_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """The shape of a text: empty, table, shouted, short, plain or long. A stand-in where a table has no topic."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = size - F.length(F.replace(text, F.lit("!!"), F.lit("")))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(bars * 50 > size, "table")
        .when(marks * 50 > size, "shouted")
        .when(size < 800, "short")
        .when(size < 4000, "plain")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Words of a text, at least one, so that an empty document has a weight too."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def keyed(
    docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`docs` with a struct column `_cell` of source, lang and topic (null as NONE), a column `_tokens`, and a column
    `_key` for the draw: the id, or where it is null a digest of source, language and text."""
    cell = F.struct(
        F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(F.col(text)).alias("topic"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in (source, lang, text)]
    key = F.when(F.col(doc_id).isNull(), F.md5(F.concat_ws(NONE, *parts))).otherwise(F.col(doc_id).cast("string"))
    return docs.withColumns({"_cell": cell, "_tokens": tokens_of(F.col(text)), "_key": key})


MARGINS = ("source", "lang", "topic")


def cells_of(marked: DataFrame) -> DataFrame:
    """Tokens of each cell of a `keyed` frame."""
    return marked.groupBy("_cell").agg(F.sum("_tokens").alias("tokens")).select("_cell.*", "tokens")


def tempered(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """Target shares of a margin: its token shares to the power `temper`, which lifts the small ones. Shares add up
    to 1."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("p"))
    total = sums.agg(F.sum("p")).first()[0] or 1.0  # one number
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def raked(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """Cells with `weight`, which adds up to 1 and meets the target share of every margin.

    A target is a frame of a margin's value and its `target`; cells of values without a target get weight 0. Fitting
    ends when no weight moves by more than `tolerance` of itself, those below NOTHING aside; if `rounds` do not
    suffice, it raises. Where targets contradict each other, the margin that comes last is met, and a warning names
    the others.
    """
    targets = {m: stored(t) for m, t in targets.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1  # one number
    begun = stored(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))))
    n_cells = begun.count()
    if not n_cells:
        return begun
    fit = _fitted_in_a_row if n_cells <= BROADCAST_CELLS else _fitted_in_frames
    fitted, moved = fit(begun, targets, rounds, tolerance)
    if not moved <= tolerance:
        raise RuntimeError(f"weights did not settle in {rounds} rounds: one still moves by {moved:.1e} of itself")
    for margin, target in targets.items():
        sums = fitted.groupBy(margin).agg(F.sum("weight").alias("s")).join(target, margin, "full")
        gap = F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))
        far = sums.agg(F.max(gap)).first()[0]  # one number
        if far > MET:
            warnings.warn(f"targets contradict each other: shares of {margin} are up to {far:.1e} off", stacklevel=2)
    return fitted


def _fitted_in_frames(
    begun: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float
) -> tuple[DataFrame, float]:
    """Fitted cells and the last move, by a job for each round."""
    fitted, moved = begun.withColumn("moved", F.lit(0.0)), float("inf")
    for _ in range(rounds):
        step = fitted.withColumn("moved", F.col("weight"))
        for margin, target in targets.items():
            sums = step.groupBy(margin).agg(F.sum("weight").alias("s"))
            factor = sums.join(target, margin).select(margin, F.try_divide("target", F.col("s")).alias("f"))
            step = step.join(factor, margin, "left").withColumn(
                "weight", F.col("weight") * F.coalesce("f", F.lit(0.0))
            )
            step = step.select(*fitted.columns)
        move = F.coalesce(F.abs(F.try_divide("weight", F.col("moved")) - 1), F.lit(0.0))
        move = F.when(F.greatest("weight", "moved") > NOTHING, move).otherwise(0.0)
        fitted = stored(step.withColumn("moved", move))
        moved = fitted.agg(F.max("moved")).first()[0]  # one number
        if moved <= tolerance:
            break
    return fitted.drop("moved"), moved


def _fitted_in_a_row(
    begun: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float
) -> tuple[DataFrame, float]:
    """`_fitted_in_frames` in one job, for cells that fit in a row: sparse cells can take hundreds of rounds."""
    margins = list(targets)
    placed = begun
    for m in margins:
        placed = placed.join(targets[m].select(m, F.col("target").alias(f"_t_{m}")), m, "left")
    # windows over all cells, of which there are BROADCAST_CELLS at most
    ranks = {f"_at_{m}": F.dense_rank().over(Window.orderBy(m)) - 1 for m in margins}
    placed = placed.withColumns({"_pos": F.row_number().over(Window.orderBy(*margins)) - 1} | ranks)
    placed = stored(placed)
    cell = F.struct("_pos", *ranks, *begun.columns)
    row = placed.agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    row = row.selectExpr("cells", "cells.weight AS begun", *[f"cells.{r} AS at_{i}" for i, r in enumerate(ranks)])
    for i, m in enumerate(margins):
        each = placed.groupBy(f"_at_{m}").agg(
            F.max(f"_t_{m}").alias("target"), F.sort_array(F.collect_list("_pos")).alias("own")
        )
        listed = F.sort_array(F.collect_list(F.struct(f"_at_{m}", "target", "own")))
        row = row.crossJoin(each.agg(listed.alias(f"of_{i}")))  # a row with a row
    # transform over a one-element array names a value, so it is worked out once
    fit = "acc.w"
    for i in range(len(margins)):
        factors = f"transform(of_{i}, g -> try_divide(g.target, aggregate(g.own, 0D, (a, p) -> a + w{i}[p])))"
        scaled = f"transform(w{i}, (x, k) -> x * coalesce(f{i}[at_{i}[k]], 0D))"
        fit = f"transform(array({fit}), w{i} -> transform(array({factors}), f{i} -> {scaled})[0])[0]"
    move = f"if(greatest(x, y) > {NOTHING!r}D, coalesce(abs(try_divide(x, y) - 1D), 0D), 0D)"
    after = f"named_struct('w', v, 'moved', array_max(zip_with(v, acc.w, (x, y) -> {move})))"
    row = stored(
        row.selectExpr(
            "cells",
            f"""aggregate(sequence(1, {rounds}), named_struct('w', begun, 'moved', double('inf')), (acc, n) ->
                if(acc.moved <= {tolerance!r}D, acc, transform(array({fit}), v -> {after})[0])) AS fit""",
        )
    )
    columns = ", ".join(f"c.`{c}`" for c in begun.columns if c != "weight")
    fitted = row.selectExpr(f"inline(zip_with(cells, fit.w, (c, w) -> struct({columns}, w AS weight)))")
    return stored(fitted.select(*begun.columns)), row.select("fit.moved").first()[0]


def probabilities(fitted: DataFrame, fraction: float) -> DataFrame:
    """Cells with `prob`, such that about `fraction` of all tokens are taken and the cells' expected tokens are as
    their weights. A document is never taken twice: cells that would need more than they have give all, and the
    others make up for it."""
    total = fitted.agg(F.sum("tokens")).first()[0] or 0  # one number
    ratio = F.col("weight") / F.col("tokens")
    scale = 0.0
    while True:
        full = ratio * F.lit(scale) >= 1
        given, rest = fitted.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()  # two numbers
        if not rest:
            break
        wider = max(0.0, fraction * total - given) / rest
        if wider <= scale * (1 + 1e-12):
            break
        scale = wider
    return fitted.withColumn("prob", F.least(F.lit(1.0), ratio * F.lit(scale)))


def draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a document's `_key`: the first 32 bits of an MD5 digest."""
    text = F.concat(F.lit(f"{seed}:"), key)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mixed(
    docs: DataFrame,
    fraction: float,
    doc_id: str = "doc_id",
    targets: dict[str, DataFrame] | None = None,
    temper: float = TEMPER,
    seed: int = 0,
    **columns: str,
) -> DataFrame:
    """`docs` with a struct column `mix`: source, lang, topic, tokens, weight, prob and sampled.

    Texts are read once for the cells and once for the rows. Without `targets` each margin's token shares are tempered. Null sources and languages are a class of their own;
    null texts have the topic `empty` and one token. Rows that share an id share a draw; rows without an id draw by
    source, language and text, so only those equal in all three share one. Other columns pass through, but for columns
    called mix, _cell, _tokens, _key or _fit.
    """
    rest = [c for c in docs.columns if c != "mix"]
    return drawn(keyed(docs, doc_id=doc_id, **columns), fraction, targets, temper, seed).select(*rest, "mix")


def drawn(
    marked: DataFrame,
    fraction: float,
    targets: dict[str, DataFrame] | None = None,
    temper: float = TEMPER,
    seed: int = 0,
) -> DataFrame:
    """`mixed` for a frame that `keyed` has marked, which may have lost its texts since."""
    cells = stored(cells_of(marked))
    targets = targets or {m: tempered(cells, m, temper) for m in MARGINS}
    fitted = stored(probabilities(raked(cells, targets), fraction)).select(
        F.struct(*MARGINS).alias("_cell"), F.struct("weight", "prob").alias("_fit")
    )
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)  # of checked size; else the join shuffles, and adaptive execution splits hot cells
    joined = marked.join(fitted, "_cell", "left")
    mix = F.struct(
        "_cell.*",
        F.col("_tokens").alias("tokens"),
        "_fit.*",
        (draw(F.col("_key"), seed) < F.col("_fit.prob")).alias("sampled"),
    )
    return joined.withColumn("mix", mix).drop("_cell", "_tokens", "_key", "_fit")
