"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Each text is searched by three fixed patterns and one for long mixed tokens. The hash of every candidate value
is aggregated over the corpus by the distinct owners and repositories that hold it. A value that many owners
hold is a copied example; a value that stays with few owners looks live. Mixed tokens are reported, as kind
`owned`, only when they look live and lie outside the other spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.scratch import stored

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
# Runs that are long enough to be a key and hold a digit, a capital and a small letter.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[a-zA-Z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
EXAMPLE_OWNERS = 3

SPAN = "array<struct<start:bigint,rank:int,end:bigint,hash:string>>"


def _listed(text: Column, pattern: str, quick: str, rank: int, group: int, shortest: int) -> Column:
    """The matches of one kind as an array of SPAN entries.

    Splitting by the pattern gives the stretches between matches; with the matches' own lengths they give the
    offsets. `quick` finds out whether the text holds a match that passes, so most texts are read once.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.sha2(x["value"], 256).alias("hash")
        )
        good = F.coalesce(F.length(x["value"]) >= shortest, F.lit(False))
        return F.struct(
            end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans")
        )

    return F.when(
        text.rlike(quick), F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    ).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """One row per document: _id, _text_hash, _owner, _repo, base (spans of the three kinds) and mixed (spans)."""
    body = F.coalesce(F.col(text), F.lit(""))
    long_hex, long_access = rf"[0-9a-f]{{{SHORTEST['hex']}}}", rf"AKIA[A-Z0-9]{{{SHORTEST['access'] - 4}}}"
    picked = docs.select(
        F.col(doc_id).alias("_id"),
        F.xxhash64(body).alias("_text_hash"),
        owner.cast("string").alias("_owner"),
        repo.cast("string").alias("_repo"),
        F.concat(
            _listed(body, ASSIGN, ASSIGN, 0, 2, SHORTEST["assign"]),
            _listed(body, ACCESS, long_access, 1, 0, SHORTEST["access"]),
            _listed(body, HEX, long_hex, 2, 0, SHORTEST["hex"]),
        ).alias("base"),
        _listed(body, MIXED, MIXED, 3, 0, 0).alias("mixed"),
    )
    outside = F.filter(
        "mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    return picked.withColumn("base", F.sort_array("base")).withColumn("mixed", outside)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_docs of every candidate value of the corpus.

    Counted in two steps, by (hash, owner, repository) and then by hash, so that each step sums up before it
    shuffles and a value that a third of the corpus holds is a few rows per task.
    """
    each = found.select(
        F.explode(F.array_distinct(F.transform(F.concat("base", "mixed"), lambda s: s["hash"]))).alias("hash"),
        "_owner",
        "_repo",
    )
    pairs = each.groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_docs")
    )


def scanned(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: _id, _text_hash and `secrets`, an array of its spans.

    A span has start, rank (of its kind), end (code points, end exclusive), hash (sha256 of the value), n_owners,
    n_repos and live (fewer than `example_owners` owners hold the value). Spans are sorted by start, then kind.

    Null texts count as empty and have no spans. Null owners are one owner. Repeated rows each give a row. Other
    columns, whatever their names, take no part.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    found = stored(candidates(docs, doc_id, text, owner, repo))
    verdicts = ownership(found)
    some = found.where(F.size("base") + F.size("mixed") > 0)
    spans = some.select("_id", "_text_hash", F.explode(F.concat("base", "mixed")).alias("s")).distinct()
    looked_up = spans.join(verdicts, spans["s.hash"] == verdicts["hash"])
    live = F.col("n_owners") < example_owners
    listed = (
        looked_up.where((F.col("s.rank") < KINDS.index("owned")) | live)
        .groupBy("_id", "_text_hash")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("s.start", "s.rank", "s.end", "s.hash", "n_owners", "n_repos", live.alias("live"))
                )
            ).alias("secrets")
        )
    )
    left, right = found.select("_id", "_text_hash").alias("l"), listed.alias("r")
    same = F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._text_hash") == F.col("r._text_hash"))
    empty = F.array().cast(listed.schema["secrets"].dataType)
    return left.join(right, same, "left").select(
        "l._id", "l._text_hash", F.coalesce("r.secrets", empty).alias("secrets")
    )


def listing(secrets: Column, ranks: int = len(KINDS)) -> Column:
    """kind:start:end of each span, joined by commas; of the first `ranks` kinds."""
    named = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(secrets, lambda s: s["rank"] < ranks)
    return F.array_join(
        F.transform(
            kept,
            lambda s: F.concat_ws(":", F.get(named, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with every secret in `text` replaced by a mark: <secret> if its value looks live, else <example>.

    Overlapping spans become one stretch, marked as live if one of them is. Texts without secrets, null texts
    and all other columns stay as they are.
    """
    spans = scanned(docs, doc_id, text, **options).where(F.size("secrets") > 0).distinct().alias("s")
    start = F.array().cast("array<struct<start:bigint,end:bigint,live:boolean>>")

    def merged(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            (last["live"] | s["live"]).alias("live"),
        )
        new = F.struct(s["start"], s["end"], s["live"])
        joined = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(
            joined, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))
        ).otherwise(F.concat(acc, F.array(new)))

    body = F.col(f"d.{text}")
    cuts = F.aggregate("s.secrets", start, merged)

    def marked(c: Column, i: Column, all_cuts: Column) -> Column:
        before = F.when(i > 0, F.get(all_cuts, i - 1)["end"]).otherwise(F.lit(0))
        gap = F.substr(body, (before + 1).cast("int"), (c["start"] - before).cast("int"))
        return F.concat(gap, F.when(c["live"], F.lit("<secret>")).otherwise(F.lit("<example>")))

    def text_of(all_cuts: Column) -> Column:
        tail = F.substr(body, (F.element_at(all_cuts, -1)["end"] + 1).cast("int"))
        return F.concat(F.array_join(F.transform(all_cuts, lambda c, i: marked(c, i, all_cuts)), ""), tail)

    # transform over a one-element array names the merged list, so it is made once
    clean = F.when(F.col("s.secrets").isNull(), body).otherwise(
        F.get(F.transform(F.array(cuts), text_of), F.lit(0))
    )
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("s._id")) & (
        F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("s._text_hash")
    )
    out = [clean.alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(spans, same, "left").select(*out)
