"""Mixing, top-k, components, the queries with SQL, and the pipeline."""

import os
import random

import numpy as np
import pytest
from compare import difference, duck, duck_table, spark_table
from pyspark.sql import functions as F

import corpus_pipeline
from lanecost.llm import mixing, near_dedup, secrets, topk
from lanecost.llm.catalog import queries
from lanecost.llm.components import components
from lanecost.llm.oracle import _mixing, statements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(statements()))
def test_query_matches_its_statement(spark, con, name):
    assert difference(spark_table(queries()[name](spark, SF)), duck_table(con, statements()[name])) is None


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randint(0, 400), pick.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(700, 701 + i) for i in range(100)] + [(5, 5)]
    low = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got | {n: r for n, r in low.items() if n == r} == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    pick = random.Random(11)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 1.0, pick.uniform(-1, 1)]) for _ in range(4)], "own") for i in range(300)]
    rows += [(300, None, "own"), (301, [], "own"), (350, [1.0, float("nan"), 0.0, 0.0], "own"), (None, [1.0] * 4, "own")]
    rows += [(400, [1.0, None, 0.0, 0.0], "own"), (401, [float("inf")] * 4, "own"), (450, [1.0, 2.0], "own"), rows[50], rows[7]]
    # ids with several vectors, among the candidates and among the queries
    rows += [(9, [0.9, 0.9, 0.9, 0.9], "own"), (100, [-1.0, 1.0, 0.5, 0.0], "own"), (100, [1.0, 1.0, 1.0, 1.0], "own")]
    return rows + [rows[11]] * 8


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    monkeypatch.setattr(topk, "SHARD_TILE", 40)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, score string").repartition(7)
    good = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v, _ in vectors() if k is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q in {k for k, _ in good if k % 50 == 0}:
        pairs = [(v, c, w) for k, v in good for c, w in good if k == q and c != q and len(w) == len(v)]
        scored = sorted((-int(v @ w), c) for v, c, w in pairs)[:5]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def shuffled(node):
    """Bytes of the rows that a finished plan's exchanges dealt out."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(node.plan())
    own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_top_k_deals_out_no_tile_for_each_pair_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_TILE", 10)
    monkeypatch.setattr(topk, "SHARD_TILE", 50)
    # 500 tiles of candidates and 50 of queries: 25,000 pairs, 5 KB of a query tile in each
    component = F.pmod(F.xxhash64("vec_id", "i"), F.lit(1000)) / 1000.0
    rows = spark.range(25_000, numPartitions=4).withColumnRenamed("id", "vec_id")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(64)))).withColumn("x", component)
    rows = rows.groupBy("vec_id").agg(F.array_sort(F.collect_list("x")).alias("embedding"))
    got = topk.top_k(rows, F.col("vec_id") % 50 == 0)
    assert len(got.collect()) == 2500
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 4 * 25_000 * 64 * 4


def test_top_k_lists_over_blocks_and_ties():
    pick = np.random.default_rng(5)
    for high in (2, 2**14, 2**29):  # single and double floats, 64-bit integers
        queries, tiles = pick.integers(-high, high, (9, 5)), pick.integers(-high, high, (3, topk.BLOCK * 2 + 70, 5))
        # one vector is most of the last tile, and a query's own id comes many times
        tiles[2, 300:] = queries[4]
        ids = pick.permutation(tiles.shape[0] * tiles.shape[1]).reshape(tiles.shape[:2])
        ids[1, :400] = 7
        own = np.array([7, *range(10, 18)])
        top, room = topk._Tops(0, own, queries, 5), {}
        for numbers, tile in zip(ids, tiles, strict=True):
            top.meet(numbers, tile, topk._length(tile), room)
        got = top.lists(0).to_pydict()
        for q, v in enumerate(queries):
            scored = [(-sum(map(int.__mul__, v.tolist(), w)), i) for i, w in zip(ids.ravel().tolist(), tiles.reshape(-1, 5).tolist(), strict=True)]
            want = sorted(x for x in scored if x[1] != own[q])[:5]
            assert [(-t["score"], t["vec_id"]) for t in got["top"][q]] == want


def test_top_k_grid():
    # 6 GB of 64 floats, a row of 50 asks: no cell holds more than its part, and less than the input is dealt out twice
    rows = 14_800_000
    of = lambda n, tile: {"rows": n, "tiles": n // tile, "bytes": n * 128, "values": n * 64}
    queries, shards = of(rows // 50, topk.QUERY_TILE), of(rows, topk.SHARD_TILE)
    asking, groups = topk._grid(queries, shards, 5, 6)
    assert queries["bytes"] / asking <= topk.QUERY_BYTES and shards["bytes"] / groups <= topk.SHARD_BYTES
    assert asking * shards["bytes"] + groups * (queries["bytes"] + 80 * queries["rows"]) < 2 * 6e9
    # small tables are one cell, and none has more groups than tiles
    assert topk._grid(of(10, 1), of(500, 100), 5, 6) == (1, 1)
    assert topk._grid(of(0, 1), of(0, 1), 5, 6) == (1, 1)
    asking, groups = topk._grid(of(10**6, 10**6), of(10**8, 5 * 10**7), 5, 6)
    assert (asking, groups) == (1, 2)


def test_products_beyond_doubles():
    big = np.array([[2**31, 1]], np.int64)
    assert topk._products(big, big)[0, 0] == 2**62 + 1


def test_raked_margins_meet_their_targets(spark):
    pick = random.Random(2)
    cells = [(f"s{s}", lang, topic, pick.randint(1, 1000)) for s in range(5) for lang in "ab" for topic in "xyz"]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    shares = {"source": {f"s{i}": 0.2 for i in range(5)}, "lang": {"a": 0.7, "b": 0.3}, "topic": {"x": 0.5, "y": 0.25, "z": 0.25}}
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in shares.items()}
    fitted = mixing.raked(frame, targets, rounds=40)
    for margin, want in shares.items():
        got = {r[0]: r[1] for r in fitted.groupBy(margin).agg(F.sum("weight")).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    probs = mixing.probabilities(fitted, 0.3).collect()
    assert sum(r["tokens"] * r["prob"] for r in probs) == pytest.approx(0.3 * sum(r["tokens"] for r in probs))
    assert all(0 <= r["prob"] <= 1 for r in probs)


def test_probabilities_of_many_halving_weights(spark):
    """Cells that give all they have are found one after the other, in more than a hundred passes."""
    rows = [(i, 1000, 0.5 ** min(i + 1, 1000)) for i in range(2000)]
    probs = mixing.probabilities(spark.createDataFrame(rows, "source int, tokens long, weight double").coalesce(1), 0.05).collect()
    assert sum(r["tokens"] * r["prob"] for r in probs) == pytest.approx(0.05 * 2_000_000, rel=1e-6)


def test_a_document_without_an_id_is_kept(spark, tmp_path):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op5_minhash_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == [("1", True), ("2", False), ("None", True)]


def test_raking_runs_until_nothing_moves(spark, con, monkeypatch):
    """Sparse cells need more rounds; the statement is given enough of them."""
    cells = mixing.cells_of(mixing.keyed(spark.read.parquet(f"{SF}/documents.parquet")))
    targets = {m: mixing.tempered(cells, m) for m in mixing.MARGINS}
    fitted = mixing.raked(cells, targets)
    for margin, target in targets.items():
        got = {r[0]: r[1] for r in fitted.groupBy(margin).agg(F.sum("weight")).collect()}
        assert got == pytest.approx({r[0]: r[1] for r in target.collect()}, abs=1e-10)
    want = duck_table(con, _mixing(rounds=40))
    assert difference(spark_table(queries()["op4_mixing"](spark, SF)), want) is None
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.raked(cells, targets, rounds=10)
    full = [(s, lang, "x", n) for s, lang, n in (("a", "e", 10), ("a", "f", 2), ("b", "e", 3), ("b", "f", 40))]
    full = spark.createDataFrame(full, "source string, lang string, topic string, tokens long")
    targets = {m: mixing.tempered(full, m) for m in mixing.MARGINS}
    one = {r[:3]: r["weight"] for r in mixing.raked(full, targets).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert {r[:3]: r["weight"] for r in mixing.raked(full, targets).collect()} == pytest.approx(one, abs=1e-12)


def test_contradicting_targets_are_reported(spark):
    cells = spark.createDataFrame([("a", "e", 3), ("b", "f", 1)], "source string, lang string, tokens long")
    shares = {"source": {"a": 0.5, "b": 0.5}, "lang": {"e": 0.9, "f": 0.1}}
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in shares.items()}
    with pytest.warns(UserWarning, match="shares of source"):
        fitted = mixing.raked(cells, targets)
    assert {r["lang"]: r["weight"] for r in fitted.collect()} == pytest.approx(shares["lang"])


def test_mixing_awkward_rows(spark):
    rows = [(1, None, None, None, "own"), (1, None, None, None, "own"), (None, "a b", "en", "s", "own"), (2, "", "en", None, "own"), (3, "w " * 9000, None, "s", "own")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")
    mix = mixing.mixed(frame, 1.0)
    assert mix.columns == [*frame.columns, "mix"]
    assert mix.where("mix.sampled").count() == 5  # the whole budget takes all
    assert mixing.mixed(frame.limit(0), 0.5).count() == 0


def test_rows_without_an_id_draw_by_their_text(spark):
    rows = [(None, f"text {i}", "en", "s") for i in range(400)] + [(None, "text 7", "en", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    drawn = mixing.mixed(frame, 0.5).select("text", "mix.sampled").collect()
    assert 150 < sum(r["sampled"] for r in drawn) < 250
    assert len({r["sampled"] for r in drawn if r["text"] == "text 7"}) == 1
    known = mixing.keyed(frame.withColumn("doc_id", F.lit(5)))
    assert known.select("_key").distinct().collect() == [("5",)]


def test_pipeline(spark):
    """Stages against the operators' own rules on plain Python."""
    import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    for r in docs.join(kept, "doc_id", "left_anti").collect():
        n, chars, symbols, lines, repeats = brute.quality(r["text"])
        judged = n < 10 or 100 * repeats > 20 * n or symbols > 0.3 * n or lines > 0 or n >= 50
        assert judged, r["doc_id"]
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    classes = brute.near_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(k for k, _, c in classes if k == c)
    clean = {r["doc_id"]: r for r in corpus_pipeline.secret_scans(spark, docs, SF).collect()}
    for r in docs.collect():
        found = brute.spans(r["text"])
        out = clean[r["doc_id"]]
        assert brute.spans(out["text"])[:3] == (0, 0, 0)
        assert (out["text"] == r["text"]) or found[3]
        assert out["n_chars"] == len(out["text"])
    base = spark.conf.get("spark.checkpoint.dir")
    there = len(os.listdir(base))
    out = corpus_pipeline.run(spark, SF)
    assert len(os.listdir(base)) == there + 1  # the stages' tables, and nothing of what they stored on the way
    assert out.count() > 0 and out.where("not lossless").count() == 0
    assert out.join(one, "doc_id", "left_anti").count() == 0


def test_pipeline_awkward_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    good = "the quick brown fox and the lazy dog of this house were here for a while, token=abcdef12345"
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (None, good, None, None, None), (None, good, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, names)
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, data, SF).count() >= 0
    stayed = corpus_pipeline.near_duplicates(spark, docs.where("text <> ''"), SF)
    assert sorted(str(r["doc_id"]) for r in stayed.collect()) == ["1", "None", "None"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Names that a stage might use itself, on rows that every stage keeps or redacts."""
    names = ["_key", "_n", "_class", "_text", "_cell", "_tokens", "_fit", "mix", "row", "key", "place", "quality", "doc", "a"]
    text = "the quick brown fox and the lazy dog of this house were here for a while, token=abcdef12345 "
    rows = [(k, f"{text} {k} is {'ab' * k}", "en", f"s{k % 3}", 9) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n} of {r['doc_id']}" for r in got for n in names), name
    assert corpus_pipeline.segmentation(spark, docs, SF).count() == 12


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(1, one), (5, one), (5, two), (7, three), (7, four), (7, four), (None, one), (8, None), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    stayed = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    want = [(1, one), (5, two), (7, three), (7, four), (None, one), (8, None), (8, "")]
    assert sorted(map(str, map(tuple, stayed))) == sorted(map(str, want))


def test_a_missing_text_is_its_own_class(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A")]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)]
    assert secrets.EXAMPLE_OWNERS == 3
