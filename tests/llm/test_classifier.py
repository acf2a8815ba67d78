"""The byte network: gradients, whole documents, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecost.llm import byte_convolution as net
from lanecost.llm.catalog import queries

SF = "/root/testdata/sf0.01"


def cross_entropy(weights, chunks, document, labels, counts):
    """The loss from plain loops over windows."""
    odds = [[] for _ in labels]
    for chunk, d in zip(chunks, document):
        pooled = plain_pool(weights, chunk)
        hidden = np.maximum(pooled @ weights["layer"] + weights["layer_bias"], 0)
        odds[d].append(float((hidden @ weights["last"] + weights["last_bias"])[0]))
    score = 1 / (1 + np.exp(-np.array([np.mean(o) for o in odds])))
    return -np.mean(counts * np.where(np.array(labels) == 1, np.log(score), np.log(1 - score)))


def plain_pool(weights, chunk):
    filters = weights["filters"].reshape(-1, net.FILTERS)
    windows = [weights["bytes"][chunk[i : i + net.WINDOW]].ravel() for i in range(0, 2 * net.HALF, net.STEP)]
    return np.maximum(np.array(windows) @ filters + weights["bias"], 0).max(axis=0)


def test_gradients_match_differences():
    pick = np.random.default_rng(5)
    weights = {k: w.astype(np.float64) for k, w in net._start(1).items()}
    chunks = pick.integers(0, 256, (5, net.CHUNK_BYTES)).astype(np.uint8)
    document, labels = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1])
    counts = np.array([0.5, 2.0, 1.0])
    gradients = net._gradients(weights, chunks, document, labels, counts)
    for name, gradient in gradients.items():
        gradient = np.asarray(gradient)
        for at in np.argsort(np.abs(gradient).ravel())[-3:]:
            at = np.unravel_index(at, gradient.shape)
            ends = []
            for move in (1e-5, -1e-5):
                moved = {k: w.copy() for k, w in weights.items()}
                moved[name][at] += move
                ends.append(cross_entropy(moved, chunks, document, labels, counts))
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(gradient[at], rel=2e-2, abs=1e-6), name


def plain_score(weights, text):
    """Every chunk of a text, one after the other."""
    data = np.frombuffer(text, np.uint8)
    padded = np.concatenate([data, np.zeros(net.CHUNK_BYTES, np.uint8)])
    odds = []
    for c in range(max(1, -(-len(data) // net.HALF) - 1)):
        chunk = np.zeros(net.CHUNK_BYTES, np.uint8)
        own = padded[c * net.HALF : c * net.HALF + net.CHUNK_BYTES]
        chunk[: len(own)] = own
        hidden = np.maximum(plain_pool(weights, chunk) @ weights["layer"] + weights["layer_bias"], 0)
        odds.append(float((hidden @ weights["last"] + weights["last_bias"])[0]))
    return 1 / (1 + np.exp(-np.mean(odds)))


def test_scores_cover_whole_documents(monkeypatch):
    pick = np.random.default_rng(6)
    sizes = [0, 1, 115, 116, 117, 127, 128, 129, 256, 1000, 5000, 12_345]
    texts = [pick.integers(1, 256, n).astype(np.uint8).tobytes() for n in sizes]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    network = net.Network(net._start(3))
    want = [plain_score(network.weights, t) for t in texts]
    assert net.scores(network, data, bounds) == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(net, "SLICE_BYTES", 1024)  # very long texts are pooled in several parts
    assert net.scores(network, data, bounds) == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy(spark):
    got = queries()["op13_quality_classifier"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0
    assert got.where(F.expr("held_out <> (crc32(string(doc_id)) % 4 = 2)")).count() == 0
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


def test_awkward_rows(spark):
    shout = "BUY!! NOW!! " * 40
    rows = [(k, k % 2, ("plain words of a quiet text. " if k % 2 else shout) * 3) for k in range(60)]
    rows += [(1, 0, "a label that contradicts"), (None, 1, "x"), (70, None, "y"), (71, 1, None), (72, 1, "")]
    frame = spark.createDataFrame(rows, "id long, label int, text string").withColumn("score", F.lit(9))
    labels = frame.select("id", "label")
    network = net.fitted(frame, labels)
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, shout * 3000, 3.0), (2, shout * 3000, 3.0), (3, "word", None)], "doc_id long, text string, chunks double")
    got = [tuple(r) for r in net.scored(docs, network, keep=("doc_id", "chunks")).collect()]
    assert len(got) == 5 and all(0 <= r[-1] <= 1 for r in got)
    assert [r[-1] for r in got if r[0] is None] == [r[-1] for r in got if r[0] == 1]
    assert len({r[-1] for r in got if r[0] == 2}) == 1
    assert net.scored(docs.limit(0), network).count() == 0
    assert net.fitted(frame.limit(0), labels).constant == net.EVEN_ODDS
    assert net.fitted(frame.where("label = 1"), labels.where("label = 1")).constant == 1
    assert {r["score"] for r in net.scored(docs, net.Network(None, 1.0)).collect()} == {1.0}
