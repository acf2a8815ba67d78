"""Document quality by a convolutional network over bytes, trained and applied in numpy.

Each byte has a learned vector. Filters look at WINDOW bytes, a window every STEP bytes. Their positive outputs are
max-pooled over chunks of 2 * HALF bytes that overlap by half and cover the whole document; the bytes after its end are
zeros. A small layer judges each chunk from its pooled filters, and the mean of the chunks' judgements is the document's
log odds. Training sees SAMPLE documents of each label and at most SAMPLE_CHUNKS chunks of one, spread evenly over it;
scoring sees every chunk of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecost.llm.packed_terms import text_slices

WINDOW, STEP, HALF = 16, 4, 128
DIMS, FILTERS, HIDDEN = 8, 32, 16
SAMPLE, SAMPLE_CHUNKS = 800, 12
EPOCHS, BATCH, RATE = 20, 64, 0.005
STEPS_OF_WINDOW = WINDOW // STEP
CHUNK_STEPS = 2 * HALF // STEP
CHUNK_BYTES = 2 * HALF + WINDOW - STEP  # with what the last windows see beyond the chunk
SLICE_BYTES = 1_000_000
EVEN_ODDS = 0.5


@dataclass
class Network:
    """Weights, or only a constant score where there was nothing to learn from."""

    weights: dict[str, np.ndarray] | None
    constant: float = EVEN_ODDS


def _start(seed: int) -> dict[str, np.ndarray]:
    pick = np.random.default_rng(seed)

    def normal(*shape: int, fan: int) -> np.ndarray:
        return (pick.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)

    return {
        "bytes": normal(256, DIMS, fan=2),
        "filters": normal(STEPS_OF_WINDOW, STEP * DIMS, FILTERS, fan=WINDOW * DIMS),
        "bias": np.zeros(FILTERS, np.float32),
        "layer": normal(FILTERS, HIDDEN, fan=FILTERS),
        "layer_bias": np.zeros(HIDDEN, np.float32),
        "last": normal(HIDDEN, 1, fan=HIDDEN),
        "last_bias": np.zeros(1, np.float32),
    }


def _judged(weights: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of chunks from their pooled filters, and the hidden values."""
    hidden = np.maximum(pooled @ weights["layer"] + weights["layer_bias"], 0)
    return (hidden @ weights["last"] + weights["last_bias"])[:, 0], hidden


def _gradients(weights: dict[str, np.ndarray], chunks: np.ndarray, document: np.ndarray, labels: np.ndarray, counts: np.ndarray):
    """Gradients of the mean cross entropy of a batch: chunks (n, CHUNK_BYTES) belong to documents 0 to len(labels) - 1,
    and document i counts counts[i] times."""
    n, of = len(chunks), np.bincount(document, minlength=len(labels))
    steps = weights["bytes"][chunks].reshape(n, -1, STEP * DIMS)
    value = sum(steps[:, k : k + CHUNK_STEPS] @ weights["filters"][k] for k in range(STEPS_OF_WINDOW))
    place = value.argmax(axis=1)
    top = np.take_along_axis(value, place[:, None], axis=1)[:, 0] + weights["bias"]
    pooled = np.maximum(top, 0)
    odds, hidden = _judged(weights, pooled)
    score = 1 / (1 + np.exp(-np.bincount(document, odds, minlength=len(labels)) / of))
    by_chunk = ((counts * (score - labels) / len(labels) / of)[document]).astype(np.float32)[:, None]
    out = {"last": hidden.T @ by_chunk, "last_bias": by_chunk.sum(axis=0)}
    by_hidden = (by_chunk @ weights["last"].T) * (hidden > 0)
    out |= {"layer": pooled.T @ by_hidden, "layer_bias": by_hidden.sum(axis=0)}
    by_filter = (by_hidden @ weights["layer"].T) * (top > 0)
    out["bias"] = by_filter.sum(axis=0)
    # a filter learns from the window where it was largest
    rows = np.arange(n)[:, None]
    out["filters"] = np.empty_like(weights["filters"])
    by_byte = np.zeros((256, DIMS), np.float32)
    for k in range(STEPS_OF_WINDOW):
        seen = steps[rows, place + k]  # chunk, filter, step's values
        out["filters"][k] = np.einsum("cf,cfd->df", by_filter, seen)
        back = (by_filter[:, :, None] * weights["filters"][k].T[None]).reshape(n, FILTERS, STEP, DIMS)
        which = chunks[rows[:, :, None], (place + k)[:, :, None] * STEP + np.arange(STEP)].ravel()
        for d in range(DIMS):
            by_byte[:, d] += np.bincount(which, back[..., d].ravel(), minlength=256).astype(np.float32)
    out["bytes"] = by_byte
    return out


def trained(documents: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Network:
    """A network for documents given as (chunks, CHUNK_BYTES) arrays of bytes, by Adam with a falling rate.

    Both labels weigh the same in all, however many documents have them.
    """
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Network(None, float(labels[0]) if len(labels) else EVEN_ODDS)
    counts = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    weights, pick = _start(seed), np.random.default_rng(seed + 1)
    mean = {k: np.zeros_like(w) for k, w in weights.items()}
    square = {k: np.zeros_like(w) for k, w in weights.items()}
    step, total = 0, EPOCHS * -(-len(labels) // BATCH)
    for _ in range(EPOCHS):
        order = pick.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            own = order[begin : begin + BATCH]
            document = np.repeat(np.arange(len(own)), [len(documents[i]) for i in own])
            chunks = np.concatenate([documents[i] for i in own])
            gradients = _gradients(weights, chunks, document, labels[own], counts[own])
            step += 1
            rate = RATE * (1 - (step - 1) / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in gradients.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                weights[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return Network(weights)


def _n_halves(n_bytes: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-n_bytes // HALF))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and the bytes of up to SAMPLE_CHUNKS chunks of each text."""
    for batch in batches:
        labels = batch.column(0)
        for first, data, bounds in text_slices(batch.column(1), SLICE_BYTES):
            out = []
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                chunks = max(1, int(_n_halves(np.int64(end - begin))) - 1)
                chosen = np.unique(np.linspace(0, chunks - 1, min(chunks, SAMPLE_CHUNKS)).astype(np.int64))
                rows = np.zeros((len(chosen), CHUNK_BYTES), np.uint8)
                for row, c in zip(rows, chosen.tolist(), strict=True):
                    own = data[begin + c * HALF : min(end, begin + c * HALF + CHUNK_BYTES)]
                    row[: len(own)] = own
                out.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([labels.slice(first, len(out)), pa.array(out, pa.binary())], names=["label", "chunks"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network for the rows of `docs` (id, text) that `labels` (id, label of 0 or 1) mark.

    It learns from `sample` ids of each label, those of the smallest hashes; an id of both labels is left out, and of an
    id's several texts the least counts. Only ids meet the labels; texts are read of the chosen ids alone. At most
    2 * sample * SAMPLE_CHUNKS * CHUNK_BYTES bytes reach the driver, where the fitting runs. With one label only, or
    none, every score is that label, or EVEN_ODDS.
    """
    known = docs.select("id").distinct().join(labels.where("label IN (0, 1)"), "id").groupBy("id")
    ids = known.agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    order = F.xxhash64("id"), F.col("id")
    chosen = [ids.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select("id", F.col("label").cast("int").alias("label"))
    # at most 2 * sample rows of two numbers
    texts = docs.select("id", "text").join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("id", "label", "text").repartition("id").select("label", "text")
    rows = rows.mapInArrow(_sampled, "label int, chunks binary").collect()
    rows = sorted((r["label"], bytes(r["chunks"])) for r in rows)
    documents = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK_BYTES) for _, c in rows]
    return trained(documents, np.array([k for k, _ in rows]))


def _halves(weights: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """Max-pooled filters of each half; `data` is whole halves and the bytes that the last windows see."""
    halves = (len(data) - (WINDOW - STEP)) // HALF
    out = np.empty((halves, FILTERS), np.float32)
    at_once = SLICE_BYTES // HALF
    for first in range(0, halves, at_once):
        last = min(halves, first + at_once)
        own = data[first * HALF : last * HALF + WINDOW - STEP]
        steps = weights["bytes"][own].reshape(-1, STEP * DIMS)
        n = (last - first) * HALF // STEP
        value = steps[:n] @ weights["filters"][0]
        for k in range(1, STEPS_OF_WINDOW):
            value += steps[k : k + n] @ weights["filters"][k]
        out[first:last] = value.reshape(last - first, HALF // STEP, FILTERS).max(axis=1)
    return np.maximum(out + weights["bias"], 0, out=out)


def scores(network: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores of documents whose bytes are data[bounds[i]:bounds[i + 1]]."""
    n = len(bounds) - 1
    if network.weights is None:
        return np.full(n, network.constant)
    size = np.diff(bounds)
    halves = _n_halves(size)
    # each document is followed by a half of zeros, so that its last windows do not see the next document
    begin = np.cumsum(halves + 1) - (halves + 1)
    laid = np.zeros(int((halves + 1).sum()) * HALF + WINDOW - STEP, np.uint8)
    laid[np.repeat(begin * HALF - bounds[:-1], size) + np.arange(int(bounds[-1]))] = data[: int(bounds[-1])]
    pooled = _halves(network.weights, laid)
    pooled[begin + halves] = _halves(network.weights, np.zeros(HALF + WINDOW - STEP, np.uint8))
    # a chunk is a half and the next one; a document of one half has one chunk, with the zeros after it
    chunks = np.maximum(1, halves - 1)
    document = np.repeat(np.arange(n), chunks)
    first = np.repeat(begin - (np.cumsum(chunks) - chunks), chunks) + np.arange(int(chunks.sum()))
    both = np.maximum(pooled[first], pooled[first + 1])
    odds, _ = _judged(network.weights, both)
    mean = np.bincount(document, odds, minlength=n) / chunks
    return 1 / (1 + np.exp(-mean))


def scored(docs: DataFrame, network: Network, keep: tuple[str | Column, ...] = (), text: str = "text") -> DataFrame:
    """The columns `keep` and `score` (0 to 1) of every row, from the whole text.

    A null text is empty, and an empty text is one chunk of zeros. Equal texts score alike. Zero bytes of a text are
    taken as the padding is. Scores are rounded to 6 digits, as sums of floats depend on their grouping.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(network, data, bounds) for _, data, bounds in text_slices(batch.column(0), SLICE_BYTES)]
            score = pa.array(np.round(np.concatenate([*parts, np.empty(0)]), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], names=[*batch.schema.names[1:], "score"])

    own = docs.select(F.col(text), *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]]
    return own.mapInArrow(judged, ", ".join([*fields, "score double"]))
