"""Tokenizers, token files and languages: against the libraries, round trips and held-out documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanecost.llm import bpe, language_id, sentence_pieces, simple8b, token_counts, token_files
from lanecost.llm.catalog import op1_language_id, op3_token_counts
from lanecost.llm.scratch import folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "!", "<|endoftext|>", "<|endof", "é", "日本", "\x1c",
    " ", "1", "23", "　", "r", "l", "x", "²", "́", "😀", "▁", " word", " word,", "￿", "\x00",
]


def texts(n=300, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choices(PARTS, k=pick.randint(0, 14))) for _ in range(n)]


def test_ids_are_the_librarys():
    encoder, library = bpe.Encoder(VOCABULARY), bpe.library(VOCABULARY)
    for begin in range(0, 300, 50):
        run = texts()[begin : begin + 50]
        values, counts = encoder.encoded(run)
        for text, own in zip(run, np.split(values, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_starts_over(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 20)
    encoder, library = bpe.Encoder(VOCABULARY), bpe.library(VOCABULARY)
    for text in [" ".join(texts(6, seed)) for seed in range(20)]:
        assert encoder.encoded([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_prefix_count_is_the_librarys():
    counter, library = token_counts.PrefixCounts(VOCABULARY), bpe.library(VOCABULARY)
    for text, counts in zip(texts(150), counter.counted(texts(150)), strict=True):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert counts.tolist() == want, repr(text)
        assert token_counts.loaded_counts(token_counts.stored_counts(counts)).tolist() == want
        for budget in (0, 1, 3):
            assert token_counts.cut(counts, budget) == max([k + 1 for k, c in enumerate(want) if c <= budget], default=0)


def test_counts_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x" * 20_000), (4, "word " * 5_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("own"))
    got = token_counts.counted(frame, VOCABULARY, 512)
    library = bpe.library(VOCABULARY)
    want = sorted(str((k, len(library.encode(t or "", add_special_tokens=False).ids))) for k, t in rows)
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in got.collect()) == want
    assert token_counts.counted(frame.limit(0), VOCABULARY, 512).count() == 0


@pytest.mark.parametrize("high", [1, 3, 100, 60_000, 2**20 - 1, 2**32 - 1])
def test_packing_round_trip(high):
    pick = random.Random(high)
    for n in (0, 1, 2, 59, 1_000):
        values = np.array([pick.choice([0, 1, pick.randint(0, high)]) for _ in range(n)], np.uint64)
        assert (simple8b.unpacked(*simple8b.packed(values), n) == values).all()


def test_a_wide_value_among_small_ones_is_escaped():
    values = np.array([5, 6, 7, 2**31] * 100, np.uint64)
    words, escapes = simple8b.packed(values)
    assert len(escapes) > 0 and len(words) * 8 + len(escapes) * 4 < 200 * 8
    assert (simple8b.unpacked(words, escapes, 400) == values).all()


def test_token_files(spark):
    rows = [(k, t) for k, t in enumerate(texts(80))] + [(-1, None), (200, ""), (200, ""), (None, "first"), (300, "x " * 40_000)]
    pick = random.Random(1)
    pick.shuffle(rows)
    path = folder(spark)
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCABULARY, 0)
    got = sorted(map(tuple, token_files.read(spark, path).collect()), key=lambda r: r[1])
    library, start = bpe.library(VOCABULARY), 0
    for (doc_id, text), found in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (found[0], found[1], found[2]) == (doc_id, start, len(ids))
        assert zlib.crc32(found[3]) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_an_empty_table_gives_empty_files(spark):
    path = folder(spark)
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY, 0)
    assert token_files.read(spark, path).count() == 0


def test_segmentations_decode_to_their_text(spark):
    rows = [(k, t) for k, t in enumerate(texts(200))] + [(500, None), (501, ""), (502, "y" * 30_000), (502, "a b c"), (None, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit("own"))
    out = sentence_pieces.segmented(frame, PIECES, keep=("doc_id", "text"))
    found = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert all(r["lossless"] for r in found.values()) and len(found) == len(rows)
    assert found[500, None]["piece_ids"] is None and found[501, ""]["piece_ids"] == []
    back = sentence_pieces.decoded(out.withColumnRenamed("text", "want"), PIECES)
    assert back.where("not (text <=> want)").count() == 0
    again = {(r["doc_id"], r["text"]): r["piece_ids"] for r in sentence_pieces.segmented(frame.repartition(5), PIECES, keep=("doc_id", "text")).collect()}
    assert again == {k: r["piece_ids"] for k, r in found.items()}


def test_draws_follow_the_lattice():
    pieces = sentence_pieces.Pieces(PIECES, sharpness=0.3)
    names = {b.decode("utf-8", "replace"): i for i, b in enumerate(pieces.bytes) if np.isfinite(pieces.weights[i])}

    def paths(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in names:
                yield from ((names[text[:k]], *rest) for rest in paths(text[k:]))

    weight = {p: float(np.exp(sum(float(pieces.weights[i]) for i in p))) for p in paths(" tion")}
    total, n = sum(weight.values()), 40_000
    ids, sizes = sentence_pieces.encoded(pieces, ["tion"] * n, [str(i) for i in range(n)])
    drawn = [tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    for path, w in weight.items():
        share = w / total
        assert abs(drawn.count(path) / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4


def test_words_that_a_worker_drops_are_filtered_again(monkeypatch):
    whole = sentence_pieces.encoded(sentence_pieces.Pieces(PIECES), texts(), [str(i) for i in range(300)])[0]
    monkeypatch.setattr(sentence_pieces, "MOST_CHARS", 50)
    monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", 40)
    assert (sentence_pieces.encoded(sentence_pieces.Pieces(PIECES), texts(), [str(i) for i in range(300)])[0] == whole).all()


def test_held_out_languages(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_texts_without_letters_and_without_a_model(spark):
    labelled = [(i, lang, text) for i, (lang, text) in enumerate([("en", "the house and the dog"), ("de", "das haus und der hund")] * 5)]
    model = language_id.fitted(spark.createDataFrame(labelled, "id long, lang string, text string"))
    rows = [(1, None), (2, ""), (3, "12 ² ½ !?"), (4, "THE DOG"), (5, "日本"), (6, "hundhaus"), (6, "hundhaus")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(frame, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "de"}
    nothing = language_id.fitted(spark.createDataFrame([], "id long, lang string, text string"))
    assert {r["lang_pred"] for r in language_id.predicted(frame, nothing).collect()} == {"und"}


def test_escapes_pay_beside_values_of_16_bits():
    values = np.array(([40] * 9 + [50_000]) * 30, np.uint64)
    words, escapes = simple8b.packed(values)
    assert len(escapes) >= 30 and words.nbytes + escapes.nbytes < 480  # what they take without escapes
    assert (simple8b.unpacked(words, escapes, len(values)) == values).all()


def test_token_counts_are_stored_at_every_prefix(spark, monkeypatch):
    sf, path = "/root/testdata/sf0.001", folder(spark)
    monkeypatch.setattr("lanecost.llm.catalog.folder", lambda _: path)
    got = op3_token_counts(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text").alias("n"))
    table = spark.read.parquet(path).join(docs, "doc_id").collect()
    assert len(table) == docs.count()
    assert all(len(token_counts.loaded_counts(r["prefix_counts"])) == r["n"] for r in table)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    want = token_counts.counted(whole, VOCABULARY, 512, table=False).select("doc_id", "n_tokens", "cut_chars")
    assert sorted(got.select("doc_id", "n_tokens", "cut_chars").collect()) == sorted(want.collect())


MORE_PARTS = [
    *PARTS, "\r", "\x0b", "\x85", "\u00a0", "\u2003", "\u200b", "×", "ñ", "ñ.", " Ж", "҂", "ß", "\n\n", "—", "“q”", "\ufeff",
    "؟", "١", "_", "99%", "a'", "'T", "'til", "don't", "日本 語", " (x)", "text|>", "a" * 70, " " + "b" * 90 + ".", " " * 70,
]


def assert_librarys(encoder, run):
    library = bpe.library(VOCABULARY)
    values, counts = encoder.encoded(run)
    assert len(counts) == len(run)
    for text, own in zip(run, np.split(values, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bound", [None, "MOST_CHUNKS", "MOST_VALUES", "MOST_KEY_BYTES", "MOST_AT_ONCE", "BASE"])
def test_cuts_within_words_and_chunks_of_one_hash(monkeypatch, bound):
    if bound == "BASE":
        monkeypatch.setattr(bpe, bound, np.uint64(0))  # all short chunks get the same hash
    elif bound:
        monkeypatch.setattr(bpe, bound, 30)
    pick, encoder = random.Random(7), bpe.Encoder(VOCABULARY)
    for _ in range(12):
        assert_librarys(encoder, ["".join(pick.choices(MORE_PARTS, k=pick.randint(0, 14))) for _ in range(40)])
    assert_librarys(encoder, ["<|endof", "text|>", "", "a<|endoftext|>b", "\n", "De"])
    assert encoder.encoded([])[0].tolist() == encoder.encoded(["", ""])[0].tolist() == []


def test_the_library_gets_a_word_once_whatever_stands_beside_it():
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) for i in range(1, 60)]
    texts = [f"{a}{sign}{b}." for a, b in zip(words, words[1:], strict=False) for sign in (" ", ", ", "&&& ", ".\n", "/", "\n")]

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.chars = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.chars += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = bpe.Encoder(VOCABULARY)
    assert_librarys(encoder, texts)
    encoder = bpe.Encoder(VOCABULARY)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    for text in texts:
        encoder.encoded([text])
    # each word once after a space and once without, with what parts it from the next
    assert counting.chars < 3 * sum(map(len, words))


def test_texts_are_taken_from_sliced_columns():
    column = pa.array(["skipped", "é", None, "", "ab", "skipped"])
    for kind in (pa.string(), pa.large_string()):
        data, ends = token_files._texts(column.cast(kind)[1:5])
        assert data.tobytes() == "éab".encode() and ends.tolist() == [2, 2, 2, 4]
    data, ends = token_files._texts(pa.array([None, None], pa.string()))
    assert data.tobytes() == b"" and ends.tolist() == [0, 0]


def test_each_word_takes_the_selector_with_the_fewest_bytes_per_value():
    pick = random.Random(2)
    for high in (3, 40, 50_000, 2**21):
        values = [pick.choice([13, 198, pick.randint(0, high), pick.randint(0, high)]) for _ in range(400)]
        words, escapes = simple8b.packed(np.array(values))
        at = n_escapes = 0
        for word in words.tolist():
            costs = []
            for count, bits in simple8b.LAYOUT:
                over = sum(v >= (1 << bits) - 1 for v in values[at : at + count])
                costs.append((8 + simple8b.ESCAPE_BYTES * over) / count)
            own, bits = simple8b.LAYOUT[word >> 60]
            assert costs[word >> 60] == min(costs)
            n_escapes += sum(v >= (1 << bits) - 1 for v in values[at : at + own])
            at += own
        assert at >= len(values) and n_escapes == len(escapes)
