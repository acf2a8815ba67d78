"""Operators on documents against plain Python, on rows with every awkward case at once."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecost.llm import near_dedup, quality, secrets, substring_dedup
from lanecost.llm.catalog import op4_mixing, op7_secret_scans, op8_quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, mix string, k int"


def rows():
    pick = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)]
    passages = [" ".join(pick.choice(vocabulary) for _ in range(n)) for n in (4, 5, 19, 20, 21, 60)]
    out = []
    for i in range(120):
        parts = [
            pick.choice(passages) if pick.random() < 0.5 else " ".join(pick.choices(vocabulary, k=pick.randint(1, 30)))
            for _ in range(pick.randint(0, 4))
        ]
        out.append((i * 7 % 120, pick.choice([" ", "\n", "\t ", " \r\n"]).join(parts)))
    base = pick.choices(vocabulary, k=60)
    for i in range(40):  # near copies
        copy = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 3])):
            copy[pick.randrange(60)] = f"z{i}"
        out.append((1000 + i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    out += [out[3], out[3], (None, out[20][1]), (None, None), (2000, None), (2001, ""), (2002, " \n\t")]
    out += [(2003, "a " * 3000), (2004, "x" * 30000), (2005, "é " * 40 + "日本 " * 40), (-5, out[33][1])]
    out.append((2006, "the quick brown fox and the lazy dog of this house were here for a while"))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    extra = ("en", "s", 1, "own", "own", 1)
    return spark.createDataFrame([(*r, *extra) for r in rows()], SCHEMA)


def test_near_classes(frame):
    got = sorted(map(tuple, near_dedup.classes(frame).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute.near_classes(rows())


def edited_copies():
    """Copies with up to 8 edits of a text that is not there itself, of one that is, and documents that share lines."""
    pick = random.Random(11)
    out = []
    for group, (n, length, with_base) in enumerate([(110, 120, False), (90, 90, True), (60, 40, False)]):
        base = [f"g{group}w{pick.randrange(400)}" for _ in range(length)]
        out += [(group * 1000, " ".join(base))] if with_base else []
        for i in range(1, n):
            copy = list(base)
            for _ in range(pick.randint(0 if group == 1 else 1, 8)):
                # edits of the same few places meet again in other copies
                copy[pick.randrange(length)] = f"e{pick.choice([pick.randrange(3), 100 + i])}"
            out.append((group * 1000 + i, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(60):
        own = " ".join(f"o{pick.randrange(10 ** 6)}" for _ in range(pick.randint(3, 25)))
        out.append((5000 + i, f"{passage} {own}"))
    pick.shuffle(out)
    return out


def test_near_classes_of_heavily_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SALT_DOCS", 16)
    frame = spark.createDataFrame(edited_copies(), "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.classes(frame).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    want = brute.near_classes(edited_copies())
    assert 20 < len({c for _, _, c in want}) < 250
    assert got == want


def test_passages(frame):
    cut = substring_dedup.deduplicated(frame).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, cut.collect()), key=repr) == brute.cut_passages(rows())


def test_passages_of_other_lengths(frame):
    for window in (3, 8):
        cut = substring_dedup.deduplicated(frame, window=window).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted(map(tuple, cut.collect()), key=repr) == brute.cut_passages(rows(), window)


def test_buckets_of_documents_are_those_of_the_engine(spark):
    ids = [0, 1, -1, 7, 200, 2**31, -(2**31) - 5, 2**62 + 3, 2**63 - 1, substring_dedup.NO_ID]
    want = spark.createDataFrame([(i,) for i in ids], "k long").select(F.pmod(F.hash("k"), F.lit(51))).collect()
    assert substring_dedup._document_buckets(np.array(ids, np.int64), 51).tolist() == [r[0] for r in want]
    multiples = substring_dedup._document_buckets(np.arange(0, 51 * 20_000, 51), 51)
    assert np.bincount(multiples, minlength=51).max() < 2 * 20_000 / 51


def test_passages_in_small_buckets(frame, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4_000)
    cut = substring_dedup.deduplicated(frame).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, cut.collect()), key=repr) == brute.cut_passages(rows())


def test_every_difference_has_a_pair_in_its_cover():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_quality(frame):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judged(frame, out="verdict").select("doc_id", "text", *[f"verdict.{n}" for n in names])
    for doc_id, text, *found in judged.collect():
        assert tuple(found) == brute.quality(text), doc_id


def test_quality_keeps_columns_of_any_name(frame):
    passed = quality.passing(frame)
    assert passed.columns == frame.columns
    assert {r["quality"] for r in passed.collect()} == {"own"}


def secret_rows():
    key = "AKIA" + "A1" * 8
    texts = [
        "secret=token: abcdef", "secret=token=abcdefgh", "PassWord : 'hunter22' x", "api_key=\"abc-DEF.123\"", "apikey=abc",
        key, key + "x" + key, "AKIAAKIA" + "B2" * 9, "AKIA123", "a" * 23, "0" * 24, "é" * 5 + " token=" + "f" * 40,
        "password=secret=secret=12345678", "日本 passwd:x passwd:abcdefg", None, "", "x" * 5000 + " token=abcdef", "aB3" * 9,
    ]
    return [(i, t, "en", f"s{i % 4}", 0, "own", "own", 1) for i, t in enumerate(texts)]


def test_base_spans(spark):
    data = spark.createDataFrame(secret_rows(), SCHEMA)
    found = {r["_id"]: r["secrets"] for r in secrets.scanned(data).collect()}
    for doc_id, text, *_ in secret_rows():
        spans = [s for s in found[doc_id] if s["rank"] < 3]
        listed = ",".join(f"{secrets.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in spans)
        assert listed == brute.spans(text)[3], text


def test_widely_held_values_are_examples(spark):
    text = "token=abcdef123456"
    wide = [(i, text, "en", f"s{i}", 0, "", "", 1) for i in range(3)]
    rare = [(9, "a token=zyxwvu987654 b", "en", None, 0, "", "", 1), (10, "mixed Aa1" * 4, "en", "s", 0, "", "", 1)]
    data = spark.createDataFrame(wide + rare, SCHEMA)
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(data).collect()}
    assert out[0] == "<example>" and out[9] == "a <secret> b"
    assert len(out) == 5
    assert secrets.redacted(data).columns == data.columns


def test_empty_tables(spark, frame):
    none = frame.limit(0)
    assert near_dedup.classes(none).count() == 0
    assert substring_dedup.deduplicated(none).count() == 0
    assert secrets.redacted(none).count() == 0
    assert quality.passing(none).count() == 0


def test_native_operators_run_no_python(spark):
    for query in (op4_mixing, op7_secret_scans, op8_quality_rules):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_count_in_ownership_once_for_each_owner(spark):
    data = spark.createDataFrame([(1, "token=abcdef123456", "en", "s", 0, "", "", 1)] * 5, SCHEMA)
    span = secrets.scanned(data).select(F.explode("secrets").alias("s")).select("s.n_owners").distinct().collect()
    assert [r[0] for r in span] == [1]


def test_a_long_clean_text_is_kept(spark):
    stops = quality.STOP_WORDS
    letters = F.translate(F.hex("id"), "0123456789", "ghijklmnop")
    words = spark.range(1_000_001).select(F.concat(F.lit("word"), letters).alias("w"), "id")
    text = " ".join(stops[r["id"] % len(stops)] if r["id"] % 5 == 0 else r["w"] for r in words.collect())
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    judged = quality.judged(frame).select("quality.n_words", "quality.kept", "quality.failed").first()
    assert tuple(judged) == (1_000_001, True, [])
