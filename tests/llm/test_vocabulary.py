"""Spelling variants and the divergence audit against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lanecost.llm import packed_terms, source_divergence, spelling
from lanecost.llm.catalog import queries

LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def brute_words(rows, least=5):
    counts = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = defaultdict(set)
    by_cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1 :]].add(w)
        by_cut[w].add(w)
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(((-words[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def test_spelling_query_matches_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries()["op11_spelling_variants"](spark, SF).collect()]
    want = brute_variants(brute_words(rows))
    assert sorted(got, key=repr) == want
    assert any(w[1] for w in want)


@pytest.mark.parametrize("most", [2048, 3])
def test_near_words_of_a_dense_vocabulary(spark, monkeypatch, most):
    """Few letters, so that many words meet; with a low bound every range is cut to single places."""
    monkeypatch.setattr(spelling, "MOST_MEETING", most)
    pick = random.Random(4)
    words = {"".join(pick.choice("abéÿ") for _ in range(pick.randint(6, 9))): pick.randint(5, 4000) for _ in range(900)}
    words |= {"x" * 300: 7, "x" * 301: 40, "x" * 302: 9000, "y" + "x" * 300: 6}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = Counter((r["word"], r["other"], r["other_n"]) for r in spelling.near_words(frame).collect())
    want = {(a, b, words[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert set(got) == want and max(got.values()) == 1


def test_spelling_awkward_rows(spark):
    long = "Straßen×÷ " * 3000 + "ü Ālphabet naïve naïve NAÏVE " + " " + "abcdefgh" * 20000
    rows = [(1, long), (1, long), (None, "Hellooo hellooo hellooo hellooo hellooo hellooo"), (2, None), (3, ""), (4, "é" * 50)]
    rows += [(k, "misspel misspell misspell misspell") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS key")
    got = sorted(map(tuple, spelling.variants(frame).collect()), key=repr)
    assert got == brute_variants(brute_words(rows))
    assert spelling.variants(frame.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["abcdef"] * 5 + ["abcdefg"] * 26 + ["abcdefgh"] * 140 + ["abcdefghi"] * 800)
    frame = spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string")
    got = sorted(map(tuple, spelling.variants(frame).collect()), key=repr)
    assert got == brute_variants(brute_words([(k, text) for k in range(2)]))
    assert {r[2] for r in got if r[0].startswith("abcdef")} == {"abcdefghi"}


def test_checksums():
    data = np.frombuffer(b"17:hello wide world" + bytes(16), np.uint8)
    begin, length = np.array([3, 9, 0]), np.array([5, 10, 0])
    start = np.array([zlib.crc32(b"17:")] * 3, np.uint32)
    want = [zlib.crc32(b"17:hello"), zlib.crc32(b"17:wide world"), zlib.crc32(b"17:")]
    assert spelling.checksums(data, begin, length, start).tolist() == want


def brute_terms(rows):
    counts, docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts.update((lang or "", source or "", t) for t in terms)
        docs.update((lang or "", source or "", t) for t in set(terms))
    return sorted((*k, n, docs[k]) for k, n in counts.items())


def awkward_terms():
    pick = random.Random(8)
    letters = ["a", "b", "Z", "é", "中", "\U0001f600", " ", "\n", "1", "[", "`", "{", "\x00", "\x7f"]
    rows = [(pick.choice(["en", "de", None, ""]), pick.choice(["s", None, "t"]), "".join(pick.choices(letters, k=200))) for _ in range(300)]
    exact = ["abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "x" * 64, "x" * 65, "X" * 5000]
    rows += [("en", "s", " ".join(exact * 3)), ("en", "s", None), (None, None, None), ("en", "u", "")]
    rows += [("en", "s", "wor"), ("en", "s", "ds")]  # a term ends with its text
    return rows


@pytest.mark.parametrize("size", [packed_terms.SLICE_BYTES, 500])
def test_packed_counts(spark, monkeypatch, size):
    """Also with slices so small that a text is counted in several parts."""
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", size)
    monkeypatch.setattr(packed_terms.text_slices, "__defaults__", (size,))
    rows = awkward_terms()
    columns = [pa.array([r[i] or "" for r in rows], pa.string()) for i in range(3)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])
    table = pa.Table.from_batches(list(source_divergence._counts(iter([batch.slice(0, 100), batch.slice(100), batch.slice(0, 0)]))))
    summed = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    got = sorted(tuple(r.values()) for r in summed.to_pylist())
    assert got == brute_terms(rows)


def brute_audit(rows, least):
    counts, held, per_lang = Counter(), Counter(), Counter()
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    for lang, source, t, n, docs in brute_terms(rows):
        counts[lang, source, t] += n
        held[lang, t] += docs
        per_lang[lang, t] += n
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for (lg, t), d in held.items() if lg == lang and d >= least]
        names = sorted((s for lg, s in groups if lg == lang), key=lambda s: s.encode())

        def shares(count):
            total = sum(map(count, terms))
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(terms)) for t in terms}

        q = shares(lambda t: per_lang[lang, t])
        p = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in names}
        for s in names:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in names if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            above = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if counts[lang, s, t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(above[:50])]
    return sorted(out)


@pytest.mark.parametrize("width", [128, 2])
def test_audit_of_awkward_rows(spark, monkeypatch, width):
    """Also with tiles of two sources, so that the sources of a language need several."""
    monkeypatch.setattr(source_divergence, "WIDTH", width)
    monkeypatch.setattr(source_divergence, "MIN_DOCS", 12)
    rows = [*awkward_terms(), *[("en", f"t{i}", f"aa b {'bb' * (i % 3)}") for i in range(5)], ("xx", "s", "one"), ("xx", "t", None)]
    rows = [(lang, source, text and text.replace("\x00", " ")) for lang, source, text in rows]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS place")
    got = sorted(map(tuple, source_divergence.audit(frame).collect()))
    want = brute_audit(rows, 12)
    assert got == want
    assert ("xx", "s", "pair", "t", 0, 1) in got
    assert source_divergence.audit(frame.limit(0)).count() == 0
