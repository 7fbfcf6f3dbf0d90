"""Operators on whole texts against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridia.llm import near_duplicates, repeated_phrases, repetition
from meridia.llm._text import grams, inside, parts, words_of
from tests.llm import brute

KIND = "doc_id long, text string, TEXT_2 string, n_words long, row long"


def table(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(k, t, "x", -1, -2) for k, t in rows], KIND)


def test_words_and_hashes():
    texts = brute.odd_texts(1)
    w = words_of(pa.array(texts))
    got = [[w.word(i).decode() for i in range(w.docs[d], w.docs[d + 1])] for d in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    flat = [x for t in got for x in t]
    for n in (1, 2, 3, 5, 8):
        keys = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
        hashes = grams(w.hashes(), n).tolist()
        assert len(set(keys)) == len(set(hashes)) == len(set(zip(keys, hashes, strict=True)))
        assert inside(w, n).sum() == sum(max(0, len(t) - n + 1) for t in got)


def test_parts_hold_whole_texts():
    batch = pa.record_batch({"t": pa.array(["a" * 10, None, "b" * 100, "", "c" * 5])})
    got = [p.column("t").to_pylist() for p in parts(batch, "t", 20)]
    assert [x for p in got for x in p] == batch.column("t").to_pylist() and len(got) > 1


@pytest.mark.parametrize(("window", "phrase", "hot", "size"), [(35, 8, 10_000, 2_000_000), (6, 3, 2, 200), (6, 6, 10_000, 100), (5, 1, 1, 4_000_000)])
def test_repeated_phrases(spark, window, phrase, hot, size):
    base = " ".join(f"q{i}" for i in range(60))
    rows = [(None, None), (2, "a " * 50), (2, "a " * 50), (3, "x")]
    rows += [(None if i % 7 == 0 else i, t) for i, t in enumerate(brute.odd_texts(2))]
    rows += [(100 + i, f"s{i} {base} t{i}") for i in range(8)] + [(200, base.upper()), (201, base + " " + base)]
    found = repeated_phrases.digest(repeated_phrases.remove_repeats(table(spark, rows), window, phrase, hot, size))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute.removed(rows, window), key=key)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    import random

    rng = random.Random(5)
    rows = list(enumerate(brute.odd_texts(3)))
    for family in range(12):  # families of copies with more and more words changed, also of copies of copies
        text = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([2, 9, 25])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                text = copy
    rng.shuffle(rows)
    found = near_duplicates.near_duplicates(table(spark, rows), n).collect()
    want = brute.linked(rows, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    stay = near_duplicates.distinct(table(spark, rows), n)
    assert stay.columns == ["doc_id", "text", "TEXT_2", "n_words", "row"]
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, (_, c) in want.items() if c == k)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t = "one two three four five six seven"
    rows = [(4, t), (4, t), (None, t), (9, t), (2, None), (2, None), (None, "alone here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(table(spark, rows), 2).collect()), key=str)
    assert got == sorted([(4, 6, 4, True)] * 2 + [(None, 6, 4, False), (9, 6, 4, False)] + [(2, 0, 2, True)] * 2 + [(None, 1, None, True)], key=str)
    assert sorted(str(r.doc_id) for r in near_duplicates.distinct(table(spark, rows), 2).collect()) == ["2", "4", "None"]
    assert near_duplicates.distinct(table(spark, [(None, t), (None, t), (None, t + " eight")]), 2).count() == 1


def test_a_row_without_an_id_links_near_copies(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t), (5, t + " more"), (7, t + " more and"), (8, "else")]
    got = {r.n_shingles: r.component_id for r in near_duplicates.near_duplicates(table(spark, rows), 2).collect()}
    assert got == {59: 5, 60: 5, 61: 5, 1: 8}


def test_distinct_keeps_columns_of_any_name(spark):
    t = " ".join(f"w{i}" for i in range(60))
    names = ["_n", "_own", "_id", "_copies", "_place", "row", "v", "label", "key"]
    rows = [(k, x, *(f"{c}{k}" for c in names)) for k, x in ((1, t), (2, t + " x"), (3, "other words here"), (3, "a third text"), (3, "a third text"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    assert sorted(map(tuple, near_duplicates.distinct(docs).collect())) == sorted([rows[0], rows[2], rows[3]])


def test_a_bucket_of_texts_below_the_threshold(spark, monkeypatch):
    """Copies of one text, most of them too much changed to be linked: blocks give few rows, and no link is lost."""
    import random

    from meridia.llm import _buckets

    monkeypatch.setattr(_buckets, "MEMBERS", 100)
    rng, base = random.Random(8), [f"b{i}" for i in range(120)]
    rows = []
    for k in range(1200):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 13)):
            copy[at] = f"e{rng.randrange(10**7)}"
        rows.append((k, " ".join(copy)))
    seen, real = [], near_duplicates.joined
    monkeypatch.setattr(near_duplicates, "joined", lambda *a: seen.append(real(*a).cache()) or seen[-1])
    want = brute.linked(rows, 2)
    assert len({c for _, c in want.values()}) > 100
    found = near_duplicates.near_duplicates(table(spark, rows), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert seen[0].count() < len(rows)


def test_suffix_repetition(spark):
    texts = brute.odd_texts(4, 120)
    found = repetition.rules(table(spark, list(enumerate(texts))), least=5, covered=0.3, longest=20).collect()
    for r in found:
        want = brute.repeats(texts[r.doc_id], 5)
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed
        assert r.kept == (not failed and want["n_covered_words"] <= 0.3 * want["n_words"] and want["longest_repeat"] <= 20)


@pytest.mark.parametrize("run", [
    lambda df: repeated_phrases.remove_repeats(df),
    lambda df: near_duplicates.near_duplicates(df),
    lambda df: near_duplicates.distinct(df),
    lambda df: repetition.rules(df),
])
def test_empty_table(spark, run):
    assert run(table(spark, []).filter(F.lit(False))).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    x, y = np.sort(a[:3000]), np.sort(a[1000:])
    s = near_duplicates.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 1000)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.5) < 0.06


def test_texts_longer_than_a_slice(spark):
    """Two equal texts of 1.7 MB among short ones, whole in every operator."""
    import random

    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(250_000))
    rows = [(1, "short one"), (2, long), (3, "short two"), (4, long), (5, None)]
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_phrases.remove_repeats(table(spark, rows)).collect()}
    assert removed == {1: (2, 0), 2: (250_000, 250_000), 3: (2, 0), 4: (250_000, 250_000), 5: (0, 0)}
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates.near_duplicates(table(spark, rows), 2).collect()}
    assert found[4] == found[2] == (2, len(brute.shingles(long, 2))) and found[1] == (1, 1) and found[5] == (5, 0)
    rules = {r.doc_id: r.n_words for r in repetition.rules(table(spark, rows)).collect()}
    assert rules == {1: 2, 2: 250_000, 3: 2, 4: 250_000, 5: 0}
