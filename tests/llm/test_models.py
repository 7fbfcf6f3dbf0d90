"""Decontamination, toxicity and language-model scores."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridia.llm import decontamination, interpolation, toxicity
from meridia.llm import queries as Q
from tests.llm import brute

FILL = [f"w{i}" for i in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(FILL) for _ in range(n))


def test_tiling_catches_reordered_passages(spark):
    rng = random.Random(1)
    items = [text(rng, 40) for _ in range(6)]
    half = lambda t: (" ".join(t.split()[:20]), " ".join(t.split()[20:]))
    a, b = half(items[1])
    docs = {
        0: text(rng, 300),
        1: text(rng, 50) + " " + items[0] + " " + text(rng, 50),
        2: f"{text(rng, 20)} {b.upper()}! {text(rng, 30)} {a}. {text(rng, 5)}",
        3: half(items[2])[0] + " " + text(rng, 100),
        4: " ".join(w for w in items[3].split()) .replace(items[3].split()[20], "changed"),
        5: None,
        6: "",
        7: " ".join(items[4].split()[i] for i in rng.sample(range(40), 40)),
    }
    rows = spark.createDataFrame([(k, v, -1) for k, v in docs.items()] + [(1, docs[1], -1)], "doc_id long, text string, item_id long")
    tests = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    found = decontamination.contaminated(rows, tests).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles) for r in found) == [(1, 0, 1), (1, 0, 1), (2, 1, 2), (4, 3, 2)]
    for r in found:
        assert r.coverage == r.covered_words / r.item_words >= 0.8 and r.covered_words == sum(t.n_words for t in r.tiles)
    kept = decontamination.clean(rows, tests)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 7]
    assert decontamination.contaminated(rows, tests.limit(0)).count() == decontamination.contaminated(rows.limit(0), tests).count() == 0


def brute_cover(item, doc, least=5):
    """Words of the item that greedy tiles cover, by looking for the longest run again and again."""
    used_i, used_d, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and i + k not in used_i and d + k not in used_d:
                    k += 1
                if k > best[0]:
                    best = (k, d, i)
        k, d, i = best
        if k < least:
            return covered
        used_i.update(range(i, i + k))
        used_d.update(range(d, d + k))
        covered += k


def test_tiles_against_plain_search():
    rng = random.Random(2)
    for _ in range(40):
        item = [rng.choice("abc") for _ in range(rng.randrange(5, 25))]
        doc = [rng.choice("abc") for _ in range(rng.randrange(0, 40))] + item[3:15] + item[:8]
        found = list(decontamination.matches(pa.array([" ".join(doc)]), x := decontamination.index([0], pa.array([" ".join(item)]), 5), x.table(), 5, 0.0))
        assert (found[0][3] if found else 0) == brute_cover(item, doc)


def test_long_tiles_against_plain_search():
    """Matches of more than twice the first length, cut and reordered passages, and terms that repeat."""
    rng = random.Random(21)
    for _ in range(15):
        item = [rng.choice(FILL[:60]) for _ in range(rng.randrange(90, 160))]
        cuts = sorted(rng.sample(range(len(item)), 4))
        pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        rng.shuffle(pieces)
        doc = [w for p in pieces for w in [*p, *(rng.choice(FILL[:60]) for _ in range(rng.randrange(3)))]] + item[20:80]
        found = list(decontamination.matches(pa.array([" ".join(doc)]), x := decontamination.index([0], pa.array([" ".join(item)]), 5), x.table(), 5, 0.0))
        assert found[0][3] == brute_cover(item, doc)
        marked = [p for i, d, k in found[0][2] for p in zip(range(i, i + k), range(d, d + k), strict=True)]
        assert all(item[i] == doc[d] for i, d in marked) and len({i for i, _ in marked}) == len({d for _, d in marked}) == len(marked)


def test_blocks_of_items(spark):
    rng = random.Random(3)
    items = [(i, text(rng, 30)) for i in range(20)]
    blocks = list(decontamination.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5, most=200))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids) == list(range(20))


def toxic_world(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        sentences = [text(rng, 8) for _ in range(rng.randrange(1, 12))]
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vilex", "vileyo", "gruntz"]) + f" q{i}"
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(4)
    docs, labels = toxic_world(rng, 900)
    rows = spark.createDataFrame([(*d, 0.5) for d in docs] + [(10_000, None, 0.5), (10_001, "", 0.5)], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.learn(rows, marks.filter(~held))
    scores = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    out = [(scores[i] >= 0.3) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out) / len(out) > 0.97
    assert scores[10_000] == scores[10_001] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    found = {r.doc_id: r.sentences for r in toxicity.offending(rows, model, 0.3).collect()}
    hits = [any(w in s.text for w in ("vilex", "vileyo", "gruntz")) for i, y in labels if y for s in found[i]]
    assert sum(hits) / len(hits) > 0.95
    kept = toxicity.below(rows, model, 0.3)
    assert kept.columns == rows.columns and kept.count() == sum(s < 0.3 for s in scores.values())


def test_noisy_or_against_plain_sentences(spark):
    """Every score, and the worst sentence, from the model's weights by plain loops."""
    import re

    import numpy as np

    rng = random.Random(11)
    docs, labels = toxic_world(rng, 400)
    docs += [(5000, None), (5001, ""), (5002, " .!? "), (5003, "vilex " * 3000 + "."), (5004, "vilex. vilex"), (5005, "VILEX é"), (None, "gruntz"), (5006, ". ".join(text(rng, 9) for _ in range(30_000)))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    number = {}

    def terms(sentence):
        for t in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", sentence.translate(brute.LOWER)):
            if t not in number:
                number[t] = toxicity._features(toxicity.words_of(pa.array([t]), lower=True, solid=toxicity.TERM))[:, 0].tolist()
            yield from number[t]

    for r in toxicity.score(rows, model).collect():
        body = next(t or "" for k, t in docs if k == r.doc_id)
        sentences = [s for s in re.split(r"[.!?\n]", body) if re.search(r"[0-9A-Za-z\u0080-\U0010ffff]", s)]
        p = [1 / (1 + math.exp(-max(-50, min(50, sum(weight.get(f, 0.0) for f in terms(s)) + model.bias)))) for s in sentences]
        assert r.n_sentences == len(p) and r.n_offending == sum(x >= 0.3 for x in p)
        assert r.score == pytest.approx(1 - math.exp(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p)), abs=1e-6)
        if p:
            assert r.worst_score == pytest.approx(max(p), abs=1e-9) and p[r.worst_sentence] == pytest.approx(max(p), abs=1e-9)
        else:
            assert r.worst_sentence is None
    assert np.all(np.diff(model.features) > 0)


def test_sample_of_toxicity_is_bounded_in_bytes(spark):
    rng = random.Random(12)
    docs, labels = toxic_world(rng, 300)
    docs.append((9000, "vilex " * 50_000))
    rows, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (9000, 0)], "doc_id long, toxic int")
    model = toxicity.learn(rows, marks, most_bytes=60_000)
    assert {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}[9000] > 0.5
    assert not len(toxicity.learn(rows, marks, most_bytes=10).features)


def test_toxicity_without_a_class(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(rows, toxicity.learn(rows, marks)).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score(rows.limit(0), toxicity.learn(rows.limit(0), marks)).collect() == []


def plain_model(rows, order, weights, buckets):
    tokens = [(k, [*brute.words(t, lower=True), None], h) for k, t, h in rows]
    counts = [Counter() for _ in range(order + 1)]
    for _, w, h in tokens:
        if not h:
            for i in range(len(w)):
                for k in range(1, order + 1):
                    counts[k][tuple(w[j] if j >= 0 else 0 for j in range(i - k + 1, i + 1))] += 1
    n, kinds, begun = sum(counts[1].values()), len(counts[1]), sum(not h for _, _, h in rows)
    out = []
    for key, w, h in tokens:
        base = model = 0.0
        for i in range(len(w)):
            gram = lambda k, at: tuple(w[j] if j >= 0 else 0 for j in range(at - k + 1, at + 1))  # noqa: B023, E731
            seen = [n] + [counts[k][gram(k, i - 1)] if i else begun for k in range(1, order)]
            b = min(int(math.log2(seen[-1] + 1)), buckets - 1)
            p = weights[b][0] / (kinds + 1)
            lost = 0.0
            for k in range(1, order + 1):
                if seen[k - 1]:
                    p += weights[b][k] * counts[k][gram(k, i)] / seen[k - 1]
                else:
                    lost += weights[b][k]
            base += math.log10((counts[1][(w[i],)] + 1) / (n + kinds + 1))
            model += math.log10(p / (1 - lost))
        out.append((key, h, len(w), sum(counts[1][(x,)] > 0 for x in w), n, base, model))
    return out


@pytest.mark.parametrize(("order", "size"), [(2, 50), (2, 10**6), (3, 200)])
def test_interpolation(spark, order, size, monkeypatch):
    rng = random.Random(6)
    rows = [(i, t, i % 5 == 2) for i, t in enumerate(brute.odd_texts(6))] + [(None, "a b", True), (1, "a b", False)]
    rows += [(500 + i, " ".join(rng.choice(FILL[:40]) for _ in range(60)), i % 3 == 0) for i in range(40)]
    learnt = []
    real = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: learnt.append(real(*a)) or learnt[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    got = sorted(map(tuple, interpolation.score(docs, F.col("held"), order, size).collect()), key=str)
    want = sorted(plain_model(rows, order, learnt[0], interpolation.BUCKETS), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for x, y in zip(got, want, strict=True):
        assert x[5] == pytest.approx(y[5]) and x[6] == pytest.approx(y[6])
    unseen = [r for r in got if r[1] and r[0] is not None and r[0] >= 500]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


def test_counts_of_more_than_32_bits(spark):
    import numpy as np

    keys = np.array([5, 9, 2**63], np.uint64)
    rows = [(1, 0, b, bytearray(interpolation._pack_sorted(keys)), bytearray(interpolation._pack(np.array([3_000_000_000, b, 0], np.uint32)))) for b in range(3)]
    got = interpolation._answered(spark.createDataFrame(rows, "gram int, part int, batch bigint, keys binary, counts binary")).collect()
    assert [interpolation._unpack(bytes(r["counts"]), np.uint64).tolist() for r in got] == [[9_000_000_000, 3, 0]] * 3
    assert sum(r.tokens for r in got) == 9_000_000_003 and sum(r.kinds for r in got) == 2


def test_query_interpolates_trigrams(spark, monkeypatch):
    learnt = []
    real = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: learnt.append(real(*a)) or learnt[-1])
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame([(i, "a b c a b d a b c") for i in range(30)], "doc_id long, text string"))
    assert Q.op6_deleted_interpolation(spark, "").count() == 30
    assert learnt[0].shape == (interpolation.BUCKETS, 4)


def test_weights_are_those_of_plain_em(spark, monkeypatch):
    """EM over every training token, each deleted from the counts in turn, instead of a histogram."""
    import numpy as np

    rng = random.Random(13)
    rows = [(i, " ".join(FILL[min(int(rng.expovariate(0.02)), 400)] for _ in range(150)), i % 7 == 2) for i in range(60)]
    learnt = []
    real = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: learnt.append(real(*a)) or learnt[-1])
    interpolation.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held"), 2).count()
    texts = [[*t.split(), None] for _, t, h in rows if not h]
    one, two = Counter(x for t in texts for x in t), Counter(p for t in texts for p in zip([0, *t[:-1]], t, strict=True))
    n, begun, uniform = sum(one.values()), len(texts), 1 / (len(one) + 1)
    by = {}
    for t in texts:
        for a, b in zip([0, *t[:-1]], t, strict=True):
            context = (begun if a == 0 else one[a]) - 1
            by.setdefault(int(math.log2(context + 1)), []).append((uniform, (one[b] - 1) / (n - 1), (two[a, b] - 1) / context if context else 0.0))
    for bucket, tokens in by.items():
        p, w = np.array(tokens), np.full(3, 1 / 3)
        for _ in range(200):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.abs(w - learnt[0][bucket]).max() < 0.03


def test_em_finds_the_mixture():
    import numpy as np

    weights = interpolation.learn_weights(np.array([0, 1]) * interpolation.CELLS**2, np.array([100.0, 50.0]), np.array([[0.5, 0.0], [0.01, 0.9]]), 0.001)
    assert weights[0].argmax() == 1 and weights[1].argmax() == 2 and np.allclose(weights.sum(axis=1), 1)


def test_interpolation_without_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert interpolation.score(docs, F.lit(True)).first().score == 0.0
    assert interpolation.score(docs.limit(0), F.lit(True)).collect() == []
