"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line ends). A sentence's score is a logistic function of its terms and
their beginnings, hashed; a document's score is the noisy-or of its sentences', 1 - prod(1 - p). Only documents have
labels: the weights are fitted by gradient descent on the likelihood of the documents' labels, so the loss reaches the
sentences that explain them, and offending() tells which these are.

The fit takes at most `most` labelled documents of each class, the first by a hash of their id that have together at most
`most_bytes` bytes of text; a longer document is not learnt from, but scored like all others. So what the driver gathers is
bounded. Everything else covers all rows. Cases: null and empty texts have no sentence and score 0; null labels are not learnt from; an id that is labelled
twice counts as toxic if one label says so; without documents of both classes the scores are the share of toxic labels;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._store import written
from meridia.llm._text import TERM, U64, Words, filter_texts, map_texts, mix, words_of

#: Bits of a feature's number, and the lengths in bytes of the beginnings that are features; 0 is the whole term.
BITS, BEGINNINGS = 20, (0, 4, 5, 6)
#: Documents of each class that a fit takes, and bytes of their texts.
MOST, MOST_BYTES = 3000, 16_000_000
#: Features that a model has at most; those with most evidence.
FEATURES = 8192
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Model:
    """Weights by feature number (sorted), and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = 0.0


def _features(words: Words) -> np.ndarray:
    """Feature numbers, a row for each kind and a column for each term."""
    out = []
    for kind, most in enumerate(BEGINNINGS):
        h = words.prefix_hashes(most) if most else words.hashes()
        out.append((mix(h ^ U64(kind * 0x9E3779B9 + 1)) >> U64(64 - BITS)).astype(np.int64))
    return np.stack(out)


def _sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first term of each sentence that has one, and the first sentence of each document (and of none, at the end)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(words.docs), np.int64)
    ended = np.cumsum(_ENDS[words.data])
    at, doc = ended[words.start], words.doc_of()
    first = np.ones(len(words), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, words.docs)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _sentence_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A probability for each sentence; the sentences' first terms; the documents' first sentences."""
    starts, docs = _sentences(words)
    weight = np.zeros(len(words))
    if len(model.features) and len(words):
        table = np.zeros(1 << BITS)
        table[model.features] = model.weights
        weight = table[_features(words)].sum(axis=0)
    z = _sums(weight, np.append(starts, len(words))) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50))), starts, docs


def document_scores(texts: pa.Array, model: Model) -> np.ndarray:
    words = words_of(texts, lower=True, solid=TERM)
    p, _, docs = _sentence_scores(words, model)
    return _noisy_or(p, docs, words, model)


def _noisy_or(p: np.ndarray, docs: np.ndarray, words: Words, model: Model) -> np.ndarray:
    scores = -np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), docs))
    if not len(model.features):
        scores = np.full(len(docs) - 1, model.prior)
    return np.clip(np.where(words.counts > 0, scores, 0.0), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    """Fits to at most `most` documents of each class, of at most `most_bytes` bytes, among those that both tables have."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    seen = marked.agg(F.avg("_y")).first()[0] or 0.0
    order = F.xxhash64("_id", F.lit("sample")), F.col("_id")
    chosen = marked.filter("_y = 1").orderBy(*order).limit(most).unionByName(marked.filter("_y = 0").orderBy(*order).limit(most))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "_id")
    rows = written(rows.withColumn("_hash", F.xxhash64("_id", F.lit("sample"))), free=False)
    upto = Window.partitionBy("_y").orderBy("_hash", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a class has at most `most` documents here
    sizes = rows.select("_y", "_id", "_hash", F.octet_length("text").cast("long").alias("_size")).groupBy("_y", "_id", "_hash").agg(F.sum("_size").alias("_size"))
    fits = sizes.withColumn("_all", F.sum("_size").over(upto)).filter(F.col("_all") <= most_bytes).select("_id")
    rows = rows.join(F.broadcast(fits), "_id", "left_semi").select("_id", "_y", "text")

    def features(texts: pa.Array) -> list[pa.Array]:
        """The distinct features of each document."""
        words = words_of(texts, lower=True, solid=TERM)
        found = _features(words).astype(np.int32)
        return [pa.array([np.unique(found[:, a:b]) for a, b in zip(words.docs[:-1], words.docs[1:], strict=True)], pa.list_(pa.int32()))]

    counts, sizes = np.zeros((2, 1 << BITS)), np.zeros(2, np.int64)
    for part in map_texts(rows, features, "features array<int>", ["_y"]).toArrow().to_batches():
        y, lists = part.column("_y").to_numpy(), part.column("features")
        for c in (0, 1):
            counts[c] += np.bincount(lists.filter(pa.array(y == c)).flatten().to_numpy(), minlength=1 << BITS)
            sizes[c] += (y == c).sum()
    used, odds = select(counts[1], counts[0], int(sizes[1]), int(sizes[0]))
    if not len(used):
        return Model(used, np.zeros(0), -50.0, seen)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))

    def bags(texts: pa.Array) -> list[pa.Array]:
        """Sorted distinct (sentence, place of a used feature) of each document, as sentence << BITS | place."""
        words = words_of(texts, lower=True, solid=TERM)
        starts, first = _sentences(words)
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        found = place[_features(words)]
        out = []
        for d in range(len(words.docs) - 1):
            a, b = words.docs[d], words.docs[d + 1]
            key = ((sentence[a:b] - first[d]) << BITS) | found[:, a:b]
            out.append(np.unique(key[found[:, a:b] >= 0]))
        return [pa.array(out, pa.list_(pa.int64())), pa.array(np.diff(first), pa.int64())]

    got = map_texts(rows, bags, "bag array<bigint>, sentences bigint", ["_id", "_y"]).toArrow().sort_by("_id")
    theta = fit(got.column("bag").combine_chunks(), got.column("sentences").to_numpy(), got.column("_y").to_numpy(), seen, odds)
    return Model(used, theta[:-1], float(theta[-1]), seen)


def _likelihood_ratio(df_pos: np.ndarray, df_neg: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Twice the log likelihood that a feature's share differs between the classes, over that it doesn't."""

    def part(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (n - k) * np.log(1 - share)

    both = (df_pos + df_neg) / (pos + neg)
    return 2 * (part(df_pos, pos, df_pos / pos) + part(df_neg, neg, df_neg / neg) - part(df_pos, pos, both) - part(df_neg, neg, both))


def select(df_pos: np.ndarray, df_neg: np.ndarray, pos: int, neg: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that speak for label 1 beyond chance, and their log odds; documents of a class have them df times."""
    if not pos or not neg:
        return np.zeros(0, np.int64), np.zeros(0)
    odds = np.log((df_pos + 0.5) / (pos + 1)) - np.log((df_neg + 0.5) / (neg + 1))
    evidence = _likelihood_ratio(df_pos, df_neg, pos, neg)
    tested = df_pos >= 3
    tested &= (odds > np.log(3)) & (evidence > 1.5 * np.log(max(2, tested.sum())))
    chosen = np.sort(np.argsort(-np.where(tested, evidence, 0), kind="stable")[:FEATURES])
    chosen = chosen[tested[chosen]]
    return chosen, odds[chosen]


def fit(bags: pa.ListArray, sentences: np.ndarray, y: np.ndarray, prior: float, odds: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 2e-3) -> np.ndarray:
    """Weights and, last, the bias, by Adam on the noisy-or likelihood from the features' log odds.

    prior: the share of label 1 that the classes weigh by, whatever their shares in the sample.
    """
    y = y.astype(float)
    flat = bags.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sentences)])
    doc = np.repeat(np.arange(len(y)), np.diff(bags.offsets.to_numpy()))
    row, col, n = first[doc] + (flat >> BITS), flat & ((1 << BITS) - 1), int(first[-1])
    of_sentence = np.repeat(np.arange(len(y)), sentences)
    theta, scale = np.append(0.5 * odds, -6.0), np.append(np.ones(len(odds)), 0.0)
    pos, neg = y.sum(), (1 - y).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = np.where(y > 0, prior / pos, (1 - prior) / neg)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(row, theta[col], n) + theta[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(of_sentence, np.log1p(-p), len(y))  # log of the chance that no sentence is toxic
        is_toxic = np.maximum(-np.expm1(none), 1e-12)
        # d loss / d z of a sentence: p where the label is 0, -p * (1 - P) / P where it is 1
        slope = share[of_sentence] * p * np.where(y[of_sentence] > 0, -np.exp(none[of_sentence]) / is_toxic[of_sentence], 1.0)
        g = np.append(np.bincount(col, slope[row], len(odds)), slope.sum()) + decay * scale * theta / len(odds) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta


def score(docs: DataFrame, model: Model, least: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, n_offending, worst_sentence, worst_score) of every row.

    n_offending: sentences that score `least` or more; worst_sentence: the number, from 0, of the first of those that score
    most, null where there is no sentence.
    """

    def each(texts: pa.Array) -> list[pa.Array]:
        words = words_of(texts, lower=True, solid=TERM)
        p, _, first = _sentence_scores(words, model)
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        worst, at = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        if len(some):
            worst[some] = np.maximum.reduceat(p, first[some])
            hit = np.flatnonzero(p == np.repeat(worst, sizes))
            at[some] = hit[np.searchsorted(hit, first[some])] - first[some]
        none = sizes == 0
        return [pa.array(_noisy_or(p, first, words, model)), pa.array(sizes), pa.array(_sums((p >= least).astype(float), first).astype(np.int64)), pa.array(at, mask=none), pa.array(worst, mask=none)]

    fields = "score double, n_sentences bigint, n_offending bigint, worst_sentence bigint, worst_score double"
    return map_texts(docs, each, fields, [doc_id], text)


def below(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The documents that score less than `least`, with all their columns."""
    return filter_texts(docs, lambda texts: document_scores(texts, model) < least, text)


def offending(docs: DataFrame, model: Model, least: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentences): of each document, its sentences that score `least` or more: number, text and score."""

    def each(texts: pa.Array) -> list[pa.Array]:
        words = words_of(texts, lower=True, solid=TERM)
        raw = words_of(texts, solid=TERM)
        p, starts, docs_ = _sentence_scores(words, model)
        last = np.append(starts[1:], len(words)) - 1
        out = []
        for d in range(len(docs_) - 1):
            hits = [s for s in range(docs_[d], docs_[d + 1]) if p[s] >= least]
            out.append([{"sentence": s - docs_[d], "text": raw.data[raw.start[starts[s]] : raw.end[last[s]]].tobytes().decode(), "score": float(p[s])} for s in hits])
        kind = pa.list_(pa.struct([("sentence", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
        return [pa.array(out, kind)]

    return map_texts(docs, each, "sentences array<struct<sentence:bigint,text:string,score:double>>", [doc_id], text)
