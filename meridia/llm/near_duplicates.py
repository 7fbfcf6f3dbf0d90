"""Near-duplicates by min-max hashing.

A document's set is that of the hashes of its n-word shingles. Under each permutation both the minimum and the maximum are
kept, so half as many permutations give as many signature values; the values are banded, and documents that agree in a band
share a bucket. Documents with equal sets are one vertex, and buckets with equal members are one bucket. Every link is
confirmed on full sets:

1. Each member of a bucket meets the bucket's pivot, the member that shares most places with others (in a group of copies,
   the one that most others resemble). The links that hold are joined into components.
2. Buckets whose members are all of one component are done. In each other one, members outside the bucket's largest component
   meet all members of other components, in blocks of bounded size (_buckets.py). No pair of texts leaves a block unless it
   joins two components, so rows stay in proportion to the buckets, whatever the groups' sizes.

So every pair that shares a band is in one component or was compared on its full sets; nothing is judged by signatures. What
the bands miss: a pair of similarity s shares none with a chance of (1 - s^rows)^bands, 5e-6 at 0.8 with 40 bands of 6.

Cases: null and empty texts have an empty set, link with nothing and are kept; a text of fewer words than n is one shingle;
equal texts are one component; rows that repeat an id are judged by their texts, and each has a row of its own in the
result; a row without an id is linked like any other and is never a component's smallest id; in a component without any id
component_id is null and all rows are told as kept, of which distinct() keeps one; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._buckets import joined
from meridia.llm._components import components
from meridia.llm._store import bounded_batches, discard, fresh, release, written
from meridia.llm._text import U64, grams, inside, map_texts, mix, parts, words_of

BANDS, ROWS, PERCENT = 40, 6, 80
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text in a row, and the bounds of each."""
    words = words_of(texts, lower=True)
    hashes, counts = words.hashes(), words.counts
    at = np.flatnonzero(inside(words, n))
    shingles, first = grams(hashes, n)[at] if len(at) else np.zeros(0, U64), np.searchsorted(at, words.docs)
    out, bounds = [], [0]
    for d in range(len(counts)):
        if 0 < counts[d] < n:
            own = mix(grams(hashes[words.docs[d] : words.docs[d + 1]], int(counts[d])) + U64(counts[d]))
        else:
            own = np.sort(shingles[first[d] : first[d + 1]])
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, U64), np.array(bounds)


def signatures(sets: np.ndarray, bounds: np.ndarray, values: int) -> np.ndarray:
    """Minima and maxima in turn, a column for each set that isn't empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((values, len(starts)), U64)
    for p in range((values + 1) // 2) if len(starts) else ():
        permuted = sets * _FACTORS[p]
        out[2 * p] = np.minimum.reduceat(permuted, starts)
        if 2 * p + 1 < values:
            out[2 * p + 1] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band, a row for each set that isn't empty."""
    values = signatures(sets, bounds, bands * rows)
    out = np.empty((bands, values.shape[1]), U64)
    for b in range(bands):
        key = np.full(values.shape[1], b + 1, U64)
        for v in values[b * rows : (b + 1) * rows]:
            key = mix(key * U64(0x9E3779B97F4A7C15) + v)
        out[b] = key
    return out.T


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, n_shingles, v, keys) of every row; v, the set's digest, and keys are null for an empty set."""

    def each(texts: pa.Array) -> list[pa.Array]:
        sets, bounds = shingle_sets(texts, n)
        sizes = np.diff(bounds)
        keys = iter(band_keys(sets, bounds, bands, rows).view(np.int64))
        return [
            pa.array(sizes),
            pa.array([_digest(sets[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            pa.array([next(keys) if s else None for s in sizes], pa.list_(pa.int64())),
        ]

    return map_texts(docs, each, "n_shingles bigint, v binary, keys array<bigint>", ["row", "doc_id"], "text")


def _similar(items: str | Column, others: str | Column, percent: int) -> Column:
    """Whether sets of these sizes may be similar enough."""
    return 100 * F.least(items, others) >= percent * F.greatest(items, others)


def confirmed(pairs: DataFrame, pool: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, from the texts of both."""
    bounded_batches(pairs.sparkSession)
    left = pool.select(F.col("v").alias("a"), F.col("text").alias("x"))
    right = pool.select(F.col("v").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "x", 1_000_000):
                xs, xb = shingle_sets(part.column("x"), n)
                ys, yb = shingle_sets(part.column("y"), n)
                ok = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = xs[xb[i] : xb[i + 1]], ys[yb[i] : yb[i + 1]]
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
                if ok.any():
                    yield part.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _pool(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(v, text, items): the text of each wanted vertex (row, v, items), which one row gives."""

    def own(texts: pa.Array) -> list[pa.Array]:
        s, b = shingle_sets(texts, n)
        return [pa.array([_digest(s[x:y]) for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary()), texts.cast(pa.string())]

    rows = docs.join(wanted, "row").select("v", "items", F.col("text").alias("_text"))
    rows = map_texts(rows, own, "_digest binary, text string", ["v", "items"], "_text").filter("v = _digest")
    return rows.dropDuplicates(["v"]).select("v", "text", "items")


def _sets(pool: DataFrame, n: int) -> DataFrame:
    """(v, shingles): each text's set, as 64-bit integers in a row."""

    def each(texts: pa.Array) -> list[pa.Array]:
        s, b = shingle_sets(texts, n)
        raw = s.tobytes()
        return [pa.array([raw[8 * x : 8 * y] for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary())]

    return map_texts(pool, each, "shingles binary", ["v"])


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """labels (v, label) after the labels' own components (v, label)."""
    to = moved.select(F.col("v").alias("label"), F.col("label").alias("_to"))
    return labels.join(to, "label", "left").select("v", F.coalesce("_to", "label").alias("label"))


def classes(docs: DataFrame, n: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (row, doc_id, text): (row, doc_id, n_shingles, v) of each, and (v, label) of each set that isn't empty."""
    sketch = written(_sketch(docs, n, bands, rows))
    sets = written(sketch.filter("v is not null").groupBy("v").agg(F.min("row").alias("row"), F.max("n_shingles").alias("items"), F.first("keys").alias("keys")))
    places = sets.select("v", "items", F.explode("keys").alias("key"))
    # bits of all members: equal for equal members
    print_ = [F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"x{i}") for i in range(2)]
    kinds = places.groupBy("key").agg(F.count("*").alias("size"), *print_).filter("size > 1")
    kinds = kinds.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key", "size")
    buckets = written(places.join(kinds, "key"))
    popular = buckets.groupBy("v").agg(F.sum("size").alias("popular"))
    pool = written(_pool(docs, sets.join(popular.select("v"), "v").select("row", "v", "items"), n))
    ranked = buckets.join(popular, "v")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("popular", "v", "items")).alias("p")).select("key", F.col("p.v").alias("p"), F.col("p.items").alias("_items"))
    met = buckets.join(pivots, "key").filter((F.col("v") != F.col("p")) & _similar("items", "_items", percent))
    pairs = met.select(F.least("v", "p").alias("a"), F.greatest("v", "p").alias("b")).distinct()
    links = written(confirmed(pairs, pool, n, percent))
    labels = components(links)
    vertices = sets.select("v")
    labels = written(vertices.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label")))
    more = written(joined(buckets, labels, _sets(pool, n), percent))
    labels = written(_relabelled(labels, components(more)))
    discard(buckets, pool, links, more, sets)
    return sketch.drop("keys"), labels


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: documents whose sets have intersection / union of at least
    percent / 100 are linked; component_id is the smallest id that links reach, and kept tells whether it is the row's own.
    """
    sketch, labels = classes(_rows(docs, doc_id, text), n, percent, bands, rows)
    found = sketch.join(labels, "v", "left")
    least = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = found.join(written(least), "label", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    release(docs.sparkSession)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def distinct(docs: DataFrame, n: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the least id; of rows that are equal in id and text, one."""
    sketch, labels = classes(_rows(docs, doc_id, text), n, percent, BANDS, ROWS)
    found = sketch.join(labels, "v", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    chosen = found.filter("label is not null").groupBy("label").agg(first).select(F.col("first.row").alias("row"))
    own, place = fresh(docs, "own"), fresh(docs, "place")
    chosen = written(chosen.unionByName(found.filter("label is null").select("row").distinct()).withColumnRenamed("row", own))
    rows = docs.withColumn(own, F.xxhash64(doc_id, text)).join(chosen, own, "left_semi")
    once = Window.partitionBy(own).orderBy(F.lit(1))
    return rows.withColumn(place, F.row_number().over(once)).filter(F.col(place) == 1).drop(own, place)
