"""Language-model scoring by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of orders 1 to `order` and of a uniform one
over the vocabulary and one unknown token. The weights depend on how often the token's longest context was seen, in
buckets that double. They are learnt by expectation-maximisation on held-out counts: each training token in turn is deleted
from all counts, and what is left predicts it.

N-grams are 64-bit hashes and travel in blobs, not rows. Documents are packed into batches of about `batch_tokens` tokens,
which is a written table. Each batch sends its different n-grams, each once with its training count, cut by ranges of the
hash; a range sums all batches' counts and answers each batch in the order in which it asked. So a frequent n-gram is one
entry a batch, ranges are even, and all batches' n-grams are counted. What EM needs is gathered in a histogram of bounded
size: cells of (bucket, logarithm of each estimate), with the estimates' means. It alone goes to the driver.

Cases: null and empty texts are the end token alone; a null id belongs to the side that the flag says; repeated rows are
documents of their own; without training documents only the uniform estimate is left; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._store import bounded_batches, release, tasks, written
from meridia.llm._text import U64, mix, parts, words_of

ORDER, BATCH = 3, 1_000_000
#: Hashes of the end token and of what stands before a document.
END, BEGIN = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
#: Buckets of context counts, and cells for the logarithm of an estimate: FINENESS cells for each factor of two.
BUCKETS, CELLS, FINENESS = 40, 32, 1


def _pack(x: np.ndarray) -> bytes:
    """Integers, byte by byte, so that their empty high bytes lie together."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=U64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, U64), dtype=U64)


def _batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """(batch, doc_ids, held, counts, vocabulary, stream, n_tokens): packed batches of whole documents."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def batch_row() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            flags = pa.concat_arrays([x[1] for x in held])
            counts = np.concatenate([x[2] for x in held])
            vocabulary, stream = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            one = pa.array([0, len(ids)], pa.int32())
            columns = [pa.array([(task << 32) + number]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, flags), pa.ListArray.from_arrays(one, pa.array(counts)), pa.array([_pack_sorted(vocabulary)], pa.binary()), pa.array([_pack(stream.astype(np.uint32))], pa.binary()), pa.array([len(stream)])]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "held", "counts", "vocabulary", "stream", "n_tokens"])

        for batch in batches:
            for part in parts(batch, "_text"):
                words = words_of(part.column("_text"), lower=True)
                tokens = np.insert(words.hashes(), words.docs[1:], END)
                held.append((part.column("doc_id"), part.column("held"), words.counts + 1, tokens))
                total += len(tokens)
                if total >= batch_tokens:
                    yield batch_row()
                    held, total, number = [], 0, number + 1
        if held:
            yield batch_row()

    schema = f"batch bigint, doc_ids array<{kind.simpleString()}>, held array<boolean>, counts array<bigint>, vocabulary binary, stream binary, n_tokens bigint"
    return docs.select("doc_id", "held", "_text").mapInArrow(run, schema)


class Tokens:
    """A batch, unpacked: hashes of the n-grams that end at each token, by order; only: of the last order alone."""

    def __init__(self, row: dict, order: int, only: bool = False) -> None:
        words = _unpack_sorted(row["vocabulary"])[_unpack(row["stream"], np.uint32)]
        self.counts = np.asarray(row["counts"], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.held = np.repeat(np.asarray(row["held"], bool), self.counts)
        self.starts = self.bounds[:-1]
        self.keys, self.inverse = [], []
        gram = words
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([[U64(0)], gram[:-1]])
                before[self.starts] = BEGIN + U64(k)
                gram = mix(before * U64(0x9E3779B97F4A7C15) + words)
            if only and k < order:
                continue
            keys, inverse = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.inverse.append(inverse)

    def before(self, seen: np.ndarray, first: float) -> np.ndarray:
        """Of each token, what the one before it has; `first` for a document's first."""
        out = np.concatenate([[first], seen[:-1]])
        out[self.starts] = first
        return out


def _asked(batches: DataFrame, gram: int, ranges: int) -> DataFrame:
    """(gram, part, batch, keys, counts): a batch's n-grams of an order in a range of hashes, with their training counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // ranges for i in range(ranges)], U64)
        for row in (r for b in rows for r in b.to_pylist()):
            tokens = Tokens(row, gram, only=True)
            own, inverse = tokens.keys[0], tokens.inverse[0]
            n = np.bincount(inverse[~tokens.held], minlength=len(own)).astype(np.uint32)
            cut = np.append(np.searchsorted(own, edges), len(own))
            keys = [_pack_sorted(own[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            counts = [_pack(n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            same = [pa.array([x] * ranges, t) for x, t in ((gram, pa.int32()), (row["batch"], pa.int64()))]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(range(ranges), pa.int32()), same[1], pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["gram", "part", "batch", "keys", "counts"])

    return batches.select("batch", "counts", "held", "vocabulary", "stream").mapInArrow(run, "gram int, part int, batch bigint, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(gram, part, batch, counts, kinds, tokens): all batches' counts, in the order of the batch's keys.

    kinds and tokens: in one row of each range, how many different n-grams training has there and how many in all.
    """

    def answer(table: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts)
        found, at = total[inverse].astype(U64), np.cumsum([0, *map(len, keys)])
        n = table.num_rows
        once = lambda x: pa.array([int(x), *[0] * (n - 1)], pa.int64())
        blobs = pa.array([_pack(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table([table.column("gram"), table.column("part"), table.column("batch"), blobs, once((total > 0).sum()), once(total.sum())], names=["gram", "part", "batch", "counts", "kinds", "tokens"])

    return asked.groupBy("gram", "part").applyInArrow(answer, "gram int, part int, batch bigint, counts binary, kinds bigint, tokens bigint")


def _estimates(tokens: Tokens, seen: list[np.ndarray], n: int, docs: int, deleted: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bucket of each token, and its estimates of orders 1, 2 ...; deleted: without the token itself."""
    less = 1.0 if deleted else 0.0
    context, out = np.full(len(tokens.held), float(n)), []
    for k, counts in enumerate(seen):
        if k:
            context = tokens.before(seen[k - 1].astype(float), float(docs))
        of = np.maximum(context - less, 0)
        out.append(np.divide(np.maximum(counts - less, 0), of, out=np.zeros(len(of)), where=of > 0))
    return np.minimum(np.log2(np.maximum(context - less, 0) + 1), BUCKETS - 1).astype(np.int64), out


def _histogram(bucket: np.ndarray, estimates: list[np.ndarray], use: np.ndarray) -> dict[str, pa.Array]:
    """Cells of the tokens to use: how many there are and the sums of their estimates."""
    cell = bucket
    for p in estimates:
        level = np.where(p > 0, 1 + np.minimum(-FINENESS * np.log2(np.maximum(p, 1e-300)), CELLS - 2), 0).astype(np.int64)
        cell = cell * CELLS + level
    kinds, inverse = np.unique(cell[use], return_inverse=True)
    sums = {f"s{k}": pa.array(np.bincount(inverse, p[use], len(kinds)).astype(float)) for k, p in enumerate(estimates)}
    return {"cell": pa.array(kinds), "n": pa.array(np.bincount(inverse, minlength=len(kinds))), **sums}


def learn_weights(cells: np.ndarray, n: np.ndarray, means: np.ndarray, uniform: float, steps: int = 200) -> np.ndarray:
    """Weights (uniform, order 1, 2 ...) of each bucket, by EM; a bucket without tokens has those of all tokens."""
    order = means.shape[1]
    p = np.column_stack([np.full(len(n), uniform), means])

    def em(use: np.ndarray) -> np.ndarray:
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(steps):
            share = p[use] * w
            w = (n[use, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-9)
            w /= w.sum()
        return w

    none = np.append(1.0, np.zeros(order))
    every = em(np.ones(len(n), bool)) if len(n) else none
    bucket = cells // CELLS**order
    return np.array([em(bucket == b) if (bucket == b).any() else every for b in range(BUCKETS)])


def score(docs: DataFrame, held: Column, order: int = ORDER, batch_tokens: int = BATCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held rows are not learnt from.

    base_score is that of add-one unigrams, score the model's log10 probability of the whole text and its end.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held"), F.col(text).alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    batches = written(_batches(docs, batch_tokens))
    ranges = tasks(spark)
    # one order after another, so that the n-grams of only one are in shuffle files
    answers = functools.reduce(DataFrame.union, [written(_answered(_asked(batches, k, ranges))) for k in range(1, order + 1)])
    known = answers.filter("gram = 1").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    kinds, n = int(known[0]), int(known[1])
    begun = batches.select(F.explode("held").alias("held")).filter("not held").count()
    uniform = 1 / (kinds + 1)

    def opened(left: pa.Table, right: pa.Table) -> tuple[dict, Tokens, list[np.ndarray]]:
        """A batch's row, its tokens and how often training has the n-grams that end at each."""
        row = left.to_pylist()[0]
        tokens, right = Tokens(row, order), right.sort_by([("gram", "ascending"), ("part", "ascending")])
        grams, blobs = right.column("gram").to_pylist(), right.column("counts").to_pylist()
        found = [np.concatenate([_unpack(x, U64) for g, x in zip(grams, blobs, strict=True) if g == k + 1]) for k in range(order)]
        return row, tokens, [f[i].astype(float) for f, i in zip(found, tokens.inverse, strict=True)]

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        _, tokens, seen = opened(left, right)
        bucket, estimates = _estimates(tokens, seen, n, begun, deleted=True)
        return pa.table(_histogram(bucket, estimates, ~tokens.held))

    both = batches.drop("n_tokens").groupBy("batch").cogroup(answers.select("batch", "gram", "part", "counts").groupBy("batch"))
    sums = ", ".join(f"s{k} double" for k in range(order))
    cells = both.applyInArrow(histogram, f"cell bigint, n bigint, {sums}").groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(order)])
    got = cells.orderBy("cell").toArrow()
    number = got.column("n").to_numpy().astype(float)
    means = np.column_stack([got.column(f"s{k}").to_numpy() / number for k in range(order)]) if len(number) else np.zeros((0, order))
    weights = learn_weights(got.column("cell").to_numpy(), number, means, uniform)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row, tokens, seen = opened(left, right)
        bucket, estimates = _estimates(tokens, seen, n, begun, deleted=False)
        p = weights[bucket, 0] * uniform
        for k, estimate in enumerate(estimates):
            p = p + weights[bucket, k + 1] * estimate
        # orders whose context wasn't seen have no estimate; their weight is shared by the others
        lost = sum((weights[bucket, k + 1] * (tokens.before(seen[k - 1], float(begun)) == 0) for k in range(1, order)), np.zeros(len(p)))
        p = p / (1 - lost) if n else np.full(len(p), uniform)
        model, base = np.log10(p), np.log10((seen[0] + 1) / (n + kinds + 1))
        known, based, scores = (np.add.reduceat(x, tokens.starts) for x in ((seen[0] > 0).astype(np.int64), base, model))
        ids, flags = (left.column(c).combine_chunks().flatten() for c in ("doc_ids", "held"))
        return pa.table([ids, flags, pa.array(tokens.counts), pa.array(known), pa.array(np.full(len(tokens.counts), n)), pa.array(based), pa.array(scores)], names=names)

    del cells  # with it go the histogram's shuffle files
    release(spark)
    return both.applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
