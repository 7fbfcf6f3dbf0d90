"""All pairs of a bucket's members that may still join two components, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._store import bounded_batches, tasks
from meridia.llm._text import U64

#: Members of a block and items of their sets, about; columns of the matrices that are multiplied at once.
MEMBERS, ITEMS, COLUMNS = 512, 1 << 18, 8192


def _common(sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """How many items each set of xs (a row) shares with each of ys; xs and ys are places in `sets`."""
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, item, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    use = shared[item]
    of, item = of[use], number[item[use]]
    order = np.argsort(item, kind="stable")
    of, item = of[order], item[order]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(item, (begin, begin + COLUMNS))
        holds = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - begin)), np.float32)
        holds[of[a:b], item[a:b] - begin] = 1
        out += holds[xs] @ holds[ys].T
    return out.astype(np.int64)


def links(labels: np.ndarray, sets: list[np.ndarray], is_x: np.ndarray, is_y: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of pairs that link labels: as many as join all that the pairs of xs and ys link, and no more."""
    xs, ys = np.flatnonzero(is_x), np.flatnonzero(is_y)
    if not len(xs) or not len(ys) or len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    common = _common(sets, xs, ys)
    ok = (100 * common >= percent * (size[xs][:, None] + size[ys][None, :] - common)) & (labels[xs][:, None] != labels[ys][None, :])
    i, j = np.nonzero(ok)
    a, b = labels[xs[i]], labels[ys[j]]
    _, first = np.unique(np.minimum(a, b) * np.int64(labels.max() + 1) + np.maximum(a, b), return_index=True)
    up = list(range(int(labels.max()) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in first.tolist():
        p, q = top(int(a[k])), top(int(b[k]))
        if p != q:
            up[q] = p
            out.append((int(xs[i[k]]), int(ys[j[k]])))
    return out


def joined(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of labels that pairs of a bucket make; buckets (key, v, items), labels (v, label), sets (v, shingles).

    Members of a bucket's largest component need not meet each other. The other members are hashed into blocks, all members
    into blocks too, and each block of the first meets each of the second in a group of its own, so no group grows.
    """
    spark = buckets.sparkSession
    bounded_batches(spark)
    here = buckets.select("key", "v", "items").join(labels, "v")
    parts = here.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("items").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(MEMBERS), w / F.lit(ITEMS))).cast("int")
    open_ = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w")).alias("top")).filter("kinds > 1")
    open_ = open_.select("key", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("_p"), blocks(F.col("n"), F.col("w")).alias("_q"))
    here = here.join(open_, "key").withColumn("x", F.col("label") != F.col("top"))
    p, q = (F.pmod(F.xxhash64("v", F.lit(side)), F.col(f"_{side}")).cast("int") for side in ("p", "q"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_y = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda i: pair(i, q))
    as_x = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda j: pair(p, j))
    here = here.withColumn("at", F.explode(F.when(F.col("x"), F.array_union(as_x, as_y)).otherwise(as_y)))
    here = here.select("key", "at.i", "at.j", "v", "label", (F.col("x") & (p == F.col("at.i"))).alias("is_x"), (q == F.col("at.j")).alias("is_y"))
    here = here.join(sets, "v").repartition(tasks(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def group() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            kinds = t.column("label").combine_chunks().dictionary_encode()
            is_x, is_y = (t.column(c).to_numpy() for c in ("is_x", "is_y"))
            found = links(kinds.indices.to_numpy().astype(np.int64), [np.frombuffer(s, U64) for s in t.column("shingles").to_pylist()], is_x, is_y, percent)
            if found:
                a, b = (t.column("label").combine_chunks().take(pa.array(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        last = None
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                name = own[:, a].tolist()
                if held and name != last:
                    yield from group()
                    held = []
                held.append(batch.slice(a, b - a))
                last = name
        if held:
            yield from group()

    return here.select("key", "i", "j", "label", "is_x", "is_y", "shingles").mapInArrow(run, "a binary, b binary")
