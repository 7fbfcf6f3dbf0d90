"""Ranking metrics of scored pairs (q, t, s): ties go to the smaller t.

A query's rank is that of its first positive, counted from 1; if none is ranked, one more than the number of tiles. Queries
without a positive are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, matrix): blocks of at most `rows` unit vectors of (id, vec); vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                some = part.filter(part.column("vec").is_valid())
                if some.num_rows:
                    x = some.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("id"))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "matrix"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vec").mapInArrow(run, f"ids array<{kind}>, matrix binary")


def cosine_scores(queries: DataFrame, gallery: DataFrame, query_id: str = "q", tile_id: str = "t", vector: str = "vec", block: int = 2048) -> DataFrame:
    """(q, t, s): every query against every gallery vector, exactly. Null vectors are left out.

    The queries are the stated set. Both sides are packed into blocks of vectors; blocks meet as rows, and each pair of blocks
    is one product of matrices, so no row of numbers is joined and both sides stay distributed.
    """
    left = _packed(queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vec")), block)
    right = _packed(gallery.select(F.col(tile_id).alias("id"), F.col(vector).alias("vec")), block)
    pairs = right.select(F.col("ids").alias("t"), F.col("matrix").alias("b")).crossJoin(left.select(F.col("ids").alias("q"), F.col("matrix").alias("a")))
    kinds = [df.schema["ids"].dataType.elementType.simpleString() for df in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, t = (batch.column(c).slice(i, 1).flatten() for c in ("q", "t"))
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(n, -1) for c, n in (("a", len(q)), ("b", len(t))))
                s = a @ b.T
                yield pa.RecordBatch.from_arrays([q.take(pa.array(np.repeat(np.arange(len(q)), len(t)))), t.take(pa.array(np.tile(np.arange(len(t)), len(q)))), pa.array(s.ravel())], names=["q", "t", "s"])

    return pairs.mapInArrow(run, f"q {kinds[0]}, t {kinds[1]}, s double")


def _halves_away(x: np.ndarray) -> np.ndarray:
    whole = np.trunc(x)
    return (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)).astype(np.int64)


def _k_best(s: np.ndarray, enough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of s of at least enough[row]: all of them, or where these are many, those that are among the k best of their
    row, of equal ones the first."""
    x, y = np.divmod(np.flatnonzero(s >= enough[:, None]), s.shape[1])
    if len(x) > 4 * k * len(s):
        n = min(k, s.shape[1])
        key = _halves_away(s) * s.shape[1] - np.arange(s.shape[1])
        x, y = np.repeat(np.arange(len(s)), n), np.argpartition(~key, n - 1, axis=1)[:, :n].ravel()
        some = s[x, y] >= enough[x]
        x, y = x[some], y[some]
    return x, y


def cosine_top_k(queries: DataFrame, gallery: DataFrame, k: int, query_id: str = "q", tile_id: str = "t", vector: str = "vec", unit: float = 1e6, block: int = 2048) -> DataFrame:
    """(q, t, s, rank): the k best gallery vectors of each query besides the one of its own id, exactly; s is the score in whole
    parts of 1 / unit, halves away from zero, and ties go to the smaller t. A vector with a NaN is nobody's neighbour.

    Each task keeps the k best that it has met of every query, so what is shuffled is k rows a query and task, not all pairs. Of a
    further block it looks only at scores that reach the k-th of these, or the k-th of the block's own best in 128 columns.
    """
    left = _packed(queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vec")), block).withColumn("_n", F.monotonically_increasing_id())
    right = _packed(gallery.select(F.col(tile_id).alias("id"), F.col(vector).alias("vec")), block)
    pairs = right.select(F.col("ids").alias("t"), F.col("matrix").alias("b")).crossJoin(left.select("_n", F.col("ids").alias("q"), F.col("matrix").alias("a")))
    kinds = [df.schema["ids"].dataType.elementType.simpleString() for df in (left, right)]
    none, columns = -2 * unit, 128  # a score that no pair has

    def scored(q: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = a @ b.T
        s *= unit
        if np.isnan(a).any() or np.isnan(b).any():
            s[np.isnan(s)] = none
        if np.isin(q, t).any():
            s[q[:, None] == t[None, :]] = none
        return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, ...]] = {}  # by block of queries: their ids, scores and tiles of the best so far
        for batch in batches:
            for i in range(batch.num_rows):
                q, t = (batch.column(c).slice(i, 1).flatten() for c in ("q", "t"))
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(n, -1) for c, n in (("a", len(q)), ("b", len(t))))
                asked, ids = (x.to_numpy(zero_copy_only=False) for x in (q, t))
                order = np.argsort(ids, kind="stable")  # so an earlier place means a smaller id
                ids = ids[order]
                n = batch.column("_n")[i].as_py()
                if n not in found:
                    found[n] = asked.copy(), np.full((len(q), k), none, np.int64), np.full((len(q), k), ids[0], ids.dtype)
                _, best, tiles = found[n]
                s = scored(asked, ids, a, b[order])
                least = best[:, -1].astype(np.float64)
                if len(ids) >= 2 * columns > 2 * k:
                    tops = s[:, : len(ids) // columns * columns].reshape(len(s), -1, columns).max(axis=1)
                    least = np.maximum(least, _halves_away(np.partition(tops, columns - k, axis=1)[:, columns - k]))
                x, y = _k_best(s, np.maximum(least - 0.5, none * 0.75), k)
                rows = np.unique(x)
                of = np.concatenate([np.repeat(rows, k), x])
                value = np.concatenate([best[rows].ravel(), _halves_away(s[x, y])])
                tile = np.concatenate([tiles[rows].ravel(), ids[y]])
                place = np.lexsort((np.unique(tile, return_inverse=True)[1], -value, of))
                start = np.searchsorted(of[place], rows)
                place = place[(start[:, None] + np.arange(k)).ravel()]  # a row has its k before and at least one more
                best[rows], tiles[rows] = value[place].reshape(-1, k), tile[place].reshape(-1, k)
        for asked, best, tiles in found.values():
            x, y = np.nonzero(best > none)
            yield pa.RecordBatch.from_arrays([pa.array(asked[x]), pa.array(tiles[x, y]), pa.array(best[x, y])], names=["q", "t", "s"])

    return top_k(pairs.mapInArrow(run, f"q {kinds[0]}, t {kinds[1]}, s long"), k)


def best(queries: DataFrame, tiles: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], query_id: str = "q", tile_id: str = "t", block: int = 16384) -> DataFrame:
    """(q, s, t): each query's best tile of all tiles; ties go to the smaller t. Ids are integers.

    score gets the ids of some queries and of some tiles and gives their matrix of integers. Both sides are packed into blocks, and
    each pair of blocks keeps the best of every query, so the pairs aren't made as rows.
    """

    def packed(df: DataFrame, key: str, name: str, rows: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                    ids = np.sort(part.column("id").drop_null().to_numpy(zero_copy_only=False))
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary())], names=[name])

        return df.select(F.col(key).cast("long").alias("id")).mapInArrow(run, f"{name} binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                q, t = (np.frombuffer(x.as_buffer(), np.int64) for x in (a, b))
                s = score(q, t)
                first = s.argmax(axis=1)  # the first of equal ones, so the smallest id
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[np.arange(len(q)), first].astype(np.int64)), pa.array(t[first])], names=["q", "s", "t"])

    pairs = packed(tiles, tile_id, "b", block).crossJoin(packed(queries, query_id, "a", max(1, block // 32)))
    top = pairs.mapInArrow(run, "q long, s long, t long").groupBy("q").agg(F.max(F.struct("s", (-F.col("t")).alias("t"))).alias("m"))
    return top.select("q", "m.s", (-F.col("m.t")).alias("t"))


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("s").desc(), "t")
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the optimizer cuts each task's rows to k before the shuffle."""
    return ranked(scores).filter(F.col("rank") <= k)


def first_positive(scores: DataFrame, positive: Column, tiles: int) -> DataFrame:
    """(q, rank) of queries that have a positive in scores."""
    rows = ranked(scores.withColumn("_p", positive))
    return rows.groupBy("q").agg(F.max(F.col("_p").cast("int")).alias("_any"), F.coalesce(F.min(F.when(F.col("_p"), F.col("rank"))), F.lit(tiles + 1)).alias("rank")).filter("_any = 1").drop("_any")


def recall(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, the share of ranks up to each k, the median rank."""
    shares = [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"r{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *shares, F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def mutual_nearest(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs in which each is the other's best, in each group."""
    by = by or []
    best = lambda key, other: Window.partitionBy(*by, key).orderBy(F.col("s").desc(), other)
    rows = scores.withColumn("_f", F.row_number().over(best("q", "t"))).filter("_f = 1")
    back = scores.withColumn("_b", F.row_number().over(best("t", "q"))).filter("_b = 1").select(*by, "q", "t")
    return rows.drop("_f").join(back, [*by, "q", "t"])


def cheap_scores(scores: DataFrame, by: list[str], n_queries: int) -> DataFrame:
    """(by, chamfer, mnn) of each pair of token grids: the mean over query tokens of their best score, and the share of query
    tokens that have a mutual nearest one. scores: by, q, t, s; n_queries: tokens of a query."""
    best = Window.partitionBy(*by, "q").orderBy(F.col("s").desc(), "t")
    back = Window.partitionBy(*by, "t").orderBy(F.col("s").desc(), "q")
    rows = scores.withColumn("_f", F.row_number().over(best)).withColumn("_b", F.row_number().over(back)).filter("_f = 1")
    return rows.groupBy(*by).agg(F.avg("s").alias("chamfer"), (F.count(F.when(F.col("_b") == 1, 1)) / n_queries).alias("mnn"))


def patch_overlap(scores: DataFrame, by: list[str], n_queries: int, n_tiles: int, ratio: float = 0.9, trim: float = 0.1, unit: float = 1.0) -> DataFrame:
    """(by, n_matches, cq, cg, score) of each pair of token grids.

    Matches are mutual nearest neighbours whose second best score is at most ratio times the best (1.0: no such test). The
    score is their trimmed mean times sqrt(cq * cg), the shares of both grids' tokens that are matched; 0 without a match.
    scores: by, q, t, s, in parts of `unit`.
    """
    best, back = Window.partitionBy(*by, "q").orderBy(F.col("s").desc(), "t"), Window.partitionBy(*by, "t").orderBy(F.col("s").desc(), "q")
    rows = scores.withColumn("_f", F.row_number().over(best)).withColumn("_b", F.row_number().over(back)).withColumn("_next", F.lead("s").over(best))
    far = F.lit(True) if ratio >= 1 else F.col("_next").isNull() | (F.col("_next") <= ratio * F.greatest(F.col("s"), F.lit(1e-9 * unit)))
    rows = rows.filter("_f = 1").withColumn("_match", (F.col("_b") == 1) & far)
    found = rows.filter("_match").groupBy(*by).agg(F.count("*").alias("n_matches"), F.countDistinct("t").alias("_t"))
    mean = trimmed_mean(rows.filter("_match"), by, "s", trim)
    out = rows.select(*by).distinct().join(found, by, "left").join(mean, by, "left").fillna(0, ["n_matches", "_t"])
    cq, cg = F.col("n_matches") / n_queries, F.col("_t") / n_tiles
    score = F.coalesce(F.col("mean") / unit * F.sqrt(cq * cg), F.lit(0.0))
    return out.select(*by, "n_matches", cq.alias("cq"), cg.alias("cg"), score.alias("score"))


def ablations(levels: DataFrame) -> DataFrame:
    """(variant, n, r1, r5, r10, median_rank): how well three ways of joining levels rank the positives: `learned`, the sum
    weighted by beta; `mean`; and `max`. levels: q, t, level, s, beta, positive; a query's betas weigh every tile alike."""
    joined = levels.groupBy("q", "t").agg(F.bool_or("positive").alias("positive"), F.sum(F.col("s") * F.col("beta")).alias("learned"), F.sum("s").alias("mean"), F.max("s").alias("max"))
    rows = joined.unpivot(["q", "t", "positive"], ["learned", "mean", "max"], "variant", "s")
    order = Window.partitionBy("variant", "q").orderBy(F.col("s").desc(), "t")
    first = rows.withColumn("rank", F.row_number().over(order)).filter("positive").groupBy("variant", "q").agg(F.min("rank").alias("rank"))
    shares = [F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"r{k}") for k in (1, 5, 10)]
    return first.groupBy("variant").agg(F.count("*").alias("n"), *shares, F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def reciprocal_rank_fusion(scores: DataFrame, by: str, method: str, item: str, k: int = 60) -> DataFrame:
    """(by, item, score): the sum over methods of 1 / (k + rank + 1), rank from 0; methods without a positive score don't vote."""
    over = Window.partitionBy(by, method)
    live = scores.withColumn("_m", F.max("score").over(over)).filter("_m > 0")
    live = live.withColumn("_r", F.row_number().over(over.orderBy(F.col("score").desc(), item)) - 1)
    return live.groupBy(by, item).agg(F.sum(1 / (k + F.col("_r") + 1.0)).alias("score"))


def trimmed_mean(df: DataFrame, by: list[str], value: str, trim: float = 0.1) -> DataFrame:
    """The mean of each group without the least and largest floor(n * trim) values."""
    over = Window.partitionBy(*by)
    rows = df.withColumn("_r", F.row_number().over(over.orderBy(value))).withColumn("_n", F.count("*").over(over))
    cut = F.floor(F.col("_n") * trim)
    return rows.filter((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(value).alias("mean"))


def capped(candidates: DataFrame, query: str, group: str, per_group: int, budget: int, score: str = "s", item: str = "t") -> DataFrame:
    """At most per_group best of each query's group, and of these the budget best of each query."""
    inner = Window.partitionBy(query, group).orderBy(F.col(score).desc(), item)
    outer = Window.partitionBy(query).orderBy(F.col(score).desc(), item)
    rows = candidates.withColumn("_g", F.row_number().over(inner)).filter(F.col("_g") <= per_group)
    return rows.withColumn("place", F.row_number().over(outer)).filter(F.col("place") <= budget).drop("_g")


def greedy_capped(candidates: DataFrame, query: str, budget: int, per_position: int, per_cell: int, min_cells: int) -> DataFrame:
    """(query, item): the best candidates first, under caps.

    A candidate is barred while its position has per_position choices, and also while all its cells have per_cell choices and
    min_cells cells are in use. Both only grow, so what is barred stays barred, and the next choice is always the first
    candidate behind the last one that isn't. candidates: query, item, score, position, cells (an array); a candidate without
    cells counts as one whose cells are full. A query's candidates are one group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["score", "item"], ascending=[False, True], ignore_index=True)
        position = pd.factorize(best["position"])[0]
        sizes = best["cells"].map(len).to_numpy()
        flat = pd.factorize(best["cells"].explode().dropna())[0]
        at_position = np.zeros(position.max(initial=-1) + 1, np.int64)
        in_cell = np.zeros(flat.max(initial=-1) + 1, np.int64)
        begin = np.cumsum(sizes) - sizes
        chosen: list[int] = []
        while len(chosen) < budget:
            barred = at_position[position] >= per_position
            if (in_cell > 0).sum() >= min_cells:
                room = np.add.reduceat(np.append(in_cell[flat] < per_cell, False), begin) if len(begin) else begin
                barred |= np.where(sizes > 0, room, 0) == 0
            free = np.flatnonzero(~barred[chosen[-1] + 1 if chosen else 0 :])
            if not len(free):
                break
            chosen.append(int(free[0]) + (chosen[-1] + 1 if chosen else 0))
            at_position[position[chosen[-1]]] += 1
            np.add.at(in_cell, flat[begin[chosen[-1]] : begin[chosen[-1]] + sizes[chosen[-1]]], 1)
        return pd.DataFrame({query: best[query].iloc[chosen].to_numpy(), "item": best["item"].iloc[chosen].to_numpy()})

    return candidates.groupBy(query).applyInPandas(select, f"{query} {kinds[query]}, item {kinds['item']}")


def planned_batches(pairs: DataFrame, neighbours: DataFrame, shard: str, size: int, seed: int = 0) -> DataFrame:
    """(shard, batch, place, pair): batches of a seed pair, up to size // 2 - 1 of its neighbours, and rarest others.

    Seeds are the pairs that no batch has yet, by number. A batch is filled by taking the first of an order and striking out
    all that share its query or its tile, so neither stands twice: first the seed's neighbours in their order, then all
    pairs, the least used first and in random order among these. pairs: shard, pair, q, t. neighbours: pair, rank, nbr.
    Shards are planned apart, each from its own pairs; one seed gives the same batches again.
    """
    known = neighbours.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr"))).alias("near"))
    rows = pairs.join(known, "pair", "left").select(shard, "pair", "q", "t", F.transform("near", lambda x: x["nbr"]).alias("near"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.sort_values("pair", ignore_index=True)
        number = pd.Index(table["pair"])
        same = np.stack([pd.factorize(table[c])[0] for c in ("q", "t")])
        q, t = same.tolist()
        full = min(size, len(set(q)), len(set(t)))
        counts = [0 if x is None else len(x) for x in table["near"]]
        places = number.get_indexer(np.concatenate([x for x, n in zip(table["near"], counts, strict=True) if n])).tolist() if any(counts) else []
        ends = np.cumsum(counts).tolist()
        # pairs by how often they were used, and where each stands among its like
        random, uses, at, like = np.random.default_rng(seed), [0] * len(q), list(range(len(q))), [list(range(len(q)))]
        parts = []

        def swap(some: list[int], i: int, j: int) -> None:
            some[i], some[j] = some[j], some[i]
            at[some[i]], at[some[j]] = i, j

        for first in range(len(q)):
            if uses[first]:
                continue
            batch, has_q, has_t = [first], {q[first]}, {t[first]}

            def offer(i: int, batch: list[int] = batch, has_q: set[int] = has_q, has_t: set[int] = has_t) -> bool:
                free = i >= 0 and q[i] not in has_q and t[i] not in has_t
                if free:
                    batch.append(i)
                    has_q.add(q[i])
                    has_t.add(t[i])
                return free

            for i in places[ends[first] - counts[first] : ends[first]]:
                if len(batch) < max(1, size // 2):
                    offer(i)
            for some in like:  # drawn without putting back, so a batch that fills up early looks at few
                left, missed = len(some), 0
                while left and len(batch) < full and missed < 64:
                    left -= 1
                    swap(some, int(random.integers(left + 1)), left)
                    missed += not offer(some[left])
                if left and len(batch) < full:  # few are free: all the rest at once
                    rest = random.permutation(some[:left])
                    rest = rest[~(np.isin(same[0][rest], list(has_q)) | np.isin(same[1][rest], list(has_t)))]
                    while len(rest) and len(batch) < full:
                        offer(int(rest[0]))
                        rest = rest[(same[:, rest] != same[:, rest[:1]]).all(axis=0)]
            for i in batch:
                some = like[uses[i]]
                swap(some, at[i], len(some) - 1)
                some.pop()
                uses[i] += 1
                if uses[i] == len(like):
                    like.append([])
                at[i] = len(like[uses[i]])
                like[uses[i]].append(i)
            parts.append(batch)
        sizes = [len(b) for b in parts]
        return pd.DataFrame({shard: pdf[shard].iloc[0], "batch": np.repeat(np.arange(len(parts)), sizes), "place": np.concatenate([np.arange(n) for n in sizes]), "pair": number.to_numpy()[np.concatenate(parts)]})

    return rows.groupBy(shard).applyInPandas(plan, f"{shard} {kinds[shard]}, batch long, place long, pair long")
