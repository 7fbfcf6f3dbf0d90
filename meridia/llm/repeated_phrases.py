"""Substring deduplication with repeated-phrase automata.

A passage recurs if a window of `window` words of it starts at two places or more, in any documents. Steps:

1. Each window elects its phrase of `phrase` words with the least hash, so equal windows elect equal phrases. Phrases that
   are elected at two places or more are candidates; all other windows can't recur.
2. Documents that hold a candidate are cut into pieces: the words of all windows that elected one occurrence of it. Equal
   pieces are counted once, with their number.
3. Pieces are sharded by their phrase, which all windows that may be equal share; any other words of a document can't hold a
   passage that recurs, so they need not stream. A shard counts its windows, which confirms the passages that recur; its automaton (Aho-Corasick over words) is compiled from these passages, laid out in
   windows, and all pieces of the shard stream through it, so every occurrence is located. Automata hold about `automaton_bytes` of pieces.
4. Located spans return to their documents and are united.

A phrase with more than `hot` different pieces is dealt to several shards, by the pieces' hashes. As equal windows may then
lie in different shards, the windows of such phrases are counted across the cluster, and each piece brings the places that
recur to its shard; passages, automata and streams are the same. No table is collected; what a task holds is a document, a
batch or a shard, whatever the number of a phrase's pieces.

Cases: null and empty texts have no words; a text of fewer words than a window loses none; rows are judged by what they hold,
so repeated rows recur in each other; ids may be null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._store import bounded_batches, discard, release, tasks, written
from meridia.llm._text import U64, Words, grams, inside, kept_text, map_texts, mix, parts, runs_of, slices, words_of

WINDOW, PHRASE = 35, 8
#: Different pieces of a phrase that one shard takes, and bytes of pieces in an automaton.
HOT, AUTOMATON = 10_000, 2_000_000


def elected(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elected phrases in order: their places, their hashes, and the first and last window that elected each.

    The least hash wins, the leftmost of equal ones. Windows lie in one document.
    """
    none = np.zeros(0, np.int64)
    n = len(words) - window + 1
    if n < 1:
        return none, np.zeros(0, U64), none, none
    value = grams(words.hashes(), phrase)
    place = np.arange(len(value))
    span, best, at = 1, value, place
    while span * 2 <= window - phrase + 1:
        worse = best[span:] < best[:-span]
        best, at = np.where(worse, best[span:], best[:-span]), np.where(worse, at[span:], at[:-span])
        span *= 2
    rest = window - phrase + 1 - span
    if rest:
        worse = best[rest:] < best[:-rest]
        at = np.where(worse, at[rest:], at[:-rest])
    doc = words.doc_of()
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    at = at[starts]
    if not len(at):
        return none, np.zeros(0, U64), none, none
    change = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(change[1:], len(at)) - 1
    return at[change], value[at[change]], starts[change], starts[last]


def _by_doc(words: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(places, words.docs)


def _candidates(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(row, phrases): of each document, the phrases that its windows elect, with repeats."""

    def each(texts: pa.Array) -> list[pa.Array]:
        words = words_of(texts)
        at, value, _, _ = elected(words, window, phrase)
        offsets = pa.array(_by_doc(words, at), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))]

    return map_texts(docs, each, "phrases array<bigint>", ["row"])


def _pieces(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, piece_id, row, doc_id, start, piece) of the documents' candidate phrases."""
    bounded_batches(docs.sparkSession)
    names = ["phrase", "piece_id", "row", "doc_id", "start", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text", 500_000):
                words = words_of(part.column("_text"))
                at, value, first, last = elected(words, window, phrase)
                wanted = part.column("wanted")
                flat, of = wanted.flatten().to_numpy().view(U64), np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
                doc = np.searchsorted(words.docs, at, "right") - 1
                step = U64(0x9E3779B97F4A7C15)
                use = np.isin(mix(value + doc.astype(U64) * step), mix(flat + of.astype(U64) * step))
                doc, value, first, last = doc[use], value[use], first[use], last[use] + window
                ids = runs_of(words.hashes(), first, last).view(np.int64)
                texts = slices(words.data, words.start[first], words.end[last - 1])
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids), part.column("row").take(rows), part.column("doc_id").take(rows), pa.array(first - words.docs[doc]), texts], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "wanted", "_text").mapInArrow(run, f"phrase bigint, piece_id bigint, row bigint, doc_id {kind}, start bigint, piece string")


def locate(pieces: pa.Array, counts: np.ndarray, window: int, known: pa.Array | None = None) -> pa.Array:
    """Of each piece, the spans of words where passages lie that recur; counts: how often a piece occurs.

    known: of each piece, the first words of windows that recur; where it is null, the pieces given here are counted.
    """
    import ahocorasick

    words = words_of(pieces)
    hashes, bounds = words.hashes(), words.docs
    at = np.flatnonzero(inside(words, window))
    doc = words.doc_of()
    if len(at):
        _, number = np.unique(grams(hashes, window)[at], return_inverse=True)
        recurs = np.bincount(number, counts[doc[at]])[number] >= 2
        if known is not None and known.null_count < len(known):
            told = known.is_valid().to_numpy(zero_copy_only=False)
            lists = known.fill_null([])
            places = np.zeros(len(words), bool)
            places[lists.flatten().to_numpy() + np.repeat(bounds[:-1], np.diff(lists.offsets.to_numpy()))] = True
            recurs = np.where(told[doc[at]], places[at], recurs)
        at = at[recurs]
    if not len(at):
        return _spans(np.zeros(len(bounds), np.int64), at, at)
    begins = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]))
    first = at[begins]
    last = at[np.append(np.flatnonzero(begins)[1:] - 1, len(at) - 1)] + window
    code = np.unique(hashes, return_inverse=True)[1].astype(np.uint32) + 2  # a character for each word of the shard
    code += np.where(code >= 0xD800, 0x800, 0).astype(np.uint32)
    if code.max() > 0x10FFFF:
        raise ValueError("an automaton has more words than characters; lower automaton_bytes")
    text = code.tobytes().decode("utf-32-le")
    # a passage is laid out in windows, end to end and the last one flush: so at most one pattern ends at a word
    tiles = (last - first + window - 1) // window
    before = np.cumsum(tiles) - tiles
    place = np.repeat(first, tiles) + window * (np.arange(tiles.sum()) - np.repeat(before, tiles))
    place = np.minimum(place, np.repeat(last, tiles) - window)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for pattern in {text[a : a + window] for a in place.tolist()}:
        automaton.add_word(pattern)
    automaton.make_automaton()
    # all pieces in a row, with a character between them that no passage has
    parted = np.insert(code, bounds[1:-1], 1).tobytes().decode("utf-32-le")
    m, ends = len(parted), automaton.iter(parted)
    change = np.zeros(m + 1, np.int64)
    while len(end := np.fromiter((e for e, _ in itertools.islice(ends, 200_000)), np.int64)):
        change += np.bincount(end + 1 - window, minlength=m + 1) - np.bincount(end + 1, minlength=m + 1)
    covered = np.cumsum(change)[:m] > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = bounds[:-1] + np.arange(len(bounds) - 1)
    piece = np.searchsorted(base, a, "right") - 1
    return _spans(np.searchsorted(piece, np.arange(len(bounds))), a - base[piece], b - base[piece])


def _spans(bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]))


def _located(shards: DataFrame, window: int, automaton_bytes: int) -> DataFrame:
    """(phrase, piece_id, spans) of pieces (phrase, part, piece_id, piece, n, known), in order of phrase and part, which lie together."""
    names = ["phrase", "piece_id", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(tables).combine_chunks()
            found = locate(t.column("piece").combine_chunks(), t.column("n").to_numpy(), window, t.column("known").combine_chunks())
            some = pa.compute.greater(pa.compute.list_value_length(found), 0)
            return pa.RecordBatch.from_arrays([t.column("phrase").combine_chunks(), t.column("piece_id").combine_chunks(), found], names=names).filter(some)

        held: list[pa.RecordBatch] = []
        size = 0
        for part in (p for batch in batches for p in parts(batch, "piece", automaton_bytes // 2)):
            if held and size >= automaton_bytes:  # a shard ends where a phrase or its part does
                last = held[-1].slice(held[-1].num_rows - 1)
                same = np.ones(part.num_rows, bool)
                for c in ("phrase", "part"):
                    same &= part.column(c).to_numpy() == last.column(c)[0].as_py()
                n = part.num_rows if same.all() else int(np.argmin(same))
                held.append(part.slice(0, n))
                if n < part.num_rows:
                    yield shard(held)
                    held, size = [], 0
                part = part.slice(n)
            if part.num_rows:
                held.append(part)
                size += part.nbytes
        if held:
            yield shard(held)

    return shards.mapInArrow(run, "phrase bigint, piece_id bigint, spans array<struct<a:bigint,b:bigint>>")


def _known(pieces: DataFrame, window: int) -> DataFrame:
    """(phrase, piece_id, known): of pieces (phrase, piece_id, piece, n), the first words of windows that recur in any of them."""

    def each(texts: pa.Array) -> list[pa.Array]:
        words = words_of(texts)
        x = grams(words.hashes(), window)
        at = np.flatnonzero(inside(words, window))
        first = np.searchsorted(at, words.docs)
        x, place = x[at], at - words.docs[:-1][words.doc_of()[at]]
        y = mix(x ^ U64(0xD6E8FEB86659FD93)) + grams(words.hashes() * U64(0x2545F4914F6CDD1D), window)[at]  # 64 bits more
        windows = pa.StructArray.from_arrays([pa.array(place), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["at", "x", "y"])
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), windows)]

    windows = map_texts(pieces, each, "windows array<struct<at:bigint,x:bigint,y:bigint>>", ["phrase", "piece_id", "n"], "piece")
    windows = written(windows.select("phrase", "piece_id", "n", F.inline("windows")), free=False)
    recurs = windows.groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 1").select("x", "y")
    return windows.join(recurs, ["x", "y"]).groupBy("phrase", "piece_id").agg(F.collect_list("at").alias("known"))


def removed_spans(docs: DataFrame, window: int, phrase: int, hot: int = HOT, automaton_bytes: int = AUTOMATON) -> DataFrame:
    """(row, doc_id, spans): of documents (row, doc_id, _text), the spans of words that lie in recurring windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sketch = written(_candidates(docs.withColumnRenamed("_text", "text"), window, phrase))
    uses = sketch.select("row", F.explode("phrases").alias("phrase"))
    twice = written(uses.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1").select("phrase"))
    wanted = uses.join(twice, "phrase").groupBy("row").agg(F.collect_set("phrase").alias("wanted"))
    pieces = written(_pieces(docs.join(wanted, "row"), window, phrase))
    discard(sketch, twice)
    kinds = written(pieces.groupBy("phrase", "piece_id", "piece").agg(F.count("*").alias("n")))
    many = written(kinds.groupBy("phrase").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("shards")).filter("shards > 1"))
    hot_kinds = kinds.join(many, "phrase")
    known = _known(hot_kinds.select("phrase", "piece_id", "piece", "n"), window)
    dealt = hot_kinds.withColumn("part", F.pmod(F.xxhash64("piece_id"), F.col("shards")).cast("int")).join(known, ["phrase", "piece_id"], "left")
    dealt = dealt.select("phrase", "part", "piece_id", "piece", "n", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"))
    cold = kinds.join(many, "phrase", "left_anti").select("phrase", F.lit(0).alias("part"), "piece_id", "piece", "n", F.lit(None).cast("array<bigint>").alias("known"))
    shards = cold.unionByName(dealt).repartition(tasks(spark), "phrase", "part").sortWithinPartitions("phrase", "part")
    located = written(_located(shards, window, automaton_bytes))
    discard(kinds)
    spans = pieces.select("phrase", "piece_id", "row", "doc_id", "start").join(located, ["phrase", "piece_id"])
    spans = spans.select("row", "doc_id", "start", F.inline("spans")).select("row", "doc_id", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("span"))
    spans = written(spans.groupBy("row", "doc_id").agg(F.collect_set("span").alias("spans")))
    discard(pieces, located)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, automaton_bytes: int = AUTOMATON, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept: the words outside recurring windows, joined by one space."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has at least one word and at most a window's")
    docs = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    spans = removed_spans(docs, window, phrase, hot, automaton_bytes)
    marked = docs.join(spans.withColumnRenamed("doc_id", "_id"), (docs["row"] == spans["row"]) & docs["doc_id"].eqNullSafe(F.col("_id")), "left").select("doc_id", "_text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                words = words_of(part.column("_text"))
                lists = part.column("spans")
                flat = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy())
                if lists.null_count:
                    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
                base = np.repeat(words.docs[:-1], sizes)
                a, b = (flat.field(i).to_numpy() + base if len(flat) else np.zeros(0, np.int64) for i in (0, 1))
                n = len(words)
                gone = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = np.diff(total[words.docs])
                keep = ~gone
                kept = [kept_text(words, d, keep) for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    release(docs.sparkSession)
    return marked.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def digest(kept: DataFrame) -> DataFrame:
    """The kept text as its SHA-256."""
    return kept.withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256)).drop("kept")

