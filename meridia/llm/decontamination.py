"""Benchmark decontamination by greedy string tiling.

Terms are lower-cased runs of letters and digits. Documents join the test items on hashes of shared runs of `least` terms,
the seeds. For a document and an item that share seeds, the longest run of equal terms that no tile has marked yet, in
both, becomes a tile, and so on until none of `least` terms is left: running Karp-Rabin hashes over the unmarked terms of
the item and of the document's seeds propose runs, at falling lengths, and the terms themselves confirm them. Tiles may stand in any order, so reordered passages
are caught. A document is contaminated by an item if the tiles cover at least `share` of the item's terms.

The items are the stated query set: they are read in blocks of at most BLOCK terms, and each block, of which the size is so
bounded, is sent to all tasks and meets all documents.

Cases: null and empty texts match nothing; items of fewer than `least` terms match nothing; a term that repeats may belong
to one tile only; repeated items are items of their own; without documents or items there are no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm._store import bounded_batches
from meridia.llm._text import TERM, U64, Words, filter_texts, grams, inside, parts, words_of

LEAST, SHARE = 5, 0.8
#: Terms of the items that are sent at once, and bits of the table that rules most of a document's runs out.
BLOCK, BITS = 1_000_000, 22
#: The first length of matches that is searched, and base and modulus of running hashes.
FIRST, BASE, PRIME = 20, 0x9E3779B97F4A7, (1 << 61) - 1


@dataclass
class Items:
    """A block of test items, with the seeds in the order of their hashes."""

    ids: list
    terms: list[list[bytes]]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[(self.hashes >> U64(64 - BITS)).astype(np.int64)] = True
        return out


def _terms(words: Words, doc: int) -> list[bytes]:
    return [words.word(i) for i in range(words.docs[doc], words.docs[doc + 1])]


def index(ids: list, texts: pa.Array, least: int) -> Items:
    words = words_of(texts, lower=True, solid=TERM)
    at = np.flatnonzero(inside(words, least))
    hashes = grams(words.hashes(), least)[at]
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    item = words.doc_of()[at] if len(at) else np.zeros(0, np.int64)
    return Items(ids, [_terms(words, d) for d in range(len(ids))], hashes, item, at - words.docs[item])


def blocks(items: DataFrame, item_id: str, text: str, least: int, most: int = BLOCK) -> Iterator[Items]:
    """The items in blocks of at most `most` terms; an item with more is a block of its own."""
    ids, texts, n = [], [], 0
    for row in items.select(F.col(item_id), F.col(text)).orderBy(item_id, text).toLocalIterator():
        size = len((row[1] or "").encode()) // 2 + 1  # terms at most
        if ids and n + size > most:
            yield index(ids, pa.array(texts, pa.string()), least)
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += size
    if ids:
        yield index(ids, pa.array(texts, pa.string()), least)


class _Hashes:
    """Running Karp-Rabin hashes of a row of terms' numbers."""

    def __init__(self, codes: list[int]) -> None:
        self.upto = [0]
        for c in codes:
            self.upto.append((self.upto[-1] * BASE + c + 2) % PRIME)

    def windows(self, free: list[bool], length: int) -> Iterator[tuple[int, int]]:
        """(place, hash) of each window whose terms are all free."""
        top, run = pow(BASE, length, PRIME), 0
        for i, ok in enumerate(free):
            run = run + 1 if ok else 0
            if run >= length:
                yield i + 1 - length, (self.upto[i + 1] - self.upto[i + 1 - length] * top) % PRIME


def tiles(item: list[bytes], doc: Words, offset: int, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, terms), longest first; ties go to the first in the document.

    seeds: (place in the document, place in the item) of equal hashes; every common run of `least` terms consists of seeds, so
    only terms that seeds cover are searched. A pass hashes all windows of some length that have no marked term; equal ones
    are confirmed and grown to the longest match. If one is over twice as long, the pass is begun again at its length; else
    the matches wait in a queue by their length, where one that has lost terms to a tile is cut. Then the length is halved,
    down to `least`.
    """
    places = sorted({d + k for d, _ in seeds for k in range(least)})
    number = {t: n for n, t in enumerate(dict.fromkeys(item))}
    item_codes = [number[t] for t in item]
    doc_codes, at = [], []  # runs of covered places, with a term of no item between them
    for p in places:
        if at and p != at[-1] + 1:
            doc_codes.append(-1)
            at.append(at[-1] + 1)
        doc_codes.append(number.get(doc.word(offset + p), -1))
        at.append(p)
    item_free, doc_free = [True] * len(item), [c >= 0 for c in doc_codes]
    item_hashes, doc_hashes = _Hashes(item_codes), _Hashes(doc_codes)

    def fits(d: int, i: int) -> bool:
        return 0 <= d < len(doc_codes) and 0 <= i < len(item) and doc_free[d] and item_free[i] and doc_codes[d] == item_codes[i]

    def found(length: int) -> list[tuple[int, int, int]]:
        """(-terms, place in the document, place in the item) of the longest matches of at least so many terms."""
        have = defaultdict(list)
        for i, h in item_hashes.windows(item_free, length):
            have[h].append(i)
        out = []
        for d, h in doc_hashes.windows(doc_free, length):
            for i in have.get(h, ()):
                if fits(d - 1, i - 1):
                    continue  # it began earlier
                k = 0
                while fits(d + k, i + k):
                    k += 1
                if k >= length:
                    out.append((-k, d, i))
        return out

    out, length = [], max(least, FIRST)
    while True:
        waiting = found(length)
        if waiting and -min(waiting)[0] > 2 * length:
            length = -min(waiting)[0]
            continue
        heapq.heapify(waiting)
        while waiting:
            size, d, i = heapq.heappop(waiting)
            free = [doc_free[d + k] and item_free[i + k] for k in range(-size)]
            if all(free):
                out.append((i, at[d], -size))
                doc_free[d : d - size] = item_free[i : i - size] = [False] * -size
                continue
            begin = 0
            for k in range(-size + 1):  # what is left of it
                if k == -size or not free[k]:
                    if k - begin >= length:
                        heapq.heappush(waiting, (begin - k, d + begin, i + begin))
                    begin = k + 1
        if length == least:
            return out
        length = max(least, length // 2)


def matches(texts: pa.Array, items: Items, table: np.ndarray, least: int, share: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]], int]]:
    """(row, item, tiles, covered terms) of the documents and items whose tiles cover enough."""
    words = words_of(texts, lower=True, solid=TERM)
    hashes = grams(words.hashes(), least)
    at = np.flatnonzero(inside(words, least) & table[(hashes >> U64(64 - BITS)).astype(np.int64)]) if len(hashes) else np.zeros(0, np.int64)
    low, high = np.searchsorted(items.hashes, hashes[at]), np.searchsorted(items.hashes, hashes[at], "right")
    some = high > low
    at, low, high = at[some], low[some], high[some]
    doc = np.searchsorted(words.docs, at, "right") - 1
    for d in np.unique(doc):
        shared = defaultdict(list)
        for p, a, b in zip(*(x[doc == d].tolist() for x in (at, low, high)), strict=True):
            for k in range(a, b):
                shared[int(items.item[k])].append((p - int(words.docs[d]), int(items.place[k])))
        for item, seeds in sorted(shared.items()):
            n = len(items.terms[item])
            reach = {i + k for _, i in seeds for k in range(least)}
            if len(reach) < share * n:
                continue
            found = tiles(items.terms[item], words, int(words.docs[d]), seeds, least)
            covered = sum(x[2] for x in found)
            if covered >= share * n:
                yield int(d), item, found, covered


FIELDS = "item_words bigint, covered_words bigint, coverage double, n_tiles bigint, longest_tile bigint, tiles array<struct<item_at:bigint,doc_at:bigint,n_words:bigint>>"


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage and tiles) of each document and item that contaminates it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType)]
    schema = T.StructType(ids + T.StructType.fromDDL(FIELDS).fields)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, text, least):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            items_, shape = sent.value, to_arrow_schema(schema)
            table = items_.table()
            for batch in batches:
                for part in parts(batch, "_text"):
                    got = []
                    for d, i, found, covered in matches(part.column("_text"), items_, table, least, share):
                        n = len(items_.terms[i])
                        spans = [{"item_at": a, "doc_at": b, "n_words": k} for a, b, k in found]
                        got.append((part.column("doc_id")[d].as_py(), items_.ids[i], n, covered, covered / n, len(found), max(x[2] for x in found), spans))
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got, strict=True), shape, strict=True)], schema=shape)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    spark = docs.sparkSession
    for block in blocks(items, item_id, text, least):
        sent = spark.sparkContext.broadcast(block)

        def stays(texts: pa.Array, sent=sent) -> np.ndarray:
            out = np.ones(len(texts), bool)
            for d, _, _, _ in matches(texts, sent.value, sent.value.table(), least, share):
                out[d] = False
            return out

        docs = filter_texts(docs, stays, text)
    return docs
