"""Words of whole text columns, as numpy arrays over an Arrow batch's own bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so it never cuts a UTF-8 sequence. Null texts count as empty.
All functions work on a batch at a time; a batch holds whole documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm._store import bounded_batches

U64 = np.uint64
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters, digits and every byte of a longer UTF-8 sequence; other bytes part the terms of looser matches.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U64)
_STEP = U64(0x9E3779B97F4A7C15)
_STEP_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n of the step and of its inverse modulo 2**64; grown by doubling, kept by the process."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        tables = []
        for base in (_STEP, _STEP_INVERSE):
            x = np.full(size, base, U64)
            x[0] = 1
            tables.append(np.cumprod(x, dtype=U64))
        if size > 1 << 22:  # a very long batch: not kept
            return tables
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a batch. docs[i]:docs[i + 1] are the words of document i; start and end are byte offsets in data."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        up, down = _power_tables(len(self.data))
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def prefix_hashes(self, most: int) -> np.ndarray:
        """A hash of the first `most` bytes of each word."""
        return Words(self.data, self.bounds, self.start, np.minimum(self.end, self.start + most), self.docs).hashes()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and the bounds of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(texts: pa.Array, lower: bool = False, solid: np.ndarray = _IS_WORD) -> Words:
    """The words of each text; lower maps the letters A-Z to a-z first. solid tells the bytes of words from others."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(len(bounds), np.int64))
    solid = solid[data]
    edge = np.zeros(n + 1, bool)  # a document ends or begins here
    edge[bounds] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return Words(data, bounds, start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; len - n + 1 values, whatever document the words belong to."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out, width, block, size = None, 0, hashes, 1
    while True:  # blocks of 1, 2, 4 ... words make up n
        if n & size:
            if out is None:
                out, width = block, size
            else:
                m = len(hashes) - width - size + 1
                out, width = mix(out[:m] * _STEP + block[width : width + m]), width + size
        if width == n:
            return out[: len(hashes) - n + 1]
        block, size = mix(block[:-size] * U64(0xD6E8FEB86659FD93) + block[size:]), size * 2


def runs_of(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words begin:end, whatever its length."""
    up, down = _power_tables(len(hashes))
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + mix((end - begin).astype(U64)))


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts data[begin:end], which may overlap."""
    size = end - begin
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    taken = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(taken)).cast(pa.string())


def inside(words: Words, n: int) -> np.ndarray:
    """Which of the len - n + 1 windows of n words lie in one document."""
    if len(words) < n:
        return np.zeros(0, bool)
    doc = words.doc_of()
    return doc[: len(words) - n + 1] == doc[n - 1 :]


def parts(batch: pa.RecordBatch, column: str | int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each; a single longer text stays whole."""
    sizes = text_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def kept_text(words: Words, doc: int, keep: np.ndarray) -> bytes:
    """The kept words of a document, joined by one space; keep has a flag for each word of the batch."""
    a, b = words.docs[doc], words.docs[doc + 1]
    raw = words.data[words.bounds[doc] : words.bounds[doc + 1]].tobytes().split()
    return b" ".join([w for w, k in zip(raw, keep[a:b].tolist(), strict=True) if k])


def map_texts(df: DataFrame, each: Callable[[pa.Array], list[pa.Array]], fields: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row, and those that `each` makes of a slice's whole texts; `fields` is their DDL."""
    bounded_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[k] for k in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *each(part.column("_text"))], names=schema.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def filter_texts(df: DataFrame, stays: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The rows whose whole texts `stays` tells to keep, with all their columns."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text):
                yield part.filter(pa.array(stays(part.column(text)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
