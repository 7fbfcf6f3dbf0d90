"""Token ids in binary shards, compressed by Re-Pair.

Documents are put in ascending order of their id by a range shuffle; a task encodes its range, appends the end id to each
document and cuts shards of about `shard_ids` ids. In a shard, rounds of Re-Pair count the pairs of neighbouring symbols
and replace the most frequent ones by nonterminals, from left to right, until no pair is frequent or symbols run out:
a symbol takes 16 bits if the vocabulary leaves room for rules in them, else 32, of which rules use as many more as
SYMBOLS. Pairs never reach over the end of a document.

A shard file: a line of JSON (version, counts, the first id and the number of rules of each round, where sections lie);
rules (two symbols each), the length of each rule's expansion, the symbols, for every STRIDE-th symbol the number of ids
before it, and of each document its id and its number of ids. decode_range() decodes a few ids from the nearest mark.

A file's name is unique to the attempt that wrote it; only files of attempts that ended are in the manifest, which is
written before anything reads it, so lost executors leave no trace.

Cases: null and empty texts have the end id alone; a null id comes first; repeated rows are documents of their own, in an
order of their own among equal ids; an empty table has no shard and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm._store import bounded_batches, file_system, put, tasks, written
from meridia.llm._text import U64, Words, parts, text_bytes

SYMBOLS, STRIDE = 1 << 16, 1024
#: How often a pair must occur to be replaced, at how many places a rule saves more than its own 8 bytes, and pairs of a round.
FREQUENT, PAYS, LEAST = 16, 5, 512
#: Pieces of text whose ids a worker remembers; it forgets all when they are more.
REMEMBERED = 2_000_000
CELL_BITS = 20
#: Bytes that begin white space other than the six characters of SPACES.
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _other_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space other than 0x20 and 0x09-0x0D begins: U+001C-1F, 85, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    at = np.flatnonzero(_ODD[data])
    if not len(at):
        return at
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[(a < 0x20) | two | general | three]


class Encoder:
    """Ids of whole texts under a byte-level BPE tokenizer.

    Such a tokenizer splits before a single space between two other characters, so the ids of a text are those of its
    pieces between such spaces. A batch's pieces are told apart by a 64-bit hash and their length, each is encoded once, and
    a worker remembers what it has encoded. Texts with other white space than ASCII's are one piece each.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        pre = told["pre_tokenizer"] or {}
        self.split = told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [x["content"].encode() for x in told["added_tokens"]]
        line = self._encode(["\n"])[0]
        self.joint = line[0] if self.split and len(line) == 1 else None  # the id of a line end, between pieces
        self.forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> None:
        """Encodes new pieces; plain ones are encoded as lines of one text."""
        ok = plain.tolist()
        joined = [p for p, k in zip(pieces, ok, strict=True) if k]
        sizes = np.zeros(len(pieces), np.int64)
        parts_ = [np.zeros(0, np.uint32)]
        for i in range(0, len(joined), 1000):
            flat = np.array(self._encode([b"\n".join(joined[i : i + 1000]).decode()])[0], np.uint32)
            parts_.append(np.append(flat, np.uint32(self.joint)))
        flat = np.concatenate(parts_)
        ends = np.flatnonzero(flat == self.joint) if self.joint is not None else np.zeros(0, np.int64)
        sizes[plain] = np.diff(np.concatenate([[-1], ends])) - 1
        rest = self._encode([p.decode() for p, k in zip(pieces, ok, strict=True) if not k])
        sizes[~plain] = [len(x) for x in rest]
        at = np.repeat(plain, sizes)
        new = np.empty(int(sizes.sum()), np.uint32)
        new[at] = np.delete(flat, ends)
        new[~at] = np.fromiter((i for x in rest for i in x), np.uint32)
        place = np.searchsorted(self.hashes, hashes)
        self.slots = np.insert(self.slots, place, len(self.bounds) - 1 + np.arange(len(hashes)))
        self.hashes = np.insert(self.hashes, place, hashes)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, new])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.hashes) > REMEMBERED:
            self.forget()
        data, bounds = text_bytes(texts)
        n, filled = len(data), np.diff(bounds) > 0
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        cut = np.zeros(n, bool)
        if self.split:
            cut[1:-1] = (data[1:-1] == 0x20) & ~space[:-2] & ~space[2:]
            for d in np.unique(np.searchsorted(bounds, _other_spaces(data), "right") - 1):
                cut[bounds[d] : bounds[d + 1]] = False
            cut[bounds[1:-1][bounds[1:-1] > 0] - 1] = False  # a space that ends a text
        cut[bounds[:-1][filled]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        hashes, first, inverse = np.unique(Words(data, bounds, start, end, bounds).hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            raw, of = data.tobytes(), first[new]
            spaces = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
            np.cumsum(space, out=spaces[1:])
            a, b = start[of], end[of]
            # no white space but perhaps one leading 0x20 before something else
            plain = (spaces[b] == spaces[a + 1]) & ((data[a] == 0x20) & (b > a + 1) | ~space[a])
            pieces = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            if self.joint is None:
                plain[:] = False
            elif any(x in raw for x in self.special):
                plain &= [not any(x in p for x in self.special) for p in pieces]
            self._learn(hashes[new], pieces, plain)
        slot = self.slots[np.searchsorted(self.hashes, hashes)][inverse]
        begin, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(start, bounds)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def symbol_type(first: int) -> type:
    """The type of symbols where rules begin at `first`."""
    if first > 1 << 30:
        raise ValueError("a vocabulary has at most 2**30 ids")
    return np.uint16 if first + LEAST <= SYMBOLS else np.uint32


def _cells(pairs: np.ndarray) -> np.ndarray:
    kind, bits = pairs.dtype.type, 8 * pairs.dtype.itemsize
    return (pairs * kind(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> kind(bits - CELL_BITS)


def compress(ids: np.ndarray, counts: np.ndarray, first: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols, rules (two symbols each) and the number of rules after each round. Symbols from `first` are rules.

    Rounds go on until no pair occurs `frequent` times or symbols run out. A round counts all pairs exactly and gives the
    most frequent ones up to half of the free symbols, LEAST at least, so that symbols are left for the pairs of its rules.
    A pair of which others in the round leave fewer than PAYS places, or whose cell of the lookup is taken, waits for the
    next one; as non-overlapping places are at least half of all, each round makes a rule. Only pairs with a symbol of the
    last round can have become frequent, so a round looks at these alone unless pairs wait.
    """
    kind = symbol_type(first)
    if len(ids) and int(ids.max()) >= first:
        raise ValueError("an id isn't in the vocabulary")
    limit = SYMBOLS if kind is np.uint16 else first + SYMBOLS
    wide = np.uint32 if kind is np.uint16 else np.uint64  # a pair of symbols
    shift = wide(8 * np.dtype(kind).itemsize)
    seq = ids.astype(wide)
    last = np.zeros(len(seq), bool)  # the end of a document
    last[np.cumsum(counts)[counts > 0] - 1] = True
    none = wide(np.iinfo(wide).max)  # no pair: the last symbol is free while there are rounds
    rules, after, made, pays = [], [], 0, max(1, min(PAYS, frequent // 2))
    rule_of, taken = np.zeros(1 << CELL_BITS, np.int32), np.zeros(1 << CELL_BITS, bool)
    where = None  # the places to look at, or all
    while (free := limit - first - made) > 0 and len(seq) > 1:
        if where is None:
            keys = (seq[:-1] << shift) | seq[1:]
            keys[last[:-1]] = none
        else:
            keys = (seq[where] << shift) | seq[where + 1]
        ranked = np.sort(keys)
        ranked = ranked[: np.searchsorted(ranked, none)]
        same = np.flatnonzero(ranked[frequent - 1 :] == ranked[: max(0, len(ranked) - frequent + 1)])
        if not len(same):
            break
        begin = np.flatnonzero(np.concatenate([[True], ranked[same[1:]] != ranked[same[:-1]]]))
        waiting = len(begin)
        pairs, n = ranked[same[begin]], np.diff(np.append(begin, len(same)))
        most = min(free, max(free // 2, LEAST))
        if most < len(pairs):
            chosen = np.argpartition(-n, most - 1)[:most]
            pairs, n = pairs[chosen], n[chosen]
        pairs = pairs[np.argsort(n, kind="stable")]  # of pairs with one cell the most frequent one has it
        cell = _cells(pairs)
        rule_of[cell], taken[cell] = np.arange(len(pairs)), True
        cells = _cells(keys)
        at = np.flatnonzero(taken[cells])
        rule = rule_of[cells[at]]
        taken[cell] = False
        same = pairs[rule] == keys[at]
        at, rule = at[same], rule[same]
        if where is not None:
            at = where[at]
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - run) % 2 == 0  # of overlapping pairs, every other one from the left
        at, rule = at[chosen], rule[chosen]
        kept = np.bincount(rule, minlength=len(pairs)) >= pays
        at, rule, pairs = at[kept[rule]], (np.cumsum(kept) - 1)[rule[kept[rule]]], pairs[kept]
        seq[at] = first + made + rule
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        where = None
        if len(pairs) == waiting:
            new = seq >= first + made
            where = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        rules.append(np.stack([(pairs >> shift).astype(kind), (pairs & wide(np.iinfo(kind).max)).astype(kind)], axis=1))
        made += len(pairs)
        after.append(made)
    return seq.astype(kind), np.concatenate(rules) if rules else np.zeros((0, 2), kind), after


def expand(seq: np.ndarray, rules: np.ndarray, after: list[int], first: int) -> np.ndarray:
    """The ids that symbols stand for; the rules of the last round go first."""
    out = seq.astype(np.uint32)
    for begin in reversed([0, *after[:-1]] if after else []):
        at = np.flatnonzero(out >= first + begin)
        pair = rules[out[at] - first]
        second = at + np.arange(1, len(at) + 1)
        stay = np.ones(len(out) + len(at), bool)
        stay[second] = False
        longer = np.empty(len(stay), np.uint32)
        longer[stay] = out
        longer[second - 1], longer[second] = pair[:, 0], pair[:, 1]
        out = longer
    return out


def lengths(rules: np.ndarray, after: list[int], first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.ones(first + len(rules), np.uint32)
    for begin, end in zip([0, *after], after, strict=False):
        out[first + begin : first + end] = out[rules[begin:end, 0]] + out[rules[begin:end, 1]]
    return out[first:]


def shard_bytes(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, first: int) -> list[bytes]:
    seq, rules, after = compress(ids, counts, first)
    size = np.concatenate([np.ones(first, np.uint32), lengths(rules, after, first)])
    before = np.zeros(len(seq), np.int64)
    np.cumsum(size[seq[:-1]], out=before[1:]) if len(seq) else None
    sections = {"rules": rules, "expands": size[first:], "symbols": seq, "marks": before[::STRIDE], "doc_ids": doc_ids.astype("<i8"), "valid": valid.astype(np.uint8), "counts": counts.astype("<i8")}
    head, at = {"version": 2, "first_rule": first, "rounds": after, "n_ids": len(ids), "sections": {}}, 0
    for name, x in sections.items():
        head["sections"][name] = [at, x.nbytes, x.dtype.str]
        at += x.nbytes
    return [json.dumps(head).encode() + b"\n", *[np.ascontiguousarray(x).tobytes() for x in sections.values()]]


class Shard:
    """A shard file, with its sections read as they are asked for."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        head = b""
        while b"\n" not in head:
            head += self.file.read(4096)
        self.offset = head.index(b"\n") + 1
        self.head = json.loads(head[: self.offset])

    def section(self, name: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        at, size, kind = self.head["sections"][name]
        width = np.dtype(kind).itemsize
        end = size // width if end is None else min(end, size // width)
        self.file.seek(self.offset + at + begin * width)
        x = np.frombuffer(self.file.read((end - begin) * width), kind)
        return x.reshape(-1, 2) if name == "rules" else x

    def ids(self) -> np.ndarray:
        return expand(self.section("symbols"), self.section("rules"), self.head["rounds"], self.head["first_rule"])

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """ids()[start:stop], from the symbols that hold them."""
        marks = self.section("marks")
        a = max(0, int(np.searchsorted(marks, start, "right")) - 1)
        b = int(np.searchsorted(marks, stop, "left"))
        if not len(marks) or stop <= start:
            return np.zeros(0, np.uint32)
        ids = expand(self.section("symbols", a * STRIDE, b * STRIDE), self.section("rules"), self.head["rounds"], self.head["first_rule"])
        return ids[start - int(marks[a]) : stop - int(marks[a])]

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_ids: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest: (task, number, path, n_docs, n_ids, n_bytes)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(tasks(spark), "_id").sortWithinPartitions("_id")
    schema = T.StructType.fromDDL("task int, number int, path string, n_docs bigint, n_ids bigint, n_bytes bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        first = encode.tokenizer.get_vocab_size()
        held, n, number = [], 0, 0

        def shard() -> pa.RecordBatch:
            ids, counts, doc_ids, valid = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/ids-{task:06d}-{number:06d}-{uuid.uuid4().hex}.repair"
            size = put(path, shard_bytes(ids, counts, doc_ids, valid, first))
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([path]), pa.array([len(counts)]), pa.array([len(ids)]), pa.array([size])], names=schema.names)

        for batch in batches:
            for part in parts(batch, "_text", 2_000_000):
                ids, counts = encode(part.column("_text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                keys = part.column("_id")
                held.append((ids, counts + 1, keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)))
                n += len(ids)
                if n >= shard_ids:
                    yield shard()
                    held, n, number = [], 0, number + 1
        if held:
            yield shard()

    return written(rows.mapInArrow(run, schema))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path): a row for each document, from the files. start: ids of all before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).repartition(tasks(spark), "path")
    schema = T.StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                ids, counts = shard.ids().astype("<u4"), shard.section("counts")
                doc_ids = pa.array(shard.section("doc_ids"), mask=shard.section("valid") == 0)
                shard.close()
                bounds = np.concatenate([[0], np.cumsum(counts)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + bounds[:-1]), pa.array(counts), pa.array(crcs, pa.int64()), pa.array([path] * len(counts), pa.string())], names=schema.names)

    return placed.mapInArrow(run, schema)
