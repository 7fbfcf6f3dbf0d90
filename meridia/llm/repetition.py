"""Quality rules, with repetition measured by suffix arrays.

For each document a suffix array over its words is built by prefix doubling (a whole batch at once; only suffixes that are
not yet told apart are sorted again), and longest common prefixes of neighbours follow from the ranks of each doubling.
The longest repeat that starts at a word is the longer of its two common prefixes; repeats that can't be extended to the
left are the maximal ones. Their spans, of at least `least` words, are united. A document is kept if they cover at most
`covered` of its words and none is longer than `longest` words.

Cases: null and empty texts have no words, fail the base rules and aren't kept; a word may belong to overlapping repeats
and is covered once; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridia.llm._text import U64, Words, map_texts, mix, words_of

LEAST, COVERED, LONGEST = 5, 0.3, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(word: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each word, how many words the longest repeat that starts there has; 0 or 1 may both stand for less than 2.

    word: numbers of equal words, from 0. docs: bounds of the documents. Repeats lie in one document and may overlap.
    """
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    stop = docs[1:][doc]  # the end of the suffix
    key = doc * np.int64(word.max() + 1) + word
    order = np.argsort(key, kind="stable")
    ranks, step = [], 1

    def first_of_group(changed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in the suffix array of the first of each one's group; at: places of the sorted ones."""
        return np.maximum.accumulate(np.where(changed, at, 0))

    sorted_keys = key[order]
    changed = np.ones(n, bool)
    changed[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = first_of_group(changed, np.arange(n))
    ranks.append(rank)
    while True:
        starts = changed
        alone = starts & np.append(starts[1:], True)
        at = np.flatnonzero(~alone)  # places whose suffixes aren't told apart yet
        if not len(at):
            break
        who = order[at]
        ahead = who + step
        second = np.where(ahead < stop[who], ranks[-1][np.minimum(ahead, n - 1)], -1)
        group = ranks[-1][who]
        again = np.lexsort((second, group))
        who, second, group = who[again], second[again], group[again]
        order[at] = who
        new = np.ones(len(at), bool)
        new[1:] = (second[1:] != second[:-1]) | (group[1:] != group[:-1])
        changed = np.ones(n, bool)
        changed[at] = new
        rank = ranks[-1].copy()
        rank[who] = first_of_group(new, at)
        ranks.append(rank)
        step *= 2
    if len(ranks) < 2:
        return out
    pair = np.flatnonzero(ranks[1][order[1:]] == ranks[1][order[:-1]]) if len(ranks) > 1 else np.zeros(0, np.int64)
    a, b = order[pair], order[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < stop[a]) & (y < stop[b])
        ok &= ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)]
        common += np.where(ok, 1 << level, 0)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _cover(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _repeated_lines(words: Words) -> np.ndarray:
    """Of each document, the lines with a word that equal an earlier line."""
    n, docs = len(words.data), len(words.bounds) - 1
    if not n:
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(words.data == 0x0A)
    start = np.unique(np.concatenate([words.bounds[:-1], breaks + 1]))
    start = start[start < n]
    end = np.append(start[1:], n)
    end = np.where(words.data[end - 1] == 0x0A, end - 1, end)
    doc = np.searchsorted(words.bounds, start, "right") - 1
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    line = Words(words.data, words.bounds, start, end, np.zeros(0, np.int64)).hashes()
    line, doc = line[has], doc[has]
    _, first = np.unique(mix(line + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[first], minlength=docs)


def measure(texts: pa.Array, least: int = LEAST) -> dict[str, np.ndarray]:
    """The figures of each whole text."""
    words = words_of(texts)
    n = len(words)
    lead = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=lead[1:])  # bytes that begin a code point
    chars = np.zeros(n + 1, np.int64)
    np.cumsum(lead[words.end] - lead[words.start], out=chars[1:])
    number = np.unique(words.hashes(), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    repeat = longest_repeats(number, words.docs)
    at = np.flatnonzero(repeat >= 3)
    long = np.flatnonzero(repeat >= least)
    left = np.ones(n, bool)  # a repeat that a longer one to the left contains isn't maximal
    if n:
        left[1:] = repeat[1:] + 1 != repeat[:-1]
        left[words.docs[:-1][words.counts > 0]] = True
    most = np.zeros(len(words.docs) - 1, np.int64)
    np.maximum.at(most, words.doc_of()[long], repeat[long])
    return {
        "n_words": words.counts,
        "word_chars": np.diff(chars[words.docs]),
        "n_symbols": _per_doc(_SYMBOL[words.data], words.bounds),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": _per_doc(_cover(at, np.full(len(at), 3), n), words.docs),
        "n_covered_words": _per_doc(_cover(long, repeat[long], n), words.docs),
        "longest_repeat": most,
        "n_maximal_repeats": _per_doc(left & (repeat >= least), words.docs),
    }


def rules(docs: DataFrame, least: int = LEAST, covered: float = COVERED, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's figures, base_failed and kept."""

    def each(texts: pa.Array) -> list[pa.Array]:
        x = measure(texts, least)
        failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        kept = ~failed & (x["n_covered_words"] <= covered * x["n_words"]) & (x["longest_repeat"] <= longest)
        return [*[pa.array(v.astype(np.int64)) for v in x.values()], pa.array(failed), pa.array(kept)]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal_repeats")
    return map_texts(docs, each, ", ".join(f"{x} bigint" for x in names) + ", base_failed boolean, kept boolean", [doc_id], text)
