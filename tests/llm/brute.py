"""Plain versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def removed(rows, window):
    """(id, words, removed, SHA-256 of what is left), for each row."""
    all_ = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in all_ for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, all_, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def linked(rows, n, percent=80):
    """id -> (size of its set, least id that links reach); ids are different."""
    sets = {k: shingles(t, n) for k, t in rows}
    has = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            has[g].append(k)
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, s in sets.items():
        shared = Counter(j for g in s for j in has[g] if j < k)
        for j, m in shared.items():
            if 100 * m >= percent * (len(s) + len(sets[j]) - m):
                a, b = sorted((top(k), top(j)))
                up[b] = a
    return {k: (len(sets[k]), top(k)) for k in sets}


def repeats(text, least):
    w = words(text)
    n = len(w)
    long = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                long[i] = max(long[i], k)
    three = {x for i, k in enumerate(long) if k >= 3 for x in range(i, i + 3)}
    covered = {x for i, k in enumerate(long) if k >= least for x in range(i, i + k)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": lines,
        "n_repeat_words": len(three),
        "n_covered_words": len(covered),
        "longest_repeat": max((k for k in long if k >= least), default=0),
    }


def odd_texts(seed, n=60):
    """Empty, null, one-word, repetitive and unusual texts, and random ones of few words."""
    import random

    rng = random.Random(seed)
    fixed = [None, "", "   \n\t", "a", "A a A a A a A a A a", "x\ny\nx\n\n \nx ", "é#\né#\nq", " no break ", "tab\tand\x0bvt\x0cff\r", "x" * 5000, "日本 語 " * 30]
    for _ in range(n):
        k = rng.choice([2, 4, 12, 60])
        fixed.append("".join(f"{rng.choice('Ab')}{rng.randrange(k)}" + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(0, 120))))
    return fixed
