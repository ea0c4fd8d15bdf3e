"""Plain Python versions of the operators, word by word, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def repeated_windows(rows, size):
    """[(n_words, n_removed, sha)] in the order of rows (id, text)."""
    texts = [words(t) for _, t in rows]
    count = collections.Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w) - size + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_groups(rows, size, percent):
    """{id: (n_shingles, component)} of rows (id, text)."""
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text, w = text or "", words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = [False] * len(w)
    for k in range(len(w) - 4):
        if count[tuple(w[k : k + 5])] > 1:
            covered[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, sum(covered)


def kneser_ney(texts, order=5):
    """([mean nats of each text's n-grams or None], [the sums over all bytes of some contexts' probabilities])."""
    # a text is its words with one blank before each
    spelled = [b"".join(b" " + w.encode() for w in words(t)) for t in texts]
    grams = [[x[k : k + order] for k in range(len(x) - order + 1)] for x in spelled]
    return _scored(grams, order)


def _scored(grams, order):
    level = collections.Counter(g for x in grams for g in x)
    levels = [level]
    while len(levels) < order:
        level = collections.Counter(g[1:] for g in level)
        levels.append(level)

    def model(n):
        count = levels[order - n]
        few = collections.Counter(count.values())
        n1, n2, n3, n4 = (few[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), k * 0.95) for k, x in enumerate(d, 1)]
        total, left = collections.Counter(), collections.Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        below, unseen = model(n - 1) if n > 1 else (lambda g: 1 / 256, lambda g: 1 / 256)

        def p(g):
            context = g[:-1]
            if not total[context]:
                return below(g[1:])
            c = count[g]
            return (c - d[min(c, 3) - 1] if c else 0) / total[context] + left[context] / total[context] * below(g[1:])

        def q(g):
            if n < order and count[g] > 1:
                return p(g)
            share = left[g[:-1]] / total[g[:-1]] if total[g[:-1]] > count[g] else 1
            return share * unseen(g[1:])

        return p, q

    p, q = model(order)
    seen = sorted(levels[0])[:: max(len(levels[0]) // 20, 1)]
    sums = [sum(p(g[:-1] + bytes([b])) for b in range(256)) for g in [*seen, b"qqqqq"]]
    nats = lambda x, own: -sum(n * math.log((p if levels[0][g] > n else q)(g)) for g, n in own.items()) / len(x)
    return [nats(x, collections.Counter(x)) if x else None for x in grams], sums
