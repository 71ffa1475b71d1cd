"""Plain restatements of the corpus operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, p, q):
    """Per row (doc_id, text): (doc_id, set size, smallest doc_id reachable by links)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in seen.get(g, ()))
        for j, n in shared.items():
            if q * n >= p * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            seen.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def dedup(rows, window=3):
    """Per row (doc_id, text): (doc_id, text left, lines, lines removed)."""
    last = lambda d: (d is None, d or 0)
    kinds = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (last(r[0]), r[1]))
    seen, out = {}, {}
    for place in range(2):  # first note the first place of each window, then cut
        for d, t in sorted(kinds, key=lambda r: last(r[0])):
            lines = t.split("\n")
            gone = set()
            for i in range(len(lines) - window + 1):
                w = tuple(lines[i : i + window])
                if not any(x.strip(" \t\x0b\x0c\r") for x in w):
                    continue
                if place == 0:
                    seen.setdefault(w, (d, t, i))
                elif seen[w] != (d, t, i):
                    gone |= set(range(i, i + window))
            out[d, t] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [(d, *out[d, t]) if t is not None else (d, None, 0, 0) for d, t in rows]


def mix_targets(sizes, weights, cap=3):
    """source -> target by repeated sharing of what lies above the cap."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sources if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(cap * sizes[s]) for s in over}


def sainte_lague(votes, seats):
    """Quotas by handing out one seat at a time (ties to the earlier row)."""
    quota = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))
        quota[best] += 1
    return quota


def rules_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
