"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def shingle_components(texts, size, percent):
    """Number of shingles and first linked text of each text."""
    sets = []
    for text in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    lists, links = collections.defaultdict(list), []
    for i, shingles in enumerate(sets):
        shared = collections.Counter(j for s in shingles for j in lists[s])
        links += [(j, i) for j, n in shared.items() if 100 * n >= percent * (len(shingles) + len(sets[j]) - n)]
        for s in shingles:
            lists[s].append(i)
    return [len(s) for s in sets], components(len(texts), links)


def window_removals(rows, length):
    """(words, removed, digest) of rows (doc_id, text) with different ids."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def byte_removals(texts, length):
    """(bytes, removed, spans, digest, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out
