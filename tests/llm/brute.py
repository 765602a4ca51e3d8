"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows, size=35):
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each (doc_id, text)."""
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= {*range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, size=5):
    w = SPACE.findall(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(rows, size=5):
    """doc_id, n_shingles, component_id of each (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    has = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            has[x].append(i)
    shared = Counter()
    for group in has.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                shared[group[a], group[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        t = top(i)
        if key is not None:
            least[t] = min(least.get(t, key), key)
    return [(key, len(s), least.get(top(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def decontam(rows, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add(item)
    out = []
    for key, text in rows:
        w = word.findall(lower(text or ""))
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= {*range(i, i + k)}
                    ids |= found
        ids.discard(None)
        names = sorted(map(str, ids))
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
