"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return SPACE.findall(text or "")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def shingles(text, k):
    words = space_words((text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(docs, k, p, q):
    """[(id, text)] to {id: (set size, smallest id of the component)}."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_licenses(text):
    words, found = alnum_words(text), []
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def contaminated(text, items, window=10):
    """(words, hit words, items found) against [(item_id, text)]."""
    words, hit, found = alnum_words(text), set(), set()
    for item, other in items:
        w = alnum_words(other)
        n = min(len(w), window)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{source: words} to {source: target}, resharing what is above a cap until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def mixed(docs, seed="mix-1"):
    """[(id, source, text)] (ids distinct) to copies of each id in the mix."""
    size = {i: len(space_words(t)) for i, _, t in docs}
    by = defaultdict(list)
    for i, s, _ in docs:
        by[s].append(i)
    sums = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    goal, out = targets(sums), Counter()
    for s, ids in by.items():
        epochs, before = int(goal[s]) // sums[s] if sums[s] else 0, 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()):
            part = max(0, min(size[i], int(goal[s]) - epochs * sums[s] - before))
            out[i] += epochs + (1 if size[i] and 2 * part >= size[i] else 0)
            before += size[i]
    return Counter({i: n for i, n in out.items() if n})
