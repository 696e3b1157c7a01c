"""Slow and plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_groups(docs, width, similarity=80):
    """docs: (id, text) -> {id: (n, component)}"""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                i0, j0 = root(i), root(j)
                up[max(i0, j0)] = min(i0, j0)
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(docs, items, width):
    """docs: (id, text), items: (id, text) -> list of (id, n_words, n_hit, item names)"""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            wanted[tuple(w[s:s + width])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for s in range(len(w) - n + 1):
                if (got := wanted.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    names |= got
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return out


def exact_groups(docs):
    """docs: (id, text) -> sorted (id, keep_id, size, hex)"""
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    for (i, _), t in zip(docs, norm):
        groups[t].append(i)
    first = {t: min((i is None, i or 0) for i in g) for t, g in groups.items()}
    return [(i, None if first[t][0] else first[t][1], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(docs, norm)]


def remove_repeats(texts, width):
    """-> list of (n_bytes, spans, kept bytes)"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if seen[d[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        out.append((len(d), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(d, gone) if not g)))
    return out


def shards(rows, limit):
    """rows: (name, address of 60 bits as a string, bytes) -> {name: prefix}"""
    def split(rows, depth):
        if sum(r[2] for r in rows) <= limit or len({r[1] for r in rows}) == 1:
            return {r[0]: rows[0][1][:depth] for r in rows}
        out = {}
        for bit in "01":
            if half := [r for r in rows if r[1][depth] == bit]:
                out |= split(half, depth + 1)
        return out

    return split(rows, 0) if rows else {}
