"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib

SPACE = b" \t\n\r\x0b\x0c"


def words(text):
    return (text or "").encode().split()


def substring_dedup(rows, span=20):
    """rows: (doc_id, text), distinct ids -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, gone = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        out = gone.setdefault(d, set())
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            if k in seen:
                out.update(range(i, i + span))
            seen.add(k)
    res = {}
    for d, t in rows:
        w = words(t)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone[d])
        res[d] = (len(w), len(gone[d]), hashlib.sha256(kept).hexdigest())
    return res


def byte_dedup(rows, span=100):
    """rows: (doc_id, text), distinct ids -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, gone = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - span + 1):
            k = hashlib.blake2b(b[i : i + span], digest_size=12).digest()
            if k in seen:
                mask[i : i + span] = b"\x01" * span
            seen.add(k)
        gone[d] = mask
    res = {}
    for d, t in rows:
        b, m = (t or "").encode(), gone[d]
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        res[d] = (len(b), sum(m), spans, hashlib.sha256(kept).hexdigest())
    return res


def shingles(text, k=5):
    t = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_join(rows):
    """rows: (doc_id, text), distinct ids -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in rows}
    index, links = {}, []
    for d in sorted(sets):
        counts = {}
        for s in sets[d]:
            for o in index.setdefault(s, []):
                counts[o] = counts.get(o, 0) + 1
            index[s].append(d)
        links += [(o, d) for o, c in counts.items() if 100 * c >= 75 * (len(sets[o]) + len(sets[d]) - c)]
    comp = components(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in sets}
