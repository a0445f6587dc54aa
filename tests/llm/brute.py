"""Plain versions of the operators, written from the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    marks = {i: fingerprint(t) for i, t in docs}
    sets = Sets(marks)
    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(marks[a] ^ marks[b]).count("1") <= 4:
                sets.join(a, b)
    return {(i, f"{marks[i]:016x}", sets.find(i)) for i in ids}


def suffix_dedup(docs, span=50):
    seen, out = set(), set()
    for i, t in sorted(docs):
        b = (t or "").encode()
        hit, mine = bytearray(len(b)), set()
        for a in range(len(b) - span + 1):
            mine.add(b[a : a + span])
            if b[a : a + span] in seen:
                hit[a : a + span] = b"\1" * span
        seen |= mine
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.add((i, len(b), sum(hit), len(bytes(hit).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def window_dedup(docs, span=20):
    seen, out = set(), set()
    for i, t in sorted(docs):
        w = words(t)
        hit = [0] * len(w)
        for a in range(len(w) - span + 1):
            key = tuple(w[a : a + span])
            if key in seen:
                hit[a : a + span] = [1] * span
            seen.add(key)
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        out.add((i, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def nearest(rows, queries, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    out = set()
    for q, v in queries:
        if not usable(v):
            continue
        v = np.array(v, float)
        near = sorted((-float((v * x).sum()), i) for i, x in rows if i != q and len(x) == len(v))[:k]
        out |= {(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(near)}
    return out


def cosine_groups(rows, least=0.98):
    ids = [i for i, _, _ in rows]
    sets, links = Sets(ids), dict.fromkeys(ids, 0)
    good = [(i, np.array(v, float), c) for i, v, c in rows if usable(v) and c is not None]
    for n, (a, x, c) in enumerate(good):
        for b, y, e in good[n + 1 :]:
            if c == e and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                links[b] += 1
                sets.join(a, b)
    return {(i, links[i], sets.find(i), sets.find(i) == i) for i in ids}


def targets(sizes, repeats=3):
    """sizes: source -> words, sources in order."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def mix(docs, block=64, seed=6, repeats=3):
    """docs: (doc_id, text, source) rows; (row, size, taken) in their order, for sources of one shard."""
    size = [len(words(t)) for _, t, _ in docs]
    sizes: dict = {}
    for (_, _, s), n in zip(docs, size):
        sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes, repeats)
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    unit = max(1, min(block, int(min((t for t in target.values() if t > 0), default=0) // 16)))
    seats = sainte_lague([target[s] for s in order], int(sum(target.values()) / unit + 0.5))
    taken = [0] * len(docs)
    for s, n in zip(order, seats):
        rows = sorted((i for i, d in enumerate(docs) if d[2] == s), key=lambda i: (hashlib.md5(f"{seed}:{'' if docs[i][0] is None else docs[i][0]}".encode()).hexdigest(), docs[i][0] or 0))
        take = min(n * unit, repeats * sizes[s])
        rounds, rest = divmod(take, sizes[s]) if sizes[s] else (0, 0)
        for i in rows:
            taken[i] = rounds * size[i] + min(rest, size[i])
            rest -= min(rest, size[i])
    return list(zip(docs, size, taken))
