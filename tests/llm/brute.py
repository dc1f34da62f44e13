"""Slow and plain versions of the operators, for comparison."""

import bisect
import hashlib
import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np


def words(text):
    out, word = [], ""
    for ch in text or "":
        if ch.isalnum() or (ord(ch) > 0x2FF and unicodedata.category(ch)[0] == "M"):
            low = ch.lower()
            word += low if len(low) == 1 else ch
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar(rows, threshold=0.5):
    """Pairs of different (doc_id, set), as (doc_id, doc_id)."""
    sets = sorted({(d, frozenset(grams(t))) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0])
    out = []
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and len(s & t) >= threshold * len(s | t):
                out.append((a, b))
    return out


def classes(rows, threshold=0.5):
    """{(doc_id, class, links)} of documents that have a link."""
    pairs = similar(rows, threshold)
    links, owner = Counter(x for p in pairs for x in p), components(pairs)
    return {(d, owner[d], n) for d, n in links.items()}


def components(pairs):
    owner = {}

    def find(x):
        while owner.setdefault(x, x) != x:
            x = owner[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        owner[b] = a
    return {x: find(x) for x in list(owner)}


def copies(rows):
    by = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None:
            by[t].add(d)
    return {(d, min(ids)) for ids in by.values() for d in ids if d != min(ids)}


def leaks(text, items, window=8, least=4):
    """Items of which a run of ``window`` words, or all words of a shorter one, is in the text."""
    w, found = words(text), set()
    for item, content in items:
        v = words(content)
        n = min(window, len(v))
        if len(v) >= least and {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
            found.add(item)
    return found


def shards(keys, shards, vnodes, slack):
    """Keys one by one, each to the first point clockwise whose shard isn't full."""
    place = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
    ring = {}
    for s in range(shards):
        for v in range(vnodes):
            ring.setdefault(place(f"shard-{s}-{v}"), s)
    points = sorted(ring)
    bound = max(1, math.ceil((1 + slack) * len(keys) / shards))
    load, out = Counter(), []

    def order(k):
        h = hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()
        return int(h[16:22], 16) >> 19, bisect.bisect_left(points, int(h[:16], 16)) % len(points), int(h[16:22], 16), (k is not None, k or 0)

    for k in sorted(keys, key=order):
        i = order(k)[1]
        while load[ring[points[i]]] >= bound:
            i = (i + 1) % len(points)
        load[ring[points[i]]] += 1
        out.append((k, ring[points[i]]))
    return out


def language_model(corpus, docs, smooth=1.0):
    """(n, mean log chance, mean context) of each document by scanning the whole corpus for its longest contexts."""
    texts = [words(t) for t in corpus if t]
    count = Counter(w for t in texts for w in t)
    total = sum(count.values())
    out = []
    for doc in docs:
        w, lp, depth = words(doc), 0.0, 0
        for i, x in enumerate(w):
            single = (count[x] + 1) / (total + len(count) + 1)
            best, places = 0, []
            for t in texts:
                for j in range(1, len(t) + 1):
                    k = 0
                    while k < min(i, j) and t[j - 1 - k] == w[i - 1 - k]:
                        k += 1
                    if k and j < len(t):
                        if k > best:
                            best, places = k, []
                        if k == best:
                            places.append(t[j])
            lp += math.log((places.count(x) + smooth * single) / (len(places) + smooth)) if best else math.log(single)
            depth += best
        out.append((len(w), lp / len(w) if w else None, depth / len(w) if w else None))
    return out


def positions(rows, start=1.0, end=0.5, steps=256, bins=64, seed=17, budget=None, schedules=None):
    """(doc_id, epoch, position), document by document: rows are (doc_id, source, text)."""
    n = lambda t: max(1, (len((t or "").encode()) + 3) // 4)
    key = lambda d: int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
    tokens = Counter()
    hist = defaultdict(lambda: np.zeros(bins))
    for d, s, t in rows:
        tokens[s] += n(t)
        hist[s][int(key(d) / (2**32 / bins))] += n(t)
    total = sum(tokens.values())
    grid = np.linspace(0, 1, steps + 1)
    weights = {s: np.array([piecewise(schedules[s], t) for t in grid]) if s in (schedules or {}) else (v / total) ** (start + (end - start) * grid) for s, v in tokens.items()}
    every = sum(weights.values())
    out, wanted = [], {}
    for d, s, _ in rows:
        if s not in wanted:
            rate = np.array([w / e if e > 0 else 0.0 for w, e in zip(weights[s], every)])
            area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)]) / steps
            wanted[s] = area / area[-1] * tokens[s] if budget is None else area * (total if budget == "all" else budget)
        want, x = wanted[s], key(d) / (2**32 / bins)
        b = min(int(x), bins - 1)
        before = np.concatenate([[0], np.cumsum(hist[s])])
        asked, epoch = before[b] + (before[b + 1] - before[b]) * (x - b), 0
        while (budget is None and epoch == 0) or (budget is not None and asked < want[-1]):
            out.append((d, epoch, float(np.interp(asked, want, grid))))
            asked, epoch = asked + tokens[s], epoch + 1
    return out


def piecewise(points, t):
    points = sorted(points)
    if t <= points[0][0]:
        return points[0][1]
    for (a, x), (b, y) in zip(points, points[1:]):
        if t <= b:
            return x + (y - x) * (t - a) / (b - a)
    return points[-1][1]


def url_score(url, good, bad, order=5, smooth=2.0):
    def chance(corpus):
        c, f = Counter(), Counter()
        for u in corpus:
            x = "\n" * order + u
            for i in range(order, len(x)):
                for k in range(order + 1):
                    c[x[i - k : i], k] += 1
                    f[x[i - k : i + 1], k] += 1
        x, total = "\n" * order + url, 0.0
        for i in range(order, len(x)):
            p = 1 / 256
            for k in range(order + 1):
                p = (f[x[i - k : i + 1], k] + smooth * p) / (c[x[i - k : i], k] + smooth)
            total += math.log(p)
        return total

    return (chance(good) - chance(bad)) / max(1, len(url))


def language(text, model, dims=2048):
    """(family, language, margin) of one text by the weights of a fitted model, its n-grams counted one by one."""
    counts = np.zeros(dims)
    w = words(text)
    line = "".join(x + " " for x in w)
    for i in range(len(line)):
        h = 0
        for k in range(min(3, len(line) - i)):
            h = (h * 0x01000193 + ord(line[i + k]) * 0x9E3779B1 + k + 1) % 2**32
            counts[((h ^ h >> 15) * 0x85EBCA6B % 2**32 >> 21) % dims] += 1
    if not w:
        return None, None, 0.0
    x = np.sqrt(counts)
    x = np.append(x / np.linalg.norm(x), 1.0)
    scores = sorted(((float(x @ model["first"][f]), f) for f in model["kinds"]), reverse=True)
    (top, family), lead = scores[0], scores[0][0] - scores[1][0]
    votes, sums = Counter(), Counter()
    for a in model["langs"][family]:
        for b in model["langs"][family]:
            if (a, b) in model["pairs"]:
                m = float(x @ model["pairs"][a, b])
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
    best = min(model["langs"][family], key=lambda z: (-votes[z], -sums[z], z))
    return family, best, min(lead, sums[best])


def packed_block(ids, percentile=90):
    """One whole block, value by value: least value, width, number of exceptions, bit planes, places and values of exceptions."""
    low = min(ids)
    far = [x - low for x in ids]
    width = sorted(far)[math.ceil(len(ids) * percentile / 100) - 1].bit_length()
    odd = [(i, x) for i, x in enumerate(far) if x >= 2**width]
    kept = [0 if x >= 2**width else x for x in far]
    planes = b"".join(sum((kept[j] >> w & 1) << j for j in range(len(ids))).to_bytes(len(ids) // 8, "little") for w in range(width))
    return low.to_bytes(4, "little") + bytes([width, len(odd)]) + planes + bytes(i for i, _ in odd) + b"".join(x.to_bytes(4, "little") for _, x in odd)
