"""Brute-force versions that several tests share."""

import math
import re

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (id, text) or (id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """With extra columns that have the names operators use inside."""
    names = "_gone _key _doc _terms _entities _removed key sha size lane node rank rep part count _row_ tokens grams prior wanted"
    return df.selectExpr("*", *(f"1 AS `{n}`" for n in names.split()))


def word_triples(text):
    w = re.findall(r"[A-Za-z0-9]+|[^\x00-\x7f]+", "") if not text else re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text.lower())
    if not w:
        return set()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def near_groups(docs, threshold=0.5):
    """{doc_id: smallest id of its group} for documents that have an earlier near-duplicate."""
    sets = {d: word_triples(t) for d, t in docs}
    ids = [d for d in sorted(sets) if sets[d]]
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            both = len(x & y)
            if both >= threshold * (len(x) + len(y) - both):
                pairs.append((a, b))
    return {d: r for d, r in union_find(pairs).items() if d != r}


def trigrams(text):
    """Folded byte trigrams that hold a letter and no double space."""
    raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").lower().encode())
    out = []
    for i in range(len(raw) - 2):
        a, b, c = raw[i : i + 3]
        if b != 32 or (a != 32 and c != 32):
            out.append(((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 16)
    return out


def languages(rows, evidence=100, pull=10.0, unknown=1e-3, confidence=0.5, smoothing=0.1, cells=1 << 16):
    """{index: language or und} of (text, lang, host[, suffix, declared]) rows, fitted on all of them: the fusion in plain loops."""
    names = sorted({r[1] for r in rows if r[1] is not None and r[0] is not None})
    counts = {n: np.full(cells, smoothing) for n in names}
    grams = [trigrams(r[0]) for r in rows]
    for g, r in zip(grams, rows):
        if r[1] in counts and r[0] is not None:
            np.add.at(counts[r[1]], g, 1)
    model = {n: np.log(c / c.sum()) for n, c in counts.items()}
    text, alone = [], []
    for g in grams:
        s = np.array([model[n][g].sum() if g else 0.0 for n in names]) * min(1, evidence / max(1, len(g)))
        e = np.exp(s - s.max())
        text.append(s)
        alone.append(e / e.sum() if g else np.zeros(len(names)))
    total = sum(alone)
    overall = (total + 1) / (sum(1 for g in grams if g) + len(names))
    none = np.zeros(len(names))
    key = lambda r, k: r[k] if len(r) > k else None
    sums = {k: {} for k in (2, 3, 4)}
    for g, a, r in zip(grams, alone, rows):
        for k, of in sums.items():
            if g and key(r, k) is not None:
                of[r[k]] = of.get(r[k], 0) + a
    out = {}

    def smoothed(k, r, a, above):
        left = np.maximum(sums[k].get(r[k], none) - a, 0) if key(r, k) is not None else none
        return (left + pull * above) / (left.sum() + pull)

    for i, (g, s, a, r) in enumerate(zip(grams, text, alone, rows)):
        prior = smoothed(2, r, a, smoothed(3, r, a, overall))
        if key(r, 4) is not None:
            said = sum(sums[4].values(), none)
            s = s + np.log((np.maximum(sums[4].get(r[4], none) - a, 0) + 1) / (np.maximum(said - a, 0) + 1 + len(sums[4])))
        scores = np.append(s + np.log(prior), -min(len(g), evidence) * math.log(cells) + math.log(unknown))
        p = np.exp(scores - scores.max())
        p = (p / p.sum())[:-1]
        out[i] = names[int(p.argmax())] if g and p.max() >= confidence else "und"
    return out


def packed(sizes, window):
    """Placements (window, offset) of pieces by the sum-of-squares rule, every level tried in turn."""
    levels, queues, opened, out = [0] * (window + 1), [[] for _ in range(window + 1)], 0, []
    for size in sizes:
        if size == window:
            out.append((opened, 0))
            opened += 1
            continue

        def squares(level):
            n = list(levels)
            if level:
                n[level] -= 1
            if level + size < window:
                n[level + size] += 1
            return sum(x * x for x in n[1:window])

        options = [lv for lv in range(window - size + 1) if lv == 0 or levels[lv]]
        best = min(options, key=lambda lv: (squares(lv), -lv))
        if best:
            levels[best] -= 1
            w = queues[best].pop(0)
        else:
            w, opened = opened, opened + 1
        if best + size < window:
            levels[best + size] += 1
            queues[best + size].append(w)
        out.append((w, best))
    return out
