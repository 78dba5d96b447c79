"""Slow, plain versions of what the operators compute, for small frames."""

import math
import re
from collections import Counter


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def sku_ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def vectors(texts):
    """One unit vector per row; document frequencies count every row."""
    tokens = [Counter(re.findall(r"[^\W]{2,}", t.lower())) for t in texts]
    df = Counter(term for counts in tokens for term in counts)
    out = []
    for counts in tokens:
        raw = {t: c * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.append({t: w / norm for t, w in raw.items()})
    return out


def cosine(u, v):
    return round(sum(w * v[t] for t, w in u.items() if t in v), 9)


def row_pairs(rows, threshold, strict=False):
    """(row_i, row_j, combined) of all row pairs that reach the threshold."""
    vecs = vectors([r[2] or "" for r in rows])
    found = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            score = round(0.4 * sku_ratio(rows[i][1], rows[j][1]) + 0.6 * cosine(vecs[i], vecs[j]), 9)
            if score > threshold if strict else score >= threshold:
                found.add((rows[i][0], rows[j][0], score))
    return found


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def dbscan(points, threshold, least):
    """Published expansion algorithm over rows in order; -1 is noise."""
    n = len(points)
    unit = []
    for p in points:
        norm = math.sqrt(sum(x * x for x in p)) + 1e-8
        unit.append([x / norm for x in p])
    near = [
        [j for j in range(n) if round(sum(x * y for x, y in zip(unit[i], unit[j])), 9) >= threshold] for i in range(n)
    ]
    labels, cluster = [None] * n, 0
    for i in range(n):
        if labels[i] is not None or len(near[i]) < least:
            continue
        queue = [i]
        while queue:
            k = queue.pop()
            if labels[k] is not None:
                continue
            labels[k] = cluster
            if len(near[k]) >= least:
                queue.extend(near[k])
        cluster += 1
    return [-1 if label is None else label for label in labels]
