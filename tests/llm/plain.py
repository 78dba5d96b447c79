"""Plain versions of the text operators for small tables."""

from collections import Counter


def bag(text, k=5):
    words = (text or "").encode().split()
    if len(words) < k:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def weighted_jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def components(nodes, links):
    """Smallest node reachable from every node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def near_duplicates(texts, least=0.8):
    """{doc_id: class} of {doc_id: text}."""
    bags = {d: bag(t) for d, t in texts.items()}
    sizes = {d: sum(b.values()) for d, b in bags.items()}
    ids = sorted(bags)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if min(sizes[a], sizes[b]) >= least * max(sizes[a], sizes[b]) and weighted_jaccard(bags[a], bags[b]) >= least
    ]
    return components(ids, links)


def repeats(texts, span=50):
    """{doc_id: (bytes, removed flags)} of {doc_id: text}."""
    first = {}
    for d in sorted(texts):
        data = (texts[d] or "").encode()
        for p in range(len(data) - span + 1):
            first.setdefault(data[p : p + span], d)
    out = {}
    for d, text in texts.items():
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - span + 1):
            if first[data[p : p + span]] < d:
                gone[p : p + span] = [True] * span
        out[d] = (data, gone)
    return out


def repeats_digest(texts):
    """{doc_id: (bytes, removed, spans, sha256 of what stays)}."""
    import hashlib

    out = {}
    for d, (data, gone) in repeats(texts).items():
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
