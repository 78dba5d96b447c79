"""Near duplicates of texts and vectors, and repeated bytes, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from partatlas.llm import bagminhash, embeddings, suffix
from partatlas.llm.common import WordHashes, hashed_words

DOCS = "doc_id long, text string, rep long, rows long, comp long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, 7, 7, 7) for d, t in rows], DOCS)


def _words(rng, n, vocabulary=5000):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def _edited(rng, words, edits):
    words = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"e{rng.integers(0, 10**9)}"
    return words


def test_signature_estimates_weighted_jaccard():
    rng, known, off = np.random.default_rng(5), WordHashes(), []
    for _ in range(60):
        times = rng.integers(1, 25, 4)
        a = " ".join(f"a{k} b{k} c{k} d{k} e{k} " * int(t) for k, t in enumerate(times))
        b = " ".join(f"a{k} b{k} c{k} d{k} e{k} " * int(t) for k, t in enumerate(np.maximum(times + rng.integers(-4, 5, 4), 1)))
        hashes, offsets = bagminhash.shingle_hashes(*hashed_words([a.encode(), b.encode()], known))
        signature = bagminhash.bag_signatures(hashes, offsets)
        true = plain.weighted_jaccard(plain.bag(a), plain.bag(b))
        off.append((signature[0] == signature[1]).mean() - true)
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.05


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(bagminhash, "CELL_ROWS", 3)
        monkeypatch.setattr(bagminhash, "LEADER_PAIRS", 2)
    rng = np.random.default_rng(8)
    texts = {}
    for base in range(6):
        words = _words(rng, 120)
        for k in range(8):
            texts[len(texts) * 3 + 1] = " ".join(_edited(rng, words, int(rng.integers(0, 4))))
    texts |= {500: texts[1], 501: " " + texts[1].replace(" ", "\n"), 502: "", 503: "  ", 504: "one two", 505: "one two", 506: "one  two three"}
    got = {r.doc_id: (r.component_id, r.kept) for r in bagminhash.near_duplicates(_docs(spark, texts.items())).collect()}
    want = plain.near_duplicates(texts)
    assert got == {d: (c, c == d) for d, c in want.items()}


@pytest.mark.parametrize("text_rows", [256, 5])
def test_open_buckets_give_no_more_links_than_connect_them(spark, monkeypatch, text_rows):
    monkeypatch.setattr(bagminhash, "TEXT_ROWS", text_rows)
    rng = np.random.default_rng(3)
    words = _words(rng, 200)
    docs = _docs(spark, [(k, " ".join(_edited(rng, words, 1))) for k in range(40)]).cache()
    groups = bagminhash.signed(docs).withColumnRenamed("doc_id", "rep").cache()
    apart = bagminhash._buckets(groups).withColumn("comp", F.col("rep"))
    links = [(r.src, r.dst) for r in bagminhash._open_links(apart, groups.select("rep", "sketch", "bands"), docs, 0.8).collect()]
    by_bucket = sum(r.rows - 1 for r in apart.select("key", "rows").distinct().collect())
    assert text_rows < 40 or len(links) <= min(by_bucket, 40 * 39 / 4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(plain.weighted_jaccard(plain.bag(texts[a]), plain.bag(texts[b])) >= 0.8 for a, b in links)
    of = {k: k for k in texts}
    for a, b in links:
        low, high = sorted((of[a], of[b]))
        of = {k: low if c == high else c for k, c in of.items()}
    assert of == plain.near_duplicates(texts)


def test_near_duplicates_of_nulls_and_repeats(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "x y z"), (3, "x y z"), (4, "x  y z")]
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in bagminhash.near_duplicates(_docs(spark, rows)).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert bagminhash.near_duplicates(_docs(spark, rows).limit(0)).collect() == []


def _brute_vectors(rows):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (label, np.array(v, dtype=np.float64))
    n, links = dict.fromkeys((i for i, _, _ in rows if i is not None), 0), []
    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    links.append((a, b))
    comp = plain.components(list(n), links)
    return sorted((i, n[i], comp[i], comp[i] == i) for i in n)


@pytest.mark.parametrize("tile", [4, 256])
def test_vector_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(16)
        for _ in range(9):
            v = base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    rows += [(900 + k, rows[0][1], rows[0][2]) for k in range(20)]
    rows += [(950, [0.0] * 16, 0), (951, None, 0), (952, [None] * 16, 0), (953, [float("nan")] * 16, 0), (954, [1.0, 2.0], 0), (955, [1.0, 2.0], 0)]
    rows += [(956, [float("inf")] * 16, 1), (957, rows[0][1], None), (958, [], 1), (959, [2 * x for x in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, n int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.vector_links(df).collect())
    assert got == _brute_vectors(rows)
    assert embeddings.vector_links(df.limit(0)).collect() == []


def test_vector_without_id(spark):
    df = spark.createDataFrame([(None, [1.0], 1), (None, None, None), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id or -1, r.kept) for r in embeddings.vector_links(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 0, -1, True), (1, 0, 1, True)]


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 400), np.full(200, 97), np.tile(rng.integers(97, 99, 7), 60)]).astype(np.uint8)
    starts = rng.permutation(len(data) - suffix.SPAN)
    hashed = suffix.Polynomial(data)
    order = suffix.suffix_order(data, hashed, starts)
    cut = [data[s : s + suffix.SPAN].tobytes() for s in starts[order]]
    assert cut == sorted(cut) and sorted(order) == list(range(len(starts)))
    same = suffix.common_extension(hashed, starts[order[:-1]], starts[order[1:]])
    for n, a, b in zip(same, cut, cut[1:]):
        assert a[:n] == b[:n] and (n == suffix.SPAN or a[n] != b[n])


@pytest.mark.parametrize("limits", [(20_000, 5_000), (5, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(suffix, "CHUNK", limits[0])
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", limits[1])
    rng = np.random.default_rng(4)
    passage = " ".join(_words(rng, 25))
    texts = {}
    for d in rng.permutation(40):
        own = " ".join(_words(rng, int(rng.integers(0, 60))))
        cut = int(rng.integers(0, 60))
        texts[int(d)] = own[: len(own) // 2] + passage[cut : cut + int(rng.integers(0, 200))] + own[len(own) // 2 :]
    texts |= {100: "a" * 300, 101: "a" * 170 + "b", 102: "ab" * 200, 103: "x" + "ab" * 90, 104: None, 105: "", 106: "é" * 80, 107: "ü" + "é" * 60}
    texts |= {200: texts[3], 201: texts[3]}
    got = {
        r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), __import__("hashlib").sha256(r.kept).hexdigest())
        for r in suffix.remove_repeats(_docs(spark, texts.items())).collect()
    }
    assert got == plain.repeats_digest(texts)


def test_repeats_of_equal_ids_and_nulls(spark):
    long = "".join(chr(97 + (k * k) % 26) for k in range(120))
    rows = [(1, long), (1, long), (1, long + "z"), (None, long), (2, long), (2, "q" + long)]
    got = sorted((r.doc_id or -1, r.n_bytes, len(r.kept)) for r in suffix.remove_repeats(_docs(spark, rows)).collect())
    assert got == [(-1, 120, 120), (1, 120, 120), (1, 120, 120), (1, 121, 121), (2, 120, 0), (2, 121, 1)]
    assert suffix.remove_repeats(_docs(spark, rows).limit(0)).collect() == []


def test_windows_stay_bounded_as_tables_grow():
    # vectors that share a prefix with one in a random direction, and the chance to miss a pair
    agree = 1 - np.arccos(embeddings.COSINE) / np.pi
    shared = []
    for rows in (200, 50_000, 200_000, 800_000, 3_200_000, 10**9):
        prefix, passes = embeddings.resolution(rows)
        assert (1 - agree**prefix) ** passes <= embeddings.MISSED
        shared.append(rows / 2**prefix)
    assert max(shared) <= embeddings.TILE and embeddings.resolution(200_000) == (10, 14)


def test_long_prefixes_find_planted_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PREFIX", 14)  # as for some millions of vectors
    monkeypatch.setattr(embeddings, "TILE", 4)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.13 * np.linalg.norm(base[:60], axis=1, keepdims=True) / 4
    points = np.concatenate([base, near])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    links = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98)) if i < j}
    frame = spark.createDataFrame([(k, p.tolist(), 1) for k, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.vector_links(frame).collect()}
    component = plain.components(range(len(points)), links)
    assert len(links) > 30
    assert got == {k: (sum(k in e for e in links), component[k]) for k in range(len(points))}
