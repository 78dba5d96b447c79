"""Source divergence, language identification and collocations against plain versions."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from check_queries import compare, connect
from partatlas.llm import collocations, divergence, langid

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, term string, place int, score string, split int, id int"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, g, s, 5, "x", 5, "x", 5, 5) for d, t, g, s in rows], DOCS)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op11_divergence", "op13_collocations"])
def test_query_equals_sql(spark, name):
    matches, *_, difference = compare(
        spark, connect(SF_DIR), name, driver.queries()[name], driver.oracle_sql()[name], SF_DIR
    )
    assert matches, difference


def _corpus(rng, docs):
    """Rows with few words, hard characters, nulls and repeated rows."""
    vocabulary = ["Of", "the", "Ärger", "ärger", "x1y", "Zed-zed", "déjà", "new", "york", "city", "\x00a", "日本", "b c"]
    rows = []
    for k in range(docs):
        words = rng.choice(vocabulary, rng.integers(0, 40))
        marks = rng.choice([" ", "\t", ", ", ".", "\n", "\x0b", "! ", "  ", "; ;"], len(words))
        text = "".join(w + m for w, m in zip(words, marks)) + "new York city " * int(rng.integers(0, 3))
        rows.append((k, text, [None, "", "en", "de"][k % 4], [None, "a", "", "b", "ü", "c"][rng.integers(6)]))
    return rows + [(900, None, "en", "a"), (901, "", "en", "new source"), (902, None, None, None), *rows[:5], (None, "the of", "xx", "q")]


def _audit(rows, min_docs, top):
    """Plain version: {(lang, source, part, item): (value, rank)}."""
    import re

    found = [(g or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for _, t, g, s in rows]
    out = {}
    for lang in {g for g, _, _ in found}:
        df = Counter(w for g, _, words in found if g == lang for w in set(words))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        sources = sorted({s for g, s, _ in found if g == lang})
        n = {s: Counter(w for g, z, words in found if (g, z) == (lang, s) for w in words if w in set(kept)) for s in sources}

        def shares(counts):
            total = sum(counts.values())
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: shares(n[s]) for s in sources}, shares(sum(n.values(), Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(q[w] - p[s][w], w) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, items, last in (("pair", pair, 10**9), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode())), 1):
                    if rank <= last:
                        out[lang, s, part, item] = (-value, rank)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_version(spark, monkeypatch, small):
    if small:
        for name, value in (("HELD", 3), ("LONG", 16), ("BROADCAST_TERMS", 1), ("CELL_ROWS", 4), ("BLOCK", 2)):
            monkeypatch.setattr(divergence, name, value)
    rows = _corpus(np.random.default_rng(3), 120)
    got = divergence.audit(_docs(spark, rows).repartition(3), min_docs=20, top=3).collect()
    assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in got} == _audit(rows, 20, 3)
    assert len(got) == len({tuple(r)[:4] for r in got})


def test_audit_without_kept_terms_and_of_no_rows(spark):
    rows = [(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "c", "de", None)]
    got = sorted(map(tuple, divergence.audit(_docs(spark, rows)).collect()))
    assert got == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert divergence.audit(_docs(spark, rows).limit(0)).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(9_876_543_210_123, 98_765_432_101_234, 77)], "n long, total long, kept long")
    got = rows.select(divergence._share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first().p
    assert got == 1 + 10**9 * (9_876_543_210_123 + 5) // (98_765_432_101_234 + 5 * 77)


def _phrases(rows, least, first):
    """Plain version: rows of collocations()."""
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            counts.update(words[i : i + k] for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        ranked = []
        for p, a in often.items():
            if len(p) < 2 or any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in often.items()
            ):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_plain_version(spark, monkeypatch, small):
    if small:
        limits = (("LONG", 12), ("SPLIT_WORDS", 30), ("BUCKET_WORDS", 50), ("TILE_BITS", 1), ("DENSE_TILES", 2), ("DENSE_SHARE", 10))
        for name, value in limits:
            monkeypatch.setattr(collocations, name, value)
    rows = _corpus(np.random.default_rng(4), 160) + [(k, "long " * 900 + "tail", "de", "a") for k in (950, 951)]
    got = collocations.collocations(_docs(spark, rows).repartition(3), least=6, first=25)
    assert sorted(map(tuple, got.collect())) == _phrases(rows, 6, 25)


def test_collocations_of_nothing(spark):
    docs = _docs(spark, [(1, None, "en", "s"), (2, "", None, "t"), (3, ".,;\n \t", "de", None)])
    assert collocations.collocations(docs, least=1).collect() == []
    assert collocations.collocations(docs.limit(0)).collect() == []
    one = collocations.collocations(_docs(spark, [(1, "a b c d", None, None)]), least=1).collect()
    assert [tuple(r)[:3] for r in one] == [("und", 1, "a b c d")]


def test_scores_of_large_counts_are_exact(spark):
    a, left, right = 9_111_222_333_444, 9_111_222_333_445, 19_111_222_333_447
    rows = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert rows.select(collocations._lower(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 2_000_000 * a // (left + right)


def test_pairs_are_counted_alike_in_every_tile(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = (rng.zipf(1.3, 5000).clip(1, 10**6).astype(np.int64) - 1 for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist()))
    for bits, share in ((11, 32), (2, 4), (3, 10**9)):
        monkeypatch.setattr(collocations, "TILE_BITS", bits)
        monkeypatch.setattr(collocations, "DENSE_SHARE", share)
        codes, counts, place = collocations.count_pairs(a, b)
        assert dict(zip(zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist()), counts.tolist())) == want
        assert (codes[place] == (a << 32 | b)).all()


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the thick forest",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft durch den dichten wald",
    "fr": "le renard brun rapide saute par-dessus le chien paresseux et court à travers la forêt",
}


def _labelled():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(150):
        lang = list(TEXTS)[k % 3]
        rows.append((k, " ".join(rng.choice(TEXTS[lang].split(), 12)), lang, "s"))
    return rows


def _plain_features(text):
    """Features of a text, one by one: runs of letters with a gap before, between and after them."""
    chars = [0]
    for c in text:
        folded = ord(c.lower()[0]) if c.isalpha() else 0
        if folded or chars[-1]:
            chars.append(folded)
    if chars[-1]:
        chars.append(0)
    full, out = (1 << 64) - 1, Counter()
    for i in range(len(chars)):
        gram = 0
        for order in (1, 2, 3):
            if i + order > len(chars):
                break
            gram = (gram * 0x9E3779B97F4A7C15 + chars[i + order - 1] + 1) & full
            if any(chars[i : i + order]):
                x = (gram + order) & full
                x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
                x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
                out[(x ^ x >> 31) >> (64 - langid.BITS)] += 1
    return out


@pytest.mark.parametrize("slice_size", [7, 1 << 20])
def test_languages_equal_plain_version(spark, monkeypatch, slice_size):
    monkeypatch.setattr(langid, "SLICE", slice_size)
    rows = _labelled()
    model = langid.train(_docs(spark, rows + [(500, "nothing learned", None, "s"), (501, None, "nn", "s"), (502, "12 34", "mm", "s")]))
    assert model.langs == sorted(TEXTS)
    counts = {g: sum((_plain_features(t) for _, t, x, _ in rows if x == g), Counter()) for g in model.langs}
    units = {
        g: {k: round(langid.UNIT * math.log((c[k] + 0.5) / (sum(c.values()) + 0.5 * (1 << langid.BITS)))) for k in range(1 << langid.BITS)}
        for g, c in counts.items()
    }
    tests = ["Der HUND läuft", "le chien, court!", "it runs 99", "x", "Ünï 𝒳𝓎 日本語", "über-forêt the", "a" * 50, *TEXTS.values()]
    got = langid.identify(_docs(spark, [(k, t, None, None) for k, t in enumerate(tests)]), model).collect()
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), tests):
        found = _plain_features(text)
        total = {g: sum(n * units[g][k] for k, n in found.items()) + round(langid.UNIT * math.log(1 / 3)) for g in model.langs}
        best = max(total.values())
        assert r.lang_pred == next(g for g in model.langs if total[g] == best)
        assert r.score == pytest.approx(1 / sum(math.exp((v - best) / langid.UNIT) for v in total.values()))


def test_language_cases(spark):
    rows = [(1, None), (2, ""), (3, "12 %% \n"), (None, "der hund"), (5, "der hund"), (5, "der hund"), (6, "the dog " * 400_000), (7, "日本")]
    docs = _docs(spark, [(d, t, "zz", "s") for d, t in rows])
    model = langid.train(_docs(spark, _labelled()))
    got = langid.identify(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == {("und", 0.0)}
    assert by[5] == by[None] and {p for p, _ in by[5]} == {"de"} and {p for p, _ in by[6]} == {"en"}
    assert len(by[7]) == 1 and all(0 <= s <= 1 for x in by.values() for _, s in x)
    assert langid.identify(docs.limit(0), model).collect() == []
    empty = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, empty).collect()} == {("und", 0.0)}


def test_sample_bounds_what_is_learned(spark):
    docs = _docs(spark, _labelled())
    counted = langid.train(docs, sample=5)
    assert counted.langs == sorted(TEXTS)
    assert (counted.matrix != langid.train(docs).matrix).any()
    assert (counted.matrix == langid.train(docs.repartition(5), sample=5).matrix).all()


def test_held_out_is_by_crc(spark):
    got = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = driver.queries()["op12_language_id"](spark, SF_DIR).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
