"""Queries with SQL on the given tables, and the edge cases of the native operators."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from check_queries import compare, connect
from partatlas.llm import decontaminate, lines, mixing

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, weight double, rows long, bad string"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, None, s, 9.0, 9, "x") for d, t, s in rows], DOCS)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op1_chat_format", "op5_mixing", "op7_line_dedup", "op10_decontamination"])
def test_query_equals_sql(spark, name):
    matches, *_, difference = compare(
        spark, connect(SF_DIR), name, driver.queries()[name], driver.oracle_sql()[name], SF_DIR
    )
    assert matches, difference


def test_mixing_targets_fill_up_to_three_times(spark):
    rows = [(d, "w " * 10, "a") for d in range(30)]
    rows += [(100 + d, "w " * 10, "b") for d in range(3)]
    rows += [(200 + d, None if d else "one two", None) for d in range(3)]
    got = mixing.mix_sources(_docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    # 332 words; weights 1, 2, 3: b stops at 90, null at 6, a gets the rest
    assert {s: round(v[0].target, 6) for s, v in by.items()} == {"a": 236.0, "b": 90.0, None: 6.0}
    assert sum(r.taken for r in by["b"]) == 90 and sum(r.taken for r in by[None]) == 6
    assert abs(sum(r.taken for r in by["a"]) - 236) <= 5
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(_docs(spark, rows)).collect()), key=str)


def test_mixing_prefers_heavy_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)  # many buckets a source
    rows = [(d, "w w w w", "a" if d < 600 else "b") for d in range(900)]
    weights = spark.createDataFrame([(d, 5.0 if d % 2 else 0.2) for d in range(900)], "doc_id long, weight double")
    got = mixing.mix_sources(_docs(spark, rows), weights).where("source = 'a'").collect()
    assert got[0].target == 1200 and abs(sum(r.taken for r in got) - 1200) <= 2  # half of the source
    heavy = sum(r.taken for r in got if r.doc_id % 2)
    assert heavy > 1000


def test_mixing_of_empty_and_wordless_tables(spark):
    assert mixing.mix_sources(_docs(spark, []).limit(0)).collect() == []
    got = mixing.mix_sources(_docs(spark, [(None, None, None), (None, "", "a"), (1, " \t\n", "a"), (1, " \t\n", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 4


def _passage(n, tag="p"):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_decontamination_cases(spark):
    items = spark.createDataFrame(
        [(1, _passage(20)), (2, "too short here"), (3, None), (None, _passage(9, "n")), (4, _passage(20)), (5, _passage(12, "q"))],
        "item_id long, text string",
    )
    part = _passage(14).split()
    rows = [
        (10, "before " * 3000 + _passage(20).upper() + " after", "s"),
        (11, " ".join(part), "s"),  # 10 of 16 shingles
        (12, None, None),
        (13, "", None),
        (None, _passage(20), None),
        (14, _passage(12, "q") + " x " + _passage(20), "s"),
        (14, _passage(12, "q") + " x " + _passage(20), "s"),
        (14, "clean text of the same id", "s"),
        (15, _passage(9, "n"), "s"),
        (16, " ".join(_passage(20).split()[:17]), "s"),  # 13 of 16: 0.8125
    ]
    got = decontaminate.decontaminate(_docs(spark, rows), items).collect()
    found = sorted((r.doc_id or -1, r.items, r.kept) for r in got)
    assert found == sorted(
        [
            (10, [1, 4], False), (11, [], True), (12, [], True), (13, [], True), (-1, [1, 4], False),
            (14, [1, 4, 5], False), (14, [1, 4, 5], False), (14, [], True), (15, [], True), (16, [1, 4], False),
        ]
    )
    assert decontaminate.decontaminate(_docs(spark, rows).limit(0), items).collect() == []
    assert all(r.kept for r in decontaminate.decontaminate(_docs(spark, rows), items.limit(0)).collect())


def test_sketches_lose_no_match(spark):
    # every way to lack the allowed number of shingles leaves one of the sketch
    items = spark.createDataFrame([(n, _passage(n, f"i{n}_")) for n in range(5, 70)], "item_id long, text string")
    hashes = decontaminate.item_shingles(items)
    kept = decontaminate.sketches(hashes, 0.8).groupBy("item_id").agg(F.count(F.lit(1)).alias("k"))
    for r in kept.join(hashes.select("item_id", "n").distinct(), "item_id").collect():
        lacking = max(m for m in range(r.n + 1) if (r.n - m) / r.n >= 0.8 - 1e-9)
        assert r.k > lacking


def test_line_dedup_cases(spark):
    shared = [(d, f"own {d}\n  Subscribe now \n\nend {d % 7}", f"s{d}") for d in range(12)]
    rows = shared + [(50, None, "s1"), (51, "", None), (52, "Subscribe now\nkeep", None), (53, "few\nfew", "s1"), (53, "few", "s2")]
    got = lines.remove_boilerplate(_docs(spark, rows)).collect()
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert len(got) == len(rows)
    assert by[3, 4].text == "own 3\n\nend 3" and by[3, 4].n_removed == 1
    assert by[50, 1].text is None and by[51, 1].text == ""
    assert by[52, 2].text == "keep" and by[53, 2].text == "few\nfew"
    assert lines.remove_boilerplate(_docs(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("lg_k", [4, 12])
def test_line_threshold_is_exact(spark, lg_k):
    rows = [(1000 * n + s, f"line {n}", f"site{s}") for n in range(1, 40) for s in range(n)]
    found = lines.boilerplate_lines(_docs(spark, rows), min_sites=20, lg_k=lg_k)
    want = spark.createDataFrame([(f"line {n}",) for n in range(20, 40)], "line string").select(F.xxhash64("line").alias("hash"))
    assert sorted(r.hash for r in found.collect()) == sorted(r.hash for r in want.collect())
