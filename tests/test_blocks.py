"""The grid of blocks, and the pair searches on top of it, against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import brute
from partatlas.functions.forest import maximum_forest
from partatlas.operators import blocks, graph, pivots, qgrams, similarity
from partatlas.operators.index import ItemIndex

MEMBERS = "id long, sku string, n long, last long"


def listing():
    """Arrow function: the pairs of every tile, and one row with the work of the task."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            start_a, a = blocks.members_of(batch.column("a"))
            start_b, b = blocks.members_of(batch.column("b"))
            name = batch.column("name").to_pylist()
            diagonal = batch.column("diagonal").to_pylist()
            for cell in range(batch.num_rows):
                left = a.field("id").to_pylist()[start_a[cell] : start_a[cell + 1]]
                right = b.field("id").to_pylist()[start_b[cell] : start_b[cell + 1]]
                assert left == sorted(left) and right == sorted(right)
                found = list(combinations(left, 2)) if diagonal[cell] else [(x, y) for x in left for y in right]
                columns = [[task] * len(found), [name[cell]] * len(found), [x for x, _ in found], [y for _, y in found]]
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["task", "name", "x", "y"])

    return run


@pytest.mark.parametrize("sizes", [{0: 40, 1: 1, 2: 9, 3: 2}, {0: 3}, {}])
def test_grid_meets_every_pair_once(spark, tiny_limits, sizes):
    rows = [(g, 100 * g + k) for g, n in sizes.items() for k in range(n)]
    members = spark.createDataFrame(rows, "group_id long, id long")
    pairs = spark.createDataFrame([(0, 0, "a"), (1, 1, "b"), (0, 2, "c"), (2, 2, "d"), (3, 0, "e"), (7, 0, "f")], "group_i long, group_j long, name string")
    got = blocks.grid(pairs, members, ["name"], listing(), "task int, name string, x long, y long").collect()
    ids = {g: [100 * g + k for k in range(n)] for g, n in sizes.items()}
    want = Counter()
    for name, i, j in (("a", 0, 0), ("b", 1, 1), ("c", 0, 2), ("d", 2, 2), ("e", 3, 0)):
        pairs_of = combinations(ids.get(i, []), 2) if i == j else ((x, y) for x in ids.get(i, []) for y in ids.get(j, []))
        want.update((name, frozenset(p)) for p in pairs_of)
    assert Counter((r.name, frozenset((r.x, r.y))) for r in got) == want


def test_tasks_of_one_group_are_balanced(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 3)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 450)
    members = spark.range(3600)  # 1,200 tiles on either side
    cells, blocked, tasks = blocks.layout(*blocks.one_group(members))
    size = {r["_block"]: r["count"] for r in blocked.groupBy("_block").count().collect()}
    b = len(size)
    assert tasks == b * b // 2
    work = Counter()
    for r in cells.select("_part", "_block_i", "_block_j").collect():
        i, j = r["_block_i"], r["_block_j"]
        work[r["_part"]] += size[i] * size[j] if i != j else size[i] * (size[i] - 1) / 2
    assert len(work) == tasks and sum(work.values()) == 3600 * 3599 / 2
    assert max(work.values()) <= 1.3 * sum(work.values()) / tasks


def _skus(seed, n):
    rng = random.Random(seed)
    out = {"", "A", "AA", "AAAA"}
    while len(out) < n:
        base = "".join(rng.choice("ABC-12") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21])))
        out.add(base)
        edited = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "9", "é"])
        out.add("".join(edited))
    return sorted(out)


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.8, 0.95, 1.0])
def test_indexed_pairs_equal_brute_force(spark, tiny_limits, floor):
    skus = _skus(int(floor * 100), 90)
    members = spark.createDataFrame([(k, s, 1, k) for k, s in enumerate(skus)], MEMBERS)
    got = [(min(r.a.id, r.b.id), max(r.a.id, r.b.id), round(r.sku_sim, 9)) for r in qgrams.indexed_pairs(members, floor).collect()]
    want = {(i, j, round(s, 9)) for i, j in combinations(range(len(skus)), 2) if (s := brute.sku_ratio(skus[i], skus[j])) >= floor - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want


def test_pending_and_scoped_pairs(spark, tiny_limits):
    skus = _skus(5, 60)
    rows = [(k, s, 1, k, k % 4, k % 5 == 0) for k, s in enumerate(skus)]
    members = spark.createDataFrame(rows, MEMBERS + ", scope_id long, asks boolean")
    similar = {(i, j) for i, j in combinations(range(len(skus)), 2) if brute.sku_ratio(skus[i], skus[j]) >= 0.6}
    pairs = lambda df: Counter((min(r.a.id, r.b.id), max(r.a.id, r.b.id)) for r in df.collect())
    assert pairs(qgrams.indexed_pairs(members, 0.6, pending="asks")) == Counter((i, j) for i, j in similar if i % 5 == 0 or j % 5 == 0)
    for floor in (0.6, 0.0):  # by the index or the grid
        reach = similar if floor else set(combinations(range(len(skus)), 2))
        assert pairs(qgrams.pairs_above(members, floor, "scope_id")) == Counter((i, j) for i, j in reach if i % 4 == j % 4)


def test_filters_leave_few_candidates(spark):
    rng = random.Random(3)
    skus = sorted({"".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ0123456789-") for _ in range(rng.randint(8, 16))) for _ in range(1500)})
    members = spark.createDataFrame([(k, s, 1, k) for k, s in enumerate(skus)], MEMBERS)
    row = qgrams.examined_pairs(members, 0.8).first()
    every = len(skus) * (len(skus) - 1) / 2
    assert row.candidates < 0.05 * every and row.looked < 0.3 * every and row.matched <= row.candidates


def test_best_sku_match_equals_brute_force(make_items, tiny_limits):
    rows = [(k * 2 + 1, s or "-", "text") for k, s in enumerate(_skus(11, 40))]
    index = ItemIndex(make_items(rows))
    first = {}
    for row, sku, _ in rows:
        first.setdefault(sku, row)
    for tiers in ((0.9, 0.75), (), (0.6,)):
        got = {r.catalog_no: (r.highest_sku_similarity, r.most_similar_sku) for r in similarity.best_sku_match(index, tiers).collect()}
        for sku in first:
            others = [o for o in sorted(first, key=first.get) if o != sku]
            sims = [brute.sku_ratio(sku, o) for o in others]
            assert got[sku] == (pytest.approx(max(sims)), others[sims.index(max(sims))])
    alone = ItemIndex(make_items([(1, "A", "x")]))
    assert similarity.best_sku_match(alone).first().most_similar_sku is None


def _plain_forest(edges):
    parent, kept = {}, []

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for w, a, b in sorted(((w, min(a, b), max(a, b)) for a, b, w in edges), key=lambda e: (-e[0], e[1], e[2])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            kept.append((a, b, w))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_maximum_forest(spark, monkeypatch, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.5, 0.6, 0.75, 0.9])) for _ in range(200)]
    edges += [(100, k, 0.7) for k in range(101, 130)] + [(k, k + 1, 0.1 * (k % 7)) for k in range(200, 240)] + [(5, 5, 1.0)]
    edges = sorted({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in edges}.values())
    proper = [e for e in edges if e[0] != e[1]]
    src, dst, weight = (np.array(x) for x in zip(*proper))
    assert sorted(proper[k] for k in maximum_forest(src, dst, weight)) == _plain_forest(proper)
    monkeypatch.setattr(graph, "FOREST_LIMIT", 20)
    frame = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(6)
    assert sorted(map(tuple, graph.maximum_spanning_forest(frame).collect())) == _plain_forest(proper)
    assert graph.maximum_spanning_forest(frame.limit(0)).collect() == []


def test_pivots_skip_cells_and_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ROWS_PER_PIVOT", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    points = np.concatenate([centres[rng.integers(0, 12, 240)] + rng.normal(scale=0.05, size=(240, 6)), np.zeros((2, 6))])
    unit = points / (np.sqrt((points**2).sum(axis=1)) + 1e-8)[:, None]
    frame = spark.createDataFrame([(k, 1, u.tolist()) for k, u in enumerate(unit)], "id long, n long, unit array<double>")
    cells = pivots.pivot_cells(frame, 0.9)
    group = {r.id: r.group_id for r in cells.points.select("id", "group_id").collect()}
    met = {frozenset(p) for p in cells.pairs}
    for i, j in zip(*np.nonzero(np.round(unit @ unit.T, 9) >= 0.9)):
        assert frozenset((group[i], group[j])) in met
    assert cells.skipped > 0.6
    assert {group[240], group[241]} == {pivots.NOWHERE}
    assert pivots.pivot_cells(frame, 0.0).pairs == [(0, 0)]
