import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import lcs, sku_ratio
from partatlas.functions.lcs import Strings, lcs_pairs, lcs_table, ratio
from partatlas.operators.sku_pairs import sku_similarity

WORDS = st.lists(st.text(alphabet="AB1é-漢", max_size=90), min_size=1, max_size=6)


@settings(max_examples=40, deadline=None)
@given(WORDS)
def test_table_and_pairs_agree_with_dynamic_programming(words):
    strings, at = Strings(words), np.arange(len(words))
    expected = np.array([[lcs(a, b) for b in words] for a in words])
    assert (lcs_table(strings, at, at) == expected).all()
    left, right = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
    assert (lcs_pairs(strings, left, right) == expected.ravel()).all()


def test_ratio_of_empty_strings_is_one():
    assert ratio(np.array([0, 0, 2]), np.array([0, 3, 5])).tolist() == [1.0, 0.0, 0.8]


def test_column_expression(spark):
    pairs = [("ABC", "AC"), ("ABC", "xyz"), ("", ""), ("A", ""), ("1SDA-77", "ISDA77")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in frame.select(sku_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [sku_ratio(a, b) for a, b in pairs]


def test_shared_beginnings_are_run_once(monkeypatch):
    from partatlas.functions import lcs

    words = [f"AB-{k:03d}" for k in range(100)] + ["", "AB", "AB-0"]
    strings, at = Strings(words), np.arange(len(words))
    run, plain = [], lcs._step
    monkeypatch.setattr(lcs, "_step", lambda state, hits: (run.append(len(hits[0])), plain(state, hits)))
    table = lcs.lcs_table(strings, at, at, np.uint8)
    # one state per different beginning, and the ends of shorter strings
    assert sum(run) < 100 + 10 + 4 + 3 * 6
    left, right = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
    assert (table.ravel() == lcs.lcs_pairs(strings, left, right)).all()


def test_profile_of_mixed_lengths_against_brute_force():
    import pyarrow as pa

    from partatlas.functions.lcs import ratio
    from partatlas.operators.sku_pairs import profiling

    rng = np.random.default_rng(5)
    for longest in (8, 40, 300):
        words = ["", *("".join(rng.choice(list("Aé1"), rng.integers(0, longest + 1))) for _ in range(30))]
        ids, n = rng.permutation(len(words)), rng.integers(1, 4, len(words))
        rows = sorted(({"id": int(i), "sku": w, "n": int(k), "last": 0} for i, w, k in zip(ids, words, n)), key=lambda r: r["id"])
        lists = pa.array([rows], pa.list_(pa.struct({"id": pa.int64(), "sku": pa.string(), "n": pa.int64(), "last": pa.int64()})))
        batch = pa.RecordBatch.from_arrays([lists, lists, pa.array([True])], names=["a", "b", "diagonal"])
        (found,) = profiling(0.6)(iter([batch]))
        strings, at = Strings([r["sku"] for r in rows]), np.arange(len(rows))
        left, right = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
        sims = ratio(lcs_pairs(strings, left, right), strings.lengths[left] + strings.lengths[right]).reshape(len(rows), -1)
        others, weight = ~np.eye(len(rows), dtype=bool), np.array([r["n"] for r in rows])
        got = found.to_pydict()
        assert np.allclose(got["total"], (sims * others).sum(axis=1))
        assert np.allclose(got["row_total"], (sims * others) @ weight)
        high = others & (sims >= 0.6)
        assert got["high_partners"] == high.sum(axis=1).tolist()
        assert np.allclose(got["high_total"], (sims * high).sum(axis=1))
        best = np.where(others, sims, -1).argmax(axis=1)
        assert got["top_id"] == [rows[k]["id"] for k in best]
        assert np.allclose(got["top"], sims[at, best])


@settings(max_examples=40, deadline=None)
@given(WORDS, WORDS)
def test_tables_of_lengths_hold_every_pair(left, right):
    import pyarrow as pa

    from partatlas.functions.lcs import tables_of_lengths

    got = np.full((len(left), len(right)), -1)
    for rows, columns, table, _ in tables_of_lengths(pa.array(left), pa.array(right)):
        assert len({len(left[k]) for k in rows}) == len({len(right[k]) for k in columns}) == 1
        got[np.ix_(rows, columns)] = table
    assert (got == [[lcs(a, b) for b in right] for a in left]).all()
    seen = np.zeros((len(left), len(left)), dtype=int)
    for rows, columns, table, wanted in tables_of_lengths(pa.array(left), pa.array(left), upper=True):
        seen[np.ix_(rows, columns)] += np.ones(table.shape, dtype=bool) if wanted is None else wanted
    assert (seen + seen.T == 1 - np.eye(len(left))).all()


def test_tables_run_what_all_columns_share_once(monkeypatch):
    import pyarrow as pa

    from partatlas.functions import lcs as kernel

    words = pa.array([f"A-VERY-LONG-BEGINNING-{k:03d}" for k in range(100)])
    run, plain = [], kernel._carried
    monkeypatch.setattr(kernel, "_carried", lambda state, hits, last: (run.append(sum(h.nbytes for h in hits)), plain(state, hits, last))[1])
    ((_, _, table, _),) = kernel.tables_of_lengths(words, words)
    assert table.shape == (100, 100) and table.diagonal().tolist() == [25] * 100
    # a byte for each column and different beginning, and a word for what all columns share
    assert sum(run) < (22 + 1 + 10 + 100) * (100 + 8) + 1


def test_a_member_leaves_a_cell_as_one_row(spark, monkeypatch):
    from partatlas.operators import blocks, sku_pairs

    members = spark.createDataFrame([(k, f"K-{k * 7919 % 10007:05d}", 1, k) for k in range(600)], "id long, sku string, n long, last long")
    monkeypatch.setattr(blocks, "TILE", 8)
    parts, plain = [], sku_pairs.grid
    monkeypatch.setattr(sku_pairs, "grid", lambda *a, **k: (parts.append(plain(*a, **k)), parts[0])[1])
    profile = sku_pairs.sku_profile(members, 0.8)
    assert {r.partners for r in profile.collect()} == {599}
    seen = {r.id: r["count"] for r in parts[0].groupBy("id").count().collect()}
    n_blocks = set(seen.values())
    assert len(seen) == 600 and len(n_blocks) == 1 and n_blocks.pop() <= 8


def test_large_cells_link_and_match_as_brute_force(monkeypatch):
    from functools import partial

    import pyarrow as pa

    from partatlas.functions.forest import smallest_labels
    from partatlas.operators import sku_pairs

    monkeypatch.setattr(sku_pairs, "SMALL_CELL", 1)
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("AB1-"), rng.integers(0, 9))) for _ in range(120)})
    members = [{"id": int(i), "sku": w, "n": int(n), "last": 0} for i, w, n in zip(rng.permutation(len(words)), words, rng.integers(1, 3, len(words)))]
    kind = pa.list_(pa.struct({"id": pa.int64(), "sku": pa.string(), "n": pa.int64(), "last": pa.int64()}))
    for cut, diagonal in ((0, True), (50, False)):
        a, b = (members, members) if diagonal else (members[:cut], members[cut:])
        names = ["a", "b", "diagonal", "floor"]
        batch = pa.RecordBatch.from_arrays([pa.array([a], kind), pa.array([b], kind), pa.array([diagonal]), pa.array([0.7])], names=names)
        near = {t: [(x, y) for x in a for y in b if (not diagonal or x["sku"] < y["sku"]) and sku_ratio(x["sku"], y["sku"]) >= t] for t in (0.7, 0.9)}
        found = [(r["a"]["id"], r["b"]["id"], r["sku_sim"]) for part in sku_pairs._matching([])(iter([batch])) for r in part.to_pylist()]
        assert len(found) == len(near[0.7])
        assert {(*sorted(f[:2]), f[2]) for f in found} == {(*sorted((x["id"], y["id"])), sku_ratio(x["sku"], y["sku"])) for x, y in near[0.7]}
        levels = [partial(sku_pairs._least, threshold=t) for t in near]
        rows = [r for part in sku_pairs.linking(levels)(iter([batch])) for r in part.to_pylist()]
        for level, pairs in enumerate(near.values()):
            assert sum(r["pairs"] or 0 for r in rows if r["level"] == level) == sum(x["n"] * y["n"] for x, y in pairs)
            links = np.array([(r["src"], r["dst"]) for r in rows if r["level"] == level and r["src"] is not None], dtype=int).reshape(-1, 2)
            edges = np.array([(x["id"], y["id"]) for x, y in pairs], dtype=int).reshape(-1, 2)
            labels = [smallest_labels(e[:, 0], e[:, 1], len(words)) for e in (links, edges)]
            assert (labels[0] == labels[1]).all()
            assert len(links) < len(words)
