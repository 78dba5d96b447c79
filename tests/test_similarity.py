import random
from collections import Counter

import pytest

import brute
from partatlas import schema as S
from partatlas.operators import best_text, graph, similarity, text_cells, tfidf
from partatlas.operators.index import ItemIndex
from partatlas.staging import stage

WORDS = ["red", "blue", "bolt", "nut", "wide", "x1", "é_2", "gear"]


def random_rows(seed, n=36):
    """Repeated numbers and texts, one hot text, blank and one-letter texts."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        sku = "".join(rng.choice("AB1") for _ in range(rng.randint(1, 6)))
        text = rng.choice(["hot item", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))), "a b", ""])
        rows.append((k * 3 + 1, sku, text))
    return rows


@pytest.mark.parametrize("threshold", [0.4, 0.41, 0.8])
def test_pairs_equal_brute_force(make_items, tiny_limits, threshold):
    rows = random_rows(int(threshold * 100))
    index = ItemIndex(make_items(rows))
    pairs = similarity.similar_pairs(index, threshold)
    got = {(r.row_i, r.row_j, r.combined) for r in similarity.expand_rows(index, pairs).collect()}
    expected = brute.row_pairs(rows, threshold)
    assert got == expected
    assert sum(r.row_pairs for r in pairs.collect()) == len(expected)


def test_strict_pairs(make_items):
    rows = [(1, "AB", "red"), (2, "AB", "zz"), (3, "AB", "red")]
    index = ItemIndex(make_items(rows))
    loose, strict = (similarity.similar_pairs(index, 0.4, strict=s).collect() for s in (False, True))
    assert {(r.row_i, r.row_j) for r in loose} == {(1, 2), (1, 1)}
    assert {(r.row_i, r.row_j) for r in strict} == {(1, 1)}


@pytest.mark.parametrize("cost", [0, 1e12])
@pytest.mark.parametrize("many", [1, 1e9])
def test_text_pairs_of_tiles_and_prefixes_equal_brute_force(make_items, tiny_limits, monkeypatch, cost, many):
    monkeypatch.setattr(tfidf, "INDEX_COST", cost)
    monkeypatch.setattr(text_cells, "MANY", many)
    monkeypatch.setattr(text_cells, "TOP_TERMS", 1)
    monkeypatch.setattr(best_text, "PRODUCTS", 3)
    rng = random.Random(7)
    texts = sorted({" ".join(rng.choice(WORDS + ["zz", "yy"]) for _ in range(rng.randint(0, 6))) for _ in range(40)})
    index = ItemIndex(make_items([(k, f"A{k}", t) for k, t in enumerate(texts)]))
    vecs = brute.vectors(texts)
    for tau in (0.0, 0.5, 0.8):
        expected = {
            (i, j): round(brute.cosine(vecs[i], vecs[j]), S.DIGITS) for j in range(len(texts)) for i in range(j)
        }
        expected = {k: c for k, c in expected.items() if c >= tau and c > 0}
        found = tfidf.text_pairs(index.vectors, tau).collect()
        assert len(found) == len(expected)
        assert {(r.text_i, r.text_j): r.desc_sim for r in found} == pytest.approx(expected, abs=1e-8)


def test_texts_with_common_rare_terms_make_no_table_of_candidates(make_items, monkeypatch):
    """a rare term in common made a candidate of every pair, for which vectors were sent about."""
    monkeypatch.setattr(tfidf, "verified", lambda *_: pytest.fail("candidates were listed"))
    rows = [(k, f"A{k}", f"rare{k % 3} " + " ".join(f"own{k}x{j}" for j in range(12))) for k in range(30)]
    index = ItemIndex(make_items([*rows, (30, "A30", rows[0][2] + " more")]))
    assert [(r.text_i, r.text_j) for r in tfidf.text_pairs(index.vectors, 0.8).collect()] == [(0, 30)]
    best = {r.catalog_no: r.most_similar_desc_sku for r in similarity.best_description_match(index).collect()}
    assert (best["A0"], best["A30"], best["A1"]) == ("A30", "A0", "A4")


@pytest.mark.parametrize("cost", [0, 1e12])
def test_best_text_with_and_without_tiers(make_items, tiny_limits, monkeypatch, cost):
    monkeypatch.setattr(tfidf, "INDEX_COST", cost)
    rows = random_rows(21)
    got = {r.catalog_no: r for r in similarity.best_description_match(ItemIndex(make_items(rows))).collect()}
    last, first = by_sku(rows)
    vecs = dict(zip([r[0] for r in rows], brute.vectors([r[2] for r in rows])))
    order = sorted(first, key=first.get)
    for sku in order:
        others = [o for o in order if o != sku]
        cosines = [round(brute.cosine(vecs[last[sku][0]], vecs[last[o][0]]), S.DIGITS) for o in others]
        assert got[sku].most_similar_desc_sku == others[cosines.index(max(cosines))]
        assert got[sku].highest_desc_similarity == pytest.approx(max(cosines))


@pytest.mark.parametrize("limit", [0, 1000])
def test_row_pairs_stay_where_they_are_found(make_items, monkeypatch, limit):
    """every pair was shuffled by either id to learn its rows."""
    monkeypatch.setattr(similarity, "SEVERAL_ROWS", limit)
    rows = random_rows(31)
    rows += [(row + 500, sku, text) for row, sku, text in rows[:4]]
    index = ItemIndex(make_items(rows))
    pairs = stage(similarity.similar_pairs(index, 0.5))
    spark = pairs.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        expanded = similarity.expand_rows(index, pairs)
        plan = expanded._jdf.queryExecution().executedPlan().toString()
        got = {(r.row_i, r.row_j, r.combined) for r in expanded.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute.row_pairs(rows, 0.5)
    assert ("hashpartitioning" in plan) == (limit == 0)


def by_sku(rows):
    last = {sku: (row, text) for row, sku, text in rows}
    first = {}
    for row, sku, _ in rows:
        first.setdefault(sku, row)
    return last, first


@pytest.mark.parametrize("seed", [2])
def test_profiles_equal_brute_force(make_items, tiny_limits, seed):
    rows = random_rows(seed)
    index = ItemIndex(make_items(rows))
    profile = similarity.item_similarity_profile(index, 0.5)
    best = similarity.best_description_match(index)
    stats = {r.catalog_no: r for r in similarity.per_item_stats(index, profile, best).collect()}
    named = {r.catalog_no: r for r in profile.collect()}
    described = {r.catalog_no: r for r in best.collect()}
    last, first = by_sku(rows)
    vecs = dict(zip([r[0] for r in rows], brute.vectors([r[2] for r in rows])))
    order = sorted(first, key=first.get)
    for sku in order:
        others = [o for o in order if o != sku]
        sims = [brute.sku_ratio(sku, o) for o in others]
        high = [s for s in sims if s >= 0.5]
        assert named[sku].highest_sku_similarity == pytest.approx(max(sims))
        assert named[sku].most_similar_sku == others[sims.index(max(sims))]
        assert named[sku].average_similarity == pytest.approx(sum(sims) / len(sims))
        if high:
            assert named[sku].high_similarity_average == pytest.approx(sum(high) / len(high))
        else:
            assert named[sku].high_similarity_average is None
        cosines = [brute.cosine(vecs[last[sku][0]], vecs[last[o][0]]) for o in others]
        assert described[sku].highest_desc_similarity == pytest.approx(max(cosines))
        assert described[sku].most_similar_desc_sku == others[cosines.index(max(cosines))]
        assert stats[sku].avg_desc_similarity == pytest.approx(sum(cosines) / len(cosines), abs=1e-8)


def test_sweep_equals_brute_force(make_items, tiny_limits):
    rows = random_rows(9)
    index = ItemIndex(make_items(rows))
    sweep = {r.threshold: r for r in similarity.threshold_sweep(index, [0.3, 0.5, 0.7]).collect()}
    sku_of = {r[0]: r[1] for r in rows}
    vecs = brute.vectors([r[2] for r in rows])
    n = len(rows)
    for threshold in (0.3, 0.5, 0.7):
        pairs = brute.row_pairs(rows, threshold)
        labels = brute.components(set(sku_of.values()), [(sku_of[i], sku_of[j]) for i, j, _ in pairs])
        sizes = [list(labels.values()).count(c) for c in set(labels.values())]
        got = sweep[threshold]
        assert (got.similar_pairs, got.connected_components, got.largest_component_size) == (len(pairs), len(sizes), max(sizes))
        mean = sum(brute.sku_ratio(a[1], b[1]) for a in rows for b in rows) / n**2
        assert got.average_sku_similarity == pytest.approx(mean)
        assert got.average_desc_similarity == pytest.approx(sum(brute.cosine(u, v) for u in vecs for v in vecs) / n**2, abs=1e-7)


def test_one_item(make_items):
    index = ItemIndex(make_items([(5, "A", "red bolt")]))
    row = similarity.item_similarity_profile(index).first()
    assert (row.average_similarity, row.most_similar_sku) == (None, None)
    assert similarity.best_description_match(index).first().most_similar_desc_sku is None
    sweep = similarity.threshold_sweep(index, [0.5]).first()
    assert (sweep.similar_pairs, sweep.connected_components, sweep.largest_component_size) == (0, 1, 1)


def test_lookup(spark, make_items):
    items = make_items([(1, "ABC", "x"), (2, "AC", "y")])
    asked = spark.createDataFrame([("ABC", "AC"), ("ABC", "nope")], "catalog_no_i string, catalog_no_j string")
    got = {r.catalog_no_j: (r.found, r.sku_sim) for r in similarity.similarity_lookup(items, asked).collect()}
    assert got == {"AC": (True, 0.8), "nope": (False, None)}
    nothing = spark.createDataFrame([(None, "AC")], "catalog_no_i string, catalog_no_j string")
    assert [(r.found, r.sku_sim) for r in similarity.similarity_lookup(items, nothing).collect()] == [(False, None)]


def test_similarity_columns_reach_every_row(make_items, tiny_limits):
    rows = random_rows(4)
    index = ItemIndex(make_items(rows))
    profile = similarity.item_similarity_profile(index)
    best = similarity.best_description_match(index)
    assert similarity.with_similarity_columns(index, profile, best).count() == len(rows)


def test_edges_take_the_last_pair_and_vertices_the_last_row(make_items):
    rows = [(1, "AA", "red bolt", "m1", "s"), (2, "AB", "red bolt", "m2", "s"), (3, "AA", "red nut", "m3", "s")]
    index = ItemIndex(make_items(rows))
    edges = graph.graph_edges(similarity.similar_pairs(index, 0.3)).collect()
    vecs = brute.vectors([r[2] for r in rows])
    assert [(e.src, e.dst) for e in edges] == [("AA", "AB")]
    assert edges[0].weight == pytest.approx(0.4 * 0.5 + 0.6 * brute.cosine(vecs[1], vecs[2]))
    assert {v.catalog_no: v.main_category for v in graph.graph_vertices(index.items).collect()} == {"AA": "m3", "AB": "m2"}


@pytest.mark.parametrize("seed", [3])
def test_components(spark, tiny_limits, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 130)]
    edges += [(k, k + 1) for k in range(200, 230)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = {r.node: r.component for r in graph.connected_components(frame).collect()}
    joined = [e for e in edges if e[0] != e[1]]
    assert got == brute.components({n for e in joined for n in e}, joined)


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_no_items(make_items):
    index = ItemIndex(make_items([(1, "A", "x y")]).limit(0))
    profile = similarity.item_similarity_profile(index)
    assert similarity.similar_pairs(index).collect() == []
    assert similarity.best_description_match(index).collect() == []
    assert profile.collect() == []
    swept = similarity.threshold_sweep(index, [0.5, 0.8], profile).collect()
    assert [(r.total_items, r.similar_pairs, r.average_sku_similarity) for r in swept] == [(0, 0, None)] * 2
    assert len(similarity.similarity_statistics(index, 0.8, profile).collect()) == 1


def test_score_that_rounding_lifts_to_the_threshold():
    # ratio 1 and cosine 0.666666666 round to 0.8; the bounds on both sides have to let it pass
    tau = (0.8 - S.SKU_WEIGHT) / S.DESC_WEIGHT - similarity.BOUND_SLACK
    assert tau < 0.666666666
    assert (0.8 - S.DESC_WEIGHT * 0.666666666) / S.SKU_WEIGHT <= 1 + similarity.sku_pairs.FLOOR_SLACK


def test_stars_and_cross_pairs_are_the_network(make_items, tiny_limits):
    rows = random_rows(12) + [(500 + k, f"H{k}", "hot item") for k in range(40)]
    index = ItemIndex(make_items(rows))
    stars = similarity.network_stars(index)
    assert stars.count() <= len(rows)  # not a row per pair of the forty
    cross = similarity.similar_pairs(index, S.NETWORK_THRESHOLD, strict=True, equal_texts=False)
    columns = ["row_i", "row_j", "combined"]
    got = similarity.expand_stars(index, stars).select(*columns).unionByName(cross.select(*columns)).collect()
    whole = similarity.similar_pairs(index, S.NETWORK_THRESHOLD, strict=True).where("row_i <> row_j").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(whole) > 40 * 39 / 2
    with pytest.raises(ValueError):
        similarity.network_stars(index, 0.7)


def _shuffles_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_terms_are_counted_within_their_rows(make_items, spark, monkeypatch):
    monkeypatch.setattr(tfidf, "COUNT_TERMS", 3)
    texts = ["bolt Bolt steel", None, "", "wire bolt wire wire a bolt", "x", "bolt bolt steel wire nut nut nut lamp"]
    rows = [(k, f"C{k}", t, "M", "S") for k, t in enumerate(texts)]
    want = Counter((k, w) for k, t in enumerate(texts) for w in (t or "").lower().split() if len(w) > 1)
    index = ItemIndex(make_items(rows))
    assert Counter({(r.row_id, r.term): r.tf for r in similarity.tokenize(index).collect()}) == want
    posted = tfidf.postings(spark.createDataFrame([(k, 1, t or "") for k, t in enumerate(texts)], "text_id long, n_rows long, text string"))
    assert _shuffles_of(posted) == 0
    assert Counter({(r.text_id, r.term): r.tf for r in posted.collect()}) == want


def test_rows_that_repeat_a_row_id_are_counted_together(make_items):
    rows = [(1, "A", "bolt nut bolt", "M", "S"), (1, "A", "bolt wire", "M", "S"), (2, "B", "nut", "M", "S"), (None, "C", "nut nut", "M", "S"), (None, "D", "nut", "M", "S")]
    got = sorted(((r.row_id or 0, r.term, r.tf) for r in similarity.tokenize(ItemIndex(make_items(rows))).collect()))
    assert got == [(0, "nut", 3), (1, "bolt", 3), (1, "nut", 1), (1, "wire", 1), (2, "nut", 1)]


def test_weights_come_with_their_terms(make_items):
    rows = [(k, f"C{k}", t, "M", "S") for k, t in enumerate(["bolt nut", "bolt bolt wire", "nut lamp wire", ""])]
    index = ItemIndex(make_items(rows))
    names = {r.term_id: r.term for r in index.vocabulary.collect()}
    want = {(r.text_id, names[t]): round(w, 9) for r in index.vectors.collect() for t, w in zip(r.terms, r.weights)}
    weights = similarity.tfidf_weights(index)
    assert {(r.text_id, r.term): r.weight for r in weights.collect()} == pytest.approx(want)
    assert _shuffles_of(weights) <= 3  # by term on both sides and by text


def test_sweep_lists_no_pairs_of_equal_texts(make_items, tiny_limits, monkeypatch):
    """Profiles of one text are counted and linked in their tasks, with the results of the listed pairs."""
    rows = random_rows(7) + [(1000 + k, f"{'AB'[k % 2]}{k % 5}1{k % 9}", "hot item") for k in range(30)]
    index = ItemIndex(make_items(rows))
    thresholds = [0.65, 0.8, 0.9]
    listed = similarity.similar_pairs(index, min(thresholds))
    expected = sorted(similarity.threshold_sweep(index, thresholds, pairs=listed).collect())
    asked, plain = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda *a, **k: asked.append(k) or plain(*a, **k))
    assert sorted(similarity.threshold_sweep(index, thresholds).collect()) == expected
    assert asked == [{"equal_texts": False}]
    profile = similarity.item_similarity_profile(index)
    one = similarity.similarity_statistics(index, 0.8, profile).first()
    assert (one.similar_pairs, one.connected_components) == (expected[1].similar_pairs, expected[1].connected_components)


def test_links_connect_catalogue_numbers_as_all_edges_do(make_items, tiny_limits):
    """One number with several texts joins their parts; a number with itself alone is no edge; fewer edges than pairs."""
    rows = [(k, f"AB-{k % 12}", ["hot item", "red bolt", "wide gear"][k % 3]) for k in range(40)] + [(90, "zz", "x1 nut"), (91, "zz", "x1 nut")]
    index = ItemIndex(make_items(rows))
    pairs = similarity.similar_pairs(index, 0.8)
    links = similarity.catalog_links(index, pairs).collect()
    edges = similarity.catalog_edges(index, pairs).collect()
    nodes = {x for e in edges for x in (e.src, e.dst)}
    assert {x for e in links for x in (e.src, e.dst)} == nodes
    assert brute.components(nodes, [tuple(e) for e in links]) == brute.components(nodes, [tuple(e) for e in edges])
