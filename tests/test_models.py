import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partatlas.operators import categorize, completion, features, keyed_forest
from partatlas.operators.index import ItemIndex

KINDS = {"A/B": ["bolt steel", "nut steel"], "A_B": ["cable wire", "wire copper"], "Solo": ["lamp bulb"]}


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        main = list(KINDS)[k % 3]
        sub = rng.randrange(len(KINDS[main]))
        rows.append((k, f"{main[:1]}-{k:03d}", f"{KINDS[main][sub]} n{k % 4}x", main, f"{main}{sub}"))
    return spark.createDataFrame(
        rows, "row_id long, catalog_no string, description string, main_category string, sub_category string"
    )


@pytest.fixture(scope="module")
def model(items):
    return categorize.train(items, trees=10, depth=6, n_components=8, clusters=3)


def test_svd_keeps_inner_products_at_full_rank(items):
    index = ItemIndex(items)
    fitted = features.fit_text_features(index)
    got = {r.row_id: np.array(r.features) for r in features.text_features(index, fitted).collect()}
    assert fitted.basis.T @ fitted.basis == pytest.approx(np.eye(fitted.basis.shape[1]), abs=1e-9)
    assert np.linalg.norm(got[0]) == pytest.approx(1.0)
    assert all(len(v) == fitted.basis.shape[1] for v in got.values())


def test_only_categories_with_two_sub_categories_get_a_model(items, model):
    names = {r.label: r.value for r in model.main_labels.collect()}
    assert {names[r.key] for r in model.subs.collect()} == {"A/B", "A_B"}
    assert {(names[r.key], r.value) for r in model.sub_labels.collect()} == {("A/B", "A/B0"), ("A/B", "A/B1"), ("A_B", "A_B0"), ("A_B", "A_B1")}
    eligible = {r.main_category: r.eligible for r in categorize.sub_model_eligibility(items).collect()}
    assert eligible == {"A/B": True, "A_B": True, "Solo": False}


def test_predictions(items, model):
    rows = categorize.predict(items, model, threshold=0.5).collect()
    assert len(rows) == 60
    for r in rows:
        assert 0 < r.main_category_confidence <= 1 and 0 <= r.cluster < 3
        if r.predicted_main_category == "Solo" or r.main_category_confidence < 0.5:
            assert (r.predicted_sub_category, r.sub_category_confidence) == ("Unknown", 0.0)
        assert r.main_category_changed == (r.predicted_main_category != r.original_main_category)
    assert sum(not r.main_category_changed for r in rows) > 50


def test_forests_of_three_hundred_keys(spark, monkeypatch):
    monkeypatch.setattr(keyed_forest, "SHARD_ROWS", 40)
    monkeypatch.setattr(keyed_forest, "PIECE_ROWS", 30)
    rng = np.random.default_rng(6)
    rows = []
    for key in range(300):
        for _ in range(100 if key == 7 else 12):  # one key is cut into shards and pieces
            label = int(rng.integers(0, 2 + key % 3))
            rows.append((key, len(rows), label, [label + rng.normal(0, 0.1), rng.normal(), float(key), rng.normal()]))
    frame = spark.createDataFrame(rows, "key int, row_id long, label int, features array<double>")
    forests = keyed_forest.train_forests(frame, 8, 6, 1)
    trees = forests.groupBy("key").count().collect()
    assert len(trees) == 300 and all(r["count"] >= 8 for r in trees)
    again = keyed_forest.train_forests(frame.repartition(5), 8, 6, 1)
    assert sorted(map(str, forests.where("key < 9").collect())) == sorted(map(str, again.where("key < 9").collect()))
    scored = keyed_forest.score_forests(frame.unionByName(frame.where("key = 0").withColumn("key", F.lit(999))), forests)
    got = {r.row_id: (r.key, r.label, r.confidence) for r in scored.collect()}
    assert len(got) == len(rows) and all(got[r][0] == k for k, r, _, _ in rows)
    assert np.mean([got[r][1] == label for _, r, label, _ in rows]) > 0.97 and all(0 < c <= 1 for _, _, c in got.values())
    # the plan does not know how many keys there are
    few = keyed_forest.score_forests(frame.where("key < 2"), keyed_forest.train_forests(frame.where("key < 2"), 8, 6, 1))
    assert scored._jdf.queryExecution().logical().toString().count("\n") < 1.5 * few._jdf.queryExecution().logical().toString().count("\n")


def test_trees_of_one_key_are_grown_by_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(0, k, int(k % 3), [float(k % 3) + rng.random(), float(rng.random())]) for k in range(60)]
    frame = spark.createDataFrame(rows, "key int, row_id long, label int, features array<double>")
    whole = keyed_forest.train_forests(frame, 12, 5, 1)
    assert whole.select(F.spark_partition_id()).distinct().count() == 1
    monkeypatch.setattr(keyed_forest, "TASK_WORK", 120)  # two trees
    cut = keyed_forest.train_forests(frame, 12, 5, 1)
    assert cut.select(F.spark_partition_id()).distinct().count() == 6
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_one_tree_separates_what_can_be_separated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3).astype(int) + 2 * (x[:, 1] > 0)).astype(np.int64)
    cuts = [keyed_forest._cuts(x[:, f]) for f in range(3)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    feature, threshold, low, high, share = keyed_forest.grow(binned, cuts, y, 4, 10, rng)
    assert np.allclose(share.sum(axis=1), 1) and ((feature < 0) == (low < 0)).all()
    assert (share[keyed_forest._leaves(x, feature, threshold, low, high)].argmax(axis=1) == y).mean() > 0.93


def test_saved_model_predicts_the_same(spark, items, model, tmp_path):
    categorize.save_model(model, str(tmp_path / "model"), spark)
    again = categorize.load_model(str(tmp_path / "model"), spark)
    names = ["row_id", "predicted_main_category", "predicted_sub_category", "main_category_confidence", "cluster"]
    before, after = (
        sorted(map(tuple, categorize.predict(items, m).select(*names).collect())) for m in (model, again)
    )
    assert before == after


def failing():
    """A service without an answer to some prompts, made here so that it travels with its code."""

    def complete(prompts):
        if any("n3x" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper()[-5:] for p in prompts]

    return complete


def test_failures_stay_with_their_rows(items):
    enriched, log = completion.enrich_descriptions(items, failing())
    got = {r.row_id: r.enriched_description for r in enriched.collect()}
    assert all((got[k] == "Unknown") == (k % 4 == 3) for k in range(60))
    assert {r.error for r in log.where("status = 'failed'").collect()} == {"no answer"}


def test_equal_prompts_are_asked_once(spark, tiny_limits):
    rows = spark.createDataFrame([(k, f"p{k % 2}") for k in range(30)], "row_id long, prompt string")
    asked = spark.sparkContext.accumulator(0)

    def count(prompts):
        asked.add(len(prompts))
        return list(prompts)

    assert completion.complete_text(rows, count).count() == 30
    assert asked.value == 2


def test_waves_and_restart_ask_open_prompts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(completion, "PROMPTS_PER_CALL", 1)
    monkeypatch.setattr(completion, "CALLS_PER_WAVE", 1)
    rows = spark.createDataFrame([(k, f"p{k % 7}") for k in range(30)], "row_id long, prompt string")
    asked = spark.sparkContext.accumulator(0)

    def answering(broken):
        def complete(prompts):
            asked.add(len(prompts))
            if any(p in broken for p in prompts):
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

        return complete

    store = str(tmp_path / "answers")
    first = completion.complete_text(rows, answering({"p3", "p5"}), 2, store)
    assert first.where("status = 'failed'").select("prompt").distinct().count() == 2
    before = asked.value
    second = completion.complete_text(rows, answering(set()), 2, store)
    assert sorted((r.row_id, r.result) for r in second.collect()) == [(k, f"P{k % 7}") for k in range(30)]
    assert asked.value - before == 2


def test_a_wave_reads_its_own_prompts_only(spark, monkeypatch):
    monkeypatch.setattr(completion, "PROMPTS_PER_CALL", 1)
    monkeypatch.setattr(completion, "CALLS_PER_WAVE", 4)
    rows = spark.createDataFrame([(k, f"prompt {k}") for k in range(120)], "row_id long, prompt string")
    laid, original = [], completion.stage

    def watched(df, by=None):
        out = original(df, by)
        if by == "wave":
            laid.append(out)
        return out

    monkeypatch.setattr(completion, "stage", watched)
    assert completion.complete_text(rows, failing(), 2).count() == 120
    (open_,) = laid
    waves = [r.wave for r in open_.select("wave").distinct().collect()]
    assert len(waves) > 8
    assert all(sum(f"/wave={w}/" in path for w in waves) == 1 for path in open_.inputFiles())
    scan = open_.where("wave = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in scan  # other waves are not opened


def test_gram_matrix_is_the_sum_of_products(spark, monkeypatch):
    monkeypatch.setattr(features, "GRAM_SLICE", 3)
    monkeypatch.setattr(features, "GRAM_SLOTS", 2)
    rng = np.random.default_rng(4)
    dense = rng.random((23, 7)) * (rng.random((23, 7)) < 0.4)
    times = rng.integers(1, 5, 23)
    rows = [(int(n), np.flatnonzero(x).tolist(), x[x > 0].tolist()) for n, x in zip(times, dense)]
    frame = spark.createDataFrame(rows, "n_rows long, terms array<long>, weights array<double>").repartition(5)
    got = {r.position: r.products for r in features.gram_matrix(frame, 7).collect()}
    assert np.allclose([got[k] for k in range(7)], (dense * times[:, None]).T @ dense)


def test_fallback_routes_only_uncertain_rows(items):
    guessed = categorize.init_predictions(items)
    routed = categorize.route_low_confidence(guessed, trained=False)
    rows = completion.llm_fallback(routed, failing()).collect()
    assert all((r.predicted_main_category == "Unknown") == (r.row_id % 4 == 3) for r in rows)
    assert {r.categorization_reason for r in rows if r.completion_failed} == {"GPT failed: no answer"}
    nothing = categorize.route_low_confidence(
        guessed.selectExpr("* except (main_category_confidence, sub_category_confidence, predicted_main_category, predicted_sub_category)",
                           "1.0D as main_category_confidence", "1.0D as sub_category_confidence", "'m' as predicted_main_category", "'s' as predicted_sub_category"))
    assert completion.llm_fallback(nothing, failing()).where("completion_failed").count() == 0
