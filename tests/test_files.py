import pytest

from partatlas import schema as S
from partatlas.operators import cleaning, completion
from partatlas.operators.completion import offline_complete
from partatlas.plans.analysis import Settings, enrich, run_analysis
from partatlas.sources import files


def write_csv(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def item_lines(n=24):
    head = "CatalogNo,Description,Main Category,Sub-category,MfrCode"
    kinds = [("Bolts", "bolt steel"), ("Wires", "wire copper"), ("Lamps", "lamp bulb")]
    return [head] + [f"AB-{k:03d},{kinds[k % 3][1]} s{k % 2}z,{kinds[k % 3][0]},{kinds[k % 3][0]}{k % 2},LEV" for k in range(n)]


def test_rows_keep_their_file_order(spark, tmp_path):
    items = files.read_items(spark, write_csv(tmp_path / "items.csv", item_lines()))
    rows = items.orderBy(S.ROW).collect()
    assert [r.row_id for r in rows] == list(range(24))
    assert [r.catalog_no for r in rows] == [f"AB-{k:03d}" for k in range(24)]


def test_declared_schema(spark, tmp_path):
    path = write_csv(tmp_path / "items.csv", ["CatalogNo,Description,Weight", "A1,bolt,2.5", "A2,,x"])
    items = files.read_items(spark, path, schema="CatalogNo string, Description string, Weight double")
    assert dict(items.dtypes)["Weight"] == "double"
    assert [(r.catalog_no, r.description, r.Weight) for r in items.orderBy(S.ROW).collect()] == [("A1", "bolt", 2.5), ("A2", None, None)]


@pytest.mark.parametrize("suffix", ["csv", "parquet", "json"])
def test_round_trip(spark, tmp_path, suffix):
    items = files.read_items(spark, write_csv(tmp_path / "items.csv", item_lines(5)))
    target = str(tmp_path / "new" / f"out.{suffix}")
    files.write_items(items, target)
    again = files.read_optional(spark, target)
    assert sorted(map(tuple, again.select(*items.columns).collect())) == sorted(map(tuple, items.collect()))


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_items(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported file type"):
        files.read_items(spark, write_csv(tmp_path / "items.txt", item_lines(1)))
    assert files.read_optional(spark) is None and files.read_optional(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError):
        Settings(similarity_threshold=1.5)


def test_stage_is_resumed_until_its_mark_changes(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for mark in ("a", "a", "b"):
        assert files.stage_or_resume(spark, str(tmp_path / "s"), mark, build).count() == 3
    assert len(built) == 2
    first = spark.range(3)
    assert files.fingerprint(first, t=1) == files.fingerprint(first.repartition(2), t=1)
    assert files.fingerprint(first, t=1) != files.fingerprint(first, t=2)


def test_whole_analysis(spark, tmp_path):
    source = write_csv(tmp_path / "items.csv", item_lines())
    out = str(tmp_path / "out")
    settings = Settings(trees=5, depth=4, n_components=4)
    summary = run_analysis(spark, source, out, offline_complete, settings, thresholds=[0.5, 0.8])
    assert summary["total_items"] == 24 and summary["clusters"] >= 1
    final = spark.read.parquet(f"{out}/processed_data")
    assert final.count() == 24 and {"most_similar_sku", "cluster", "enriched_description"} <= set(final.columns)
    assert spark.read.json(f"{out}/similarity_statistics.json").count() == 2
    assert files.exists(spark, f"{out}/charts/layout") and files.exists(spark, f"{out}/cluster_results/metrics")
    assert files.exists(spark, f"{out}/models/main")
    for name in ("combined", "sku", "desc"):
        assert files.exists(spark, f"{out}/similarity/{name}")
    asked = spark.read.json(f"{out}/request_statistics.json").first()
    assert asked.total_requests == asked.successful_requests + asked.failed_requests >= 24
    assert spark.read.json(f"{out}/enrichment_statistics.json").first().total == 24
    method, parameters, labels, vectors = files.load_clusters(spark, f"{out}/cluster_results")
    assert method == "dbscan" and parameters["min_neighbours"] == settings.min_neighbours
    assert labels.count() == vectors.count() == 24 and set(labels.columns) == {S.ROW, "cluster"}
    with pytest.raises(FileNotFoundError):
        files.load_clusters(spark, f"{out}/nowhere")


def test_a_run_that_was_killed_asks_open_prompts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(completion, "PROMPTS_PER_CALL", 1)
    monkeypatch.setattr(completion, "CALLS_PER_WAVE", 1)
    items = cleaning.clean_items(files.read_items(spark, write_csv(tmp_path / "items.csv", item_lines(12))))
    folder = files.answer_folder(str(tmp_path / "out"), "v1")
    calls = completion.Calls(2, folder)

    def service(dies):
        asked = spark.sparkContext.accumulator(0)

        def complete(prompts):
            if dies and any("AB-007" in p for p in prompts):
                raise SystemExit  # takes the worker along
            asked.add(len(prompts))
            return offline_complete(prompts)

        return complete, asked

    with pytest.raises(Exception):
        enrich(items, service(True)[0], Settings(), calls).count()
    kept = completion.asked_prompts(spark, folder).where("status = 'ok'").count()
    assert 0 < kept < 12
    complete, asked = service(False)
    assert enrich(items, complete, Settings(), calls).where("enriched_description <> 'Unknown'").count() == 12
    assert asked.value == 12 - kept
    complete, asked = service(False)
    assert enrich(items, complete, Settings(), calls).count() == 12 and asked.value == 0


def test_first_rows(spark):
    frame = spark.range(50).toDF(S.ROW).repartition(5)
    assert [r.row_id for r in files.head_subset(frame, 3).collect()] == [0, 1, 2]


def test_a_run_that_dies_leaves_other_marks_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda n: lambda: spark.range(n)
    assert files.stage_or_resume(spark, path, "first", rows(3)).count() == 3

    def dies():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.stage_or_resume(spark, path, "second", dies)
    (tmp_path / "s").mkdir(exist_ok=True)
    assert files.stage_or_resume(spark, path, "first", dies).count() == 3
    assert files.stage_or_resume(spark, path, "second", rows(5)).count() == 5
    assert files.stage_or_resume(spark, path, "first", dies).count() == 3
