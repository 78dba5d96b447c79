import pytest

from partatlas import schema as S
from partatlas.operators import cleaning, statistics

NAMES = "row_id long, catalog_no string, description string, main_category string, sub_category string, mfr_code string"


def frame(spark, rows, names=NAMES):
    return spark.createDataFrame(rows, names)


def test_invalid_catalogue_numbers_are_dropped(spark):
    rows = [(1, None, "a", "m", "s", "x"), (2, "EMPTY", "a", "m", "s", "x"), (3, "empty", "a", "m", "s", "x"), (4, " ", "a", "m", "s", "x")]
    kept = cleaning.drop_invalid_catalog(frame(spark, rows)).collect()
    assert [r.row_id for r in kept] == [3, 4]


def test_defaults_and_names(spark):
    rows = [(1, "A1", None, None, None, None), (2, "A2", "d", "m", "s", "LEV"), (3, "A3", "d", "m", "s", "other")]
    got = cleaning.clean_items(frame(spark, rows)).orderBy("row_id").collect()
    assert (got[0].description, got[0].main_category, got[0].sub_category) == ("Unknown", "Uncategorized", "Uncategorized")
    assert [r.mfr_code for r in got] == ["Unknown", "Leviton", "other"]


def test_missing_columns_are_added(spark):
    got = cleaning.clean_items(frame(spark, [(1, "A1")], "row_id long, catalog_no string")).first()
    assert (got.description, got.main_category, got.mfr_code) == ("Unknown", "Unknown", "Unknown")


def test_every_prefix_of_the_rule_table(spark):
    rules = [(prefix, name) for name, prefixes in S.MANUFACTURER_PREFIXES.items() for prefix in prefixes]
    first = [(p, next(n for q, n in rules if p.startswith(q))) for p, _ in rules]  # a rule may begin with another
    cases = [(p + tail, n) for p, n in first for tail in ("", "-77", "X")]
    cases += [(p.lower() + "q", n) for p, n in first] + [(" " + p, "Unknown") for p, _ in rules[:3]]
    cases += [("", "Unknown"), ("~1", "Unknown"), (None, "Unknown")]
    numbered = [(k, c) for k, (c, _) in enumerate(cases)]
    got = cleaning.extract_manufacturer(frame(spark, numbered, "row_id long, catalog_no string")).orderBy("row_id").collect()
    assert [(r.catalog_no, r.manufacturer) for r in got] == cases


def test_validation(spark):
    good = frame(spark, [(1, "A", "d", "m", "s", None)])
    cleaning.validate_model_input(good)
    assert cleaning.validate_required(good) and not cleaning.validate_required(good.drop("description"))
    with pytest.raises(ValueError, match="Missing required columns"):
        cleaning.validate_model_input(good.drop("main_category"))
    with pytest.raises(ValueError, match="Empty DataFrame"):
        cleaning.validate_model_input(good.limit(0))
    with pytest.raises(ValueError, match="All descriptions are missing"):
        cleaning.validate_model_input(frame(spark, [(1, "A", None, "m", "s", None)]))


def test_enrichment_gate(spark):
    rows = [(k, "x" if k < 8 else None) for k in range(10)]
    at_limit = frame(spark, rows, "row_id long, enriched_description string")
    assert cleaning.needs_enrichment(at_limit)
    assert not cleaning.needs_enrichment(at_limit.where("row_id < 9"))
    assert cleaning.needs_enrichment(at_limit.drop(S.ENRICHED))


def test_statistics_of_small_frames(spark):
    rows = [(1, "A1", "d", "m", "s", "x"), (2, None, None, "m", None, None), (3, "EMPTY", "d", None, "s", "x")]
    report = statistics.cleaning_report(frame(spark, rows)).first()
    assert (report.rows_removed, report.rows_kept, report.unique_skus) == (2, 1, 1)
    counts = {(r.metric, r.key): r.value for r in statistics.distributions(frame(spark, rows), [S.MAIN, S.MFR]).collect()}
    assert counts == {("main_category", "m"): 2, ("mfr_code", "x"): 2}


def test_routing_percentage_is_null_when_nothing_was_sent(spark):
    rows = spark.createDataFrame([(False, False)], "needs_completion boolean, completion_failed boolean")
    assert statistics.routing_stats(rows).first().completion_failed_pct is None
