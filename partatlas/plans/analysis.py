"""The whole analysis as one job: load, enrich, compare, categorise, cluster, report."""

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import (
    categorize,
    charts,
    cleaning,
    cluster_metrics,
    clustering,
    completion,
    features,
    similarity,
    statistics,
)
from partatlas.operators.index import ItemIndex
from partatlas.sources import files
from partatlas.staging import stage


@dataclass
class Settings:
    """Options of a run; the defaults are those of the analysis everyone knows."""

    similarity_threshold: float = S.SIMILARITY_THRESHOLD
    dbscan_eps: float = 1 - S.SIMILARITY_THRESHOLD
    min_neighbours: int = S.DBSCAN_MIN_NEIGHBOURS
    confidence_threshold: float = S.CONFIDENCE_THRESHOLD
    trees: int = S.FOREST_TREES
    depth: int = categorize.MAX_DEPTH
    max_features: int = S.TFIDF_MAX_FEATURES
    n_components: int = S.SVD_COMPONENTS
    kmeans_clusters: int = S.KMEANS_CLUSTERS
    enrichment_share: float = S.ENRICHED_SHARE
    calls_at_once: int = completion.CALLS_AT_ONCE
    # names the completion function and its state; without it no earlier answer or stage of it is used again
    completion_version: str | None = None

    def __post_init__(self):
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold has to lie between 0 and 1")
        if not 0 < self.dbscan_eps <= 1:
            raise ValueError("dbscan_eps has to lie between 0 and 1")
        if self.min_neighbours < 1:
            raise ValueError("min_neighbours has to be at least 1")


def enrich(items: DataFrame, complete: completion.Complete, settings: Settings, calls: completion.Calls) -> DataFrame:
    """Enriched descriptions unless more than the given share of the rows has one."""
    if not cleaning.needs_enrichment(items, settings.enrichment_share):
        return items
    return completion.enrich_descriptions(items, complete, calls)[0]


def assign_categories(
    items: DataFrame,
    settings: Settings,
    complete: completion.Complete,
    model_dir: str | None = None,
    calls: completion.Calls = completion.Calls(),
):
    """Train on known rows, predict all, and send uncertain rows to completion.

    Returns the items with adopted categories. Without a known row everything
    is sent to completion.
    """
    spark = items.sparkSession
    known = cleaning.trainable_rows(items)
    trained = not known.isEmpty()
    if trained:
        model = categorize.train(
            known,
            settings.trees,
            settings.depth,
            categorize.SEED,
            settings.max_features,
            settings.n_components,
            settings.kmeans_clusters,
        )
        if model_dir:
            categorize.save_model(model, model_dir, spark)
        rows = categorize.predict(items, model, settings.confidence_threshold).drop(S.CLUSTER)
        rows = rows.withColumn("categorization_reason", F.lit(categorize.REASON_MODEL))
    else:
        rows = categorize.track_changes(categorize.init_predictions(items))
    routed = categorize.route_low_confidence(rows, settings.confidence_threshold, trained)
    decided = completion.llm_fallback(routed, complete, calls=calls)
    changed = categorize.track_changes(decided)
    return categorize.adopt_predictions(changed)


def cluster_items(items: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(labels, feature vectors) of density clustering on SVD text features."""
    cleaning.validate_model_input(items, S.CLUSTER_COLUMNS)
    index = ItemIndex(items)
    fitted = features.fit_text_features(index, settings.max_features, settings.n_components)
    vectors = stage(features.text_features(index, fitted).select(S.ROW, "features"))
    labels = clustering.dbscan(clustering.VectorIndex(vectors), 1 - settings.dbscan_eps, settings.min_neighbours)
    return stage(labels), vectors


def run_analysis(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    complete: completion.Complete,
    settings: Settings | None = None,
    enrich_texts: bool = True,
    cluster: bool = True,
    chart: bool = True,
    thresholds: list[float] | None = None,
    names: dict[str, str] | None = None,
    columns: dict[str, str] | None = None,
    key: str | None = None,
) -> dict:
    """Run all stages and write their tables under `output_dir`.

    Enrichment and categories are resumed from an earlier run if neither the input nor the
    settings they depend on have changed, and a run that died asks only prompts without a good
    answer. Both hold between runs that name the same `completion_version`. Returns counts
    and timings.
    """
    settings = settings or Settings()
    version = settings.completion_version or f"unnamed-{uuid.uuid4().hex}"
    answers = files.answer_folder(output_dir, version)
    calls = completion.Calls(settings.calls_at_once, answers)
    used = replace(settings, completion_version=version, calls_at_once=completion.CALLS_AT_ONCE)
    timing, started = {}, time.monotonic()

    def timed(name, work):
        begin = time.monotonic()
        result = work()
        timing[name] = time.monotonic() - begin
        return result

    def load():
        return stage(cleaning.clean_items(files.read_items(spark, input_path, columns, key), names))

    items = timed("data_loading", load)
    if enrich_texts:
        mark = files.fingerprint(items, step="enrich", complete=version, share=settings.enrichment_share)
        items = timed(
            "enrichment",
            lambda: files.stage_or_resume(spark, f"{output_dir}/enriched_data", mark, lambda: enrich(items, complete, settings, calls)),
        )
    compared = ItemIndex(items)

    def compare():
        profile = stage(similarity.item_similarity_profile(compared, settings.similarity_threshold))
        best = stage(similarity.best_description_match(compared))
        # searched once, at the lowest score that anything below asks for
        lowest = min([*swept, settings.similarity_threshold, *([S.NETWORK_THRESHOLD] if chart else [])])
        return profile, best, stage(similarity.similar_pairs(compared, lowest))

    swept = thresholds or [settings.similarity_threshold]
    profile, best, found = timed("similarity", compare)
    pairs = found.where(F.col("combined") >= settings.similarity_threshold)
    mark = files.fingerprint(items, step="categorise", settings=repr(used))
    decided = timed(
        "category_assignment",
        lambda: files.stage_or_resume(
            spark,
            f"{output_dir}/categorized_data",
            mark,
            lambda: assign_categories(items, settings, complete, f"{output_dir}/models", calls),
        ),
    )
    final = similarity.with_similarity_columns(compared, profile, best).select(
        S.ROW, *[c for c in similarity_columns()]
    )
    final = decided.join(final, S.ROW)
    labels = vectors = None
    if cluster:
        labels, vectors = timed("clustering", lambda: cluster_items(decided, settings))
        final = clustering.attach_clusters(final, labels)
    final = stage(final)
    if chart:

        def draw():
            above = found.where(F.col("combined") > S.NETWORK_THRESHOLD)
            points = charts.layout_of_similarity(compared)
            files.tables_sink(charts.chart_tables(final, above, points), f"{output_dir}/charts")

        timed("visualization", draw)

    def report():
        files.tables_sink({"processed_data": final}, output_dir)
        categorize.failures(final).write.mode("overwrite").option("header", True).csv(
            f"{output_dir}/categorization_failures.csv"
        )
        matrices = {
            "combined": pairs,
            "sku": similarity.sku_similarity_pairs(compared, settings.similarity_threshold),
            "desc": similarity.description_similarity_pairs(compared, settings.similarity_threshold),
        }
        files.similarity_matrix_sink(matrices, f"{output_dir}/similarity")
        files.similar_pairs_sink(similarity.similar_pairs_detail(compared, pairs), f"{output_dir}/similar_pairs.csv")
        sweep = similarity.threshold_sweep(compared, swept, profile, found)
        files.stats_sink(sweep, f"{output_dir}/similarity_statistics.json")
        files.stats_sink(
            similarity.per_item_stats(compared, profile, best), f"{output_dir}/per_item_statistics.json"
        )
        files.stats_sink(statistics.category_change_stats(final), f"{output_dir}/category_change_statistics.json")
        files.stats_sink(statistics.routing_stats(final), f"{output_dir}/routing_statistics.json")
        if S.ENRICHED in final.columns:
            files.stats_sink(statistics.enrichment_stats(final), f"{output_dir}/enrichment_statistics.json")
        if files.exists(spark, answers):
            log = completion.asked_prompts(spark, answers)
            files.stats_sink(statistics.request_stats(log), f"{output_dir}/request_statistics.json")
        kinds = [S.MAIN, S.SUB, *([S.CLUSTER] if cluster else [])]
        files.stats_sink(statistics.distributions(final, kinds), f"{output_dir}/distribution_statistics.json")
        if cluster:
            chosen = {"eps": settings.dbscan_eps, "min_neighbours": settings.min_neighbours}
            files.save_clusters(f"{output_dir}/cluster_results", "dbscan", chosen, labels, vectors)
            tables = cluster_metrics.analyze_clusters(final, labels, vectors)
            files.tables_sink(tables, f"{output_dir}/cluster_results")

    timed("statistics", report)
    timing["total"] = time.monotonic() - started
    return {**statistics.run_summary(final).first().asDict(), "timing": timing}


def similarity_columns() -> list[str]:
    return [
        "highest_sku_similarity",
        "most_similar_sku",
        "highest_desc_similarity",
        "most_similar_desc_sku",
        "average_similarity",
        "high_similarity_average",
    ]
