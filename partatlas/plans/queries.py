"""One query per operator over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.functions import text
from partatlas.operators import (
    categorize,
    charts,
    cleaning,
    cluster_metrics,
    clustering,
    completion,
    features,
    graph,
    similarity,
    statistics,
)
from partatlas.operators.index import ItemIndex
from partatlas.plans import views
from partatlas.plans.analysis import Settings, assign_categories, run_analysis
from partatlas.sources import files
from partatlas.staging import new_path, stage

THRESHOLDS = [0.7, 0.8, 0.9]
VECTOR_THRESHOLD = 0.4  # the embeddings have no denser neighbourhoods


def raw(spark, d):
    return views.items_raw(spark, d)


def items(spark, d):
    return cleaning.clean_items(raw(spark, d), views.BRAND_NAMES)


def docs(spark, d):
    return views.items_docs(spark, d)


def predicted(spark, d):
    return views.items_predicted(spark, d)


def clustered(spark, d):
    return views.items_clustered(spark, d)


def parts_index(spark, d):
    return ItemIndex(items(spark, d))


def docs_index(spark, d):
    return ItemIndex(docs(spark, d))


def _labels(spark, d):
    return clustered(spark, d).select("row_id", "cluster")


# --- cleaning -----------------------------------------------------------------


def clean_filter(spark, d):
    return cleaning.drop_invalid_catalog(raw(spark, d))


def fill_defaults(spark, d):
    return cleaning.fill_defaults(cleaning.cast_keys(cleaning.ensure_columns(raw(spark, d))))


def ensure_columns(spark, d):
    """Parts of a file that has neither descriptions nor sub-categories."""
    return cleaning.ensure_columns(raw(spark, d).drop("description", "sub_category"))


def map_manufacturer(spark, d):
    return cleaning.map_manufacturer(raw(spark, d), views.BRAND_NAMES).select("row_id", "mfr_code")


def extract_manufacturer(spark, d):
    return cleaning.extract_manufacturer(raw(spark, d), views.TYPE_PREFIXES).select(
        "row_id", "catalog_no", "manufacturer"
    )


def item_columns(spark, d):
    return cleaning.item_columns(items(spark, d))


def validation_report(spark, d):
    return cleaning.validation_report(raw(spark, d))


def choose_text(spark, d):
    return cleaning.choose_text(raw(spark, d)).select("row_id", "text")


def trainable_rows(spark, d):
    return cleaning.trainable_rows(raw(spark, d))


def init_predictions(spark, d):
    return categorize.init_predictions(items(spark, d))


def adopt_predictions(spark, d):
    return categorize.adopt_predictions(predicted(spark, d)).select("row_id", "main_category", "sub_category")


def enrichment_coverage(spark, d):
    half = raw(spark, d).withColumn("enriched_description", F.when(F.col("row_id") % 10 != 3, F.col("description")))
    return cleaning.enrichment_coverage(half)


def head_subset(spark, d):
    return files.head_subset(raw(spark, d))


def failures(spark, d):
    return categorize.failures(predicted(spark, d))


# --- statistics ---------------------------------------------------------------


def dataset_statistics(spark, d):
    return statistics.dataset_statistics(raw(spark, d).drop("mfr_code"), views.TYPE_PREFIXES)


def cleaning_report(spark, d):
    return statistics.cleaning_report(raw(spark, d), views.BRAND_NAMES)


def manufacturer_distribution(spark, d):
    return statistics.value_counts(items(spark, d), S.MFR)


def category_distribution(spark, d):
    return statistics.value_counts(items(spark, d), S.MAIN)


def subcategory_distribution(spark, d):
    return statistics.value_counts(items(spark, d), S.SUB)


def distributions(spark, d):
    return statistics.distributions(items(spark, d), [S.MFR, S.MAIN, S.SUB])


def cluster_distribution(spark, d):
    return statistics.cluster_distribution(clustered(spark, d))


def top_subcategories(spark, d):
    return statistics.top_subcategories(items(spark, d))


def category_cluster_crosstab(spark, d):
    return statistics.category_cluster_crosstab(clustered(spark, d), list(range(-1, 9)))


def category_cluster_counts(spark, d):
    return statistics.category_cluster_counts(clustered(spark, d))


def chart_statistics(spark, d):
    return statistics.chart_statistics(clustered(spark, d))


def category_changes(spark, d):
    return categorize.track_changes(predicted(spark, d)).select(
        "row_id", "original_main_category", "original_sub_category", "main_category_changed", "sub_category_changed"
    )


def category_change_stats(spark, d):
    return statistics.category_change_stats(categorize.track_changes(predicted(spark, d)))


def routing_stats(spark, d):
    routed = categorize.route_low_confidence(predicted(spark, d))
    return statistics.routing_stats(completion.llm_fallback(routed, completion.offline_complete))


def enrichment_stats(spark, d):
    return statistics.enrichment_stats(completion.enrich_descriptions(items(spark, d), completion.offline_complete)[0])


def request_stats(spark, d):
    return statistics.request_stats(complete_text(spark, d))


def run_summary(spark, d):
    return statistics.run_summary(clustered(spark, d))


# --- similarity ---------------------------------------------------------------


def tokenize(spark, d):
    return similarity.tokenize(docs_index(spark, d))


def tfidf_weights(spark, d):
    return similarity.tfidf_weights(docs_index(spark, d))


def vocabulary_topk(spark, d):
    return similarity.vocabulary_topk(docs_index(spark, d))


def description_similarity_pairs(spark, d):
    return similarity.description_similarity_pairs(docs_index(spark, d))


def sku_similarity_pairs(spark, d):
    return similarity.sku_similarity_pairs(parts_index(spark, d)).select(
        "row_i", "row_j", "catalog_no_i", "catalog_no_j", "sku_sim", "row_pairs"
    )


def combined_similarity(spark, d):
    return similarity.similar_pairs(parts_index(spark, d), 0.7).select(
        "row_i", "row_j", "sku_sim", "desc_sim", "combined"
    )


def similar_pairs(spark, d):
    return similarity.similar_pairs(parts_index(spark, d)).select(
        "row_i", "row_j", "catalog_no_i", "catalog_no_j", "combined", "n_i", "n_j", "row_pairs"
    )


def similar_pairs_detail(spark, d):
    index = parts_index(spark, d)
    return similarity.similar_pairs_detail(index, similarity.similar_pairs(index))


def similar_row_pairs(spark, d):
    index = parts_index(spark, d)
    return similarity.expand_rows(index, similarity.similar_pairs(index))


def item_similarity_profile(spark, d):
    return similarity.item_similarity_profile(parts_index(spark, d)).select(
        "catalog_no", "average_similarity", "high_similarity_average"
    )


def best_sku_match(spark, d):
    return similarity.best_sku_match(parts_index(spark, d))


def best_description_match(spark, d):
    return similarity.best_description_match(docs_index(spark, d))


def per_item_stats(spark, d):
    index = parts_index(spark, d)
    return similarity.per_item_stats(
        index, similarity.item_similarity_profile(index), similarity.best_description_match(index)
    )


def similarity_columns(spark, d):
    index = parts_index(spark, d)
    profile = similarity.item_similarity_profile(index)
    best = similarity.best_description_match(index)
    return similarity.with_similarity_columns(index, profile, best).drop("description", "main_category", "sub_category", "mfr_code")


def similarity_lookup(spark, d):
    """Every part's catalogue number against the one of the next key, known or not."""
    table = raw(spark, d)
    named = table.select(F.col("row_id").alias("k"), F.col("catalog_no").alias("catalog_no_i"))
    after = table.select((F.col("row_id") - 1).alias("k"), F.coalesce("catalog_no", F.lit("none")).alias("catalog_no_j"))
    asked = named.where(F.col("catalog_no_i").isNotNull()).join(after, "k").select("catalog_no_i", "catalog_no_j")
    return similarity.similarity_lookup(items(spark, d), asked.distinct())


def similarity_statistics(spark, d):
    index = parts_index(spark, d)
    profile = similarity.item_similarity_profile(index)
    return similarity.similarity_statistics(index, S.SIMILARITY_THRESHOLD, profile)


def threshold_sweep(spark, d):
    return similarity.threshold_sweep(parts_index(spark, d), THRESHOLDS)


# --- graph --------------------------------------------------------------------


def graph_vertices(spark, d):
    return graph.graph_vertices(items(spark, d))


def graph_edges(spark, d):
    return graph.graph_edges(similarity.similar_pairs(parts_index(spark, d)))


def network_edges(spark, d):
    index = parts_index(spark, d)
    above = similarity.similar_pairs(index, S.NETWORK_THRESHOLD, strict=True)
    return graph.network_edges(above, graph.graph_vertices(index.items))


def network_stars(spark, d):
    return similarity.network_stars(parts_index(spark, d)).drop("head", "text_id")


def connected_components(spark, d):
    index = parts_index(spark, d)
    edges = similarity.catalog_links(index, similarity.similar_pairs(index))
    return graph.connected_components(edges)


def cluster_graph_metrics(spark, d):
    return cluster_metrics.cluster_graph_metrics(_labels(spark, d))


# --- features and models ------------------------------------------------------


def sku_features(spark, d):
    return docs(spark, d).select("row_id", *[c.alias(n) for n, c in text.sku_features(F.col("catalog_no")).items()])


def truncated_svd(spark, d):
    index = docs_index(spark, d)
    return features.text_features(index, features.fit_text_features(index)).select("row_id", "features")


def _limited(spark, d, max_features):
    index = docs_index(spark, d)
    terms = stage(features.limited_terms(index, max_features))
    return terms, stage(features.tfidf_features(index.postings, terms))


def tfidf_features(spark, d):
    terms, vectors = _limited(spark, d, S.TFIDF_MAX_FEATURES)
    entries = vectors.select("text_id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    named = entries.join(F.broadcast(terms), F.col("e.terms") == F.col("position"))  # at most max_features rows
    return named.select("text_id", "term", F.round("e.weights", 9).alias("weight"))


def gram_matrix(spark, d):
    """Products of the hundred most frequent terms over all documents."""
    terms, vectors = _limited(spark, d, 100)
    rows = features.gram_matrix(vectors, terms.count())
    pairs = rows.select("position", F.posexplode("products").alias("other", "product"))
    first = terms.select(F.col("position").alias("i"), F.col("term").alias("term_i"))
    second = terms.select(F.col("position").alias("j"), F.col("term").alias("term_j"))
    return (
        pairs.where("position <= other AND product > 0")
        .join(F.broadcast(first), F.col("position") == F.col("i"))  # a hundred rows
        .join(F.broadcast(second), F.col("other") == F.col("j"))
        .select("term_i", "term_j", F.round("product", 6).alias("product"))
    )


def standard_scale(spark, d):
    scaled = features.standard_scale(views.item_vectors(spark, d).select("row_id", "features"))
    return scaled.select("row_id", F.posexplode("features").alias("position", "value")).select(
        "row_id", "position", F.round("value", 6).alias("value")
    )


def label_encode(spark, d):
    return features.label_encode(items(spark, d), S.MAIN)


def sub_model_eligibility(spark, d):
    return categorize.sub_model_eligibility(items(spark, d))


def category_predictions(spark, d):
    table = docs(spark, d)
    model = categorize.train(cleaning.trainable_rows(table))
    return categorize.predict(table, model).drop("description")


def route_low_confidence(spark, d):
    return categorize.route_low_confidence(predicted(spark, d)).select("row_id", "needs_completion")


def assigned_categories(spark, d):
    return assign_categories(docs(spark, d), Settings(), completion.offline_complete).drop("description")


# --- completion ---------------------------------------------------------------


def enrichment_prompt(spark, d):
    table = items(spark, d)
    return table.select("row_id", completion.enrichment_prompt(table).alias("prompt"))


def category_prompts(spark, d):
    return completion.category_prompts(items(spark, d), "main_category")


def category_prompts_short(spark, d):
    return completion.category_prompts(items(spark, d), "main_category", short=True)


def complete_text(spark, d):
    table = docs(spark, d)
    prompts = table.select("row_id", completion.main_prompt(table, short=True).alias("prompt"))
    return completion.complete_text(prompts, completion.offline_complete).select("row_id", "result", "status")


def enrich_descriptions(spark, d):
    return completion.enrich_descriptions(items(spark, d), completion.offline_complete)[0].select("row_id", "enriched_description")


def llm_fallback(spark, d):
    routed = categorize.route_low_confidence(predicted(spark, d))
    return completion.llm_fallback(routed, completion.offline_complete).select(
        "row_id",
        "predicted_main_category",
        "predicted_sub_category",
        "main_category_confidence",
        "sub_category_confidence",
        "categorization_reason",
    )


def fallback_uncertain_parts(spark, d):
    return completion.fallback_uncertain_parts(predicted(spark, d), completion.offline_complete).select(
        "row_id",
        "predicted_main_category",
        "predicted_sub_category",
        "main_category_confidence",
        "sub_category_confidence",
    )


def reevaluate_categories(spark, d):
    return completion.reevaluate_categories(items(spark, d), completion.offline_complete).select(
        "row_id", "llm_main_category", "llm_sub_category", "main_category_changed", "sub_category_changed"
    )


# --- clustering ---------------------------------------------------------------


def neighbour_pairs(spark, d):
    return clustering.neighbour_pairs(clustering.VectorIndex(views.item_vectors(spark, d)), VECTOR_THRESHOLD)


def dbscan(spark, d):
    return clustering.dbscan(clustering.VectorIndex(views.item_vectors(spark, d)), VECTOR_THRESHOLD)


def kmeans_assign(spark, d):
    return clustering.kmeans_assign(views.item_vectors(spark, d))


def cluster_summary(spark, d):
    return cluster_metrics.cluster_summary(_labels(spark, d))


def cluster_sizes(spark, d):
    return cluster_metrics.cluster_sizes(_labels(spark, d))


def cluster_category_profile(spark, d):
    return cluster_metrics.cluster_category_profile(clustered(spark, d))


def silhouette(spark, d):
    return cluster_metrics.silhouette(_labels(spark, d), views.item_vectors(spark, d))


def calinski_harabasz(spark, d):
    return cluster_metrics.calinski_harabasz(_labels(spark, d), views.item_vectors(spark, d))


def davies_bouldin(spark, d):
    return cluster_metrics.davies_bouldin(_labels(spark, d), views.item_vectors(spark, d))


def all_cluster_metrics(spark, d):
    return cluster_metrics.cluster_metrics(_labels(spark, d), views.item_vectors(spark, d)).withColumn(
        "avg_degree", F.round("avg_degree", 6)
    )


def analyze_clusters(spark, d):
    """All tables of a cluster analysis as (part, key, value)."""
    tables = cluster_metrics.analyze_clusters(clustered(spark, d), _labels(spark, d), views.item_vectors(spark, d))
    measures = ["silhouette", "calinski_harabasz", "davies_bouldin", "avg_degree", "num_components", "largest_component"]

    def wide(name, columns):
        entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns])
        return tables[name].select(F.lit(name).alias("part"), F.explode(entries).alias("e")).select("part", "e.*")

    sizes = tables["sizes"].select(F.lit("sizes").alias("part"), F.col("cluster").cast("string").alias("key"), F.col("size").cast("double").alias("value"))
    profile = tables["categories"].select(
        F.lit("categories").alias("part"), F.concat_ws("/", "cluster", "level", "category").alias("key"), F.col("n").cast("double").alias("value")
    )
    every = wide("summary", ["n_clusters", "n_noise", "n_items"]).unionByName(wide("metrics", measures)).unionByName(sizes).unionByName(profile)
    return every.withColumn("value", F.round("value", 6))


def attach_clusters(spark, d):
    return clustering.attach_clusters(views.item_vectors(spark, d).drop("features"), _labels(spark, d))


def layout_of_vectors(spark, d):
    return charts.layout_of_vectors(views.item_vectors(spark, d))


def layout_of_similarity(spark, d):
    return charts.layout_of_similarity(parts_index(spark, d))


def chart_tables(spark, d):
    """Every chart table of the parts, with clusters by their brand, and its number of rows."""
    table = items(spark, d).withColumn("cluster", F.length("sub_category"))
    index = ItemIndex(table)
    above = similarity.similar_pairs(index, S.NETWORK_THRESHOLD, strict=True)
    tables = charts.chart_tables(table, above, charts.layout_of_similarity(index))
    counts = [t.agg(F.lit(name).alias("chart"), F.count(F.lit(1)).alias("n_rows")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def run_pipeline(spark, d):
    """The whole analysis of the parts, from a file to its result tables, as counts read from these."""
    source, out = f"{new_path(spark)}.parquet", new_path(spark)
    files.write_items(raw(spark, d), source)
    settings = Settings(trees=5, depth=5, n_components=8, completion_version="offline")
    run_analysis(
        spark, source, out, completion.offline_complete, settings, thresholds=THRESHOLDS, names=views.BRAND_NAMES, key="row_id"
    )
    one = lambda name, column, value: spark.read.json(f"{out}/{name}.json").select(F.lit(column).alias("name"), value.cast("long").alias("value"))
    rows = lambda name: spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("value"))
    swept = spark.read.json(f"{out}/similarity_statistics.json").select(
        F.explode(
            F.array(
                *[
                    F.struct(F.format_string("%s at %.1f", F.lit(c), "threshold").alias("name"), F.col(c).cast("long").alias("value"))
                    for c in ("similar_pairs", "connected_components", "largest_component_size")
                ]
            )
        ).alias("e")
    ).select("e.*")
    found = [
        rows("processed_data"),
        rows("similarity/combined"),
        rows("similarity/sku"),
        rows("similarity/desc"),
        rows("charts/network_vertices"),
        rows("charts/network_edges"),
        rows("cluster_results/assignments"),
        one("enrichment_statistics", "enriched", F.col("enriched")),
        swept,
    ]
    return reduce(DataFrame.unionByName, found)


QUERIES = {
    f.__name__: f
    for f in (
        clean_filter, fill_defaults, map_manufacturer, extract_manufacturer, item_columns, validation_report,
        choose_text, trainable_rows, init_predictions, adopt_predictions, enrichment_coverage, head_subset, failures,
        dataset_statistics, cleaning_report, manufacturer_distribution, category_distribution,
        subcategory_distribution, distributions, cluster_distribution, top_subcategories, category_cluster_crosstab,
        category_cluster_counts, chart_statistics, category_changes, category_change_stats, routing_stats,
        enrichment_stats, request_stats, run_summary, tokenize, tfidf_weights, vocabulary_topk,
        description_similarity_pairs, sku_similarity_pairs, combined_similarity, similar_pairs, similar_pairs_detail,
        similar_row_pairs, item_similarity_profile, best_sku_match, best_description_match, per_item_stats,
        similarity_columns, similarity_lookup, similarity_statistics, threshold_sweep, graph_vertices, graph_edges,
        network_edges, connected_components, cluster_graph_metrics, sku_features, truncated_svd, standard_scale,
        label_encode, sub_model_eligibility, category_predictions, route_low_confidence, assigned_categories,
        enrichment_prompt, category_prompts, category_prompts_short, complete_text, enrich_descriptions, llm_fallback,
        fallback_uncertain_parts, reevaluate_categories, neighbour_pairs, dbscan, kmeans_assign, cluster_summary,
        cluster_sizes, cluster_category_profile, silhouette, calinski_harabasz, davies_bouldin, all_cluster_metrics,
        attach_clusters, layout_of_vectors, layout_of_similarity, ensure_columns, tfidf_features, gram_matrix,
        analyze_clusters, chart_tables, run_pipeline, network_stars,
    )
}
QUERIES["clean_items"] = items
QUERIES["cluster_metrics"] = QUERIES.pop("all_cluster_metrics")
QUERIES["assign_categories"] = QUERIES.pop("assigned_categories")
