"""Supervised categories: training, prediction, routing of uncertain rows."""

from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import clustering, features, keyed_forest
from partatlas.operators.cleaning import validate_model_input
from partatlas.operators.index import ItemIndex
from partatlas.staging import stage

MAX_DEPTH = 30  # the deepest trees Spark grows
SEED = 42

PREDICTION_DEFAULTS = {
    "predicted_main_category": S.UNKNOWN,
    "predicted_sub_category": S.UNKNOWN,
    "main_category_confidence": 0.0,
    "sub_category_confidence": 0.0,
    "categorization_reason": "",
}

# The reasons a finished row can carry.
REASON_MODEL = "ML prediction"
REASON_COMPLETION = "Used GPT (ML not trained or low confidence)"
REASON_FAILED = "GPT failed"


@dataclass
class CategoryModel:
    """Everything a prediction needs.

    `main_labels` is (value, label), `subs` the trees of all main categories with several
    sub-categories, keyed by the label of the main category, `sub_labels` (key, value, label).
    """

    text: features.TextFeatures
    scale: tuple
    kmeans: KMeansModel
    main: RandomForestClassificationModel
    main_labels: DataFrame
    subs: DataFrame
    sub_labels: DataFrame


def init_predictions(items: DataFrame) -> DataFrame:
    return items.withColumns({name: F.lit(value) for name, value in PREDICTION_DEFAULTS.items()})


def sub_model_eligibility(items: DataFrame) -> DataFrame:
    """Main categories with the number of their sub-categories; two or more get a model."""
    known = items.where(F.col(S.MAIN).isNotNull())
    return (
        known.groupBy(S.MAIN)
        .agg(F.count_distinct(F.coalesce(F.col(S.SUB), F.lit(S.UNKNOWN))).alias("n_sub"), F.count(F.lit(1)).alias("n"))
        .withColumn("eligible", F.col("n_sub") >= 2)
    )


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024
    )


def scaled(frame: DataFrame, scale: tuple) -> DataFrame:
    arrays = frame.withColumn("features", vector_to_array("features"))
    return features.scaled(arrays, scale).withColumn("features", array_to_vector("features"))


def _sub_labels(known: DataFrame) -> DataFrame:
    """(key, value, label) of the sub-categories of main categories that have several, in sorted order."""
    found = known.select("key", F.col("sub").alias("value")).distinct()
    several = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    # the window sees each sub-category of a main category once
    order = Window.partitionBy("key").orderBy("value")
    return found.join(several, "key", "left_semi").withColumn("label", F.row_number().over(order) - 1)


def train(
    items: DataFrame,
    trees: int = S.FOREST_TREES,
    depth: int = MAX_DEPTH,
    seed: int = SEED,
    max_features: int = S.TFIDF_MAX_FEATURES,
    n_components: int = S.SVD_COMPONENTS,
    clusters: int = S.KMEANS_CLUSTERS,
) -> CategoryModel:
    """Text features, k-means, one forest for main and one per eligible main category.

    The main forest and k-means are distributed fits over the staged feature table; the forests
    of all main categories are grown in one grouped pass.
    """
    validate_model_input(items)
    index = ItemIndex(items)
    text = features.fit_text_features(index, max_features, n_components)
    main_labels = stage(features.label_encode(items, S.MAIN))
    categories = items.select(
        S.ROW,
        F.coalesce(F.col(S.MAIN), F.lit(S.UNKNOWN)).alias("value"),
        F.coalesce(F.col(S.SUB), F.lit(S.UNKNOWN)).alias("sub"),
    ).join(main_labels, "value")
    labelled = categories.select(S.ROW, "sub", F.col("label").alias("key"), F.col("label").cast("double").alias("label"))
    frame = stage(features.item_features(index, text).join(labelled, S.ROW))
    scale = features.fit_scale(frame)
    means = clustering.kmeans(scaled(frame, scale), clusters)
    main = _forest(trees, depth, seed).fit(frame)
    sub_labels = stage(_sub_labels(frame))
    known = frame.drop("label").join(sub_labels.withColumnRenamed("value", "sub"), ["key", "sub"])
    rows = known.select("key", S.ROW, "label", vector_to_array("features").alias("features"))
    subs = stage(keyed_forest.train_forests(rows, trees, depth, seed))
    return CategoryModel(text, scale, means, main, main_labels, subs, sub_labels)


def predict_main(frame: DataFrame, model: CategoryModel) -> DataFrame:
    """`frame` with main_number, the most probable main category and its probability."""
    names = model.main_labels.select(F.col("label").alias("main_number"), F.col("value").alias("predicted_main_category"))
    return (
        model.main.transform(frame)
        .withColumn("main_number", F.col("prediction").cast("int"))
        .withColumn("main_category_confidence", F.array_max(vector_to_array("probability")))
        .drop("rawPrediction", "probability", "prediction")
        .join(names, "main_number")
    )


def predict_sub(frame: DataFrame, model: CategoryModel, threshold: float = S.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Rows with a sure main category go to that category's forest; the others stay Unknown at 0.

    `frame` comes from `predict_main`.
    """
    sure = frame.where(F.col("main_category_confidence") >= threshold)
    rows = sure.select(F.col("main_number").alias("key"), S.ROW, vector_to_array("features").alias("features"))
    names = model.sub_labels.select("key", "label", F.col("value").alias("predicted_sub_category"))
    found = keyed_forest.score_forests(rows, model.subs).join(names, ["key", "label"]).select(
        S.ROW, "predicted_sub_category", F.col("confidence").alias("sub_category_confidence")
    )
    unknown = {"predicted_sub_category": S.UNKNOWN, "sub_category_confidence": 0.0}
    return frame.join(found, S.ROW, "left").fillna(unknown).drop("main_number")


def predict_cluster(frame: DataFrame, model: CategoryModel) -> DataFrame:
    return model.kmeans.transform(scaled(frame, model.scale)).select(S.ROW, "cluster")


def predict(items: DataFrame, model: CategoryModel, threshold: float = S.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Items with cluster, predicted categories, confidences, originals and change flags."""
    validate_model_input(items)
    frame = stage(features.item_features(ItemIndex(items), model.text))
    main = stage(predict_main(frame, model))
    found = predict_sub(main, model, threshold).drop("features")
    clusters = predict_cluster(frame, model)
    return track_changes(items.drop(S.CLUSTER).join(found, S.ROW).join(clusters, S.ROW))


def track_changes(items: DataFrame, main: str = "predicted_main_category", sub: str = "predicted_sub_category") -> DataFrame:
    return items.withColumns(
        {
            "original_main_category": F.col(S.MAIN),
            "original_sub_category": F.col(S.SUB),
            "main_category_changed": ~F.col(main).eqNullSafe(F.col(S.MAIN)),
            "sub_category_changed": ~F.col(sub).eqNullSafe(F.col(S.SUB)),
        }
    )


def route_low_confidence(items: DataFrame, threshold: float = S.CONFIDENCE_THRESHOLD, trained: bool = True) -> DataFrame:
    """`needs_completion`: nothing trained, a confidence below the threshold, or a prediction Unknown."""
    uncertain = (
        (F.col("main_category_confidence") < threshold)
        | (F.col("predicted_main_category") == S.UNKNOWN)
        | (F.col("sub_category_confidence") < threshold)
        | (F.col("predicted_sub_category") == S.UNKNOWN)
    )
    return items.withColumn("needs_completion", uncertain if trained else F.lit(True))


def adopt_predictions(items: DataFrame) -> DataFrame:
    return items.withColumns({S.MAIN: F.col("predicted_main_category"), S.SUB: F.col("predicted_sub_category")})


def failures(items: DataFrame) -> DataFrame:
    return items.where(F.col("predicted_main_category") == S.UNKNOWN)


def save_model(model: CategoryModel, path: str, spark) -> None:
    """Models as Spark ML folders, tables as parquet."""
    root = PurePosixPath(path) if "://" not in path else path.rstrip("/")
    at = lambda name: f"{root}/{name}"
    basis = [(k, row.tolist()) for k, row in enumerate(model.text.basis)]
    facts = [(model.text.max_features, model.text.n_components, *model.scale)]
    tables = {
        "terms": model.text.terms,
        "basis": spark.createDataFrame(basis, "position bigint, row array<double>"),
        "settings": spark.createDataFrame(
            facts, "max_features int, n_components int, means array<double>, deviations array<double>"
        ),
        "main_labels": model.main_labels,
        "subs": model.subs,
        "sub_labels": model.sub_labels,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(at(name))
    model.kmeans.write().overwrite().save(at("kmeans"))
    model.main.write().overwrite().save(at("main"))


def load_model(path: str, spark) -> CategoryModel:
    at = lambda name: f"{path.rstrip('/')}/{name}"
    settings = spark.read.parquet(at("settings")).first()
    basis = sorted(spark.read.parquet(at("basis")).collect())
    matrix = np.array([r["row"] for r in basis]) if basis else np.zeros((0, 0))
    text = features.TextFeatures(
        spark.read.parquet(at("terms")), matrix, settings["max_features"], settings["n_components"]
    )
    return CategoryModel(
        text,
        (settings["means"], settings["deviations"]),
        KMeansModel.load(at("kmeans")),
        RandomForestClassificationModel.load(at("main")),
        *(spark.read.parquet(at(name)) for name in ("main_labels", "subs", "sub_labels")),
    )
