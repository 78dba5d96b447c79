"""Item tables derived from the benchmark tables.

Nulls, "EMPTY" and repeated catalogue numbers are put in by key, because the
tables have none.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule tables for these views.
BRAND_NAMES = {f"Brand#{k}": f"Maker {k}" for k in range(1, 6)}
TYPE_PREFIXES = {"ECONOMIC": ["ECO"], "PROMOTED": ["PRO"], "REGULAR": ["STA"]}


def _key_is(modulus, rest, column="p_partkey"):
    return F.col(column) % modulus == rest


def items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as uncleaned items."""
    key = F.col("p_partkey").cast("long")
    number = key - F.when(_key_is(37, 1), 1).otherwise(0)
    catalog = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.lpad(number.cast("string"), 6, "0"))

    def unless(modulus, rest, column):
        return F.when(~_key_is(modulus, rest), F.col(column))

    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("row_id"),
        F.when(_key_is(29, 7), F.lit(None)).when(_key_is(31, 5), F.lit("EMPTY")).otherwise(catalog).alias("catalog_no"),
        unless(17, 3, "p_name").alias("description"),
        unless(19, 4, "p_type").alias("main_category"),
        unless(23, 6, "p_brand").alias("sub_category"),
        unless(13, 2, "p_brand").alias("mfr_code"),
    )


def items_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the whole text is the description."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("row_id"),
        F.concat("source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("catalog_no"),
        F.col("text").alias("description"),
        F.col("lang").alias("main_category"),
        F.col("source").alias("sub_category"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as items with a feature vector."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("string").alias("main_category"),
        (F.col("vec_id") % 7).cast("string").alias("sub_category"),
    )


def items_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned parts with predictions and confidences derived from their keys and sizes."""
    from partatlas.operators.cleaning import clean_items

    key = F.col("row_id")
    guess = (
        F.when(key % 11 == 0, F.lit("Unknown")).when(key % 5 == 1, F.lit("SMALL")).otherwise(F.col("main_category"))
    )
    return clean_items(items_raw(spark, sf_dir), BRAND_NAMES).withColumns(
        {
            "predicted_main_category": guess,
            "main_category_confidence": (key * 7 % 100) / 100.0,
            "predicted_sub_category": F.when(key % 13 == 0, F.lit("Unknown")).otherwise(F.col("sub_category")),
            "sub_category_confidence": (key * 3 % 100) / 100.0,
            "categorization_reason": F.lit("ML prediction"),
        }
    )


def items_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label as cluster; label 9 counts as noise."""
    label = F.col("main_category").cast("int")
    return item_vectors(spark, sf_dir).withColumn("cluster", F.when(label == 9, F.lit(-1)).otherwise(label))
