"""Counts, distributions and summaries of item tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import cleaning


def dataset_statistics(items: DataFrame, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    if S.MFR not in items.columns:
        items = items.withColumn(S.MFR, cleaning.manufacturer_of(F.col(S.CATALOG), prefixes))
    return items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(S.MFR).alias("unique_manufacturers"),
        F.count_distinct(S.MAIN).alias("unique_categories"),
        F.count_distinct(S.SUB).alias("unique_subcategories"),
        F.count_if(F.col(S.DESCRIPTION).isNull()).alias("missing_descriptions"),
        F.count_if(F.col(S.MAIN).isNull()).alias("missing_categories"),
    )


def cleaning_report(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """What cleaning removes and what is left, in one pass over the raw table."""
    number = F.col(S.CATALOG)
    kept = number.isNotNull() & (number.cast("string") != S.EMPTY_CATALOG)
    filled = cleaning.map_manufacturer(
        cleaning.fill_defaults(cleaning.cast_keys(cleaning.ensure_columns(raw.withColumn("_kept", kept)))), names
    )

    def of_kept(column):
        return F.when(F.col("_kept"), F.col(column))

    def nulls(column):
        return F.count_if(F.col("_kept") & F.col(column).isNull())

    return filled.agg(
        F.count_if(~F.col("_kept")).alias("rows_removed"),
        F.count_if("_kept").alias("rows_kept"),
        F.count_distinct(of_kept(S.CATALOG)).alias("unique_skus"),
        F.count_distinct(of_kept(S.MFR)).alias("unique_manufacturers"),
        F.count_distinct(of_kept(S.MAIN)).alias("unique_main_categories"),
        F.count_distinct(of_kept(S.SUB)).alias("unique_sub_categories"),
        nulls(S.DESCRIPTION).alias("missing_descriptions"),
        nulls(S.MAIN).alias("missing_main_categories"),
        nulls(S.SUB).alias("missing_sub_categories"),
    )


def value_counts(items: DataFrame, column: str) -> DataFrame:
    """Non-null values of a column with their row counts."""
    return items.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distributions(items: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one scan: (metric, key, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns])
    return (
        items.select(F.explode(pairs).alias("p"))
        .where(F.col("p.key").isNotNull())
        .groupBy("p.metric", "p.key")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def cluster_distribution(items: DataFrame) -> DataFrame:
    return value_counts(items, S.CLUSTER).orderBy(S.CLUSTER)


def top_subcategories(items: DataFrame, top_n: int = S.TOP_SUBCATEGORIES) -> DataFrame:
    return value_counts(items, S.SUB).orderBy(F.desc("n"), S.SUB).limit(top_n)


def category_cluster_counts(items: DataFrame) -> DataFrame:
    """Non-zero cells of the category by cluster table."""
    return (
        items.where(F.col(S.MAIN).isNotNull() & F.col(S.CLUSTER).isNotNull())
        .groupBy(S.MAIN, S.CLUSTER)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_cluster_crosstab(items: DataFrame, clusters: list[int]) -> DataFrame:
    """One row per category and one column per listed cluster, 0 where nothing falls."""
    return items.groupBy(S.MAIN).pivot(S.CLUSTER, clusters).count().fillna(0)


def chart_statistics(items: DataFrame) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(S.MAIN).alias("main_categories"),
        F.count_distinct(S.SUB).alias("sub_categories"),
    ]
    if S.CLUSTER in items.columns:
        measures.append(F.count_distinct(S.CLUSTER).alias("clusters"))
    return items.agg(*measures)


def category_change_stats(changes: DataFrame) -> DataFrame:
    measures = {}
    for name in ("main_category", "sub_category"):
        flag = F.col(f"{name}_changed")
        measures[f"{name}_changed"] = F.count_if(flag)
        measures[f"{name}_changed_pct"] = F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))
    return changes.agg(*[m.alias(k) for k, m in measures.items()])


def routing_stats(routed: DataFrame) -> DataFrame:
    """Rows decided by the model, sent to completion, and failed there."""
    sent = F.col("needs_completion")
    failed = sent & F.col("completion_failed")
    return routed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~sent).alias("model_used"),
        F.count_if(sent).alias("completion_used"),
        F.count_if(failed).alias("completion_failed"),
        (F.avg((~sent).cast("double")) * 100).alias("model_used_pct"),
        (F.avg(sent.cast("double")) * 100).alias("completion_used_pct"),
        (F.avg(F.when(sent, failed.cast("double"))) * 100).alias("completion_failed_pct"),
    )


def enrichment_stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(S.ENRICHED) != S.UNKNOWN).alias("enriched")
    )


def request_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status") == "ok").alias("successful_requests"),
        F.count_if(F.col("status") != "ok").alias("failed_requests"),
    )


def run_summary(items: DataFrame) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(S.MAIN).alias("unique_categories"),
        F.count_distinct(S.SUB).alias("unique_subcategories"),
    ]
    if S.CLUSTER in items.columns:
        measures.append(F.count_distinct(S.CLUSTER).alias("clusters"))
    return items.agg(*measures)
