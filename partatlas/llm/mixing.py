"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the key -ln(u) / w of Efraimidis and Spirakis, with u a hash of
its id and w its quality weight: the documents with the smallest keys are a weighted
sample. A source whose target is t and whose size is S is taken floor(t / S) times as
a whole; what is left of t goes to its first documents in the order of their keys.

The order inside a source is never sorted as a whole. The keys of a source follow
1 - exp(-key * mean weight) roughly evenly, so that value cuts it into buckets of a few
thousand documents; bucket sums give every bucket its offset, and only inside a bucket
is there a running sum. A source with a third of all rows is so spread like any other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partatlas.llm.common import word_count, written

ROWS_PER_BUCKET = 4000
MAX_EPOCHS = 3
CYCLE = 3  # sources weigh 1, 2, 3, 1, 2, 3, …


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for good, 1 for toxic good, 0.5 for bad documents."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .select("doc_id", F.expr("CASE WHEN q < 1 THEN 0.5D WHEN t > 0 THEN 1.0D ELSE 2.0D END").alias("weight"))
    )


def source_targets(sizes: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, mean_weight) with `target`, by water filling.

    Sources in the order of their names (null last) weigh 1, 2, 3, repeating. In the order
    of cap / weight, a source reaches its cap if the level that the rest would get is not
    below that ratio; all others get the level of the first that stays below its cap. That
    is where sharing excess again and again ends. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % CYCLE + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("all_size", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.coalesce("caps_before", F.lit(0.0))) / F.col("w_left"))
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(everything))
        .withColumn(
            "target", F.when(F.col("open"), F.least("cap", F.col("first_open.level") * F.col("w"))).otherwise(F.col("cap"))
        )
        .select("source", "source_size", "n_docs", "mean_weight", "target")
    )


def uniform(seed: str, doc_id: Column) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row of `docs`.

    `docs` has doc_id, text and source; `weights` (doc_id, weight > 0) has quality weights,
    1 where it has no row. `taken` counts the words the mix takes of the document: its size
    for every complete epoch of its source, and once more if it is in the part of an epoch
    that follows. The document at the end of that part is in if most of it still fits, so a
    source misses its target by half a document at most.

    A null text has size 0. Null sources form one source, which sorts last. Rows that repeat
    a doc_id are documents of their own with the same key; a null doc_id has a key as well.
    An empty table gives no rows. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if weights is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(weights.select("doc_id", "weight"), "doc_id", "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1.0))
        )
    sized = written(sized)
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("weight").alias("mean_weight")
    )
    targets = written(source_targets(sums, share, max_epochs)).withColumnRenamed("source", "of")
    key = -F.log(uniform(seed, F.col("doc_id"))) / F.col("weight")
    buckets = F.ceil(F.col("n_docs") / F.lit(ROWS_PER_BUCKET))
    keyed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("key", key)
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * buckets))
    )
    before_bucket = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(F.col("source").alias("of"), F.col("bucket").alias("at"))
        .agg(F.sum("size").alias("bucket_size"))
        .select("of", "at", F.coalesce(F.sum("bucket_size").over(before_bucket), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    epochs = F.coalesce(
        F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(max_epochs)), F.lit(0)
    )
    middle = F.col("offset") + F.coalesce("before", F.lit(0)) + F.col("size") / 2
    part = F.when(middle <= F.col("target") - F.col("epochs") * F.col("source_size"), F.col("size")).otherwise(F.lit(0))
    return (
        keyed.withColumn("before", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
        .withColumn("epochs", epochs)
        .select(
            "doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken")
        )
    )
