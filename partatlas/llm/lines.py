"""Removal of boilerplate lines: lines that occur on many distinct sites.

Every line (trimmed) is hashed, and a HyperLogLog sketch of the sites it occurs on is
merged by aggregation, so that the state of a line stays small however many rows repeat
it. Lines whose estimate is surely above or below the threshold are decided by it; lines
near the threshold get an exact distinct count. Documents then lose the lines found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partatlas.llm.common import written

MIN_SITES = 10
LG_K = 10
SIGMAS = 6


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(hash, length) of the lines of `docs` that occur on at least `min_sites` sources.

    A null source is no site. Empty lines are never boilerplate.
    """
    site_lines = (
        docs.where(F.col("source").isNotNull())
        .select("source", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _trimmed))).alias("line"))
        .where(F.col("line") != "")
        .select("source", F.xxhash64("line").alias("hash"), F.length("line").alias("length"))
    )
    error = SIGMAS * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    # a line that occurs fewer times than that cannot be on so many sites
    spread = written(
        site_lines.groupBy("hash", "length")
        .agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("source", F.lit(lg_k)).alias("sketch"))
        .where(F.col("rows") >= min_sites)
        .select("hash", "length", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= low)
    )
    sure = spread.where(F.col("sites") > high).select("hash", "length")
    near = spread.where(F.col("sites") <= high).select("hash", "length")
    exact = (
        site_lines.join(near, ["hash", "length"], "left_semi")
        .distinct()
        .groupBy("hash", "length")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("hash", "length")
    )
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every row of `docs` without its boilerplate lines.

    Lines are separated by line feeds and compared without blanks around them. A null text
    counts as one empty line and stays null. Rows with a null source are cleaned as well.
    Rows that repeat a doc_id are told apart by their text.
    """
    found = written(boilerplate_lines(docs, min_sites, lg_k))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hits = (
        rows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _trimmed))).alias("line"))
        .where(F.col("line") != "")
        .select("doc_id", "text_hash", F.xxhash64("line").alias("hash"), F.length("line").alias("length"))
        .join(found, ["hash", "length"], "left_semi")
        .groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"))
        .agg(F.collect_set("hash").alias("bad"))  # at most the lines of one document
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text"))
    kept = F.filter(
        _lines(F.col("text")),
        lambda line: F.col("bad").isNull() | (_trimmed(line) == "") | ~F.array_contains("bad", F.xxhash64(_trimmed(line))),
    )
    return (
        rows.join(written(hits), same, "left")
        .withColumn("kept", kept)
        .select(
            "doc_id",
            F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
            F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
            (F.size(_lines(F.col("text"))) - F.size("kept")).cast("long").alias("n_removed"),
        )
    )
