"""Benchmark decontamination by MinHash containment search.

An item of n distinct five-word shingles is in a document if at least a share t of them
is. Each item is sketched by its shingles of lowest hash. Items are partitioned by size,
and the partition fixes the length of the sketch: one more than the shingles that a match
may lack, floor((1 - t) * n) + 1 at the largest n of the partition. A document that holds
the share t of an item then holds at least one shingle of its sketch for certain, however
long the document is, so the search loses nothing. Candidates are verified by the exact
containment of all shingles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partatlas.llm.common import SHINGLE, words, written

CONTAINMENT = 0.8
BROADCAST_ROWS = 200_000  # of two numbers each; larger sketch tables are joined by a shuffle


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, repeats included; fewer words have none."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h):
        last = F.size(h) - SHINGLE
        return F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        ).otherwise(F.array().cast("array<bigint>"))

    # bound by a lambda, so that the words are hashed once and not for every shingle
    return F.flatten(F.transform(F.array(hashes), of))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, hash, n): the distinct shingles of every item and how many it has."""
    one = items.where(F.col("item_id").isNotNull()).select("item_id", F.array_distinct(shingles(F.col("text"))).alias("s"))
    return one.select("item_id", F.explode("s").alias("hash"), F.size("s").alias("n"))


def sketches(item_hashes: DataFrame, containment: float) -> DataFrame:
    """(hash, item_id) of the sketch of every item, as long as its size partition asks."""
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    lowest = F.slice(F.array_sort("s"), F.lit(1), (F.floor((1 - F.lit(containment)) * largest + 1e-9) + 1).cast("int"))
    grouped = item_hashes.groupBy("item_id", "n").agg(F.collect_set("hash").alias("s"))  # one benchmark item
    return grouped.select("item_id", F.explode(lowest).alias("hash"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, item_id, share) of all items that documents contain.

    `docs` has doc_id and text, `items` item_id and text; an item without five words matches
    nothing, and neither does one whose id is null. Repeated item ids are one item with the
    shingles of all its rows.
    """
    doc_rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    exploded = item_shingles(items).select("item_id", "hash").distinct()
    counted = exploded.join(exploded.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id")
    item_rows = written(counted)
    probes = _small(written(sketches(item_rows, containment)).select("hash").distinct())
    hit = (
        doc_rows.select("doc_id", "text_hash", F.explode(shingles(F.col("text"))).alias("hash"))
        .join(probes, "hash", "left_semi")
        .select("doc_id", "text_hash")
        .distinct()
    )
    candidates = written(hit)
    # equal texts are verified once
    some = candidates.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    shingled = (
        doc_rows.alias("d")
        .join(some.alias("c"), F.expr("d.text_hash = c.text_hash AND d.doc_id <=> c.doc_id"), "left_semi")
        .dropDuplicates(["text_hash"])
        .select("text_hash", F.explode(F.array_distinct(shingles(F.col("text")))).alias("hash"))
    )
    found = (
        shingled.join(_small(item_rows), "hash")
        .groupBy("text_hash", "item_id")
        .agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
        .where(F.col("common") >= F.lit(containment) * F.col("n") - 1e-9)
        .select("text_hash", "item_id", (F.col("common") / F.col("n")).alias("share"))
    )
    return candidates.join(found, "text_hash")


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, kept, n_items, items, share) for every row of `docs`.

    `items` lists the contained benchmark items in order, `share` is the largest share found
    (0 if none), `kept` says that there is none. A null text contains nothing; rows with a
    null doc_id are judged as well; repeated rows give repeated results.
    """
    found = (
        contained_items(docs, items, containment)
        .groupBy(F.col("doc_id").alias("of"), "text_hash")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("text_hash")), "left").select(
        "doc_id",
        F.col("items").isNull().alias("kept"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
