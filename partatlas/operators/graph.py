"""Graph of similar items: vertices, edges and connected components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.functions.forest import maximum_forest, spanning_edges
from partatlas.operators.skew import attach_by_key
from partatlas.staging import stage

FOREST_LIMIT = 1_000_000


def graph_vertices(items: DataFrame) -> DataFrame:
    """One vertex per catalogue number with the attributes of its last row."""
    names = [S.DESCRIPTION, S.MAIN, S.SUB, *([S.CLUSTER] if S.CLUSTER in items.columns else [])]
    return (
        items.groupBy(S.CATALOG)
        .agg(F.max_by(F.struct(*names), S.ROW).alias("v"))
        .select(S.CATALOG, *[F.col(f"v.{n}").alias(n) for n in names])
    )


def graph_edges(pairs: DataFrame) -> DataFrame:
    """One edge per pair of catalogue numbers, weighted by its last row pair.

    The pair of a catalogue number with itself is no edge; it stays in the pairs.
    """
    later = F.struct(F.least("last_i", "last_j"), F.greatest("last_i", "last_j"))
    ends = [F.least("catalog_no_i", "catalog_no_j").alias("src"), F.greatest("catalog_no_i", "catalog_no_j").alias("dst")]
    return (
        pairs.where(F.col("catalog_no_i") != F.col("catalog_no_j"))
        .groupBy(*ends)
        .agg(F.max_by("combined", later).alias("weight"))
    )


def network_edges(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the category (and cluster, where known) of both ends.

    `pairs` are those strictly above the network threshold.
    """
    names = [S.MAIN, *([S.CLUSTER] if S.CLUSTER in vertices.columns else [])]
    edges = graph_edges(pairs)
    for end in ("src", "dst"):
        ends = vertices.select(F.col(S.CATALOG).alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names])
        edges = edges.join(ends, end)
    return edges


def _forest_of_partition(batches):
    """Arrow function: per level, a spanning forest of the edges of this partition."""
    held = {}

    def flush(level):
        src, dst = held.pop(level)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(src), level, dtype=np.int32)), pa.array(src), pa.array(dst)],
            names=["level", "src", "dst"],
        )

    for batch in batches:
        level, src, dst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "src", "dst"))
        for one in np.unique(level):
            at = level == one
            old = held.get(one, (np.array([], dtype=np.int64),) * 2)
            held[one] = spanning_edges(np.concatenate([old[0], src[at]]), np.concatenate([old[1], dst[at]]))
            if len(held[one][0]) > FOREST_LIMIT:
                yield flush(one)
    for one in list(held):
        yield flush(one)


def local_forests(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: at most one per node and partition."""
    return edges.select("level", "src", "dst").mapInArrow(
        _forest_of_partition, "level int, src bigint, dst bigint"
    )


def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("level", "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))


def _linked(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the lowest node around u; hubs are spread over tasks."""
    lowest = _lowest_neighbour(edges).withColumn("m", F.least("m", "u"))
    keyed = lowest.withColumn("key", F.struct("level", "u")).drop("level", "u")
    return attach_by_key(edges.withColumn("key", F.struct("level", "u")), keyed, "key", "degree", ["v"]).drop("key", "degree")


def _mark(edges: DataFrame):
    """Number and order-free fingerprint of the edges, to see when they stop changing."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("level", "u", "v"))).first()


def connected_components(edges: DataFrame, levels: bool = False) -> DataFrame:
    """(node, component) of (src, dst) by alternating large and small stars.

    The component is its lowest node; nodes without an edge do not appear. With
    `levels`, edges carry a `level` and every level is a graph of its own.
    """
    start = edges if levels else edges.withColumn("level", F.lit(0))
    forest = local_forests(start.where(F.col("src") != F.col("dst")))
    star = stage(forest.select("level", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = _mark(star)
    while True:
        both = star.unionByName(star.select("level", F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _linked(both)
            .where(F.col("v") > F.col("u"))
            .select("level", F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        small = _linked(large)
        links = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        star = stage(
            small.select("level", F.explode(links).alias("e"))
            .select("level", "e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        mark = _mark(star)
        if mark == seen:
            break
        seen = mark
    roots = star.select("level", F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = star.select("level", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return found if levels else found.drop("level")


def _maximum_forest_of_partition(batches):
    """Arrow function: a maximum spanning forest of the edges of this partition."""
    held, size = [], 0

    def reduced():
        src, dst, weight = (np.concatenate(x) for x in zip(*held))
        at = maximum_forest(src, dst, weight)
        return src[at], dst[at], weight[at]

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["src", "dst", "weight"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight")))
        size += batch.num_rows
        if size > FOREST_LIMIT:
            held = [reduced()]
            size = len(held[0][0])
            if size > FOREST_LIMIT // 2:
                yield batch_of(held[0])
                held, size = [], 0
    if held:
        yield batch_of(reduced())


def maximum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): a maximum spanning forest of weighted edges, whose components at any weight are the graph's.

    An edge that is not in the forest of some of the edges is not in that of all, so every
    partition is reduced to its own forest first. Borůvka's rounds follow: each component takes the
    heaviest edge that leaves it (of equal ones, the lowest), and components so connected become one.
    """
    spark = edges.sparkSession
    plain = edges.where(F.col("src") != F.col("dst")).select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")
    )
    local = plain.mapInArrow(_maximum_forest_of_partition, "src bigint, dst bigint, weight double")
    open_ = stage(local.select("*", F.col("src").alias("u"), F.col("dst").alias("v")))
    forest = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    ends = F.array(F.col("u"), F.col("v"))
    order = F.struct("weight", -F.least("src", "dst"), -F.greatest("src", "dst"))
    edge = F.struct("src", "dst", "weight", "u", "v")
    while not open_.isEmpty():
        first = open_.select(F.explode(ends).alias("node"), order.alias("o"), edge.alias("e")).groupBy("node").agg(F.max_by("e", "o").alias("e"))
        chosen = stage(first.select("e.*").distinct())
        forest = forest.unionByName(chosen.select("src", "dst", "weight"))
        joined = connected_components(chosen.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        sizes = open_.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        facts = stage(joined.join(sizes, "node"))
        for end in ("u", "v"):
            named = facts.select(F.col("node").alias(end), F.col("component").alias("_label"), "degree")
            open_ = attach_by_key(open_, named, end, "degree", ["src", "dst"]).drop(end, "degree").withColumnRenamed("_label", end)
        between = open_.where(F.col("u") != F.col("v")).withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
        best = between.groupBy("u", "v").agg(F.max_by(F.struct("src", "dst", "weight"), order).alias("e"))
        open_ = stage(best.select("e.*", "u", "v"))
    return forest
