"""Neighbour pairs, density clustering and k-means on feature vectors.

Items with equal vectors are compared once and counted. Vectors are compared
chunk against chunk inside tasks (`blocks`): a task hands on neighbour counts, a
spanning forest or the best label per member, so that dense neighbourhoods never
become pair tables. Only `neighbour_pairs` lists pairs, because they are its result.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.functions.forest import spanning_edges
from partatlas.operators.blocks import grid, members_of
from partatlas.operators.graph import connected_components
from partatlas.operators.order import positions
from partatlas.operators.pivots import PivotCells, pivot_cells
from partatlas.operators.skew import attach_by_key
from partatlas.staging import stage

NORM_GUARD = 1e-8  # fixed value: added to a vector's norm before it divides
NOISE = -1


class VectorIndex:
    """Distinct vectors of a (row_id, features) table: id, n and the normalised vector."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors.select(S.ROW, F.col("features").cast("array<double>").alias("features"))
        norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x)) + NORM_GUARD
        # the norm is written with the points; inlined it would be evaluated once per entry
        self.points = stage(
            self.vectors.groupBy("features")
            .agg(F.min(S.ROW).alias("id"), F.count(F.lit(1)).alias("n"))
            .withColumn("norm", norm)
        )

    def normalised(self) -> DataFrame:
        return self.points.select("id", "n", F.transform("features", lambda x: x / F.col("norm")).alias("unit"))

    def normalised_and_single(self) -> DataFrame:
        """`normalised` with the norm and the vector in single precision, if that holds every vector as it is."""
        same = F.forall("features", lambda x: x.cast("float").cast("double").eqNullSafe(x))
        if not self.points.where(~same).isEmpty():
            return self.normalised()
        single = F.col("features").cast("array<float>").alias("single")
        return self.points.select("id", "n", F.transform("features", lambda x: x / F.col("norm")).alias("unit"), "norm", single)

    def spread_to_rows(self, labels: DataFrame) -> DataFrame:
        """Labels (id, cluster) of distinct vectors given to every row with that vector."""
        facts = self.points.join(labels, "id").select("features", "n", "cluster")
        return attach_by_key(self.vectors, facts, "features", "n", [S.ROW]).select(S.ROW, "cluster")


def _matrix(members, field):
    """Rows of an Arrow struct field of equally long lists as a matrix."""
    lists = members.field(field)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _fields(points):
    """The columns of `points` that say the unit vectors, as few bytes as can be."""
    return ["norm", "single"] if "single" in points.columns else ["unit"]


def _sent(points):
    return points.select("group_id", "id", "n", *_fields(points))


def _units(members):
    if members.type.get_field_index("single") < 0:
        return _matrix(members, "unit")
    single = _matrix(members, "single").astype(np.float64)
    # the division that Spark does for `unit`
    return single / members.field("norm").to_numpy(zero_copy_only=False)[:, None] if len(members) else single


def _cell_cosines(batch):
    """For every cell of a batch: members, cosines and which pairs count (each once)."""
    start_a, a = members_of(batch.column("a"))
    start_b, b = members_of(batch.column("b"))
    unit_a, unit_b = _units(a), _units(b)
    diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
    for cell in range(batch.num_rows):
        at_a, at_b = slice(*start_a[cell : cell + 2]), slice(*start_b[cell : cell + 2])
        cosines = np.round(unit_a[at_a] @ unit_b[at_b].T, S.DIGITS)
        yield a.slice(at_a.start, at_a.stop - at_a.start), b.slice(at_b.start, at_b.stop - at_b.start), cosines, diagonal[cell]


def _column(members, field):
    return members.field(field).to_numpy(zero_copy_only=False)


def neighbour_pairs(index: VectorIndex, threshold: float = S.SIMILARITY_THRESHOLD) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold; groups too far apart never meet."""

    def run(batches):
        for batch in batches:
            for a, b, cosines, diagonal in _cell_cosines(batch):
                near = cosines >= threshold
                if diagonal:
                    near &= np.triu(np.ones(near.shape, dtype=bool), 1)
                i, j = np.nonzero(near)
                id_a, id_b = _column(a, "id")[i], _column(b, "id")[j]
                n_a, n_b = _column(a, "n")[i], _column(b, "n")[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(id_a, id_b)),
                        pa.array(np.maximum(id_a, id_b)),
                        pa.array(cosines[i, j]),
                        pa.array(n_a * n_b),
                    ],
                    names=["row_i", "row_j", "cosine", "row_pairs"],
                )

    cells = pivot_cells(stage(index.normalised_and_single()), threshold)
    return grid(cells.within(), _sent(cells.points), [], run, "row_i bigint, row_j bigint, cosine double, row_pairs bigint")


def _neighbour_counts(cells: PivotCells, threshold: float) -> DataFrame:
    """Rows within reach of every distinct vector, itself included."""

    def run(batches):
        for batch in batches:
            for a, b, cosines, diagonal in _cell_cosines(batch):
                near = (cosines >= threshold).astype(np.int64)
                parts = [(a, near @ _column(b, "n"))]
                if not diagonal:
                    parts.append((b, near.T @ _column(a, "n")))
                for members, counts in parts:
                    yield pa.RecordBatch.from_arrays([members.field("id"), pa.array(counts)], names=["id", "near"])

    counted = grid(cells.within(), _sent(cells.points), [], run, "id bigint, near bigint")
    return counted.groupBy("id").agg(F.sum("near").alias("near"))


def _core_forest(cells: PivotCells, cores: DataFrame, threshold: float) -> DataFrame:
    """Edges that connect the core vectors as all their neighbour pairs would."""

    def run(batches):
        for batch in batches:
            for a, b, cosines, _ in _cell_cosines(batch):
                i, j = np.nonzero(cosines >= threshold)
                src, dst = spanning_edges(_column(a, "id")[i], _column(b, "id")[j])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return grid(cells.within(), cores, [], run, "src bigint, dst bigint")


def _border_labels(cells: PivotCells, others: DataFrame, cores: DataFrame, threshold: float) -> DataFrame:
    """Lowest cluster among the core neighbours of every other vector."""

    def run(batches):
        for batch in batches:
            for a, b, cosines, _ in _cell_cosines(batch):
                cluster = _column(b, "cluster").astype(np.int64)
                lowest = np.where(cosines >= threshold, cluster, np.iinfo(np.int64).max).min(axis=1)
                hit = np.flatnonzero(lowest < np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays(
                    [a.field("id").take(pa.array(hit)), pa.array(lowest[hit])], names=["id", "cluster"]
                )

    sides = [others.withColumn("cluster", F.lit(None).cast("long")), cores]
    sides = [df.select("id", *_fields(df), "cluster", (F.col("group_id") * 2 + k).alias("group_id")) for k, df in enumerate(sides)]
    found = grid(cells.between(), sides[0].unionByName(sides[1]), [], run, "id bigint, cluster bigint")
    return found.groupBy("id").agg(F.min("cluster").alias("cluster"))


def dbscan(
    index: VectorIndex,
    threshold: float = S.SIMILARITY_THRESHOLD,
    min_neighbours: int = S.DBSCAN_MIN_NEIGHBOURS,
) -> DataFrame:
    """(row_id, cluster) of density clustering under cosine distance 1 − threshold.

    Core rows have at least `min_neighbours` rows within reach, themselves
    included. Clusters are numbered by their lowest core row; a border row takes
    the lowest cluster among its core neighbours; the rest is noise, −1.
    """
    cells = pivot_cells(stage(index.normalised_and_single()), threshold)
    counts = stage(_neighbour_counts(cells, threshold))
    flagged = stage(cells.points.join(counts.where(F.col("near") >= min_neighbours).select("id", F.lit(True).alias("core")), "id", "left"))
    cores = flagged.where("core").select("group_id", "id", *_fields(flagged))
    linked = connected_components(_core_forest(cells, cores, threshold))
    component = cores.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left")
    component = stage(component.withColumn("component", F.coalesce("component", "id")))
    numbered = positions(component.select("component").distinct(), ["component"], "cluster")
    core_labels = stage(component.join(numbered, "component").select("id", "cluster"))
    others = flagged.where(F.col("core").isNull()).select("group_id", "id", *_fields(flagged))
    border = _border_labels(cells, others, cores.join(core_labels, "id"), threshold)
    noise = others.select("id").join(border, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)))
    labels = core_labels.unionByName(noise).withColumn("cluster", F.col("cluster").cast("int"))
    return index.spread_to_rows(labels)


def kmeans(vectors: DataFrame, k: int = S.KMEANS_CLUSTERS, seed: int = S.KMEANS_SEED):
    """Fitted k-means model of a (row_id, features) table."""
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(_ml(vectors))


def _ml(vectors: DataFrame) -> DataFrame:
    if dict(vectors.dtypes)["features"].startswith("array"):
        return vectors.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return vectors


def kmeans_assign(vectors: DataFrame, k: int = S.KMEANS_CLUSTERS, seed: int = S.KMEANS_SEED) -> DataFrame:
    return kmeans(vectors, k, seed).transform(_ml(vectors)).select(S.ROW, "cluster")


def attach_clusters(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items with their cluster; `labels` has one row per item."""
    return items.drop(S.CLUSTER).join(labels.select(S.ROW, F.col("cluster").alias(S.CLUSTER)), S.ROW)
