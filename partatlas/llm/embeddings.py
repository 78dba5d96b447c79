"""Near-duplicate vectors of one label by sorted projection passes.

Each pass draws random hyperplanes, hashes every vector to the signs of its projections
and sorts the vectors of a label by these bits. Vectors at a small angle share long
prefixes, so they stand close together in some of the passes: each vector is compared with
all that stand in its tile of the order or the next one. Where more vectors share a prefix
of their bits than a window holds, all of them are compared tile by tile, so a dense group
loses nothing to the width of the window. The prefix is as long as it takes for vectors in
random directions to fill a tile by it, and the number of passes follows from the prefix, so
the pairs compared per vector stay the same as the table grows, and the recall does.

Equal vectors are compared once and counted. A pair that stands together in several passes
is counted in the first of them, which both vectors know from their places in all passes;
therefore no table of pairs is ever made: cells return the links of each vector and a
spanning forest, and the forests of all passes are connected in the end.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partatlas.functions.forest import spanning_edges
from partatlas.llm.common import written
from partatlas.operators.graph import connected_components

COSINE = 0.98
MISSED = 4e-5  # chance that a pair at the threshold shares no prefix in any pass
BITS = 60
PREFIX = 10  # bits at least
TILE = 256
STRIP = 8  # tiles that one task compares in a row
SEED = 20_240


def resolution(rows: int) -> tuple[int, int]:
    """(bits of the prefix, passes) for labels of at most `rows` different vectors."""
    prefix = min(max(PREFIX, int(np.ceil(np.log2(max(rows, 1) / TILE)))), BITS)
    agree = 1 - np.arccos(COSINE) / np.pi  # of a pair at the threshold, in one bit
    return prefix, int(np.ceil(np.log(MISSED) / np.log(1 - agree**prefix)))


def _planes(dimension, k):
    return np.random.default_rng([SEED, dimension, k]).standard_normal((dimension, BITS))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, class, vector) of the vectors that can link: class is the label and the length.

    Left out are null ids and labels, null vectors, and those with null or non-finite
    components or without any component that is not zero.
    """
    v = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    return (
        vectors.select("vec_id", "label", v.alias("v"))
        .where(F.coalesce(fine, F.lit(False)))
        .select("vec_id", F.struct("label", F.size("v").alias("length")).alias("class"), F.col("v").alias("vector"))
    )


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _codes(passes):
    """Arrow function: the code of every vector in every pass, as text of bits packed to a number."""

    def run(batches):
        planes = {}
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            codes = np.zeros((len(lengths), passes), dtype=np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                vectors = _matrix(batch.column("vector").take(pa.array(at)))
                for k in range(passes):
                    if (n, k) not in planes:
                        planes[n, k] = _planes(n, k)
                    bits = (vectors @ planes[n, k]) > 0
                    codes[at, k] = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * passes), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("class"), lists], names=["id", "class", "codes"])

    return run


def _numbered(batches):
    """Arrow function: part and place of every row in its sorted partition."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(place, place + n))],
            names=[*batch.schema.names, "part", "place"],
        )
        place += n


def _placed(points: DataFrame) -> DataFrame:
    """(id, pass, class, run, tile) of all points in all passes; tiles count along the whole order."""
    largest = points.groupBy("class").count().agg(F.max("count").alias("n")).first()["n"]
    prefix, passes = resolution(largest or 0)
    coded = points.select("id", "class", F.col("class.length").alias("length"), "vector").mapInArrow(
        _codes(passes), f"id long, class {points.schema['class'].dataType.simpleString()}, codes array<long>"
    )
    rows = coded.select("id", "class", F.posexplode("codes").alias("pass", "code"))
    order = ["pass", "class", "code", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"id long, class {points.schema['class'].dataType.simpleString()}, pass int, code long, part int, place long"
    numbered = written(ranged.mapInArrow(_numbered, schema))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = (
        numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    )
    return numbered.join(offsets, "part").select(
        "id",
        "pass",
        F.xxhash64("class", F.shiftright("code", BITS - prefix)).alias("run"),
        F.floor((F.col("ahead") + F.col("place")) / TILE).alias("tile"),
    )


def _cell(tables):
    """Links of the vectors in a set of rows and a forest of them.

    `tables` yields (rows of a, rows of b, whether they are the same rows); rows is a tuple
    (id, n, class number, unit vectors, places, runs).
    """
    links, edges = {}, []
    for k, a, b, same, near in tables:
        cosines = a[3] @ b[3].T
        hit = (cosines >= COSINE - 1e-9) & (a[2][:, None] == b[2])
        if same:
            hit &= a[0][:, None] < b[0]
        x, y = np.nonzero(hit)
        if not len(x):
            continue
        exact = np.einsum("ij,ij->i", a[6][x], b[6][y]) / np.sqrt(a[7][x] * b[7][y])
        fine = exact >= COSINE
        # counted here only if no earlier pass, and in this pass no window, has the pair
        gap = np.abs(a[4][x, : k + 1] - b[4][y, : k + 1])
        together = (gap <= 1) | (a[5][x, : k + 1] == b[5][y, : k + 1])
        fine &= ~together[:, :k].any(axis=1)
        if not near:
            fine &= gap[:, k] > 1
        x, y = x[fine], y[fine]
        for ids, others, i, j in ((a[0], b[1], x, y), (b[0], a[1], y, x)):
            for one, n in zip(*_summed(ids[i], others[j]), strict=True):
                links[one] = links.get(one, 0) + n
        edges.append(spanning_edges(a[0][x], b[0][y]))
    src = np.concatenate([np.zeros(0, dtype=np.int64), *[e[0] for e in edges]])
    dst = np.concatenate([np.zeros(0, dtype=np.int64), *[e[1] for e in edges]])
    if len(src):
        src, dst = spanning_edges(src, dst)
    ids, n = list(links), list(links.values())
    return pa.table(
        {
            "src": pa.array([*ids, *src.tolist()], pa.int64()),
            "dst": pa.array([None] * len(ids) + dst.tolist(), pa.int64()),
            "n": pa.array([*n, *[None] * len(src)], pa.int64()),
        }
    )


def _summed(ids, values):
    unique, at = np.unique(ids, return_inverse=True)
    return unique.tolist(), np.bincount(at, values, len(unique)).astype(np.int64).tolist()


def _rows(table):
    """The columns of a cell's rows as arrays; vectors of one length, the class as a number."""
    vectors = _matrix(table.column("vector").combine_chunks())
    norm = np.einsum("ij,ij->i", vectors, vectors)
    return (
        table.column("id").to_numpy(),
        table.column("n").to_numpy(),
        table.column("class_hash").to_numpy(),
        vectors / np.sqrt(norm)[:, None],
        _matrix(table.column("tiles").combine_chunks()),
        _matrix(table.column("runs").combine_chunks()),
        vectors,
        norm,
    )


def _pick(rows, at):
    return tuple(x[at] for x in rows)


def _strips(key, table):
    """One strip of one pass and vector length: every tile against itself and the next."""
    k, strip = key[0].as_py(), key[1].as_py()
    rows = _rows(table)
    tile = rows[4][:, k]

    def pairs():
        for t in range(strip * STRIP, (strip + 1) * STRIP):
            a = _pick(rows, np.flatnonzero(tile == t))
            if not len(a[0]):
                continue
            b = _pick(rows, np.flatnonzero(tile == t + 1))
            yield k, a, a, True, True
            if len(b[0]):
                yield k, a, b, False, True

    return _cell(pairs())


def _dense(key, table):
    """Two blocks of tiles of a run that no window holds: the pairs that stand further apart."""
    k, run, i, j = (x.as_py() for x in key)
    rows = _rows(table)
    block = rows[4][:, k] // STRIP
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)

    def pairs():
        yield k, _pick(rows, a), _pick(rows, b), i == j, False

    return _cell(pairs() if len(a) and len(b) else [])


def vector_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine, in double precision, is at least
    0.98. Vectors that cannot link (see `usable`) have no links and are their own component; a
    row without an id has no component and is kept. Vectors of different lengths do not link.
    Rows that repeat a vec_id are one vector with several places: links are counted for each of
    its vectors and added up. An empty table gives no rows; other columns are not looked at.
    """
    good = usable(vectors)
    # equal vectors are one point; its id is the smallest of theirs
    points = written(good.groupBy("class", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    placed = _placed(points)
    places = written(
        placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pass", "tile", "run"))).alias("p"))
    ).select("id", F.col("p.tile").alias("tiles"), F.col("p.run").alias("runs"))
    whole = written(
        points.join(places, "id").select(
            "id", "n", F.xxhash64("class").alias("class_hash"), F.size("vector").alias("length"), "vector", "tiles", "runs"
        )
    )
    columns = ["id", "n", "class_hash", "length", "vector", "tiles", "runs"]
    each = whole.select(*columns, F.posexplode("tiles").alias("pass", "tile"))
    strip = F.floor(F.col("tile") / STRIP)
    # the first tile of a strip is also the last neighbour of the strip before
    strips = F.when((F.col("tile") % STRIP == 0) & (F.col("tile") > 0), F.array(strip, strip - 1)).otherwise(F.array(strip))
    windows = each.withColumn("strip", F.explode(strips)).groupBy("pass", "strip", "length").applyInArrow(
        _strips, "src long, dst long, n long"
    )
    run_of = F.get(F.col("runs"), F.col("pass"))
    block = F.floor(F.col("tile") / STRIP)
    blocked = each.withColumn("run", run_of).withColumn("block", block)
    dense = (
        blocked.groupBy("pass", "run")
        .agg(F.min("tile").alias("low"), F.max("tile").alias("high"))
        .where(F.col("high") - F.col("low") > 1)
        # a run stands together in the order, so its blocks follow each other
        .select("pass", "run", F.explode(F.sequence(F.floor(F.col("low") / STRIP), F.floor(F.col("high") / STRIP))).alias("other"))
    )
    cells = (
        blocked.join(dense, ["pass", "run"])
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .groupBy("pass", "run", "i", "j")
        .applyInArrow(_dense, "src long, dst long, n long")
    )
    found = written(windows.unionByName(cells))
    linked = found.where(F.col("n").isNotNull()).groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("others"))
    comps = connected_components(found.where(F.col("dst").isNotNull()).select("src", "dst"))
    result = (
        points.join(linked, "id", "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("class").alias("c"),
            F.col("vector").alias("v"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    by_id = (
        good.join(result, (F.col("class") == F.col("c")) & (F.col("vector") == F.col("v")))
        .groupBy("vec_id")
        .agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    )
    return vectors.select("vec_id").join(by_id, "vec_id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
