"""Best text partner by cosine where no threshold can prune: exact, without pair tables.

Pending texts meet each other and all others in the tiles of a grid. In a tile the cosine is
split in two: the few most frequent terms, which most texts share, are multiplied as
dense matrices; all other terms are held by few texts of a tile, so their products are
summed by merging the sorted terms of both sides. Products of single terms exist in
arrays only, and a text leaves a tile with one partner.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators.blocks import grid, members_of

DENSE_TERMS = 2048
TILES = 4  # of `grid`, on either side of a tile here
PRODUCTS = 1 << 22  # of single terms that exist at a time


def _entries(members, first_dense):
    """(owner, term, weight) of the entries of all members, the rare ones and the frequent ones."""
    start, terms = members_of(members.field("terms"))
    terms = terms.to_numpy(zero_copy_only=False)
    weights = members_of(members.field("weights"))[1].to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(members)), np.diff(start))
    rare = terms < first_dense
    return [(owner[at], terms[at], weights[at]) for at in (rare, ~rare)]


def dense(entries, rows, dense_ids):
    out = np.zeros((rows, len(dense_ids)))
    owner, terms, weights = entries
    out[owner, np.searchsorted(dense_ids, terms)] = weights
    return out


def merged(a, b, shape):
    """Sums of products over terms that both sides hold, as a matrix."""
    order = np.argsort(b[1], kind="stable")
    owner_b, terms_b, weights_b = (x[order] for x in b)
    begin, end = (np.searchsorted(terms_b, a[1], side) for side in ("left", "right"))
    held = np.flatnonzero(end > begin)
    owner_a, weights_a, begin, counts = a[0][held], a[2][held], begin[held], (end - begin)[held]
    ends = np.cumsum(counts)
    out = np.zeros(shape[0] * shape[1])
    first = 0
    while first < len(counts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
        n = counts[first:last]
        at_a = np.repeat(np.arange(first, last), n)
        at_b = np.arange(len(at_a)) + np.repeat(begin[first:last] - (ends[first:last] - n - done), n)
        out += np.bincount(owner_a[at_a] * shape[1] + owner_b[at_b], weights_a[at_a] * weights_b[at_b], len(out))
        first = last
    return out.reshape(shape)


def _best(ids, sims, first_ids):
    """Per row the highest cosine above 0 and the lowest first id that has it."""
    order = np.argsort(first_ids)
    at = sims[:, order].argmax(axis=1)
    top = sims[np.arange(len(ids)), order[at]]
    hit = np.flatnonzero(top > 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.array(top[hit]), pa.array(first_ids[order[at[hit]]])], names=["id", "top", "first"]
    )


def _tile_best(dense_ids):
    dense_ids = np.array(dense_ids, dtype=np.int64)
    # ids ascend with frequency, so one comparison tells frequent terms
    first_dense = int(dense_ids[0]) if len(dense_ids) else np.iinfo(np.int64).max

    def run(batches):
        for batch in batches:
            start_a, a_all = members_of(batch.column("a"))
            start_b, b_all = members_of(batch.column("b"))
            inside = batch.column("inside").to_numpy(zero_copy_only=False)
            diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
            for cell in range(batch.num_rows):
                a = a_all.slice(start_a[cell], start_a[cell + 1] - start_a[cell])
                b = b_all.slice(start_b[cell], start_b[cell + 1] - start_b[cell])
                (rare_a, dense_a), (rare_b, dense_b) = _entries(a, first_dense), _entries(b, first_dense)
                sims = merged(rare_a, rare_b, (len(a), len(b)))
                sims += dense(dense_a, len(a), dense_ids) @ dense(dense_b, len(b), dense_ids).T
                sims = np.round(sims, S.DIGITS)
                if diagonal[cell]:
                    np.fill_diagonal(sims, 0.0)
                yield _best(a.field("id").to_numpy(), sims, b.field("first").to_numpy())
                if inside[cell] and not diagonal[cell]:
                    yield _best(b.field("id").to_numpy(), sims.T, a.field("first").to_numpy())

    return run


def frequent_terms(vectors: DataFrame) -> list[int]:
    """Ids of the DENSE_TERMS most frequent terms, ascending."""
    entries = vectors.select(F.explode("terms").alias("term_id"))
    frequent = entries.groupBy("term_id").count().orderBy(F.desc("term_id")).limit(DENSE_TERMS)
    return sorted(r["term_id"] for r in frequent.select("term_id").collect())


def best_partners(vectors: DataFrame, pending: DataFrame, heads: DataFrame) -> DataFrame:
    """(text_id, top, top_id) for every pending text that shares a term with another text."""
    spark = vectors.sparkSession
    members = (
        vectors.join(pending.withColumn("group_id", F.lit(0).cast("bigint")), "text_id", "left")
        .join(heads.select("text_id", F.col("first_id").alias("first")), "text_id")
        .select(F.coalesce("group_id", F.lit(1)).alias("group_id"), F.col("text_id").alias("id"), "first", "terms", "weights")
    )
    pairs = spark.createDataFrame([(0, 0, True), (0, 1, False)], "group_i bigint, group_j bigint, inside boolean")
    found = grid(pairs, members, ["inside"], _tile_best(frequent_terms(vectors)), "id bigint, top double, first bigint", TILES)
    best = found.groupBy("id").agg(F.max(F.struct("top", (-F.col("first")).alias("neg_id"))).alias("b"))
    return best.select(F.col("id").alias("text_id"), F.col("b.top").alias("top"), (-F.col("b.neg_id")).alias("top_id"))
