"""Text pairs with a cosine of at least tau, block against block: exact, without a table of candidates.

In a tile the products of rare terms are summed by merging the sorted terms of both sides, those
of the most frequent terms by one matrix product. The terms between the two add at most the
product of what each text has there. Only pairs that can reach tau so are multiplied in full, in the tile that found them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators.best_text import dense, frequent_terms, merged
from partatlas.operators.blocks import grid, members_of, one_group

TOP_TERMS = 64
TILES = 4  # of `grid`, on either side of a tile here
MANY = 32  # of a tile's pairs one in so many, from where a matrix product is cheaper
SLICE = 1 << 21
SLACK = 1e-8


def pair_dots(offsets, terms, weights, at_i, at_j, limit):
    """Dot products of the vectors at `at_i` and `at_j`; `limit` terms are looked up at a time."""
    known, number = np.unique(terms, return_inverse=True)
    # terms ascend within a vector, so these keys ascend over all vectors
    sizes = np.diff(offsets)
    keys = np.repeat(np.arange(len(sizes)), sizes) * len(known) + number
    # look the terms of the shorter vector up in the longer one
    short = np.where(sizes[at_i] <= sizes[at_j], at_i, at_j)
    long = at_i + at_j - short
    dots = np.zeros(len(short))
    ends = np.cumsum(sizes[short])
    begin = 0
    while begin < len(short):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        counts = sizes[short[begin:end]]
        pair = np.repeat(np.arange(begin, end), counts)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[short[pair]]
        wanted = long[pair] * len(known) + number[entry]
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[found] == wanted)
        products = weights[entry[hit]] * weights[found[hit]]
        dots[begin:end] = np.bincount(pair[hit] - begin, weights=products, minlength=end - begin)
        begin = end
    return dots


class _Side:
    """The vectors of one side of a tile, their terms by frequency: rare, between, and at the top."""

    def __init__(self, members, dense_ids):
        self.rows, self.ids = len(members), members.field("id").to_numpy()
        self.start, terms = members_of(members.field("terms"))
        self.terms = terms.to_numpy(zero_copy_only=False)
        self.weights = members_of(members.field("weights"))[1].to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(self.rows), np.diff(self.start))
        top_ids = dense_ids[-TOP_TERMS:]
        # ids ascend with frequency, so one comparison tells frequent terms
        is_dense, is_top = (self.terms >= (ids[0] if len(ids) else np.iinfo(np.int64).max) for ids in (dense_ids, top_ids))
        self.rare, self.frequent, top = ((owner[at], self.terms[at], self.weights[at]) for at in (~is_dense, is_dense, is_top))
        between = is_dense & ~is_top
        rest = np.sqrt(np.bincount(owner[between], self.weights[between] ** 2, self.rows))
        self.bound = np.column_stack([dense(top, self.rows, top_ids), rest])


def _reaching(a, b, dense_ids, tau, diagonal):
    """Positions in a and b and cosines of the pairs of a tile that reach tau."""
    sums = merged(a.rare, b.rare, (a.rows, b.rows))

    def above(scores):
        near = scores >= tau - SLACK
        return np.nonzero(np.triu(near, 1) if diagonal else near)

    at_a, at_b = above(sums + a.bound @ b.bound.T)
    if len(at_a) * MANY > a.rows * b.rows:
        sums += dense(a.frequent, a.rows, dense_ids) @ dense(b.frequent, b.rows, dense_ids).T
        at_a, at_b = above(sums)
        dots = sums[at_a, at_b]
    else:
        # only the vectors of such pairs
        (own, i), (other, j) = (np.unique(at, return_inverse=True) for at in (at_a, at_b))
        sizes, terms, weights = [], [], []
        for side, rows in ((a, own), (b, other)):
            counts = np.diff(side.start)[rows]
            entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(side.start[rows], counts)
            sizes.append(counts)
            terms.append(side.terms[entry])
            weights.append(side.weights[entry])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        dots = pair_dots(offsets, np.concatenate(terms), np.concatenate(weights), i, len(own) + j, SLICE)
    dots = np.round(dots, S.DIGITS)
    at = np.flatnonzero((dots >= tau) & (dots > 0))
    return at_a[at], at_b[at], dots[at]


def _tile_pairs(dense_ids, tau):
    dense_ids = np.array(dense_ids, dtype=np.int64)

    def run(batches):
        for batch in batches:
            (start_a, a_all), (start_b, b_all) = (members_of(batch.column(side)) for side in ("a", "b"))
            diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
            for cell in range(batch.num_rows):
                a = _Side(a_all.slice(start_a[cell], start_a[cell + 1] - start_a[cell]), dense_ids)
                b = a if diagonal[cell] else _Side(b_all.slice(start_b[cell], start_b[cell + 1] - start_b[cell]), dense_ids)
                at_a, at_b, dots = _reaching(a, b, dense_ids, tau, diagonal[cell])
                found = [np.minimum(a.ids[at_a], b.ids[at_b]), np.maximum(a.ids[at_a], b.ids[at_b]), dots]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["text_i", "text_j", "desc_sim"])

    return run


def pairs_above(vectors: DataFrame, tau: float) -> DataFrame:
    """(text_i, text_j, desc_sim) of all pairs with a cosine of tau > 0 or more, the lower id first."""
    groups, members = one_group(vectors.select(F.col("text_id").alias("id"), "terms", "weights"))
    function = _tile_pairs(frequent_terms(vectors), tau)
    return grid(groups, members, [], function, "text_i bigint, text_j bigint, desc_sim double", TILES)
