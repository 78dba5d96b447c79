"""Pairs of catalogue numbers above a ratio, found through the q-grams they share.

A ratio of t leaves at most (1 - t) (la + lb) insertions and deletions between two strings, of
which each takes away q grams of one string at most, and q - 1 of the other. So they share at least
    (la + lb) ((2 q - 1) t / 2 - (q - 1)) - (q - 1)
grams. That bound is used three times. As a prefix: with all grams in one order from rare to
frequent, two strings that share that many share one among their first few, and only those
are indexed. As a length filter: the shorter string has to be long enough. As a count filter:
grams that one string has and the other surely lacks, read from 64-bit signatures. What is left has
its longest common subsequence computed, in the same task.

Bigrams bound strings from some length on; pairs with a shorter string share single letters.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas.functions.lcs import Strings, lcs_pairs, lcs_table, ratio
from partatlas.operators.blocks import grid, members_of, one_group
from partatlas.operators.sku_pairs import FLOOR_SLACK, MEMBER, SMALL_CELL, _small_cells, matching_pairs
from partatlas.staging import stage

RANKED_GRAMS = 1 << 16  # grams whose frequency orders them; all others come first, by hash
DENSE_SHARE = 8  # a tile with a candidate among so many pairs is computed as a table
BOUND_SLACK = 1e-6

_ROW = "id bigint, sku string, n bigint, last bigint, scope bigint, pending boolean"
_POSTING = f"gram bigint, {_ROW}, size int, sig bigint, grams array<bigint>"


class Bound:
    """How many grams two strings share at least if their ratio reaches `floor`."""

    def __init__(self, floor: float):
        self.floor = floor - FLOOR_SLACK
        self.share = {q: (2 * q - 1) * self.floor / 2 - (q - 1) for q in (1, 2)}
        # bigrams say something about strings that share two or more with any partner
        self.bigrams_from = np.inf if self.share[2] <= 0 else int(np.ceil((2 - self.floor) / self.share[2]))

    def shared(self, q, total):
        """Least number of common grams of strings whose lengths add up to `total`."""
        return total * self.share[q] - (q - 1) - BOUND_SLACK

    def of_string(self, q, length):
        """The same for a string and its shortest partner."""
        return self.shared(q, 2 * length / (2 - self.floor))

    def sizes(self, length):
        """Which grams a string of that length is indexed by."""
        if length >= self.bigrams_from:
            yield 2
        if length and length * self.floor / (2 - self.floor) < self.bigrams_from:
            yield 1  # it may have a partner that is too short for bigrams


def _grams(scope, sku, q):
    """64-bit numbers of the grams of a string, the k-th occurrence of a gram by a number of its own.

    The lowest bit says which q; the second one is left to the caller.
    """
    import xxhash

    seen, out = Counter(), []
    for at in range(len(sku) - q + 1):
        gram = sku[at : at + q]
        seen[gram] += 1
        number = xxhash.xxh3_64_intdigest(f"{scope}:{seen[gram]}:{gram}".encode("utf-8", "surrogatepass"))
        out.append((number & ~3 | (q - 1)) - (1 << 63))
    return out


def _signature(grams):
    """64 bits, one set for every gram; a bit that the other signature lacks is a gram it lacks."""
    bits = 0
    for gram in grams:
        bits |= 1 << ((gram >> 8) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _all_grams(bound):
    def run(batches):
        for batch in batches:
            skus, scopes = batch.column("sku").to_pylist(), batch.column("scope").to_pylist()
            found = [g for sku, scope in zip(skus, scopes) for q in bound.sizes(len(sku)) for g in _grams(scope, sku, q)]
            grams, counts = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    return run


def _prefix_postings(bound, rank):
    """Arrow function: a row for every gram in the prefix of every string."""
    names = [f.split(" ")[0] for f in _ROW.split(", ")]

    def run(batches):
        order = {g: k for k, g in enumerate(rank.value, 1)}
        for batch in batches:
            rows, grams, sizes, signatures, prefixes = [], [], [], [], []
            for row, (sku, scope) in enumerate(zip(batch.column("sku").to_pylist(), batch.column("scope").to_pylist())):
                for q in bound.sizes(len(sku)):
                    own = sorted(_grams(scope, sku, q), key=lambda g: (order.get(g, 0), g))
                    least = max(1, int(np.ceil(bound.of_string(q, len(sku)))))
                    prefix = own[: max(len(own) - least + 1, 0)]
                    rows += [row] * len(prefix)
                    grams += prefix
                    sizes += [len(own)] * len(prefix)
                    signatures += [_signature(own)] * len(prefix)
                    prefixes += [prefix] * len(prefix)
            columns = [batch.column(name).take(pa.array(rows, pa.int64())) for name in names]
            own = [pa.array(sizes, pa.int32()), pa.array(signatures, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), *columns, *own], names=["gram", *names, "size", "sig", "grams"]
            )

    return run


def postings(members: DataFrame, floor: float) -> DataFrame:
    """The prefix index of `members` (id, sku, n, last, scope, pending); strings of one scope share grams."""
    spark, bound = members.sparkSession, Bound(floor)
    counts = members.mapInArrow(_all_grams(bound), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "gram").limit(RANKED_GRAMS).collect()
    rank = spark.sparkContext.broadcast([r["gram"] for r in reversed(frequent)])
    return stage(members.mapInArrow(_prefix_postings(bound, rank), _POSTING))


def _fields(members, names):
    return [members.field(name).to_numpy(zero_copy_only=False) for name in names]


class _Side:
    """What the filters need of the members of one side."""

    def __init__(self, members, lengths):
        self.members, self.lengths = members, lengths
        self.size, self.signature = _fields(members, ("size", "sig"))
        self.signature = self.signature.view(np.uint64)
        self.start, flat = members_of(members.field("grams"))
        self.flat = flat.to_numpy(zero_copy_only=False)


def _passing(bound, q, a, b, at_a, at_b):
    """Which of the pairs (broadcast positions) pass the length filter and the count filter."""
    la, lb = a.lengths[at_a], b.lengths[at_b]
    total, short = la + lb, np.minimum(la, lb)
    passing = 2 * short >= bound.floor * total
    if np.ndim(q) or q == 1:
        passing &= (np.asarray(q) > 1) | (short < bound.bigrams_from)
    least = np.where(np.asarray(q) > 1, bound.shared(2, total), bound.shared(1, total))
    sa, sb = a.signature[at_a], b.signature[at_b]
    passing &= a.size[at_a] - np.bitwise_count(sa & ~sb) >= least
    passing &= b.size[at_b] - np.bitwise_count(sb & ~sa) >= least
    return passing


def _first_shared(a, b, left, right, gram):
    """Which of the pairs share no gram of their prefixes that comes before the one they were found by."""
    found = np.zeros(len(left), dtype=bool)
    open_ = np.arange(len(left))
    step = 0
    while len(open_):
        # prefixes are in one order: walk along a's until its gram is one of b's
        own = a.flat[a.start[left[open_]] + step]
        here = own == gram[open_]
        found[open_[here]] = True
        open_, own = open_[~here], own[~here]
        shared = np.zeros(len(open_), dtype=bool)
        widths = b.start[right[open_] + 1] - b.start[right[open_]]
        for k in range(int(widths.max(initial=0))):
            inside = np.flatnonzero(k < widths)
            shared[inside] |= b.flat[b.start[right[open_[inside]]] + k] == own[inside]
        open_ = open_[~shared]
        step += 1
    return found


def _examined(bound):
    """Of every batch of cells: the pairs looked at, how many passed the filters, and those that match."""

    def run(batch):
        start_a, a_all = members_of(batch.column("a"))
        start_b, b_all = members_of(batch.column("b"))
        strings = Strings(pa.concat_arrays([a_all.field("sku"), b_all.field("sku")]))
        a, b = _Side(a_all, strings.lengths[: len(a_all)]), _Side(b_all, strings.lengths[len(a_all) :])
        diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
        gram = batch.column("gram").to_numpy(zero_copy_only=False)
        n_pairs = np.diff(start_a) * np.diff(start_b)
        looked, passed, found = 0, 0, []

        def match(left, right, of):
            nonlocal passed
            passed += len(left)
            sims = ratio(lcs_pairs(strings, left, len(a_all) + right), a.lengths[left] + b.lengths[right])
            keep(left, right, of, sims)

        def keep(left, right, of, sims):
            reached = np.flatnonzero(sims >= bound.floor)
            own = _first_shared(a, b, left[reached], right[reached], of[reached])
            found.append((left[reached[own]], right[reached[own]], sims[reached[own]]))

        small = np.flatnonzero((n_pairs > 0) & (n_pairs < SMALL_CELL))
        for cell, left, right in _small_cells(small, start_a, start_b, diagonal):
            looked += len(left)
            passing = np.flatnonzero(_passing(bound, (gram[cell] & 1) + 1, a, b, left, right))
            match(left[passing], right[passing], gram[cell[passing]])
        for cell in np.flatnonzero(n_pairs >= SMALL_CELL):
            left, right = np.arange(*start_a[cell : cell + 2]), np.arange(*start_b[cell : cell + 2])
            passing = _passing(bound, int(gram[cell] & 1) + 1, a, b, left[:, None], right[None, :])
            looked += passing.size
            if diagonal[cell]:
                passing &= np.triu(np.ones(passing.shape, dtype=bool), 1)
            i, j = np.nonzero(passing)
            of = np.full(len(i), gram[cell])
            if len(i) * DENSE_SHARE < passing.size:
                match(left[i], right[j], of)
            else:
                passed += len(i)
                table = lcs_table(strings, left, len(a_all) + right)[i, j]
                keep(left[i], right[j], of, ratio(table, a.lengths[left[i]] + b.lengths[right[j]]))
        return a_all, b_all, looked, passed, found

    return run


def _plain(members, at):
    names = [f.split(":")[0] for f in MEMBER[len("struct<") : -1].split(",")]
    return pa.StructArray.from_arrays([members.field(name).take(pa.array(at)) for name in names], names=names)


def _matching(bound):
    examined = _examined(bound)

    def run(batches):
        for batch in batches:
            a, b, _, _, found = examined(batch)
            for left, right, sims in found:
                if len(left):
                    yield pa.RecordBatch.from_arrays(
                        [_plain(a, left), _plain(b, right), pa.array(sims)], names=["a", "b", "sku_sim"]
                    )

    return run


def _counting(bound):
    examined = _examined(bound)

    def run(batches):
        for batch in batches:
            _, _, looked, passed, found = examined(batch)
            numbers = [[x] for x in (looked, passed, sum(len(f[0]) for f in found))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers], names=["looked", "candidates", "matched"])

    return run


def _meeting(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of groups, members): strings with a gram in common; one of two has to be pending."""
    group = F.when(F.col("pending"), F.col("gram")).otherwise(F.col("gram").bitwiseOR(F.lit(2)))
    members = index.select(group.alias("group_id"), "id", "sku", "n", "last", "size", "sig", "grams")
    sides = index.groupBy("gram").agg(F.max("pending").alias("asks"), F.min("pending").alias("alone"))
    asked = sides.where("asks").select(F.col("gram"), F.explode(F.when(F.col("alone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(2)))).alias("k"))
    pairs = asked.select(F.col("gram").alias("group_i"), F.col("gram").bitwiseOR(F.col("k").cast("long")).alias("group_j"), "gram")
    return pairs, members


def _prepared(members: DataFrame, scope, pending) -> DataFrame:
    return members.select(
        "id", "sku", "n", "last", (F.col(scope) if scope else F.lit(0)).cast("long").alias("scope"),
        (F.col(pending) if pending else F.lit(True)).alias("pending"),
    )


def indexed_pairs(members: DataFrame, floor: float, scope: str | None = None, pending: str | None = None) -> DataFrame:
    """(a, b, sku_sim): pairs of `members` (id, sku, n, last) with a ratio of at least `floor`, above 0.

    With `scope`, only members that agree in that column meet; with `pending`, only pairs with a
    member where that column is true. Every pair is found once, by the first gram of both prefixes.
    """
    index = postings(_prepared(members, scope, pending), floor)
    return grid(*_meeting(index), ["gram"], _matching(Bound(floor)), f"a {MEMBER}, b {MEMBER}, sku_sim double")


def examined_pairs(members: DataFrame, floor: float) -> DataFrame:
    """One row: pairs that share an indexed gram (looked), those that pass the filters, and the matches."""
    index = postings(_prepared(members, None, None), floor)
    parts = grid(*_meeting(index), ["gram"], _counting(Bound(floor)), "looked bigint, candidates bigint, matched bigint")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("looked", "candidates", "matched")])


def index_of_fewer(members: DataFrame, floor: float, scope: str | None = None) -> DataFrame | None:
    """The index of `members`, if it would look at fewer pairs than there are."""
    if floor <= FLOOR_SLACK:
        return None
    index = postings(_prepared(members, scope, None), floor)
    n = F.count(F.lit(1)).cast("double")
    by_gram = index.groupBy("gram").agg(n.alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("w"))
    whole = members.groupBy(*([scope] if scope else [])).agg(n.alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("w"))
    return index if by_gram.first()["w"] < (whole.first()["w"] or 0.0) else None


def pairs_above(members: DataFrame, floor: float, scope: str | None = None) -> DataFrame:
    """`indexed_pairs`, or every pair in a grid where the index would look at no fewer pairs than that."""
    index = index_of_fewer(members, floor, scope)
    if index is not None:
        return grid(*_meeting(index), ["gram"], _matching(Bound(floor)), f"a {MEMBER}, b {MEMBER}, sku_sim double")
    if scope:
        groups = members.select(F.col(scope).alias("group_i")).distinct().withColumn("group_j", F.col("group_i"))
        pair, grouped = groups, members.select(F.col(scope).alias("group_id"), "id", "sku", "n", "last")
    else:
        pair, grouped = one_group(members.select("id", "sku", "n", "last"))
    return matching_pairs(pair.withColumn("floor", F.lit(float(floor))), grouped, {})
