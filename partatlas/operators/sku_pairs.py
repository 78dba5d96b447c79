"""Indel similarity of catalogue numbers, computed block against block.

The pairs of a cell only ever exist as numpy arrays inside a task, which hands
on either the pairs above the cell's floor or per-member sums.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.functions.forest import spanning_edges
from partatlas.functions.lcs import Strings, lcs_pairs, ratio, tables_of_lengths
from partatlas.operators.blocks import BLOCK_ROWS, TILE, grid, members_of, one_group
from partatlas.operators.order import positions

SMALL_CELL = 4096  # cells with fewer pairs are handled many at a time
SLICE = 1 << 19
LOOKUP_ROWS = 4096
NEIGHBOURS = 1024  # strings compared with the next one at a time
LINKS = 1 << 20  # of a level that a task holds
FLOOR_SLACK = 3e-9  # above what rounding cosine and score to nine digits can move a ratio

MEMBER = "struct<id:bigint,sku:string,n:bigint,last:bigint>"
WHOLE = BLOCK_ROWS // TILE  # `tiles` of `grid` at which a cell is one tile
PROFILE = (
    "id bigint, partners bigint, total double, row_total double, high_partners bigint, "
    "high_total double, top double, top_id bigint"
)


def _both_sides(batch):
    start_a, a = members_of(batch.column("a"))
    start_b, b = members_of(batch.column("b"))
    strings = Strings(pa.concat_arrays([a.field("sku"), b.field("sku")]))
    return start_a, a, start_b, b, strings


def _floored(strings, left, right, floor):
    """Positions and ratios of the given pairs that reach their floor."""
    la, lb = strings.lengths[left], strings.lengths[right]
    possible = np.flatnonzero(ratio(np.minimum(la, lb), la + lb) >= floor - FLOOR_SLACK)
    lcs = lcs_pairs(strings, left[possible], right[possible])
    sims = ratio(lcs, (la + lb)[possible])
    reached = sims >= floor[possible] - FLOOR_SLACK
    return possible[reached], sims[reached]


def _small_cells(cells_at, start_a, start_b, diagonal):
    """All pairs of the listed cells as (cell, position in a, position in b), in slices."""
    sizes = (np.diff(start_a) * np.diff(start_b))[cells_at]
    begin = 0
    while begin < len(cells_at):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), SLICE)))
        part = cells_at[begin:end]
        cell = np.repeat(part, sizes[begin:end])
        within = np.arange(len(cell)) - np.repeat(np.cumsum(sizes[begin:end]) - sizes[begin:end], sizes[begin:end])
        width = np.diff(start_b)[cell]
        left = start_a[cell] + within // width
        right = start_b[cell] + within % width
        upper = ~diagonal[cell] | (within // width < within % width)
        yield cell[upper], left[upper], right[upper]
        begin = end


def _least(lengths, other, threshold):
    """Per length, the least LCS with a string of length `other` whose ratio reaches the threshold."""
    possible = np.arange(min(int(lengths.max(initial=0)), other) + 1)
    short = ratio(possible[None, :], (lengths + other)[:, None]) < threshold
    return short.sum(axis=1)  # the ratio ascends with the LCS


def _cells(batch):
    """The cells of a batch that have few pairs, as a batch of their own, and the others as (cell, members, members, diagonal)."""
    (start_a, a), (start_b, b) = (members_of(batch.column(side)) for side in ("a", "b"))
    n_pairs = np.diff(start_a) * np.diff(start_b)
    diagonal = batch.column("diagonal").to_numpy(zero_copy_only=False)
    few = np.flatnonzero((n_pairs > 0) & (n_pairs < SMALL_CELL))

    def large():
        for cell in np.flatnonzero(n_pairs >= SMALL_CELL):
            sides = [x.slice(start[cell], start[cell + 1] - start[cell]) for x, start in ((a, start_a), (b, start_b))]
            yield cell, *sides, bool(diagonal[cell])

    return batch.take(pa.array(few)), large()


def _near(a, b, diagonal, least_of):
    """(rows, columns, LCS, where each function of `least_of` is reached)s for every two members of a cell, where one is reached at all."""
    lengths = [pc.utf8_length(x.field("sku")).to_numpy(zero_copy_only=False) for x in (a, b)]
    for rows, columns, lcs, wanted in tables_of_lengths(a.field("sku"), b.field("sku"), diagonal):
        highest, la, lb = lcs.max(), lengths[0][rows[:1]].astype(np.int64), int(lengths[1][columns[0]])
        least = [int(needed(la, lb)[0]) for needed in least_of]
        if highest < min(least):
            continue
        near = [lcs >= x if x <= highest else np.zeros(lcs.shape, dtype=bool) for x in least]
        if wanted is not None:
            near = [x & wanted for x in near]
        yield rows, columns, lcs, near, int(la[0]) + lb


def _matching(keep):
    """Arrow function: the pairs of every cell whose ratio reaches `floor`."""

    def found(batch, cell, left, right, sims):
        columns = [batch.column(name).take(pa.array(cell)) for name in keep]
        return pa.RecordBatch.from_arrays([*columns, left, right, pa.array(sims)], names=[*keep, "a", "b", "sku_sim"])

    def run(batches):
        for batch in batches:
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            few, large = _cells(batch)
            if few.num_rows:
                start_a, a, start_b, b, strings = _both_sides(few)
                diagonal, floor = (few.column(name).to_numpy(zero_copy_only=False) for name in ("diagonal", "floor"))
                for cell, left, right in _small_cells(np.arange(few.num_rows), start_a, start_b, diagonal):
                    at, sims = _floored(strings, left, len(a) + right, floor[cell])
                    yield found(few, cell[at], a.take(pa.array(left[at])), b.take(pa.array(right[at])), sims)
            for cell, a, b, diagonal in large:
                least = partial(_least, threshold=floors[cell] - FLOOR_SLACK)
                for rows, columns, lcs, (near,), lengths in _near(a, b, diagonal, [least]):
                    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                    sims = ratio(lcs[i, j], np.full(len(i), lengths))
                    yield found(batch, np.full(len(i), cell), a.take(pa.array(rows[i])), b.take(pa.array(columns[j])), sims)

    return run


def matching_pairs(group_pairs: DataFrame, members: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Member pairs of every (group_i, group_j, floor) whose ratio reaches the floor.

    `keep` names further columns of `group_pairs` and their types. Where both
    groups are the same, every unordered pair of members is looked at once.
    """
    kept = "".join(f"{name} {kind}, " for name, kind in keep.items())
    schema = f"{kept}a {MEMBER}, b {MEMBER}, sku_sim double"
    return grid(group_pairs, members, [*keep, "floor"], _matching(list(keep)), schema, WHOLE)


def _totals(table, most):
    """Sums of a table of numbers up to `most`, by row and by column."""
    rows, columns = table.shape
    if table.dtype != np.uint8:
        return table.sum(axis=1, dtype=np.int64), table.sum(axis=0, dtype=np.int64)
    # so many bytes can be added as bytes
    few = min(255 // max(int(most), 1), 16)
    whole, wide = rows // few * few, columns // few * few
    by_row = np.add.reduce(table[:, :wide].reshape(rows, few, -1), axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    by_column = np.add.reduce(table[:whole].reshape(-1, few, columns), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return by_row + table[:, wide:].sum(axis=1, dtype=np.int64), by_column + table[whole:].sum(axis=0, dtype=np.int64)


class _Profiles:
    """What the members of one side have seen of the other side so far; as best partner, of their own side too."""

    def __init__(self, members):
        self.ids, self.n = (members.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n"))
        self.several = self.n != 1
        self.total, self.row_total, self.high_total = (np.zeros(len(self.ids)) for _ in range(3))
        self.high_partners, self.top_id = (np.zeros(len(self.ids), dtype=np.int64) for _ in range(2))
        self.top = np.full(len(self.ids), -1.0)
        self.start(members.field("sku"))

    def start(self, skus):
        """Next to each other in their order, strings are partners that few others exceed."""
        order = pc.sort_indices(skus).to_numpy()
        for begin in range(0, len(order) - 1, NEIGHBOURS):
            at = order[begin : begin + NEIGHBOURS + 1]
            strings, left = Strings(skus.take(pa.array(at))), np.arange(len(at) - 1)
            sims = ratio(lcs_pairs(strings, left, left + 1), strings.lengths[:-1] + strings.lengths[1:])
            for mine, found in ((at[:-1], self.ids[at[1:]]), (at[1:], self.ids[at[:-1]])):
                self.take_over(mine, sims, found)

    def take_over(self, at, sims, found):
        better = (sims > self.top[at]) | ((sims == self.top[at]) & (found < self.top_id[at]))
        self.top[at[better]], self.top_id[at[better]] = sims[better], found[better]

    def add(self, at, table, other, columns, sums, share):
        """The `table` (a row per position in `at`) of LCS with the members of `other` at `columns`."""
        self.total[at] += share(sums)
        more = np.flatnonzero(other.several[columns])
        if len(more):
            sums = sums + table[:, more].astype(np.float64) @ (other.n[columns[more]] - 1.0)
        self.row_total[at] += share(sums)

    def add_high(self, at, counts, sums, share):
        self.high_partners[at] += counts
        self.high_total[at] += share(sums)

    def look(self, at, table, most, other, columns, share, own=None):
        """Take over better partners; `most` is the highest number of each row, `own` the cells of members with themselves."""
        sims = share(most.astype(np.float64))
        open_ = np.flatnonzero(sims >= self.top[at])
        if not len(open_):
            return
        hit = table[open_] == most[open_, None]
        if own is not None:
            hit &= ~own[open_]
        row, column = np.divmod(np.flatnonzero(hit), table.shape[1])
        if not len(row):
            return
        ids = other.ids[columns[column]]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        row = open_[row[starts]]
        self.take_over(at[row], sims[row], np.minimum.reduceat(ids, starts))

    def batch(self, partners):
        columns = [self.ids, np.full(len(self.ids), partners, dtype=np.int64), self.total, self.row_total]
        columns += [self.high_partners, self.high_total, self.top, self.top_id]
        names = ["id", "partners", "total", "row_total", "high_partners", "high_total", "top", "top_id"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _met(a, b, diagonal, threshold):
    """A batch with the profiles of the members of a cell, for each side.

    Tables hold strings of one length a side, so all their pairs have one divisor: sums are formed of
    whole numbers, and a ratio is compared as an LCS.
    """
    mine = _Profiles(a)
    theirs = mine if diagonal else _Profiles(b)
    place = np.full(len(b), -1)
    lengths = [pc.utf8_length(x.field("sku")).to_numpy(zero_copy_only=False) for x in (a, b)]
    for rows, columns, table, _ in tables_of_lengths(a.field("sku"), b.field("sku")):
        la, lb = int(lengths[0][rows[0]]), int(lengths[1][columns[0]])
        both, longest = la + lb, min(la, lb)
        least = int(_least(np.array([la]), lb, threshold)[0])
        if not both:  # empty strings have a ratio of 1 with each other
            table, least, longest, both = table + 1, least + 1, 1, 2

        def share(sums):
            return 2.0 * sums / both

        own = None
        if diagonal:
            place[columns] = np.arange(len(columns))
            met = np.flatnonzero(place[rows] >= 0)
            if len(met):
                own = np.zeros(table.shape, dtype=bool)
                own[met, place[rows[met]]] = True
                table[own] = 0
            place[columns] = -1
        by_row, by_column = _totals(table, longest)
        mine.add(rows, table, theirs, columns, by_row, share)
        mine.look(rows, table, table.max(axis=1), theirs, columns, share, own)
        if not diagonal:
            theirs.add(columns, table.T, mine, rows, by_column, share)
            most = table.max(axis=0)
            theirs.look(columns, table.T, most, mine, rows, share)
        high = table >= least
        if own is not None:
            high &= ~own
        if high.any():
            counts, sums = _totals(high.view(np.uint8), 1), _totals(table * high, longest)
            mine.add_high(rows, counts[0], sums[0], share)
            if not diagonal:
                theirs.add_high(columns, counts[1], sums[1], share)
    yield mine.batch(len(b) - diagonal)
    if not diagonal:
        yield theirs.batch(len(a))


def profiling(threshold):
    """Arrow function: per member of every cell, sums and the best partner over the other side."""

    def run(batches):
        for batch in batches:
            (start_a, a), (start_b, b) = (members_of(batch.column(side)) for side in ("a", "b"))
            for cell, diagonal in enumerate(batch.column("diagonal").to_pylist()):
                own = [x.slice(start[cell], start[cell + 1] - start[cell]) for x, start in ((a, start_a), (b, start_b))]
                yield from _met(*own, diagonal, threshold)

    return run


class _Joined:
    """Components of the members of a cell, by the links seen so far."""

    def __init__(self, n):
        self.label = np.arange(n)

    def joining(self, rows, columns, near, n_near):
        """Some of the links (row, column) of a table that join what was apart, after which all of them are in one component."""
        found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while n_near:
            left, right = self.label[rows], self.label[columns]
            if (left == left[0]).all() and (right == left[0]).all():
                break
            if n_near <= sum(near.shape):
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                apart = left[i] != right[j]
                i, j, n_near = i[apart], j[apart], 0
            else:
                apart = near & (left[:, None] != right)
                i, j = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                if not len(i):
                    break
                i, j = np.concatenate([i, apart[:, j].argmax(axis=0)]), np.concatenate([apart[i].argmax(axis=1), j])
            new = self._united(left[i], right[j])
            found[0].append(i[new])
            found[1].append(j[new])
        return np.concatenate(found[0]), np.concatenate(found[1])

    def _united(self, left, right):
        """Positions of the edges between labels that join two components, one after the other."""
        root, new = {}, []

        def top(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for k, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                new.append(k)
        if new:
            moved = np.arange(len(self.label))
            for x in list(root):
                moved[x] = top(x)
            self.label = moved[self.label]
        return new


class _Links:
    """Links of a task by level, reduced to a spanning forest now and then."""

    def __init__(self, levels):
        self.held, self.size = [[] for _ in range(levels)], [0] * levels

    def add(self, level, src, dst):
        self.held[level].append((src, dst))
        self.size[level] += len(src)
        if self.size[level] > LINKS:
            src, dst = self.reduced(level)
            if len(src) > LINKS // 2:
                yield self.batch(level, src, dst)
                src, dst = src[:0], dst[:0]
            self.held[level], self.size[level] = [(src, dst)], len(src)

    def reduced(self, level):
        src, dst = (np.concatenate(x) for x in zip(*self.held[level])) if self.held[level] else (np.zeros(0, np.int64),) * 2
        return spanning_edges(src, dst)

    @staticmethod
    def batch(level, src, dst, pairs=None):
        columns = [pa.array(np.full(len(src), level, np.int32)), pa.array(src), pa.array(dst), pa.array([pairs] * len(src), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["level", "src", "dst", "pairs"])


def linking(least_of):
    """Arrow function: per level, the row pairs behind all member pairs that reach it, and links that connect as these do.

    `least_of` has a function for every level: the least LCS of strings of some lengths with one of another length.
    """

    def run(batches):
        links, counts = _Links(len(least_of)), [0] * len(least_of)
        for batch in batches:
            few, large = _cells(batch)
            start_a, a, start_b, b, strings = _both_sides(few)
            (ids_a, n_a), (ids_b, n_b) = ([x.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n")] for x in (a, b))
            diagonal = few.column("diagonal").to_numpy(zero_copy_only=False)
            for _, left, right in _small_cells(np.arange(few.num_rows), start_a, start_b, diagonal):
                lcs = lcs_pairs(strings, left, len(a) + right)
                la, lb = strings.lengths[left], strings.lengths[len(a) + right]
                for level, least in enumerate(least_of):
                    reached = np.zeros(len(left), dtype=bool)
                    for length in np.unique(lb):
                        at = np.flatnonzero(lb == length)
                        reached[at] = lcs[at] >= least(la[at], int(length))
                    counts[level] += int(n_a[left[reached]] @ n_b[right[reached]])
                    yield from links.add(level, ids_a[left[reached]], ids_b[right[reached]])
            for _, a, b, diagonal in large:
                (ids_a, n_a), (ids_b, n_b) = ([x.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n")] for x in (a, b))
                joined = [_Joined(len(a) if diagonal else len(a) + len(b)) for _ in least_of]
                for rows, columns, _, tables, _ in _near(a, b, diagonal, least_of):
                    more = np.flatnonzero(n_b[columns] != 1)
                    for level, near in enumerate(tables):
                        n_near = _totals(near.view(np.uint8), 1)[0]
                        counts[level] += int(n_a[rows] @ n_near)
                        if len(more):
                            counts[level] += int(n_a[rows] @ np.rint(near[:, more] @ (n_b[columns[more]] - 1.0)).astype(np.int64))
                        i, j = joined[level].joining(rows, columns if diagonal else len(a) + columns, near, n_near.sum())
                        yield from links.add(level, ids_a[rows[i]], ids_b[columns[j]])
        for level, pairs in enumerate(counts):
            src, dst = links.reduced(level)
            yield links.batch(level, src, dst)
            yield pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "src": pa.array([None], pa.int64()), "dst": pa.array([None], pa.int64()), "pairs": pa.array([pairs], pa.int64())})

    return run


def sku_profile(members: DataFrame, threshold: float) -> DataFrame:
    """Every catalogue number against all others: counts, sums, and the best partner.

    A mean over all partners has no shortcut for LCS, so the work grows with the
    square of the distinct catalogue numbers; what is shuffled stays at one row per
    member and block, and so does what is handed on. Blocks are ranges of the sorted numbers, which
    share beginnings. Ties for the best partner go to the lowest id.
    """
    pair, grouped = one_group(positions(members, ["sku", "id"], "position"))
    parts = grid(pair, grouped, [], profiling(threshold), PROFILE, WHOLE, "position")
    return (
        parts.groupBy("id")
        .agg(
            F.sum("partners").alias("partners"),
            F.sum("total").alias("total"),
            F.sum("row_total").alias("row_total"),
            F.sum("high_partners").alias("high_partners"),
            F.sum("high_total").alias("high_total"),
            F.max(F.struct("top", (-F.col("top_id")).alias("neg_id"))).alias("best"),
        )
        .select(
            "id",
            "partners",
            "total",
            "row_total",
            "high_partners",
            "high_total",
            F.when(F.col("partners") > 0, F.col("best.top")).alias("top"),
            F.when(F.col("partners") > 0, -F.col("best.neg_id")).alias("top_id"),
        )
    )


def ratios(batches):
    """Arrow function: the ratio of the two catalogue numbers of every row."""
    for batch in batches:
        for begin in range(0, batch.num_rows, LOOKUP_ROWS):
            part = batch.slice(begin, LOOKUP_ROWS)
            strings = Strings(part.column(0).to_pylist() + part.column(1).to_pylist())
            left = np.arange(part.num_rows)
            lcs = lcs_pairs(strings, left, left + part.num_rows)
            lengths = strings.lengths[left] + strings.lengths[left + part.num_rows]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(ratio(lcs, lengths))], names=[*batch.schema.names[:2], "sku_sim"])


def sku_similarity(a, b):
    """The same ratio as a column expression, to check the others by."""
    row = F.aggregate(
        F.split(a, ""),
        F.array_repeat(F.lit(0), F.length(b) + 1),
        lambda previous, ch: F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda built, at: F.concat(
                built,
                F.array(
                    F.when(F.substring(b, at, F.lit(1)) == ch, F.element_at(previous, at) + 1).otherwise(
                        F.greatest(F.element_at(previous, at + 1), F.element_at(built, -1))
                    )
                ),
            ),
        ),
    )
    total = F.length(a) + F.length(b)
    lcs = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(row, -1))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs / total)
