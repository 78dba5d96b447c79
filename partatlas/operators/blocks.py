"""Members of groups against each other, block against block.

This is the layout under every operator that has to compare members with each other. Groups
are cut into blocks of equal size, and every two blocks that have to meet do so in a cell.
A group of B blocks has B² / 2 cells of equal work: B (B − 1) / 2 with two blocks, and B / 2 that
hold two blocks which only meet themselves. Each member is sent to B cells, however many
pairs it has, and large cells have a task each by an explicit number. Inside a task a
cell is worked off in tiles, so pairs exist only a tile at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partatlas.operators.skew import attach_by_key
from partatlas.staging import stage

TILE = 512  # members of a tile on either side
BLOCK_ROWS = 32_768  # members of a block at most, so a task holds twice as many
CELLS_PER_CORE = 4
FEW_ROWS = 500  # of a table of groups that the driver holds
SMALL_SHARE = 8  # cells of less than this part of a full cell's work share tasks

_LAYOUT = ("_part", "_group_i", "_group_j", "_block_i", "_block_j", "_side")


def one_group(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair of the single group 0 with itself, and `members` put into it."""
    group = members.sparkSession.range(1)
    pair = group.select(F.col("id").alias("group_i"), F.col("id").alias("group_j"))
    return pair, members.withColumn("group_id", F.lit(0).cast("long"))


def two_groups(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair of the groups 0 and 1, and `left` and `right` (of equal columns) put into them."""
    group = left.sparkSession.range(1)
    pair = group.select(F.col("id").alias("group_i"), (F.col("id") + 1).alias("group_j"))
    tagged = [df.withColumn("group_id", F.lit(k).cast("long")) for k, df in enumerate((left, right))]
    return pair, tagged[0].unionByName(tagged[1])


def _block_rows(work: float, cores: int) -> int:
    """Members of a block: a tile at least, and so many that all cells together are some for each core."""
    return int(min(max(np.sqrt(work / (CELLS_PER_CORE * cores)), TILE), BLOCK_ROWS))


def _held(table: DataFrame) -> DataFrame:
    """`table` as it is now: from the driver if it has few rows, else written."""
    rows = table.limit(FEW_ROWS + 1).collect()
    return table.sparkSession.createDataFrame(rows, table.schema) if len(rows) <= FEW_ROWS else stage(table)


def layout(group_pairs: DataFrame, members: DataFrame, position: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(cells, blocked members, number of tasks) for pairs of groups (group_i, group_j, further columns).

    Every cell says which block of either group meets which, and its task `_part`. Blocked members
    carry `_block`, picked by the hash of `id`, or as equal ranges of their `position` in the group (0, 1, …).
    """
    spark = members.sparkSession
    sizes = _held(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")))
    same = F.col("group_i") == F.col("group_j")
    sized = _held(
        group_pairs.join(sizes.toDF("group_i", "_n_i"), "group_i")
        .join(sizes.toDF("group_j", "_n_j"), "group_j")
        .withColumn("_work", F.col("_n_i").cast("double") * F.col("_n_j") / F.when(same, 2).otherwise(1))
    )
    work = sized.agg(F.coalesce(F.sum("_work"), F.lit(0.0)).alias("w")).first()["w"]
    rows = _block_rows(work, spark.sparkContext.defaultParallelism)

    def blocks(n):
        # an even number, so that blocks which meet themselves come in twos
        return F.when(F.col(n) <= rows, 1).otherwise(2 * F.ceil(F.col(n) / F.lit(2 * rows))).cast("int")

    cut = sized.withColumns({"_b_i": blocks("_n_i"), "_b_j": blocks("_n_j")})
    tasks_of = F.when(same & (F.col("_b_i") > 1), F.col("_b_i") * F.col("_b_j") / 2).otherwise(F.col("_b_i") * F.col("_b_j"))
    large = (F.col("_work") * SMALL_SHARE >= float(rows) * rows) | (F.col("_b_i") > 1) | (F.col("_b_j") > 1)
    cut = cut.withColumns({"_tasks": tasks_of.cast("long"), "_large": large})
    # large pairs are few: each has at least an eighth of a task's work or a full block
    before = Window.orderBy("group_i", "group_j").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.where("_large").withColumn("_first", F.coalesce(F.sum("_tasks").over(before), F.lit(0)))
    total = cut.groupBy("_large").agg(
        F.sum("_tasks").alias("t"), F.sum("_work").alias("w"), F.sum(F.col("_n_i") + F.col("_n_j")).alias("r")
    )
    found = {r["_large"]: r for r in total.collect()}
    first_small = int(found[True]["t"]) if True in found else 0
    shared = 0
    if False in found:
        shared = max(1, int(np.ceil(max(found[False]["w"] / (float(rows) * rows), found[False]["r"] / BLOCK_ROWS))))
    spread = F.pmod(F.xxhash64("group_i", "group_j"), F.lit(max(shared, 1))) + first_small
    placed = numbered.unionByName(cut.where("NOT _large").withColumn("_first", spread))
    low, high = F.col("_block_i"), F.col("_block_j")
    inner = F.when(
        same & (F.col("_b_i") > 1),
        F.when(low == high, F.col("_b_i") * (F.col("_b_i") - 1) / 2 + F.floor(low / 2)).otherwise(high * (high - 1) / 2 + low),
    ).otherwise(low * F.col("_b_j") + high)
    cells = (
        placed.withColumn("_block_i", F.explode(F.sequence(F.lit(0), F.col("_b_i") - 1)))
        .withColumn("_block_j", F.explode(F.sequence(F.when(same, F.col("_block_i")).otherwise(F.lit(0)), F.col("_b_j") - 1)))
        .withColumn("_part", (F.col("_first") + F.when(F.col("_large"), inner).otherwise(0)).cast("int"))
    )
    sized_members = attach_by_key(members, sizes, "group_id", "_n", ["id"])
    block = F.floor(F.col(position) * blocks("_n") / F.col("_n")) if position else F.pmod(F.xxhash64("id"), blocks("_n"))
    blocked = sized_members.withColumn("_block", block.cast("int")).drop("_n")
    return cells, blocked, max(1, first_small + shared)


def grid(
    group_pairs: DataFrame, members: DataFrame, keep: list[str], function, schema: str, tiles: int = 1, position: str | None = None
) -> DataFrame:
    """`function`, an Arrow function, over the tiles of all members of every pair of groups.

    `members` are (group_id, id, further fields), `group_pairs` (group_i, group_j, `keep`…). The batches
    that `function` gets have a row per tile: the `keep` columns, the lists `a` and `b` of members as
    structs by ascending id, and `diagonal` where both are the same list. Tiles have `tiles` times TILE members a side.
    With `position`, a column that is not handed on, blocks are ranges of it.
    """
    fields = ["id", *[c for c in members.columns if c not in ("group_id", "id", position)]]
    cells, blocked, tasks = layout(group_pairs, members, position)
    same = (F.col("group_i") == F.col("group_j")) & (F.col("_block_i") == F.col("_block_j"))
    sides = []
    for side, (group, block) in enumerate((("group_i", "_block_i"), ("group_j", "_block_j"))):
        wanted = cells if side == 0 else cells.where(~same)
        mine = blocked.select(F.col("group_id").alias("_g"), F.col("_block").alias("_k"), F.struct(*fields).alias("_member"))
        joined = wanted.join(mine, (F.col(group) == F.col("_g")) & (F.col(block) == F.col("_k")))
        sides.append(
            joined.select(
                "_part",
                F.col("group_i").alias("_group_i"),
                F.col("group_j").alias("_group_j"),
                "_block_i",
                "_block_j",
                F.lit(side).alias("_side"),
                *keep,
                "_member",
            )
        )
    rows = sides[0].unionByName(sides[1])
    return rows.repartitionById(tasks, F.col("_part")).mapInArrow(_tiled(keep, function, tiles * TILE), schema)


def _tiled(keep, function, tile):
    """Arrow function over a task's rows: sorts them by cell and hands their tiles to `function`."""

    def run(batches):
        held = list(batches)
        if not sum(batch.num_rows for batch in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        member = table.column("_member").chunk(0)
        keys = [table.column(name).to_numpy() for name in _LAYOUT[1:]]
        order = np.lexsort([member.field("id").to_numpy(zero_copy_only=False), *reversed(keys)])
        member = member.take(pa.array(order))
        keys = [k[order] for k in keys]
        kept = [table.column(name).chunk(0) for name in keep]
        fresh = np.zeros(len(order), dtype=bool)
        fresh[0] = True
        for k in keys[:-1]:
            fresh[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(order))
        first_b = starts + np.add.reduceat((keys[-1] == 0).astype(np.int64), starts)
        diagonal = (keys[0] == keys[1])[starts] & (keys[2] == keys[3])[starts]
        yield from function(_tiles(member, kept, keep, order[starts], starts, first_b, ends, diagonal, tile))

    return run


def _tiles(member, kept, keep, row, starts, first_b, ends, diagonal, tile):
    """Batches of tiles; cells that fit into a tile come many at a time."""

    def batch(parts):
        cell, a0, a1, b0, b1, diag = (np.array(x) for x in zip(*parts))
        columns = [column.take(pa.array(row[cell])) for column in kept]
        return pa.RecordBatch.from_arrays(
            [*columns, _lists(member, a0, a1), _lists(member, b0, b1), pa.array(diag)], names=[*keep, "a", "b", "diagonal"]
        )

    waiting, held = [], 0
    for cell in range(len(starts)):
        a0, a1, b0, b1 = starts[cell], first_b[cell], first_b[cell], ends[cell]
        own = bool(diagonal[cell])
        if own:
            b0, b1 = a0, a1
        if a0 == a1 or b0 == b1:
            continue
        if max(a1 - a0, b1 - b0) <= tile:
            waiting.append((cell, a0, a1, b0, b1, own))
            held += a1 - a0 + b1 - b0
            if held >= 4 * TILE:
                yield batch(waiting)
                waiting, held = [], 0
            continue
        for a in range(a0, a1, tile):
            for b in range(a if own else b0, b1, tile):
                yield batch([(cell, a, min(a + tile, a1), b, min(b + tile, b1), own and a == b)])
    if waiting:
        yield batch(waiting)


def _lists(member, begin, end):
    """One list of members for every range."""
    counts = end - begin
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], counts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), member.take(pa.array(at)))


def members_of(column):
    """Start of every list and all members of an Arrow list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()
