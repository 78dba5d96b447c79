"""Joins that stay balanced when a few keys hold a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task may take. The list of keys above it, which is broadcast, has at
# most one entry per TASK_ROWS rows of the table: a million entries for 10^12 rows.
TASK_ROWS = 1_000_000
# Rows of one key on either side of a self join that meet in a task.
PAIR_ROWS = 4_000


def _pieces(rows_of_key: Column, limit: int) -> Column:
    return F.greatest(F.ceil(rows_of_key / F.lit(limit)), F.lit(1)).cast("int")


def attach_by_key(
    rows: DataFrame, facts: DataFrame, key: str, rows_of_key: str, spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join many `rows` per key with one row of `facts` per key.

    `facts[rows_of_key]` says how many rows the key has. Keys of more than `TASK_ROWS` rows
    are cut into pieces by the hash of `spread`, and their fact row is repeated once per piece.
    """
    pieces = _pieces(F.col(rows_of_key), TASK_ROWS)
    hot = F.broadcast(facts.where(pieces > 1).select(key, pieces.alias("_pieces")))
    piece = F.pmod(F.xxhash64(*spread), F.coalesce("_pieces", F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn("_piece", piece).drop("_pieces")
    right = facts.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right, [key, "_piece"], how).drop("_piece")


def self_join_by_key(rows: DataFrame, key: str, identity: str, condition, select: list) -> DataFrame:
    """Pairs of rows with the same key that meet `condition(left, right)`.

    The rows of a key are cut into pieces of about `PAIR_ROWS`, and every piece on the left
    meets every piece on the right in a cell of its own, so a task never forms more than
    PAIR_ROWS² pairs of one key at a time, however many rows the key has.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    pieces = _pieces(F.col("_n"), PAIR_ROWS)
    cut = attach_by_key(rows, counts, key, "_n", [identity]).withColumn(
        "_own", F.pmod(F.xxhash64(F.lit("piece"), identity), pieces).cast("int")
    )
    others = F.explode(F.sequence(F.lit(0), pieces - 1))
    left = cut.withColumn("_other", others).drop("_n").alias("l")
    right = cut.withColumn("_other", others).drop("_n").alias("r")
    same = (
        (F.col(f"l.{key}") == F.col(f"r.{key}"))
        & (F.col("l._own") == F.col("r._other"))
        & (F.col("l._other") == F.col("r._own"))
    )
    return left.join(right, same & condition).select(*select)
