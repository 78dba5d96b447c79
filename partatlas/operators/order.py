"""Positions in a global order without a global task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas.staging import stage

_LOW = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def positions(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, … by ascending `order`, which has to be unique.

    The table is range partitioned and sorted; each row's number inside its
    partition is shifted by the rows of the partitions before it. Only one count
    per partition passes through the driver.
    """
    sorted_parts = stage(
        table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
            "_mono", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("_mono", _LOW)
    counts = sorted_parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, before = [], 0
    for part_id, n in sorted((r["_part"], r["n"]) for r in counts):
        starts.append((part_id, before))
        before += n
    shift = table.sparkSession.createDataFrame(starts or [(0, 0)], "_part bigint, _first bigint")
    return (
        sorted_parts.withColumn("_part", part)
        .join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_first") + F.col("_mono").bitwiseAND(F.lit((1 << _LOW) - 1)))
        .drop("_part", "_first", "_mono")
    )
