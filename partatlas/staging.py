"""Intermediate tables on the shared folder of the cluster.

Iterative jobs and tables that several branches read are written once and read
back, which cuts the lineage, survives lost executors and gives later stages
column pruning and exact sizes.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="partatlas-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return _own_folder[app]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and return a scan of the written table.

    With `by`, the table is laid out by that (number) column, so that reading
    one value reads only its files.
    """
    spark = df.sparkSession
    path = new_path(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
