"""What several text operators share: words, intermediate tables, hashing in tasks."""

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partatlas.staging import shared_folder, stage

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SHINGLE = 5

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of every write are freed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back."""
    with freed_shuffles(df.sparkSession):
        return stage(df)


def new_folder(spark: SparkSession, kind: str) -> str:
    """Path of a new folder in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """The words of a text, lower case, none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(x):
    """Finaliser that spreads every bit of 64-bit numbers (arrays, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of every word seen, so that a repeated word is hashed once."""

    LIMIT = 150_000

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts, known):
    """(hashes of all words, offsets by text) of a list of byte strings."""
    parts = [t.split() for t in texts]  # on ASCII white space, as WORD
    ends = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.fromiter((known[w] for p in parts for w in p), dtype=np.uint64, count=int(ends[-1]))
    return flat, ends


def sub_batches(texts, budget=1_500_000):
    """Ranges (begin, end) of texts with about `budget` bytes each, one text at least."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= budget:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column):
    """Arrow strings as a list of byte strings, null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]
