"""From raw documents to token files: five text operators one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's documents. Stages that select return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partatlas.llm import bagminhash, decontaminate, mixing, ordinal, tokens
from partatlas.llm.common import freed_shuffles, new_folder

# The classifier is fitted while the pipeline runs, which SQL cannot express.
ORACLE_SQL = None


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of `docs` that `judged` (doc_id, kept) does not reject, rows without an id included."""
    rejected = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def _aside(docs: DataFrame, names: set[str]) -> dict[str, str]:
    """New names for the columns of `docs` that are called like one of `names`."""
    taken = set(docs.columns) | names
    return {c: next(n for k in range(len(taken) + 1) if (n := f"given_{k}_{c}") not in taken) for c in docs.columns if c in names}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is not below one half.

    Null and empty texts are judged by their shape; all columns are handed on as they are.
    """
    aside = _aside(docs, {"expected_grade", "tail_probability", "kept"})
    judged = ordinal.classify(docs.withColumnsRenamed(aside), _table(spark, sf_dir, "labels")).where("kept")
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return _judged(docs, bagminhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return _judged(docs, decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the mix counts words, so texts without words go.

    Rows keep all their columns, whatever these are called.
    """
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source"), mixing.label_weights(_table(spark, sf_dir, "labels")))
    taken = (
        mixed.where(F.col("size") > 0)
        .groupBy("doc_id", "source", "size")
        .agg(F.max("taken").alias("taken"))
        .select(
            F.col("doc_id").alias("of"),
            F.col("source").alias("from"),
            F.col("size").alias("words"),
            F.floor(F.col("taken") / F.col("size")).cast("int").alias("times"),
        )
        .where(F.col("times") > 0)
    )
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("of"))
        & F.col("row.source").eqNullSafe(F.col("from"))
        & (mixing.word_count(F.col("row.text")) == F.col("words"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    return rows.join(taken, same).select("row", copies).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from its token files."""
    path = new_folder(spark, "tokens")
    with freed_shuffles(spark):
        tokens.write_token_files(docs, path)
    return tokens.read_token_files(spark, path, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each but the last is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_folder(spark, f"stage{k}")
            with freed_shuffles(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
