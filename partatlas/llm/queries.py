"""One query per text operator, over whole tables with production parameters."""

from pyspark.sql import functions as F

from partatlas.llm import (
    bagminhash,
    chat,
    collocations,
    decontaminate,
    divergence,
    embeddings,
    langid,
    lines,
    mixing,
    ordinal,
    suffix,
    tokens,
    warc,
)
from partatlas.llm.common import freed_shuffles, new_folder, written


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark, sf_dir):
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, chat.LEARNED, hard)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_conversations(written(chat.format_conversations(turns)))


def op2_vector_links(spark, sf_dir):
    return embeddings.vector_links(_table(spark, sf_dir, "embeddings"))


def op3_near_duplicates(spark, sf_dir):
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    path = new_folder(spark, "tokens")
    with freed_shuffles(spark):
        tokens.write_token_files(_table(spark, sf_dir, "documents"), path)
    return written(tokens.read_token_files(spark, path, with_ids=False))  # a few numbers per document, decoded once


def op5_mixing(spark, sf_dir):
    weights = mixing.label_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights)


def op6_warc(spark, sf_dir):
    path = new_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        warc.page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op7_line_dedup(spark, sf_dir):
    return lines.remove_boilerplate(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_quality(spark, sf_dir):
    scored = ordinal.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "expected_grade", "tail_probability", "kept")


def op9_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op11_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_vector_links,
        op3_near_duplicates,
        op4_token_files,
        op5_mixing,
        op6_warc,
        op7_line_dedup,
        op8_quality,
        op9_suffix_dedup,
        op10_decontamination,
        op11_divergence,
        op12_language_id,
        op13_collocations,
    )
}
