"""Text completion as a Spark job: prompts, calls, enrichment and category fallback.

The caller supplies the function that answers prompts; the job around it asks
every distinct prompt once, bounds how many calls run at a time by the number of
partitions of a wave, and turns a failing prompt into a row with an error.
"""

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import categorize
from partatlas.operators.skew import attach_by_key
from partatlas.sources.files import exists
from partatlas.staging import new_path, stage

CALLS_AT_ONCE = 8
PROMPTS_PER_CALL = 256
CALLS_PER_WAVE = 16  # of each partition
_WORD = re.compile("[a-z0-9]{2,}")
_ANSWERS = "result string, status string, error string, _key binary"

Complete = Callable[[Sequence[str]], Sequence[str]]


@dataclass(frozen=True)
class Calls:
    """How prompts are asked: so many calls at once, and a folder that keeps the answers for later runs."""

    at_once: int = CALLS_AT_ONCE
    store: str | None = None


def offline_complete(prompts: Sequence[str]) -> list[str]:
    """Deterministic stand-in for a service: the first three words after the last colon.

    A prompt without a word there has no answer and fails.
    """
    answers = []
    for prompt in prompts:
        if prompt is None:
            answers.append(float("nan"))
            continue
        words = _WORD.finditer(prompt.rsplit(":", 1)[-1].lower())
        said = [word.group() for word in islice(words, 3)]
        if not said:
            raise ValueError("nothing to say")
        answers.append(" ".join(said))
    return answers


def _ask(complete: Complete, prompts: list[str]) -> list[tuple]:
    """Answers of a batch; if the batch fails, every prompt is asked on its own."""
    try:
        return [(str(a).strip(), "ok", None) for a in complete(prompts)]
    except Exception:
        answers = []
        for prompt in prompts:
            try:
                answers.append((str(complete([prompt])[0]).strip(), "ok", None))
            except Exception as error:
                answers.append((S.UNKNOWN, "failed", str(error)))
        return answers


def _calling(complete: Complete):
    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), PROMPTS_PER_CALL):
                prompts = frame["prompt"].iloc[at : at + PROMPTS_PER_CALL].tolist()
                answers = _ask(complete, prompts)
                yield pd.DataFrame(answers, columns=["result", "status", "error"]).assign(_key=frame["_key"].iloc[at : at + PROMPTS_PER_CALL].tolist())

    return run


def complete_text(
    prompted: DataFrame, complete: Complete, calls_at_once: int = CALLS_AT_ONCE, store: str | None = None
) -> DataFrame:
    """`prompted` (with row_id and prompt) plus result, status and error.

    Prompts are asked in waves of a bounded number, and the answers of every wave are written
    before the next begins. The open prompts are laid out by wave once, so a wave reads its own
    only. A task that fails asks its part of one wave again. With `store`, a folder for answers,
    a later run asks only prompts that have no good answer there.
    """
    spark = prompted.sparkSession
    rows = stage(prompted.withColumn("_key", F.unhex(F.sha2("prompt", 256))))
    distinct = rows.groupBy("_key").agg(F.first("prompt").alias("prompt"))
    path = store or new_path(spark)
    if store and exists(spark, store):
        good = spark.read.schema(_ANSWERS).parquet(store).where("status = 'ok'")
        distinct = distinct.join(good, "_key", "left_anti")
    # how many prompts are open is only known once they are written, so the key says the wave
    waves = max(1, -(-rows.select("_key").distinct().count() // (calls_at_once * PROMPTS_PER_CALL * CALLS_PER_WAVE)))
    wave = F.pmod(F.xxhash64("_key"), F.lit(waves)).cast("int")
    open_ = stage(distinct.withColumn("wave", wave).repartition("wave"), by="wave")
    for now in sorted(r["wave"] for r in open_.select("wave").distinct().collect()):
        asked = open_.where(F.col("wave") == now).repartition(calls_at_once, "_key").select("prompt", "_key").mapInPandas(_calling(complete), _ANSWERS)
        asked.write.mode("append").parquet(path)
    if not exists(spark, path):
        spark.createDataFrame([], _ANSWERS).write.parquet(path)
    answer = F.max_by(F.struct("result", "status", "error"), F.col("status") == "ok").alias("a")
    answers = asked_prompts(spark, path).groupBy("_key").agg(answer).select("_key", "a.*")
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return attach_by_key(rows, answers.join(counts, "_key"), "_key", "_n", [S.ROW]).drop("_key", "_n")


def asked_prompts(spark, store: str) -> DataFrame:
    """The log of a folder of answers: result, status and error of every prompt that was asked."""
    return spark.read.schema(_ANSWERS).parquet(store)


def _given(items: DataFrame, column: str, default: str = "") -> Column:
    return F.coalesce(F.col(column), F.lit(default)) if column in items.columns else F.lit(default)


def _text(items: DataFrame) -> Column:
    return _given(items, S.ENRICHED if S.ENRICHED in items.columns else S.DESCRIPTION)


# The wording of the prompts.
def enrichment_prompt(items: DataFrame) -> Column:
    return F.concat(
        F.lit("Create an enriched part description in plain English (10 words or less). CatalogNo: "),
        _given(items, S.CATALOG),
        F.lit(", Manufacturer: "),
        _given(items, S.MFR),
        F.lit(", Abbreviated Description: "),
        _given(items, S.DESCRIPTION),
        F.lit("."),
    )


def _part(items: DataFrame) -> Column:
    return F.concat(
        F.lit("CatalogNo: "),
        _given(items, S.CATALOG),
        F.lit(", Manufacturer: "),
        _given(items, S.MFR, S.UNKNOWN),
        F.lit(", Description: "),
        _text(items),
    )


def main_prompt(items: DataFrame, short: bool = False) -> Column:
    if short:
        return F.concat(F.lit("Determine the main category for: "), _text(items))
    return F.concat(F.lit("Determine the main category for this electrical part. "), _part(items))


def sub_prompt(items: DataFrame, main: Column, short: bool = False) -> Column:
    if short:
        return F.concat(
            F.lit("Determine the sub-category for: "), _text(items), F.lit(" (main category: "), main, F.lit(")")
        )
    return F.concat(
        F.lit("Determine the sub-category for this electrical part. "), _part(items), F.lit(", Main Category: "), main
    )


def category_prompts(items: DataFrame, main: str, short: bool = False) -> DataFrame:
    """(row_id, main_prompt, sub_prompt) with the main answer taken from column `main`."""
    return items.select(
        S.ROW,
        main_prompt(items, short).alias("main_prompt"),
        sub_prompt(items, F.col(main), short).alias("sub_prompt"),
    )


def enrich_descriptions(items: DataFrame, complete: Complete, calls: Calls = Calls()) -> tuple[DataFrame, DataFrame]:
    """Items with the enriched column, and the completion log."""
    prompted = items.select(S.ROW, enrichment_prompt(items).alias("prompt"))
    log = stage(complete_text(prompted, complete, calls.at_once, calls.store))
    answers = log.select(S.ROW, F.col("result").alias(S.ENRICHED))
    return items.drop(S.ENRICHED).join(answers, S.ROW), log


def _two_passes(items: DataFrame, complete: Complete, short: bool, calls: Calls) -> DataFrame:
    """(row_id, main_answer, sub_answer, failed, error): the sub prompt embeds the main answer.

    A row whose main prompt fails is not asked for a sub-category.
    """
    asked = items.select(S.ROW, main_prompt(items, short).alias("prompt"))
    first = stage(complete_text(asked, complete, calls.at_once, calls.store)).select(
        S.ROW, F.col("result").alias("main_answer"), F.col("status").alias("main_status"), F.col("error").alias("main_error")
    )
    answered = items.join(first.where(F.col("main_status") == "ok"), S.ROW)
    second = stage(
        complete_text(
            answered.select(S.ROW, sub_prompt(items, F.col("main_answer"), short).alias("prompt")),
            complete,
            calls.at_once,
            calls.store,
        )
    ).select(S.ROW, F.col("result").alias("sub_answer"), F.col("status").alias("sub_status"), F.col("error").alias("sub_error"))
    failed = ~(F.col("main_status").eqNullSafe("ok") & F.col("sub_status").eqNullSafe("ok"))
    return first.join(second, S.ROW, "left").select(
        S.ROW, "main_answer", "sub_answer", failed.alias("failed"), F.coalesce("main_error", "sub_error").alias("error")
    )


def reevaluate_categories(items: DataFrame, complete: Complete, calls: Calls = Calls()) -> DataFrame:
    """Categories of every row by completion, with change flags.

    Where only the sub prompt fails, the main answer is given up as well.
    """
    answers = _two_passes(items, complete, False, calls)
    known = answers.select(
        S.ROW,
        F.when(F.col("failed"), F.lit(S.UNKNOWN)).otherwise(F.col("main_answer")).alias("llm_main_category"),
        F.when(F.col("failed"), F.lit(S.UNKNOWN)).otherwise(F.col("sub_answer")).alias("llm_sub_category"),
    )
    return categorize.track_changes(items.join(known, S.ROW), "llm_main_category", "llm_sub_category").drop(
        "original_main_category", "original_sub_category"
    )


def llm_fallback(routed: DataFrame, complete: Complete, short: bool = True, calls: Calls = Calls()) -> DataFrame:
    """Rows with `needs_completion` get both categories by completion, at confidence 0.

    Adds `completion_failed`; the other rows pass through.
    """
    routed = stage(routed)
    base = [c for c in routed.columns if c not in categorize.PREDICTION_DEFAULTS]
    sent = routed.where("needs_completion")
    answers = _two_passes(sent, complete, short, calls)
    unknown = F.lit(S.UNKNOWN)
    done = sent.select(*base).join(answers, S.ROW).select(
        *base,
        F.when(F.col("failed"), unknown).otherwise(F.col("main_answer")).alias("predicted_main_category"),
        F.when(F.col("failed"), unknown).otherwise(F.col("sub_answer")).alias("predicted_sub_category"),
        F.lit(0.0).alias("main_category_confidence"),
        F.lit(0.0).alias("sub_category_confidence"),
        F.when(F.col("failed"), F.concat(F.lit(f"{categorize.REASON_FAILED}: "), F.col("error")))
        .otherwise(F.lit(categorize.REASON_COMPLETION))
        .alias("categorization_reason"),
        F.col("failed").alias("completion_failed"),
    )
    kept = routed.where(~F.col("needs_completion")).withColumn("completion_failed", F.lit(False))
    return kept.unionByName(done)


def fallback_uncertain_parts(
    routed: DataFrame, complete: Complete, threshold: float = S.CONFIDENCE_THRESHOLD, calls: Calls = Calls()
) -> DataFrame:
    """Replace only the categories whose own confidence is too low, with the long prompts.

    The sub prompt embeds the main category that holds by then. A category that was sent to
    completion has confidence 0 afterwards, also if completion failed.
    """
    rows = stage(routed)
    low_main = F.col("main_category_confidence") < threshold
    low_sub = F.col("sub_category_confidence") < threshold
    asked = rows.where(low_main).select(S.ROW, main_prompt(rows).alias("prompt"))
    first = stage(complete_text(asked, complete, calls.at_once, calls.store))
    main = rows.join(first.select(S.ROW, F.col("result").alias("_main"), F.col("status").alias("_ms")), S.ROW, "left")
    main = stage(
        main.withColumn("_failed", F.coalesce(F.col("_ms") != "ok", F.lit(False)))
        .withColumn("_name", F.coalesce("_main", "predicted_main_category"))
    )
    to_ask = main.where(low_sub & ~F.col("_failed")).select(S.ROW, sub_prompt(main, F.col("_name")).alias("prompt"))
    second = stage(complete_text(to_ask, complete, calls.at_once, calls.store))
    both = main.join(second.select(S.ROW, F.col("result").alias("_sub"), F.col("status").alias("_ss")), S.ROW, "left")
    failed = F.col("_failed") | F.coalesce(F.col("_ss") != "ok", F.lit(False))
    return both.withColumns(
        {
            "predicted_main_category": F.when(failed & low_main, F.lit(S.UNKNOWN)).otherwise(F.col("_name")),
            "predicted_sub_category": F.when(failed & low_sub, F.lit(S.UNKNOWN)).otherwise(
                F.coalesce("_sub", "predicted_sub_category")
            ),
            "main_category_confidence": F.when(low_main, F.lit(0.0)).otherwise(F.col("main_category_confidence")),
            "sub_category_confidence": F.when(low_sub, F.lit(0.0)).otherwise(F.col("sub_category_confidence")),
            "completion_failed": failed,
        }
    ).drop("_main", "_ms", "_failed", "_name", "_sub", "_ss")
