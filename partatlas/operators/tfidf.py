"""TF-IDF over distinct texts and the exact cosine join on it.

All work is done once per distinct text. Document frequencies still count every
row, so the weights are those of the full table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.functions.text import tokens
from partatlas.operators.blocks import members_of
from partatlas.operators.skew import attach_by_key, self_join_by_key
from partatlas.operators.text_cells import pair_dots, pairs_above
from partatlas.staging import stage

SLACK = 1e-8
CELL_PAIRS = 5000
INDEX_COST = 256  # of a pair that meets in the prefix join, in pairs of a tile
SLICE = 1 << 21
COUNT_TERMS = 1 << 18  # counted at a time


def _counting(keep):
    """Arrow function: every different term of every row with its number, the `keep` columns beside it."""

    def run(batches):
        for batch in batches:
            for begin, end in _slices(members_of(batch.column("terms"))[0]):
                part = batch.slice(begin, end - begin)
                start, flat = members_of(part.column("terms"))
                coded = flat.dictionary_encode()
                width = max(len(coded.dictionary), 1)
                row = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(start))
                cells, tf = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                owner, term = pa.array(cells // width), pa.array(cells % width)
                columns = [part.column(name).take(owner) for name in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, coded.dictionary.take(term), pa.array(tf.astype(np.int64))], names=[*keep, "term", "tf"]
                )

    return run


def _slices(start):
    """Ranges of rows with about COUNT_TERMS terms each, a row at least."""
    begin = 0
    while begin < len(start) - 1:
        end = max(begin + 1, int(np.searchsorted(start, start[begin] + COUNT_TERMS, "right")) - 1)
        yield begin, end
        begin = end


def counted_terms(rows: DataFrame, keep: dict[str, str]) -> DataFrame:
    """(`keep`…, term, tf) of rows with a text: each row is counted by itself, so nothing is shuffled or held.

    `keep` names further columns and their types.
    """
    # the pattern is matched once, before Python counts
    split = rows.select(*keep, tokens(F.col("text")).alias("terms"))
    schema = ", ".join(f"{name} {kind}" for name, kind in keep.items())
    return split.mapInArrow(_counting(list(keep)), f"{schema}, term string, tf bigint")


def postings(texts: DataFrame) -> DataFrame:
    """(text_id, n_rows, term, tf) of different texts given as (text_id, n_rows, text), a row each."""
    return counted_terms(texts, {"text_id": "bigint", "n_rows": "bigint"})


def vocabulary(posted: DataFrame) -> DataFrame:
    """Per term: rows and distinct texts that hold it, and its occurrences over all rows."""
    return posted.groupBy("term").agg(
        F.sum("n_rows").alias("df"),
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("tf") * F.col("n_rows")).alias("occurrences"),
    )


def top_terms(vocab: DataFrame, max_features: int = S.TFIDF_MAX_FEATURES) -> DataFrame:
    """The most frequent terms of the corpus; ties go to the smaller term."""
    return vocab.orderBy(F.desc("occurrences"), "term").limit(max_features)


def numbered_terms(vocab: DataFrame) -> DataFrame:
    """Vocabulary with a `term_id` that ascends with (n_texts, term), written once.

    The ids only have to be distinct and in that order; they come from a range
    partitioned sort and are fixed by writing the table.
    """
    return stage(vocab.orderBy("n_texts", "term").withColumn("term_id", F.monotonically_increasing_id()))


def idf(df, n_rows: int):
    return F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + df)) + 1.0


def unit_vectors(weighted: DataFrame, term: str = "term_id") -> DataFrame:
    """(text_id, n_rows, terms, weights) of (text_id, n_rows, term_id, weight), length 1; `term` names the terms."""
    entries = F.sort_array(F.collect_list(F.struct(term, "weight")))
    # the norm is an aggregate of its own: as a projection it would be evaluated once per entry
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return (
        weighted.groupBy("text_id", "n_rows")
        .agg(entries.alias("e"), norm.alias("norm"))
        .select(
            "text_id",
            "n_rows",
            F.col(f"e.{term}").alias("terms"),
            F.transform("e.weight", lambda w: w / F.col("norm")).alias("weights"),
        )
    )


def raw_weights(posted: DataFrame, terms: DataFrame, n_rows: int) -> DataFrame:
    """(text_id, n_rows, term, term_id, weight): tf · (ln((1+n)/(1+df)) + 1) of every posting."""
    facts = terms.select("term", "term_id", "n_texts", idf(F.col("df"), n_rows).alias("idf"))
    joined = attach_by_key(posted, facts, "term", "n_texts", ["text_id"])
    return joined.select("text_id", "n_rows", "term", "term_id", (F.col("tf") * F.col("idf")).alias("weight"))


def tfidf_vectors(posted: DataFrame, terms: DataFrame, n_rows: int) -> DataFrame:
    """Unit TF-IDF vectors: `raw_weights`, normalised."""
    return unit_vectors(raw_weights(posted, terms, n_rows))


def _list_parts(column):
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _prefixes(tau):
    """Arrow function: postings of every vector up to where the rest is shorter than tau."""

    def run(batches):
        for batch in batches:
            offsets, terms = _list_parts(batch.column("terms"))
            weights = _list_parts(batch.column("weights"))[1].to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            # squared norm of every vector from each of its positions to its end
            sums = np.concatenate([[0.0], np.cumsum(weights * weights)])
            ends = sums[offsets[1:]]
            tail = np.sqrt(np.maximum(ends[owner] - sums[:-1], 0.0))
            after = np.sqrt(np.maximum(ends[owner] - sums[1:], 0.0))
            keep = np.flatnonzero(tail >= tau - SLACK)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_id").take(pa.array(owner[keep])),
                    terms.take(pa.array(keep)),
                    pa.array(weights[keep]),
                    pa.array(after[keep]),
                ],
                names=["text_id", "term_id", "weight", "rest"],
            )

    return run


def _dots(key, candidates, vectors):
    """Dot products of the candidate pairs of one cell, from the vectors they need."""
    ids = vectors.column("text_id").to_numpy()
    offsets, terms = _list_parts(vectors.column("terms").combine_chunks())
    weights = _list_parts(vectors.column("weights").combine_chunks())[1].to_numpy(zero_copy_only=False)
    order = np.argsort(ids)
    at_i, at_j = (order[np.searchsorted(ids, candidates.column(c).to_numpy(), sorter=order)] for c in ("text_i", "text_j"))
    dots = pair_dots(offsets, terms.to_numpy(zero_copy_only=False), weights, at_i, at_j, SLICE)
    return pa.table(
        {"text_i": candidates.column("text_i"), "text_j": candidates.column("text_j"), "desc_sim": np.round(dots, S.DIGITS)}
    )


def prefix_postings(vectors: DataFrame, tau: float) -> DataFrame:
    return vectors.select("text_id", "terms", "weights").mapInArrow(
        _prefixes(tau), "text_id bigint, term_id bigint, weight double, rest double"
    )


def _candidate_bound(tau):
    # at the first common term, everything after it adds at most the product of the rests
    def bound(l, r):
        return F.col(f"{l}.weight") * F.col(f"{r}.weight") + F.col(f"{l}.rest") * F.col(f"{r}.rest") >= tau - SLACK

    return bound


def verified(candidates: DataFrame, vectors: DataFrame, tau: float) -> DataFrame:
    """Exact cosines of distinct candidates (text_i, text_j), kept from tau up.

    Texts are hashed into so many parts that a cell of two parts holds about
    CELL_PAIRS candidates. A cell is sent every vector it needs once, not once
    per candidate.
    """
    pairs = stage(candidates)
    parts = max(1, int(np.sqrt(pairs.count() / CELL_PAIRS)))

    def part(column):
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    placed = pairs.withColumns({"part_i": part("text_i"), "part_j": part("text_j")})
    cell = [F.col("part_i").alias("cell_i"), F.col("part_j").alias("cell_j")]
    sides = [placed.select(*cell, F.col(f"text_{side}").alias("text_id")) for side in ("i", "j")]
    needed = sides[0].unionByName(sides[1]).distinct().join(vectors.select("text_id", "terms", "weights"), "text_id")
    cells = placed.groupBy("part_i", "part_j").cogroup(needed.groupBy("cell_i", "cell_j"))
    return cells.applyInArrow(_dots, "text_i bigint, text_j bigint, desc_sim double").where(
        (F.col("desc_sim") >= tau) & (F.col("desc_sim") > 0)
    )


def _index_pays(prefix: DataFrame, vectors: DataFrame, wanted: DataFrame | None = None) -> bool:
    """Whether the prefix join costs less than all pairs of `vectors`, or those with one of `wanted`, in tiles."""

    def pairs(n, asking):
        return asking * (n - (asking + 1) / 2)

    flag = F.lit(1) if wanted is None else F.when(F.col("wanted"), 1)
    terms = prefix.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"), F.count(flag).alias("asking"))
    met = terms.agg(F.coalesce(F.sum(pairs(F.col("n").cast("double"), F.col("asking"))), F.lit(0.0)).alias("met")).first()["met"]
    n = vectors.count()
    return met * INDEX_COST < pairs(n, n if wanted is None else vectors.join(wanted, "text_id", "left_semi").count())


def text_pairs(vectors: DataFrame, tau: float) -> DataFrame:
    """Pairs of distinct texts with cosine >= tau (or any common term where tau <= 0).

    Terms are ordered from rare to frequent. Two vectors with a dot product of
    at least tau share a term at which both still have a rest of at least tau,
    so an equi-join of those prefixes misses nothing; the first common term
    also bounds the whole product, which drops most pairs inside the join. Where so many pairs
    would meet in the join that all pairs in tiles cost less, they are compared there.
    """
    tau = max(tau, SLACK)
    bound = _candidate_bound(tau)
    prefix = prefix_postings(vectors, tau)
    if not _index_pays(prefix, vectors):
        return pairs_above(vectors, tau)
    candidates = self_join_by_key(
        stage(prefix),
        "term_id",
        "text_id",
        (F.col("l.text_id") < F.col("r.text_id")) & bound("l", "r"),
        [F.col("l.text_id").alias("text_i"), F.col("r.text_id").alias("text_j")],
    ).distinct()
    return verified(candidates, vectors, tau)


def _flagged_prefixes(vectors, wanted, tau):
    flagged = prefix_postings(vectors, tau).join(wanted.withColumn("wanted", F.lit(True)), "text_id", "left")
    return flagged.withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def index_pays(vectors: DataFrame, wanted: DataFrame, tau: float) -> bool:
    """Whether `text_pairs_of` costs less than all pairs with a text among `wanted` in tiles."""
    return _index_pays(_flagged_prefixes(vectors, wanted, tau), vectors, wanted)


def text_pairs_of(vectors: DataFrame, wanted: DataFrame, tau: float) -> DataFrame:
    """Pairs of `text_pairs` with at least one text among `wanted`, by the prefix join."""
    tau = max(tau, SLACK)
    bound = _candidate_bound(tau)
    prefix = stage(_flagged_prefixes(vectors, wanted, tau))
    # wanted texts are on the left; two of them meet once, with the lower id there
    once = F.col("l.wanted") & (~F.col("r.wanted") | (F.col("l.text_id") < F.col("r.text_id")))
    candidates = self_join_by_key(
        prefix,
        "term_id",
        "text_id",
        once & (F.col("l.text_id") != F.col("r.text_id")) & bound("l", "r"),
        [F.col("l.text_id").alias("text_i"), F.col("r.text_id").alias("text_j")],
    ).distinct()
    return verified(candidates, vectors, tau)
