"""Similar items: pairs, best matches, profiles and their statistics.

combined = 0.4 · catalogue-number ratio + 0.6 · description cosine.
"""

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import qgrams, sku_pairs, tfidf
from partatlas.operators.best_text import best_partners
from partatlas.operators.blocks import grid
from partatlas.operators.graph import connected_components, local_forests, maximum_spanning_forest
from partatlas.operators.index import ItemIndex
from partatlas.operators.skew import attach_by_key
from partatlas.staging import stage

# Candidate bounds give way by more than rounding to nine digits can move a score.
BOUND_SLACK = 2e-9
SEVERAL_ROWS = 1_000_000  # of profiles with several rows, that are broadcast to expand pairs


def _rounded(column: Column) -> Column:
    return F.round(column, S.DIGITS)


def combined_score(sku_sim: Column, desc_sim: Column) -> Column:
    return _rounded(F.lit(S.SKU_WEIGHT) * sku_sim + F.lit(S.DESC_WEIGHT) * desc_sim)


def tokenize(index: ItemIndex) -> DataFrame:
    """(row_id, term, tf) of the chosen text of every row; rows that repeat a row_id are counted together."""
    rows = index.chosen.select(S.ROW, "text")
    repeated = stage(rows.groupBy(S.ROW).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(S.ROW))
    kind = dict(rows.dtypes)[S.ROW]
    if repeated.isEmpty():
        return tfidf.counted_terms(rows, {S.ROW: kind})
    marked = rows.join(repeated.select(F.col(S.ROW).alias("_row"), F.lit(True).alias("_again")), F.col(S.ROW).eqNullSafe(F.col("_row")), "left")
    counted = tfidf.counted_terms(marked, {S.ROW: kind, "_again": "boolean"})
    together = counted.where("_again").groupBy(S.ROW, "term").agg(F.sum("tf").alias("tf"))
    return counted.where("_again IS NULL").select(S.ROW, "term", "tf").unionByName(together)


def tfidf_weights(index: ItemIndex) -> DataFrame:
    """(text_id, n_rows, term, weight): the non-zero weights of every distinct text."""
    named = tfidf.unit_vectors(tfidf.raw_weights(index.postings, index.vocabulary, index.n_rows), "term")
    return named.select("text_id", "n_rows", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        "text_id", "n_rows", F.col("e.terms").alias("term"), _rounded(F.col("e.weights")).alias("weight")
    )


def vocabulary_topk(index: ItemIndex, max_features: int = S.TFIDF_MAX_FEATURES) -> DataFrame:
    return tfidf.top_terms(index.vocabulary, max_features).select("term", "df", "occurrences")


def description_similarity_pairs(index: ItemIndex, threshold: float = S.SIMILARITY_THRESHOLD) -> DataFrame:
    """Pairs of distinct texts with cosine >= threshold and how many row pairs they stand for."""
    sizes = index.texts.select("text_id", "n_rows")
    return (
        tfidf.text_pairs(index.vectors, threshold)
        .join(sizes.toDF("text_i", "n_i"), "text_i")
        .join(sizes.toDF("text_j", "n_j"), "text_j")
        .select("text_i", "text_j", "desc_sim", "n_i", "n_j", (F.col("n_i") * F.col("n_j")).alias("row_pairs"))
    )


def _ordered(pairs: DataFrame, *extra) -> DataFrame:
    """Flat pair columns with the lower id first."""
    swap = F.col("a.id") > F.col("b.id")
    low = F.when(swap, F.col("b")).otherwise(F.col("a"))
    high = F.when(swap, F.col("a")).otherwise(F.col("b"))
    return pairs.select(low.alias("low"), high.alias("high"), *extra).select(
        F.col("low.id").alias("row_i"),
        F.col("high.id").alias("row_j"),
        F.col("low.sku").alias("catalog_no_i"),
        F.col("high.sku").alias("catalog_no_j"),
        F.col("low.n").alias("n_i"),
        F.col("high.n").alias("n_j"),
        F.col("low.last").alias("last_i"),
        F.col("high.last").alias("last_j"),
        *extra,
    )


def sku_similarity_pairs(index: ItemIndex, threshold: float = S.SIMILARITY_THRESHOLD) -> DataFrame:
    """Pairs of distinct catalogue numbers with ratio >= threshold and their row pairs."""
    pairs = qgrams.pairs_above(index.skus, threshold).withColumn("sku_sim", _rounded(F.col("sku_sim")))
    return (
        _ordered(pairs, "sku_sim")
        .where(F.col("sku_sim") >= threshold)
        .withColumn("row_pairs", F.col("n_i") * F.col("n_j"))
    )


def _text_groups(index: ItemIndex, threshold: float) -> DataFrame:
    """Pairs of different texts that can reach the threshold, with the ratio they need."""
    tau = (threshold - S.SKU_WEIGHT) / S.DESC_WEIGHT - BOUND_SLACK
    between = tfidf.text_pairs(index.vectors, tau).select("text_i", "text_j", "desc_sim")
    floor = (F.lit(float(threshold)) - F.lit(S.DESC_WEIGHT) * F.col("desc_sim")) / F.lit(S.SKU_WEIGHT)
    return between.withColumn("floor", floor)


def _pairs_of_equal_text(index: ItemIndex, threshold: float) -> DataFrame:
    """Pairs of profiles with one text, which need a ratio of (t - 0.6) / 0.4."""
    floor = (threshold - S.DESC_WEIGHT) / S.SKU_WEIGHT
    with_terms = index.profiles.join(index.vectors.select("text_id"), "text_id", "left_semi")
    if floor > 1.0 + sku_pairs.FLOOR_SLACK:
        with_terms = with_terms.limit(0)
    return _ordered(qgrams.pairs_above(with_terms, floor, "text_id"), "sku_sim").withColumn("desc_sim", F.lit(1.0))


def _pairs_without_common_terms(index: ItemIndex, threshold: float, groups: DataFrame) -> DataFrame:
    """Pairs that reach a threshold of at most 0.4 on the catalogue number alone."""
    pairs = _ordered(qgrams.pairs_above(index.profiles, threshold / S.SKU_WEIGHT), "sku_sim")
    text = index.profiles.select("id", "text_id")
    located = pairs.join(text.toDF("row_i", "text_a"), "row_i").join(text.toDF("row_j", "text_b"), "row_j")
    located = located.withColumn("text_i", F.least("text_a", "text_b")).withColumn(
        "text_j", F.greatest("text_a", "text_b")
    )
    own = index.vectors.select(F.col("text_id").alias("text_i"), F.col("text_id").alias("text_j"))
    sharing = groups.select("text_i", "text_j").unionByName(own)
    return located.join(sharing, ["text_i", "text_j"], "left_anti").withColumn("desc_sim", F.lit(0.0))


def similar_pairs(
    index: ItemIndex, threshold: float = S.SIMILARITY_THRESHOLD, strict: bool = False, equal_texts: bool = True
) -> DataFrame:
    """Pairs of profiles with a combined score at (or, if strict, above) the threshold.

    A profile is a distinct catalogue number with a distinct text; `row_pairs`
    counts the row pairs behind it, and a profile of several rows is also paired
    with itself. `expand_rows` lists the single row pairs. Without `equal_texts`, only profiles of
    different texts are paired.

    The text pairs come first: the score can only be reached if the cosine is at
    least (t − 0.4) / 0.6, and each text pair then says which ratio it needs.
    """
    groups = stage(_text_groups(index, threshold))
    wanted = groups.where(F.col("floor") <= 1.0 + sku_pairs.FLOOR_SLACK).withColumnsRenamed(
        {"text_i": "group_i", "text_j": "group_j"}
    )
    members = index.profiles.withColumnRenamed("text_id", "group_id")
    found = sku_pairs.matching_pairs(wanted, members, {"desc_sim": "double"})
    pairs = _ordered(found, "sku_sim", "desc_sim")
    if equal_texts:
        pairs = pairs.unionByName(_pairs_of_equal_text(index, threshold))
    if threshold <= S.SKU_WEIGHT:
        apart = _pairs_without_common_terms(index, threshold, groups)
        pairs = pairs.unionByName(apart.select(*pairs.columns))
    pairs = pairs.withColumn("row_pairs", F.col("n_i") * F.col("n_j"))
    if equal_texts:
        pairs = pairs.unionByName(_own_pairs(index))
    return _scored(pairs, threshold, strict)


def _scored(pairs: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    scored = pairs.withColumn("combined", combined_score(F.col("sku_sim"), F.col("desc_sim")))
    reached = F.col("combined") > threshold if strict else F.col("combined") >= threshold
    return scored.where(reached).select(
        "row_i",
        "row_j",
        "catalog_no_i",
        "catalog_no_j",
        _rounded(F.col("sku_sim")).alias("sku_sim"),
        "desc_sim",
        "combined",
        "n_i",
        "n_j",
        "last_i",
        "last_j",
        "row_pairs",
    )


def _own_pairs(index: ItemIndex) -> DataFrame:
    """Profiles of several rows against themselves."""
    several = index.profiles.where(F.col("n") > 1)
    has_terms = index.vectors.select("text_id", F.lit(1.0).alias("own"))
    return several.join(has_terms, "text_id", "left").select(
        F.col("id").alias("row_i"),
        F.col("id").alias("row_j"),
        F.col("sku").alias("catalog_no_i"),
        F.col("sku").alias("catalog_no_j"),
        F.col("n").alias("n_i"),
        F.col("n").alias("n_j"),
        F.col("last").alias("last_i"),
        F.col("last").alias("last_j"),
        F.lit(1.0).alias("sku_sim"),
        F.coalesce(F.col("own"), F.lit(0.0)).alias("desc_sim"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("row_pairs"),
    )


def expand_rows(index: ItemIndex, pairs: DataFrame) -> DataFrame:
    """The single row pairs behind profile pairs; as long as `sum(row_pairs)`."""
    keyed = index.profiles.select("id", "text_id", F.col("sku").alias(S.CATALOG))
    rows = index.rows.join(keyed, ["text_id", S.CATALOG]).select("id", S.ROW)
    scores = pairs.select(
        F.col("row_i").alias("id_i"), F.col("row_j").alias("id_j"), "catalog_no_i", "catalog_no_j", "combined"
    )
    repeated = index.profiles.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    several = stage(rows.join(index.profiles.where("n > 1").select("id"), "id", "left_semi"))
    if repeated.isEmpty() and several.count() <= SEVERAL_ROWS:
        # a profile of one row has that row's id, so pairs stay where they are found
        both = scores.where("id_i IS NOT NULL AND id_j IS NOT NULL")
        for side in ("i", "j"):
            own = F.broadcast(several.toDF(f"id_{side}", f"_row_{side}"))
            both = both.join(own, f"id_{side}", "left").withColumn(f"row_{side}", F.coalesce(f"_row_{side}", f"id_{side}"))
    else:
        both = scores.join(rows.toDF("id_i", "row_i"), "id_i").join(rows.toDF("id_j", "row_j"), "id_j")
    swap = F.col("row_i") > F.col("row_j")
    return both.where((F.col("id_i") != F.col("id_j")) | (F.col("row_i") < F.col("row_j"))).select(
        F.least("row_i", "row_j").alias("row_i"),
        F.greatest("row_i", "row_j").alias("row_j"),
        F.when(swap, F.col("catalog_no_j")).otherwise(F.col("catalog_no_i")).alias("catalog_no_i"),
        F.when(swap, F.col("catalog_no_i")).otherwise(F.col("catalog_no_j")).alias("catalog_no_j"),
        "combined",
    )


def similar_pairs_detail(index: ItemIndex, pairs: DataFrame) -> DataFrame:
    """Profile pairs with the description and categories of the first row on each side."""
    details = index.items.select(S.ROW, S.DESCRIPTION, S.MAIN, S.SUB)
    scores = pairs.select("row_i", "row_j", "catalog_no_i", "catalog_no_j", "combined", "row_pairs")
    for side in ("i", "j"):
        names = [f"row_{side}", f"{S.DESCRIPTION}_{side}", f"{S.MAIN}_{side}", f"{S.SUB}_{side}"]
        scores = scores.join(details.toDF(*names), f"row_{side}")
    return scores


def network_stars(index: ItemIndex, threshold: float = S.NETWORK_THRESHOLD) -> DataFrame:
    """(text_id, head, id, catalog_no, size): the part of the network that equal texts make, a row per profile.

    Catalogue numbers with one text score 0.6 or more whatever they are, so each text is a clique.
    It is written as a star: its `size`, and every member with the first one. Texts of a single
    catalogue number are left out. Together with `similar_pairs` of different texts
    (`equal_texts=False`) this is the network; `expand_stars` gives the edges.
    """
    if threshold >= S.DESC_WEIGHT:
        raise ValueError(f"equal texts alone do not reach a score above {threshold}")
    members = index.profiles.join(index.vectors.select("text_id"), "text_id", "left_semi")
    facts = members.groupBy("text_id").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    named = attach_by_key(members.select("text_id", "id", "sku"), facts, "text_id", "size", ["id"])
    return named.select("text_id", "head", "id", F.col("sku").alias(S.CATALOG), "size")


def expand_stars(index: ItemIndex, stars: DataFrame) -> DataFrame:
    """(row_i, row_j, catalog_no_i, catalog_no_j, combined) of every two members of a star."""
    wanted = stars.select("text_id", "id")
    members = index.profiles.join(wanted, ["text_id", "id"], "left_semi")
    pairs = _ordered(qgrams.pairs_above(members, 0.0, "text_id"), "sku_sim")
    score = combined_score(F.col("sku_sim"), F.lit(1.0))
    return pairs.select("row_i", "row_j", "catalog_no_i", "catalog_no_j", score.alias("combined"))


def item_similarity_profile(index: ItemIndex, threshold: float = S.SIMILARITY_THRESHOLD) -> DataFrame:
    """Per catalogue number: partners, mean ratio, mean of the ratios at or above the threshold, best partner."""
    profile = stage(sku_pairs.sku_profile(index.skus, threshold))
    names = index.skus.select("id", F.col("sku").alias(S.CATALOG), "n", "last")
    best = index.skus.select(F.col("id").alias("top_id"), F.col("sku").alias("most_similar_sku"))
    return (
        names.join(profile, "id")
        .join(best, "top_id", "left")
        .select(
            "id",
            S.CATALOG,
            "n",
            "row_total",
            _rounded(F.col("top")).alias("highest_sku_similarity"),
            "most_similar_sku",
            _rounded(F.try_divide("total", "partners")).alias("average_similarity"),
            _rounded(F.try_divide("high_total", "high_partners")).alias("high_similarity_average"),
        )
    )


SKU_TIERS = (0.9, 0.75)


def best_sku_match(index: ItemIndex, tiers: tuple = SKU_TIERS) -> DataFrame:
    """Most similar other catalogue number and the ratio; the first one where several are as similar.

    Numbers look for partners at a high ratio first, where the index prunes; only those that find
    none go on to the next, and what is left at the end meets all others.
    """
    pending = index.skus.select("id")
    found = None
    for tier in tiers:
        asking = pending.withColumn("pending", F.lit(True))
        members = index.skus.join(asking, "id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))
        pairs = stage(qgrams.indexed_pairs(members, tier, pending="pending"))
        best = stage(_best_of_pairs(pairs).join(pending, "id", "left_semi"))
        found = best if found is None else found.unionByName(best)
        pending = stage(pending.join(best, "id", "left_anti"))
        if pending.isEmpty():
            break
    else:
        rest = _best_of_all(index, pending)
        found = rest if found is None else found.unionByName(rest)
    names = index.skus.select(F.col("id").alias("top_id"), F.col("sku").alias("most_similar_sku"))
    return (
        index.skus.select("id", F.col("sku").alias(S.CATALOG))
        .join(found, "id", "left")
        .join(names, "top_id", "left")
        .select(S.CATALOG, _rounded(F.col("top")).alias("highest_sku_similarity"), "most_similar_sku")
    )


def _best(parts: DataFrame) -> DataFrame:
    """(id, top, top_id) of (id, top, top_id) with several rows per id; ties go to the lowest top_id."""
    best = parts.groupBy("id").agg(F.max(F.struct("top", (-F.col("top_id")).alias("neg_id"))).alias("b"))
    return best.select("id", F.col("b.top").alias("top"), (-F.col("b.neg_id")).alias("top_id"))


def _best_of_pairs(pairs: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("a.id").alias("id"), F.col("sku_sim").alias("top"), F.col("b.id").alias("top_id")),
        F.struct(F.col("b.id").alias("id"), F.col("sku_sim").alias("top"), F.col("a.id").alias("top_id")),
    )
    return _best(pairs.select(F.explode(ends).alias("e")).select("e.*"))


def _best_of_all(index: ItemIndex, pending: DataFrame) -> DataFrame:
    """The best partner of every pending catalogue number among all."""
    asking = pending.withColumn("group_id", F.lit(0).cast("long"))
    members = index.skus.join(asking, "id", "left").withColumn("group_id", F.coalesce("group_id", F.lit(1)))
    pairs = index.skus.sparkSession.createDataFrame([(0, 0), (0, 1)], "group_i bigint, group_j bigint")
    parts = grid(pairs, members, [], sku_pairs.profiling(2.0), sku_pairs.PROFILE, sku_pairs.WHOLE)
    return _best(parts.where(F.col("partners") > 0).join(pending, "id", "left_semi"))


BEST_TIERS = (0.9,)


def best_description_match(index: ItemIndex, tiers: tuple = BEST_TIERS) -> DataFrame:
    """Most similar other catalogue number by description, and its cosine.

    One item per catalogue number (its last row) takes part. Texts look for
    partners at a high cosine first, if the prefix join prunes there; texts that
    find none are compared with all others. What is left has cosine 0 with
    everything, and its best match is the first other catalogue number.
    """
    skus = index.last_rows
    # the two first catalogue numbers of every text, so that each can be excluded once
    first = skus.groupBy("text_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_skus"))
    lead = stage(first)
    second = (
        skus.join(lead.select(F.col("first_id").alias("id")), "id", "left_anti")
        .groupBy("text_id")
        .agg(F.min("id").alias("second_id"))
    )
    heads = stage(lead.join(second, "text_id", "left"))
    vectors = stage(index.vectors.join(heads.select("text_id"), "text_id", "left_semi"))
    own = heads.where(F.col("second_id").isNotNull()).join(vectors.select("text_id"), "text_id", "left_semi")
    matches = own.select("text_id", F.lit(1.0).alias("top"), F.col("second_id").alias("top_id"))
    pending = vectors.select("text_id")
    for tier in tiers:
        if not tfidf.index_pays(vectors, pending, tier):
            continue
        found = stage(_best_partners(vectors, pending, heads, tier))
        matches = matches.unionByName(found)
        # after one tier a text with two catalogue numbers has seen every partner that ties with them
        done = found.select("text_id").unionByName(own.select("text_id"))
        pending = stage(pending.join(done, "text_id", "left_anti"))
        if pending.isEmpty():
            break
    else:
        matches = matches.unionByName(stage(best_partners(vectors, pending, heads)))
    best = matches.groupBy("text_id").agg(F.max(F.struct("top", (-F.col("top_id")).alias("neg_id"))).alias("b"))
    facts = heads.join(best, "text_id", "left").select(
        "text_id", "n_skus", "first_id", "second_id", "b.top", (-F.col("b.neg_id")).alias("top_id")
    )
    joined = attach_by_key(skus, facts, "text_id", "n_skus", ["id"])
    return _named_best(index, joined, vectors)


def _best_partners(vectors: DataFrame, pending: DataFrame, heads: DataFrame, tier: float) -> DataFrame:
    """(text_id, top, top_id): best partner text of every pending text with a partner at the tier."""
    found = stage(tfidf.text_pairs_of(vectors, pending, tier))
    both = found.select("text_i", "text_j", "desc_sim").unionByName(
        found.select(F.col("text_j").alias("text_i"), F.col("text_i").alias("text_j"), "desc_sim")
    )
    first = heads.select(F.col("text_id").alias("text_j"), "first_id")
    return (
        both.join(pending.withColumnRenamed("text_id", "text_i"), "text_i", "left_semi")
        .join(first, "text_j")
        .groupBy(F.col("text_i").alias("text_id"))
        .agg(F.max(F.struct("desc_sim", (-F.col("first_id")).alias("neg_id"))).alias("b"))
        .select("text_id", F.col("b.desc_sim").alias("top"), (-F.col("b.neg_id")).alias("top_id"))
    )


def _named_best(index: ItemIndex, joined: DataFrame, vectors: DataFrame) -> DataFrame:
    """Settle each catalogue number's own case and replace ids by names."""
    two_first = [r["id"] for r in index.skus.orderBy("id").limit(2).collect()]
    lead, follower = (F.lit(x).cast("long") for x in [*two_first, None, None][:2])
    default = F.when(F.col("id") != lead, lead).otherwise(follower)
    # a text partner at cosine 1 competes with the item's own text by position
    sibling = F.when(F.col("id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    own_top = F.when(F.col("second_id").isNotNull() & (F.col("top") == 1.0), sibling)
    other = F.col("top_id")
    best_id = F.when(F.col("top").isNull(), default).otherwise(
        F.when(other == F.col("id"), own_top).otherwise(F.least(other, own_top))
    )
    chosen = joined.withColumn("best_id", best_id).withColumn(
        "sim", F.when(F.col("best_id").isNotNull(), F.coalesce(F.col("top"), F.lit(0.0)))
    )
    names = index.skus.select(F.col("id").alias("best_id"), F.col("sku").alias("most_similar_desc_sku"))
    sizes = chosen.groupBy("best_id").agg(F.count(F.lit(1)).alias("_n"))
    named = names.join(sizes, "best_id")
    return attach_by_key(chosen, named, "best_id", "_n", ["id"], how="left").select(
        F.col("sku").alias(S.CATALOG), F.col("sim").alias("highest_desc_similarity"), "most_similar_desc_sku"
    )


def description_means(index: ItemIndex) -> DataFrame:
    """Mean cosine of every catalogue number with all others, without any pair.

    With unit vectors u and v = sum of all u, the mean is (u·v − u·u) / (n − 1).
    """
    skus = index.last_rows
    n = skus.count()
    sizes = skus.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_skus"))
    weighted = index.vectors.join(sizes, "text_id").select(
        "text_id", "n_skus", F.explode(F.arrays_zip("terms", "weights")).alias("e")
    )
    entries = stage(weighted.select("text_id", "n_skus", F.col("e.terms").alias("term_id"), F.col("e.weights").alias("w")))
    total = entries.groupBy("term_id").agg(
        F.sum(F.col("w") * F.col("n_skus")).alias("v"), F.count(F.lit(1)).alias("n_entries")
    )
    dots = (
        attach_by_key(entries, total, "term_id", "n_entries", ["text_id"])
        .groupBy("text_id")
        .agg(F.sum(F.col("w") * F.col("v")).alias("uv"), F.sum(F.col("w") * F.col("w")).alias("uu"))
    )
    facts = sizes.join(dots, "text_id", "left")
    mean = (F.coalesce(F.col("uv"), F.lit(0.0)) - F.coalesce(F.col("uu"), F.lit(0.0))) / F.lit(float(n - 1) if n > 1 else None)
    return attach_by_key(skus, facts, "text_id", "n_skus", ["id"]).select(
        F.col("sku").alias(S.CATALOG), _rounded(mean).alias("avg_desc_similarity")
    )


def per_item_stats(index: ItemIndex, profile: DataFrame, best_description: DataFrame) -> DataFrame:
    return (
        profile.select(
            S.CATALOG,
            F.col("average_similarity").alias("avg_sku_similarity"),
            F.col("highest_sku_similarity").alias("max_sku_similarity"),
        )
        .join(description_means(index), S.CATALOG)
        .join(
            best_description.select(S.CATALOG, F.col("highest_desc_similarity").alias("max_desc_similarity")),
            S.CATALOG,
        )
    )


def with_similarity_columns(index: ItemIndex, profile: DataFrame, best_description: DataFrame) -> DataFrame:
    """Items with the six similarity columns of their catalogue number."""
    facts = profile.join(best_description, S.CATALOG).select(
        S.CATALOG,
        "n",
        "highest_sku_similarity",
        "most_similar_sku",
        "highest_desc_similarity",
        "most_similar_desc_sku",
        "average_similarity",
        "high_similarity_average",
    )
    return attach_by_key(index.items, facts, S.CATALOG, "n", [S.ROW], how="left").drop("n")


def similarity_lookup(items: DataFrame, requested: DataFrame) -> DataFrame:
    """Ratio of requested pairs (catalog_no_i, catalog_no_j); null and a flag where one is unknown."""
    known = items.select(S.CATALOG).distinct()
    wanted = requested
    for side in ("i", "j"):
        seen = known.select(F.col(S.CATALOG).alias(f"catalog_no_{side}"), F.lit(True).alias(f"known_{side}"))
        wanted = wanted.join(seen, f"catalog_no_{side}", "left")
    found = F.coalesce(F.col("known_i") & F.col("known_j"), F.lit(False))
    flagged = stage(wanted.select("catalog_no_i", "catalog_no_j", found.alias("found")))
    scored = flagged.where("found").select("catalog_no_i", "catalog_no_j").mapInArrow(
        sku_pairs.ratios, "catalog_no_i string, catalog_no_j string, sku_sim double"
    )
    unknown = flagged.where("NOT found").withColumn("sku_sim", F.lit(None).cast("double"))
    known_pairs = scored.select("catalog_no_i", "catalog_no_j", F.lit(True).alias("found"), _rounded(F.col("sku_sim")).alias("sku_sim"))
    return known_pairs.unionByName(unknown)


def catalog_edges(index: ItemIndex, pairs: DataFrame, *extra) -> DataFrame:
    """Edges between distinct catalogue numbers, named by the id of each."""
    ids = index.skus.select("id", "sku")
    return (
        pairs.where(F.col("catalog_no_i") != F.col("catalog_no_j"))
        .join(ids.toDF("src", "catalog_no_i"), "catalog_no_i")
        .join(ids.toDF("dst", "catalog_no_j"), "catalog_no_j")
        .select("src", "dst", *extra)
    )


def catalog_links(index: ItemIndex, pairs: DataFrame) -> DataFrame:
    """Edges that connect catalogue numbers as those of `catalog_edges` do.

    Pairs are reduced to a spanning forest of profiles in the partitions that hold them, so only
    an edge per profile and partition is shuffled, however many pairs there are.
    """
    ends = pairs.select(F.lit(0).alias("level"), F.col("row_i").alias("src"), F.col("row_j").alias("dst")).where("src != dst")
    links = stage(local_forests(ends).select(F.col("src").alias("row_i"), F.col("dst").alias("row_j")))
    for side in ("i", "j"):
        degree = links.groupBy(f"row_{side}").agg(F.count(F.lit(1)).alias("_n"))
        names = index.profiles.select(F.col("id").alias(f"row_{side}"), F.col("sku").alias(f"catalog_no_{side}"))
        links = attach_by_key(links, names.join(degree, f"row_{side}"), f"row_{side}", "_n", ["row_j" if side == "i" else "row_i"]).drop("_n")
    return catalog_edges(index, links)


def description_mean_all(index: ItemIndex) -> DataFrame:
    """Mean cosine over all row pairs including each row with itself: |v|² / n²."""
    v = (
        index.vectors.select("n_rows", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
        .groupBy("e.terms")
        .agg(F.sum(F.col("n_rows") * F.col("e.weights")).alias("v"))
    )
    n = float(index.n_rows)
    return v.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("s")).select(
        F.try_divide(F.col("s"), F.lit(n * n)).alias("average_desc_similarity"),
        F.when(F.col("s") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("max_desc_similarity"),
    )


@lru_cache(maxsize=1 << 16)
def _least_lcs(total: int, threshold: float) -> int:
    """Least LCS of strings of one text, whose lengths add up to `total`, with a score at the threshold; rounded as `combined_score` is."""
    for lcs in range(total // 2 + 1):
        score = S.SKU_WEIGHT * (2.0 * lcs / total if total else 1.0) + S.DESC_WEIGHT
        if float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-S.DIGITS), ROUND_HALF_UP)) >= threshold:
            return lcs
    return total // 2 + 1


def _at_level(threshold: float):
    def least(lengths, other):
        found, at = np.unique(lengths + other, return_inverse=True)
        return np.array([_least_lcs(int(total), threshold) for total in found], dtype=np.int64)[at]

    return least


def _swept_equal_texts(index: ItemIndex, thresholds: list[float]) -> DataFrame | None:
    """(level, src, dst, pairs): links between profiles of one text that connect as all similar ones do, and how many row pairs these are.

    Neither needs the pairs themselves, which grow with the square of the profiles of a text: they are
    counted and linked in the tasks that find them. None if the index finds the few there are.
    """
    lowest = min(thresholds)
    members = index.profiles.join(index.vectors.select("text_id"), "text_id", "left_semi")
    floor = (lowest - S.DESC_WEIGHT) / S.SKU_WEIGHT
    if floor > 1.0 + sku_pairs.FLOOR_SLACK or qgrams.index_of_fewer(members, floor, "text_id") is not None:
        return None
    groups = members.select(F.col("text_id").alias("group_i")).distinct().withColumn("group_j", F.col("group_i"))
    grouped = members.select(F.col("text_id").alias("group_id"), "id", "sku", "n", "last")
    levels = [_at_level(float(t)) for t in thresholds]
    return stage(grid(groups, grouped, [], sku_pairs.linking(levels), "level int, src bigint, dst bigint, pairs bigint", sku_pairs.WHOLE))


def threshold_sweep(
    index: ItemIndex, thresholds: list[float], profile: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Pair, mean and component statistics for every threshold.

    `pairs`, if given, are the similar pairs at the lowest threshold or below.

    Pairs are found once, at the lowest threshold; those of equal texts are counted and linked where they
    are found, and never listed. The others' maximum spanning forest has the
    components of every threshold, so it takes the place of the pairs there: with a row per
    catalogue number at most, it is labelled with the thresholds an edge reaches.
    """
    spark = index.items.sparkSession
    if profile is None:
        profile = item_similarity_profile(index)
    equal = None
    if pairs is None:
        equal = _swept_equal_texts(index, thresholds)
        if equal is None:
            pairs = similar_pairs(index, min(thresholds))
        else:
            apart = similar_pairs(index, min(thresholds), equal_texts=False)
            pairs = apart.unionByName(_scored(_own_pairs(index), min(thresholds)))
        pairs = stage(pairs)
    else:
        pairs = pairs.where(F.col("combined") >= min(thresholds))
    levels = spark.createDataFrame([(k, float(t)) for k, t in enumerate(thresholds)], "level int, threshold double")
    sums = pairs.agg(
        *[F.sum(F.when(F.col("combined") >= float(t), F.col("row_pairs"))).alias(f"at_{k}") for k, t in enumerate(thresholds)]
    )
    counts = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"at_{k}").alias("pairs")) for k in range(len(thresholds))])).alias("c")).select("c.*")
    if equal is not None:
        counts = counts.unionByName(equal.select("level", "pairs")).groupBy("level").agg(F.sum("pairs").alias("pairs"))
    edges = catalog_edges(index, pairs, F.col("combined").alias("weight"))
    if len(thresholds) > 1:
        edges = maximum_spanning_forest(edges)
    reached = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(t)).alias("t")) for k, t in enumerate(thresholds)]),
            lambda x: x.t <= F.col("weight"),
        )
    )
    at_level = edges.withColumn("_r", reached).select("src", "dst", F.col("_r.level").alias("level"))
    if equal is not None:
        at_level = at_level.unionByName(equal.where("src IS NOT NULL").select("src", "dst", "level"))
        # the profiles of a catalogue number are one node; its id is that of its first profile
        named = index.profiles.select("id", "sku").join(index.skus.select(F.col("id").alias("first"), "sku"), "sku").where("id != first")
        same = named.crossJoin(F.broadcast(levels.select("level"))).select(F.col("id").alias("src"), F.col("first").alias("dst"), "level")
        at_level = at_level.unionByName(same)
    components = component_sizes(index, at_level, len(thresholds))
    n = index.n_rows
    # sum over ordered row pairs: n_i · (all rows' ratios) plus every row with the rows of its own number
    sku_mean = profile.agg(
        F.try_divide(F.sum(F.col("n") * F.col("row_total") + F.col("n") * F.col("n")), F.lit(float(n) * n)).alias(
            "average_sku_similarity"
        )
    )
    means = sku_mean.withColumn("_one", F.lit(1)).join(
        description_mean_all(index).withColumn("_one", F.lit(1)), "_one"
    )
    return (
        levels.join(counts, "level", "left")
        .join(components, "level", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(means), "_one")
        .select(
            "threshold",
            F.lit(n).cast("long").alias("total_items"),
            F.coalesce("pairs", F.lit(0)).alias("similar_pairs"),
            _rounded(F.col("average_sku_similarity")).alias("average_sku_similarity"),
            _rounded(F.col("average_desc_similarity")).alias("average_desc_similarity"),
            F.lit(1.0 if n else None).cast("double").alias("max_sku_similarity"),
            "max_desc_similarity",
            _rounded(F.try_divide(F.coalesce("pairs", F.lit(0)), F.lit(n))).alias("similar_items_ratio"),
            "connected_components",
            "largest_component_size",
        )
    )


def component_sizes(index: ItemIndex, edges: DataFrame, n_levels: int) -> DataFrame:
    """(level, connected_components, largest_component_size) over all catalogue numbers.

    Numbers without an edge are components of their own and are only counted.
    """
    n_skus = index.skus.count()
    labels = connected_components(edges, levels=True).join(index.skus.select(F.col("id").alias("node")), "node", "left_semi")
    sizes = labels.groupBy("level", "component").agg(F.count(F.lit(1)).alias("size"))
    per_level = sizes.groupBy("level").agg(
        F.count(F.lit(1)).alias("joined"), F.sum("size").alias("covered"), F.max("size").alias("largest")
    )
    levels = index.items.sparkSession.range(n_levels).select(F.col("id").cast("int").alias("level"))
    alone = F.lit(n_skus) - F.coalesce(F.col("covered"), F.lit(0))
    return levels.join(per_level, "level", "left").select(
        "level",
        (F.coalesce(F.col("joined"), F.lit(0)) + alone).alias("connected_components"),
        F.coalesce(F.col("largest"), F.lit(1 if n_skus else 0)).cast("long").alias("largest_component_size"),
    )


def similarity_statistics(index: ItemIndex, threshold: float, profile: DataFrame) -> DataFrame:
    """The sweep at one threshold plus the means of the per-item columns."""
    per_row = profile.agg(
        _rounded(F.try_divide(F.sum(F.col("average_similarity") * F.col("n")), F.sum(F.when(F.col("average_similarity").isNotNull(), F.col("n"))))).alias(
            "avg_similarity_mean"
        ),
        _rounded(F.try_divide(F.sum(F.col("high_similarity_average") * F.col("n")), F.sum(F.when(F.col("high_similarity_average").isNotNull(), F.col("n"))))).alias(
            "high_similarity_mean"
        ),
        F.coalesce(F.sum(F.when(F.col("high_similarity_average") > 0, F.col("n"))), F.lit(0)).alias(
            "items_with_high_similarity"
        ),
    )
    sweep = threshold_sweep(index, [threshold], profile)
    return (
        sweep.withColumn("_one", F.lit(1))
        .join(F.broadcast(per_row.withColumn("_one", F.lit(1))), "_one")
        .drop("_one", "threshold")
    )
