"""Audit of how the sources of a language differ in the words they use.

Texts are tokenised as bytes: one translate table lowers the letters A to Z and blanks
whatever separates terms, and a split gives the terms. A counter per document yields how
often and in how many documents a term occurs, and tasks merge the counters of their
documents by language and source before anything is shuffled.

Sources are compared term block by term block: a cell holds some terms of a language and
two blocks of its sources as a small matrix, so no pair of sources exists as a row per term.
All shares are whole numbers (parts of a thousand million, smoothed), so sums are exact.
"""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partatlas.llm.common import as_bytes, written

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5

TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
HELD = 400_000  # terms that a task merges before it hands them on
LONG = 1 << 22  # bytes of a text that are split at a time
BROADCAST_TERMS = 1_000_000  # kept terms up to which the list of them is broadcast (some 50 MB)
CELL_ROWS = 8_000
BLOCK = 128  # sources of a cell on either side


def _counter(text: bytes) -> Counter:
    """How often every term occurs in a text; a long text is split piece by piece."""
    if len(text) <= LONG:
        return Counter(text.translate(TERM_BYTES).split())
    found, begin, lowered = Counter(), 0, text.translate(TERM_BYTES)
    while begin < len(lowered):
        end = lowered.find(b" ", begin + LONG)
        end = len(lowered) if end < 0 else end
        found.update(lowered[begin:end].split())
        begin = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term, a row per task.

    A task hands on what it has merged whenever that exceeds `HELD` terms, so its memory is
    bounded by that and by its longest text.
    """

    def count(batches):
        # documents that have a term, and its occurrences beyond the first of each document
        seen, more = defaultdict(Counter), defaultdict(Counter)

        def flush():
            for (lang, source), counts in seen.items():
                terms, further = list(counts), more[lang, source]
                n_docs = np.fromiter(counts.values(), np.int64, len(terms))
                n = n_docs + np.fromiter((further[t] for t in terms), np.int64, len(terms))
                names = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                words = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*names, words, pa.array(n), pa.array(n_docs)], names=["lang", "source", "term", "n", "docs"]
                )
            seen.clear()
            more.clear()

        held = 0
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, text in zip(groups, as_bytes(batch.column("text"))):
                found, counts, further = _counter(text), seen[group], more[group]
                held -= len(counts)
                counts.update(found.keys())
                held += len(counts)
                for term, n in found.items():
                    if n > 1:
                        further[term] += n - 1
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term, in parts of `SCALE`, as a whole number; products are decimals."""
    top = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = total.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * F.lit(SMOOTH).cast("decimal(1,0)")
    return (F.call_function("div", top, low) + 1).cast("long")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """`rows` of kept terms. Few kept terms are broadcast, more are joined by their key."""
    few = kept.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(kept) if few else kept, ["lang", "term"], "left_semi")


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, extra): over all kept terms, |p_i - p_j| less its value for a term that neither has.

    `counts` (lang, place, slices, blocks, term, p) has the terms that occur, `groups` (lang, place, slices,
    blocks, zero) every source with its place among those of the language and its share of an
    absent term. The terms of a language are cut into `slices`, its sources into `blocks`.
    """

    def celled(rows: DataFrame) -> DataFrame:
        """Every row once for each block that its own block meets."""
        own = F.floor(F.col("place") / F.lit(BLOCK)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        return rows.withColumn("own", own).select("*", other).select(
            "lang", "slice", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "place", "term", "p"
        )

    terms = counts.withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    heads = (
        groups.where(F.col("slices") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        .select("lang", "slice", "blocks", "place", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    )
    columns = ["lang", "slice", "blocks", "place", "term", "p"]
    cells = celled(terms.select(*columns).unionByName(heads))

    def compare(key, cell):
        lang, _, low, high = (k.as_py() for k in key)
        places = cell.column("place").to_numpy()
        shares = cell.column("p").to_numpy()
        head = cell.column("term").is_null().to_numpy()
        found = cell.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode()
        order = np.argsort(places[head])
        members, zero = places[head][order], shares[head][order]
        matrix = np.repeat(zero[:, None], len(found.dictionary), axis=1)
        matrix[np.searchsorted(members, places[~head]), found.indices.to_numpy()] = shares[~head]
        first, second, extra = [], [], []
        for k in np.flatnonzero(members // BLOCK == low):
            # within one block each pair once, between two blocks each member with each
            others = np.flatnonzero((members // BLOCK == high) & (members > members[k]))
            away = np.abs(matrix[others] - matrix[k]).sum(axis=1) - matrix.shape[1] * np.abs(zero[others] - zero[k])
            first.append(np.full(len(others), members[k]))
            second.append(members[others])
            extra.append(away)
        first, second, extra = (np.concatenate(x) for x in (first, second, extra))
        return pa.table(
            {"lang": pa.array([lang] * len(first), pa.string()), "i": first.astype(np.int32), "j": second.astype(np.int32), "extra": extra}
        )

    parts = cells.groupBy("lang", "slice", "low", "high").applyInArrow(compare, "lang string, i int, j int, extra long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources are from each other and what marks them.

    Part `pair` has, for every source of a language, each other source with the sum of the
    differences of their term shares, the most different first. Part `term` has the `top` terms
    that a source uses more than its language does. Only terms in at least `min_docs`
    documents of the language count. Ranks start at 1; ties go to the item that comes first
    in byte order.

    Null texts, languages and sources are empty ones; a source without any kept term has the
    shares of absent terms. Repeated rows count repeatedly, texts of any length are counted
    whole, an empty table gives no rows, and other columns are not looked at.
    """
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = written(term_counts(docs))
    kept = written(
        parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    )
    counts = written(_only(parts, kept).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    n_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    by_place, whole = Window.partitionBy("lang").orderBy("source"), Window.partitionBy("lang")  # one row per source
    groups = written(
        docs.select(*group)
        .distinct()
        .join(n_group, ["lang", "source"], "left")
        .join(size, "lang", "left")
        .fillna(0, ["total", "rows", "terms"])
        .withColumn("place", F.row_number().over(by_place) - 1)
        .withColumn("blocks", F.ceil(F.count(F.lit(1)).over(whole) / F.lit(BLOCK)).cast("int"))
        .withColumn("slices", F.ceil(F.sum("rows").over(whole) / F.lit(CELL_ROWS)).cast("int"))
        .withColumn("lang_total", F.sum("total").over(whole))
        .withColumn("zero", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))
    )
    shares = written(
        counts.join(groups, ["lang", "source"]).select(
            "lang", "source", "place", "slices", "blocks", "term", "n", "terms", "lang_total",
            _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        )
    )

    extras = _pair_sums(shares, groups)
    a = groups.select("lang", F.col("place").alias("i"), F.col("source").alias("one"), F.col("zero").alias("zero_i"), "terms")
    b = groups.select("lang", F.col("place").alias("j"), F.col("source").alias("two"), F.col("zero").alias("zero_j"))
    # the result has a row for every two sources of a language
    pairs = (
        a.join(b, "lang")
        .where(F.col("i") < F.col("j"))
        .join(extras, ["lang", "i", "j"], "left")
        .withColumn("value", F.col("terms") * F.abs(F.col("zero_i") - F.col("zero_j")) + F.coalesce("extra", F.lit(0)))
    )
    both = pairs.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value")
    )
    lang_n = shares.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    marks = (
        shares.join(lang_n, ["lang", "term"])
        .withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
        .where(F.col("value") > 0)
        .select("lang", "source", F.col("term").alias("item"), "value")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = ["lang", "source", "part", "item", "value", "rank"]
    ranked_pairs = both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    ranked_marks = marks.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked_pairs.select(*own).unionByName(ranked_marks.select(*own))
