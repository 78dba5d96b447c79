"""Tables that the similarity operators share, each built once per item table."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S
from partatlas.operators import tfidf
from partatlas.operators.cleaning import choose_text
from partatlas.operators.skew import attach_by_key
from partatlas.staging import stage


def _text_key(text):
    return F.unhex(F.sha2(text, 256))


class ItemIndex:
    """Distinct texts, catalogue numbers and their combinations for one item table.

    Rows that agree in what is being compared are compared once and counted:
    `texts` by description, `skus` by catalogue number, `profiles` by both. The
    id of each is the lowest `row_id` among its rows.
    """

    def __init__(self, items: DataFrame, text_col: str | None = None):
        self.items = items
        self.chosen = choose_text(items, text_col)

    @cached_property
    def n_rows(self) -> int:
        return self.rows.count()

    @cached_property
    def texts(self) -> DataFrame:
        """(text_id, n_rows, text, text_key) per distinct text."""
        # by the hash, so that texts travel as values of partial sums and not as keys
        grouped = self.chosen.groupBy(_text_key(F.col("text")).alias("text_key")).agg(
            F.min(S.ROW).alias("text_id"), F.count(F.lit(1)).alias("n_rows"), F.first("text").alias("text")
        )
        return stage(grouped.select("text_id", "n_rows", "text", "text_key"))

    @cached_property
    def rows(self) -> DataFrame:
        """(row_id, catalog_no, text_id) per item row."""
        keyed = self.chosen.select(S.ROW, S.CATALOG, _text_key(F.col("text")).alias("text_key"))
        facts = self.texts.select("text_key", "text_id", "n_rows")
        return stage(attach_by_key(keyed, facts, "text_key", "n_rows", [S.ROW]).drop("text_key", "n_rows"))

    @cached_property
    def skus(self) -> DataFrame:
        """(id, sku, n, last) per distinct catalogue number."""
        return stage(
            self.items.groupBy(F.col(S.CATALOG).alias("sku"))
            .agg(F.min(S.ROW).alias("id"), F.count(F.lit(1)).alias("n"), F.max(S.ROW).alias("last"))
            .select("id", "sku", "n", "last")
        )

    @cached_property
    def profiles(self) -> DataFrame:
        """(text_id, id, sku, n, last) per distinct pair of catalogue number and text."""
        return stage(
            self.rows.groupBy("text_id", F.col(S.CATALOG).alias("sku"))
            .agg(F.min(S.ROW).alias("id"), F.count(F.lit(1)).alias("n"), F.max(S.ROW).alias("last"))
            .select("text_id", "id", "sku", "n", "last")
        )

    @cached_property
    def postings(self) -> DataFrame:
        return stage(tfidf.postings(self.texts.select("text_id", "n_rows", "text")))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return tfidf.numbered_terms(tfidf.vocabulary(self.postings))

    @cached_property
    def vectors(self) -> DataFrame:
        return stage(tfidf.tfidf_vectors(self.postings, self.vocabulary, self.n_rows))

    @cached_property
    def last_rows(self) -> DataFrame:
        """The last row of every catalogue number: (id, sku, n, last, text_id)."""
        last = self.rows.select(F.col(S.ROW).alias("last"), "text_id")
        return stage(self.skus.join(last, "last"))
