"""Column expressions on item texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def sku_features(catalog: Column) -> dict[str, Column]:
    """Length, digits and letters of a catalogue number; null counts as empty."""
    given = F.coalesce(catalog, F.lit(""))
    return {
        "sku_length": F.length(given),
        "sku_digits": F.length(F.regexp_replace(given, r"[^\p{Nd}]", "")),
        "sku_letters": F.length(F.regexp_replace(given, r"[^\p{L}]", "")),
    }
