"""Cleaning, defaults, manufacturer rules and input checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partatlas import schema as S


def drop_invalid_catalog(items: DataFrame) -> DataFrame:
    """Rows whose catalogue number is present and is not the word EMPTY."""
    number = F.col(S.CATALOG)
    return items.where(number.isNotNull() & (number.cast("string") != S.EMPTY_CATALOG))


def ensure_columns(items: DataFrame) -> DataFrame:
    missing = [c for c in S.KEY_COLUMNS if c not in items.columns]
    return items.withColumns({c: F.lit("" if c == S.CATALOG else S.UNKNOWN) for c in missing})


def cast_keys(items: DataFrame) -> DataFrame:
    return items.withColumns({c: F.col(c).cast("string") for c in S.KEY_COLUMNS})


def fill_defaults(items: DataFrame) -> DataFrame:
    return items.fillna({S.DESCRIPTION: S.UNKNOWN, S.MAIN: S.UNCATEGORIZED, S.SUB: S.UNCATEGORIZED})


def manufacturer_name(code: Column, names: dict[str, str]) -> Column:
    """Name of a manufacturer code; unmapped codes stay, null becomes Unknown."""
    if not names:
        return F.coalesce(code, F.lit(S.UNKNOWN))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code, F.lit(S.UNKNOWN))


def map_manufacturer(items: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    names = S.MANUFACTURER_NAMES if names is None else names
    return items.withColumn(S.MFR, manufacturer_name(F.col(S.MFR), names))


def manufacturer_of(catalog: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """Manufacturer whose prefix starts the upper-cased catalogue number."""
    prefixes = S.MANUFACTURER_PREFIXES if prefixes is None else prefixes
    upper = F.upper(catalog)
    rules = [
        F.when(upper.startswith(prefix), F.lit(name)) for name, listed in prefixes.items() for prefix in listed
    ]
    return F.coalesce(*rules, F.lit(S.UNKNOWN))


def extract_manufacturer(items: DataFrame, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    return items.withColumn("manufacturer", manufacturer_of(F.col(S.CATALOG), prefixes))


def clean_items(items: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return map_manufacturer(fill_defaults(cast_keys(ensure_columns(drop_invalid_catalog(items)))), names)


def item_columns(items: DataFrame) -> DataFrame:
    """The five item attributes, one row per item."""
    return items.select(
        S.ROW,
        F.col(S.CATALOG).alias("catalog_numbers"),
        F.col(S.DESCRIPTION).alias("descriptions"),
        F.col(S.MFR).alias("manufacturer_codes"),
        F.col(S.MAIN).alias("main_categories"),
        F.col(S.SUB).alias("sub_categories"),
    )


def validate_required(items: DataFrame) -> bool:
    return all(c in items.columns for c in S.REQUIRED_COLUMNS)


def validation_report(items: DataFrame) -> DataFrame:
    """Row and description counts with the verdict a model fit depends on."""
    counted = items.agg(F.count(F.lit(1)).alias("n_rows"), F.count(S.DESCRIPTION).alias("n_descriptions"))
    verdict = (
        F.when(F.col("n_rows") == 0, F.lit("Empty DataFrame provided"))
        .when(F.col("n_descriptions") == 0, F.lit("All descriptions are missing"))
        .otherwise(F.lit("ok"))
    )
    return counted.withColumn("verdict", verdict)


def validate_model_input(items: DataFrame, required: list[str] = S.MODEL_COLUMNS) -> None:
    missing = [c for c in required if c not in items.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    verdict = validation_report(items).first()["verdict"]
    if verdict != "ok":
        raise ValueError(verdict)


def text_column(items: DataFrame, text_col: str | None = None) -> str:
    """The enriched description where that column exists, the description otherwise."""
    return text_col or (S.ENRICHED if S.ENRICHED in items.columns else S.DESCRIPTION)


def choose_text(items: DataFrame, text_col: str | None = None) -> DataFrame:
    return items.withColumn("text", F.coalesce(F.col(text_column(items, text_col)), F.lit("")))


def trainable_rows(items: DataFrame) -> DataFrame:
    known = [F.col(c).isNotNull() & (F.col(c) != S.UNKNOWN) for c in (S.MAIN, S.SUB)]
    return items.where(known[0] & known[1])


def enrichment_coverage(items: DataFrame, share: float = S.ENRICHED_SHARE) -> DataFrame:
    """Share of rows with an enriched description, and whether a run has to fill them."""
    filled = F.count(S.ENRICHED) if S.ENRICHED in items.columns else F.lit(0).cast("long")
    counted = items.agg(F.count(F.lit(1)).alias("n_rows"), filled.alias("n_enriched"))
    return counted.withColumn(
        "needs_enrichment", ~(F.col("n_enriched") > F.lit(float(share)) * F.col("n_rows"))
    )


def needs_enrichment(items: DataFrame, share: float = S.ENRICHED_SHARE) -> bool:
    if S.ENRICHED not in items.columns:
        return True
    return enrichment_coverage(items, share).first()["needs_enrichment"]
