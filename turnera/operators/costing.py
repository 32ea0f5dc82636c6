"""Token counts and costs of the text variants, row by row."""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.fixed_values import RATE_USD_PER_MILLION, VARIANTS
from turnera.functions.money import cost
from turnera.functions.tokens import TokenCounter, with_token_counts


def count_variants(frame: DataFrame, counter: TokenCounter, variants=tuple(VARIANTS)) -> DataFrame:
    """Add ``tokens_<variant>`` for each variant, in one pass of the counter."""
    return with_token_counts(frame, {f"tokens_{v}": VARIANTS[v] for v in variants}, counter)


def price_rows(frame: DataFrame, rate: Decimal = RATE_USD_PER_MILLION) -> DataFrame:
    """Add ``costo_estimado_<variant>``; no count, no cost."""
    return frame.withColumns(
        {f"costo_estimado_{v}": cost(F.col(f"tokens_{v}"), rate).cast("double") for v in VARIANTS}
    )
