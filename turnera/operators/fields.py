"""The four fields read out of a message by rule, and their merge with given values."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.fixed_values import EXTRACTED_COLUMNS
from turnera.functions.rules import EXTRACTORS
from turnera.functions.text import matching_form, present, strip


def extract_fields(frame: DataFrame, fields: Sequence[str] = EXTRACTED_COLUMNS) -> DataFrame:
    """Add or complete ``fields`` from the whole raw message; a given value wins, untouched.

    The folded message is its own projection, so all rules share it.
    """
    folded = frame.withColumn("_t", matching_form(present(F.col("mensaje_texto"))))
    columns = {}
    for field in fields:
        value = EXTRACTORS[field]("_t")
        if field in frame.columns:
            given = F.col(field).cast("string")
            value = F.when(strip(present(given)) != "", given).otherwise(value)
        columns[field] = value
    return folded.withColumns(columns).drop("_t")
