"""Column names, the required columns and the result contract.  No function runs a job."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions.text import present


class MissingColumnsError(ValueError):
    """A table lacks a required column."""


def canonical_places(names: Sequence[str]) -> dict[str, int]:
    """Canonical column names with the position each is taken from: the first one wins."""
    places: dict[str, int] = {}
    for place, name in enumerate(names):
        tidy = str(name).strip().lower()
        places.setdefault(fixed.COLUMN_ALIASES.get(tidy, tidy), place)
    return places


def normalize_columns(frame: DataFrame) -> DataFrame:
    """Trim and lower-case names, resolve aliases, keep the first column of each name."""
    numbered = frame.toDF(*(f"_{i}" for i in range(len(frame.columns))))
    places = canonical_places(frame.columns)
    return numbered.select(*(F.col(f"_{place}").alias(name) for name, place in places.items()))


def require_columns(frame: DataFrame) -> DataFrame:
    missing = [c for c in fixed.REQUIRED_COLUMNS if c not in frame.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns {missing}; found {frame.columns}")
    return frame


def with_message(frame: DataFrame) -> DataFrame:
    """``mensaje_texto`` as a string, '' for null."""
    return frame.withColumn("mensaje_texto", present(F.col("mensaje_texto")))


def validated(frame: DataFrame) -> DataFrame:
    """Canonical names, checked, with a message that is never null."""
    return frame.transform(normalize_columns).transform(require_columns).transform(with_message)


#: What the operators compute or use on the way; an input's own columns of these names are dropped.
COMPUTED = (
    "mensaje_limpio", "mensaje_ingles", *(f"{kind}_{v}" for kind in ("tokens", "costo_estimado") for v in fixed.VARIANTS),
    "util", "copias", "clave", "clave_sha", "veces", "cache_key", "texto_origen", "texto_destino", "motor", "nuevo", "motivo_rechazo",
)


def without_computed(frame: DataFrame) -> DataFrame:
    """An earlier run's results must not pass for this one's; names with a leading underscore are reserved."""
    return frame.drop(*COMPUTED, *(c for c in frame.columns if c.startswith("_")))


def result_contract(frame: DataFrame) -> DataFrame:
    """Exactly the result columns, in order; absent ones are null, others are dropped."""
    return frame.select(
        *(
            (F.col(name) if name in frame.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in fixed.RESULT_COLUMNS.items()
        )
    )
