"""Which messages are worth processing: cleaning, rejects, duplicates, volume counts.

"First" always means first by an explicit row order, by default ``archivo_origen`` and
``fila``, which together identify a row.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnera.functions import text

ROW_ORDER = ("archivo_origen", "fila")
ROW_PRINT = "_huella"


class NoUsableRowsError(ValueError):
    """Nothing is left to process."""


def with_clean(frame: DataFrame) -> DataFrame:
    """Add ``mensaje_limpio`` unless it is already there."""
    if "mensaje_limpio" in frame.columns:
        return frame
    return frame.withColumn("mensaje_limpio", text.clean(F.col("mensaje_texto")))


def with_usable(frame: DataFrame) -> DataFrame:
    """Add ``mensaje_limpio`` and the flag ``util`` unless they are already there."""
    if "util" in frame.columns:
        return frame
    usable = text.is_usable(F.col("mensaje_texto"), text.present(F.col("mensaje_limpio")))
    return with_clean(frame).withColumn("util", usable)


def usable(frame: DataFrame) -> DataFrame:
    return with_usable(frame).filter("util").drop("util")


def unusable(frame: DataFrame) -> DataFrame:
    return with_usable(frame).filter(~F.col("util")).drop("util")


def duplicate_key(frame: DataFrame) -> list[Column]:
    """Same patient (if the table has patients), same text but for accents and case."""
    key = text.matching_form(text.present(F.col("mensaje_limpio")))
    patient = [F.col("paciente_id")] if "paciente_id" in frame.columns else []
    return [*patient, key.alias("clave")]


def deduplicate(frame: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Keep the first row of each patient and text.

    A rank filter on 1, so Spark thins every group inside the map tasks, before the
    shuffle: however often one message repeats, a task sends at most one copy of it.
    """
    frame = with_clean(frame)
    *patient, key = duplicate_key(frame)
    keyed = frame.withColumn("_clave", key)
    window = Window.partitionBy(*patient, "_clave").orderBy(*order)
    ranked = keyed.withColumn("_lugar", F.row_number().over(window))
    return ranked.filter("_lugar = 1").drop("_clave", "_lugar")


def valid_rows(frame: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Usable rows without duplicates, cleaning each message once.

    A filter on ``util`` before the window would be pushed below the cleaning and repeat
    it.  Here unusable rows share one window group instead, which the rank filter thins
    to a row per task, and they leave after the window.
    """
    flagged = with_usable(frame)
    keys = {f"_k{i}": F.when(F.col("util"), k) for i, k in enumerate(duplicate_key(flagged))}
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = flagged.withColumns(keys).withColumn("_lugar", F.row_number().over(window))
    return ranked.filter("_lugar = 1 and util").drop(*keys, "_lugar", "util")


def collapse(frame: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """One row per patient and text with ``copias``, the number of rows it stands for.

    Unusable rows fold into a single row with ``util`` false, so one pass and one
    shuffle give both the valid rows and exact volume counts.  Partial aggregation
    bounds what a map task sends to one row per key.
    """
    flagged = with_usable(frame)
    keyed = flagged.withColumn("_clave", F.when(F.col("util"), digest(flagged)))
    first = F.min_by(F.struct(*flagged.columns), F.struct(*order)).alias("fila_primera")
    grouped = keyed.groupBy("util", "_clave").agg(first, F.count("*").alias("copias"))
    return grouped.select("fila_primera.*", "copias")


def digest(frame: DataFrame) -> Column:
    """``duplicate_key`` in 64 characters, so that a group's key does not carry a third copy of the text."""
    parts = (F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in duplicate_key(frame))
    return F.sha2(F.to_json(F.array(*parts)), 256)


def stats(frame: DataFrame) -> DataFrame:
    """One row: rows read, discarded as empty, removed as duplicates, valid."""
    flagged = with_usable(frame)
    keys = [F.when(F.col("util"), k).alias(f"_k{i}") for i, k in enumerate(duplicate_key(flagged))]
    groups = flagged.select("util", *keys).groupBy("util", *(f"_k{i}" for i in range(len(keys)))).agg(F.count("*").alias("copias"))
    return collapsed_stats(groups)


def collapsed_stats(groups: DataFrame) -> DataFrame:
    """The same counts from collapsed rows (``util``, ``copias``)."""
    read = F.coalesce(F.sum("copias"), F.lit(0))
    empty = F.coalesce(F.sum(F.when(~F.col("util"), F.col("copias"))), F.lit(0))
    valid = F.count_if("util")
    return groups.agg(
        read.alias("filas_leidas"),
        empty.alias("filas_descartadas_vacio"),
        (read - empty - valid).alias("duplicados_eliminados"),
        valid.alias("filas_validas"),
    )


def require_rows(counts: dict) -> dict:
    """Stop a run that has nothing to process."""
    if counts["filas_leidas"] == 0:
        raise NoUsableRowsError("the input has no rows")
    if counts["filas_validas"] == 0:
        raise NoUsableRowsError("every row was discarded in preprocessing")
    return counts


def with_print(frame: DataFrame) -> DataFrame:
    """Add a hash of the whole row, which orders rows that share their place; rows alike in it are interchangeable."""
    return frame.withColumn(ROW_PRINT, F.xxhash64(*frame.columns))


def labelled(frame: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Every row with ``motivo_rechazo``: ``vacio``, ``duplicado``, or null for a valid one.

    Nothing is written or joined.  The first row of each key is found among the rows of one
    input task, then among these firsts; all other rows are duplicates wherever the first is.  So
    rows of a message that repeats endlessly stay dealt over as many groups as there are tasks.
    """
    flagged = with_usable(frame)
    keyed = flagged.withColumns({"_clave": F.when(F.col("util"), digest(flagged)), "_tarea": F.spark_partition_id()})
    first = F.row_number().over(Window.partitionBy("_clave", "_tarea").orderBy(*order)) == 1
    local = keyed.withColumn("_primera", first & F.col("util"))
    group = F.when(F.col("_primera"), F.lit(-1)).otherwise(F.col("_tarea"))
    place = F.row_number().over(Window.partitionBy("_clave", "_grupo").orderBy(*order))
    ranked = local.withColumn("_grupo", group).withColumn("_lugar", place)
    reason = F.when(~F.col("util"), "vacio").when(~F.col("_primera") | (F.col("_lugar") > 1), "duplicado")
    return ranked.withColumn("motivo_rechazo", reason).drop("_clave", "_tarea", "_primera", "_grupo", "_lugar")


def rejected(frame: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Every row that is not valid, with ``motivo_rechazo``, in the frame's own columns."""
    kept = [c for c in frame.columns if c not in ("mensaje_limpio", "util", ROW_PRINT)]
    return labelled(frame, order).filter("motivo_rechazo IS NOT NULL").select(*kept, "motivo_rechazo")
