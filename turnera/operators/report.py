"""Totals, savings, distributions and projections of a processed table.

Everything is derived from ``cells``: one row per action and specialty with counts and
token sums.  It is the only scan of the processed rows, and partial aggregation makes
its shuffle as small as the number of different values.
"""

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions.money import cost, projected_cost, projected_tokens

RATE = fixed.RATE_USD_PER_MILLION


def _sums() -> list[Column]:
    tokens = [F.coalesce(F.sum(f"tokens_{v}"), F.lit(0)).alias(f"tokens_{v}") for v in fixed.VARIANTS]
    return [F.count("*").alias("n"), F.count("tokens_ingles").alias("n_ingles"), *tokens]


def cells(results: DataFrame) -> DataFrame:
    """Counts and token sums per action and specialty."""
    return results.groupBy("accion", "especialidad").agg(*_sums())


def whole(results: DataFrame) -> DataFrame:
    """The same sums over all rows, for reports without a distribution: no field has to be extracted."""
    return results.agg(*_sums())


def cells_of_texts(valid: DataFrame, translated: DataFrame) -> DataFrame:
    """``cells`` before the rows meet their translation: rows are summed by text first.

    ``valid`` counts the original's tokens, ``translated`` those of clean and English text.
    """
    by_text = valid.groupBy("accion", "especialidad", "mensaje_limpio").agg(F.count("*").alias("n"), F.sum("tokens_original").alias("tokens_original"))
    tokens = translated.select(F.col("texto_origen").alias("mensaje_limpio"), "tokens_limpio", "tokens_ingles")
    met = by_text.join(tokens, "mensaje_limpio", "left")
    times = {v: F.coalesce(F.sum(F.col("n") * F.col(f"tokens_{v}")), F.lit(0)).alias(f"tokens_{v}") for v in ("limpio", "ingles")}
    return met.groupBy("accion", "especialidad").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("tokens_ingles").isNotNull(), F.col("n"))), F.lit(0)).alias("n_ingles"),
        F.sum("tokens_original").alias("tokens_original"), times["limpio"], times["ingles"],
    )


def totals(cell: DataFrame) -> DataFrame:
    """One row: ``n``, ``n_ingles`` and the token sum of every variant."""
    names = ("n", "n_ingles", *(f"tokens_{v}" for v in fixed.VARIANTS))
    return cell.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names))


def totals_and_savings(cell: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Token sums, the cost of each sum, and what the variants save against the original."""
    priced = totals(cell).withColumns({f"_costo_{v}": cost(F.col(f"tokens_{v}"), rate) for v in fixed.VARIANTS})
    savings = {v: _saving(v) for v in ("limpio", "ingles")}
    return priced.select(
        F.col("n").alias("n_procesadas"),
        *(f"tokens_{v}" for v in fixed.VARIANTS),
        *(F.col(f"_costo_{v}").cast("double").alias(f"costo_{v}") for v in fixed.VARIANTS),
        *(saved.alias(f"{v}_absoluto") for v, (saved, _) in savings.items()),
        *(share.alias(f"{v}_pct") for v, (_, share) in savings.items()),
    )


def _saving(variant: str) -> tuple[Column, Column]:
    """USD and percent saved; null for a translation that was not made."""
    base = F.col("_costo_original")
    saved = (base - F.col(f"_costo_{variant}")).cast("double")
    share = F.when(base == 0, 0.0).otherwise(saved / base.cast("double") * 100)
    made = (F.col("n_ingles") > 0) if variant == "ingles" else F.lit(True)
    return F.when(made, saved), F.when(made, share)


def average_tokens(cell: DataFrame) -> DataFrame:
    """Tokens per message of every variant, 0 without messages."""
    return totals(cell).select(*(_average(F.col(f"tokens_{v}")).alias(v) for v in fixed.VARIANTS))


def _average(tokens: Column, n: Column | None = None) -> Column:
    n = F.col("n") if n is None else n
    return F.when(n == 0, 0.0).otherwise(tokens.cast("double") / n.cast("double"))


def _variant_rows(cell: DataFrame) -> DataFrame:
    """One row per computed variant: ``variante``, ``tokens``, ``tokens_base``, ``n``."""
    pairs = F.array(
        *(F.struct(F.lit(v).alias("variante"), F.col(f"tokens_{v}").alias("tokens")) for v in fixed.VARIANTS)
    )
    rows = totals(cell).select("n", "n_ingles", F.col("tokens_original").alias("tokens_base"), F.inline(pairs))
    return rows.filter((F.col("variante") != "ingles") | (F.col("n_ingles") > 0)).drop("n_ingles")


def variant_comparison(cell: DataFrame, rate: Decimal = RATE) -> DataFrame:
    """Long table of the variants; a translation without tokens is left out."""
    rows = _variant_rows(cell).filter((F.col("variante") != "ingles") | (F.col("tokens") > 0))
    priced = rows.withColumns({"_costo": cost(F.col("tokens"), rate), "_base": cost(F.col("tokens_base"), rate)})
    saved = (F.col("_base") - F.col("_costo")).cast("double")
    return priced.select(
        "variante",
        "tokens",
        F.col("_costo").cast("double").alias("costo"),
        _average(F.col("tokens")).alias("promedio"),
        saved.alias("ahorro"),
        F.when(F.col("_base") == 0, 0.0).otherwise(saved / F.col("_base").cast("double") * 100).alias("ahorro_pct"),
    )


def projection(
    cell: DataFrame, messages_per_day: int = fixed.MESSAGES_PER_DAY, periods: dict[str, int] | None = None, rate: Decimal = RATE
) -> DataFrame:
    """Messages, tokens and cost of each variant over each period."""
    volumes = F.array(
        *(
            F.struct(F.lit(name).alias("periodo"), F.lit(messages_per_day * days).cast("bigint").alias("mensajes"))
            for name, days in (periods or fixed.PERIOD_DAYS).items()
        )
    )
    rows = _variant_rows(cell).select("variante", F.col("tokens").alias("_suma"), "n", F.inline(volumes))
    volume = (F.col("_suma"), F.col("n"), F.col("mensajes"))
    return rows.select(
        "variante",
        "periodo",
        "mensajes",
        projected_tokens(*volume).alias("tokens"),
        projected_cost(*volume, rate).cast("double").alias("costo"),
    )


def distribution(cell: DataFrame, column: str, absent: str) -> DataFrame:
    """Rows per value, most frequent first; '' is a value of its own."""
    value = F.coalesce(F.col(column), F.lit(absent)).alias(column)
    return cell.groupBy(value).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), column)


def action_distribution(cell: DataFrame) -> DataFrame:
    return distribution(cell, "accion", fixed.WITHOUT_ACTION)


def specialty_distribution(cell: DataFrame) -> DataFrame:
    return distribution(cell, "especialidad", fixed.WITHOUT_SPECIALTY)


def top_specialties(cell: DataFrame, k: int = 8) -> DataFrame:
    return specialty_distribution(cell).limit(k)


def kpi_row(stats: DataFrame) -> DataFrame:
    """Headline counts out of the volume statistics."""
    return stats.select(
        F.col("filas_leidas").alias("leidas"),
        F.col("filas_validas").alias("validas"),
        F.col("filas_descartadas_vacio").alias("descartadas"),
        F.col("duplicados_eliminados").alias("duplicados"),
    )


def aggregates_document(
    cell: DataFrame,
    stats: DataFrame,
    engine: str = "none",
    optimized: bool = True,
    messages_per_day: int = fixed.MESSAGES_PER_DAY,
    rate: Decimal = RATE,
) -> DataFrame:
    """The parts of the report that have a fixed size, as one row of nested columns.

    Distributions have as many values as the requests do; ``aggregates_rows`` holds them.
    """
    sums = totals_and_savings(cell, rate)
    names = [f"{kind}_{v}" for kind in ("tokens", "costo") for v in fixed.VARIANTS]
    savings = [f"{v}_{kind}" for v in ("limpio", "ingles") for kind in ("absoluto", "pct")]
    head = sums.select("n_procesadas", F.struct(*names).alias("totales"), F.struct(*savings).alias("ahorro"))
    averages = average_tokens(cell).select(F.struct(*fixed.VARIANTS).alias("promedio_tokens_por_mensaje"))
    # Three variants of four periods.
    period = F.map_from_entries(F.collect_list(F.struct("periodo", F.struct("mensajes", "tokens", "costo"))))
    by_variant = projection(cell, messages_per_day, rate=rate).groupBy("variante").agg(period.alias("periodos"))
    periods = by_variant.agg(F.map_from_entries(F.collect_list(F.struct("variante", "periodos"))).alias("proyeccion"))
    parts = [head, averages, periods, stats.select(F.struct(*stats.columns).alias("preprocesamiento"))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # one row each
    document = rows.agg(*(F.first(c, ignorenulls=True).alias(c) for part in parts for c in part.columns))
    meta = F.struct(
        F.lit(engine).alias("motor_traduccion"),
        F.lit(optimized).alias("optimizar_tokens"),
        F.lit(float(rate)).alias("tarifa_usd_por_millon"),
        F.lit(messages_per_day).alias("mensajes_por_dia_proyeccion"),
    )
    return document.withColumn("_meta", meta)


def aggregates_rows(
    cell: DataFrame, stats: DataFrame, messages_per_day: int = fixed.MESSAGES_PER_DAY, rate: Decimal = RATE
) -> DataFrame:
    """The whole report as rows ``seccion``, ``clave``, ``valor``: complete for any number of values."""
    sums = totals_and_savings(cell, rate)
    for v in fixed.VARIANTS:
        sums = sums.withColumn(f"promedio_{v}", _average(F.col(f"tokens_{v}"), F.col("n_procesadas")))
    named = [("totales", c, c) for c in (f"{kind}_{v}" for kind in ("tokens", "costo") for v in fixed.VARIANTS)]
    named += [("ahorro", c, c) for c in (f"{v}_{kind}" for v in ("limpio", "ingles") for kind in ("absoluto", "pct"))]
    named += [("procesadas", "n_procesadas", "n_procesadas")]
    named += [("promedio_tokens_por_mensaje", v, f"promedio_{v}") for v in fixed.VARIANTS]
    parts = [_long(sums, named), _long(stats, [("preprocesamiento", c, c) for c in stats.columns])]
    for section, table, key in (
        ("distribucion_acciones", action_distribution(cell), "accion"),
        ("distribucion_especialidades", specialty_distribution(cell), "especialidad"),
    ):
        parts.append(table.select(F.lit(section).alias("seccion"), F.col(key).alias("clave"), F.col("n").cast("double").alias("valor")))
    periods = projection(cell, messages_per_day, rate=rate)
    figures = F.array(*(F.struct(F.lit(c).alias("que"), F.col(c).cast("double").alias("valor")) for c in ("mensajes", "tokens", "costo")))
    inlined = periods.select("variante", "periodo", F.inline(figures))
    parts.append(inlined.select(F.lit("proyeccion").alias("seccion"), F.concat_ws(".", "variante", "periodo", "que").alias("clave"), "valor"))
    return reduce(DataFrame.union, parts)


def _long(row: DataFrame, named: list[tuple[str, str, str]]) -> DataFrame:
    """Columns of one row as (section, key, column) say."""
    cells = (F.struct(F.lit(s).alias("seccion"), F.lit(k).alias("clave"), F.col(c).cast("double").alias("valor")) for s, k, c in named)
    return row.select(F.inline(F.array(*cells)))
