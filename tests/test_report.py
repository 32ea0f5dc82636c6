import json

import pytest
from pyspark.sql import functions as F

from turnera.operators import report

SCHEMA = "accion string, especialidad string, tokens_original int, tokens_limpio int, tokens_ingles int"


@pytest.fixture
def results(spark):
    return spark.createDataFrame([("confirmar", "", 100, 80, 60), ("cancelar", "x", 200, 160, 120), (None, None, 0, 0, 0)], SCHEMA)


@pytest.fixture
def untranslated(results):
    return results.withColumn("tokens_ingles", F.lit(None).cast("int"))


def test_totals_and_savings(results):
    row = report.totals_and_savings(report.cells(results)).first()
    assert (row.n_procesadas, row.tokens_original, row.tokens_limpio, row.tokens_ingles) == (3, 300, 240, 180)
    assert (row.costo_original, row.limpio_absoluto, row.limpio_pct) == (0.00075, 0.00015, pytest.approx(20))
    assert row.ingles_pct == pytest.approx(40)


def test_no_saving_is_claimed_for_a_missing_translation(untranslated):
    row = report.totals_and_savings(report.cells(untranslated)).first()
    assert (row.tokens_ingles, row.costo_ingles, row.ingles_absoluto, row.ingles_pct) == (0, 0.0, None, None)


def test_nothing_processed(results):
    cell = report.cells(results.limit(0))
    row = report.totals_and_savings(cell).first()
    assert (row.n_procesadas, row.costo_original, row.limpio_pct) == (0, 0.0, 0.0)
    assert report.average_tokens(cell).first() == (0.0, 0.0, 0.0)
    assert {(r.tokens, r.costo) for r in report.projection(cell).collect()} == {(0, 0.0)}


def test_projection(spark):
    cell = report.cells(spark.createDataFrame([("a", "b", 20, 10, None)], SCHEMA))
    rows = {(r.variante, r.periodo): (r.mensajes, r.tokens, r.costo) for r in report.projection(cell).collect()}
    assert rows["original", "mensual"] == (450_000, 9_000_000, 22.5)
    assert len(rows) == 8 and ("ingles", "anual") not in rows


def test_variants(results, untranslated):
    rows = {r.variante: r for r in report.variant_comparison(report.cells(results)).collect()}
    assert rows["ingles"].promedio == 60 and rows["original"].ahorro == 0
    assert {r.variante for r in report.variant_comparison(report.cells(untranslated)).collect()} == {"original", "limpio"}


def test_distributions_keep_empty_apart_and_break_ties_by_label(spark):
    rows = [("", "b"), (None, "a"), ("x", "a"), ("", "b"), ("z", None)]
    cell = report.cells(spark.createDataFrame([(a, e, 1, 1, 1) for a, e in rows], SCHEMA))
    assert [tuple(r) for r in report.action_distribution(cell).collect()] == [("", 2), ("(sin accion)", 1), ("x", 1), ("z", 1)]
    assert [tuple(r) for r in report.specialty_distribution(cell).collect()] == [("a", 2), ("b", 2), ("(sin especialidad)", 1)]
    assert [r.especialidad for r in report.top_specialties(cell, 1).collect()] == ["a"]


def test_document(spark, results):
    stats = spark.createDataFrame([(9, 3, 3, 3)], "filas_leidas bigint, filas_descartadas_vacio bigint, duplicados_eliminados bigint, filas_validas bigint")
    document = report.aggregates_document(report.cells(results), stats, "glosario")
    assert document.count() == 1
    body = json.loads(document.select(F.to_json(F.struct("*")).alias("j")).first().j)
    assert body["proyeccion"]["original"]["diario"]["mensajes"] == 15_000
    assert body["preprocesamiento"]["filas_leidas"] == 9
    assert body["_meta"] == {"motor_traduccion": "glosario", "optimizar_tokens": True, "tarifa_usd_por_millon": 2.5, "mensajes_por_dia_proyeccion": 15000}


def test_rows_of_the_report_are_complete_at_any_cardinality(spark):
    many = spark.range(12_000).select(F.lit("a").alias("accion"), F.concat(F.lit("e"), "id").alias("especialidad"), *(F.lit(1).alias(f"tokens_{v}") for v in ("original", "limpio", "ingles")))
    stats = spark.createDataFrame([(9, 3, 3, 3)], "filas_leidas bigint, filas_descartadas_vacio bigint, duplicados_eliminados bigint, filas_validas bigint")
    rows = report.aggregates_rows(report.cells(many), stats)
    assert rows.filter("seccion = 'distribucion_especialidades'").count() == 12_000
    assert {r.valor for r in rows.filter("seccion = 'distribucion_acciones'").collect()} == {12_000.0}
    assert report.aggregates_document(report.cells(many), stats).first().n_procesadas == 12_000


def test_sums_by_text_equal_sums_by_row(spark):
    valid = spark.createDataFrame([("a", "x", "t1", 3), ("a", "x", "t1", 4), ("b", "", "t2", 5)], "accion string, especialidad string, mensaje_limpio string, tokens_original int")
    table = spark.createDataFrame([("t1", 2, 1), ("t2", 7, None)], "texto_origen string, tokens_limpio int, tokens_ingles int")
    by_row = valid.join(table.withColumnRenamed("texto_origen", "mensaje_limpio"), "mensaje_limpio")
    assert sorted(report.cells_of_texts(valid, table).collect()) == sorted(report.cells(by_row).collect())
