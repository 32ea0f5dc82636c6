import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions.tokens import bpe_counts, pretoken_counts
from turnera.operators import columns, quality, translation
from turnera.plans import job, queries
from turnera.plans.settings import RunOptions
from turnera.session import at_least, shared_folder, wanted_partitions
from turnera.sources import memo, readers, workbook
from tests.conftest import SMALL

FOUR = [
    ("P1", "Les confirmo la visita de cardiologia del lunes."),
    ("P2", "Hay que anular la hora que tenia pedida."),
    ("P3", ""),
    ("P4", "hola"),
]


def test_without_translation(spark, table, tmp_path):
    out = str(tmp_path / "out")
    seen = []
    run = job.run(spark, table(FOUR), RunOptions(out, optimize_tokens=False, counter=bpe_counts(), rejects=True), seen.append)
    assert run.stats == {"filas_leidas": 4, "filas_descartadas_vacio": 2, "duplicados_eliminados": 0, "filas_validas": 2}
    rows = sorted(run.results.collect())
    assert run.results.columns == list(fixed.RESULT_COLUMNS)
    assert [(r.paciente_id, r.accion, r.especialidad, r.fecha_solicitada) for r in rows] == [("P1", "confirmar", "cardiologia", "lunes"), ("P2", "cancelar", "", "")]
    assert {(r.mensaje_ingles, r.tokens_ingles, r.costo_estimado_ingles) for r in rows} == {("", None, None)}
    document = seen[0]
    assert document["_meta"]["motor_traduccion"] == "none" and document["_meta"]["optimizar_tokens"] is False
    assert set(document["proyeccion"]) == {"original", "limpio"} and document["proyeccion"]["original"]["anual"]["costo"] > 0
    assert document["totales"]["tokens_original"] == sum(r.tokens_original for r in rows)
    assert sorted((r.fila, r.motivo_rechazo) for r in run.rejects.collect()) == [(2, "vacio"), (3, "vacio")]
    written = json.loads(next(Path(run.path, "agregados").glob("part-*.json")).read_text())
    assert written["n_procesadas"] == 2 and written["ahorro"]["ingles_pct"] is None
    latest = job.latest_aggregates(spark, out).first()
    assert latest.n_procesadas == 2 and latest.ultima_ejecucion is not None


@pytest.mark.parametrize("pieces", [200, 5])
def test_run_equals_the_lazy_plan(spark, tmp_path, monkeypatch, pieces):
    monkeypatch.setattr(translation, "PIECES", pieces)
    requests = queries.sol_with_names(spark, SMALL)
    run = job.run(spark, requests, RunOptions(str(tmp_path / "out"), str(tmp_path / "memo"), rejects=True))
    lazy = queries.results_contract(spark, SMALL)
    assert run.results.exceptAll(lazy).count() == 0 and lazy.exceptAll(run.results).count() == 0
    assert run.stats == queries.preprocess_stats(spark, SMALL).first().asDict()
    assert run.stats["filas_leidas"] == run.results.count() + run.rejects.count()
    reasons = dict(run.rejects.groupBy("motivo_rechazo").count().collect())
    assert reasons == {"vacio": run.stats["filas_descartadas_vacio"], "duplicado": run.stats["duplicados_eliminados"]}


def test_second_run_translates_nothing(spark, table, tmp_path):
    options = RunOptions(str(tmp_path / "out"), str(tmp_path / "memo"))
    job.run(spark, table(FOUR), options)
    first = memo.read(spark, options.memo_path)
    assert first.count() == 2 and first.columns[0] == "cache_key"
    again = job.run(spark, table([*FOUR, ("P9", "Deseo postergar")]), options)
    assert memo.read(spark, options.memo_path).count() == 3
    assert again.results.count() == 3


def test_a_killed_run_leaves_the_former_results(spark, table, tmp_path):
    options = RunOptions(str(tmp_path / "out"), str(tmp_path / "memo"))
    with pytest.raises(job.NoResultsError):
        job.latest_results(spark, options.output_path)
    first = job.run(spark, table(FOUR), options)

    def broken(batches):
        yield next(batches)
        raise OSError("out of memory")

    late = RunOptions(options.output_path, counter=translation_breaks)
    for attempt in (RunOptions(options.output_path, engine=translation.Engine("rota", batches=broken)), late):
        with pytest.raises(Exception, match="out of memory|counted"):
            job.run(spark, table([("P7", "Pido hora para el lunes")]), attempt)
        assert sorted(job.latest_results(spark, options.output_path).collect()) == sorted(first.results.collect())
        assert job.latest_aggregates(spark, options.output_path).first().n_procesadas == 2
    second = job.run(spark, table(FOUR[:1]), options)
    assert job.latest_run(spark, options.output_path) == second.path and job.latest_results(spark, options.output_path).count() == 1
    job.remove_former_runs(spark, options.output_path)
    assert [p.name for p in Path(options.output_path, "corridas").iterdir()] == [second.run_id]
    observed = job.run_metrics(spark, options.output_path).first()
    assert (observed.corrida, observed.filas_leidas, observed.filas_escritas) == (second.run_id, 1, 1)
    assert observed.tokens_original == second.results.agg({"tokens_original": "sum"}).first()[0]


def translation_breaks(column):
    raise ValueError("not to be counted")


def test_nothing_to_do(spark, table, tmp_path):
    options = RunOptions(str(tmp_path / "out"))
    with pytest.raises(quality.NoUsableRowsError, match="no rows"):
        job.run(spark, table(FOUR).limit(0), options)
    with pytest.raises(quality.NoUsableRowsError, match="discarded"):
        job.run(spark, table(FOUR[2:]), options)
    with pytest.raises(columns.MissingColumnsError):
        job.run(spark, table(FOUR).drop("paciente_id"), options)
    with pytest.raises(columns.MissingColumnsError, match="fila"):
        job.run(spark, table(FOUR).drop("fila"), options)


def test_workbook_in_workbook_out(spark, table, tmp_path):
    workbook.register(spark)
    given = table(FOUR).select(F.col("paciente_id").alias("ID_PACIENTE"), F.col("mensaje_texto").alias("Mensaje"))
    given.coalesce(1).write.format("workbook").mode("append").save(str(tmp_path / "in"))
    requests = readers.read_requests(spark, str(tmp_path / "in"))
    run = job.run(spark, requests, RunOptions(str(tmp_path / "out"), export_format="xlsx"))
    exported = readers.read_requests(spark, f"{run.path}/xlsx")
    assert exported.columns[2:] == list(fixed.RESULT_COLUMNS)
    assert sorted(r.mensaje_limpio for r in exported.collect()) == sorted(r.mensaje_limpio for r in run.results.collect())


def test_row_data_is_shuffled_once_before_translation(spark):
    plan = job.processed(queries.sol(spark, SMALL), pretoken_counts, queries.GLOSSARY)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(_k") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text


def test_partitions_are_dealt_out_on_request_only(spark):
    frame = spark.range(0, 10, 1, 1)
    assert at_least(frame, None, "id") is frame
    assert at_least(frame, 4, "id").rdd.getNumPartitions() == 4


def test_wanted_partitions_come_from_the_plan_alone(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    frame = spark.range(0, 1_000_000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    assert wanted_partitions(frame, 1 << 20) >= 1
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup()) == list(before)


def test_computed_columns_of_the_input_are_ignored(spark, table, tmp_path):
    plain = job.run(spark, table(FOUR), RunOptions(str(tmp_path / "a"), rejects=True))
    stale = table(FOUR).withColumns({c: F.lit("STALE") for c in (*columns.COMPUTED, "_t", "_clave")})
    again = job.run(spark, stale, RunOptions(str(tmp_path / "b"), rejects=True))
    assert sorted(again.results.collect()) == sorted(plain.results.collect())
    assert sorted(again.rejects.collect()) == sorted(plain.rejects.collect())


def test_metrics_come_before_the_table_and_stages_go(spark, table, tmp_path):
    out, seen = tmp_path / "out", []
    run = job.run(spark, table(FOUR), RunOptions(str(out)), lambda document: seen.append(bool(list(out.glob("corridas/*/resultados")))))
    assert seen == [False] and run.results.count() == 2
    assert not Path(shared_folder(spark).removeprefix("file:"), "turnera", run.run_id).exists()


def test_rejects_are_complete_on_repeated_and_null_row_identity(spark, tmp_path):
    schema = "archivo_origen string, fila bigint, paciente_id string, mensaje_texto string"
    for rows in (
        [("a", 1, "P1", "Deseo anular la hora"), ("a", 1, "P1", "deseo anular la HORA"), ("a", 1, "P2", ""), ("a", 1, "P3", "")],
        [("a", None, "P1", "Deseo anular la hora"), ("a", None, "P1", "Deseo anular la hora"), (None, 2, "P2", "x"), (None, None, "P4", "Pido hora")],
    ):
        run = job.run(spark, spark.createDataFrame(rows, schema), RunOptions(str(tmp_path / str(rows[0][1])), rejects=True))
        assert run.stats["filas_leidas"] == 4 == run.results.count() + run.rejects.count()
        reasons = dict(run.rejects.groupBy("motivo_rechazo").count().collect())
        assert reasons.get("duplicado", 0) == run.stats["duplicados_eliminados"] and reasons["vacio"] == run.stats["filas_descartadas_vacio"]


def test_totals_read_no_rules(spark):
    for query in (queries.totals_and_savings, queries.avg_tokens, queries.cost_projection, queries.variant_comparison):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert next(iter(fixed.SPECIALTY_RULES.values()))[0] not in plan and fixed.DATE_RULES[0] not in plan
