import time

import pytest
from pyspark.sql import functions as F

from turnera.operators import columns
from turnera.plans.settings import RunOptions
from turnera.sources import memo
from turnera.streaming import incremental

SCHEMA = "id_paciente string, mensaje string"


@pytest.fixture
def inbox(spark, tmp_path):
    folder = tmp_path / "in"

    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / name))

    put("01", [("P1", "Quiero cancelar mi cita"), ("P1", "quiero cancelar mi CITA"), ("P2", "")])
    put("02", [("P1", "quiero  cancelar mi cita."), ("P3", "Confirmo la visita")])
    return folder, put


def options(tmp_path, **more):
    return incremental.StreamOptions(RunOptions(str(tmp_path / "out"), str(tmp_path / "memo")), str(tmp_path / "control"), **more)


def process(spark, inbox, choice):
    counts = {}
    stream = incremental.read_stream(spark, str(inbox), SCHEMA, files_per_batch=1)
    query = incremental.start(stream, choice, counts.__setitem__)
    query.awaitTermination()
    observed = [p["observedMetrics"]["volumen"] for p in query.recentProgress if p["numInputRows"]]
    assert [o["filas_leidas"] for o in observed] == [c["filas_leidas"] for c in counts.values()]
    return counts


def results(spark, tmp_path):
    return sorted((r.paciente_id, r.mensaje_limpio) for r in incremental.results(spark, str(tmp_path / "out")).collect())


def test_each_batch_on_its_own(spark, inbox, tmp_path):
    counts = process(spark, inbox[0], options(tmp_path))
    assert [c["filas_validas"] for c in counts.values()] == [1, 2]
    assert sum(c["filas_leidas"] for c in counts.values()) == 5
    assert results(spark, tmp_path) == [("P1", "Quiero cancelar mi cita"), ("P1", "quiero cancelar mi cita"), ("P3", "Confirmo la visita")]


def test_across_batches_and_later_files(spark, inbox, tmp_path):
    choice = options(tmp_path, across_batches=True)
    process(spark, inbox[0], choice)
    assert results(spark, tmp_path) == [("P1", "Quiero cancelar mi cita"), ("P3", "Confirmo la visita")]
    inbox[1]("03", [("P3", "CONFIRMO la visita"), (None, "Confirmo la visita")])
    assert list(process(spark, inbox[0], choice)) == [2]
    everything = incremental.results(spark, str(tmp_path / "out"))
    assert everything.count() == 3 and everything.filter("paciente_id is null").count() == 1


def test_a_repeated_batch_replaces_itself(spark, inbox, tmp_path):
    choice = options(tmp_path, across_batches=True)
    batch = spark.read.schema(SCHEMA).parquet(str(inbox[0] / "01")).select(
        F.lit("01").alias("archivo_origen"), F.col("_metadata.row_index").alias("fila"), "*"
    )
    for _ in range(2):
        incremental.process_batch(columns.validated(batch), 0, choice)
    assert results(spark, tmp_path) == [("P1", "Quiero cancelar mi cita")]
    assert memo.read(spark, choice.run.memo_path).count() == 1


def test_streams_with_one_output_keep_both(spark, inbox, tmp_path):
    process(spark, inbox[0], options(tmp_path))
    first = results(spark, tmp_path)
    other = incremental.StreamOptions(RunOptions(str(tmp_path / "out"), str(tmp_path / "memo")), str(tmp_path / "control2"))
    process(spark, inbox[0], other)
    assert results(spark, tmp_path) == sorted(first * 2)
    third = incremental.StreamOptions(RunOptions(str(tmp_path / "out"), str(tmp_path / "memo")), str(tmp_path / "control3"), across_batches=True)
    process(spark, inbox[0], third)
    assert results(spark, tmp_path) == sorted(first * 2)


def test_keys_are_forgotten_after_their_time(spark, inbox, tmp_path):
    choice = options(tmp_path, across_batches=True, remember_days=1 / 86_400)  # a second
    process(spark, inbox[0], choice)
    time.sleep(2)
    inbox[1]("03", [("P3", "CONFIRMO la visita")])
    process(spark, inbox[0], choice)
    assert [p for p, _ in results(spark, tmp_path)].count("P3") == 2
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "false"


def test_files_of_any_header_are_landed_once(spark, tmp_path):
    for name, rows, schema in (
        ("1", [("P1", "Quiero cancelar mi cita")], " ID_Paciente string, Mensaje string"),
        ("2", [("Confirmo la visita", "P2", 5)], "mensaje_texto string, paciente_id string, extra int"),
        ("3", [(7, "Pido hora")], "paciente_id int, mensaje string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    where = str(tmp_path / "in"), str(tmp_path / "landed"), str(tmp_path / "control-in")
    incremental.land(spark, *where, files_per_batch=2).awaitTermination()
    first = spark.read.parquet(where[1])
    assert sorted((r.paciente_id, r.mensaje_texto) for r in first.collect()) == [("7", "Pido hora"), ("P1", "Quiero cancelar mi cita"), ("P2", "Confirmo la visita")]
    # The last batch again, as after a failure between its rows and its commit.
    for commit in (tmp_path / "control-in" / "commits").glob("*1*"):
        commit.unlink()
    spark.createDataFrame([("P9", "Deseo anular")], "id_paciente string, mensaje string").coalesce(1).write.parquet(str(tmp_path / "in" / "4"))
    incremental.land(spark, *where, files_per_batch=2).awaitTermination()
    assert spark.read.parquet(where[1]).count() == 4
    incremental.start(incremental.read_landed(spark, where[1]), options(tmp_path, across_batches=True)).awaitTermination()
    assert len(results(spark, tmp_path)) == 4
