import pytest
from pyspark.sql import functions as F

from turnera.operators import quality
from turnera.plans import job

ROWS = [
    ("P1", "Confirmo mi cita"), ("P1", "confirmo  mi cítá"), ("P2", "Confirmo mi cita"), ("P2", ""),
    ("P2", "hola"), (None, "cancelar"), (None, "CANCELAR."), ("P3", "ok"), ("P3", "ok."), ("P3", None),
]


def ids(frame):
    return sorted(r.fila for r in frame.select("fila").collect())


def test_split(table):
    frame = job.prepare(table(ROWS))
    assert ids(quality.usable(frame)) == [0, 1, 2, 5, 6, 8]
    assert ids(quality.unusable(frame)) == [3, 4, 7, 9]


def test_first_of_each_patient_and_text(table):
    frame = job.prepare(table(ROWS))
    assert ids(quality.deduplicate(quality.usable(frame))) == [0, 2, 5, 8]
    assert ids(quality.valid_rows(frame)) == [0, 2, 5, 8]


def test_without_patient_the_text_alone_decides(table):
    frame = table(["Confirmo mi cita", "confirmo  mi  cita", "cancelar"], "mensaje_texto")
    assert ids(quality.deduplicate(frame)) == [0, 2]


def test_counts_add_up(table):
    counts = quality.stats(job.prepare(table(ROWS))).first().asDict()
    assert counts == {"filas_leidas": 10, "filas_descartadas_vacio": 4, "duplicados_eliminados": 2, "filas_validas": 4}


def test_collapse_keeps_first_and_counts_copies(table):
    rows = quality.collapse(job.prepare(table(ROWS))).collect()
    assert sorted((r.fila, r.copias) for r in rows if r.util) == [(0, 2), (2, 1), (5, 2), (8, 1)]
    assert [r.copias for r in rows if not r.util] == [4]
    assert quality.collapsed_stats(quality.collapse(job.prepare(table(ROWS)))).first() == quality.stats(job.prepare(table(ROWS))).first()


def test_rejects_are_everything_else(table):
    rows = quality.rejected(job.prepare(table(ROWS))).collect()
    assert sorted((r.fila, r.motivo_rechazo) for r in rows) == [
        (1, "duplicado"), (3, "vacio"), (4, "vacio"), (6, "duplicado"), (7, "vacio"), (9, "vacio"),
    ]


@pytest.mark.parametrize("partitions", [1, 64])
def test_any_partitioning_gives_the_same_rows(spark, table, partitions):
    frame = table([("P1", f"Cita número {i % 40}") for i in range(400)]).repartition(partitions)
    assert ids(quality.valid_rows(job.prepare(frame))) == list(range(40))


def test_one_text_in_most_rows(spark):
    """A message that fills the table reaches the shuffle once per task."""
    frame = spark.range(0, 200_000, 1, 8).select(
        F.lit("a").alias("archivo_origen"), F.col("id").alias("fila"), F.lit("P").alias("paciente_id"),
        F.when(F.col("id") % 1000 == 999, F.concat(F.lit("texto "), F.col("id"))).otherwise(F.lit("quiero cancelar")).alias("mensaje_texto"),
    )
    valid = quality.valid_rows(frame)
    assert valid.count() == 201
    plan = valid._jdf.queryExecution().executedPlan().toString()
    limit = plan.index("row_number(), 1, Partial")
    assert plan.index("Exchange") < limit  # printed above, so executed after
    assert plan.count("substring_index") == 1  # each message is cleaned once


def test_empty_guards():
    with pytest.raises(quality.NoUsableRowsError, match="no rows"):
        quality.require_rows({"filas_leidas": 0, "filas_validas": 0})
    with pytest.raises(quality.NoUsableRowsError, match="discarded"):
        quality.require_rows({"filas_leidas": 3, "filas_validas": 0})


def test_rejects_of_a_hot_key_need_no_join(spark):
    """Every row is told once, whichever task holds the first of its key."""
    rows = [("a", (i * 37) % 400, "P1", "Deseo anular la hora") for i in range(400)] + [("b", i, f"P{i}", "ok" if i % 2 else f"Pido hora {i}") for i in range(40)]
    frame = job.prepare(spark.createDataFrame(rows, "archivo_origen string, fila long, paciente_id string, mensaje_texto string").repartition(7))
    told = quality.labelled(frame)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {(r.archivo_origen, r.fila): r.motivo_rechazo for r in told.collect()}
    assert len(got) == 440 and got.pop(("a", 0)) is None
    assert all((r == "duplicado") if k[0] == "a" else (r == ("vacio" if k[1] % 2 else None)) for k, r in got.items())
