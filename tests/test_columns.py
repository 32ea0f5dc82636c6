import pytest

from turnera import fixed_values as fixed
from turnera.operators import columns, fields


def test_aliases_case_and_blanks(spark):
    frame = spark.createDataFrame([("1", "hola", "x")], [" ID_Paciente", "MENSAJE ", "especialidad_medica"])
    assert columns.normalize_columns(frame).columns == ["paciente_id", "mensaje_texto", "especialidad"]


def test_first_column_of_a_name_wins(spark):
    frame = spark.createDataFrame([("1", "2", "m", "n")], ["id_paciente", "paciente_id", "mensaje_texto", "Mensaje"])
    assert columns.normalize_columns(frame).first().asDict() == {"paciente_id": "1", "mensaje_texto": "m"}


def test_missing_columns(spark):
    with pytest.raises(columns.MissingColumnsError, match="paciente_id.*mensaje_texto.*foo"):
        columns.validated(spark.createDataFrame([("1",)], ["foo"]))


def test_null_message_becomes_empty(table):
    assert columns.validated(table([("1", None)])).first().mensaje_texto == ""


def test_contract(spark):
    frame = spark.createDataFrame([("1", "cancelar", 3, "sobra")], "paciente_id string, accion string, tokens_limpio int, extra string")
    out = columns.result_contract(frame)
    assert dict(out.dtypes) == fixed.RESULT_COLUMNS and out.columns == list(fixed.RESULT_COLUMNS)
    row = out.first()
    assert (row.paciente_id, row.tokens_limpio, row.mensaje_ingles, row.costo_estimado_ingles) == ("1", 3, None, None)


def test_given_values_win(table):
    frame = table(
        [("1", "cancelar mañana", " otra ", "el lunes"), ("2", "cancelar mañana", " \t", ""), ("3", "nada", None, None)],
        "paciente_id, mensaje_texto, accion, fecha_solicitada",
    )
    rows = fields.extract_fields(frame).orderBy("fila").collect()
    assert [(r.accion, r.fecha_solicitada) for r in rows] == [(" otra ", "el lunes"), ("cancelar", "manana"), ("", "")]


def test_only_the_wanted_fields(table):
    assert fields.extract_fields(table([("1", "cancelar")]), ["accion"]).columns[-1] == "accion"
