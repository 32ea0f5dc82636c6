import pytest
from pyspark.sql import functions as F

from turnera.functions import text

CASES = [
    (None, ""),
    ("", ""),
    (" \t\r\n ", ""),
    ("Hola, muchas gracias por confirmar la cita por favor.", "por confirmar la cita"),
    ("Quiero reprogramar mi cita para el viernes.", "Quiero reprogramar mi cita para el viernes"),
    ("uno.dos tres", "uno"),
    (".empieza con punto", ""),
    ("llego a las 9.30", "llego a las 9"),
    ("Buenos días doctora", "Buenos días doctora"),
    ("buenos dias doctora", "doctora"),
    ("confirmo la cita saludos a todos", "confirmo la cita"),
    ("confirmo la cita saludos amigos", "confirmo la cita amigos"),
    ("espero turno QUEDO A SU DISPOSICION para lo que sea", "espero turno"),
    ("cita\u00a0\u2003de\x1cojos", "cita de ojos"),
    ("cita @ # sede * norte", "cita sede norte"),
    ("holanda no es hola", "holanda no es"),
    ("hola_1 hola", "hola_1"),
    ("éhola hola½ hola", "éhola hola½"),
    ("¿¡: cita (urgente) !?", "cita ()"),
    ("cita 😀 médica", "cita médica"),
    ("GRACIAS Gracias gracia", "gracia"),
    ("le agradezco agradezco muy amable", ""),
]


@pytest.mark.parametrize("message, expected", CASES)
def test_clean(spark, message, expected):
    frame = spark.createDataFrame([(message,)], "m string")
    assert frame.select(text.clean(F.col("m")).alias("c")).first().c == expected


def test_clean_is_stable_on_its_own_output(spark):
    frame = spark.createDataFrame([(m,) for m, _ in CASES], "m string")
    once = frame.select(text.clean(F.col("m")).alias("c")).filter(~F.col("c").contains("."))
    assert once.filter(text.clean(F.col("c")) != F.col("c")).count() == 0


def test_fold_changes_only_the_listed_letters(spark):
    row = spark.createDataFrame([("ÁÉÍÓÚÜÑ áéíóúüñ àçö",)], "m string")
    assert row.select(text.matching_form(F.col("m")).alias("f")).first().f == "aeiouun aeiouun àçö"


@pytest.mark.parametrize(
    "message, cleaned, usable",
    [
        ("abc", "abc", True),
        ("ok", "ok", False),
        ("  ok  ", "ok", False),
        ("ok!", "ok", True),
        ("12!", "12", False),
        ("123", "123", True),
        ("é !", "é", True),
        ("hola", "", False),
        ("\u2003\u2003\u2003", "", False),
        (None, "", False),
        ("a\nb", "a\nb", True),
    ],
)
def test_usable(spark, message, cleaned, usable):
    frame = spark.createDataFrame([(message, cleaned)], "m string, c string")
    assert frame.select(text.is_usable(F.col("m"), F.col("c")).alias("u")).first().u is usable


def test_strip_removes_every_kind_of_space(spark):
    frame = spark.createDataFrame([(text.SPACE_CHARS + "x y" + text.SPACE_CHARS,)], "m string")
    assert frame.select(text.strip(F.col("m")).alias("s")).first().s == "x y"
    assert text.SPACE_CHARS == "".join(c for c in map(chr, range(0x110000)) if c.isspace())
