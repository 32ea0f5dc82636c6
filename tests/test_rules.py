"""Every rule is checked against Python's own regex engine on the plain rule tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions import rules, text
from turnera.sources import requests
from tests.conftest import SMALL

LABELS = {"accion": fixed.ACTION_RULES, "especialidad": fixed.SPECIALTY_RULES}
MATCHES = {"fecha_solicitada": fixed.DATE_RULES, "preferencia_horario": fixed.TIME_RULES}
EVERY_RULE = [
    *fixed.ACTION_VETOES,
    *(p for table in LABELS.values() for patterns in table.values() for p in patterns),
    *fixed.DATE_RULES,
    *fixed.TIME_RULES,
]


def expected(field: str, folded: str) -> str:
    if field in MATCHES:
        found = (re.search(p, folded) for p in MATCHES[field])
        return next((m[0].strip() for m in found if m), "")
    if field == "accion" and any(re.search(p, folded) for p in fixed.ACTION_VETOES):
        return ""
    return next((label for label, ps in LABELS[field].items() if any(re.search(p, folded) for p in ps)), "")


def check(spark, messages):
    frame = spark.createDataFrame([(m,) for m in messages], "m string")
    folded = frame.select("m", text.matching_form(F.col("m")).alias("t"))
    rows = folded.select("t", *(f("t").alias(n) for n, f in rules.EXTRACTORS.items())).collect()
    for row in rows:
        for field in rules.EXTRACTORS:
            assert row[field] == expected(field, row.t), (field, row.t)


def example(rule: str, pick: random.Random) -> str:
    """A text the rule matches, made from the rule."""
    out = rule.replace(r"\b", "")
    while group := re.search(r"\(([^()]*)\)(\?)?", out):
        choice = pick.choice(group[1].split("|"))
        out = out[: group.start()] + ("" if group[2] and pick.random() < 0.5 else choice) + out[group.end():]
    out = re.sub(r"\\d\{(\d)[^}]*\}", lambda m: "7" * int(m[1]), out)
    out = re.sub(r"\\s[+*]", lambda _: pick.choice([" ", "  ", "\u00a0", "\n"]), out)
    out = re.sub(r"\\w\*", lambda _: pick.choice(["", "log", "ñ_½"]), out)
    out = re.sub(r"([a-z])\?", lambda m: m[1] if pick.random() < 0.5 else "", out)
    return out + "x" if rule.endswith(r" \b") else out


def test_every_rule_has_an_example_that_holds_its_needle():
    pick = random.Random(5)
    for rule in EVERY_RULE:
        for _ in range(20):
            sample = example(rule, pick)
            assert re.search(rule, sample), (rule, sample)
            words = rules.needles(rule)
            assert not words or any(w in sample for w in words)


def test_every_rule_alone_and_mixed(spark):
    pick = random.Random(7)
    pieces = [example(rule, pick) for rule in EVERY_RULE for _ in range(3)]
    alone = [f"{before}{piece}{after}" for piece in pieces for before, after in [("", ""), ("ver ", " hoy"), ("é", ""), ("", "½"), ("(", ")"), ("_", "_")]]
    mixed = [pick.choice([" ", ", ", "\n", ""]).join(pick.sample(pieces, 3)) for _ in range(1500)]
    check(spark, alone + mixed + [m.upper() for m in mixed[:300]])


def test_derived_view(spark):
    view = requests.solicitudes(spark.read.parquet(f"{SMALL}/orders.parquet"))
    messages = [r.m for r in view.select(text.present(F.col("mensaje_texto")).alias("m")).collect()]
    check(spark, messages)
    folded = [m.lower().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO)) for m in messages]
    never = [rule for rule in EVERY_RULE if not any(re.search(rule, m) for m in folded)]
    assert never == [r"\bdesconfirmar\b"]


@pytest.mark.parametrize(
    "field, message, value",
    [
        ("accion", "Quiero confirmar mi cita", "confirmar"),
        ("accion", "No voy a poder asistir, cancele por favor", "cancelar"),
        ("accion", "Solicito modificar la fecha de mi consulta", "reprogramar"),
        ("accion", "confirmar si es posible postergar", "reprogramar"),
        ("accion", "no quiero confirmar ni cancelar", ""),
        ("accion", "no lo sé todavía", ""),
        ("preferencia_horario", "en el horario de la mañana", "horario de la manana"),
        ("preferencia_horario", "para el turno de la tarde", "turno de la tarde"),
        ("preferencia_horario", "en las primeras horas del día", "primeras horas del dia"),
        ("preferencia_horario", "a las 9 de", "a las 9"),
        ("especialidad", "cita con el cardiólogo", "cardiologia"),
        ("especialidad", "me pueden otorgar hora", "otorrinolaringologia"),
        ("especialidad", "maternidad", ""),
        ("fecha_solicitada", "mañana, o el 15 de mayo", "el 15 de mayo"),
        ("fecha_solicitada", "la próxima semana por la mañana", "proxima semana"),
    ],
)
def test_examples(spark, field, message, value):
    frame = spark.createDataFrame([(message,)], "m string").select(text.matching_form(F.col("m")).alias("t"))
    assert frame.select(rules.EXTRACTORS[field]("t").alias("v")).first().v == value
