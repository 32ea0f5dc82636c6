import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnera.operators import translation as tr

NOW = datetime(2025, 6, 1)
UPPER = tr.Engine("mayusculas", column=F.upper)


def batches(chunks):
    for texts in chunks:
        yield ["" if t == "mudo" else t[::-1] for t in texts]


REVERSE = tr.Engine("al reves", batches=batches)


@pytest.fixture
def frame(spark):
    rows = [(i, t) for i, t in enumerate(["uno", "dos", "uno", "Uno", "mudo"])]
    return spark.createDataFrame(rows, "fila int, mensaje_limpio string")


def english(frame):
    return {r.fila: r.mensaje_ingles for r in frame.collect()}


def memo(spark, *rows):
    rows = [(key(t), t, target, "viejo", written, expires) for t, target, written, expires in rows]
    return spark.createDataFrame(rows, tr.MEMO_SCHEMA)


def key(source):
    return "tr_es_en:" + hashlib.sha256(source.encode()).hexdigest()[:16]


def test_keys(frame):
    rows = tr.distinct_texts(frame).collect()
    assert {(r.cache_key, r.texto_origen, r.veces) for r in rows} == {(key(t), t, 2 if t == "uno" else 1) for t in ("uno", "dos", "Uno", "mudo")}


@pytest.mark.parametrize("memoised", [False, True])
def test_both_kinds_of_engine(spark, frame, memoised):
    known = memo(spark, ("dos", "TWO", NOW, None)) if memoised else None
    two = "TWO" if memoised else "DOS"
    assert english(tr.translate(frame, UPPER, known, NOW)) == {0: "UNO", 1: two, 2: "UNO", 3: "UNO", 4: "MUDO"}
    two = "TWO" if memoised else "sod"
    assert english(tr.translate(frame, REVERSE, known, NOW)) == {0: "onu", 1: two, 2: "onu", 3: "onU", 4: "mudo"}


def test_engine_sees_each_unknown_text_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def counting(chunks):
        for texts in chunks:
            seen.add(len(texts))
            yield texts

    known = memo(spark, ("dos", "TWO", NOW, None))
    table = tr.translations(tr.distinct_texts(frame), tr.Engine("cuenta", batches=counting), known, NOW, partitions=2)
    assert {r.texto_origen for r in table.collect() if r.nuevo} == {"uno", "Uno", "mudo"}
    assert seen.value == 3


def test_expiry_and_latest_entry(spark, frame):
    hour = timedelta(hours=1)
    known = memo(
        spark,
        ("uno", "old", NOW - 2 * hour, None), ("uno", "new", NOW - hour, NOW + hour),
        ("dos", "gone", NOW - hour, NOW), ("tres", "other", NOW, None),
    )
    texts = tr.distinct_texts(frame)
    found = {r.texto_origen: r.texto_destino for r in tr.lookup(texts, known, NOW).collect()}
    assert found == {"uno": "new", "dos": None, "Uno": None, "mudo": None}
    assert {r.texto_origen for r in tr.misses(texts, known, NOW).collect()} == {"dos", "Uno", "mudo"}


def test_a_key_collision_does_not_mix_texts(spark, frame):
    known = spark.createDataFrame([(key("uno"), "otro texto", "wrong", "x", NOW, None)], tr.MEMO_SCHEMA)
    assert {r.texto_destino for r in tr.lookup(tr.distinct_texts(frame), known, NOW).collect()} == {None}


def test_written_entries(frame):
    table = tr.translations(tr.distinct_texts(frame), REVERSE)
    rows = tr.memo_entries(table, 30, NOW).collect()
    assert len(rows) == 4 and {r.expires_at - r.written_at for r in rows} == {timedelta(days=30)}
    assert {r.expires_at for r in tr.memo_entries(table, 0, NOW).collect()} == {None}
    assert tr.memo_entries(table.withColumn("nuevo", F.lit(False)), 30, NOW).count() == 0


def test_hot_texts_give_the_same_rows(spark):
    rows = spark.range(3000).select(
        F.col("id").cast("int").alias("fila"),
        F.when(F.col("id") % 3 == 0, "muy frecuente").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("mensaje_limpio"),
    )
    table = tr.translations(tr.distinct_texts(rows), UPPER)
    mapped = tr.map_back(rows, table)
    plain = rows.join(table.withColumnRenamed("texto_origen", "mensaje_limpio"), "mensaje_limpio", "left")
    expected = {r.fila: r.texto_destino for r in plain.collect()}
    assert english(mapped) == expected and mapped.count() == 3000
    assert set(mapped.columns) == {"fila", "mensaje_limpio", "mensaje_ingles"}


def test_a_hot_text_is_met_in_pieces(spark):
    rows = spark.range(2000).select(F.col("id").alias("fila"), F.lit("muy frecuente").alias("mensaje_limpio"))
    plan = tr.map_back(rows, tr.translations(tr.distinct_texts(rows), UPPER))
    assert "_pieza" in plan._jdf.queryExecution().optimizedPlan().toString() and english(plan) == {i: "MUY FRECUENTE" for i in range(2000)}


def test_glossary(spark):
    frame = spark.createDataFrame([(1, "Quiero  cambiar mi\tcita")], "fila int, mensaje_limpio string")
    engine = tr.glossary_engine({"quiero": "want", "cita": "visit", "mi": "my"})
    assert english(tr.translate(frame, engine)) == {1: "want  cambiar mi\tcita"}


def test_dictionary_takes_the_longest_phrase_from_the_left(spark):
    entries = [("cita", "visit"), ("mi cita", "my visit"), ("Cambiar mi", "change my"), ("cita de hoy", "today's visit"), ("hoy", "today"), ("hoy", "now"), (None, "x"), ("y", None)]
    engine = tr.dictionary_engine(spark.createDataFrame(entries, "origen string, destino string"), 3)
    rows = ["cambiar mi cita de hoy", "CITA y hoy", "mi cita de ayer", "nada", "", None, "cita"]
    frame = spark.createDataFrame(list(enumerate(rows)), "fila int, mensaje_limpio string")
    expected = ["change my today's visit", "visit y now", "my visit de ayer", "nada", "", None, "visit"]
    assert english(tr.translate(frame, engine)) == dict(enumerate(expected))
    known = memo(spark, ("cita", "DATE", NOW, None))
    assert english(tr.translate(frame, engine, known, NOW))[6] == "DATE"


def test_choice():
    assert tr.choose_engine("auto", {"remoto": REVERSE, "local": UPPER}, ("local", "remoto")) is UPPER
    assert tr.choose_engine("local", {"remoto": REVERSE}) is REVERSE
    with pytest.raises(ValueError):
        tr.choose_engine("auto", {})


def test_budgeted_batches_keep_their_order():
    seen = []

    def engine(batches):
        for texts in batches:
            seen.append(texts)
            yield [t.upper() for t in texts]

    lists = [["a b c d e f", "a", "b c", "", "x y z"], [], ["long " * 50, "q"], []]
    got = list(tr.budgeted(engine, budget=12)(iter(lists)))
    assert got == [[t.upper() for t in texts] for texts in lists]
    for texts in seen:
        assert len(texts) == 1 or len(texts) * max(len(t.split()) + 1 for t in texts) <= 12
    assert len(seen) < 7


def test_engines_are_probed_where_they_run(spark):
    def broken():
        return False

    engines = {"a": tr.Engine("a", available=broken), "b": tr.Engine("b", available=lambda: True), "c": tr.Engine("c")}
    there = tr.probed(spark, engines, tasks=5)
    assert list(there) == ["b", "c"] and tr.choose_engine("auto", there, ("a", "b")).name == "b"


def test_hot_texts_are_met_in_pieces(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i % 2, f"cold {i % 40}") for i in range(80)] + [(7, None)]
    frame = spark.createDataFrame(rows, "fila long, mensaje_limpio string")
    known = tr.distinct_texts(frame.na.drop()).withColumns({"texto_destino": F.upper("texto_origen"), "motor": F.lit("m"), "nuevo": F.lit(True)}).checkpoint()
    got = tr.map_back(frame, known)
    assert sorted((r.fila, r.mensaje_limpio or "", r.mensaje_ingles or "") for r in got.collect()) == sorted((f, t or "", (t or "").upper()) for f, t in rows)
