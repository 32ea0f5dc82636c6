import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions import money, tokens
from turnera.operators import costing


def test_cost(spark):
    frame = spark.createDataFrame([(0,), (1,), (3,), (None,), (1_000_000,), (4001,)], "t int")
    costs = [r.c for r in frame.select(money.cost(F.col("t")).cast("double").alias("c")).collect()]
    assert costs == [0.0, 0.000003, 0.000008, None, 2.5, 0.010003]


def test_other_rate(spark):
    row = spark.range(1).select(money.cost(F.lit(7), Decimal("0.15")).cast("double").alias("c")).first()
    assert row.c == 0.000001


def test_projection_is_exact(spark):
    pick = random.Random(3)
    rows = []
    for _ in range(2000):
        n = pick.randrange(1, 10 ** pick.randrange(1, 10))
        rows.append((pick.randrange(n * 100_000), n, 15_000 * pick.choice([1, 30, 90, 365])))
    rows += [(1, 2, 15_001), (3, 2, 15_001), (20, 1, 450_000), (0, 0, 15_000)]
    frame = spark.createDataFrame(rows, "s bigint, n bigint, m bigint")
    volume = [F.col(c) for c in "snm"]
    out = frame.select("*", money.projected_tokens(*volume).alias("t"), money.projected_cost(*volume).alias("c")).collect()
    for r in out:
        exact = Fraction(r.s * r.m, max(r.n, 1))
        assert r.t == round(exact)
        micros = exact * Fraction("2.5")
        assert r.c * 10**6 == (2 * micros.numerator + micros.denominator) // (2 * micros.denominator)
    assert (out[-2].t, float(out[-2].c)) == (9_000_000, 22.5)


def test_pretokens(spark):
    frame = spark.createDataFrame([("Hola, día 2025!",), ("",), (None,), ("a\u00a0b",)], "m string")
    assert [r.n[0] for r in frame.select(tokens.pretoken_counts(F.col("m")).alias("n")).collect()] == [6, 0, 0, 2]


def test_bpe_equals_the_encoder(spark, table):
    texts = ["hola mundo", "cancelar cita", "", None, "<|endoftext|> 😀", "hola mundo"] * 50
    frame = table([(t, "x") for t in texts], "mensaje_texto, mensaje_limpio").repartition(3)
    encoder = tokens._encoder(None, None)
    rows = costing.count_variants(frame, tokens.bpe_counts(), ("original", "limpio")).collect()
    for row in rows:
        assert row.tokens_original == len(encoder.encode_ordinary(row.mensaje_texto or ""))
        assert row.tokens_limpio == 1
    assert {r.tokens_original for r in rows if not r.mensaje_texto} == {0}


def test_rank_file_of_the_caller(spark, table, tmp_path):
    import base64

    ranks = tmp_path / "own.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ho") + b" 256")
    counted = costing.count_variants(table([("hola", "")], "mensaje_texto, x"), tokens.bpe_counts(str(ranks)), ("original",))
    assert counted.first().tokens_original == 3


def test_all_variants_in_one_python_pass(spark, table):
    frame = table([("a", "b", "c")], "mensaje_texto, mensaje_limpio, mensaje_ingles")
    plan = costing.count_variants(frame, tokens.bpe_counts())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_row_prices(spark):
    frame = spark.createDataFrame([(10, 4, None)], "tokens_original int, tokens_limpio int, tokens_ingles int")
    row = costing.price_rows(frame).first()
    assert [row[f"costo_estimado_{v}"] for v in fixed.VARIANTS] == [0.000025, 0.00001, None]


def test_bad_rank_path(spark, table):
    with pytest.raises(Exception, match="own_missing"):
        costing.count_variants(table([("a", "")], "mensaje_texto, x"), tokens.bpe_counts("/nowhere/own_missing"), ("original",)).collect()
