"""Work is dealt to tasks by rows, not by the splits of a file, and state is reached a bucket at a time."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnera.plans import queries
from turnera.streaming import incremental


@pytest.fixture(scope="module")
def one_split(spark, tmp_path_factory):
    """Orders in a file of one row group, some keys twice and some null."""
    d = str(tmp_path_factory.mktemp("orders"))
    keys = spark.range(120_000).select(F.nullif(F.col("id") % 110_000, F.lit(3)).alias("o_orderkey"), F.nullif(F.col("id") * 7 % 1000, F.lit(5)).alias("o_custkey"))
    keys.coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.range(900).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name")).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("view", [queries.sol, queries.sol_with_names])
def test_requests_are_dealt_before_they_are_worded(spark, one_split, view, monkeypatch):
    monkeypatch.setattr(queries, "KEYS_EACH", 64 << 10)
    frame = view(spark, one_split)
    held = [n for n in frame.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"] if n]
    assert len(held) > 4 and sum(held) == 120_000 and max(held) < 2 * 120_000 / len(held)


def test_a_small_input_is_not_moved(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert queries.sol(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_a_bucket_of_keys_is_read_and_added_to_once():
    class State:
        def __init__(self):
            self.held, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.held)

        def appendList(self, values):
            self.calls += 1
            self.held += values

    class Handle:
        def getListState(self, name, schema, lifetime=None):
            return state

    state, names = State(), ["archivo_origen", "fila", "util", "clave_sha", "cubo"]
    first = incremental.FirstOfKey(names, None)
    first.init(Handle())
    rows = [Row(*names)("a", i, True, f"k{i % 500}", 1) for i in range(2000)] + [Row(*names)(None, 7, False, "vacio:1", 1)] * 3
    out = {r["clave_sha"]: r for r in first.handleInputRows((1,), iter(rows), None)}
    assert len(out) == 501 and all(r["nuevo"] for r in out.values()) and out["vacio:1"]["copias"] == 3
    assert all(out[f"k{i}"]["fila"] == i and out[f"k{i}"]["copias"] == 4 for i in range(500))
    again = list(first.handleInputRows((1,), iter([*rows[:2], Row(*names)("a", 1, True, "neu", 1), *rows[-1:]]), None))
    assert {r["clave_sha"]: r["nuevo"] for r in again} == {"k0": False, "k1": False, "neu": True, "vacio:1": True}
    assert state.calls == 4 and len(state.held) == 501
