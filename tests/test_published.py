"""Versions that writers publish side by side, and the memo stored by key."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from turnera.operators import translation
from turnera.sources import memo, published


def test_writers_side_by_side(spark, tmp_path):
    root = str(tmp_path / "root")
    assert published.current(spark, root) == []
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: published.publish(spark, root, lambda parts: [*parts, f"p{i}"]), range(18)))
    assert sorted(published.current(spark, root)) == sorted(f"p{i}" for i in range(18))
    published.forget_versions(spark, root, keep=2)
    assert len(list((tmp_path / "root" / published.FOLDER).glob("0*.json"))) == 2 and len(published.current(spark, root)) == 18


def test_a_writer_that_dies_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "root")
    published.publish(spark, root, lambda parts: ["good"])

    def die(parts):
        raise OSError("killed")

    with pytest.raises(OSError):
        published.publish(spark, root, die)
    (tmp_path / "root" / published.FOLDER / ".draft").write_text("{")
    assert published.current(spark, root) == ["good"]


def texts_of(spark, words, times=1):
    return translation.distinct_texts(spark.createDataFrame([(w,) for w in words] * times, "mensaje_limpio string"))


def entries(spark, words, engine="a", ttl=30):
    known = texts_of(spark, words).withColumns({"texto_destino": F.upper("texto_origen"), "motor": F.lit(engine), "nuevo": F.lit(True)})
    return translation.memo_entries(known, ttl)


def test_only_touched_prefixes_are_read(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo.write(entries(spark, [f"text {i}" for i in range(300)]), path, "one")
    assert len(published.current(spark, path)) == 16
    asked = texts_of(spark, ["text 7", "text 8", "unknown"]).checkpoint()
    read = memo.read(spark, path, asked)
    prefixes = {r.cache_key[len("tr_es_en:")] for r in asked.collect()}
    assert {f.split("prefijo=")[1][0] for f in read.inputFiles()} <= prefixes and len(prefixes) < 4
    assert "In(cache_key" in read._jdf.queryExecution().executedPlan().toString() or "cache_key" in str(read._jdf.queryExecution().executedPlan().toString())
    found = {r.texto_origen: r.texto_destino for r in translation.lookup(asked, read).collect()}
    assert found == {"text 7": "TEXT 7", "text 8": "TEXT 8", "unknown": None}


def test_compaction_of_gathered_prefixes(spark, tmp_path):
    path = str(tmp_path / "memo")
    words = [f"text {i}" for i in range(60)]
    memo.write(entries(spark, words), path, "one")
    memo.write(entries(spark, words[:3], "b"), path, "two")
    memo.write(entries(spark, words[:3], "c"), path, "two")  # a repeated run replaces itself
    expired = entries(spark, ["old"]).withColumn("expires_at", F.current_timestamp() - F.expr("interval 1 day"))
    memo.write(expired, path, "three")
    before = published.current(spark, path)
    assert sum("two." in p for p in before) <= 3 and memo.read(spark, path, but="two").filter("motor = 'c'").isEmpty()
    gone = memo.compact(spark, path)
    alone = {p for p in before if sum(p.split("/")[1] == q.split("/")[1] for q in before) == 1}
    assert alone and alone <= set(published.current(spark, path)) and alone.isdisjoint(gone)
    memo.remove(spark, path, gone)
    left = sorted((r.texto_origen, r.motor) for r in memo.read(spark, path).collect() if r.texto_origen != "old")
    assert left == sorted((w, "c" if w in words[:3] else "a") for w in words)
    parts = [p.split("/")[1] for p in published.current(spark, path)]
    assert len(parts) == len(set(parts)) and memo.compact(spark, path) == []


def test_compaction_beside_a_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "memo")
    for run in ("one", "two"):
        memo.write(entries(spark, [f"text {i}" for i in range(20)], run), path, run)
    fresh = translation.fresh

    def meanwhile(table):
        memo.write(entries(spark, ["late"]), path, "late")
        return fresh(table)

    monkeypatch.setattr(translation, "fresh", meanwhile)
    memo.compact(spark, path)
    assert sorted(r.motor for r in memo.read(spark, path).collect()) == ["a"] + ["two"] * 20
