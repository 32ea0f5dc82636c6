"""The pipeline's stages on the smallest tables, each against a plain restatement on its own input."""

import re

import pyarrow.parquet as pq

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_near_copies import kept

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, size=10):
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns[:5] == columns and all(before[d] == t for d, t in seen[-1].items())
    quality, near, clean, coded = seen
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    assert sum((d in quality) != (q == 1) for d, q in labels.items() if d in before) <= 0.02 * len(labels)
    assert set(near) == kept(quality)
    items = [r["text"] for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    held = set().union(*(windows(t) for t in items))
    hit = {d for d, t in near.items() if any(windows(t, n) & held for n in {len(w) for w in held})}
    assert set(clean) == set(near) - hit
    assert set(coded) == set(clean) and docs.columns[5:] == ["ids"]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
