"""Near duplicates by exact similarity, against brute force; clusters whole and dealt into chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_queries import simhash
from turnera.llm import near_copies


def shingled(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(texts):
    """The smallest id of every component of pairs at 0.8 or more."""
    sets = {d: shingled(t) for d, t in texts.items()}
    group = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return set(group.values())


def copies(random, n, words=120):
    """A text and copies of it with a few words replaced."""
    base = [f"w{i}" for i in random.integers(0, 5000, words)]
    texts = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for at in random.integers(0, words, int(random.integers(1, 4))):
            own[at] = f"x{random.integers(0, 10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("sets", [1024, 5])
def test_stage_links_at_eight_tenths_only(spark, monkeypatch, sets):
    monkeypatch.setattr(near_copies, "SETS", sets)
    random = np.random.default_rng(4)
    listed = [t for _ in range(4) for t in copies(random, 9)]
    listed += [listed[0], listed[0].upper(), "", " ", "one two", "one  two", "one three"]
    half = listed[0].split()[:60]
    listed += [" ".join(half), " ".join(half[:59])]  # Jaccard with the whole far below 0.8, with each other above
    texts = dict(enumerate(listed))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, frame, SMALL).collect()}
    assert got == kept(texts)
    far = [(a, b) for a in texts for b in texts if a < b and likeness(shingled(texts[a]), shingled(texts[b])) >= 0.8 and (simhash(texts[a]) ^ simhash(texts[b])).bit_count() > 3]
    assert far  # pairs that three bits would miss


def test_keys_of_repeated_and_null_ids(spark):
    rows = [(None, "same words in all of these")] * 3 + [(None, "something else entirely, and longer"), (7, "same words in all of these")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_copies.deduplicated(frame).collect()) == [0, 7]
    assert near_copies.deduplicated(frame.limit(0)).count() == 0


def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = kept({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()} == expected


def test_boilerplate_gathers_no_cluster(spark):
    """Texts that share 60 of 100 words share keys in a chain, but none is probably like another."""
    random = np.random.default_rng(11)
    common = " ".join(f"b{i}" for i in range(60))
    texts = [common + " " + " ".join(f"w{i}" for i in random.integers(0, 10**6, 40)) for _ in range(1500)]
    texts += [texts[0] + " more", texts[7] + " more"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = frame.select("doc_id", near_copies._described(F.col("text"), 5).alias("d")).select("doc_id", "d.*")
    share = sets.select(F.explode("bands").alias("k")).groupBy("k").count().filter("count > 1").count()
    found = near_copies.clusters(sets, 0.8).groupBy("cluster").count().collect()
    assert share > 100 and sorted(r["count"] for r in found) == [2, 2]
    kept_ids = {r.doc_id for r in near_copies.deduplicated(frame).collect()}
    assert kept_ids == set(range(1500))


@pytest.mark.parametrize("few, size", [(64, 1024), (1, 5)])
def test_candidates_against_brute_force(spark, monkeypatch, few, size):
    """Every two sets at 0.8 or more are joined by candidate links, whatever the sizes of keys and chunks."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SETS", size)
    random = np.random.default_rng(12)
    texts = [t for _ in range(20) for t in copies(random, 12, words=80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = frame.select("doc_id", near_copies._described(F.col("text"), 5).alias("d")).select("doc_id", "d.*")
    root = {r.fingerprint: r.cluster for r in near_copies.clusters(sets, 0.8).collect()}
    name = {r.doc_id: r.fingerprint for r in sets.collect()}
    own = [shingled(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 0.8 <= likeness(own[a], own[b]) < 1]
    assert len(pairs) > 100 and all(root.get(name[a]) == root.get(name[b]) is not None for a, b in pairs)
