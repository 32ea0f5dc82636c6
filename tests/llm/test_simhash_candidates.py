"""The SimHash operator's links are candidates of the near-duplicate stage, by themselves too."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_near_copies import kept, likeness, shingled
from turnera.llm import near_copies


def simhash(text, size):
    words = text.lower().split()
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def long_copies():
    """Texts, one of their words replaced, one text's words repeated, and texts apart."""
    random = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        words = [f"w{i}" for i in random.integers(0, 10**6, 600)]
        changed = list(words)
        changed[int(random.integers(0, 600))] = "other"
        texts += [" ".join(words), " ".join(changed), " ".join(words[:200]) + " apart"]
    return dict(enumerate([*texts, texts[0] + " " + texts[0], "", "one", "two"]))


def test_close_simhashes_link_without_a_shared_key(spark):
    texts = long_copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = frame.select("doc_id", near_copies._described(F.col("text"), 5).alias("d")).select("doc_id", "d.*")
    rows = {r.doc_id: r for r in sets.collect()}
    assert all(r.simhash & (2**64 - 1) == simhash(texts[d], 5) for d, r in rows.items())
    none = F.filter("bands", lambda b: F.lit(False))
    far = sets.dropDuplicates(["fingerprint"]).withColumn("bands", F.when(F.size("bands") > 0, F.array(F.xxhash64("fingerprint"))).otherwise(none))
    root = {r.fingerprint: r.cluster for r in near_copies.clusters(far, 0.8).collect()}
    close = [(a, b) for a in texts for b in range(a) if texts[a] and texts[b] and rows[a].fingerprint != rows[b].fingerprint and (rows[a].simhash ^ rows[b].simhash).bit_count() <= 3]
    assert len(close) > 8 and all(root.get(rows[a].fingerprint) == root.get(rows[b].fingerprint) is not None for a, b in close)
    assert all(likeness(shingled(texts[a]), shingled(texts[b])) < 1 for a, b in close)


def test_result_is_that_of_brute_force(spark):
    texts = long_copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicated(frame).collect()} == kept(texts)
