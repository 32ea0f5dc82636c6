"""Collocations against a plain count, the trie against a Counter."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnera.llm import phrases


def brute(rows, least, within=80, best=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            counts.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = []
    for lang, counts in f.items():
        phrases_ = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in phrases_.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    longer[p[i : i + s]] = max(longer[p[i : i + s]], a)
        scored = []
        for p, a in phrases_.items():
            if longer[p] and 100 * longer[p] >= within * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:best], 1):
            found.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def texts(random, n=60):
    words = np.array(["alfa", "Beta", "beta", "gámma", "δ", "e'e", "x\x00y", "zz", " ", "alfabeta"])
    gaps = np.array([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", " :"])
    return ["".join(w + g for w, g in zip(words[random.integers(0, 10, 80) // (1 + i % 3)], gaps[random.integers(0, 10, 80)])) for i in range(n)]


CASES = [("en", None), (None, ""), ("", "one one one one one one one"), ("und", "a b a b a b"), (None, "a b. a b"), ("en", "."), ("en", " \t\n")]


@pytest.mark.parametrize("least", [1, 5])
def test_against_counts(spark, monkeypatch, least):
    random = np.random.default_rng(3)
    rows = [(["en", "de", None][i % 3], t) for i, t in enumerate(texts(random))] + CASES
    rows += rows[:5] + [("en", "very long words in a row " * 3000)]
    monkeypatch.setattr(phrases, "PIECES", 4)  # prefixes dealt into pieces
    frame = spark.createDataFrame([(l, t, 1, "x", 2) for l, t in rows], "lang string, text string, n int, phrase string, rank int")
    got = sorted(map(tuple, phrases.collocations(frame, least=least).collect()))
    assert got == brute(rows, least)
    assert max(Counter(r[0] for r in got).values()) > 10


def test_ranked_in_tiers(spark, monkeypatch):
    rows = [("en", t) for t in texts(np.random.default_rng(5))]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(frame, least=2, best=7).collect())) == brute(rows, 2, best=7)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(frame).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_trie_bursts_and_spills(k):
    """Every phrase leaves whole, whatever bursts or has to leave early."""
    random = np.random.default_rng(k)
    counter = phrases.Counter(k, None, entries=60, words=40, burst=8)
    rows, expected = [], Counter()
    for number in range(30):
        own = texts(random, 4) + [" ".join(f"w{i}" for i in random.integers(0, 50, 30))]
        language = ["en", "de"][number % 2]
        for t in own:
            for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                w = [x for x in re.split("[ \t]+", piece) if x]
                expected.update((language, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
        rows += list(counter.read(language, pa.array(own)))
    rows += list(counter.rest())
    got = Counter()
    for batch in rows:
        for r in batch.to_pylist():
            got[r["lang"], f"{r['prefix']} {r['last']}" if k > 1 else r["last"]] += r["n"]
    assert got == expected and len(rows) > 3


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_task_holds_and_tells_a_bounded_part(monkeypatch, k):
    """Runs leave in small batches, texts are scanned in small portions, and the trie stays near its bound within one call."""
    monkeypatch.setattr(phrases, "TOLD", 64)
    monkeypatch.setattr(phrases, "SCANNED", 500, raising=False)
    random = np.random.default_rng(k)
    own = [" ".join(f"w{i}" for i in random.integers(0, 400, 60)) + "." for _ in range(100)] + ["", "."]
    counter, most = phrases.Counter(k, None, entries=300, words=1000, burst=50), 0
    rows = []
    for batch in counter.read("en", pa.array(own)):
        most = max(most, sum(t.entries for t in counter.tries.values()))
        rows.append(batch)
    most = max(most, sum(t.entries for t in counter.tries.values()))
    rows += list(counter.rest())
    got = Counter()
    for batch in rows:
        for r in batch.to_pylist():
            got[f"{r['prefix']} {r['last']}" if k > 1 else r["last"]] += r["n"]
    expected = Counter()
    for text in own:
        w = text.strip(".").split()
        expected.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert got == expected
    assert max(b.num_rows for b in rows) <= 64 and most <= 300 + 64


def test_marks(spark):
    held = [("en", f"w{i} x{i}") for i in range(3000)]
    marks = phrases.marks_of(spark.createDataFrame(held, "lang string, phrase string"))
    def asked(rows):
        return marks.has(phrases.mixed([np.array([phrases.word_hash(l, p.split()[i].encode()) for l, p in rows], np.uint64) for i in (0, 1)]))

    assert asked(held).all()
    assert asked([("de", p) for _, p in held]).mean() < 0.2 and asked([("en", f"x{i} w{i}") for i in range(3000)]).mean() < 0.2
