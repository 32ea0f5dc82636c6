"""The audit against plain counting, sorted pointers against a plain sort."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnera.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least, best=10):
    holding, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = terms_of(text)
        holding[lang or ""].update(set(own))
        counts[lang or "", source or ""].update(own)
    found = []
    for lang in holding:
        kept = {t for t, n in holding[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (l, s), c in counts.items() if l == lang}
        whole = Counter()
        for g in groups.values():
            whole.update(g)

        def share(group, term):
            return 1 + 10**9 * (group.get(term, 0) + 2) // (sum(group.values()) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for s, g in groups.items():
            pairs = [(-sum(apart(share(g, t), share(o, t)) for t in kept), x.encode()) for x, o in groups.items() if x != s]
            own = [(-apart(share(g, t), share(whole, t)), t.encode()) for t in g if share(g, t) > share(whole, t)]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(own)[:best])):
                found += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(listed, 1)]
    return sorted(found)


@pytest.mark.parametrize("cells,pairs", [(1 << 18, 1 << 20), (64, 4)])
def test_against_counts(spark, monkeypatch, cells, pairs):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "PAIRS", pairs)
    random = np.random.default_rng(2)
    words = [f"{'ab' * (i % 9)}{chr(97 + i % 26)}{'é' * (i % 3)}" for i in range(60)]
    rows = [(["en", "de", None][i % 3], f"s{random.integers(0, 6)}" if i % 7 else None, " ".join(words[int(j)] for j in random.integers(0, 60, 30) // (1 + i % 4))) for i in range(150)]
    rows += [("xx", "a", None), ("xx", "b", ""), ("xx", None, "1 2 3"), ("yy", "alone", "term " * 20), ("en", "bare", "..."), ("", "", "Und UND und")] + rows[:4]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "lang string, source string, text string, term string, n int")
    assert sorted(map(tuple, source_audit.divergences(frame, least=4).collect())) == brute(rows, 4)


def test_empty_table(spark):
    assert source_audit.divergences(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB é1 \n"), max_size=60), min_size=1, max_size=8), st.integers(0, 3))
def test_runs(listed, times):
    listed = listed + ["prefixprefixprefix prefixprefix prefix " * times, "x" * 40 * times]
    terms, n, holding = source_audit.runs_of(pa.array(listed))
    expected = Counter(t for text in listed for t in terms_of(text))
    documents = Counter(t for text in listed for t in set(terms_of(text)))
    assert terms.to_pylist() == sorted(expected, key=str.encode)
    assert dict(zip(terms.to_pylist(), n.tolist())) == expected and dict(zip(terms.to_pylist(), holding.tolist())) == documents
