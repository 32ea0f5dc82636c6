"""Licence notices: planted in running text and wrapped, mentioned only, and against a plain restatement."""

import random
import textwrap

import numpy as np
import pytest

from tests.conftest import SMALL
from turnera.llm import license_scan as ls


@pytest.fixture(scope="module")
def lines(spark):
    return ls.sampled_paragraphs(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", "text")


@pytest.fixture(scope="module")
def model(lines):
    return ls.train(lines)


def found(text, model):
    return [(n["family"], n["line"]) for n in ls.scan([text], model)[0][1]]


@pytest.mark.parametrize("width", [30, 72, None])
def test_every_family_is_found_in_running_text(model, lines, width):
    words = [w for line in lines for w in ls.words_of(line)]
    draw = random.Random(3)
    missed, wrong, planted = [], [], 0
    for family, templates in ls.TEMPLATES.items():
        for template in templates:
            before, after = (" ".join(draw.choice(words) for _ in range(draw.randrange(20, 200))) for _ in range(2))
            text = f"{before}. {template} {after}"
            families = {f for f, _ in found("\n".join(textwrap.wrap(text, width)) if width else text, model)}
            planted += 1
            missed += [template] if family not in families else []
            wrong += [(template, families)] if families - {family} else []
    assert not wrong and len(missed) <= 0.02 * planted


def test_a_notice_is_told_at_its_line(model):
    text = "first block\n\n\nplain words before it. Released under the\nMIT License. More text follows.\n\nLicensed under CC BY 4.0."
    assert found(text, model) == [("MIT", 3), ("CC BY", 6)]
    assert [n["paragraph"] for n in ls.scan([text], model)[0][1]] == [1, 2] and ls.scan([text], model)[0][0] == 3
    both = "Licensed under the Apache License, Version 2.0. " + "other words " * 30 + "Released under the MIT License."
    assert {f for f, _ in found(both, model)} == {"Apache", "MIT"}


def test_what_only_speaks_of_licences_is_none(model):
    for text in (
        "We do not accept code under the GPL; the MIT License discussion below is only history.",
        "the licence of the driver, version 2, was free software for a person",
        "the general public may use the library under the terms of the contract", "", "\n \n",
    ):
        assert found(text, model) == [], text


def test_held_out_lines_of_the_corpus_stay_unknown(spark, model, lines):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    telling = {r.doc_id for r in ls.with_notices(docs).filter("size(notices) > 0").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all("licen" in texts[d].lower() or "rights" in texts[d].lower() for d in telling)


def plain_scan(text, model):
    """The scan without prefix sums, moving counts or batches."""
    gram = {int(k): i for i, k in enumerate(model.keys)}
    base, results, block = len(model.words), [], []
    blocks = []
    for number, line in enumerate([*text.split("\n"), ""]):
        if line.strip():
            block.append((number, ls.words_of(line)))
        elif block:
            blocks.append(block)
            block = []
    for at, block in enumerate(blocks):
        own, line_of, places = [], [], set()
        for number, words in block:
            places |= {(len(own) + a, len(own) + b) for a, b in ls._windows(len(words)) if words}
            own += words
            line_of += [number] * len(words)
        places |= set(ls._windows(len(own))) if own else set()
        told = {}
        for a, b in places:
            ids = [model.words.get(w, -1) for w in own[a:b]]
            logits = np.zeros(ls.UNKNOWN + 1)
            for n, shift in ((1, 0), (2, base), (3, base + base * base)):
                for i in range(len(ids) - n + 1):
                    if min(ids[i : i + n]) >= 0:
                        code = 0
                        for one in ids[i : i + n]:
                            code = code * base + one
                        if shift + code in gram:
                            logits += model.weights[gram[shift + code]]
            logits = logits / np.sqrt(b - a) + np.array([1, sum(i < 0 for i in ids) / (b - a), 1 / np.sqrt(b - a)]) @ model.dense
            logits /= model.temperature
            logits[ls.UNKNOWN] += model.offset
            chances = np.exp(logits - logits.max())
            chances /= chances.sum()
            first = max(0, a - ls.WINDOW)
            near = own[first : b + ls.WINDOW]
            have = list(zip(near, near[1:]))
            for number, (family, pairs) in enumerate(model.pairs):
                if chances[family] <= chances[ls.UNKNOWN] or not any(p in pairs for p in have):
                    continue
                reach, best = len(pairs) + len(pairs) // 2 + 2, (0, 0, 0)
                for stop in range(len(have)):
                    span = [i for i in range(max(0, stop - reach), stop + 1) if have[i] in pairs]
                    if have[stop] in pairs and len({have[i] for i in span}) > best[0]:
                        best = (len({have[i] for i in span}), span[0], stop + 2)
                share = best[0] / len(pairs)
                inside = len({p for p in have if p in pairs}) / len(set(have))
                if share < (0.8 if len(pairs) <= 8 else 0.6):
                    if len(own) > ls.WINDOW or len(near) < 4 or inside < 0.8:
                        continue
                    share = best[0] / len(set(have))
                key = (number, first + best[1])
                if key not in told or told[key][0] < chances[family]:
                    told[key] = (chances[family], best[0], family, first + best[1], first + best[2], share)
        kept = []
        for one in sorted(told.values(), key=lambda t: (-t[1], -t[0], t[2], t[3])):
            if all(one[4] <= k[3] or k[4] <= one[3] for k in kept):
                kept.append(one)
        results += [(at, line_of[k[3]], ls.FAMILIES[k[2]], k[5], k[0]) for k in sorted(kept, key=lambda k: k[3])]
    return len(blocks), results


def test_scan_against_its_plain_restatement(spark, model):
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    telling = [t for t in texts if "icens" in t or "GNU" in t][:25]
    draw = random.Random(9)
    every = [t for templates in ls.TEMPLATES.values() for t in templates]
    mixed = ["\n".join(textwrap.wrap(" ".join(draw.sample(every, 4)), draw.choice([20, 40, 80]))) for _ in range(12)]
    held = telling + texts[:25] + mixed + ["", "\n\n", "MIT License", "the General Public License"]
    for text, (n, notices) in zip(held, ls.scan(held, model)):
        plain_n, plain = plain_scan(text, model)
        assert n == plain_n and [(x["paragraph"], x["line"], x["family"]) for x in notices] == [p[:3] for p in plain]
        assert [x["similarity"] for x in notices] == pytest.approx([p[3] for p in plain])
        assert [x["probability"] for x in notices] == pytest.approx([p[4] for p in plain], abs=1e-6)
