"""The registered queries over whole small tables: against their SQL, or a plain restatement."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from turnera.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SMALL)
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    expected = sorted((tuple(map(dict(zip(names, row)).get, frame.columns)) for row in answer.fetchall()), key=repr)
    assert sorted(map(tuple, frame.collect()), key=repr) == expected


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries._vocabulary("byte_bpe_50k.json"))
    for r in queries.op1_token_counts(spark, SMALL).collect():
        tokens = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), tokens, tokens > 1024)


def test_shards(spark, texts):
    rows = queries.op3_sharding(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_sentencepiece(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries._vocabulary("piece_bpe_32k.model"))
    for r in queries.op4_sentencepiece(spark, SMALL).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.round_trip


def test_lm_scores(spark, texts):
    def tokens(text):
        return [w for w in re.split(b"[\x20\x09-\x0d]+", text.encode().lower()) if w] + [None]

    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, t in texts.items() if not out[d] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = queries.op8_lm_scores(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def simhash(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, differing=3):
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[a] < group[b] and (prints[a] ^ prints[b]).bit_count() <= differing:
                    group[b], changed = group[a], True
    return group


def test_simhash(spark, texts):
    prints = {d: simhash(t) for d, t in texts.items()}
    group = reachable(prints)
    rows = queries.op9_simhash(spark, SMALL).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {d: (prints[d], group[d]) for d in texts}
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows) and any(group[d] != d for d in texts)


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    rows = queries.op6_quality(spark, SMALL).collect()
    wrong = [r.doc_id for r in rows if r.doc_id in labels and r.keep != (labels[r.doc_id] == 1)]
    assert len(wrong) <= 0.02 * len(labels)


def test_licenses_are_found_where_they_are(spark, texts):
    rows = {r.doc_id: r for r in queries.op7_licenses(spark, SMALL).collect()}
    words = {"CC BY-NC": "CC BY-NC 4.0", "GPL": "GNU General Public", "Apache": "Apache License", "MIT": "MIT License"}
    for d, text in texts.items():
        expected = sorted(f for f, w in words.items() if w in text)
        assert rows[d].families == ",".join(expected) and rows[d].n_paragraphs == sum(bool(x.strip()) for x in text.split("\n"))


def test_url_verdicts(spark):
    pages = {r["page_id"]: r["url"] for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    rows = queries.op10_url_filter(spark, SMALL).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        rest = pages[r.page_id].partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(t), t, v) for t, v in queries.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")
