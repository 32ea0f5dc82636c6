"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the methods' inner parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import reachable, simhash as plain_simhash
from turnera.llm import (
    decontamination, license_scan, lm_scoring, quality, queries, recurrent, sentencepiece_codec, sharding, simhash, token_counts, topk, url_filter,
)
from turnera.llm.components import components

LONG = "una frase que se repite, word by word. " * 3000
ROWS = [(1, "Hello  World", "a", "x"), (1, "Hello  World", "a", "x"), (2, None, None, None), (None, "null id ~ ñandú", "b", "x"), (3, "", "a", None), (4, " \n\t ", "b", "y"), (5, LONG, "a", "x")]
CLASHES = ("N_TOKENS", "IDS", "_found", "_row", "_text", "salt", "shard", "component_id", "Keep", "notices", "verdict", "host", "fingerprint", "_key", "spans", "score", "_scan")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries._vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = token_counts.with_token_counts(docs, path).collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in ROWS]
    assert token_counts.with_token_counts(empty, path).count() == 0
    proof = token_counts.prove(path)
    counts = token_counts.Counts(proof)
    random = np.random.default_rng(3)
    pieces = [chr(c) for c in [*range(0x250), 0x558, 0x88F, 0x2028, 0x3000, 0x4E00, 0x1F917]] + ["<|endoftext|>", "'s", "  ", " the", *proof.whole[:300]]
    for _ in range(300):
        text = "".join(random.choice(pieces, 40))
        assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert set(proof.foreign) and all(len(library.encode(w).ids) == 1 for w in proof.whole[::97])


@pytest.mark.parametrize("block_bytes", [1 << 22, 40])
def test_decontamination(spark, docs, empty, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    items = [("i1", "hello world"), ("i1", "hello world"), (None, "frase que"), ("i2", ""), ("i3", None), ("i4", "a b c d e f g h i j k"), ("i5", "Que se repite WORD BY word una frase que se")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = sorted(decontamination.with_hits(docs, bench).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r["items"]) for r in rows[:6]] == [(None, 3, []), *[(1, 2, ["i1"])] * 2, (2, 0, []), (3, 0, []), (4, 0, [])]
    assert rows[6]["items"] == ["i5"] and rows[6].n_words == 24000
    assert sum(b - a for a, b in zip(rows[6].spans[::2], rows[6].spans[1::2])) == 24000 - 1 - 4  # first and last of the cycle
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4]
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(docs, bench, remove="spans").collect()}
    assert cut[1] == "" and cut[None] == "null id ~ ñandú" and cut[2] is None
    assert decontamination.with_hits(empty, bench).count() == 0 and decontamination.decontaminated(docs, bench.limit(0)).count() == 7


def test_sharding(spark, docs, empty):
    rows = sharding.interleaved(docs, shards=3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert {r["size"] for r in rows if r.doc_id == 2} == {8}
    assert sharding.interleaved(empty).count() == 0
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    placed = sharding.interleaved(many, shards=10).join(many, "doc_id").groupBy("source", "shard").count()
    assert {r.source: r.d for r in placed.groupBy("source").agg((F.max("count") - F.min("count")).alias("d")).collect() if r.d > 2} == {}


def unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [(p, -1.0 - i * 0.37, 1) for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "abb", "ba", "▁b"])]
    for text, score, kind in pieces:
        model.pieces.add(piece=text, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    return model.SerializeToString()


def test_sentencepiece(spark, docs, empty, monkeypatch):
    import sentencepiece

    path = queries._vocabulary("piece_bpe_32k.model")
    assert all(r.parity for r in sentencepiece_codec.with_parity(docs, path).select("parity").collect())
    coded = sentencepiece_codec.with_text(sentencepiece_codec.with_ids(docs, path), path).collect()
    assert [r.decoded for r in coded] == [t or "" for _, t, _, _ in ROWS]
    assert sentencepiece_codec.with_ids(empty, path).count() == 0
    odd = spark.createDataFrame([([415, None, -4, 99_999, 1, 415],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_codec.with_text(odd, path).collect()] == ["The The", "", ""]
    monkeypatch.setattr(sentencepiece_codec, "KEPT", 40)
    random = np.random.default_rng(4)
    with open(path, "rb") as file:
        models = [file.read(), unigram_model()]
    for data in models:
        codec, library = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        for _ in range(300):
            text = "".join(random.choice(["a", "b", " ", "é", "▁", "the", "\n", "一", "\U0001f917"], 25))
            ids = np.frombuffer(codec.encode(text), np.int32).tolist()
            assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)
        assert codec.differing == 0
        noise = [random.integers(3, 259, 9).tolist() for _ in range(200)]
        assert [codec.decode(n) for n in noise] == [library.decode(n) for n in noise]


def test_top_k(spark):
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=6) * random.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25] * 6) for i in range(40)] + [(500, [0.25] * 6)] * 2 + [(600, None), (700, [1.0, None] * 3), (800, [float("nan")] * 6), (801, [float("inf")] * 6), (None, [1.0] * 6), (900, [1.0, 2.0]), (901, [2.0, 1.0]), (1000, []), (1100, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("piece", F.lit("clash"))
    whole = topk.whole_vectors(frame)
    found = topk.top_k(whole.filter("id % 100 = 0"), whole, k=10).collect()
    held = [(i, [math_floor(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for query, vector in {i: v for i, v in held if i % 100 == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(vector, v)), i) for i, v in held if i != query and len(v) == len(vector)))[:10]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query)
        assert own == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], query
    nothing = topk.whole_vectors(frame.limit(0))
    assert topk.top_k(nothing, nothing).count() == 0


def math_floor(x):
    return int(np.floor(1024 * float(x)))


@pytest.mark.parametrize("scale", [1, 2**30])
def test_pieces_are_searched_exactly_by_coordinate_and_by_length(scale):
    random = np.random.default_rng(6)
    vectors = np.rint(random.normal(size=(500, 8)) * 100) * scale
    queries_ = np.vstack([vectors[:20] + np.rint(random.normal(size=(20, 8)) * 3), np.zeros((1, 8))])
    ids, vec_ids = np.arange(21) + 1000, random.permutation(500)
    scores = [[sum(int(a) * int(b) for a, b in zip(q, v)) for v in vectors] for q in queries_]
    for need in (-np.inf, 0.9):
        needs = np.array([-np.inf if need < 0 or scale > 1 else float(sorted(s)[-10]) * need for s in scores])
        found = topk.best_of_piece(ids, queries_, needs, vec_ids, vectors, 10)
        for q, own in enumerate(scores):
            held = [(min(2**63 - 1, max(-(2**63), s)), int(vec_ids[i])) for i, s in enumerate(own)]
            best = sorted((-s, v) for s, v in held if s >= needs[q])[:10]
            assert [(-s, v) for row, v, s in found if row == q] == best


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (5, 1), (4, 7), (9, 0)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.p_quality <= 1 and r.keep is not None for r in rows)
    assert quality.kept(docs, labels).columns == docs.columns
    assert quality.kept(docs, labels.limit(0)).count() == 7 and quality.scored(empty, labels).count() == 0


def test_sparse_sites_shrink_to_the_level_above(spark):
    rows = [("h1", "p1", 9.0)] * 50 + [("h2", "p1", -9.0)] * 50 + [("h2", "p2", 9.0)] + [("h3", "p1", 9.0)]
    sites = {(r._host, r._path): r for r in quality.site_rates(spark.createDataFrame(rows, "_host string, _path string, _odds double"), 0.5).collect()}
    assert sites["h1", "p1"].host_rate > 0.9 > sites["h3", "p1"].host_rate > 0.5 > sites["h2", "p2"].host_rate


def test_licenses(spark, docs, empty):
    lines = ["Licensed under CC BY 4.0.", "plain words here " * 60 + "Released under the MIT License. " + "and other words " * 60, "the licence of the driver, version 2, was free software for a person", ""]
    more = docs.unionByName(spark.createDataFrame([(10 + i, t, "a", "x") for i, t in enumerate(lines)], "doc_id long, text string, source string, lang string"), allowMissingColumns=True)
    found = {r.doc_id: [n.family for n in r.notices] for r in license_scan.with_notices(more).collect()}
    assert found[10] == ["CC BY"] and found[11] == ["MIT"] and found[12] == [] and found[13] == [] and found[2] == [] and found[5] == []
    assert license_scan.with_notices(empty).count() == 0


def test_lm(spark, docs, empty):
    rows = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1 and rows[5].n_tokens == 24001
    assert lm_scoring.scored(docs).count() == 7 and lm_scoring.scored(empty).count() == 0
    none = lm_scoring.scored(docs.filter("doc_id = 2").limit(0).unionByName(docs.filter(lm_scoring.is_held_out(F.col("doc_id")))))
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none.collect())


def test_the_network_is_a_distribution_and_carries_its_state():
    random = np.random.default_rng(7)
    weights = recurrent.initial(np.sort(random.integers(1, 99, recurrent.FREQUENT))[::-1], random.integers(1, 99, recurrent.RARE))
    for name, shape in recurrent.SHAPES.items():
        weights[name] = weights[name] + random.normal(0, 0.3, shape).astype(np.float32)
    every = np.arange(recurrent.FREQUENT + recurrent.RARE)
    state = np.repeat(random.normal(size=(1, recurrent.HIDDEN)).astype(np.float32), len(every), axis=0)
    assert np.exp(recurrent.log_probabilities(weights, state, every)).sum() == pytest.approx(1, abs=1e-4)
    texts = [random.integers(0, len(every), n).astype(np.int32) for n in (0, 1, 31, 32, 33, 400, 5)]
    for text, log in zip(texts, recurrent.score(weights, texts, 0, most_lanes=3)):
        state, total = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
        for before, after in zip([0, *text[:-1]], text):
            state, _ = recurrent._advance(weights, weights["inputs"][[before]], state)
            total += recurrent.log_probabilities(weights, state, np.array([after]))[0]
        assert log == pytest.approx(total, rel=1e-4)


def test_gradients():
    random = np.random.default_rng(8)
    weights = recurrent.initial(np.arange(recurrent.FREQUENT, 0, -1), np.ones(recurrent.RARE))
    for name in ("inputs", "recur", "class_w", "word_w"):
        weights[name] = random.normal(0, 0.2, weights[name].shape).astype(np.float32)
    inputs, targets = random.integers(0, 2112, (8, 4)), random.integers(0, 2112, (8, 4))
    seen = {}

    class Watched(recurrent.Trainer):
        def _step(self, name, grad, at):
            seen[name] = np.zeros(self.weights[name].shape)
            seen[name][at] = grad

    carried = np.ones((8, 4), np.float32)
    carried[3, 1] = carried[5, 2] = 0  # documents that begin inside a piece
    Watched(weights)._piece(inputs, targets, np.ones((8, 4), bool), carried, np.zeros((4, recurrent.HIDDEN), np.float32))
    precise = {n: w.astype(float) for n, w in weights.items()}

    def loss(own):
        state, total = np.zeros((4, recurrent.HIDDEN)), 0.0
        for x, y, stays in zip(inputs, targets, carried):
            state, _ = recurrent._advance(own, own["inputs"][x], state * stays[:, None])
            total -= recurrent.log_probabilities(own, state, y).sum()
        return total / inputs.size

    for name in weights:
        at = np.unravel_index(np.abs(seen[name]).argmax(), weights[name].shape)
        up, down = ({n: w.copy() for n, w in precise.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert seen[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=1e-3)


@pytest.mark.parametrize("few", [1024, 2])
def test_simhash(spark, docs, empty, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rows = simhash.groups(docs).collect()
    own = {r.doc_id: r for r in rows}
    assert own[2].fingerprint == own[3].fingerprint == own[4].fingerprint == "0" * 16 and own[4].component_id == 2
    assert int(own[5].fingerprint, 16) == plain_simhash(LONG) and sum(r.component_id == 1 for r in rows) == 2
    assert simhash.groups(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5]
    random = np.random.default_rng(9)
    centre = int(random.integers(0, 2**63))
    prints = {i: centre ^ sum(1 << int(b) for b in set(random.integers(0, 64, random.integers(0, 5)))) for i in range(60)}
    prints |= {i: int(random.integers(0, 2**63)) for i in range(60, 80)}
    frame = spark.createDataFrame([(i, simhash._signed(p)) for i, p in prints.items()], "_key long, fingerprint long").checkpoint()
    expected = reachable(prints)
    assert {r._key: r.component_id for r in simhash.with_components(frame).collect()} == expected


def test_rows_with_one_null_id_keep_one_each(spark):
    rows = [(None, "same words in all of these")] * 3 + [(None, "something else entirely, and longer")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicated(frame).count() == 2


def test_components_of_a_long_chain(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(41)}


def test_url_filter(spark):
    rules = [("good.org/", "allow"), ("bad.org/", "block"), ("bad.org/ok", "allow")]
    rows = [
        (1, "http://good.org/a", '<a href="http://friend.net/x">'), (2, "https://FRIEND.net", "<a HREF='//other.net'>"), (3, "http://spam.net/?q", '<a href="http://bad.org/">'),
        (4, "http://bad.org/x#f", None), (5, "http://bad.org/okay", ""), (6, None, '<a href="http://bad.org/">'), (7, "no scheme/x", ""), (8, "http://sub.bad.org/y", "<a href='/rel'>"), (8, "http://sub.bad.org/y", ""),
        (9, "http://other.net/", ""), (10, "http://lonely.net/p/q?z=http://bad.org", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("HOST", F.lit("clash")).withColumn("_salt", F.lit("clash"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages.drop("_salt"), rules).collect()}
    assert found == {
        1: ("good.org", "/a", "good.org/", "allow"), 2: ("friend.net", "", None, "allow"), 3: ("spam.net", "", None, "block"), 4: ("bad.org", "/x", "bad.org/", "block"),
        5: ("bad.org", "/okay", "bad.org/ok", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("sub.bad.org", "/y", "bad.org/", "block"),
        9: ("other.net", "/", None, "allow"), 10: ("lonely.net", "/p/q", None, "allow"),
    } | {3: ("spam.net", "/", None, "block")}
    assert url_filter.judged(pages, rules).count() == 11 and url_filter.judged(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("rounds,close", [(8, 1e-6), (None, 1e-3)])
def test_ranks_equal_a_plain_power_iteration(spark, rounds, close):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")]
    seeds = {"a": 3.0, "d": 1.0}
    ranks = start = {h: w / 4 for h, w in seeds.items()}
    for _ in range(rounds or 200):
        following = {h: 0.15 * start.get(h, 0) for h in "abcd"}
        for src, dst in links:
            following[dst] += 0.85 * ranks.get(src, 0) / sum(s == src for s, _ in links)
        ranks = following
    found = url_filter.spread(
        spark.createDataFrame([("trust", h, w) for h, w in seeds.items()], "kind string, host string, weight double"),
        spark.createDataFrame([("trust", *x) for x in links], "kind string, src string, dst string"), rounds=rounds,
    ).collect()
    assert {r.host: pytest.approx(r["rank"], rel=close) for r in found} == {h: r for h, r in ranks.items() if r}


def test_distrust_reaches_far_hosts_and_faint_ones(spark):
    rules = [("bad.org/", "block")]
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">' if i < 19 else '<a href="http://bad.org/">') for i in range(20)]
    # One seed page links come from among a million, spread over 60 hosts and again over 60.
    hub = [(100, "http://bad.org/", None)] + [(200 + i, f"http://mid{i}.net/", '<a href="http://bad.org/">') for i in range(60)]
    hub += [(300 + i, f"http://far{i}.net/", "".join(f'<a href="http://mid{j}.net/">' for j in range(60))) for i in range(60)]
    pages = spark.createDataFrame(chain + hub, "page_id long, url string, html string")
    many = spark.range(1_000_000).select((F.col("id") + 1000).alias("page_id"), F.lit("http://x.bad.org/").alias("url"), F.lit(None).cast("string").alias("html"))
    found = {r.page_id: r.verdict for r in url_filter.judged(pages.union(many), rules).filter("page_id < 1000").collect()}
    assert set(found.values()) == {"block"} and len(found) == 141
    links = spark.createDataFrame([("distrust", "s", f"m{i}") for i in range(500)] + [("distrust", f"m{i}", "end") for i in range(500)], "kind string, src string, dst string")
    seeds = spark.createDataFrame([("distrust", "s", 1.0), ("distrust", "t", 1e15)], "kind string, host string, weight double")
    ranks = {r.host: r["rank"] for r in url_filter.spread(seeds, links, rounds=None).collect()}
    assert ranks["end"] == pytest.approx(0.15 * 0.85**2 * 1e-15) and ranks["m7"] == pytest.approx(0.15 * 0.85 * 1e-15 / 500)


def test_lm_scores_do_not_depend_on_partitions(spark):
    from turnera.llm import lm_scoring

    words = "the of and to in is that for it as was with on by at from".split()
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 3)) % len(words)] for j in range(120))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({r.doc_id: r.asDict() for r in lm_scoring.scored(frame.repartition(n), learner_words=3000).collect()} for n in (1, 9))
    assert all(abs(few[d]["score"] - many[d]["score"]) < 1e-3 for d in few)
    out = [r for r in few.values() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out) > 0.05


def test_every_row_is_written_to_a_shard_once(spark, tmp_path):
    rows = [(1, "a", "s", 9, "x"), (1, "a", "s", 9, "x"), (1, "b", "s", 9, "y"), (None, None, None, 9, "z"), (None, None, "s", 9, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, Shard int, _key string")
    sharding.write_shards(frame, str(tmp_path / "shards"), shards=2)
    written = spark.read.parquet(str(tmp_path / "shards"))
    got = [(r.doc_id, r.text, r.source, r["_key"]) for r in written.collect()]
    assert sorted(got, key=repr) == sorted(((d, t, s, k) for d, t, s, _, k in rows), key=repr)
    assert {r["shard"] for r in written.select("shard").collect()} == {0, 1}


def test_first_rows_with_any_column_names(spark):
    rows = [(1, "same words", 5, 6), (1, "same words", 5, 6), (2, "same words", 7, 8), (3, "other", 9, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _again long")
    frame = frame.withColumns({"_Gone_digest": F.lit(1), "_d": F.lit(2), "_again_digest": F.lit(3)})
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r["_gone"], r["_again"], r["_d"]) for r in kept.collect()) == [(1, 5, 6, 2), (3, 9, 9, 2)]
