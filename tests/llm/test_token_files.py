"""Token files: the coding, the encoder against the library, round trips, damage."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from turnera.llm import queries, token_files

VOCABULARY = queries._vocabulary("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_coding(ranks):
    control, data = token_files.packed(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, -(-r.bit_length() // 8)) for r in ranks)
    assert token_files.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks


PARTS = ["it's", "İstanbul", "T̈", "̈", "Σας", "ǅ", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>B", "12a3", "--", "ñ", "ñ", "\x00", "\x1c", "\x85", " ", " x", "'S", "½", "𝔄", "<", "|>", "X" * 300]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4), st.sampled_from([" ", "\t", "\n", "\r", "\x0b", "\x0c", "  "])), max_size=12).map("".join), max_size=5))
def test_encoder_is_the_library(listed):
    encode = test_encoder_is_the_library.__dict__.setdefault("held", token_files.Encoder(open(VOCABULARY, encoding="utf-8").read(), 2))
    assert encode.by_units
    ids, n = encode(pa.array(listed, pa.string()))
    expected = [e.ids + [2] for e in library().encode_batch(listed, add_special_tokens=False)]
    assert n.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def brute(rows):
    coder, start, found = library(), 0, []
    for key, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [2]
        found.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op12_token_files(spark, SMALL).collect())) == brute(docs)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 3)
    rows = [(None, "no key"), (None, None), (-5, ""), (3, None), (4, "four"), (7, "repeated row"), (7, "repeated row"), (8, "long " * 5000)] + [(9, f"hot key {i}") for i in range(400)]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start int, ids string").repartition(5)
    path = str(tmp_path / "set")
    token_files.write(token_files.encoded(frame, VOCABULARY, end=2), path, files=4)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    digests = sorted(token_files.read_digests(spark, path).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    start = 0
    for r, d in zip(got, digests):
        assert (r.start, r.n_tokens) == (start, len(r.ids)) == (d.start, d.n_tokens) and d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    coder = library()
    expected = sorted((repr(k), coder.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == expected
    files = spark.read.format("binaryFile").load(f"{path}/ids").count()
    assert files > 4  # several files a part
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    counts = np.bincount([i for r in got for i in r.ids])
    assert [counts[i] for i in ranks] == sorted((c for c in counts if c), reverse=True)


def test_empty_table_and_whole_texts(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "none")
    token_files.write(token_files.encoded(frame, VOCABULARY, end=2), path)
    assert token_files.read_ids(spark, path).collect() == []
    other = queries._vocabulary("byte_bpe_50k.json")  # keeps white space, so texts are encoded whole
    frame = spark.createDataFrame([(1, "two  words\n"), (2, None)], "doc_id long, text string")
    token_files.write(token_files.encoded(frame, other, end=50256), str(tmp_path / "bytes"))
    from tokenizers import Tokenizer

    rows = token_files.read_ids(spark, str(tmp_path / "bytes")).orderBy("start").collect()
    assert [r.ids for r in rows] == [Tokenizer.from_file(other).encode("two  words\n").ids + [50256], [50256]]


def test_damage_is_told():
    ranks = np.arange(100, dtype=np.uint32)
    block = bytearray(token_files._block(0, 0, 0, [1], [ranks], ranks) + token_files.END_OF_BLOCK.encode())
    assert [r[-1].tolist() for r in token_files._blocks(memoryview(bytes(block)))] == [ranks.tolist()]
    block[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files._blocks(memoryview(bytes(block))))
