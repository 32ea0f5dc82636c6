"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; it is parsed here, field by field, and rebuilt: the normaliser
(identity models; spaces become the metaspace mark and a mark is put in front), the pieces as
a unigram model with their scores or as merges ordered by score, and byte fallback for
characters without a piece.  Words are encoded in multithreaded batches, and every batch is
verified: the sentencepiece library encodes the same words, and where it should differ, its
ids are taken (none is known to).

Words can be encoded apart because no piece holds a mark behind another character (checked
when the model is read), so nothing merges across the end of a word.  Each distinct word is
encoded once per worker and kept, which bounds the memory a very long text needs.  A model
without that property is refused.

As texts are rows of independent words, parity word by word is parity of whole texts;
``with_parity`` compares whole texts as well.

Defined cases: a null text is the empty text, and that has no pieces.  Control pieces
(begin, end) are never produced and decode to nothing; their strings in a text are text.
Ids outside the vocabulary decode to nothing.  Repeated rows are encoded alike; other columns
pass through, and an input column named like an output is replaced.
"""

import codecs
import os
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import adding, ready, require, text_of

MARK = "▁"
#: Piece and model kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words in each of the two generations that a worker keeps, and words in one batch.
KEPT, BATCH = 200_000, 4096
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


# --- the model file -----------------------------------------------------------------


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: list[Piece]
    kind: int
    byte_fallback: bool
    dummy_prefix: bool
    squeeze: bool


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size, at = (_varint(data, at) if wire == 2 else ({1: 8, 5: 4}[wire], at))
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    """Fixed field numbers: model 1 pieces, 2 trainer, 3 normaliser; piece 1 text, 2 score, 3
    kind; trainer 3 kind, 24 marks behind words, 35 byte fallback; normaliser 2 map, 3 prefix,
    4 squeezing, 5 marks for spaces."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(Piece(own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    model = Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))
    if normaliser.get(2) or trainer.get(24) or not normaliser.get(5, 1):
        raise ValueError("only identity normalisers with a mark before each word are rebuilt")
    if model.kind not in (UNIGRAM, BPE) or any(p.kind in (USER, UNUSED) for p in pieces):
        raise ValueError("only unigram and merge models without user or unused pieces are rebuilt")
    if any(MARK in p.text.lstrip(MARK) for p in pieces if p.kind == NORMAL):
        raise ValueError("a piece crosses the end of a word")
    return model


# --- rebuilt with the tokenizers library ----------------------------------------------


def _merges(pieces: list[Piece]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece: best score first, as the file orders equal ones."""
    known = {p.text for p in pieces if p.kind == NORMAL}
    order = sorted((i for i, p in enumerate(pieces) if p.kind == NORMAL), key=lambda i: (-pieces[i].score, i))
    pairs = []
    for i in order:
        text = pieces[i].text
        pairs += [(text[:n], text[n:]) for n in range(1, len(text)) if text[:n] in known and text[n:] in known]
    return pairs


def rebuilt(model: Model):
    """The tokenizer of words, whose marks are set, and the normaliser that sets them."""
    from tokenizers import Tokenizer, models, normalizers

    unknown = next(i for i, p in enumerate(model.pieces) if p.kind == UNKNOWN)
    if model.kind == UNIGRAM:
        backend = models.Unigram([(p.text, p.score) for p in model.pieces], unknown, model.byte_fallback)
    else:
        vocabulary = {p.text: i for i, p in enumerate(model.pieces)}
        backend = models.BPE(
            vocabulary, _merges(model.pieces), unk_token=model.pieces[unknown].text, fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    words = Tokenizer(backend)
    marks = [normalizers.Replace(" ", MARK)]
    if model.dummy_prefix:
        marks.append(normalizers.Prepend(MARK))
    normaliser = normalizers.Sequence(marks)
    return words, normaliser


class Codec:
    """Encodes and decodes; one per worker process."""

    def __init__(self, data: bytes, threads: int = 1):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = parse(data)
        self.words, self.normaliser = rebuilt(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.differing = 0
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.written = [self._written(p) for p in self.model.pieces]

    def _written(self, piece: Piece) -> bytes:
        if piece.kind == BYTE:
            return bytes([int(piece.text[3:5], 16)])
        return b"" if piece.kind == CONTROL else piece.text.replace(MARK, " ").encode()

    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return self.normaliser.normalize_str(text) if text else ""

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers in a row."""
        if not text:
            return b""
        if self.model.dummy_prefix and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            words = text.split(" ")  # each stands for itself behind one mark
        else:
            words = [w[1:] if w[0] == MARK and self.model.dummy_prefix else MARK + w for w in _WORDS.findall(self.normalised(text))]
        fresh = set(words).difference(self.kept)
        if fresh:
            if len(self.kept) + len(fresh) > KEPT:  # words still in use come back from the generation before
                self.kept, self.before = {}, self.kept
                fresh = set(words)
            self.kept.update((w, self.before[w]) for w in fresh if w in self.before)
            self._learn(list(fresh.difference(self.kept)))
        return b"".join(map(self.kept.__getitem__, words))

    def _learn(self, keys: list[str]) -> None:
        """Encode distinct words; what the sentencepiece library gives differently is its."""
        front = MARK if self.model.dummy_prefix else ""
        for start in range(0, len(keys), BATCH):
            part = keys[start : start + BATCH]
            words = [front + k if front else k[1:] for k in part]
            found = self.words.encode_batch_fast(words, add_special_tokens=False)
            ids = [e.ids for e in found]
            if not self._agrees(part if front else words, ids):
                for i, key in enumerate(part):
                    if (key or not front) and (own := self.reference.encode(key if front else words[i])) != ids[i]:
                        ids[i], self.differing = own, self.differing + 1
            self.kept.update((key, array("i", i).tobytes()) for key, i in zip(part, ids))

    def _agrees(self, words: list[str], ids: list[list[int]]) -> bool:
        """Whether the sentencepiece library gives these ids for the words in one line."""
        if not self.model.dummy_prefix or any(not w or w[0] == MARK for w in words):
            return False
        return self.reference.encode(" ".join(words)) == [i for own in ids for i in own]

    def decode(self, ids: list[int]) -> str:
        """The text of ids that the vocabulary has."""
        text = b"".join(map(self.written.__getitem__, ids)).decode(errors="each-byte")
        marked = ids and self.model.pieces[ids[0]].text[:1] == MARK
        return text[1:] if self.model.dummy_prefix and marked else text


# Bytes that are no text become one replacement character each.
codecs.register_error("each-byte", lambda error: ("\ufffd", error.start + 1))


_workers: dict[int, tuple[bytes, Codec]] = {}


def _codec(data: bytes, threads: int) -> Codec:
    held = _workers.get(threads)
    if held is None or held[0] != data:
        held = _workers[threads] = (data, Codec(data, threads))
    return held[1]


# --- in Spark -------------------------------------------------------------------------


def _read(spark, model: str):
    with open(model, "rb") as file:
        data = file.read()
    parse(data)
    ready(spark)
    return spark.sparkContext.broadcast(data)  # the model file, a few megabytes whatever the texts


def with_ids(docs: DataFrame, model: str, text: str = "text", threads: int = 2, column: str = "ids") -> DataFrame:
    """Add the ids of every text as an array of ints; ``model`` is a file the driver can read."""
    require(docs, text)
    shared = _read(docs.sparkSession, model)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value, threads)
        for batch in batches:
            rows = [codec.encode(t.as_py()) for t in batch]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return adding(docs, {column: encoded(text_of(text))})


def _known(lists: pa.ListArray, size: int) -> Iterator[list[int]]:
    """Each row's ids without nulls and those beyond the vocabulary; a null row has none."""
    values = lists.values.fill_null(-1).to_numpy()
    offsets = lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    foreign = bool(len(values)) and bool(values.min() < 0 or values.max() >= size)
    for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = values[start:stop] if valid[row] else values[:0]
        yield (own[(own >= 0) & (own < size)] if foreign else own).tolist()


def with_text(rows: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; a null array decodes to the empty text."""
    require(rows, ids)
    shared = _read(rows.sparkSession, model)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value, 1)
        for batch in batches:
            yield pa.array((codec.decode(own) for own in _known(batch, len(codec.written))), pa.string(), size=len(batch))

    return adding(rows, {column: decoded(F.col(f"`{ids}`").cast("array<int>"))})


def with_parity(docs: DataFrame, model: str, text: str = "text", column: str = "parity") -> DataFrame:
    """Add whether the sentencepiece library, run on each whole text, gives the same ids."""
    shared = _read(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def same(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = _codec(shared.value, 1)
        for texts, ids in batches:
            yield pa.array((codec.reference.encode(t.as_py()) == i.as_py() for t, i in zip(texts, ids)), pa.bool_(), size=len(texts))

    held = with_ids(docs, model, text, column="_ids")
    return adding(held, {column: same(text_of(text), F.col("_ids"))}).drop("_ids")
