"""Benchmark decontamination: windows of test items looked up in training documents.

The items' word windows form a hash set that is broadcast; every document's word windows are
scanned against it, a hash that matches is verified word by word, and documents, or just the
spans of the windows found, are removed.

The set is held in blocks of bounded size: items are dealt into as many blocks as their bytes
ask for, and a document is scanned once for each block, its spans so far passed along in the
row, so that neither driver nor worker ever holds more than one block's windows at a time
and a benchmark of any size is searched whole.

Words: A-Z lower-cased; runs of letters and digits of ASCII and of any other characters.  A
window is ``size`` consecutive words of an item; an item of fewer words, but not none, is
one window.  Null texts have no words; an item without an id marks words but is not listed;
repeated items are one.  An empty benchmark finds nothing.
"""

import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import adding, ready, require, stored_at, tables_of, text_of, without
from turnera.session import remove_folder

#: UTF-8 bytes of benchmark text in one block, on average.
BLOCK_BYTES = 4 << 20

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FACTOR = 0x9E3779B97F4A7C15

FOUND = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Windows(NamedTuple):
    """One block: word numbers, and by window length the sorted hashes and the exact windows."""

    words: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    items: dict[bytes, list[str]]


def _rolling(numbers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` numbers that begin at ``at``."""
    hashes = np.zeros(len(at), np.uint64)
    for i in range(length):
        hashes = (hashes + numbers[at + i].astype(np.uint64)) * np.uint64(_FACTOR)
    return hashes


def build(items: list[tuple[str | None, str]], size: int) -> Windows:
    words: dict[bytes, int] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    exact: dict[bytes, set[str]] = {}
    for item, text in items:
        own = words_of(text)
        if not own:
            continue
        numbers = np.array([words.setdefault(w, len(words) + 1) for w in own], np.int32)
        length = min(size, len(own))
        starts = np.arange(len(own) - length + 1)
        hashes.setdefault(length, []).append(_rolling(numbers, starts, length))
        for i in starts:
            exact.setdefault(numbers[i : i + length].tobytes(), set()).update([item] if item is not None else [])
    return Windows(words, {n: np.unique(np.concatenate(h)) for n, h in hashes.items()}, {w: sorted(i) for w, i in exact.items()})


def scan(text: str, windows: Windows) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged spans of hit words (from, to), items found."""
    words = words_of(text)
    numbers = np.fromiter(map(windows.words.get, words, repeat(0)), np.int32, len(words))
    foreign = np.concatenate([[0], np.cumsum(numbers == 0)])
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for length, hashes in windows.hashes.items():
        starts = np.flatnonzero(foreign[length:] == foreign[:-length]) if len(words) >= length else np.zeros(0, int)
        if len(starts):
            own = _rolling(numbers, starts, length)
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            starts = starts[hashes[place] == own]
        for i in starts.tolist():
            held = windows.items.get(numbers[i : i + length].tobytes())  # the same words, not only the same hash
            if held is not None:
                spans.append((i, i + length))
                items.update(held)
    return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((start, stop))
    return joined


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), text_of(text).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // BLOCK_BYTES))
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b) for b in range(count)]


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``n_words``, ``spans`` (hit words as from, to, from, to, ...) and ``items`` to every row."""
    require(docs, text)
    require(benchmark, item, item_text)
    spark = docs.sparkSession
    ready(spark)
    none = F.lit(None)
    frame = adding(docs, {"_found": F.struct(none.cast("bigint").alias("n_words"), none.cast("array<bigint>").alias("spans"), none.cast("array<string>").alias("items"))})
    blocks, folder = _blocks(benchmark, item, item_text), f"{tables_of(spark)}/{uuid.uuid4().hex}"
    for number, block in enumerate(blocks):
        if number:  # one table at a time: rows with what the blocks so far have found
            frame = stored_at(frame, f"{folder}/{number}")
            if number > 1:
                remove_folder(spark, f"{folder}/{number - 1}")
        # At most one block: BLOCK_BYTES of text on average.
        windows = build([(r["item"], r["text"]) for r in block.collect()], size)
        frame = adding(frame, {"_found": _scanner(spark.sparkContext.broadcast(windows))(text_of(text), "_found.spans", "_found.items")})
    return adding(without(frame, "n_words", "spans", "items"), {n: F.col(f"_found.{n}") for n in ("n_words", "spans", "items")}).drop("_found")


def _scanner(shared):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(FOUND)
    def scanned(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = shared.value
        for texts, before, known in batches:
            rows = []
            for text, spans, items in zip(texts, before, known):
                n, found, names = scan(text.as_py(), windows)
                if spans.is_valid and len(spans):
                    flat = spans.as_py()
                    found = merged(found + list(zip(flat[::2], flat[1::2])))
                if items.is_valid:
                    names |= set(items.as_py())
                rows.append({"n_words": n, "spans": [x for s in found for x in s], "items": sorted(names)})
            yield pa.array(rows, kind)

    return scanned


def without_spans(text: str, spans: list[int]) -> str:
    """The text without the characters from the first to the last of each span's words."""
    if not spans:
        return text
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, stop in zip(spans[::2], spans[1::2]):
        kept.append(text[at : words[start][0]])
        at = words[stop - 1][1]
    return "".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = 10, text: str = "text", **names: str) -> DataFrame:
    """Rows without benchmark passages, columns as they were.

    ``remove="documents"`` drops every row with a hit; ``"spans"`` cuts the passages out and
    keeps the rows (cut and scan again until nothing is hit, if seams must be clean too).
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    columns = docs.columns
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns)).alias("_row"), text_of(text).alias("_text"))
    found = with_hits(held, benchmark, size, "_text", **names)
    if remove == "documents":
        return found.filter(F.size("spans") == 0).select("_row.*")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_spans(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    shorter = F.when(F.size("spans") == 0, F.col(f"_row.`{text}`")).otherwise(cut("_text", "spans"))
    return found.select(*(shorter.alias(c) if c.lower() == text.lower() else F.col(f"_row.`{c}`") for c in columns))
