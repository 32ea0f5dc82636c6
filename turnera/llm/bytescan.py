"""Texts of an Arrow batch as one byte array: what the operators on words share."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer text is scanned alone.
PORTION = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(classes: dict[int, int]) -> np.ndarray:
    """Lookup table of byte classes, 0 where none is given."""
    found = np.zeros(256, np.uint8)
    for byte, kind in classes.items():
        found[byte] = kind
    return found


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and the offsets between them; no text may be null."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[pa.Array]:
    """A batch in slices of whole texts, of about ``size`` bytes each."""
    _, offsets = joined(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def collected(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            whole, held, total = pa.Table.from_batches(held).combine_chunks(), [], 0  # the parts go before the whole is read
            yield from whole.to_batches()
            del whole
    if held:
        whole, held = pa.Table.from_batches(held).combine_chunks(), []
        yield from whole.to_batches()


def begins(solid: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a run of ``solid`` bytes begins; no run goes on into the next text."""
    found = solid.copy()
    found[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(solid)]
    found[edges] = solid[edges]
    return found


def cut(data: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """The solid bytes from each of ``starts`` up to the next as binary values; only other bytes lie between them."""
    packed = data[solid]
    places = np.cumsum(solid, dtype=np.int32)[starts] - 1 if len(starts) else np.zeros(0, np.int32)
    at = np.append(places, len(packed)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])
