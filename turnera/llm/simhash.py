"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has a bit set where over half of a text's shingle hashes have it.  Two that
differ in at most three bits agree on three of six blocks, whichever bits differ, so every
pair shares one of twenty keys of about 32 bits; rows are joined on those keys and then
verified by Hamming distance.  Only distinct fingerprints take part: copies share one.

A key shared by very many fingerprints (near copies of one text) is refined: as the kept
blocks agree, the three bits can only differ in the rest, which is split into six again.
Such a finer key leaves sixteen bits free, so it can never hold more than 65,536
fingerprints.  Within a key no pairs are emitted but only the links of a spanning forest,
which loses no connection.  Components of those links are the groups.

Defined cases: a null or blank text has no shingles and fingerprint zero, which is linked
like any other.  Repeated rows share fingerprint and group.  A null id never is a group's
smallest one; a group of null ids alone has a null ``component_id``.
"""

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import ready, require, stored, text_of, unused
from turnera.llm.components import components

BITS = 64
#: Fixed value: the seed of the shingle hash.
SEED = 42
#: Fingerprints of one key that are compared without a finer key.
FEW = 1024
#: Shingle hashes held at once by a worker.
HELD = 1 << 19
SALTS = 16


# --- fingerprints -------------------------------------------------------------------


def _hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in parts of bounded length."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not words:
        return
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    for start in range(0, len(words) - size + 1, HELD):
        part = words[start : start + HELD + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        firsts, lasts = (ends - lengths)[: len(part) - size + 1].tolist(), ends[size - 1 :].tolist()
        yield np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(firsts, lasts)), np.uint64, len(firsts))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in every run of ``hashes`` that begins at ``starts``.

    Eight bits at a time lie in the eight bytes of a word, which are added for at most 255
    hashes before a byte could overflow.
    """
    bounds = np.append(starts, len(hashes))
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(bounds[:-1], bounds[1:])])
    owner = np.searchsorted(cuts, starts)
    counts = np.zeros((len(starts), BITS), np.int64)
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, shift::8] = np.add.reduceat(sums, owner, axis=0)  # little-endian: byte j holds bit 8j + shift
    return counts


def _pack(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    majority = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.int64).ravel()


def _fingerprints(texts: list[str], size: int) -> np.ndarray:
    found = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def settle() -> None:
        if rows:
            lengths = np.array([len(h) for h in held])
            counts = _bit_counts(np.concatenate(held), np.cumsum(lengths) - lengths)
            found[rows] = _pack(counts, lengths)
            held.clear()
            rows.clear()

    waiting = 0
    for row, text in enumerate(texts):
        parts = _hashes(text, size)
        first = next(parts, None)
        if first is None:
            continue
        second = next(parts, None)
        if second is None:
            held.append(first)
            rows.append(row)
            waiting += len(first)
            if waiting >= HELD:
                settle()
                waiting = 0
            continue
        counts, total = np.zeros((1, BITS), np.int64), 0
        for part in chain((first, second), parts):
            counts += _bit_counts(part, np.zeros(1, np.int64))
            total += len(part)
        found[row] = _pack(counts, np.array([total]))[0]
    settle()
    return found


def of_hashes(parts: list[np.ndarray]) -> int:
    """The SimHash, as a signed long, of a text whose shingle hashes are at hand."""
    counts, total = np.zeros((1, BITS), np.int64), 0
    for part in parts:
        counts += _bit_counts(part, np.zeros(1, np.int64))
        total += len(part)
    return int(_pack(counts, np.array([total]))[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The SimHash of a text column as a signed long; ``size`` words a shingle."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_fingerprints(batch.to_pylist(), size))

    return simhash(text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- links --------------------------------------------------------------------------


def _masks(bits: list[int], blocks: int, differing: int) -> list[int]:
    """Masks of the blocks kept: every choice that leaves ``differing`` blocks out."""
    parts = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for i in kept for b in parts[i]) for kept in combinations(range(blocks), blocks - differing)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keys(value: Column, masks: list[int]) -> Column:
    """One (choice, kept bits) for every mask."""
    choices = (F.struct(F.lit(i).alias("choice"), value.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("kept")) for i, m in enumerate(masks))
    return F.explode(F.array(*choices))


def _forest(values: np.ndarray, differing: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within the distance of each other."""
    links, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue[-1]).view(np.uint64)) <= differing
            at = queue.pop()
            links += [(int(at), int(v)) for v in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return links


def _links_within(buckets: DataFrame, differing: int) -> DataFrame:
    """Links (a, b) inside each bucket's array ``held``."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            found = [_forest(np.unique(np.array(v, np.int64)), differing) for v in batch.to_pylist()]
            yield pa.array([[{"a": a, "b": b} for a, b in f] for f in found], kind)

    return buckets.select(F.explode(links("held")).alias("link")).select("link.a", "link.b")


def links(fingerprints: DataFrame, differing: int = 3, blocks: int = 6) -> DataFrame:
    """Links (a, b) that join all distinct ``fingerprint`` values within the distance.

    Every two values in at most ``differing`` bits are in one component of the links, and
    every link is such a pair.
    """
    masks = _masks(list(range(BITS)), blocks, differing)
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))
    distinct = fingerprints.select("fingerprint").distinct()
    keyed = distinct.select("fingerprint", _keys(F.col("fingerprint"), masks).alias("_k")).select("fingerprint", "_k.*", salt.alias("salt"))
    shared = keyed.groupBy("choice", "kept").agg(F.count("*").alias("n")).filter("n > 1")
    salted = shared.select("choice", "kept", "n", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    members = stored(keyed.join(salted, ["choice", "kept", "salt"]).select("choice", "kept", "n", "fingerprint"), "members")

    few = members.filter(F.col("n") <= FEW).groupBy("choice", "kept").agg(F.collect_list("fingerprint").alias("held"))
    finer = [_masks([b for b in range(BITS) if not m >> b & 1], 6, differing) for m in masks]
    cases = F.array(*(F.array(*(F.lit(_signed(m | f)).cast("long") for f in fs)) for m, fs in zip(masks, finer)))
    many = (
        members.filter(F.col("n") > FEW)
        .select("fingerprint", "choice", F.posexplode(F.element_at(cases, F.col("choice") + 1)).alias("part", "mask"))
        .groupBy("choice", "part", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("kept"))
        .agg(F.collect_list("fingerprint").alias("held")).filter(F.size("held") > 1)
    )
    found = _links_within(few.select("held").union(many.select("held")), differing)
    return found.distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, differing: int = 3) -> DataFrame:
    """Every row's ``key``, ``fingerprint`` (hexadecimal) and ``component_id``, the group's smallest key."""
    require(docs, key, text)
    ready(docs.sparkSession)
    rows = stored(docs.select(F.col(f"`{key}`").alias("_key"), fingerprint(text_of(text), size).alias("fingerprint")), "fingerprints")
    return with_components(rows, differing).drop("root").select(F.col("_key").alias(key), hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def with_components(rows: DataFrame, differing: int = 3) -> DataFrame:
    """Add ``root``, the group's smallest fingerprint, and ``component_id`` to stored rows (_key, fingerprint, ...)."""
    return with_roots(rows, components(links(rows, differing)))


def with_roots(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """As ``with_components``, from components (node, root) of the fingerprints."""
    smallest = rows.groupBy("fingerprint").agg(F.min("_key").alias("least"))
    labelled = smallest.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # A root may stand for very many fingerprints, and a fingerprint for very many rows.
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))
    every = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt")
    named = labelled.withColumn("salt", salt).join(roots.select("*", every), ["root", "salt"]).select("fingerprint", "root", "component_id")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    return dealt.join(named.select("*", every), ["fingerprint", "salt"]).drop("salt")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, differing: int = 3) -> DataFrame:
    """One row of each group, columns as they were: that with the smallest key, null keys last.

    Of rows with that key the one with the smallest text digest stays, and of rows alike in
    key and text any one.
    """
    require(docs, key, text)
    ready(docs.sparkSession)
    digest = F.xxhash64(text_of(text))
    rows = stored(docs.select(F.col(f"`{key}`").alias("_key"), digest.alias("_digest"), fingerprint(text_of(text), size).alias("fingerprint")), "fingerprints")
    return first_rows(docs, with_components(rows, differing), key, text)


def first_rows(docs: DataFrame, rooted: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs``, whatever its columns are called, for each root among ``rooted`` (_key, _digest, root)."""
    lost, lost_digest, again_key, again_digest, own = (unused(docs, n) for n in ("_gone", "_gone_digest", "_again", "_again_digest", "_d"))
    digest = F.xxhash64(text_of(text))
    grouped = rooted.groupBy("root", "_key", "_digest").agg(F.count("*").alias("copies"))
    grouped = stored(grouped, "grouped")
    first = F.min(F.struct(F.isnull("_key").alias("none"), "_key", "_digest")).alias("first")
    # Groups of one row decide nothing; a group may hold most rows, so its winner is met by salt.
    larger = grouped.groupBy("root").agg(first, F.count("*").alias("n")).filter("n > 1")
    salted = larger.select("root", "first", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    members = grouped.withColumn("salt", F.pmod(F.xxhash64("_key", "_digest"), F.lit(SALTS))).join(salted, ["root", "salt"])
    stays = F.col("_key").eqNullSafe(F.col("first._key")) & (F.col("_digest") == F.col("first._digest"))
    gone = stored(members.filter(~stays).select(F.col("_key").alias(lost), F.col("_digest").alias(lost_digest)), "gone")
    # Hashed by shuffle at every size: a row's text moves once, unsorted, and meets the few ids of its partition.
    kept = docs.join(gone.hint("shuffle_hash"), F.col(f"`{key}`").eqNullSafe(F.col(lost)) & (digest == F.col(lost_digest)), "left_anti")
    repeated = grouped.filter("copies > 1").select(F.col("_key").alias(again_key), F.col("_digest").alias(again_digest))
    if repeated.isEmpty():
        return kept
    again = stored(repeated, "repeated")
    same = F.col(f"`{key}`").eqNullSafe(F.col(again_key)) & (digest == F.col(again_digest))
    several = kept.join(again, same, "left_semi").withColumn(own, digest)
    return kept.join(again, same, "left_anti").union(several.dropDuplicates([key, own]).drop(own))
