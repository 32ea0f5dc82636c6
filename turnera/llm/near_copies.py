"""Near duplicates by exact Jaccard similarity of word shingle sets.

Candidates come first from the SimHash operator: sets whose texts' fingerprints, of the same
shingles, differ in at most three bits (``simhash.links``).  Most pairs at 0.8 differ in more, so
others come from MinHash bands: ``BANDS`` keys of ``ROWS`` minima each.  Two sets of
similarity s share a key with probability 1 - (1 - s^8)^40: 99.94 % at 0.8, 99.9999 % at 0.9.
Sets that share a key meet there by their sketches, a byte of each of ``SKETCH`` minima.  Those
whose sketches agree in the asked share, less five standard deviations, are probably alike; only
these are joined to clusters, so that texts that merely share boilerplate gather in none.  Within
a cluster sets are compared exactly, so a link always is a pair of at least the asked similarity.
A sketch misses one pair in three million of those that just reach it.  Components of the links
are the groups.

Only distinct sets take part: copies share one; keys that the very same sets share are looked at
once.  A key or cluster of very many sets, or of very long ones, is dealt into chunks, and each
two chunks are compared on their own.  Links are those of a spanning forest, which loses no
connection.

Defined cases: texts of fewer words than a shingle have one shingle, all their words.  Null and
blank texts have the empty set and are one group.  Keys as in ``simhash.deduplicated``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera.llm import simhash
from turnera.llm.common import ready, require, stored, text_of
from turnera.llm.components import components
from turnera.llm.simhash import SALTS, _hashes, first_rows, of_hashes, with_roots

BANDS, ROWS = 40, 8
#: Shingle hashes that meet all multipliers at once.
HELD = 1024
#: Sets, and shingles of all its sets, in a chunk of a cluster; sets in a chunk of a key.
SETS, SHINGLES = 1024, 1 << 21
#: Every other minimum gives a byte of the sketch.
SKETCH = BANDS * ROWS // 2
#: Sets of a key that are compared many keys at a time; larger keys are a group each, or several.
FEW = 64
#: Odd multipliers and shifts of the minima, and what mixes a band's minima to a key.
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return _distinct(list(_hashes(text, size)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _band_keys(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One number for every band of a set, and its sketch."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), HELD):
        least = np.minimum(least, (_TIMES * short[start : start + HELD] + _PLUS).min(axis=1))
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), least[::2].astype(np.uint8).tobytes()


def _digest(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def _described(text: Column, size: int) -> Column:
    """A text's set digest, its shingles' number, its band keys, its sketch and its SimHash."""

    @F.arrow_udf("struct<fingerprint:bigint,n:bigint,bands:array<bigint>,sketch:binary,simhash:bigint>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            digests, numbers, keys, sketches, prints = [], [], [], [], []
            for value in batch:
                parts = list(_hashes(value.as_py(), size))
                own = _distinct(parts)
                prints.append(of_hashes(parts))
                digests.append(_digest(own))
                numbers.append(len(own))
                bands, sketch = _band_keys(own) if len(own) else (np.zeros(0, np.uint64), b"")
                keys.append(bands.view(np.int64))
                sketches.append(sketch)
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [pa.array(digests, pa.int64()), pa.array(numbers, pa.int64()), bands, pa.array(sketches, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.StructArray.from_arrays(columns, ["fingerprint", "n", "bands", "sketch", "simhash"])

    return described(text)


def _sets(text: Column, size: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t.as_py(), size).view(np.int64) for t in batch], pa.list_(pa.int64()))

    return sets(text)


# --- links --------------------------------------------------------------------------


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (places) of a spanning forest of the sets that are at least so similar to each other."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    holders = owner[np.argsort(ids, kind="stable")]  # the sets that hold each shingle, shingle by shingle
    counts = np.bincount(ids)
    ends = np.cumsum(counts)
    begins, places = np.cumsum(sizes) - sizes, np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        if not places[first]:
            continue
        places[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            own = ids[begins[at] : begins[at] + sizes[at]]
            runs = counts[own]
            took = np.repeat(ends[own] - np.cumsum(runs), runs) + np.arange(runs.sum())
            common = np.bincount(holders[took], minlength=len(sets))
            near = np.flatnonzero(places & (common >= least * (sizes + sizes[at] - common) - 1e-9))
            places[near] = False
            links += [(at, int(v)) for v in near]
            queue += near.tolist()
    return links


def _tiles(chunk: Column, pieces: Column) -> Column:
    """Every two chunks (i, j) of a key or cluster that this chunk takes part in; its own, if it is the only one."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda j: (j != chunk) | (pieces == 1))
    return F.explode(F.transform(others, lambda j: F.struct(F.least(j, chunk).alias("i"), F.greatest(j, chunk).alias("j"))))


def probable(prints: np.ndarray, sketches: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets whose sketches agree in ``least`` or more of their bytes."""
    links, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.count_nonzero(sketches[left] == sketches[at], axis=1) >= least * sketches.shape[1]
            links += [(int(prints[at]), int(prints[v])) for v in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def _agreeing(prints: pa.Array, sketches: pa.Array, least: float) -> list[tuple[int, int]]:
    matrix = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(prints), SKETCH)
    return probable(prints.to_numpy(), matrix, least)


def _within_few(keys: DataFrame, least: float) -> DataFrame:
    """Links (a, b) inside each row's array ``sets`` of (fingerprint, sketch)."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def linked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            groups = (batch[row].values for row in range(len(batch)))
            found = [[{"a": a, "b": b} for a, b in _agreeing(g.field("fingerprint"), g.field("sketch"), least)] for g in groups]
            yield pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return keys.select(F.explode(linked("sets")).alias("link")).select("link.a", "link.b")


def _within_many(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among members (held, i, j, fingerprint, sketch) of each key's chunks i and j."""

    def linked(group: pa.Table) -> pa.Table:
        prints, sketches = (pa.concat_arrays(group[c].chunks) for c in ("fingerprint", "sketch"))
        a, b = zip(*_agreeing(prints, sketches, least) or [(None, None)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).drop_null()

    return members.groupBy("held", "i", "j").applyInArrow(linked, "a long, b long")


def _by_simhash(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join distinct sets (fingerprint, simhash) whose SimHashes differ in at most three bits.

    The sets of one SimHash hang on the first of them, and links of SimHashes join those firsts.
    """
    firsts = stored(sets.groupBy("simhash").agg(F.min("fingerprint").alias("first"), F.count("*").alias("n")), "simhashes")
    every = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt")
    salted = firsts.filter("n > 1").select("simhash", "first", every)
    members = sets.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))).join(salted, ["simhash", "salt"])
    own = members.filter("first <> fingerprint").select(F.col("first").alias("a"), F.col("fingerprint").alias("b"))
    a, b = (firsts.select(F.col("simhash").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    between = simhash.links(firsts.select(F.col("simhash").alias("fingerprint"))).join(a, "a").join(b, "b")
    return own.union(between.select("a_first", "b_first"))


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """Distinct sets (fingerprint, bands, sketch, simhash) to links (a, b) of those with close SimHashes, or with a shared key and probably alike."""
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).alias("salt")
    keyed = sets.select("fingerprint", F.posexplode("bands").alias("band", "held")).select("fingerprint", F.xxhash64("band", "held").alias("held"), salt)
    # Keys that the very same sets share are one; copies with a word changed share most of theirs.
    who = [F.count("*").alias("n"), F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"), F.bit_xor(F.xxhash64("fingerprint")).alias("all")]
    shared = keyed.groupBy("held").agg(*who).filter("n > 1").groupBy("n", "low", "high", "all").agg(F.min("held").alias("held"))
    salted = shared.select("held", "n", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    members = keyed.join(salted, ["held", "salt"]).select("held", "n", "fingerprint")
    # Only sets that share a key bring their sketch.
    members = stored(members.join(sets.select("fingerprint", "sketch"), "fingerprint"), "members")
    bound = least - 5 * np.sqrt(least * (1 - least) / SKETCH)
    few = members.filter(F.col("n") <= FEW).groupBy("held").agg(F.collect_list(F.struct("fingerprint", "sketch")).alias("sets"))
    pieces = F.ceil(F.col("n") / SETS).cast("long")
    chunk = F.pmod(F.xxhash64("fingerprint", F.lit(1)), pieces)
    many = members.filter(F.col("n") > FEW).select("held", "fingerprint", "sketch", _tiles(chunk, pieces).alias("tile"))
    large = _within_many(many.select("held", "tile.i", "tile.j", "fingerprint", "sketch"), bound)
    close = _by_simhash(sets.filter(F.size("bands") > 0).select("fingerprint", "simhash"))
    return _within_few(few, bound).union(large).union(close).distinct()


def clusters(sets: DataFrame, least: float) -> DataFrame:
    """Distinct sets to (fingerprint, cluster): those joined by probable likeness, others left out."""
    return components(candidates(sets, least)).select(F.col("node").alias("fingerprint"), F.col("root").alias("cluster"))


def _verified(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among members (cluster, i, j, fingerprint, held) that share a cluster and chunks i and j."""

    def linked(group: pa.Table) -> pa.Table:
        prints = group["fingerprint"].to_numpy()
        _, once = np.unique(prints, return_index=True)  # repeated rows
        column = group["held"].combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        found = forest([column[i].values.to_numpy() for i in once.tolist()], least)
        ends = prints[once]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(ends[list(a)], pa.int64()), "b": pa.array(ends[list(b)], pa.int64())})

    return members.groupBy("cluster", "i", "j").applyInArrow(linked, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, text: str, key: str, size: int, least: float) -> DataFrame:
    """Links (a, b) of set digests that join all sets of at least the similarity."""
    digest = F.xxhash64(text_of(text))
    first = F.min(F.struct(F.isnull("_key").alias("none"), "_key", "_digest")).alias("first")
    once = stored(rows.groupBy("fingerprint").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("simhash").alias("simhash")), "sets")
    held = stored(once.select("fingerprint", "first", "n").join(clusters(once.select("fingerprint", "bands", "sketch", "simhash"), least), "fingerprint"), "clusters")
    pieces = F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / SHINGLES)).cast("long")
    # Only clusters of more than a chunk: at most one for every SETS sets or SHINGLES shingles.
    large = held.groupBy("cluster").agg(pieces.alias("pieces")).filter("pieces > 1")
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("pieces"))
    dealt = held.join(F.broadcast(large), "cluster", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("chunk", chunk)
    wanted = dealt.select("fingerprint", "cluster", "pieces", "chunk", F.col("first._key").alias("_key"), F.col("first._digest").alias("_digest"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (digest == F.col("_digest"))
    texts = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).join(wanted.hint("shuffle_hash"), same)
    found = texts.select("cluster", "pieces", "chunk", "fingerprint", _sets(text_of(text), size).alias("held"))
    both = _tiles(F.col("chunk"), F.col("pieces")).alias("tile")
    return _verified(found.select("cluster", "fingerprint", "held", both).select("cluster", "tile.i", "tile.j", "fingerprint", "held"), least)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group, columns as they were: that with the smallest key, as ``simhash.deduplicated``."""
    require(docs, key, text)
    ready(docs.sparkSession)
    described = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(text_of(text)).alias("_digest"), _described(text_of(text), size).alias("d"))
    rows = stored(described.select("_key", "_digest", "d.*"), "shingle-sets")
    joined = components(links(docs, rows, text, key, size, least))
    return first_rows(docs, with_roots(rows.select("_key", "_digest", "fingerprint"), joined), key, text)
