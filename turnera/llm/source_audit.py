"""Source divergence audit: how the sources of a language differ in their terms.

Terms are counted by sorting pointers.  A task lays its texts behind each other, notes where
each term begins, and sorts these pointers, for each source apart, by multikey quicksort: by
the next eight bytes of the term, then, within runs of pointers that are still equal and not
at an end, by the eight after them, and so on.  A run of equal terms then tells their
occurrences and, as pointers of a run keep the order of the texts, the documents that hold
them.  Only runs leave a task: language, source, term, occurrences, documents.

Each language keeps the terms that ``least`` of its documents hold.  With smoothed shares p of
the kept terms in each source, in billionths, two sources diverge by the sum over terms of
(p - q)^2 / (p + q), each rounded down; terms that set a source apart are found by the same
measure against its whole language.  Sums over pairs of sources run over blocks of terms: a
block is a matrix of sources by terms, its size bounded, and only sums for each pair leave it.

Defined cases: null text, language or source reads as ''.  Every row is a document, repeated
or not.  A source without a kept term has share 1 / V of each, as smoothing gives it; a
language without kept terms has pairs of value 0 and no terms.  Other columns are not read.
A task holds a text whole, and terms of any length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnera.llm import bytescan
from turnera.llm.common import ready, require, stored, text_of

#: Bytes of text whose pointers are sorted together.
SORTED = 16 << 20
#: Cells of a matrix of sources by terms, and pairs that one task sums.
CELLS, PAIRS = 1 << 18, 1 << 20
#: Shares are in billionths; each count is raised by this much.
WHOLE, RAISED = 1_000_000_000, 2
LETTERS = bytescan.table_of(dict.fromkeys((*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)), 1))

# --- sorting pointers -----------------------------------------------------------------------


def _eight(data: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as one number, zero beyond its end; ``data`` has eight bytes to spare."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[starts]
    keys = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    short = left < 8
    if short.any():
        drop = ((8 - np.maximum(left[short], 0)) * 8).astype(np.uint64)
        mask = np.where(drop == 64, np.uint64(0), ~np.uint64(0) << np.minimum(drop, np.uint64(63)))
        keys[short] &= mask
    return keys


def sorted_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their terms, equal ones as they came, and where runs of equal terms begin.

    Multikey quicksort by eight bytes at a time, all runs of a depth together.
    """
    order = np.argsort(keys := _eight(data, starts, lengths), kind="stable")
    keys = keys[order]
    edge = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    depth = 8
    while True:
        # Runs with a term that goes on; those that end here come first in them, being padded with zeros.
        run = np.cumsum(edge) - 1
        longer = np.maximum.reduceat(lengths[order], np.flatnonzero(edge)) > depth if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(longer[run]) if len(order) else np.zeros(0, np.int64)
        if not len(at):
            return order, np.flatnonzero(edge)
        own = order[at]
        keys = _eight(data, np.minimum(starts[own] + depth, len(data) - 8), lengths[own] - depth)
        inner = np.lexsort((keys, run[at]))
        order[at], keys = own[inner], keys[inner]
        edge[at[1:]] |= (keys[1:] != keys[:-1]) & (run[at][1:] == run[at][:-1])
        depth += 8


def runs_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts in order, with their occurrences and the number of texts that hold each."""
    data, offsets = bytescan.joined(texts)
    solid = LETTERS[data] == 1
    starts = np.flatnonzero(bytescan.begins(solid, offsets))
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(bytescan.begins(solid[::-1], len(data) - offsets[::-1]))
    lengths = (len(data) - ends[::-1]) - starts
    lowered = np.append(bytescan.LOWER[data], np.zeros(8, np.uint8))
    order, edges = sorted_runs(lowered, starts, lengths)
    text = np.searchsorted(offsets[1:], starts[order], "right")
    fresh = np.r_[True, text[1:] != text[:-1]]
    fresh[edges] = True
    n = np.diff(edges, append=len(order))
    first = order[edges]
    terms = pa.array([lowered[a:b].tobytes() for a, b in zip(starts[first].tolist(), (starts + lengths)[first].tolist())], pa.binary())
    return terms.cast(pa.string()), n, np.add.reduceat(fresh.astype(np.int64), edges)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bytescan.collected(batches, SORTED):
        pairs = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
        names: dict[tuple[str, str], int] = {}
        codes = np.fromiter((names.setdefault((p["lang"], p["source"]), len(names)) for p in pairs.to_pylist()), np.int64, len(pairs))
        for (lang, source), code in names.items():
            for portion in bytescan.portions(batch["text"].take(pa.array(np.flatnonzero(codes == code))), SORTED):
                terms, n, holding = runs_of(portion)
                k = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array(n), pa.array(holding)], ["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(text_of(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every source, and documents that hold it."""
    ready(docs.sparkSession)
    runs = _named(docs, text, lang, source).mapInArrow(_told, "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- divergence -------------------------------------------------------------------------------


def _share(count: str, total: str, kept: str) -> Column:
    """p, exact: 1 + floor(WHOLE (count + RAISED) / (total + RAISED kept))."""
    return F.expr(f"CAST(1 + (CAST({WHOLE} AS DECIMAL(19,0)) * (CAST({count} AS DECIMAL(18,0)) + {RAISED}) DIV (CAST({total} AS DECIMAL(18,0)) + {RAISED} * CAST({kept} AS DECIMAL(18,0)))) AS BIGINT)")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _paired(key, counted: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over a block's terms for each source of a tile with every other one of its language."""
    lang, tile, tiles, terms = (sources[c][0].as_py() for c in ("lang", "tile", "tiles", "terms"))
    sources = sources.sort_by("source")
    names = sources["source"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    shares = np.repeat(sources["p0"].to_numpy()[:, None], terms, axis=1)
    if counted.num_rows:
        columns = counted["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        shares[[place[s] for s in counted["source"].to_pylist()], columns] = counted["p"].to_numpy()
    rows = {"lang": [], "source": [], "item": [], "value": []}
    for i in range(tile, len(names), tiles):
        apart, both = shares - shares[i], shares + shares[i]
        values = (apart * apart // both).sum(axis=1)
        others = [j for j in range(len(names)) if j != i]
        rows["lang"] += [lang] * len(others)
        rows["source"] += [names[i]] * len(others)
        rows["item"] += [names[j] for j in others]
        rows["value"] += values[others].tolist()
    return pa.table(rows, pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def pair_divergences(shares: DataFrame, terms: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    Terms of a language are dealt into blocks of at most about ``CELLS`` cells by a hash; each
    block meets all sources of its language in one task, which sends one sum a pair, or in as
    many as its pairs need at ``PAIRS`` a task.
    """
    blocks, tiles = F.ceil(F.col("sources") * F.col("kept") / CELLS), F.ceil(F.col("sources") * F.col("sources") / PAIRS)
    wide = sizes.select("lang", F.greatest(blocks, F.lit(1)).cast("long").alias("blocks"), F.least(tiles, "sources").cast("long").alias("tiles"))
    block, tile = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile")
    counted = shares.join(wide, "lang").select("lang", block, tile, "source", "term", "p")
    filled = terms.join(wide, "lang").select("lang", "tiles", block).groupBy("lang", "block", "tiles").agg(F.count("*").alias("terms"))
    sources = groups.join(filled, "lang").select("lang", "block", tile, "tiles", "terms", "source", "p0")
    place = ["lang", "block", "tile"]
    sums = counted.groupBy(*place).cogroup(sources.groupBy(*place)).applyInArrow(_paired, "lang string, source string, item string, value long")
    found = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages without kept terms have no block; their pairs are 0.
    bare = groups.join(sizes.filter("kept = 0"), "lang").select("lang", "source")
    pairs = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    return found.union(pairs.select("lang", "source", "item", F.lit(0).cast("bigint")))


def divergences(docs: DataFrame, least: int = 10, best: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair``, all other sources; part ``term``, the ``best`` terms."""
    require(docs, text, lang, source)
    counts = stored(term_counts(docs, text, lang, source), "terms")
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"), "kept")
    kept = counts.join(terms.select("lang", "term"), ["lang", "term"], "left_semi")
    wholes = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = _named(docs, text, lang, source).select("lang", "source").distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(wholes, "lang", "left").na.fill(0, ["total", "kept", "whole"])
    none = F.when(F.col("kept") > 0, _share("0", "total", "greatest(kept, 1)"))
    groups = stored(groups.withColumn("p0", none), "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept"))
    shares = stored(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "kept").alias("p")), "shares")

    pair = pair_divergences(shares, terms, groups.select("lang", "source", "p0"), sizes)
    whole = terms.join(wholes, "lang").select("lang", "term", _share("n", "whole", "kept").alias("q"))
    apart = shares.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    told = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair.select("*", F.lit("pair").alias("part"), rank).select(told)
    return pairs.union(apart.select("*", F.lit("term").alias("part"), rank).filter(F.col("rank") <= best).select(told))
