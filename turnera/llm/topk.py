"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are whole numbers: floor(1024 * x) of every component.  Candidates are grouped into
buckets of similar length.  A query takes its first threshold from the longest vectors; a
bucket whose longest vector cannot reach the threshold is never sent to that query.  For the
others the threshold, over the query's and the bucket's length, is a cosine that a candidate
must reach: where it is high, candidates are looked up by the coordinates in which the query
is strong (all others would need a smaller angle than they can have); where it is low, by
their length.  What is left is verified by whole-number products, exact in any order.

A bucket is dealt into pieces of bounded size by a hash of the id, and queries into blocks,
so that equal or equally long vectors, however many, never meet in one task.

Defined cases: a vector that is null or holds null, NaN or an infinity takes no part, neither
does a row without an id; vectors are compared with those of as many components only; an
empty vector scores 0 with other empty ones.  Equal scores go to the smaller id; repeated ids
are separate candidates, save that a query skips every row with its own id.  Scores beyond
a long saturate.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnera.llm.common import checkpointed, ready, require

SCALE = 1024
#: Candidates in a piece of a bucket and queries in a block, on average.
PIECE, BLOCK = 8192, 4096
#: Long vectors of each dimension, from which first thresholds come.
PROBE = 512
#: From this local cosine on, coordinates are looked up instead of lengths.
COORDINATE_FROM = 0.4
#: Products of whole numbers up to this are exact in binary floating point.
EXACT = float(2**53)
#: Slack for rounding in bounds (never in scores).
SLACK = 1e-9

#: Lengths are told apart in steps of an eighth of an octave; beyond the last step they share one.
STEPS, LAST = 4, 8192

FOUND = "query_id long, query_hash long, vec_id long, score long"


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Valid rows as (id, v, dim, square, level); v holds whole numbers as doubles."""
    require(rows, key, vector)
    valid = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("x", lambda x: F.when(F.abs(x) < 2.0**43, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return (
        rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
        .filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(valid)
        .select("id", whole.alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("square", F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
        .withColumn("level", F.floor(F.least(F.log2(F.col("square") + 1) * STEPS, F.lit(float(LAST)))).cast("int"))
    )


def _longest_of(level):
    """No vector of a level is longer."""
    return F.when(level >= LAST, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), (level + 1) / (2.0 * STEPS)))


# --- inside a task: numpy over one piece of a bucket -----------------------------


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _is_exact(queries: np.ndarray, candidates: np.ndarray) -> bool:
    if not (queries.size and candidates.size):
        return True
    return float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1] < EXACT


def _products(queries: np.ndarray, candidates: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return np.rint(queries @ candidates.T).astype(np.int64)
    right = [[int(x) for x in row] for row in candidates]
    low, high = -(2**63), 2**63 - 1
    return np.array(
        [[min(high, max(low, sum(int(a) * b for a, b in zip(q, c)))) for c in right] for q in queries], np.int64
    ).reshape(len(queries), len(right))


def first_thresholds(ids, queries, probe_ids, probes, k: int) -> np.ndarray:
    """The k-th best score among the probes but a query's own; minus infinity if they are fewer."""
    needs = np.full(len(ids), -np.inf)
    if len(probe_ids) >= k and _is_exact(queries, probes):
        for start in range(0, len(ids), 1024):
            part = slice(start, start + 1024)
            scores = (queries[part] @ probes.T) if queries.shape[1] else np.zeros((len(ids[part]), len(probe_ids)))
            scores[ids[part, None] == probe_ids[None, :]] = -np.inf
            needs[part] = np.sort(scores, axis=1)[:, -k]
    return needs


def best_of_piece(ids, queries, needs, vec_ids, vectors, k: int):
    """For each query its k best of a piece that reach its threshold, as (query row, id, score)."""
    exact = _is_exact(queries, vectors)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.lexsort((vec_ids, -lengths))
    vec_ids, vectors, lengths = vec_ids[order], vectors[order], lengths[order]
    own = np.sqrt((queries * queries).sum(axis=1))
    reach = own * (lengths[0] if len(lengths) else 0.0)
    cosines = np.where(needs > 0, needs / np.maximum(reach, 1e-300), -1.0)
    found: list[tuple[int, int, int]] = []

    def keep(row: int, at: np.ndarray, scores: np.ndarray) -> None:
        right = (scores >= needs[row]) & (vec_ids[at] != ids[row])
        at, scores = at[right], scores[right]
        if len(at) > k:
            top = scores >= np.partition(scores, len(scores) - k)[-k]
            at, scores = at[top], scores[top]
        ranked = np.lexsort((vec_ids[at], -scores))[:k]
        found.extend((row, int(vec_ids[at[i]]), int(scores[i])) for i in ranked)

    by_coordinate = exact & (cosines >= COORDINATE_FROM) & (cosines <= 1 + SLACK)
    by_length = np.flatnonzero(~by_coordinate & (cosines <= 1 + SLACK))
    for start in range(0, len(by_length), 128):
        rows = by_length[start : start + 128]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(needs[rows] > 0, needs[rows] / own[rows] * (1 - SLACK), -1.0)
        long_enough = np.searchsorted(-lengths, -least, side="right")
        most = int(long_enough.max(initial=0))
        scores = _products(queries[rows], vectors[:most], exact)
        for i, row in enumerate(rows):
            keep(row, np.arange(long_enough[i]), scores[i, : long_enough[i]])
    if by_coordinate.any():
        units = vectors / np.maximum(lengths, 1e-300)[:, None]
        along = np.argsort(units, axis=0, kind="stable")
        places = np.take_along_axis(units, along, axis=0)
        for row in np.flatnonzero(by_coordinate):
            unit = queries[row] / own[row]
            spread = np.arccos(np.clip(cosines[row] * (1 - SLACK), -1, 1))
            narrowest = None
            for focus in np.argsort(-np.abs(unit))[:4]:
                angle = np.arccos(np.clip(unit[focus], -1, 1))
                low = np.cos(min(np.pi, angle + spread)) - 1e-7
                high = np.cos(max(0.0, angle - spread)) + 1e-7
                start, stop = np.searchsorted(places[:, focus], [low, high])
                if narrowest is None or stop - start < narrowest[1] - narrowest[0]:
                    narrowest = (start, stop, focus)
            at = along[narrowest[0] : narrowest[1], narrowest[2]]
            keep(row, at, _products(queries[row : row + 1], vectors[at], True)[0])
    return found


# --- in Spark: which piece meets which block of queries ----------------------------


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score.

    Both inputs come from ``whole_vectors``.  A query is a distinct pair of id and vector.
    """
    spark = vectors.sparkSession
    ready(spark)
    vectors = checkpointed(vectors)
    queries = queries.withColumn("query_hash", F.xxhash64("v")).dropDuplicates(["id", "query_hash", "v"])

    # The longest vector of each of PROBE groups by hash: at most PROBE rows a dimension.
    groups = vectors.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(PROBE)).alias("_group"))
    chosen = groups.agg(F.max_by("id", F.struct("square", "id")).alias("id"), F.max_by("v", F.struct("square", "id")).alias("v")).collect()
    probes: dict[int, tuple] = {}
    for dim in {r["dim"] for r in chosen}:
        own = [r for r in chosen if r["dim"] == dim]
        probes[dim] = (np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], float).reshape(len(own), dim))
    shared = spark.sparkContext.broadcast(probes)

    @F.arrow_udf("double")
    def need(ids: pa.Array, dims: pa.Array, values: pa.Array) -> pa.Array:
        keys, sizes = ids.to_numpy(zero_copy_only=False), dims.to_numpy(zero_copy_only=False)
        needs = np.full(len(keys), -np.inf)
        for dim in set(sizes.tolist()):
            at = np.flatnonzero(sizes == dim)
            own = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
            if dim in shared.value:
                needs[at] = first_thresholds(keys[at], own, *shared.value[dim], k)
        return pa.array(needs)

    asked = checkpointed(queries.withColumn("need", need("id", "dim", "v")))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # One row a dimension and level, LAST levels at most.
    levels = checkpointed(
        vectors.groupBy("dim", "level").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).join(F.broadcast(blocks), "dim")
    )
    reached = F.col("need") <= F.sqrt("square") * _longest_of(F.col("level")) * (1 + SLACK)
    left = (
        asked.drop("level").join(F.broadcast(levels), "dim").filter((F.col("need") <= 0) | reached)
        .select("id", "v", "query_hash", "need", "dim", "level", F.pmod(F.xxhash64("id", "query_hash"), "blocks").alias("block"),
                F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    )
    right = (
        vectors.join(F.broadcast(levels), ["dim", "level"])
        .select("id", "v", "dim", "level", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"),
                F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"))
    )
    keys = ["dim", "level", "piece", "block"]
    right = right.select(*(F.col(c).alias(f"held_{c}") for c in right.columns))

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if asking.num_rows and held.num_rows:
            ids = asking["id"].to_numpy()
            hashes = asking["query_hash"].to_numpy()
            needs = asking["need"].to_numpy()
            hits = best_of_piece(
                ids, _matrix(asking["v"], len(ids)), needs, held["held_id"].to_numpy(), _matrix(held["held_v"], held.num_rows), k
            )
            rows = [(int(ids[q]), int(hashes[q]), v, s) for q, v, s in hits]
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "query_hash", "vec_id", "score"), columns)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*(f"held_{c}" for c in keys))).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
