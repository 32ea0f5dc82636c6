"""Language-model scores of whole documents: a gated recurrent network over counted words.

Counts come first: every token of every training document, summed in Spark (a table that
grows with the corpus).  The most frequent words have outputs of their own; all others belong
to a rare class told by their ending, in which their share is (c + 1) / (n + v + 1), n and v
the class's tokens and distinct words in training, so that an unseen word has its share too.
The network then learns which classes and words follow, starting from the counts.

Each text is then read once more, for the ids of its words, which are stored; training and
scoring read ids.  Training is data-parallel and covers every training text whole: texts are dealt by a
hash of their ids to ``ROUNDS`` rounds and, in each, to learners of about ``LEARNER_WORDS`` words.
A learner lays its texts in lanes and runs truncated backpropagation through all of their words in
consecutive windows, the state carried from window to window.  The learners' weights are averaged by
words seen, up a tree of bounded groups, and start the next round.  As a learner's share does not depend on
partitions or executors, neither do the weights.  Scoring lays documents in lanes and
carries the state through all windows of a document, however long.

Counts of the ``KNOWN`` most frequent words are broadcast (the bound of every broadcast
here); the other words of each document meet their counts in a join.

Defined cases: a null or blank text has the end token alone.  A null id reads as the empty
text for the split.  Without training documents counts are zero and all classes alike.
Repeated rows are scored each; an input column named like an output is replaced.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera.llm import recurrent
from turnera.llm.common import ready, require, stored, text_of
from turnera.llm.recurrent import FREQUENT, RARE, Vocabulary

#: Words whose counts every worker holds, and distinct words a counting task holds at once.
KNOWN, HELD = 1 << 17, 1 << 19
#: Words that a learner sees in a round, about, and rounds of averaging.
LEARNER_WORDS, ROUNDS = 1 << 20, 4
#: Bytes of ids that are scored in one set of lanes.
TOGETHER = 3 << 20
#: An id of the network in a stored table.
IDS = np.dtype("<u2")
#: Weights travel in pieces of this many numbers, and are added in groups of this many rows.
PIECE, FAN = 8192, 64
#: The end token; no word is empty.
END = b""
LN10 = math.log(10)


def tokens_of(text: str) -> list[bytes]:
    """Words (runs of anything but the six ASCII white spaces, A-Z lower-cased) and the end token."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % RARE


def is_held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


# --- counts -----------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, kind, n) over the single text column, kind the word's rare class; stored."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = list(held)
            columns = [pa.array(words, pa.binary()), pa.array(map(rare_class, words), pa.int32(), size=len(words)), pa.array(held.values(), pa.int64(), size=len(words))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "kind", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of(text.as_py()))
                if len(held) > HELD:
                    yield told()
        yield told()

    partial = texts.mapInArrow(counted, "word binary, kind int, n long")
    return stored(partial.groupBy("word", "kind").agg(F.sum("n").alias("n")), "counts")


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """Totals, and the words from the smallest count that at most ``known`` words reach."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["step"]: r["words"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # 1,024 rows at most
    least, reached = None, 0
    for s in sorted(sizes, reverse=True):
        reached += sizes[s]
        if reached > known:
            break
        least = s
    rows = counts.filter(step >= least).select("word", "n").toArrow() if least is not None else None
    words, n = (rows["word"].to_pylist(), rows["n"].to_pylist()) if rows is not None else ([], [])
    ranked = sorted(zip(words, n), key=lambda r: (-r[1], r[0]))
    if END not in dict(ranked):
        ranked.append((END, 0))
    # The end token always is among the words with an output of their own.
    at = next(i for i, (w, _) in enumerate(ranked) if w == END)
    if at >= FREQUENT:
        ranked.insert(FREQUENT - 1, ranked.pop(at))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # RARE rows
    rare_n, rare_v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in totals:
        rare_n[r["kind"]], rare_v[r["kind"]] = r["n"], r["v"]
    tokens, distinct = int(rare_n.sum()), int(rare_v.sum())
    for word, count in ranked[:FREQUENT]:
        rare_n[rare_class(word)] -= count
        rare_v[rare_class(word)] -= count > 0
    ids = np.array([i if i < FREQUENT else FREQUENT + rare_class(w) for i, (w, _) in enumerate(ranked)], np.int32)
    return Vocabulary({w: i for i, (w, _) in enumerate(ranked)}, np.array([c for _, c in ranked], np.int64), tokens, distinct, rare_n, rare_v, ids)


def _numbers(words: list[bytes], held: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Place in the vocabulary (-1: not held) and network id of every word."""
    places = np.fromiter(map(held.index.get, words, repeat(-1)), np.int32, len(words))
    ids = held.ids[places]
    other = np.flatnonzero(places < 0)
    ids[other] = [FREQUENT + rare_class(words[i]) for i in other.tolist()]
    return places, ids


# --- training ----------------------------------------------------------------------------


def _learner(shared, first: int):
    """One round of a learner: the weights it comes to, in pieces, times the words it saw."""

    def learned(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("ids", "ascending")])
        trainer = recurrent.Trainer(shared.value)
        trainer.learn([np.frombuffer(d.as_buffer(), IDS) for d in rows["ids"]], first)
        values, task = recurrent.flat(trainer.weights).astype(np.float64) * trainer.words, rows["learner"][0].as_py()
        parts = [{"task": task, "piece": p, "words": float(trainer.words), "held": values[p * PIECE : (p + 1) * PIECE]} for p in range(-(-len(values) // PIECE))]
        return pa.Table.from_pylist(parts, schema=_PIECES)

    return learned


def train(coded: DataFrame, held: Vocabulary, rounds: int = ROUNDS, learner_words: int = LEARNER_WORDS) -> recurrent.Weights:
    """Weights learned from the ids of all training texts (n_tokens, ids).

    Each text takes part in one round, whole.  A round's texts are dealt by a hash of their ids to learners of
    about ``learner_words`` words, however many partitions there are; the learners' weights are
    averaged by words seen, and the next round starts from the average.
    """
    spark = coded.sparkSession
    weights = recurrent.initial(held.counts[:FREQUENT], held.rare_tokens)
    first = held.index[END]
    hashed = coded.select("n_tokens", "ids", F.xxhash64("ids").alias("h"))
    total = hashed.agg(F.sum("n_tokens")).first()[0] or 0
    rounds = max(1, min(rounds, -(-total // learner_words)))
    learners = max(1, round(total / rounds / learner_words))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        own = hashed.filter(F.pmod("h", F.lit(rounds)) == number).select("ids", "h", F.pmod(F.shiftright("h", 20), F.lit(learners)).cast("long").alias("learner"))
        pieces = own.groupBy("learner").applyInArrow(_learner(shared, first), "task long, piece int, words double, held array<double>")
        for fan in (FAN * FAN, FAN, 1):
            pieces = pieces.withColumn("task", F.pmod("task", F.lit(fan))).groupBy("task", "piece").applyInArrow(_added, pieces.schema)
        parts = pieces.orderBy("piece").toArrow().to_pylist()  # one row a piece of the weights
        if parts:
            weights = recurrent.shaped(np.concatenate([np.array(p["held"]) / p["words"] for p in parts]))
    return weights


_PIECES = pa.schema([("task", pa.int64()), ("piece", pa.int32()), ("words", pa.float64()), ("held", pa.list_(pa.float64()))])


def _added(rows: pa.Table) -> pa.Table:
    """Sum of the pieces of a group, in the order of their tasks."""
    rows = rows.sort_by("task")
    total = np.sum([np.array(h.as_py()) for h in rows["held"]], axis=0)
    first = {"task": rows["task"][0].as_py(), "piece": rows["piece"][0].as_py(), "words": float(np.sum(rows["words"].to_numpy())), "held": total}
    return pa.Table.from_pylist([first], schema=_PIECES)


# --- ids and scores --------------------------------------------------------------------


def _measured(texts: list[str], held: Vocabulary):
    """Per text: tokens, known tokens, sum of log10(c + 1) over held words, share of rare words in their classes, other words, ids."""
    share = np.log10(held.rare_tokens + held.rare_distinct + 1.0)
    logs = np.log10(held.counts + 1.0)
    for text in texts:
        words = tokens_of(text)
        places, own = _numbers(words, held)
        found = places >= 0
        other = Counter(words[i] for i in np.flatnonzero(~found).tolist())
        rare = own[own >= FREQUENT] - FREQUENT
        # A held word without an output of its own has its count inside its rare class.
        inside = logs[places[found & (places >= FREQUENT)]].sum() - share[rare].sum()
        known = int((held.counts[places[found]] > 0).sum())
        yield len(words), known, float(logs[places[found]].sum()), float(inside), other, own.astype(IDS).tobytes()


def _struct(rows: list) -> pa.Array:
    """The measured rows, other words as flat arrays behind offsets."""
    tokens, known, counted, inside, others, ids = zip(*rows) if rows else ((),) * 6
    offsets = np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32)
    flat = pa.StructArray.from_arrays(
        [pa.array([w for o in others for w in o], pa.binary()), pa.array([t for o in others for t in o.values()], pa.int64())], ["word", "times"]
    )
    columns = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(counted, pa.float64()), pa.array(inside, pa.float64()), pa.array(ids, pa.binary())]
    return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["n_tokens", "known", "counted", "inside", "ids", "others"])


def _together(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Batches in sets of enough ids that a long document does not run through its lanes alone."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, learner_words: int = LEARNER_WORDS) -> DataFrame:
    """One row for each document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    require(docs, key, text)
    spark = docs.sparkSession
    ready(spark)
    split = docs.select(F.col(f"`{key}`").alias("_key"), is_held_out(F.col(f"`{key}`")).alias("held_out"), text_of(text).alias("_text"))
    counts = word_counts(split.filter("NOT held_out").select("_text"))
    held = vocabulary(counts)
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("struct<n_tokens:bigint,known:bigint,counted:double,inside:double,ids:binary,others:array<struct<word:binary,times:bigint>>>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _struct(list(_measured(batch.to_pylist(), shared.value)))

    coded = split.select("_key", "held_out", F.monotonically_increasing_id().alias("row"), measured("_text").alias("m")).select("_key", "held_out", "row", "m.*")
    coded = stored(coded, "coded")
    weights = spark.sparkContext.broadcast(train(coded.filter("NOT held_out"), held, rounds, learner_words))
    first = held.index[END]

    @F.arrow_udf("double")
    def network(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for together in _together(batches):
            logs = recurrent.score(weights.value, [np.frombuffer(d.as_buffer(), IDS) for b in together for d in b], first) / LN10
            start = 0
            for b in together:
                yield pa.array(logs[start : start + len(b)])
                start += len(b)

    others = coded.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    met = others.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs")
    )
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    floor = math.log10(held.tokens + held.distinct + 1)
    rows = coded.drop("others").withColumn("network", network("ids")).drop("ids")
    return rows.join(met, "row", "left").select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(held.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + logs - F.col("n_tokens") * floor).alias("base_score"), (F.col("network") + F.col("inside") + logs).alias("score"),
    )
