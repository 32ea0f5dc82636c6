"""Phrase collocation mining: exact counts of frequent phrases in a HAT-trie, and their scores.

Texts are split into pieces and words; a phrase is words in a row within a piece.  Phrases are
counted level by level, one word longer each time.  A phrase of k words can only reach the
least count if both phrases of k - 1 words in it do, so before a level those of the level
before are marked in a bit table by a hash of their words; what finds no mark is not counted.
The table is sized by what it holds and bounded by ``MOST_BITS``; a phrase marked by chance is
counted for nothing, never wrongly.

In a task, phrases are counted in a trie over the task's own word ids.  Its upper levels branch
on one word each; below them hang hash containers of the remaining words, packed into one
number.  A container that grows beyond ``BURST`` bursts into a branch with a container for each
next word.  When the trie holds more than ``ENTRIES`` phrases, its fullest subtrees are spilled
whole, each as a run sorted by its words' ids, until half are left.  A run leaves container by container,
in batches of ``TOLD`` rows, and no longer holds what has left.  Runs are merged by prefix, all words of
the phrase but the last: a shuffle partition takes whole prefixes.  A prefix that holds more
than 1 / ``PIECES`` of the occurrences which the level before has counted (at most ``PIECES``
do, and are broadcast) is dealt into pieces by the last word.

Defined cases: a null text is empty; a null language is ``und``, and meets documents of that
language.  An empty text or piece has no words.  Every row counts, repeated or not.  Only the
text and language columns are read.  A task holds a text whole, and words of any length.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnera.llm import bytescan
from turnera.llm.common import ready, require, stored, text_of

#: Phrases in a container before it bursts, and phrases and distinct words that a task holds.
BURST, ENTRIES, WORDS = 1 << 12, 1 << 20, 1 << 19
#: Rows of a batch that leaves a task at most, bytes of text that are read together, and that are cut into words at once.
TOLD, TOGETHER, SCANNED = 1 << 15, 16 << 20, 1 << 20
#: Bits of a word id within a packed number; three ids fit.
ID_BITS = 21
#: Bits for each phrase of a bit table, and bits of a table at most (64 MB).
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Prefixes with more than 1 / PIECES of a level are dealt into pieces.
PIECES = 200
WORD, GAP, BREAK = 0, 1, 2
CLASSES = bytescan.table_of({0x20: GAP, 0x09: GAP} | {b: BREAK for b in (*b".,;:!?", *range(0x0A, 0x0E))})
#: A language's phrases are ranked in as many tiers first, so that its last task ranks TIERS times ``best`` at most.
TIERS = 32
#: Scores are millionths of twice the share of a phrase in its parts.
SCALE = 2_000_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

# --- words of a batch -----------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and the number of the piece each lies in."""
    words, pieces, before = [], [], 0
    for portion in bytescan.portions(texts, SCANNED):  # what a scan needs for each byte is many times the text
        data, offsets = bytescan.joined(portion)
        kind = CLASSES[data]
        solid = kind == WORD
        starts = np.flatnonzero(bytescan.begins(solid, offsets))
        breaks = np.cumsum(kind == BREAK, dtype=np.int32)
        pieces.append(breaks[starts] + np.searchsorted(offsets[1:], starts, "right") + before)
        words.append(bytescan.cut(bytescan.LOWER[data], solid, starts))
        before += len(portion) + int(breaks[-1] if len(breaks) else 0)
    return (pa.concat_arrays(words), np.concatenate(pieces)) if words else (pa.array([], pa.binary()), np.zeros(0, np.int64))


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of the hashes of words in a row."""
    total = np.zeros(len(hashes[0]), np.uint64)
    for own, multiplier in zip(hashes, MULTIPLIERS):
        total = (total ^ own) * multiplier
        total ^= total >> np.uint64(29)
    return total


def word_hash(language: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(language))


class Marks(NamedTuple):
    """Hashes of frequent phrases in a bit table."""

    bits: int
    table: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(self.bits)
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- the trie -------------------------------------------------------------------------------


class Trie:
    """Counts of phrases of ``k`` words of one language; keys are word ids.

    A node is a container (a dict of packed remaining words) or a branch (a list holding a
    dict of nodes by next word).
    """

    def __init__(self, k: int, burst: int = BURST):
        self.k, self.burst = k, burst
        self.root: dict | list = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> None:
        """Distinct phrases, sorted: their first word, the packed other words, occurrences."""
        if self.k == 1 or isinstance(self.root, dict):
            self.root = self._into(self.root, (first << (ID_BITS * (self.k - 1))) | rest if self.k < 4 else self._wide(first, rest), n.tolist(), self.k)
            return
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        rest, n = rest.tolist(), n.tolist()
        for a, b, word in zip(starts.tolist(), np.append(starts[1:], len(first)).tolist(), first[starts].tolist()):
            self.root[0][word] = self._into(self.root[0].get(word, {}), rest[a:b], n[a:b], self.k - 1)

    @staticmethod
    def _wide(first: np.ndarray, rest: np.ndarray) -> list[int]:
        return [(a << (ID_BITS * 3)) | b for a, b in zip(first.tolist(), rest.tolist())]

    def _into(self, node: dict | list, keys, times: list[int], left: int):
        """Add keys of ``left`` packed words below a node, and give the node, burst if it is full."""
        keys = keys if isinstance(keys, list) else keys.tolist()
        if isinstance(node, list):
            shift = ID_BITS * (left - 1)
            low, children = (1 << shift) - 1, node[0]
            groups: dict[int, tuple[list[int], list[int]]] = {}
            for key, n in zip(keys, times):
                own = groups.setdefault(key >> shift, ([], []))
                own[0].append(key & low)
                own[1].append(n)
            for word, (own, counts) in groups.items():
                children[word] = self._into(children.get(word, {}), own, counts, left - 1)
            return node
        before, get = len(node), node.get
        for key, n in zip(keys, times):
            node[key] = get(key, 0) + n
        self.entries += len(node) - before
        if len(node) > self.burst and left > 1:
            self.entries -= len(node)
            return self._into([{}], list(node), list(node.values()), left)
        return node

    def size(self, node: dict | list) -> int:
        return len(node) if isinstance(node, dict) else sum(map(self.size, node[0].values()))

    def spilled(self, keep: int) -> Iterator[tuple[list[int], list[int]]]:
        """Take the fullest subtrees out, as sorted runs in parts, until at most ``keep`` phrases stay."""
        if isinstance(self.root, dict) or keep == 0:
            node, self.root, self.entries = self.root, {}, 0
            yield from self._run(node, 0, self.k)
            return
        sizes = {word: self.size(child) for word, child in self.root[0].items()}
        for word in sorted(sizes, key=lambda w: -sizes[w]):
            if self.entries <= keep:
                return
            self.entries -= sizes[word]
            yield from self._run(self.root[0].pop(word), word, self.k - 1)

    def _run(self, node: dict | list, path: int, left: int) -> Iterator[tuple[list[int], list[int]]]:
        """All phrases of a subtree in order, packed whole, and their counts, a container at a time; empties the subtree."""
        if isinstance(node, dict):
            head, keys = path << (ID_BITS * left), sorted(node)
            counts = list(map(node.__getitem__, keys))
            node.clear()
            for start in range(0, len(keys), TOLD):
                part = slice(start, start + TOLD)
                yield [head | key for key in keys[part]] if head else keys[part], counts[part]
            return
        for word in sorted(node[0]):
            yield from self._run(node[0].pop(word), path << ID_BITS | word, left - 1)


class Counter:
    """Counts the phrases of ``k`` words of a task's texts, in one trie a language."""

    def __init__(self, k: int, marks: Marks | None, entries: int = ENTRIES, words: int = WORDS, burst: int = BURST):
        self.k, self.marks, self.entries, self.most_words, self.burst = k, marks, entries, words, burst
        self._clear()

    def _clear(self) -> None:
        self.tries: dict[str, Trie] = {}
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.hashes: dict[str, np.ndarray] = {}

    def read(self, language: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Count the texts; give the runs that had to leave."""
        first, rest, n = self._phrases(language, texts)
        for start in range(0, len(n), TOLD):  # numbers become objects slice by slice, and the trie never holds much more than it may
            part = slice(start, start + TOLD)
            self.tries.setdefault(language, Trie(self.k, self.burst)).add(first[part], rest[part], n[part])
            if sum(t.entries for t in self.tries.values()) > self.entries:
                yield from self._spilled(1, 2)
        if len(self.words) > self.most_words:
            yield from self.rest()

    def _phrases(self, language: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' distinct phrases that may be frequent, and their occurrences."""
        words, pieces = words_of(texts)
        coded = words.dictionary_encode()
        del words
        ids = self._local(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        at = self._candidates(language, ids, pieces)
        return self._distinct(ids, at) if len(at) else (at, at, at)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._spilled(0, 1)
        self._clear()

    def _spilled(self, share: int, of: int) -> Iterator[pa.RecordBatch]:
        """Runs behind each other, in batches of rows, until a share of each trie is left."""
        held = pa.array(self.words, pa.binary()).cast(pa.string())
        for name, trie in self.tries.items():
            keys, counts = [], []
            for own, n in trie.spilled(trie.entries * share // of):
                if len(keys) + len(own) > TOLD:
                    yield self._rows(name, keys, counts, held)
                    keys, counts = [], []
                keys += own
                counts += n
            if keys:
                yield self._rows(name, keys, counts, held)

    def _local(self, distinct: list[bytes]) -> np.ndarray:
        ids, words = self.ids, self.words
        for word in distinct:
            if word not in ids:
                ids[word] = len(words)
                words.append(word)
        return np.fromiter(map(ids.__getitem__, distinct), np.int64, len(distinct))

    def _hashes(self, language: str) -> np.ndarray:
        """The hash of every word held, by id."""
        known = self.hashes.get(language, np.zeros(0, np.uint64))
        if len(known) < len(self.words):
            new = [word_hash(language, w) for w in self.words[len(known) :]]
            known = self.hashes[language] = np.concatenate([known, np.array(new, np.uint64)])
        return known

    def _candidates(self, language: str, ids: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Where phrases begin whose both shorter phrases are marked."""
        k, places = self.k, len(ids) - self.k + 1
        if places <= 0:
            return np.zeros(0, np.int64)
        whole = pieces[:places] == pieces[k - 1 :]
        if self.marks is not None:
            hashes = self._hashes(language)[ids]
            marked = self.marks.has(mixed([hashes[i : i + places + 1] for i in range(k - 1)]))
            whole &= marked[:-1] & marked[1:]
        return np.flatnonzero(whole)

    def _distinct(self, ids: np.ndarray, at: np.ndarray):
        first, rest = ids[at], np.zeros(len(at), np.int64)
        for i in range(1, self.k):
            rest = rest << ID_BITS | ids[at + i]
        if self.k < 4:  # all in one number
            keys, n = np.unique(first << (ID_BITS * (self.k - 1)) | rest, return_counts=True)
            return keys >> (ID_BITS * (self.k - 1)), keys & ((1 << (ID_BITS * (self.k - 1))) - 1), n
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
        return first[starts], rest[starts], np.diff(starts, append=len(first))

    def _rows(self, language: str, keys: list[int], counts: list[int], held: pa.Array) -> pa.RecordBatch:
        low, three = (1 << ID_BITS) - 1, (1 << 3 * ID_BITS) - 1
        rest = np.array(keys if self.k < 4 else [key & three for key in keys], np.int64)
        ids = [rest >> (ID_BITS * (min(self.k, 3) - 1 - i)) & low for i in range(min(self.k, 3))]
        if self.k == 4:  # the first of four ids is beyond 64 bits
            ids.insert(0, np.array([key >> 3 * ID_BITS for key in keys], np.int64))
        columns = [held.take(pa.array(own)) for own in ids]
        prefix = pc.binary_join_element_wise(*columns[:-1], " ") if self.k > 1 else pa.repeat("", len(keys))
        return pa.RecordBatch.from_arrays([pa.repeat(language, len(keys)), prefix, columns[-1], pa.array(counts, pa.int64())], ["lang", "prefix", "last", "n"])


# --- counts over all documents -----------------------------------------------------------------


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    for batch in bytescan.collected(batches, TOGETHER):
        languages = batch["lang"].dictionary_encode()
        codes = languages.indices.to_numpy()
        for code, language in enumerate(languages.dictionary.to_pylist()):
            own = batch["text"].take(pa.array(np.flatnonzero(codes == code)))
            for portion in bytescan.portions(own):
                yield language, portion


def _runs(texts: DataFrame, k: int, marks) -> DataFrame:
    """(lang, prefix, last, n): what the tasks' tries counted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(k, marks.value if marks is not None else None)
        for language, portion in _by_language(batches):
            yield from counter.read(language, portion)
        yield from counter.rest()

    return texts.mapInArrow(counted, "lang string, prefix string, last string, n long")


def _joined(prefix: str, last: str) -> Column:
    return F.when(F.col(prefix) == "", F.col(last)).otherwise(F.concat(prefix, F.lit(" "), last))


def _merged(runs: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """(lang, phrase, prefix, n): runs added up, each prefix in one partition unless it is very full."""
    if shorter is None:
        return runs.groupBy("lang", "prefix", "last").agg(F.sum("n").alias("n"))
    total = shorter.agg(F.sum("n")).first()[0] or 0
    full = F.broadcast(shorter.filter(F.col("n") * PIECES > total).select("lang", F.col("phrase").alias("prefix"), F.ceil(F.col("n") * PIECES / F.lit(max(total, 1))).alias("pieces")))
    dealt = runs.join(full, ["lang", "prefix"], "left").withColumn("piece", F.pmod(F.xxhash64("last"), F.coalesce("pieces", F.lit(1))))
    return dealt.repartition("lang", "prefix", "piece").groupBy("lang", "prefix", "piece", "last").agg(F.sum("n").alias("n"))


def marks_of(phrases: DataFrame) -> Marks:
    """A bit table of (lang, phrase); its bits come to the driver, MOST_BITS of them at most."""
    wanted = phrases.count() * BITS_EACH
    bits = min(MOST_BITS, max(1 << 16, 1 << wanted.bit_length()))

    @F.arrow_udf("long")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for languages, texts in batches:
            found = []
            for language, text in zip(languages.to_pylist(), texts.to_pylist()):
                hashes = [np.array([word_hash(language, w)], np.uint64) for w in text.encode().split(b" ")]
                found.append(int(mixed(hashes)[0] % np.uint64(bits)))
            yield pa.array(found, pa.int64())

    # Spark's bit positions start at 1 within a bucket of 2^15.
    at = phrases.select((place("lang", "phrase") + 1).alias("at"))
    buckets = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table, size = np.zeros(bits // 8, np.uint8), 1 << 12
    for row in buckets.toLocalIterator():  # bits / 2^15 rows of 4 KB
        table[(row.bucket - 1) * size : row.bucket * size] |= np.frombuffer(row.bits, np.uint8)
    return Marks(bits, table)


def counted(docs: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``longest`` words that occur ``least`` times; (lang, n) of all words."""
    if longest > 4:
        raise ValueError("phrases have at most four words")
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(text_of(text).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    levels, shorter, marks, totals = [], None, None, None
    for k in range(1, longest + 1):
        found = _merged(_runs(texts, k, marks), shorter)
        if k == 1:
            found = stored(found, "words")
            totals = found.groupBy("lang").agg(F.sum("n").alias("n"))
        kept = found.filter(F.col("n") >= least).select("lang", _joined("prefix", "last").alias("phrase"), F.lit(k).alias("words"), "n")
        shorter = stored(kept, f"phrases-{k}")
        levels.append(shorter)
        if k < longest:
            marks = spark.sparkContext.broadcast(marks_of(shorter))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.union(level)
    return phrases, totals


# --- scores ---------------------------------------------------------------------------------------


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def with_counts(rows: DataFrame, part: str, name: str, phrases: DataFrame) -> DataFrame:
    """Add the count of the phrase in column ``part``.

    Parts that more than 1 / PIECES of the rows ask for, at most PIECES, are answered by broadcast.
    """
    asked = rows.groupBy("lang", F.col(part).alias("phrase")).agg(F.count("*").alias("times"))
    total = rows.count()
    known = phrases.select("lang", "phrase", F.col("n").alias(name))
    often = stored(asked.filter(F.col("times") * PIECES > total).join(known, ["lang", "phrase"]).select("lang", F.col("phrase").alias(part), F.col(name).alias("_often")), "often")
    told = rows.join(F.broadcast(often), ["lang", part], "left")
    few = told.filter("_often IS NULL").drop("_often").join(known.withColumnRenamed("phrase", part), ["lang", part])
    return told.filter("_often IS NOT NULL").withColumnRenamed("_often", name).select(few.columns).union(few)


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, within: int = 80, best: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its weakest cut, 2,000,000 a / (l + r) rounded down.  Phrases
    inside a longer one that has ``within`` percent of their count are left out.
    """
    require(docs, text, lang)
    phrases, totals = counted(docs, longest, least, text, lang)
    found = phrases.filter("words > 1")
    cuts = found.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stored(cuts.withColumns({"left": _part(1, F.col("k")), "right": _part(F.col("k") + 1, F.col("words") - F.col("k"))}), "cuts")
    cuts = stored(with_counts(cuts, "left", "l", phrases), "left-counts")
    cuts = with_counts(cuts, "right", "r", phrases)
    score = F.expr(f"CAST({SCALE} AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("bigint")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    sizes = F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> named_struct('i', i, 's', s))))")
    inner = phrases.filter("words > 2").select("lang", "phrase", "n", F.explode(sizes).alias("at")).select("lang", _part(F.col("at.i"), F.col("at.s")).alias("phrase"), "n")
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.coalesce(_exact(F.col("longer")) * 100 < _exact(F.col("cut.a")) * within, F.lit(True)))

    order = [F.desc("cut.score"), F.desc("cut.a"), "phrase"]
    tier = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TIERS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(tier)).filter(F.col("rank") <= best)  # what one tier of a language keeps
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", *(F.col(f"cut.{c}").alias(c) for c in "alr"), "n", "cut.score")
