"""Token ids in binary files: frequency-ranked ids, byte-aligned lengths, control bytes apart.

Each text is encoded and its ids end with an end id.  Ids are counted over all documents and
ranked, the most frequent first, so that most need one byte.  A rank takes one to four bytes;
the lengths, two bits each, stand in control bytes apart from the data, four to a byte, so that
a reader gets all lengths from one table lookup and all ranks from array arithmetic.

A data set is a folder: ``ids``, files of blocks in ascending order of document; ``ranks``, the
id of each rank; ``parts``, the ids before each part.  A block holds whole documents:

    magic, version, part, block, ids before it in its part, ids, documents, data bytes, checksum
    key of each document (8 bytes), whether it has one (1), its number of ids (4)
    control bytes, data bytes

and is followed by the mark ``END_OF_BLOCK``.  Spark's own sink writes the blocks and Spark's
reader returns the files, so every file system that Spark reaches will do and a task that is
lost or run twice leaves nothing behind.

Encoding: where the vocabulary drops white space (``_drops_spaces``), a text is cut into units
that cannot influence each other (runs of ASCII letters, single digits, runs of signs, and any
other run between spaces whole), and each distinct unit is encoded once per worker by the
tokenizers library.  Other vocabularies encode each text whole.

Defined cases: a null or empty text holds the end id alone.  Keys are integers; a document with
a null key comes first.  Rows that share a key are ordered by the checksum of their ids.
Special strings inside a text are read as the library reads them.  Other columns are not kept.
"""

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnera.llm import bytescan
from turnera.llm.common import ready, require, stored, text_of

#: Ids of a block, and of a file on average; smaller data sets have a file for each task.
BLOCK_IDS, FILE_IDS, TASK_IDS = 1 << 18, 1 << 23, 1 << 20
#: Blocks of a file at most; Spark's reader holds a file whole.
FILE_BLOCKS = 1 << 6
#: Units of a generation that a worker keeps with their ids; it keeps two, and what is met again moves to the younger.
KEPT = 250_000
HEADER = struct.Struct("<4sHIIQIIQI")
MAGIC, VERSION, END_OF_BLOCK = b"TIDS", 1, "/TIDS\n"
#: Lengths of the four ranks that a control byte describes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)

# --- encoding ----------------------------------------------------------------------------

# Fixed value: the split of word vocabularies that drop white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, SIGN, FOREIGN = 0, 1, 2, 3, 4


def _drops_spaces(spec: dict) -> bool:
    """Whether units between spaces are encoded alike alone and in a text."""
    norm, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers") if norm.get("type") == "Sequence" else [norm]
    local = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ") for s in steps)
    lowers = any(s.get("type") == "Lowercase" for s in steps)
    parts = split.get("pretokenizers") if split.get("type") == "Sequence" else []
    words = len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_SPLIT} and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
    bytelevel = words and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
    bare = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    return bool(local and lowers and bytelevel and bare and spec["model"].get("dropout") is None and not spec.get("truncation") and not spec.get("padding"))


class Encoder:
    """Ids of texts; one per worker process."""

    def __init__(self, library: str, end: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(library)
        self.library = Tokenizer.from_str(library)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_units = _drops_spaces(spec)
        self.end = end
        classes = {b: FOREIGN for b in (*range(32), *range(127, 256), ord("'"))}
        classes |= {b: SIGN for b in range(33, 127) if chr(b) != "'"} | {b: LETTER for b in (*range(65, 91), *range(97, 123))} | {b: DIGIT for b in range(48, 58)}
        classes |= {b: SPACE for b in (9, 10, 11, 12, 13, 32)} | {t["content"].encode()[0]: FOREIGN for t in spec["added_tokens"]}
        self.classes = bytescan.table_of(classes)
        self.plain = bytes(b for b in range(256) if classes.get(b, 0) in (LETTER, DIGIT, SIGN))
        self.held: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts behind each other, and the number of each text's; end ids included."""
        if not self.by_units:
            coded = self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            ids = [[*e.ids, self.end] for e in coded]
            return np.array([i for own in ids for i in own], np.uint32), np.array([len(i) for i in ids], np.int64)
        units, bounds = self.units(*bytescan.joined(texts))
        coded = units.dictionary_encode()
        own = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, codes = np.frombuffer(b"".join(own), np.uint32), coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        begins = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
        ids = flat[np.repeat(begins, n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.append(0, ends)[bounds]
        return np.insert(ids, stops, self.end).astype(np.uint32), np.diff(stops, prepend=0) + 1

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and how many lie before the end of each text."""
        kind = self.classes[data]
        solid = kind != SPACE
        begin = bytescan.begins(solid, offsets)
        chunks = np.flatnonzero(begin)
        lowered = bytescan.LOWER[data]
        change = kind == DIGIT
        change[1:] |= kind[1:] != kind[:-1]
        change &= solid
        if len(chunks):
            foreign = np.maximum.reduceat(kind, chunks) == FOREIGN
            if foreign.any():
                whole = np.zeros(len(data), bool)
                whole[chunks[0] :] = np.repeat(foreign, np.diff(chunks, append=len(data)))
                change &= ~whole
                np.copyto(lowered, data, where=whole)
        starts = np.flatnonzero(begin | change)
        return bytescan.cut(lowered, solid, starts), np.searchsorted(starts, offsets[1:])

    def _ids(self, units: list[bytes]) -> list[bytes]:
        if len(self.held) > KEPT:
            self.held, self.older = {}, self.held
        found = list(map(self.held.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            ids = found[i] = self.older.get(units[i])
            if ids is None:
                new.append(i)
            else:
                self.held[units[i]] = ids
        if new:
            plain, merge = self.plain, self.library.model.tokenize
            other = []
            for i in new:
                if units[i].translate(None, plain):
                    other.append(i)
                else:
                    found[i] = np.array([t.id for t in merge(units[i].decode())], np.uint32).tobytes()
            coded = self.library.encode_batch_fast([units[i].decode() for i in other], add_special_tokens=False)
            for i, encoding in zip(other, coded):
                found[i] = np.array(encoding.ids, np.uint32).tobytes()
            self.held.update((units[i], found[i]) for i in new)
        return found


_workers: dict[tuple[str, int], Encoder] = {}


def _encoder(key: str, library: str, end: int) -> Encoder:
    if (key, end) not in _workers:
        _workers.clear()
        _workers[key, end] = Encoder(library, end)
    return _workers[key, end]


def encoded(docs: DataFrame, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n, ids (little-endian, 2 bytes each where all ids fit, else 4), crc, row; stored."""
    require(docs, key, text)
    spark = docs.sparkSession
    ready(spark)
    with open(vocabulary, encoding="utf-8") as file:
        library = file.read()
    spec = json.loads(library)
    width = 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end]) < 1 << 16 else 4
    shared, name = spark.sparkContext.broadcast(library), hashlib.sha256(library.encode()).hexdigest()

    @F.arrow_udf("binary")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(name, shared.value, end)
        for batch in batches:
            parts = []
            for portion in bytescan.portions(batch):
                ids, n = encode(portion)
                data = ids.astype(f"<u{width}").tobytes()
                stops = np.append(0, np.cumsum(n)) * width
                parts.append(pa.array([data[a:b] for a, b in zip(stops, stops[1:])], pa.binary()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    coded = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), ids_of(text_of(text)).alias("ids"))
    table = coded.select("key", (F.octet_length("ids") / width).cast("bigint").alias("n"), F.lit(width).alias("width"), "ids", F.crc32("ids").alias("crc"), F.monotonically_increasing_id().alias("row"))
    return stored(table, "coded", compression="zstd")


# --- ranks and blocks --------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for width, ids in zip(batch["width"].to_pylist(), batch["ids"]):
            own = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def ranked_ids(coded: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by falling frequency over all documents, and how many occur in all; bounded by the vocabulary."""
    counts = coded.select("width", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "id").toArrow()
    return found["id"].to_numpy().astype(np.uint32), int(np.sum(found["n"].to_numpy()))


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fours[: len(ranks)] = extra
    fours = fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return np.bitwise_or.reduce(fours, axis=1).tobytes(), data.tobytes()


def unpacked(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        ranks[at] |= data[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _block(part: int, number: int, before: int, keys: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    control, data = packed(rank_of[np.concatenate(ids)])
    counts = np.array([len(i) for i in ids], "<u4")
    body = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is not None for k in keys) + counts.tobytes() + control + data
    return HEADER.pack(MAGIC, VERSION, part, number, before, int(counts.sum()), len(keys), len(data), zlib.crc32(body)) + body


def _blocks(content: memoryview) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, block, ids before it, keys, whether there is a key, ids of each document, ranks) of a file's blocks."""
    at, mark = 0, END_OF_BLOCK.encode()
    while at < len(content):
        magic, version, part, number, before, n, docs, size, checksum = HEADER.unpack_from(content, at)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a file of token ids")
        at += HEADER.size
        stop = at + 13 * docs + -(-n // 4) + size
        body = content[at:stop]
        if zlib.crc32(body) != checksum or content[stop : stop + len(mark)] != mark:
            raise ValueError(f"block {number} of part {part} is damaged")
        counts, control = 9 * docs, 13 * docs
        data = control + -(-n // 4)
        ranks = unpacked(np.frombuffer(body[control:data], np.uint8), np.frombuffer(body[data:], np.uint8), n)
        yield part, number, before, np.frombuffer(body[: 8 * docs], "<i8"), np.frombuffer(body[8 * docs : counts], bool), np.frombuffer(body[counts:control], "<u4"), ranks
        at = stop + len(mark)


def write(coded: DataFrame, path: str, files: int | None = None) -> None:
    """Write ``encoded`` documents as a data set at ``path``, which must not exist.

    ``files`` bounds the parts; by default there is one for ``FILE_IDS`` ids.
    """
    spark = coded.sparkSession
    ids, total = ranked_ids(coded)
    spark.createDataFrame(pa.table({"rank": np.arange(len(ids)), "id": ids.astype(np.int64)}), "rank long, id long").write.parquet(f"{path}/ranks")
    if files is None:
        files = max(-(-total // FILE_IDS), min(spark.sparkContext.defaultParallelism, -(-total // TASK_IDS)), 1)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, waiting = [], []

        def told() -> pa.RecordBatch:
            nonlocal number, before, held
            block = _block(part, number, before, keys, waiting, shared.value)
            number, before, held = number + 1, before + held, 0
            keys.clear()
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

        for batch in batches:
            for key, width, ids_ in zip(batch["key"].to_pylist(), batch["width"].to_pylist(), batch["ids"]):
                keys.append(key)
                waiting.append(np.frombuffer(ids_.as_py(), f"<u{width}"))
                held += len(waiting[-1])
                if held >= BLOCK_IDS:
                    yield told()
        if keys:
            yield told()

    order = [F.col("key").asc_nulls_first(), F.col("crc"), F.col("row")]
    dealt = coded.select("key", "crc", "row", "width", "ids").repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = dealt.select("key", "width", "ids").mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    written.write.option("lineSep", END_OF_BLOCK).option("maxRecordsPerFile", FILE_BLOCKS).option("compression", "none").text(f"{path}/ids")
    sizes = _files(spark, path).mapInArrow(_sizes, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")


# --- reading -----------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/ids").select("content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[memoryview]:
    return (memoryview(value.as_buffer()) for batch in batches for value in batch.column(0))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each block, from its header."""
    for content in _contents(batches):
        at = 0
        while at < len(content):
            _, _, part, _, _, n, docs, size, _ = HEADER.unpack_from(content, at)
            at += HEADER.size + 13 * docs + -(-n // 4) + size + len(END_OF_BLOCK)
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]})


def _read(spark: SparkSession, path: str, told, columns: str) -> DataFrame:
    ready(spark)
    held = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()["id"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(held)  # bounded by the vocabulary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            for part, _, before, keys, has, counts, ranks in _blocks(content):
                ids, stops = shared.value[ranks], np.cumsum(counts, dtype=np.int64)
                starts = stops - counts
                fixed = [pa.array(keys, pa.int64(), mask=~has), pa.array(np.full(len(keys), part)), pa.array(before + starts), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*fixed, told(ids, starts, stops)], ["key", "part", "start", "n_tokens", "told"])

    read = _files(spark, path).mapInArrow(rows, f"key long, part long, start long, n_tokens long, told {columns}")
    return read.join(spark.read.parquet(f"{path}/parts"), "part").withColumn("start", F.col("start") + F.col("before"))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row a document: key, start (ids of all documents before it), n_tokens, ids."""
    def lists(ids, starts, stops):
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _read(spark, path, lists, "array<int>").select(F.col("key").alias(key), "start", "n_tokens", F.col("told").alias("ids"))


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row a document: key, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    def checksums(ids, starts, stops):
        data = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())], pa.int64())

    return _read(spark, path, checksums, "long").select(F.col("key").alias(key), "start", "n_tokens", F.col("told").alias("ids_crc32"))
