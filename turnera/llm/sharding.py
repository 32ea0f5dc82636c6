"""Shards that all have the corpus's mixture, by proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and ranked; the rank as a fraction of the
source's size places them on a common scale, on which every source is spread evenly.  Cut
into equal counts, that order gives shards that each hold every source in proportion.

Neither ranking nor cutting gathers a source: digests and fractions are uniform, so their
leading digits deal rows into even blocks, counts of blocks give offsets, and only the rows
of one block are ordered together.  Texts are read once to measure them and never moved.

Defined cases: null texts have no bytes; a null source is a source of its own; rows with the
same key share a place in the shuffle and are ordered by size and checksum, so that only
rows that are alike in every output column are interchangeable.  An empty table gives none.
The law is ``rows`` (counts at most one apart), so equal texts form no groups and
``grown_shard`` is null.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnera.llm.common import require, stored, text_of, without

#: Blocks into which the shuffle of one source, and the common scale, are dealt.
BLOCKS = 4096
#: UTF-8 bytes that a row has besides its text.
ROW_BYTES = 8


def shuffle_digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _leading(digest: Column) -> Column:
    """The first twelve bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _offsets(rows: DataFrame, group: list[str], block: str) -> DataFrame:
    """Per block of a group: rows in the blocks before it, and rows of the whole group."""
    counts = rows.groupBy(*group, block).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    before = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, block,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"),
    )


def interleaved(docs: DataFrame, shards: int = 24, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Place every row: its key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    require(docs, key, text, source)
    alike = ["_digest", "size", "text_crc32"]
    measured = docs.select(
        F.col(f"`{key}`").alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_source"),
        shuffle_digest(F.col(f"`{key}`"), seed).alias("_digest"),
        (F.octet_length(text_of(text)) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of(text)).alias("text_crc32"),
    ).withColumn("_block", _leading(F.col("_digest")))
    narrow = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_source"),
        _leading(shuffle_digest(F.col(f"`{key}`"), seed)).alias("_block"),
    )
    within = Window.partitionBy("_source", "_block").orderBy(*alike)
    ranked = (
        measured.withColumn("_row", F.row_number().over(within))
        .join(_offsets(narrow, ["_source"], "_block"), ["_source", "_block"])
        .withColumn("_fraction", (F.col("_before") + F.col("_row") - F.lit(0.5)) / F.col("_all"))
        .select("_key", *alike, "_source", "_fraction", F.least(F.floor(F.col("_fraction") * BLOCKS), F.lit(BLOCKS - 1)).alias("_part"))
    )
    ranked = stored(ranked, "ranked")
    order = Window.partitionBy("_part").orderBy("_fraction", "_source", *alike)
    placed = (
        ranked.withColumn("_row", F.row_number().over(order))
        .join(F.broadcast(_offsets(ranked, [], "_part")), "_part")  # BLOCKS rows at most
        .withColumn("_at", F.col("_before") + F.col("_row") - 1)
        .withColumn("_shard", F.expr(f"(_at * {shards}) div _all"))
    )
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_at - (_shard * _all + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", text: str = "text", **options: str) -> None:
    """Write whole rows as one folder per shard, every row once.

    Rows that repeat a key, a size and a checksum are numbered on both sides, as any of them may
    take any of their places.  An input column named ``shard`` is replaced.
    """
    nth = F.row_number().over(Window.partitionBy("_key", "_size", "_crc").orderBy(F.lit(0)))
    places = interleaved(docs, shards, key=key, text=text, **options)
    places = places.select(F.col(f"`{key}`").alias("_key"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard").withColumn("_nth", nth)
    whole = without(docs, "shard")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in whole.columns)).alias("_row"), F.col(f"`{key}`").alias("_key"),
        (F.octet_length(text_of(text)) + ROW_BYTES).cast("long").alias("_size"), F.crc32(text_of(text)).alias("_crc"),
    ).withColumn("_nth", nth)
    same = [rows[c].eqNullSafe(places[c]) for c in ("_key", "_size", "_crc", "_nth")]
    rows.join(places, same).select("_row.*", "shard").write.partitionBy("shard").parquet(path)
