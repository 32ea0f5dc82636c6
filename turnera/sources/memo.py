"""The translation memo as a table stored by key.

Entries lie in parts, one for each run and prefix of the key (``segmento=<run>/prefijo=<hex>``),
ordered by key inside.  A run reads the parts of the prefixes that its own texts have and no
others, and, when its texts are few, asks the scan for their keys.  A published version lists the
parts that count (``published``), so that runs side by side and runs that die leave the memo
whole.  ``compact`` rewrites only prefixes that have gathered several parts, each on its own.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.operators import translation
from turnera.session import remove_folder
from turnera.sources import published

#: Hex digits of the key that name a prefix, a file each in a run; and those that deal a large prefix over tasks.
DIGITS, SPLIT = 1, 0
#: Up to so many keys are handed to the scan itself.
PUSHED = 1000
#: Parts of a prefix from which on it is compacted.
GATHERED = 2


def _prefix() -> F.Column:
    return F.substring("cache_key", len(fixed.MEMO_KEY_PREFIX) + 1, DIGITS)


def write(entries: DataFrame, path: str, run: str) -> None:
    """Add a run's entries and publish them, in place of what an earlier attempt of the same run published."""
    spark, segment = entries.sparkSession, f"{run}.{uuid.uuid4().hex[:8]}"
    new = _stored(entries, path, segment)
    published.publish(spark, path, lambda parts: [p for p in parts if _run(p) != run] + new)


def _run(part: str) -> str:
    return part.split("/")[0].removeprefix("segmento=").rsplit(".", 1)[0]


def _stored(entries: DataFrame, path: str, segment: str) -> list[str]:
    """Write a segment: files of one prefix, ordered by key; a large prefix may take several tasks."""
    place = f"segmento={segment}"
    keyed = entries.withColumn("prefijo", _prefix())
    dealt = keyed.repartition("prefijo", F.substring("cache_key", len(fixed.MEMO_KEY_PREFIX) + DIGITS + 1, SPLIT))
    dealt.sortWithinPartitions("prefijo", "cache_key").write.partitionBy("prefijo").parquet(f"{path}/{place}")
    return [f"{place}/{name}" for name in published.folders(entries.sparkSession, f"{path}/{place}") if name.startswith("prefijo=")]


def _table(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], translation.MEMO_SCHEMA)
    read = spark.read.schema(f"{translation.MEMO_SCHEMA}, segmento string, prefijo string").option("basePath", path)
    return read.parquet(*(f"{path}/{p}" for p in parts)).drop("segmento", "prefijo")


def read(spark: SparkSession, path: str, texts: DataFrame | None = None, but: str = "") -> DataFrame:
    """The memo, empty if there is none yet, without what run ``but`` wrote.

    With ``texts`` (a stored table with ``cache_key``) only the prefixes that they have.
    """
    parts = [p for p in published.current(spark, path) if _run(p) != but]
    if texts is None or not parts:
        return _table(spark, path, parts)
    asked = {f"prefijo={r.prefijo}": r.n for r in texts.groupBy(_prefix().alias("prefijo")).agg(F.count("*").alias("n")).collect()}  # 16 ** DIGITS rows
    memo = _table(spark, path, [p for p in parts if p.split("/")[1] in asked])
    if sum(asked.values()) <= PUSHED:
        memo = memo.filter(F.col("cache_key").isin([r.cache_key for r in texts.select("cache_key").collect()]))
    return memo


def compact(spark: SparkSession, path: str, gathered: int = GATHERED) -> list[str]:
    """Leave one part of each prefix that has ``gathered`` parts or more: the latest unexpired entry of each text.

    Gives the parts that no longer count; ``remove`` deletes them once no reader needs them.
    """
    parts: dict[str, list[str]] = {}
    for p in published.current(spark, path):
        parts.setdefault(p.split("/")[1], []).append(p)
    old = [p for own in parts.values() if len(own) >= gathered for p in own]
    if not old:
        return []
    new = _stored(translation.fresh(_table(spark, path, old)), path, f"compacta.{uuid.uuid4().hex[:8]}")

    def replaced(now: list[str]) -> list[str]:
        if not set(old) <= set(now):  # another compaction, or a repeated run, has replaced some of these parts
            raise RuntimeError(f"{path}: the parts being compacted were replaced meanwhile")
        return [p for p in now if p not in set(old)] + new

    published.publish(spark, path, replaced)
    return old


def remove(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Delete parts that no version in use lists."""
    for part in set(parts) - set(published.current(spark, path)):
        remove_folder(spark, f"{path}/{part}")
