"""New request files go through the same operators as they arrive.

Every micro-batch writes under its stream's identity and its own number, replacing what an
earlier attempt at the same batch wrote, so a restart neither loses nor repeats rows, and
streams that share an output never touch each other's.  The identity is the one that Spark
keeps in the checkpoint: it survives restarts and is new with a new checkpoint.

Duplicates across batches are told by keyed state in Spark's state store: keys lie in lists, one
for each bucket of their hash, and a batch reads the lists of its own keys' buckets, each at once.
Only a new stream reads the keys that the output already holds, once, as its initial state.

Files whose headers differ are landed first (``land``): a stream of their names, each batch read
header by header and written with the canonical columns, which ``read_landed`` streams on.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from turnera import fixed_values as fixed
from turnera.functions.text import strip
from turnera.operators import columns, costing, fields, quality, translation
from turnera.plans.job import prepare
from turnera.plans.settings import RunOptions
from turnera.session import at_least, remove_folder, ship_package
from turnera.sources import memo as stored_memo
from turnera.sources.published import exists
from turnera.sources.readers import read_files

KEYS_SCHEMA = "clave_sha string, flujo string, lote bigint"


@dataclass(frozen=True)
class StreamOptions:
    """``across_batches`` also drops what an earlier batch already accepted, ``remember_days`` at most ago if given."""

    run: RunOptions
    checkpoint: str
    across_batches: bool = False
    remember_days: float | None = None
    files_per_batch: int | None = None


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int | None = None, order: str | None = None
) -> DataFrame:
    """Requests from a folder that files keep arriving in, with their provenance."""
    reader = spark.readStream.schema(schema).format(kind).option("recursiveFileLookup", True)
    if kind == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    row = F.col(order) if order else F.col("_metadata.row_index")
    stream = reader.load(path)
    cells = [F.col(c).cast("string").alias(c) for c in stream.columns if c not in quality.ROW_ORDER]
    return stream.select(
        F.col("_metadata.file_path").alias("archivo_origen"), row.cast("bigint").alias("fila"), *cells
    )


LANDED = {"archivo_origen": "string", "fila": "bigint"} | {c: "string" for c in fixed.RESULT_COLUMNS if c not in columns.COMPUTED}


def land(
    spark: SparkSession, path: str, landed: str, checkpoint: str, kind: str = "parquet", order: str | None = None,
    files_per_batch: int | None = None, options: dict | None = None,
) -> StreamingQuery:
    """Bring what has arrived at ``path`` since the last time, with whatever headers, to ``landed`` with canonical columns.

    The stream is one of file names; no file is opened for it.  A batch that is already there
    whole is not written again, so that a restart after a failure lands every file once.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
    if files_per_batch:
        names = names.option("maxFilesPerTrigger", files_per_batch)

    def process(batch: DataFrame, number: int) -> None:
        place = f"{landed}/lote={number}"
        if exists(batch.sparkSession, f"{place}/_SUCCESS"):
            return
        files = sorted(r.path for r in batch.select("path").collect())  # one name a file
        if files:
            read = columns.validated(read_files(batch.sparkSession, files, kind, order, options=options))
            kept = [(F.col(c) if c in read.columns else F.lit(None)).cast(t).alias(c) for c, t in LANDED.items()]
            read.select(*kept).write.mode("overwrite").parquet(place)

    writer = names.load(path).select("path").writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_landed(spark: SparkSession, landed: str, batches_per_batch: int | None = None) -> DataFrame:
    """Landed requests as a stream, with the provenance they arrived with."""
    reader = spark.readStream.schema(", ".join(f"{c} {t}" for c, t in LANDED.items())).option("recursiveFileLookup", True)
    if batches_per_batch:
        reader = reader.option("maxFilesPerTrigger", batches_per_batch)
    return reader.parquet(landed)


class FirstOfKey(StatefulProcessor):
    """The first row of each key in a batch, how many rows it stands for, and whether the key is new to the stream.

    A group is a bucket of keys: its list of keys is read and added to as a whole, not key by key.
    """

    def __init__(self, names: list[str], remember_ms: int | None):
        self.row, self.remember = Row(*names, "copias", "nuevo"), remember_ms

    def init(self, handle) -> None:
        self.seen = handle.getListState("vistos", "clave_sha string", self.remember)

    def handleInputRows(self, key, rows, timers):
        firsts: dict[str, list] = {}
        for row in rows:
            own = tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in quality.ROW_ORDER)
            held = firsts.get(row["clave_sha"])
            if held is None:
                firsts[row["clave_sha"]] = [own, row, 1]
                continue
            held[2] += 1
            if own < held[0]:
                held[:2] = own, row
        usable = {k for k, (_, row, _) in firsts.items() if row["util"]}
        new = usable.difference(k for k, in self.seen.get()) if usable else usable
        if new:
            self.seen.appendList([(k,) for k in sorted(new)])
        for k, (_, row, number) in firsts.items():
            yield self.row(*row, number, k in new or k not in usable)

    def handleInitialState(self, key, row, timers) -> None:
        self.seen.appendList([(k,) for k in row["claves"]])

    def close(self) -> None:
        pass


#: Buckets of keys in the state: a batch reads the lists of those that its own keys fall into.
BUCKETS = 1 << 16
#: Groups that the unusable rows of a batch are dealt into; they have no key.
UNUSABLE_GROUPS = 64
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_keys(requests: DataFrame, earlier: DataFrame, remember_days: float | None = None) -> DataFrame:
    """A stream's rows, one for each key and batch, with ``clave_sha``, ``copias`` and ``nuevo``; ``earlier`` keys are known from the start.

    Keys live in Spark's state store, with a time to live if ``remember_days`` is given; the session then runs no
    batches without data, as every key yet to expire would call for one.
    """
    spark = requests.sparkSession
    if spark.conf.get(_PROVIDER, _ROCKS) != _ROCKS or spark.conf.get(_PROVIDER, None) is None:
        spark.conf.set(_PROVIDER, _ROCKS)
    if remember_days is not None:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    flagged = quality.with_usable(requests)
    spare = F.concat(F.lit("vacio:"), F.pmod(F.xxhash64(*quality.ROW_ORDER), F.lit(UNUSABLE_GROUPS)).cast("string"))
    keyed = flagged.withColumn("clave_sha", F.when(F.col("util"), quality.digest(flagged)).otherwise(spare))
    bucket = F.pmod(F.xxhash64("clave_sha"), F.lit(BUCKETS))
    keyed, known = keyed.withColumn("cubo", bucket), earlier.groupBy(bucket.alias("cubo")).agg(F.collect_set("clave_sha").alias("claves"))
    schema = StructType([*keyed.schema.fields, StructField("copias", LongType()), StructField("nuevo", BooleanType())])
    lifetime = None if remember_days is None else int(remember_days * 86_400_000)
    return keyed.groupBy("cubo").transformWithState(
        FirstOfKey(keyed.columns, lifetime), schema, "Append", "None" if lifetime is None else "ProcessingTime", initialState=known.groupBy("cubo")
    ).drop("cubo")


def start(requests: DataFrame, options: StreamOptions, on_metrics: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Run a stream of requests until what is there now has been processed.

    ``on_metrics`` gets the exact counts of a batch before its results are written; the
    query's own progress shows ``volumen``, rows and blank messages, while it reads.
    """
    spark = requests.sparkSession
    ship_package(spark)
    frame = prepare(requests)
    blank = F.count_if(strip(F.col("mensaje_texto")) == "").alias("mensajes_en_blanco")
    watched = frame.observe("volumen", F.count("*").alias("filas_leidas"), blank)
    if options.across_batches:
        watched = first_of_keys(watched, _known_keys(spark, options), options.remember_days)

    def process(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, options.checkpoint)
        if options.across_batches:
            process_collapsed(batch, number, options, on_metrics, stream)
        else:
            process_batch(batch, number, options, on_metrics, stream)

    writer = watched.writeStream.foreachBatch(process).option("checkpointLocation", options.checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark wrote into the checkpoint when the stream first started."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def process_batch(
    batch: DataFrame,
    number: int,
    options: StreamOptions,
    on_metrics: Callable[[int, dict], None] | None = None,
    stream: str = "manual",
) -> None:
    """One micro-batch without keyed state: duplicates within it, then ``process_collapsed``."""
    dealt = at_least(batch, options.run.min_partitions, *quality.ROW_ORDER)
    collapsed = quality.collapse(dealt)
    process_collapsed(collapsed.withColumns({"clave_sha": quality.digest(collapsed), "nuevo": F.lit(True)}), number, options, on_metrics, stream)


def process_collapsed(
    collapsed: DataFrame,
    number: int,
    options: StreamOptions,
    on_metrics: Callable[[int, dict], None] | None = None,
    stream: str = "manual",
) -> None:
    """Rows that stand for their key (``util``, ``copias``, ``clave_sha``, ``nuevo``): fields, translation, costs, results."""
    spark, run = collapsed.sparkSession, options.run
    home = f"{run.output_path}/lotes"
    place = f"flujo={stream}/lote={number}"
    early = ("original",) if run.optimize_tokens else ("original", "limpio")
    accepted = _written(costing.count_variants(fields.extract_fields(collapsed), run.counter, early), f"{home}/validas/{place}")
    if on_metrics:
        on_metrics(number, quality.collapsed_stats(accepted.withColumn("util", F.when(F.col("nuevo") | ~F.col("util"), F.col("util")))).first().asDict())
    valid = accepted.filter("util AND nuevo").drop("util", "copias", "nuevo")
    valid.select("clave_sha").write.mode("overwrite").parquet(f"{home}/claves/{place}")
    valid = valid.drop("clave_sha")

    if run.optimize_tokens:
        # A second attempt must see the memo as the first one did.
        entry = f"{stream}_{number}"
        texts = _written(translation.distinct_texts(valid), f"{home}/textos/{place}")
        memo = stored_memo.read(spark, run.memo_path, texts, but=entry) if run.memo_path else None
        translated = translation.translations(texts, run.engine, memo, None, run.translate_partitions, run.tokens_per_task)
        named = translated.withColumns({"mensaje_limpio": F.col("texto_origen"), "mensaje_ingles": F.col("texto_destino")})
        counted = costing.count_variants(named, run.counter, ("limpio", "ingles")).drop("mensaje_limpio", "mensaje_ingles")
        table = _written(counted, f"{home}/traducciones/{place}")
        if run.memo_path:
            stored_memo.write(translation.memo_entries(table, run.memo_ttl_days), run.memo_path, entry)
        valid = translation.map_back(valid, table)
    else:
        valid = translation.untranslated(valid)
    results = columns.result_contract(costing.price_rows(valid, run.rate))
    results.write.mode("overwrite").parquet(f"{run.output_path}/resultados/{place}")
    for passed in ("validas", "textos", "traducciones"):
        remove_folder(spark, f"{home}/{passed}/{place}")


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _known_keys(spark: SparkSession, options: StreamOptions) -> DataFrame:
    """Keys that all streams into this output have accepted, read as the initial state of a new stream only."""
    path = f"{options.run.output_path}/lotes/claves"
    keys = spark.read.schema(KEYS_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], KEYS_SCHEMA)
    return keys.select("clave_sha").distinct()


def results(spark: SparkSession, output_path: str) -> DataFrame:
    """All results accepted so far."""
    return spark.read.parquet(f"{output_path}/resultados").drop("flujo", "lote")
