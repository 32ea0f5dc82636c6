"""The catalogue: every operator as a query over the given tables.

``sol`` is the view of worded requests (``sources.requests.solicitudes``) and ``doc`` the
documents read as messages.  ``turnera.plans.oracle`` states each query once more in SQL.
"""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.functions import rules, text
from turnera.functions.tokens import bpe_counts, pretoken_counts
from turnera.glossary import WORDS
from turnera.operators import columns, costing, fields, quality, report, translation
from turnera.plans import job
from turnera.plans.settings import RunOptions
from turnera.session import asked_partitions, at_least, shared_folder, ship_package, wanted_partitions
from turnera.sources import memo, requests
from turnera.sources.readers import consolidate, read_requests
from turnera.streaming import incremental

ID = ["archivo_origen", "fila"]
#: The files whose translations the memo already holds in the memo queries.
EARLIER_FILES = ("lote_0", "lote_1")
GLOSSARY = translation.glossary_engine(WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of order keys, by plan statistics, that one task words and reads by rule: tens of thousands of rows.
KEYS_EACH = 256 << 10


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def _tasks(keys: DataFrame) -> int | None:
    """Tasks that order keys are dealt to: their file may be a split or two, and a row costs much more than its keys."""
    wanted = asked_partitions(keys.sparkSession) or wanted_partitions(keys, KEYS_EACH)
    return wanted if wanted > 1 else None


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _order_keys(spark, sf_dir)
    return at_least(keys, _tasks(keys))


def sol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.solicitudes(orders(spark, sf_dir))


def sol_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _order_keys(spark, sf_dir)
    return requests.solicitudes(keys, table(spark, sf_dir, "customer"), _tasks(keys))


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = at_least(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), asked_partitions(spark), "doc_id")
    return documents.select(
        F.col("lang").alias("archivo_origen"), F.col("doc_id").alias("fila"),
        F.col("source").alias("paciente_id"), F.col("text").alias("mensaje_texto"),
    )


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated, usable requests, the first of each patient and text."""
    return quality.valid_rows(job.prepare(sol(spark, sf_dir)))


def results(spark: SparkSession, sf_dir: str, optimized: bool = True) -> DataFrame:
    return job.processed(sol(spark, sf_dir), pretoken_counts, GLOSSARY if optimized else None)


def cells(spark: SparkSession, sf_dir: str, optimized: bool = True) -> DataFrame:
    return report.cells(results(spark, sf_dir, optimized))


def sums(spark: SparkSession, sf_dir: str, optimized: bool = True) -> DataFrame:
    """Token sums of all rows; no action or specialty is read for them."""
    frame = quality.valid_rows(job.prepare(sol(spark, sf_dir)))
    engine = GLOSSARY if optimized else None
    counted = job.counted(frame, pretoken_counts, engine)
    return report.whole(counted)


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/turnera/{uuid4().hex}"


def _stored(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# --- one function per catalogue entry ------------------------------------------


def normalize_columns(spark, d):
    renamed = sol(spark, d).select(
        F.col("fila"), F.col("archivo_origen"), F.col("paciente_id").alias(" ID_Paciente "),
        F.col("mensaje_texto").alias("Mensaje"), F.lit("otro").alias("mensaje_texto"),
        F.col("especialidad").alias("Especialidad_Medica"),
    )
    return columns.validated(renamed)


def consolidate_sources(spark, d):
    documents = doc(spark, d).withColumnsRenamed({"paciente_id": "id_paciente", "mensaje_texto": "Mensaje"})
    return consolidate([sol(spark, d), documents])


def clean_messages(spark, d):
    return quality.with_clean(doc(spark, d)).select(*ID, "mensaje_limpio")


def fold_messages(spark, d):
    return doc(spark, d).select(*ID, text.matching_form(F.col("mensaje_texto")).alias("texto_plegado"))


def usable_messages(spark, d):
    return quality.usable(columns.with_message(sol(spark, d))).select(*ID, "mensaje_texto", "mensaje_limpio")


def rejected_messages(spark, d):
    frame = job.prepare(sol(spark, d)).select(*ID, "paciente_id", "mensaje_texto")
    return quality.rejected(frame)


def dedup_messages(spark, d):
    return valid(spark, d).select(*ID, "paciente_id", "mensaje_limpio")


def collapsed_messages(spark, d):
    return quality.collapse(job.prepare(sol(spark, d))).filter("util").select(*ID, "mensaje_limpio", "copias")


def preprocess_stats(spark, d):
    return quality.stats(job.prepare(sol(spark, d)))


def _extracted(field: str):
    def query(spark, d):
        folded = sol(spark, d).select(*ID, text.matching_form(text.present(F.col("mensaje_texto"))).alias("_t"))
        return folded.select(*ID, rules.EXTRACTORS[field]("_t").alias(field))

    return query


def merge_input_fields(spark, d):
    return fields.extract_fields(columns.with_message(sol(spark, d))).select(
        *ID, "accion", "especialidad", "fecha_solicitada", "preferencia_horario"
    )


def clean_and_extract(spark, d):
    frame = fields.extract_fields(quality.with_clean(job.prepare(sol(spark, d))))
    return frame.select(*ID, "mensaje_limpio", "accion", "especialidad", "fecha_solicitada", "preferencia_horario")


def pretoken_messages(spark, d):
    return costing.count_variants(doc(spark, d), pretoken_counts, ("original",)).select(*ID, "tokens_original")


def bpe_token_counts(spark, d):
    cleaned = quality.with_clean(doc(spark, d))
    return costing.count_variants(cleaned, bpe_counts(), ("original", "limpio")).select(
        *ID, "tokens_original", "tokens_limpio"
    )


def distinct_texts(spark, d):
    return translation.distinct_texts(valid(spark, d)).select("texto_origen", "veces")


def memo_keys(spark, d):
    return translation.distinct_texts(valid(spark, d)).select("cache_key", "texto_origen")


def _memo(spark, d) -> DataFrame:
    """The memo after a run over the earlier files."""
    earlier = valid(spark, d).filter(F.col("archivo_origen").isin(*EARLIER_FILES))
    return translation.memo_entries(translation.translations(translation.distinct_texts(earlier), GLOSSARY))


def _stored_memo(spark, d):
    """Texts, and the memo's entries of the prefixes that they have."""
    home = _home(spark)
    memo.write(_memo(spark, d), f"{home}/memo", "primera")
    texts = _texts(spark, d, home)
    return texts, memo.read(spark, f"{home}/memo", texts)


def memo_lookup(spark, d):
    looked = translation.lookup(*_stored_memo(spark, d))
    return looked.select("cache_key", "texto_origen", "texto_destino", "motor")


def memo_misses(spark, d):
    return translation.misses(*_stored_memo(spark, d)).select(
        "cache_key", "texto_origen"
    )


def memo_translations(spark, d):
    texts, known = _stored_memo(spark, d)
    return translation.translations(texts, GLOSSARY, known)


def translate_glossary(spark, d):
    return _translated(spark, valid(spark, d), GLOSSARY)


def _translated(spark, frame, engine):
    """Valid rows and their translations, each computed once."""
    home = _home(spark)
    frame = _stored(frame.select(*ID, "mensaje_limpio"), f"{home}/validas")
    table = _stored(translation.translations(translation.distinct_texts(frame), engine), f"{home}/traducciones")
    return translation.map_back(frame, table).select(*ID, "mensaje_limpio", "mensaje_ingles")


def row_costs(spark, d):
    costs = [f"costo_estimado_{v}" for v in ("original", "limpio", "ingles")]
    return results(spark, d).select(*ID, *costs)


def totals_and_savings(spark, d):
    return report.totals_and_savings(sums(spark, d))


def avg_tokens(spark, d):
    return report.average_tokens(sums(spark, d))


def cost_projection(spark, d):
    return report.projection(sums(spark, d))


def projection_not_optimized(spark, d):
    return report.projection(sums(spark, d, optimized=False))


def dist_acciones(spark, d):
    return report.action_distribution(cells(spark, d))


def dist_especialidades(spark, d):
    return report.specialty_distribution(cells(spark, d))


def top_especialidades(spark, d):
    return report.top_specialties(cells(spark, d))


def variant_comparison(spark, d):
    return report.variant_comparison(sums(spark, d))


def kpi_row(spark, d):
    return report.kpi_row(preprocess_stats(spark, d))


def results_contract(spark, d):
    frame = job.processed(sol_with_names(spark, d), pretoken_counts, GLOSSARY)
    return columns.result_contract(frame)


def results_not_optimized(spark, d):
    frame = job.processed(sol_with_names(spark, d), pretoken_counts)
    return columns.result_contract(frame)


def aggregates_document(spark, d):
    """Every part of the report reads the same small table, so it is written first."""
    home = _home(spark)
    cell, counts = _stored(cells(spark, d), f"{home}/celdas"), _stored(preprocess_stats(spark, d), f"{home}/conteos")
    return report.aggregates_rows(cell, counts)


def _job(spark, d, home, **choices):
    run_options = RunOptions(f"{home}/salida", f"{home}/memo", **choices)
    return job.run(spark, sol_with_names(spark, d), run_options)


def job_results(spark, d):
    return _job(spark, d, _home(spark), rejects=True).results


def job_results_not_optimized(spark, d):
    return _job(spark, d, _home(spark), optimize_tokens=False).results


def latest_aggregates(spark, d):
    home = _home(spark)
    _job(spark, d, home)
    latest = job.latest_aggregates(spark, f"{home}/salida")
    return latest.select("n_procesadas", *(F.col(f"totales.tokens_{v}").alias(f"tokens_{v}") for v in ("original", "limpio", "ingles")))


def _folder_of_requests(spark, d, kind, **options):
    """Requests written as several files with mixed headers, and where."""
    home = _home(spark)
    rows = sol(spark, d).select("archivo_origen", F.col("fila").cast("string").alias("orden"), "paciente_id", "mensaje_texto", "fecha_solicitada", "especialidad")
    plain = rows.filter(~F.col("archivo_origen").isin(*EARLIER_FILES)).drop("archivo_origen")
    other = rows.filter(F.col("archivo_origen").isin(*EARLIER_FILES)).drop("archivo_origen")
    plain.repartition(2).write.options(**options).format(kind).save(f"{home}/entrada/uno")
    other.withColumnsRenamed({"paciente_id": " ID_Paciente", "mensaje_texto": "Mensaje"}).repartition(2).write.options(**options).format(kind).save(f"{home}/entrada/dos")
    return f"{home}/entrada"


def _as_read(frame):
    text = F.coalesce("mensaje_texto", F.lit(""))
    return frame.select(F.col("orden").cast("bigint").alias("fila"), "paciente_id", text.alias("mensaje_texto"), F.nullif("fecha_solicitada", F.lit("")).alias("fecha_solicitada"))


def read_parquet_folder(spark, d):
    return _as_read(read_requests(spark, _folder_of_requests(spark, d, "parquet"), "parquet"))


def read_csv_folder(spark, d):
    folder = _folder_of_requests(spark, d, "csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _as_read(read_requests(spark, folder, "csv", order="orden"))


def read_json_folder(spark, d):
    folder = _folder_of_requests(spark, d, "json", ignoreNullFields=False)
    return _as_read(read_requests(spark, folder, "json", order="orden"))


def _texts(spark, d, home):
    return _stored(translation.distinct_texts(valid(spark, d)), f"{home}/textos")


def _half_expired(spark, d):
    """The memo's entries, half of them expired yesterday."""
    even = F.substring("cache_key", 10, 1).isin(*"02468ace")
    past = F.current_timestamp() - F.expr("interval 1 day")
    return _memo(spark, d).withColumn("expires_at", F.when(even, F.col("expires_at")).otherwise(past))


def memo_second_run(spark, d):
    """What a second run translates anew after half of the first run's entries have expired."""
    home = _home(spark)
    memo.write(_half_expired(spark, d), f"{home}/memo", "primera")
    texts = _texts(spark, d, home)
    second = translation.translations(texts, GLOSSARY, memo.read(spark, f"{home}/memo", texts))
    return second.select("cache_key", "texto_origen", "nuevo")


def memo_compaction(spark, d):
    """A memo of two runs, the same texts in both and half of them expired, compacted prefix by prefix; a later run adds nothing."""
    path = f"{_home(spark)}/memo"
    memo.write(_half_expired(spark, d), path, "primera")
    memo.write(_half_expired(spark, d).withColumn("motor", F.lit("otra")), path, "segunda")
    memo.compact(spark, path)
    memo.write(_half_expired(spark, d).limit(0), path, "vacia")
    return memo.read(spark, path).select("cache_key", "texto_origen", "texto_destino", "motor")


def latest_results(spark, d):
    """Two runs into one output; the second dies after its metrics, so that the first one's results stay the latest."""
    home = _home(spark)
    _job(spark, d, home)

    def die(document):
        raise RuntimeError("killed")

    try:
        job.run(spark, sol_with_names(spark, d).filter("fila % 2 = 0"), RunOptions(f"{home}/salida", f"{home}/memo"), die)
    except RuntimeError as killed:
        if str(killed) != "killed":
            raise
    return job.latest_results(spark, f"{home}/salida")


def run_metrics(spark, d):
    home = _home(spark)
    _job(spark, d, home)
    return job.run_metrics(spark, f"{home}/salida").drop("corrida")


def empty_guards(spark, d):
    """Which guard stops a run of no rows, of rejected rows only, and of all rows."""
    frame = sol(spark, d)
    inputs = {"ninguna": frame.filter("fila < 0"), "rechazadas": frame.filter("fila % 20 = 0"), "todas": frame}
    told = []
    for name, rows in inputs.items():
        counts = quality.stats(job.prepare(rows)).first().asDict()
        try:
            quality.require_rows(counts)
            guard = None
        except quality.NoUsableRowsError as stopped:
            guard = str(stopped)
        told.append((name, counts["filas_leidas"], counts["filas_validas"], guard))
    return spark.createDataFrame(told, "entrada string, filas_leidas bigint, filas_validas bigint, guarda string")


def _upper(batches):
    for texts in batches:
        yield [t.upper() for t in texts]


def batch_engine_translation(spark, d):
    """Of three engines the first whose model is there, as tasks find; upper case stands for a translation."""
    ship_package(spark)
    there, absent = (lambda: True), (lambda: False)
    engines = {
        "local": translation.Engine("local", batches=_upper, available=absent),
        "mayusculas": translation.Engine("mayusculas", batches=_upper, available=there), GLOSSARY.name: GLOSSARY,
    }
    engine = translation.choose_engine("auto", translation.probed(spark, engines), ("local", "mayusculas"))
    return _translated(spark, valid(spark, d), engine)


#: Tokens of a batch in ``budgeted_translation``.
BUDGET = 64


def _strict_upper(batches):
    for texts in batches:
        padded = len(texts) * max(len(t.split()) + 1 for t in texts)
        if padded > BUDGET and len(texts) > 1:
            raise ValueError(f"{padded} tokens in a batch")
        yield [t.upper() for t in texts]


def budgeted_translation(spark, d):
    """An engine that refuses batches beyond its budget gets none; tasks are dealt by tokens."""
    ship_package(spark)
    home = _home(spark)
    engine = translation.Engine("mayusculas", batches=translation.budgeted(_strict_upper, BUDGET))
    found = translation.translations(_texts(spark, d, home), engine, tokens_per_task=4096)
    return found.select("cache_key", "texto_origen", "texto_destino", "veces")


#: Words of the longest phrase in the dictionary of ``translate_dictionary``.
PHRASE_WORDS = 3


def translate_dictionary(spark, d):
    """The texts by a dictionary of about half their own phrases, chosen by digest."""
    home = _home(spark)
    texts = _texts(spark, d, home)
    words = texts.select(F.split(F.lower("texto_origen"), " ").alias("w"))
    places = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(PHRASE_WORDS), F.size("w") - F.col("i") + 1))).alias("n")
    phrases = places.select("w", "i", lengths).select(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("origen")).distinct()
    chosen = phrases.filter(F.substring(F.md5("origen"), 1, 1).isin(*"02468ace"))
    entries = _stored(chosen.withColumn("destino", F.concat(F.lit("<"), "origen", F.lit(">"))), f"{home}/diccionario")
    found = translation.translations(texts, translation.dictionary_engine(entries, PHRASE_WORDS))
    return found.select("cache_key", "texto_origen", "texto_destino", "veces")


def incremental_run(spark, d):
    """The orders file as a stream of requests, through the incremental job."""
    home = _home(spark)
    keys = _order_keys(spark, d)
    arriving = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*").select(*keys.columns)
    options = incremental.StreamOptions(RunOptions(f"{home}/salida", f"{home}/memo"), f"{home}/control")
    incremental.start(requests.solicitudes(at_least(arriving, _tasks(keys))), options).awaitTermination()
    return incremental.results(spark, f"{home}/salida")


def incremental_batches(spark, d):
    """The requests in four deliveries, a batch each, in order; duplicates are dropped across batches."""
    home, keys = _home(spark), _order_keys(spark, d)
    files = -(-(_tasks(keys) or 1) // 4)  # of a delivery
    options = incremental.StreamOptions(RunOptions(f"{home}/salida", f"{home}/memo"), f"{home}/control", across_batches=True)
    for file in range(4):
        part = keys.filter(F.col("o_orderkey") % 4 == file)
        part.repartition(files).write.parquet(f"{home}/entrada/{file}")
        stream = spark.readStream.schema(keys.schema).option("recursiveFileLookup", True).parquet(f"{home}/entrada")
        incremental.start(requests.solicitudes(stream), options).awaitTermination()
    return incremental.results(spark, f"{home}/salida")


def incremental_mixed_headers(spark, d):
    """Files that spell their columns differently, three to a batch, are landed, then run as a stream."""
    home = _home(spark)
    folder = _folder_of_requests(spark, d, "json", ignoreNullFields=False)
    incremental.land(spark, folder, f"{home}/llegadas", f"{home}/control-llegadas", "json", order="orden", files_per_batch=3).awaitTermination()
    lot = F.concat(F.lit("lote_"), (F.col("fila") % 4).cast("string"))  # the file that the request came from at first
    landed = incremental.read_landed(spark, f"{home}/llegadas").withColumn("archivo_origen", lot)
    options = incremental.StreamOptions(RunOptions(f"{home}/salida", f"{home}/memo"), f"{home}/control")
    incremental.start(landed, options).awaitTermination()
    return incremental.results(spark, f"{home}/salida")


def generated_requests(spark, d):
    return requests.generate_from(orders(spark, d), "o_orderkey")


CATALOGUE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_columns": normalize_columns,
    "consolidate_sources": consolidate_sources,
    "clean_messages": clean_messages,
    "fold_messages": fold_messages,
    "usable_messages": usable_messages,
    "rejected_messages": rejected_messages,
    "dedup_messages": dedup_messages,
    "collapsed_messages": collapsed_messages,
    "preprocess_stats": preprocess_stats,
    "extract_accion": _extracted("accion"),
    "extract_especialidad": _extracted("especialidad"),
    "extract_fecha": _extracted("fecha_solicitada"),
    "extract_horario": _extracted("preferencia_horario"),
    "merge_input_fields": merge_input_fields,
    "clean_and_extract": clean_and_extract,
    "pretoken_counts": pretoken_messages,
    "bpe_token_counts": bpe_token_counts,
    "distinct_texts": distinct_texts,
    "memo_keys": memo_keys,
    "memo_lookup": memo_lookup,
    "memo_misses": memo_misses,
    "memo_translations": memo_translations,
    "translate_glossary": translate_glossary,
    "row_costs": row_costs,
    "totals_and_savings": totals_and_savings,
    "avg_tokens": avg_tokens,
    "cost_projection": cost_projection,
    "projection_not_optimized": projection_not_optimized,
    "dist_acciones": dist_acciones,
    "dist_especialidades": dist_especialidades,
    "top_especialidades": top_especialidades,
    "variant_comparison": variant_comparison,
    "kpi_row": kpi_row,
    "results_contract": results_contract,
    "results_not_optimized": results_not_optimized,
    "aggregates_document": aggregates_document,
    "job_results": job_results,
    "job_results_not_optimized": job_results_not_optimized,
    "latest_aggregates": latest_aggregates,
    "read_parquet_folder": read_parquet_folder,
    "read_csv_folder": read_csv_folder,
    "read_json_folder": read_json_folder,
    "memo_second_run": memo_second_run,
    "memo_compaction": memo_compaction,
    "latest_results": latest_results,
    "run_metrics": run_metrics,
    "empty_guards": empty_guards,
    "budgeted_translation": budgeted_translation,
    "translate_dictionary": translate_dictionary,
    "batch_engine_translation": batch_engine_translation,
    "incremental_run": incremental_run,
    "incremental_batches": incremental_batches,
    "incremental_mixed_headers": incremental_mixed_headers,
    "generated_requests": generated_requests,
}
