"""The composed batch job.

Row data is shuffled once to drop duplicates and once to meet its translation; the
distinct texts are shuffled once to be found and once to meet the memo.  Each stage that
several later ones read is written to the shared folder, so nothing is computed twice
and a lost executor costs only its own tasks.  A run writes into a folder of its own and is
published at its end; one that dies leaves the results of the former run in place.
"""

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.operators import columns, costing, fields, quality, report, translation
from turnera.plans.settings import RunOptions
from turnera.session import at_least, remove_folder, shared_folder, ship_package
from turnera.sources import memo as stored_memo
from turnera.sources import published

RUNS = "corridas"
METRICS_SCHEMA = (
    "corrida string, filas_leidas bigint, filas_descartadas_vacio bigint, duplicados_eliminados bigint, filas_validas bigint, "
    "filas_escritas bigint, tokens_original bigint, tokens_limpio bigint, tokens_ingles bigint"
)


@dataclass(frozen=True)
class RunResult:
    """Where a run left its tables, and its one-row statistics."""

    run_id: str
    stats: dict
    results: DataFrame
    aggregates: DataFrame
    rejects: DataFrame | None = None
    path: str = ""


def prepare(requests: DataFrame) -> DataFrame:
    """Validated requests with their row order, without columns that a run computes."""
    frame = columns.without_computed(columns.validated(requests))
    missing = [c for c in quality.ROW_ORDER if c not in frame.columns]
    if missing:
        raise columns.MissingColumnsError(f"requests need {missing} to tell which row comes first")
    return frame


def processed(
    requests: DataFrame,
    counter,
    engine: translation.Engine | None = None,
    memo: DataFrame | None = None,
    rate=fixed.RATE_USD_PER_MILLION,
) -> DataFrame:
    """The whole row pipeline as one lazy plan, without intermediate tables."""
    valid = quality.valid_rows(prepare(requests))
    return costing.price_rows(counted(fields.extract_fields(valid), counter, engine, memo), rate)


def counted(valid: DataFrame, counter, engine: translation.Engine | None, memo: DataFrame | None = None) -> DataFrame:
    """Valid rows, translated if there is an engine, with the tokens of each variant."""
    if engine is None:
        plain = costing.count_variants(translation.untranslated(valid).drop("tokens_ingles"), counter, ("original", "limpio"))
        return plain.withColumn("tokens_ingles", F.lit(None).cast("int"))
    return costing.count_variants(translation.translate(valid, engine, memo), counter)


def run(
    spark: SparkSession,
    requests: DataFrame,
    options: RunOptions,
    on_metrics: Callable[[dict], None] | None = None,
) -> RunResult:
    """Process ``requests`` and write results, report tables and, on request, rejects."""
    ship_package(spark)
    run_id = uuid.uuid4().hex[:12]
    stage = f"{shared_folder(spark)}/turnera/{run_id}"
    result = _run(spark, requests, options, on_metrics, run_id, stage)
    if not options.keep_stages:
        remove_folder(spark, stage)
    return result


def _run(spark: SparkSession, requests: DataFrame, options: RunOptions, on_metrics, run_id: str, stage: str) -> RunResult:
    prepared = at_least(prepare(requests), options.min_partitions, *quality.ROW_ORDER)
    order, home = list(quality.ROW_ORDER), f"{options.output_path}/{RUNS}/{run_id}"
    if options.rejects:  # rows that share their place are told apart, so that results and rejects agree on the first
        prepared = quality.with_print(prepared)
        order.append(quality.ROW_PRINT)

    # 1. Clean, drop duplicates, extract, count what needs no translation.
    wanted = [c for c in prepared.columns if c in order or c in fixed.RESULT_COLUMNS]
    collapsed = fields.extract_fields(quality.collapse(prepared.select(*wanted), order))
    early = ("original",) if options.optimize_tokens else ("original", "limpio")
    valid = _written(costing.count_variants(collapsed, options.counter, early), f"{stage}/validas")
    stats = quality.require_rows(quality.collapsed_stats(valid).first().asDict())
    valid = valid.filter("util").drop("util", "copias")

    # 2. Translate distinct texts; their tokens are counted here, once per text.
    engine_name = "none"
    if options.optimize_tokens:
        engine_name = options.engine.name
        texts = translation.distinct_texts(valid)
        memo = None
        if options.memo_path:
            texts = _written(texts, f"{stage}/textos")
            memo = stored_memo.read(spark, options.memo_path, texts)
        translated = translation.translations(texts, options.engine, memo, None, options.translate_partitions, options.tokens_per_task)
        named = translated.withColumns({"mensaje_limpio": F.col("texto_origen"), "mensaje_ingles": F.col("texto_destino")})
        tokens = costing.count_variants(named, options.counter, ("limpio", "ingles"))
        table = _written(tokens.drop("mensaje_limpio", "mensaje_ingles"), f"{stage}/traducciones")
        if options.memo_path:
            stored_memo.write(translation.memo_entries(table, options.memo_ttl_days), options.memo_path, run_id)
        cell = report.cells_of_texts(valid, table)
        valid = translation.map_back(valid, table)
    else:
        valid = translation.untranslated(valid)
        cell = report.cells(valid)

    # 3. Everything the report says out of one small table, then the results.
    cell = _written(cell, f"{home}/celdas")
    counts = spark.createDataFrame([stats])
    document = report.aggregates_document(
        cell, counts, engine_name, options.optimize_tokens, options.messages_per_day, options.rate
    )
    if on_metrics:
        on_metrics(document.first().asDict(recursive=True))
    results = columns.result_contract(costing.price_rows(valid, options.rate))
    written = Observation(f"resultados-{run_id}")
    sums = (F.sum(f"tokens_{v}").alias(f"tokens_{v}") for v in fixed.VARIANTS)
    results = _written(results.observe(written, F.count("*").alias("filas_escritas"), *sums), f"{home}/resultados")
    metrics = {"corrida": run_id, **stats, **{k: v or 0 for k, v in written.get.items()}}
    _written(spark.createDataFrame([metrics], METRICS_SCHEMA), f"{home}/metricas")
    _write_report(cell, counts, document, options, home)

    # 4. Optional outputs.
    rejects = None
    if options.rejects:
        rejects = _written(quality.rejected(prepared, order), f"{home}/rechazos")
    if options.export_format:
        export(results, f"{home}/{options.export_format}", options.export_format)

    # 5. All of it counts from here on, or none.
    published.publish(spark, options.output_path, lambda before: [run_id])
    return RunResult(run_id, stats, results, document, rejects, home)


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _write_report(cell: DataFrame, counts: DataFrame, document: DataFrame, options: RunOptions, home: str) -> None:
    tables = {
        "agregados_filas": report.aggregates_rows(cell, counts, options.messages_per_day, options.rate),
        "distribucion_acciones": report.action_distribution(cell),
        "distribucion_especialidades": report.specialty_distribution(cell),
        "proyeccion": report.projection(cell, options.messages_per_day, rate=options.rate),
        "comparacion": report.variant_comparison(cell, options.rate),
    }
    writes = [partial(t.write.mode("overwrite").parquet, f"{home}/{name}") for name, t in tables.items()]
    body = document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False)
    writes.append(partial(body.json, f"{home}/agregados"))
    with ThreadPoolExecutor(len(writes)) as pool:  # small, independent jobs
        list(pool.map(lambda write: write(), writes))


def export(results: DataFrame, path: str, kind: str) -> None:
    """Write results as xlsx, csv or json, one file per task."""
    if kind == "xlsx":
        from turnera.sources import workbook

        workbook.register(results.sparkSession)
        results.write.format("workbook").mode("overwrite").save(path)
    else:
        results.write.mode("overwrite").option("header", True).format(kind).save(path)


class NoResultsError(ValueError):
    """No run has been published yet."""


def latest_run(spark: SparkSession, output_path: str) -> str:
    """The folder of the last run that was published."""
    runs = published.current(spark, output_path)
    if not runs:
        raise NoResultsError(f"no published run in {output_path}")
    return f"{output_path}/{RUNS}/{runs[-1]}"


def latest_results(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.parquet(f"{latest_run(spark, output_path)}/resultados")


def run_metrics(spark: SparkSession, output_path: str) -> DataFrame:
    """What the last run observed: rows read and left out, and rows and tokens as they were written."""
    return spark.read.schema(METRICS_SCHEMA).parquet(f"{latest_run(spark, output_path)}/metricas")


def latest_aggregates(spark: SparkSession, output_path: str) -> DataFrame:
    """The aggregates document of the last run, with the time it was written."""
    read = spark.read.json(f"{latest_run(spark, output_path)}/agregados")
    return read.select("*", F.col("_metadata.file_modification_time").alias("ultima_ejecucion"))


def remove_former_runs(spark: SparkSession, output_path: str) -> None:
    """Delete the folders of all runs but the published one, also of those still going on."""
    kept = latest_run(spark, output_path)
    for name in published.folders(spark, f"{output_path}/{RUNS}"):
        if not kept.endswith(f"/{name}"):
            remove_folder(spark, f"{output_path}/{RUNS}/{name}")
