"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice over its whole tables and the faster run counts.  ``job_*`` are
complete runs of the batch job on generated requests, tables written and report included.
"""

import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnera.functions.tokens import bpe_counts  # noqa: E402
from turnera.plans import job, queries  # noqa: E402
from turnera.plans.settings import RunOptions  # noqa: E402
from turnera.session import shared_folder, with_defaults  # noqa: E402
from turnera.sources import requests  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "clean_messages", "pretoken_counts", "clean_and_extract", "dedup_messages",
    "preprocess_stats", "rejected_messages", "distinct_texts", "memo_translations", "translate_glossary",
    "row_costs", "totals_and_savings", "cost_projection", "dist_especialidades", "results_contract",
    "generated_requests",
)


def session() -> SparkSession:
    builder = with_defaults(SparkSession.builder.master(f"local[{CPUS}]").appName("bench"))
    for key, value in {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
        "turnera.min_partitions": CPUS,  # the tables are single small files
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_query(spark: SparkSession, name: str) -> None:
    queries.CATALOGUE[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()


def run_job(spark: SparkSession, optimized: bool) -> None:
    home = f"{shared_folder(spark)}/bench/{uuid.uuid4().hex}"
    table = requests.generate_from(queries.orders(spark, SF_DIR), "o_orderkey", row="fila")
    placed = table.selectExpr("'generadas' AS archivo_origen", "*")
    options = RunOptions(f"{home}/out", f"{home}/memo", optimize_tokens=optimized, counter=bpe_counts(), min_partitions=int(CPUS))
    job.run(spark, placed, options)


def timed(action, *arguments) -> float:
    seconds = []
    for _ in range(2):
        start = time.perf_counter()
        action(*arguments)
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    spark = session()
    rows = queries.table(spark, SF_DIR, "orders").count()
    times = {name: timed(run_query, spark, name) for name in HEADLINE}
    times["job_optimized"] = timed(run_job, spark, True)
    times["job_not_optimized"] = timed(run_job, spark, False)
    line = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "request_rows": rows,
        "job_rows_per_second": round(rows / times["job_optimized"]),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
