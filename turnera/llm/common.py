"""What the operators share: column handling, stage tables, batches of texts."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.session import remove_folder, shared_folder, ship_package


#: Rows in a batch that goes to Python, unless the session sets a number of its own: whole
#: texts are large, and a batch is held several times over.
BATCH_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Let workers import this package, and bound the batches that they are sent."""
    ship_package(spark)
    if spark.conf.get(_ROWS_KEY) == "10000":  # Spark's default
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def require(frame: DataFrame, *names: str) -> None:
    """Fail early, and by name, when an input lacks a column."""
    missing = [n for n in names if n.lower() not in {c.lower() for c in frame.columns}]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def without(frame: DataFrame, *names: str) -> DataFrame:
    """Drop columns of these names in any case; what an operator computes replaces them."""
    gone = {n.lower() for n in names}
    return frame.select(*(frame[f"`{c}`"] for c in frame.columns if c.lower() not in gone))


def unused(frame: DataFrame, name: str) -> str:
    """The name, lengthened until the frame has no such column in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def adding(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name, in any case, is replaced.

    The expressions may read the columns that they replace.
    """
    gone = {n.lower() for n in columns}
    kept = [frame[f"`{c}`"] for c in frame.columns if c.lower() not in gone]
    return frame.select(*kept, *(value.alias(name) for name, value in columns.items()))


def text_of(name: str) -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that lost executors cost no earlier stage."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def tables_of(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/turnera-llm/{spark.sparkContext.applicationId}"


def forget_stored(spark: SparkSession) -> None:
    """Delete this application's stored tables, once no result that rests on them is needed."""
    remove_folder(spark, tables_of(spark))


def stored(frame: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a table that later steps share into the shared folder and read it back."""
    spark = frame.sparkSession
    return stored_at(frame, f"{tables_of(spark)}/{uuid.uuid4().hex}/{label}", compression)


def stored_at(frame: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
