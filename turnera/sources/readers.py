"""Request tables from files: discovery, reading as strings, union with provenance."""

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.operators.columns import normalize_columns
from turnera.session import ship_package
from turnera.sources.workbook import located, read_workbooks

KINDS = ("xlsx", "parquet", "csv", "json")


class InputError(ValueError):
    """The input path does not hold readable files."""


def discover(spark: SparkSession, path: str, kind: str = "xlsx") -> list[str]:
    """The files of one kind at ``path``: the file itself, or all below the folder, sorted."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = [r.path for r in listing.load(path).select("path").collect()]  # one name a file
    except AnalysisException as missing:
        raise InputError(f"input path does not exist: {path}") from missing
    files = sorted(f for f in found if f.lower().endswith(f".{kind}"))
    if files:
        return files
    if len(found) == 1 and found[0].endswith(path.rstrip("/")):
        raise InputError(f"input file must be .{kind}: {path}")
    raise InputError(f"no .{kind} files in {path}")


def read_requests(
    spark: SparkSession,
    path: str,
    kind: str = "xlsx",
    order: str | None = None,
    same_header: bool = False,
    options: dict | None = None,
) -> DataFrame:
    """All requests at ``path``, every cell a string, with ``archivo_origen`` and ``fila``.

    Parquet files and workbooks number their rows; csv and json need ``order``, a column
    that does.  Names are settled per header before the union, so files that spell a
    column differently meet in one.  ``same_header`` reads a folder whose files all agree
    as one scan; that they do is verified in one distributed job.  ``options`` go to Spark's reader:
    csv is read with quoted line breaks, which keeps a file in one task; where messages
    have none, ``{"multiLine": False}`` lets large files be split.
    """
    return read_files(spark, discover(spark, path, kind), kind, order, same_header, options)


def read_files(
    spark: SparkSession, files: list[str], kind: str, order: str | None = None, same_header: bool = False, options: dict | None = None
) -> DataFrame:
    """``read_requests`` of files that are already known."""
    if kind == "xlsx":
        return read_workbooks(spark, files)
    if order is None and kind != "parquet":
        raise InputError(f"{kind} rows have no position: name a column that orders them")
    groups = [_alike(spark, kind, files)] if same_header else _by_header(spark, kind, files, options)
    return consolidate(_with_provenance(_scan(spark, kind, group, options), order) for group in groups)


def _first_lines(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line, in one distributed job over each file's first block."""
    begin = F.col("_metadata.file_block_start") == 0
    lines = spark.read.text(list(files)).filter(begin).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    groups: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).orderBy("file").collect():
        groups.setdefault(row.line, []).append(row.file)
    return groups


def _alike(spark: SparkSession, kind: str, files: list[str]) -> list[str]:
    """The files, once it is verified that their headers do not differ (json has none)."""
    if kind == "csv" and len(_first_lines(spark, files)) > 1:
        raise InputError("same_header: the first lines of the files differ")
    if kind == "parquet":
        try:
            every = spark.read.option("mergeSchema", True).parquet(*files).columns  # Spark reads the footers in tasks
        except Exception as differing:
            raise InputError("same_header: the files' columns differ in type") from differing
        if every != spark.read.parquet(files[0]).columns:
            raise InputError("same_header: the files' columns differ")
    return files


def _by_header(spark: SparkSession, kind: str, files: Sequence[str], options: dict | None) -> list[list[str]]:
    """Files that spell their columns alike, found in one distributed job; only names of files come to the driver."""
    if kind == "csv":
        return list(_first_lines(spark, files).values())
    if kind == "json":
        return _grouped(_json_keys(spark, files, options)) or [list(files)]
    if any("://" in f and f.split("://")[0] not in FOOTERS for f in files):  # tasks can't open these without Spark
        with ThreadPoolExecutor(8) as pool:
            headers = list(pool.map(lambda f: tuple(_scan(spark, kind, [f], options).dtypes), files))
        return [[f for f, h in zip(files, headers) if h == header] for header in dict.fromkeys(headers)]
    ship_package(spark)
    places = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(places)
    return _grouped(listed.mapInArrow(_footers, "file string, header array<string>"))


#: Schemes that tasks open themselves, for a file's last bytes alone.
FOOTERS = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and types of each parquet file, from its footer."""
    for batch in batches:
        for file in batch["file"].to_pylist():
            system, path = located(file)
            with system.open_input_file(path) as stream:
                schema = pq.read_schema(stream)
            yield pa.RecordBatch.from_pydict({"file": [file], "header": [[f"{field.name}\n{field.type}" for field in schema]]})


def _json_keys(spark: SparkSession, files: Sequence[str], options: dict | None) -> DataFrame:
    """The names that the objects of each json file have, in order of name."""
    whole = str((options or {}).get("multiLine", False)).lower() == "true"
    rows = spark.read.text(list(files), wholetext=whole).select(F.col("_metadata.file_path").alias("file"), "value")
    if whole:
        rows = rows.select("file", F.explode(F.from_json("value", "array<map<string,string>>")).alias("row")).select("file", F.map_keys("row").alias("names"))
    else:
        rows = rows.select("file", F.json_object_keys("value").alias("names"))
    return rows.select("file", F.explode("names").alias("name")).groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("header"))


def _grouped(headers: DataFrame) -> list[list[str]]:
    groups = headers.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return sorted(r.files for r in groups.select("files").collect())


def _scan(spark: SparkSession, kind: str, files: Sequence[str], options: dict | None) -> DataFrame:
    usual = {
        "csv": {"header": True, "multiLine": True, "escape": '"'},
        "json": {"primitivesAsString": True},
        "parquet": {},
    }[kind]
    return spark.read.options(**(usual | (options or {}))).format(kind).load(list(files))


def _with_provenance(frame: DataFrame, order: str | None) -> DataFrame:
    names = {c: f"`{c.replace('`', '``')}`" for c in frame.columns}
    row = F.col(names[order]) if order else F.col("_metadata.row_index")
    return normalize_columns(
        frame.select(
            F.col("_metadata.file_path").alias("archivo_origen"),
            row.cast("bigint").alias("fila"),
            *(F.col(quoted).cast("string").alias(c) for c, quoted in names.items()),
        )
    )


def consolidate(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by canonical column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(normalize_columns, frames))
