"""Session settings and the shared folder for intermediate tables."""

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods beyond 8000 bytes; the rule chains then run faster
    # as many small methods than inside one stage-wide method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def with_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "turnera"), "zip", root, "turnera")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="turnera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def at_least(frame: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Deal an input out over ``partitions``, if a number is asked for; it moves whole rows.

    Worth it only for an input of fewer splits than there are cores.
    """
    return frame.repartition(partitions, *keys) if partitions else frame


def asked_partitions(spark: SparkSession) -> int | None:
    """The session's own ``turnera.min_partitions``, none by default."""
    asked = spark.conf.get("turnera.min_partitions", None)
    return int(asked) if asked else None


def wanted_partitions(frame: DataFrame, bytes_each: int = 256 << 20) -> int:
    """A number of shuffle partitions for a frame, from plan statistics alone (no job runs)."""
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, -(-size // bytes_each))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
