"""Immutable parts under one pointer that moves at once.

Writers put what they compute into folders of their own, which no reader looks into yet.
``publish`` then adds the next numbered version: a list of the parts that count from now on.
A version is written beside its place and moved there without overwriting.  So a reader sees
the former version or the new one, never a half; what a run that died has written is never
seen; and of two writers that publish at once one finds the number taken, reads the other's
version and adds its own change to that.
"""

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_versiones"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at ``path``, sorted; none if it does not exist."""
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(_path(spark, path)) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def _latest(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    files, place = _files(spark, root), f"{root}/{FOLDER}"
    if not files.exists(_path(spark, place)):
        return 0, []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, place))]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return 0, []
    stream = files.open(_path(spark, f"{place}/{max(numbers):012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return max(numbers), json.loads(text)["partes"]


def current(spark: SparkSession, root: str) -> list[str]:
    """The parts of the latest version, none before the first."""
    return _latest(spark, root)[1]


def publish(spark: SparkSession, root: str, change: Callable[[list[str]], list[str]], attempts: int = 50) -> list[str]:
    """Add a version: ``change`` of the parts of the one before.  It may be asked again when another writer came first."""
    files, hadoop = _files(spark, root), spark._jvm.org.apache.hadoop.fs
    files.mkdirs(_path(spark, f"{root}/{FOLDER}"))
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    for _ in range(attempts):
        number, before = _latest(spark, root)
        parts = change(list(before))
        draft = _path(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps({"partes": parts}).encode()))
        stream.close()
        try:
            context.rename(draft, _path(spark, f"{root}/{FOLDER}/{number + 1:012d}.json"), spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
            return parts
        except Py4JJavaError as failure:
            files.delete(draft, False)
            if "FileAlreadyExistsException" not in failure.java_exception.getClass().getName():
                raise
    raise RuntimeError(f"{root}: other writers published {attempts} times in between")


def forget_versions(spark: SparkSession, root: str, keep: int = 20) -> None:
    """Delete all but the latest versions' lists (not the parts)."""
    files, place = _files(spark, root), f"{root}/{FOLDER}"
    last = _latest(spark, root)[0]
    for status in files.listStatus(_path(spark, place)):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith(".") and int(name.removesuffix(".json")) <= last - keep:
            files.delete(status.getPath(), False)
