import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnera.session import with_defaults  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = with_defaults(SparkSession.builder.master("local[4]"))
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows as a table of strings, with a row order."""

    def make(rows, names="paciente_id, mensaje_texto"):
        names = [n.strip() for n in names.split(",")]
        schema = "archivo_origen string, fila bigint, " + ", ".join(f"`{n}` string" for n in names)
        placed = [("a", i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        return spark.createDataFrame(placed, schema)

    return make
