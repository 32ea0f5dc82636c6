"""Workbooks (.xlsx) as a Spark data source: one task reads one workbook, or writes one.

A workbook is a compressed file that cannot be split and holds at most 1,048,576 rows a
sheet, so it is the natural unit of work; parallelism comes from the number of files.
"""

import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from turnera.fixed_values import MISSING_CELL_TEXTS
from turnera.operators.columns import canonical_places
from turnera.session import ship_package

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EPOCH = datetime(1899, 12, 30)
BUILT_IN_DATES = {*range(14, 23), *range(45, 48)}
MAX_ROWS = 1_048_576
ROWS_PER_BATCH = 5_000
SHEET_NAME = "Resultados"


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """First sheets as strings under canonical names, with ``archivo_origen`` and ``fila``."""
    register(spark)
    reader = spark.read.format("workbook").option("files", json.dumps(list(files)))
    headers = reader.option("part", "headers").schema("lugar int, nombre string").load()
    seen = headers.groupBy("nombre").agg({"lugar": "min"}).orderBy("min(lugar)", "nombre")
    names = [r.nombre for r in seen.toLocalIterator() if r.nombre not in ("archivo_origen", "fila")]
    columns = "".join(f", `{n.replace('`', '``')}` string" for n in names)
    return reader.option("part", "rows").schema(f"archivo_origen string, fila bigint{columns}").load()


class WorkbookSource(DataSource):
    """``format("workbook")``: reads the workbooks named in ``files``, writes to ``path``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def reader(self, schema) -> "WorkbookReader":
        files = self.options.get("files")
        return WorkbookReader(json.loads(files) if files else [self.options["path"]], self.options.get("part"), schema)

    def writer(self, schema, overwrite: bool) -> "WorkbookWriter":
        return WorkbookWriter(self.options["path"], schema, overwrite)


@dataclass
class Workbook(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    def __init__(self, files, part, schema):
        self.files, self.part, self.schema = files, part, schema

    def partitions(self):
        return [Workbook(f) for f in self.files]

    def read(self, partition: Workbook):
        system, path = located(partition.path)
        with system.open_input_file(path) as stream, zipfile.ZipFile(stream) as book:
            rows = _sheet_rows(book)
            places = canonical_places(["" if c is None else c for c in next(rows, [])])
            places.pop("", None)
            if self.part == "headers":
                yield from ((place, name) for name, place in places.items())
                return
            wanted = [places.get(f.name) for f in self.schema.fields[2:]]
            number = 0
            while batch := list(islice(rows, ROWS_PER_BATCH)):
                cells = ([None if p is None or p >= len(r) else r[p] for r in batch] for p in wanted)
                columns = [
                    pa.array([partition.path] * len(batch), pa.string()),
                    pa.array(range(number, number + len(batch)), pa.int64()),
                    *(pa.array(c, pa.string()) for c in cells),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)
                number += len(batch)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    for scheme in ("s3a:", "s3n:"):  # Hadoop's names for one store
        path = "s3:" + path.removeprefix(scheme) if path.startswith(scheme) else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[list[str | None]]:
    """Rows of the first sheet, each a list of cell texts by column position."""
    names = set(book.namelist())
    first = next(ElementTree.parse(book.open("xl/workbook.xml")).iter(MAIN + "sheet"))
    links = ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(e.get("Target") for e in links if e.get("Id") == first.get(REL + "id"))
    sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    shared = []
    if "xl/sharedStrings.xml" in names:
        for entry in _elements(book, "xl/sharedStrings.xml", "si"):
            shared.append(_text(entry))
    dates = _date_styles(book) if "xl/styles.xml" in names else frozenset()
    filled = 0
    for row in _elements(book, sheet, "row"):
        number = int(row.get("r", filled + 1))
        while filled and filled + 1 < number:  # rows a sheet leaves out are blank rows
            filled += 1
            yield []
        filled = number
        cells: list[str | None] = []
        for cell in row.iter(MAIN + "c"):
            place = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells.extend([None] * (place - len(cells)))
            cells.append(_cell_text(cell, shared, dates))
        yield cells


def _elements(book: zipfile.ZipFile, part: str, tag: str):
    """Elements of one kind, each freed after use, so a large sheet never sits in memory."""
    events = ElementTree.iterparse(book.open(part), events=("start", "end"))
    _, root = next(events)
    holder = root
    for event, element in events:
        if event == "start" and element.tag == MAIN + "sheetData":
            holder = element
        if event == "end" and element.tag == MAIN + tag:
            yield element
            holder.clear()


def _column(reference: str) -> int:
    number = 0
    for letter in reference:
        if letter.isdigit():
            break
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(element) -> str:
    """The text of a string entry, plain or in formatted runs, without phonetic hints."""
    runs = [element.find(MAIN + "t"), *(r.find(MAIN + "t") for r in element.findall(MAIN + "r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def _date_styles(book: zipfile.ZipFile) -> frozenset[int]:
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {
        int(f.get("numFmtId"))
        for f in root.iter(MAIN + "numFmt")
        if set("ymdh") & set(f.get("formatCode", "").split(";")[0].lower().replace("[red]", ""))
    }
    formats = root.find(MAIN + "cellXfs")
    kinds = [] if formats is None else [int(x.get("numFmtId", 0)) for x in formats]
    return frozenset(i for i, kind in enumerate(kinds) if kind in BUILT_IN_DATES or kind in own)


def _cell_text(cell, shared: list[str], dates: frozenset[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        value = _text(cell.find(MAIN + "is"))
    else:
        stored = cell.find(MAIN + "v")
        if stored is None or stored.text is None or kind == "e":
            return None
        value = stored.text
        if kind == "s":
            value = shared[int(value)]
        elif kind == "b":
            value = "True" if value == "1" else "False"
        elif kind == "n":
            value = _number_text(float(value), int(cell.get("s", 0)) in dates)
    return None if value in MISSING_CELL_TEXTS else value


def _number_text(number: float, is_date: bool) -> str:
    if is_date:
        return str(EPOCH + timedelta(seconds=round(number * 86400)))
    return str(int(number)) if number == int(number) else repr(number)


# --- writing ------------------------------------------------------------------

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    f'<sheet name="{SHEET_NAME}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_FORBIDDEN = {c: None for c in range(32) if c not in (9, 10, 13)} | {0xFFFE: None, 0xFFFF: None}


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WorkbookWriter(DataSourceWriter):
    """One workbook per task, more where a task exceeds a sheet; visible only once all are done."""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite

    def write(self, rows) -> Written:
        system, folder = located(self.path)
        pending = posixpath.join(folder, "_temporary")
        system.create_dir(pending, recursive=True)
        rows, files = iter(rows), []
        for first in rows:
            file = posixpath.join(pending, f"part-{uuid.uuid4().hex}.xlsx")
            with system.open_output_stream(file) as stream:
                self._write_book(stream, first, islice(rows, MAX_ROWS - 2))
            files.append(file)
        return Written(files)

    def _write_book(self, stream, first, rest) -> None:
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
            for part, body in _PARTS.items():
                book.writestr(part, body)
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for row in (self.names, first):
                    sheet.write(_row_xml(row))
                while block := list(islice(rest, 1_000)):
                    sheet.write(b"".join(map(_row_xml, block)))
                sheet.write(b"</sheetData></worksheet>")

    def commit(self, messages) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.is_file and old.extension == "xlsx":
                    system.delete_file(old.path)
        for file in (f for m in messages if m for f in m.files):
            system.move(file, posixpath.join(folder, posixpath.basename(file)))

    def abort(self, messages) -> None:
        system, _ = located(self.path)
        for file in (f for m in messages if m for f in m.files):
            system.delete_file(file)


def _row_xml(row) -> bytes:
    return ("<row>" + "".join(map(_cell_xml, row)) + "</row>").encode()


def _cell_xml(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = escape(str(value).translate(_FORBIDDEN), {"\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
