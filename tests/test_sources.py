import zipfile

import pytest
from pyspark.sql import functions as F

from turnera.operators import columns
from turnera.sources import readers, requests, workbook
from tests.conftest import SMALL

CELLS = "archivo_origen", "fila", "paciente_id", "mensaje_texto"


def rows(frame):
    short = F.element_at(F.split("archivo_origen", "/"), -1).alias("archivo")
    return sorted(map(tuple, frame.select(short, "fila", "paciente_id", "mensaje_texto").collect()))


@pytest.fixture
def book(spark, tmp_path):
    """Write a one-workbook folder."""

    def make(frame, folder):
        workbook.register(spark)
        frame.coalesce(1).write.format("workbook").mode("append").save(str(tmp_path / folder))
        return next((tmp_path / folder).glob("*.xlsx"))

    return make


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.xlsx", "sub/a.XLSX", "c.txt"):
        (tmp_path / name).write_text("-")
    assert [f.rsplit("/", 1)[1] for f in readers.discover(spark, str(tmp_path))] == ["b.xlsx", "a.XLSX"]
    assert len(readers.discover(spark, str(tmp_path / "b.xlsx"))) == 1
    with pytest.raises(readers.InputError, match="must be .xlsx"):
        readers.discover(spark, str(tmp_path / "c.txt"))
    with pytest.raises(readers.InputError, match="no .csv"):
        readers.discover(spark, str(tmp_path), "csv")
    with pytest.raises(readers.InputError, match="does not exist"):
        readers.discover(spark, str(tmp_path / "nothing"))


def test_parquet_files_with_different_names_meet(spark, tmp_path):
    one = spark.createDataFrame([("1", "x"), ("2", None)], ["id_paciente", "Mensaje"])
    two = spark.createDataFrame([("y", 3, "c")], ["mensaje_texto", "paciente_id", "ciudad"])
    one.coalesce(1).write.parquet(str(tmp_path / "in/one"))
    two.coalesce(1).write.parquet(str(tmp_path / "in/two"))
    frame = readers.read_requests(spark, str(tmp_path / "in"), "parquet")
    assert frame.columns[:2] == ["archivo_origen", "fila"] and set(dict(frame.drop("fila").dtypes).values()) == {"string"}
    assert [(r[1:]) for r in rows(frame)] in ([(0, "1", "x"), (1, "2", None), (0, "3", "y")], [(0, "3", "y"), (0, "1", "x"), (1, "2", None)])
    assert frame.select("archivo_origen").distinct().count() == 2


def test_csv_and_json_need_an_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,ID_PACIENTE,mensaje\n1,007,"dos\nlíneas, ""sí"""\n2,8,\n')
    (tmp_path / "b.json").write_text('{"n": 5, "paciente_id": 7, "mensaje_texto": "hola"}\n')
    with pytest.raises(readers.InputError, match="name a column"):
        readers.read_requests(spark, str(tmp_path), "csv")
    assert rows(readers.read_requests(spark, str(tmp_path), "csv", order="n")) == [("a.csv", 1, "007", 'dos\nlíneas, "sí"'), ("a.csv", 2, "8", None)]
    assert rows(readers.read_requests(spark, str(tmp_path), "json", order="n", same_header=True)) == [("b.json", 5, "7", "hola")]


def test_workbook_round_trip(spark, book):
    frame = spark.createDataFrame(
        [("P1", "línea 1\nlínea <2> & \"3\"", 5, 2.5, True, None), ("P2", "  bordes ", None, 1e-7, False, "NA")],
        "id_paciente string, mensaje string, n int, x double, b boolean, vacia string",
    )
    path = book(frame, "one")
    read = readers.read_requests(spark, str(path.parent))
    assert read.columns == [*CELLS, "n", "x", "b", "vacia"]
    assert [tuple(r)[1:] for r in read.orderBy("fila").collect()] == [
        (0, "P1", "línea 1\nlínea <2> & \"3\"", "5", "2.5", "True", None), (1, "P2", "  bordes ", None, "1e-07", "False", None),
    ]


def test_workbooks_with_different_headers(spark, book, tmp_path):
    book(spark.createDataFrame([("1", "x")], ["id_paciente", "mensaje_texto"]), "in/one")
    book(spark.createDataFrame([("y", "2", "z")], ["Mensaje ", "Paciente_ID", "ciudad"]), "in/two")
    read = readers.read_requests(spark, str(tmp_path / "in"))
    assert read.rdd.getNumPartitions() == 2
    assert sorted((r.paciente_id, r.mensaje_texto, r.ciudad) for r in read.collect()) == [("1", "x", None), ("2", "y", "z")]
    columns.require_columns(read)


def test_workbook_of_another_program(spark, tmp_path):
    """Shared strings, rich text, dates, blank rows, gaps, formulas and errors."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="z" sheetId="7" r:id="rId9"/><sheet name="o" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="/xl/worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>paciente_id</t></si><si><r><t>mensaje</t></r><r><t>_texto</t></r><rPh><t>no</t></rPh></si><si><t>fecha_solicitada</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/first.xml": f"""<worksheet {main}><sheetData>
            <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>
            <row r="2"><c r="A2"><v>7.0</v></c><c r="B2" t="str"><f>1</f><v>hola</v></c><c r="D2" s="1"><v>45672</v></c></row>
            <row r="4"><c r="B4" t="e"><v>#N/A</v></c><c r="D4" s="2"><v>45672.5</v></c><c r="AA4"><v>1</v></c></row>
            </sheetData></worksheet>""",
    }
    with zipfile.ZipFile(tmp_path / "otro.xlsx", "w") as file:
        for name, body in parts.items():
            file.writestr(name, body)
    read = readers.read_requests(spark, str(tmp_path / "otro.xlsx")).orderBy("fila")
    assert [tuple(r)[1:] for r in read.collect()] == [
        (0, "7", "hola", "2025-01-15 00:00:00"), (1, None, None, None), (2, None, None, "2025-01-15 12:00:00"),
    ]


def test_long_sheets_continue_in_another_workbook(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MAX_ROWS", 11)
    writer = workbook.WorkbookWriter(str(tmp_path), spark.range(1).schema, True)
    done = writer.write(iter([(i,) for i in range(25)]))
    writer.commit([done])
    assert len(list(tmp_path.glob("*.xlsx"))) == 3
    read = readers.read_requests(spark, str(tmp_path))
    assert sorted(int(r.id) for r in read.collect()) == list(range(25))


def test_overwrite_replaces_workbooks(spark, tmp_path):
    workbook.register(spark)
    for n in (5, 2):
        spark.range(n).write.format("workbook").mode("overwrite").save(str(tmp_path / "out"))
    assert readers.read_requests(spark, str(tmp_path / "out")).count() == 2


def test_generated_requests(spark):
    one, many = (requests.generate_from(spark.range(0, 5000, 1, n), "id") for n in (1, 9))
    assert one.exceptAll(many).count() == 0 and one.columns == [
        "id_paciente", "paciente", "ciudad", "especialidad_medica", "fecha_solicitada", "mensaje_texto",
    ]
    row = one.agg(F.avg((F.col("mensaje_texto") == "").cast("int")), F.min("fecha_solicitada"), F.max("fecha_solicitada"), F.countDistinct("especialidad_medica")).first()
    assert 0.08 < row[0] < 0.12 and tuple(row)[1:] == ("2025-01-03", "2025-01-31", 12)
    assert requests.generate(spark, 10, seed=1).exceptAll(requests.generate(spark, 10, seed=2)).count() == 10


def test_derived_view_reaches_every_case(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    view = requests.solicitudes(orders, spark.read.parquet(f"{SMALL}/customer.parquet"))
    assert view.filter(F.col("paciente").isNull()).count() == 0
    counts = view.agg(
        *(F.count_if(c) for c in (F.col("mensaje_texto").isNull(), F.col("mensaje_texto") == "", F.col("mensaje_texto") == "ok", F.col("mensaje_texto") == "hola, gracias!!")),
    ).first()
    assert tuple(counts) == (75, 75, 36, 33)


def test_same_header_is_verified(spark, tmp_path):
    for number, name in enumerate(("mensaje", "Mensaje_Texto")):
        frame = spark.createDataFrame([("1", "P1", "hola")], f"n string, id_paciente string, {name} string").coalesce(1)
        frame.write.mode("append").option("header", True).csv(str(tmp_path / "csv"))
        frame.write.mode("append").parquet(str(tmp_path / "parquet"))
    for kind in ("csv", "parquet"):
        with pytest.raises(readers.InputError, match="same_header"):
            readers.read_requests(spark, str(tmp_path / kind), kind, order="n", same_header=True)
        assert readers.read_requests(spark, str(tmp_path / kind), kind, order="n").filter("mensaje_texto = 'hola'").count() == 2


def test_headers_are_found_in_tasks(spark, tmp_path, monkeypatch):
    """Parquet files that differ in a name or a type, json files that differ in their keys: no file is opened by the driver."""
    from pyspark.sql import functions as F

    frames = [("a", "paciente_id string, mensaje string"), ("b", "ID_PACIENTE string, Mensaje string"), ("c", "paciente_id int, mensaje string")]
    for kind in ("parquet", "json"):
        for i, (name, schema) in enumerate(frames):
            frame = spark.createDataFrame([(i, f"texto {name}")], "n int, m string").select(F.col("n").cast("int" if "int" in schema else "string"), "m")
            frame = frame.toDF(*(c.split()[0] for c in schema.split(", ")))
            (frame.withColumn("orden", F.lit(1)) if kind == "json" else frame).coalesce(1).write.format(kind).save(str(tmp_path / kind / name))
    listed = readers.discover(spark, str(tmp_path / "parquet"), "parquet")
    assert len(readers._by_header(spark, "parquet", listed, None)) == 3
    scans = []
    scan = readers._scan
    monkeypatch.setattr(readers, "_scan", lambda *a: scans.append(a[2]) or scan(*a))
    got = readers.read_requests(spark, str(tmp_path / "parquet"), "parquet")
    assert sorted((r.paciente_id, r.mensaje_texto) for r in got.collect()) == [("0", "texto a"), ("1", "texto b"), ("2", "texto c")] and len(scans) == 3
    scans.clear()
    got = readers.read_requests(spark, str(tmp_path / "json"), "json", order="orden")
    assert sorted((r.paciente_id, r.mensaje_texto) for r in got.collect()) == [("0", "texto a"), ("1", "texto b"), ("2", "texto c")] and len(scans) == 2
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "x.json").write_text('[{"orden": 1,\n "paciente_id": "P", "mensaje": "m"}]')
    (whole / "y.json").write_text('[{"orden": 1,\n "id_paciente": "Q", "mensaje": "m"}]')
    got = readers.read_requests(spark, str(whole), "json", order="orden", options={"multiLine": True})
    assert sorted(r.paciente_id for r in got.collect()) == ["P", "Q"]
