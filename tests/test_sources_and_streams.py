import zipfile

from paperloom.operators import load
from paperloom.sources import office
from paperloom.streaming import events

from .conftest import DATA

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path, monkeypatch):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    packed(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('One')}<w:tbl><w:tr><w:tc>{p(' x ')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"})
    packed(tmp_path / "b.xlsx", {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="T" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
    })
    (tmp_path / "c.docx").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[1]: r for r in office.texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "One\nx | y\nTwo\n" and got["b.xlsx"].text == "=== Sheet: T ===\nhead |  | 5" and "BadZipFile" in got["c.docx"].error
    monkeypatch.setattr(office, "MOST_BYTES", 10)
    try:
        office.docx_text((tmp_path / "a.docx").read_bytes())
        raise AssertionError
    except ValueError:
        pass


def streamed(spark, df, make, tmp_path):
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    query = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_rate_limits_of_a_stream(spark, tmp_path):
    """All windows that the watermark has passed are the batch's."""
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    got = {tuple(r) for r in streamed(spark, rows, lambda s: events.rate_limited(s, 1, "1 day"), tmp_path).collect()}
    want = {tuple(r) for r in load.rate_limited(rows, 1, "1 day").collect()}
    last = max(r[1] for r in want)
    assert got <= want and {w for w in want if (last - w[1]).days > 1} <= got


def test_first_copies_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'a' END AS workspace_id, concat('h', id % 10) AS file_hash, timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int), 0) AS created_at FROM range(50)")
    assert streamed(spark, rows, events.first_copies, tmp_path).count() == 10
