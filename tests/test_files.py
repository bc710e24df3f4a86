"""A folder of mixed files: a text or an error for each, and only those of the asked types opened."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom.sources import files

from .test_sources_and_streams import W, packed


def docx(path, text):
    packed(path, {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>"})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    docx(tmp_path / "in/a.docx", "One")
    docx(tmp_path / "in/deep/B.DOCX", "Two")
    (tmp_path / "in/broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "in/scan.jpeg").write_bytes(b"\xff\xd8")
    (tmp_path / "in/page.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/table.csv").write_text("a,b")
    (tmp_path / "in/noextension").write_text("x")
    (tmp_path / "in/empty.docx").write_bytes(b"")
    (tmp_path / "in/_SUCCESS").write_text("")
    return tmp_path / "in"


def test_a_row_for_every_file(spark, folder):
    got = {os.path.basename(r.path): r for r in files.texts(spark, str(folder)).collect()}
    assert set(got) == {"a.docx", "B.DOCX", "broken.xlsx", "scan.jpeg", "page.pdf", "table.csv", "noextension", "empty.docx"}
    assert (got["a.docx"].text, got["B.DOCX"].text, got["scan.jpeg"].text) == ("One\n", "Two\n", "")
    assert "BadZipFile" in got["broken.xlsx"].error and "BadZipFile" in got["empty.docx"].error
    assert (got["table.csv"].error, got["noextension"].error, got["table.csv"].bytes) == ("Unsupported type: CSV", "Unsupported type: ", 3)
    assert all((r.text is None) != (r.error is None) for r in got.values())
    assert files.texts(spark, f"file://{folder}").count() == 8


def test_other_types_are_not_opened(spark, folder, tmp_path):
    df = files.texts(spark, str(folder)).where(F.col("type") == "DOCX")
    assert sorted(os.path.basename(r.path) for r in df.collect()) == ["B.DOCX", "a.docx", "empty.docx"]
    reader = files._Reader({"path": str(folder)})
    left = list(reader.pushFilters([files.In(("type",), ("DOCX", "XLSX")), files.EqualTo(("type",), "XLSX"), files.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and [os.path.basename(p) for x in reader.partitions() for p, _ in x.files] == ["broken.xlsx"]
    # Spark has nothing left to filter, so the source alone has left the others out
    assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_listing_and_sizes(spark, folder):
    rows = files.texts(spark, str(folder), extract="false").collect()
    assert len(rows) == 8 and all(r.text is None and r.error is None for r in rows)
    large = files.texts(spark, str(folder), maxFileBytes=5).where("type = 'XLSX'").first()
    assert "more than is allowed" in large.error


def test_tasks_by_bytes(spark, folder, tmp_path):
    most = 4 * files.OPENING
    shares = files.dealt([(f"f{i:03}", 0) for i in range(10)] + [("g", 10 * most), ("h", 1)], most)
    assert [len(x.files) for x in shares] == [4, 4, 2, 1, 1] and sum((x.files for x in shares), []) == [(f"f{i:03}", 0) for i in range(10)] + [("g", 10 * most), ("h", 1)]
    assert files.texts(spark, str(folder), shareBytes=1).rdd.getNumPartitions() == 8
    (tmp_path / "none").mkdir()
    assert files.texts(spark, str(tmp_path / "none")).count() == 0
