"""Text of office files: DOCX and XLSX read by the standard library inside tasks, a file a row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes that the parts of a file may unpack to together.
MOST_BYTES = 200 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def opened(data: bytes) -> zipfile.ZipFile:
    """The archive, unless it unpacks to more than ``MOST_BYTES``."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    if sum(x.file_size for x in archive.infolist()) > MOST_BYTES:
        raise ValueError("The file unpacks to more than is allowed.")
    return archive


def _said(node: ElementTree.Element) -> str:
    """Text of all runs below a node."""
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in node.iter())


def docx_text(data: bytes) -> str:
    """Paragraphs a line each; rows of tables with bars between trimmed cells."""
    body = ElementTree.fromstring(opened(data).read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            out += [" | ".join(_said(cell).strip() for cell in row.findall(f"{_W}tc")) + "\n" for row in node.iter(f"{_W}tr")]
        elif node.tag == f"{_W}p":
            out.append(_said(node) + "\n")
    return "".join(out)


def xlsx_text(data: bytes) -> str:
    """Each sheet: a title line, then its rows with bars between cells; empty cells stay empty."""
    archive = opened(data)
    names = set(archive.namelist())
    shared = ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    lines = []
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        lines.append(f"=== Sheet: {sheet.get('name')} ===")
        target = targets[sheet.get(f"{_R}id")]
        for row in ElementTree.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                at = 0
                for letter in (x for x in c.get("r", "") if x.isalpha()):
                    at = 26 * at + ord(letter.upper()) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.findtext(f"{_S}v")
                cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v)] if c.get("t") == "s" else v)
            lines.append(" | ".join(cells))
    return "\n".join(lines)


READERS = {"docx": docx_text, "xlsx": xlsx_text}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, error`` of all DOCX and XLSX files below a folder; a file that can't be read gets an error, not a stop."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows.append((p, READERS[p.rsplit(".", 1)[-1].lower()](bytes(content)), None))
                except Exception as e:  # any fault of a file is the file's
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx,DOCX,XLSX}").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")
