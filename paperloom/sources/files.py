"""Text of files of any type below a folder, as a data source: ``spark.read.format("paperloom_files")``.

Rows: ``path, type, bytes, text, error``, one for every file. DOCX and XLSX files are read, images have an empty text
(recognition is another step), and every other file is an error of its row, as is one that can't be read or is too large.

Files are dealt out to tasks by bytes. A filter on ``type`` (``=`` or ``IN``) reaches the source: files of other types are
listed, not opened. If no ``text`` or ``error`` is wanted, pass ``extract=false``, and no file is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ..functions.rules import FILE_TYPES
from . import office

SCHEMA = "path string, type string, bytes long, text string, error string"
#: A file's share of a task beyond its bytes: opening it costs as much as reading this many.
OPENING = 4 << 20
_TYPES = {e: t for t, extensions in FILE_TYPES.items() for e in extensions}
_READERS = {"DOCX": office.docx_text, "XLSX": office.xlsx_text}
_IMAGES = ("JPG", "PNG")


def type_of(path: str) -> str:
    """The type by the extension, of any case; an unknown extension in capitals, none as an empty text."""
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
    return _TYPES.get(extension, extension.upper())


@dataclass
class _Files(InputPartition):
    """What one task reads: places and sizes."""

    files: list[tuple[str, int]]


def dealt(files: list[tuple[str, int]], most: int) -> list[_Files]:
    """Files in the order of their places, cut where a share would go beyond ``most`` bytes; a larger file is its own."""
    out: list[_Files] = []
    weight = most
    for path, size in sorted(files):
        cost = size + OPENING
        if weight + cost > most or not out:
            out.append(_Files([]))
            weight = 0
        out[-1].files.append((path, size))
        weight += cost
    return out


def _open_folder(uri: str):
    """The file system of a place, by its scheme, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_share = int(options.get("sharebytes", 128 << 20))
        self.most_file = int(options.get("maxfilebytes", office.MOST_BYTES))
        self.extract = options.get("extract", "true").lower() == "true"
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("path",), ("type",), ("bytes",)):
                continue  # these are never null
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("type",):
                yield f
            else:
                self.types = asked if self.types is None else self.types & asked

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        files, place = _open_folder(self.path)
        found = files.get_file_info(fs.FileSelector(place, recursive=True))
        wanted = [(x.path, x.size) for x in found if x.is_file and not x.base_name.startswith((".", "_")) and (self.types is None or type_of(x.path) in self.types)]
        return dealt(wanted, self.most_share) or [_Files([])]

    def _one(self, files, path: str, size: int, kind: str) -> tuple[str | None, str | None]:
        if kind in _IMAGES:
            return "", None
        if kind not in _READERS:
            return None, f"Unsupported type: {kind}"
        if size > self.most_file:
            return None, f"The file has {size} bytes, more than is allowed."
        try:
            with files.open_input_file(path) as f:
                return _READERS[kind](f.read()), None
        except Exception as e:  # any fault of a file is the file's
            return None, f"{type(e).__name__}: {e}"

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _open_folder(self.path)
        for path, size in partition.files:
            kind = type_of(path)
            text, error = self._one(files, path, size, kind) if self.extract else (None, None)
            yield path, kind, size, text, error


class Files(DataSource):
    """Options: the place (local, or a URI that pyarrow knows), ``shareBytes`` a task, ``maxFileBytes``, ``extract``."""

    @classmethod
    def name(cls) -> str:
        return "paperloom_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of all files below ``path``. Filters on ``type`` are pushed where the session allows it to Python sources."""
    spark.dataSource.register(Files)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(Files.name()).options(**options).load(path)
