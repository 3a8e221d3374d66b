"""A data source for folders of files: text, Markdown, HTML, DOCX, ODT, RTF and PDF by ``spark.read.format("folder")``.

Partitions hold files of about ``partition_bytes`` together, the largest first; one file is one partition's. Filters on
suffix, name and size (equal, in, and bounds of size) are pushed down and choose files before any is opened; a schema given
by the reader chooses the columns, and content is read only for ``text`` or ``content``. A file that can't be converted has
a null text and an error. Paths are those of the executors' file systems (local, or what pyarrow opens by URI).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

COLUMNS = "path string, name string, suffix string, size long, modified timestamp, text string, content binary, error string"
_BOUNDS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Files(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


def dealt(files: list[tuple], most: int) -> list[list[tuple]]:
    """Files (size in the fourth place) in groups of at most ``most`` bytes, or of one file."""
    out: list[list[tuple]] = []
    held = most + 1
    for file in sorted(files, key=lambda f: (-f[3], f[0])):
        if held + file[3] > most or not out:
            out.append([])
            held = 0
        out[-1].append(file)
        held += file[3] + 1
    return out


def converted(name: str, content: bytes) -> str | None:
    """A file's text as Markdown, by its suffix; None for what isn't read."""
    from ..operators import convert, pdf

    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "pdf":
        return convert.pdf_text_markdown("\f".join(pdf.read(content)[0]))
    return convert.to_markdown(kind, content)


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, most: int, schema: StructType):
        self.folder, self.most, self.schema, self.chosen = folder, most, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("suffix", "name", "size") and isinstance(f, EqualTo | In) or (column == "size" and type(f) in _BOUNDS):
                self.chosen.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for f in self.chosen:
            own = row[f.attribute[0]]
            if not (own in f.value if isinstance(f, In) else own == f.value if isinstance(f, EqualTo) else _BOUNDS[type(f)](own, f.value)):
                return False
        return True

    def _files(self) -> list[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        out = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            suffix = info.base_name.rsplit(".", 1)[1].lower() if "." in info.base_name else ""
            row = {"name": info.base_name, "suffix": suffix, "size": info.size}
            if self._wanted(row):
                out.append((info.path, info.base_name, suffix, info.size, info.mtime))
        return out

    def partitions(self) -> list[Files]:
        return [Files(files) for files in dealt(self._files(), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        names = self.schema.fieldNames()
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        for path, name, suffix, size, modified in partition.files:
            row = {"path": path, "name": name, "suffix": suffix, "size": size, "modified": modified or datetime.datetime.fromtimestamp(0, datetime.UTC), "text": None, "content": None, "error": None}
            if {"text", "content", "error"} & set(names):
                with store.open_input_stream(path) as file:
                    content = file.read()
                row["content"] = content
                if {"text", "error"} & set(names):
                    try:
                        row["text"] = converted(name, content)
                    except Exception as e:  # a damaged file of any format is its own row's error
                        row["error"] = f"{type(e).__name__}: {e}"
            yield tuple(row[n] for n in names)


class FolderSource(DataSource):
    """``spark.read.format("folder").load(path)``; option ``partition_bytes`` (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("partition_bytes", 64 << 20)), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    from ..shipping import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
