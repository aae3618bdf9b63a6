"""JSON documents in files of their own: a printer with two spaces a level, and a sink that writes one named file per row."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# The sink runs in tasks also where the library is not installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CONTROLS = [f"{i:02X}" for i in range(32) if f"{i:02X}" != f"{i:02x}"]


def _scalar(value: Column, kind: DataType) -> Column:
    if not isinstance(kind, StringType):
        return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    text = F.to_json(F.array(value))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    for code in _CONTROLS:  # control characters are written in lower case; two backslashes are none of theirs
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return text


def pretty(value: Column, kind: DataType, level: int = 0) -> Column:
    """A value as JSON with members and items on lines of their own, two spaces a level deep; nulls are written, empty arrays and maps take no lines.

    Characters beyond ASCII stay as they are. Members come in the order of the schema, a map's in the order it has.
    """
    inner, outer = "\n" + "  " * (level + 1), "\n" + "  " * level

    def lines(parts: Column, left: str, right: str) -> Column:
        return F.when(F.size(parts) == 0, left + right).otherwise(F.concat(F.lit(left + inner), F.array_join(parts, "," + inner), F.lit(outer + right)))

    if isinstance(kind, StructType):
        parts = F.array(*[F.concat(_scalar(F.lit(f.name), StringType()), F.lit(": "), pretty(value[f.name], f.dataType, level + 1)) for f in kind.fields])
        made = lines(parts, "{", "}")
    elif isinstance(kind, ArrayType):
        made = lines(F.transform(value, lambda x: pretty(x, kind.elementType, level + 1)), "[", "]")
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_scalar(e["key"].cast("string"), StringType()), F.lit(": "), pretty(e["value"], kind.valueType, level + 1))
        made = lines(F.transform(F.map_entries(value), entry), "{", "}")
    else:
        made = _scalar(value, kind)
    return F.when(value.isNull(), "null").otherwise(made)


def pretty_column(df: DataFrame, column: str) -> Column:
    """A column of df as such a document, with a line feed at its end."""
    return F.concat(pretty(F.col(column), df.select(column).schema[0].dataType), F.lit("\n"))


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: names, and the folder its files wait in."""

    folder: str
    names: list[str]


class NamedDocumentWriter(DataSourceWriter):
    """Tasks write to folders of their own beside the target; only the commit moves files to their names, so that a task that is run twice leaves one file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")

    def _store(self, path: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return store, root

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = self._store(posixpath.join(self.staging, uuid.uuid4().hex))
        store.create_dir(root, recursive=True)
        names = []
        for row in iterator:
            if not row.file or "/" in row.file or row.file in (".", ".."):
                raise ValueError(f"not the name of a file: {row.file!r}")
            with store.open_output_stream(f"{root}/{row.file}") as out:
                out.write((row.document or "").encode())
            names.append(row.file)
        return Staged(root, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._store(self.path)
        staged = [(m.folder, n) for m in messages if m is not None for n in m.names]
        names = [n for _, n in staged]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            self.abort(messages)
            raise ValueError(f"several documents of one name: {', '.join(twice[:5])}")
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name not in names:
                    store.delete_file(x.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = self._store(self.staging)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class NamedDocuments(DataSource):
    """format("named-documents"): rows (file, document) as files of these names in one folder."""

    @classmethod
    def name(cls) -> str:
        return "named-documents"

    def schema(self) -> str:
        return "file string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedDocumentWriter:
        return NamedDocumentWriter(self.options["path"], overwrite)


def write_documents(df: DataFrame, path: str) -> None:
    """file, document: each row's document in a file of its name in the folder; files that stood there before go. The same name twice is an error, and nothing is written."""
    df.sparkSession.dataSource.register(NamedDocuments)
    df.select("file", "document").write.format("named-documents").mode("overwrite").save(path)
