"""A sink that writes one JSON file a row: all files of a write appear together, or none."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_name(key: str) -> str:
    """`KEY.json`; what a file system might not take is written as %XX, as is a dot or an underscore in front."""
    said = quote(key, safe="")
    return (f"%{ord(said[0]):02X}{said[1:]}" if said[:1] in ("_", ".") else said) + ".json"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class JsonFiles(DataSource):
    """Rows (key, json) become files of a folder that driver and executors share. The folder is replaced as a whole."""

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "key string, json string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"))


class _Writer(DataSourceArrowWriter):
    """Tasks write to a folder beside the one that is named, and it takes that one's place in a single move.

    A file is written under a hidden name and then moved, so that an attempt that is lost leaves no half of a file, and one
    that is made again writes the same files. Tasks tell the driver only how many files they wrote.
    """

    def __init__(self, path: str):
        self.path = path
        parent, _, last = path.rpartition("/")
        self.staged = f"{parent}/.{last}-{uuid4().hex}" if parent or path.startswith("/") else f".{last}-{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, staged = _place(self.staged)
        files.create_dir(staged, recursive=True)
        n = 0
        for batch in iterator:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not key:
                    raise ValueError("a row without a key has no file")
                hidden = f"{staged}/.{uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    out.write((json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n").encode())
                files.move(hidden, f"{staged}/{file_name(key)}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, staged = _place(self.staged)
        _, path = _place(self.path)
        files.create_dir(staged, recursive=True)
        there = files.get_file_info(fs.FileSelector(staged))
        for lost in (f for f in there if f.base_name.startswith(".")):
            files.delete_file(lost.path)
        if sum(m.files for m in messages if m) != sum(not f.base_name.startswith(".") for f in there):
            files.delete_dir(staged)
            raise ValueError(f"{self.path}: rows share a key")
        old = f"{staged}-old"
        before = files.get_file_info(path).type != fs.FileType.NotFound
        if before:
            files.move(path, old)
        files.move(staged, path)
        if before:
            files.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, staged = _place(self.staged)
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


def write_json_files(df: DataFrame, key: str, folder: str) -> None:
    """Writes each row as `KEY.json` of the folder, two spaces an indent, fields that are null left out.

    The folder then holds these files only. Rows that share a key, or have none (null or empty), are an error, and then the
    folder stays what it was; no rows make an empty folder.
    """
    df.sparkSession.dataSource.register(JsonFiles)
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json"))
    rows.write.format("json_files").mode("overwrite").save(folder)
