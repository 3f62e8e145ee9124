"""A data source for text tables inside zip files: a partition for each file and member, inflated as a stream.

spark.read.format("zipped_text").schema(...) yields string columns by name; rows come in Arrow batches, so a member of any size
needs the memory of a few blocks. Files are opened by pyarrow's file systems on the executors: local, shared and object
stores that it knows. A deflated stream can't be split, so a member is one task: downloads of many files scale by files."""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of text that are parsed at a time.
BLOCK = 1 << 20
#: Columns that tell where a row comes from.
FILE, MEMBER = "_file", "_member"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), posixpath.abspath(path.removeprefix("file:")))


def zips(path: str) -> list[str]:
    """The file at path, or all zip files of a folder, in order."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"nothing at {path}")
    if info.type != pafs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{posixpath.relpath(x.path, place)}" for x in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if x.type == pafs.FileType.File and x.extension == "zip")


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names = schema.fieldNames()
        self.paths, self.members, self.sep = json.loads(options["paths"]), options.get("member", "*"), options.get("sep", ",")
        self.encoding, self.only = options.get("encoding", "utf-8"), json.loads(options.get("only", "{}"))

    def partitions(self) -> Sequence[InputPartition]:
        """Only the directories of the files are read here."""
        out = []
        for path in (p for given in self.paths for p in zips(given)):
            fs, place = opened(path)
            with fs.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                found = [n for n in z.namelist() if not n.endswith("/") and fnmatch.fnmatchcase(n, self.members)]
            if not found:
                raise ValueError(f"no member like {self.members} in {path}")
            out += [Member(path, n) for n in found]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        fs, place = opened(partition.path)
        own = {FILE: partition.path, MEMBER: partition.name}
        with fs.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            stream = io.BufferedReader(raw, BLOCK)
            head = stream.readline().decode(self.encoding).lstrip("﻿").rstrip("\r\n")
            names = [c.strip() for c in next(csv.reader([head], delimiter=self.sep), [])]
            if missing := [c for c in self.names if c not in names and c not in own]:
                raise ValueError(f"columns {missing} are missing from {partition.name} in {partition.path}")
            if not stream.peek(1):
                return
            read = [*dict.fromkeys([*[c for c in self.names if c not in own], *self.only])]
            rows = pacsv.open_csv(
                stream,
                pacsv.ReadOptions(use_threads=False, block_size=BLOCK, column_names=names, encoding=self.encoding),
                pacsv.ParseOptions(delimiter=self.sep),
                pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=read, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
            )
            for batch in rows:
                for column, values in self.only.items():
                    batch = batch.filter(pc.is_in(batch[column], pa.array(values, pa.string())))
                if batch.num_rows:
                    arrays = [pa.array([own[c]] * batch.num_rows, pa.string()) if c in own else batch[c] for c in self.names]
                    yield pa.RecordBatch.from_arrays(arrays, self.names)


class ZippedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_text"

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(schema, self.options)


def zipped_table(spark: SparkSession, path: str | list[str], columns: Sequence[str], member: str = "*", sep: str = ",", encoding: str = "utf-8", only: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The named columns, as strings, of the members like `member` of all zip files at path; an unquoted empty value is null.

    only: by column the values whose rows are kept; others are dropped before they leave the reader. A header that lacks a
    column, a file without such a member and a path with nothing at it are a ValueError."""
    spark.dataSource.register(ZippedText)
    paths = [path] if isinstance(path, str) else list(path)
    options = {"paths": json.dumps(paths), "member": member, "sep": sep, "encoding": encoding, "only": json.dumps({k: list(v) for k, v in (only or {}).items()})}
    return spark.read.format("zipped_text").schema(", ".join(f"`{c}` string" for c in columns)).options(**options).load()
