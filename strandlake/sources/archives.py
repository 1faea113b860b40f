"""Members of ZIP archives as a Python data source: central directories are listed, and only wanted members are read.

Archives are opened by Arrow's file systems, which read byte ranges. The driver reads the directories at the
archives' ends; a task seeks to each of its members. Filters on the member's name and the option ``members`` leave others unread.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from . import dcd

SCHEMA = "path string, member string, size long, content binary"
#: Compressed bytes of the members of one task, and content bytes of a batch.
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 8 << 20


class _Members(InputPartition):
    def __init__(self, path: str, place: str, names: list[str]):
        super().__init__((path, place, tuple(names)))
        self.path, self.place, self.names = path, place, names


class ZipSource(DataSource):
    """Format ``zip_members``; options path (an archive or a folder of them), members (a glob of names), pushdown ("true", as of ``dcd``)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushReader if self.options.get("pushdown", "false") == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("members", "*")
        self.tests: list = []

    def _archives(self) -> list[tuple[str, str]]:
        system, place, prefix = dcd._prefix(self.path)
        info = system.get_file_info(place)
        if info.type == dcd.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == dcd.fs.FileType.File:
            return [(self.path, place)]
        return [(prefix + f.path, f.path) for f in sorted(system.get_file_info(dcd.fs.FileSelector(place)), key=lambda f: f.path) if f.path.endswith(".zip")]

    def partitions(self) -> list[InputPartition]:
        system, out = dcd._prefix(self.path)[0], []
        for path, place in self._archives():
            with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for m in z.infolist():
                    if m.is_dir() or not fnmatch.fnmatchcase(m.filename, self.glob) or not all(t(m.filename) for t in self.tests):
                        continue
                    if held and size + m.compress_size > SPLIT_BYTES:
                        out.append(_Members(path, place, held))
                        held, size = [], 0
                    held.append(m.filename)
                    size += m.compress_size
                if held:
                    out.append(_Members(path, place, held))
        return out

    def read(self, part: _Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        rows, held = [], 0
        with dcd._prefix(part.path)[0].open_input_file(part.place) as f, zipfile.ZipFile(f) as z:
            for name in part.names:
                data = z.read(name)
                rows.append((part.path, name, len(data), data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("member",) or not isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(f.value.__eq__)
            elif isinstance(f, In):
                self.tests.append(frozenset(f.value).__contains__)
            else:
                self.tests.append(lambda n, f=f: n.startswith(f.value) if isinstance(f, StringStartsWith) else n.endswith(f.value))


def read_zip(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    """path, member, size, content of the members of an archive, or of a folder's archives, whose names fit the glob ``members``."""
    spark.dataSource.register(ZipSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("zip_members").option("path", path).option("members", members).option("pushdown", push).load()


def read_texts(spark: SparkSession, path: str, members: str = "*.pdb") -> DataFrame:
    """path (archive and member), text: what :func:`readers.read_text` takes."""
    return read_zip(spark, path, members).select(F.concat("path", F.lit("!"), "member").alias("path"), F.decode("content", "utf-8").alias("text"))
