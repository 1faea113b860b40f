"""Binary trajectory files as a Python data source: batch and streaming scans split by bytes, and a writer.

Records are framed by their length on both sides (32-bit little endian). After the header records, each frame has an
optional unit-cell record and three coordinate records, so frames have one size and a file splits at any frame. Paths
with a scheme go through Arrow's file systems; the driver lists files and sizes only, and each task reads its file's header.

A scan reads only what is asked for: a range of frames (option or pushed filter) is a range of bytes, filters on the path
leave whole files out, and with a subset of the atoms a task seeks from one wanted span of a record to the next. How many
frames a file has follows from its size, not from its header, so files may grow; a stream remembers how many frames
of each file it has given out, and leaves a frame that is not whole for later.

The writer's tasks write files of their own, header and all, which the driver renames when all tasks have ended.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.geometry import pseudo_strand

SCHEMA = "path string, frame_idx long, cell struct<a:double,gamma:double,b:double,beta:double,alpha:double,c:double>, x array<float>, y array<float>, z array<float>"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Bytes between two wanted spans that are read rather than sought over.
GAP_BYTES = 4096
#: Bytes of a file that the writer makes; a task holds one.
FILE_BYTES = 64 << 20
_CELL = ("a", "gamma", "b", "beta", "alpha", "c")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Cut(ValueError):
    """The file ends within a record."""


def _record(f) -> bytes:
    head = f.read(4)
    if len(head) < 4:
        raise Cut("the file is cut")
    n = struct.unpack("<i", head)[0]
    if n < 0:
        raise ValueError("a record of negative length")
    body = f.read(n)
    tail = f.read(4)
    if len(body) < n or len(tail) < 4:
        raise Cut("the file is cut")
    if tail != head:
        raise ValueError("record lengths differ")
    return body


def _header(f, size: int, path: str) -> dict:
    h = _record(f)
    if len(h) != 84 or h[:4] not in (b"CORD", b"VELD"):
        raise ValueError(f"{path}: not a trajectory header")
    frames, first, every = struct.unpack_from("<3i", h, 4)
    step, cell = struct.unpack_from("<fi", h, 40)
    _record(f)
    (atoms,) = struct.unpack("<i", _record(f))
    start = f.tell()
    one = 3 * (8 + 4 * atoms) + (56 if cell else 0)
    rest = size - start
    return {"magic": h[:4].decode(), "declared": frames, "first": first, "every": every, "step": step, "cell": bool(cell), "version": struct.unpack_from("<i", h, 80)[0], "atoms": atoms, "start": start, "size": one, "frames": rest // one, "cut": rest % one != 0}


def header(path: str) -> dict:
    """Magic, declared frames, first step, interval, time step, cell flag, version, atoms, and where frames begin."""
    system, place = _place(path)
    with system.open_input_file(place) as f:
        return _header(f, f.size(), path)


class _Split(InputPartition):
    """The frames of a file that begin in bytes lo to hi and have numbers first to last (of all if these are none)."""

    def __init__(self, path: str, name: str, lo: int, hi: int, first: int = 0, last: int | None = None):
        super().__init__((path, name, lo, hi, first, last))
        self.path, self.name, self.lo, self.hi, self.first, self.last = path, name, lo, hi, first, last


def _prefix(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, place in it, and what stands before places of it in names."""
    system, place = _place(path)
    return system, place, path[: len(path) - len(place)] if path.endswith(place) else ""


def _files(path: str) -> list[tuple[str, fs.FileInfo]]:
    """Full name and information of the file, or of all trajectory files in the folder, by name."""
    system, place, prefix = _prefix(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info)]
    found = (f for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".dcd") and not f.base_name.startswith((".", "_")))
    return [(prefix + f.path, f) for f in sorted(found, key=lambda f: f.path)]


def _spans(atoms: list[int], total: int, pre: int) -> list[tuple[int, int]]:
    """Byte ranges of a frame that hold its record marks and the wanted atoms, with gaps of at most ``GAP_BYTES`` in them."""
    width = 4 * total
    want = [(0, 4), (52, 56)] if pre else []
    for c in range(3):
        at = pre + c * (8 + width)
        want += [(at, at + 4), *[(at + 4 + 4 * a, at + 8 + 4 * a) for a in atoms], (at + 4 + width, at + 8 + width)]
    if pre:
        want.append((4, 52))  # the cell is small
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(want):
        if out and lo - out[-1][1] <= GAP_BYTES:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _batches(f, h: dict, name: str, first: int, last: int, atoms: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Frames first to last of an open file."""
    n, pre = h["atoms"], 56 if h["cell"] else 0
    if atoms is not None and any(not 0 <= a < n for a in atoms):
        raise IndexError(f"{name}: atoms 0 to {n - 1}, not {[a for a in atoms if not 0 <= a < n]}")
    pick = None if atoms is None else np.array(atoms, np.int64)
    spans = [(0, h["size"])] if atoms is None else _spans(sorted(set(atoms)), n, pre)
    if sum(hi - lo for lo, hi in spans) * 2 > h["size"]:
        spans = [(0, h["size"])]
    many = max(1, BATCH_BYTES // h["size"])
    kind = pa.struct([(c, pa.float64()) for c in _CELL])
    for at in range(first, last, many):
        k = min(many, last - at)
        if spans == [(0, h["size"])]:
            f.seek(h["start"] + at * h["size"])
            raw = np.frombuffer(f.read(k * h["size"]), np.uint8).reshape(k, -1)
        else:
            raw = np.zeros((k, h["size"]), np.uint8)
            for i in range(k):
                for lo, hi in spans:
                    f.seek(h["start"] + (at + i) * h["size"] + lo)
                    raw[i, lo:hi] = np.frombuffer(f.read(hi - lo), np.uint8)
        marks = [*([(0, 48), (52, 48)] if pre else []), *[(pre + c * (8 + 4 * n) + e, 4 * n) for c in range(3) for e in (0, 4 + 4 * n)]]
        if any((np.ascontiguousarray(raw[:, o : o + 4]).view("<i4") != size).any() for o, size in marks):
            raise ValueError(f"{name}: record lengths differ")
        xyz = [np.ascontiguousarray(raw[:, pre + c * (8 + 4 * n) + 4 :][:, : 4 * n]).view("<f4") for c in range(3)]
        xyz = [c if pick is None else c[:, pick] for c in xyz]
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * xyz[0].shape[1])
        cells = np.ascontiguousarray(raw[:, 4:52]).view("<f8") if pre else None
        cell = pa.StructArray.from_arrays([pa.array(cells[:, c]) for c in range(6)], fields=list(kind)) if pre else pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(at, at + k)), cell, *[pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(c).ravel())) for c in xyz]], names=["path", "frame_idx", "cell", "x", "y", "z"])


class DcdSource(DataSource):
    """Format ``dcd``, for batch and streaming reads and writes. Options:

    path; strict ("true": a cut last frame fails); atoms (numbers with commas: only these, in this order); first, last
    (range of frame numbers); pushdown ("true": filters on path and frame_idx are taken into the scan, which
    needs ``spark.sql.python.filterPushdown.enabled``).
    """

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushReader if self.options.get("pushdown", "false") == "true" else _Reader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Writer(self.options)


def _numbers(text: str | None) -> list[int] | None:
    return None if text is None else [int(x) for x in text.split(",") if x.strip()]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("strict", "true") == "true"
        self.atoms = _numbers(options.get("atoms"))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        self.names: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        found = [(name, info) for name, info in _files(self.path) if self.names is None or name in self.names]
        if self.last is not None and self.last < self.first:
            return []
        return [_Split(self.path, name, lo, min(lo + SPLIT_BYTES, info.size), self.first, self.last) for name, info in found for lo in range(0, max(info.size, 1), SPLIT_BYTES)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        """Frames that begin in the split's bytes, as Arrow batches; the split with a file's end tells a cut last frame."""
        system, place, prefix = _prefix(split.path)
        with system.open_input_file(split.name.removeprefix(prefix)) as f:
            h = _header(f, f.size(), split.name)
            if h["cut"] and self.strict and split.hi == f.size():
                raise ValueError(f"{split.name}: the last frame is cut")
            first = max(split.first, -(-(split.lo - h["start"]) // h["size"]))
            last = min(h["frames"], max(0, -(-(split.hi - h["start"]) // h["size"])), h["frames"] if split.last is None else split.last + 1)
            yield from _batches(f, h, split.name, first, last, self.atoms)


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds on frame_idx and equality on path; gives back the others."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("frame_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    last = f.value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            elif at == ("path",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """Offsets are the numbers of whole frames of each file. A file whose header is not there yet has none."""

    def __init__(self, options):
        self.path, self.atoms = options["path"], _numbers(options.get("atoms"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _, prefix = _prefix(self.path)
        out = {}
        for name, info in _files(self.path):
            with system.open_input_file(name.removeprefix(prefix)) as f:
                try:
                    out[name] = _header(f, info.size, name)["frames"]
                except Cut:
                    continue
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, last in sorted(end.items()):
            first = start.get(name, 0)
            if first < last:
                size = header(name)["size"]
                step = max(1, SPLIT_BYTES // size)
                out += [_Split(self.path, name, 0, 0, k, min(k + step, last) - 1) for k in range(first, last, step)]
        return out

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _prefix(split.path)
        with system.open_input_file(split.name.removeprefix(prefix)) as f:
            h = _header(f, f.size(), split.name)
            if h["frames"] <= split.last:
                raise ValueError(f"{split.name}: {h['frames']} frames where there were {split.last + 1}")
            yield from _batches(f, h, split.name, split.first, split.last + 1, self.atoms)


def _framed(body: bytes) -> bytes:
    return struct.pack("<i", len(body)) + body + struct.pack("<i", len(body))


def file_header(frames: int, atoms: int, cell: bool, first: int = 0) -> bytes:
    h = bytearray(84)
    h[:4] = b"CORD"
    struct.pack_into("<3i", h, 4, frames, first, 1)
    struct.pack_into("<fi", h, 40, 1.0, int(cell))
    struct.pack_into("<i", h, 80, 24)
    return _framed(bytes(h)) + _framed(struct.pack("<i", 1) + b"Curves".ljust(80)) + _framed(struct.pack("<i", atoms))


def _encoded(b: pa.RecordBatch) -> tuple[np.ndarray, int, bool]:
    """The frames of a batch as rows of bytes, their number of atoms, and whether they have cells."""
    sides = [b.column(b.schema.get_field_index(c)) for c in "xyz"]
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in sides]
    atoms = int(sizes[0][0])
    if any((s != atoms).any() for s in sizes):
        raise ValueError("frames differ in their number of atoms")
    cell = b.column(b.schema.get_field_index("cell"))
    celled = cell.null_count == 0
    if not celled and cell.null_count < b.num_rows:
        raise ValueError("some frames have a cell and some have none")
    pre, width = 56 if celled else 0, 4 * atoms
    raw = np.zeros((b.num_rows, pre + 3 * (8 + width)), np.uint8)

    def put(at: int, values: np.ndarray) -> None:
        data = np.ascontiguousarray(values).view(np.uint8).reshape(b.num_rows, -1)
        mark = np.frombuffer(struct.pack("<i", data.shape[1]), np.uint8)
        raw[:, at : at + 4] = raw[:, at + 4 + data.shape[1] : at + 8 + data.shape[1]] = mark
        raw[:, at + 4 : at + 4 + data.shape[1]] = data

    if celled:
        put(0, np.stack([cell.field(c).to_numpy(zero_copy_only=False) for c in _CELL], 1).astype("<f8"))
    for c, x in enumerate(sides):
        put(pre + c * (8 + width), x.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, atoms))
    return raw, atoms, celled


class _Message(WriterCommitMessage):
    def __init__(self, drafts: list[tuple[str, str]], frames: int, shape: tuple | None):
        self.drafts, self.frames, self.shape = drafts, frames, shape


class _Writer(DataSourceArrowWriter):
    """Files of a folder, or with the option ``frames`` (how many there are) one file of one ordered partition.

    A file is written under a name that readers pass over, with its header, and renamed when the job commits; if it fails,
    such files go. ``frame_idx`` of a file's first frame is the first step in its header.
    """

    def __init__(self, options):
        self.path, self.frames = options["path"], int(options["frames"]) if "frames" in options else None
        self.job = uuid.uuid4().hex  # tasks get this writer, so all drafts of a write begin alike

    def write(self, batches) -> WriterCommitMessage:
        system, place = _place(self.path)
        name, drafts, n, shape, held, stream = uuid.uuid4().hex, [], 0, None, [], None
        part = 0

        def put() -> None:
            """A whole file of what is held."""
            nonlocal held
            if held:
                draft = f"{place}/.{self.job}-{name}-{len(drafts)}"
                with system.open_output_stream(draft) as f:
                    f.write(file_header(sum(len(r) for r, _ in held), *shape, first=held[0][1]))
                    for r, _ in held:
                        f.write(r.tobytes())
                drafts.append((draft, f"{place}/frames-{held[0][1]:012d}-{name[:8]}.dcd"))
                held = []

        try:
            for b in batches:
                if not b.num_rows:
                    continue
                raw, *own = _encoded(b)
                if shape is not None and tuple(own) != shape:
                    raise ValueError("frames differ in their number of atoms, or some have no cell")
                shape = tuple(own)
                first = b.column(b.schema.get_field_index("frame_idx"))[0].as_py() or 0
                n += len(raw)
                if self.frames is not None:
                    if stream is None:
                        drafts.append((f"{place}.{self.job}-{name}.draft", place))
                        stream = system.open_output_stream(drafts[0][0])
                        stream.write(file_header(self.frames, *shape, first=first))
                    stream.write(raw.tobytes())
                    continue
                if held and part + raw.nbytes > FILE_BYTES:
                    put()
                    part = 0
                held.append((raw, first))
                part += raw.nbytes
            put()
            if self.frames is not None and n not in (0, self.frames):
                raise ValueError(f"a file of {self.frames} frames is written from one ordered partition, not one of {n}")
        except BaseException:
            if stream is not None:
                stream.close()
            self._delete(system, drafts)
            raise
        if stream is not None:
            stream.close()
        return _Message(drafts, n, shape)

    @staticmethod
    def _delete(system: fs.FileSystem, drafts: list[tuple[str, str]]) -> None:
        for draft, _ in drafts:
            if system.get_file_info(draft).type != fs.FileType.NotFound:
                system.delete_file(draft)

    def commit(self, messages) -> None:
        system, place = _place(self.path)
        full = [m for m in messages if m is not None and m.frames]
        try:
            if len({m.shape for m in full}) > 1:
                raise ValueError("frames differ in their number of atoms, or some have no cell")
            if self.frames is not None and len(full) > 1:
                raise ValueError("a file is written from one ordered partition")
        except ValueError:
            self.abort(messages)
            raise
        for m in full:
            for draft, final in m.drafts:
                system.move(draft, final)
        if self.frames is not None and not full:
            with system.open_output_stream(place) as f:
                f.write(file_header(0, 0, False))

    def abort(self, messages) -> None:
        """Deletes the drafts of tasks that ended, and of those that were stopped on the way. One that still runs may leave a draft, which no reader sees."""
        system, place = _place(self.path)
        for m in messages:
            if m is not None:
                self._delete(system, m.drafts)
        folder, prefix = (place, f".{self.job}-") if self.frames is None else (place.rpartition("/")[0] or ".", f"{place.rpartition('/')[2]}.{self.job}-")
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(prefix):
                system.delete_file(f.path)


def _loaded(reader, path: str, **options):
    for k, x in options.items():
        if x is not None:
            reader = reader.option(k, x)
    return reader.format("dcd").option("path", path).load()


def read_dcd(spark: SparkSession, path: str, strict: bool = True, atoms: list[int] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """path, frame_idx, cell, x, y, z of the file or folder ``path``; of ``atoms`` only, in their order, and frames first to last (both included).

    Filters on path and frame_idx reach the scan where the session sets ``spark.sql.python.filterPushdown.enabled``.
    """
    spark.dataSource.register(DcdSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    first, last = frames or (None, None)
    return _loaded(spark.read, path, strict=str(strict).lower(), atoms=None if atoms is None else ",".join(map(str, atoms)), first=first, last=last, pushdown=push)


def stream_dcd(spark: SparkSession, path: str, atoms: list[int] | None = None) -> DataFrame:
    """The frames of the file or folder ``path`` as a stream: those that are there, and what files grow by."""
    spark.dataSource.register(DcdSource)
    return _loaded(spark.readStream, path, atoms=None if atoms is None else ",".join(map(str, atoms)))


_COLUMNS = ("frame_idx", "cell", "x", "y", "z")


def write_dcd(frames: DataFrame, path: str) -> None:
    """Write columns frame_idx, cell, x, y, z in frame order to one file, by one task."""
    frames.sparkSession.dataSource.register(DcdSource)
    rows = frames.select(F.lit(path).alias("path"), *_COLUMNS).coalesce(1).sortWithinPartitions("frame_idx")
    rows.write.format("dcd").mode("append").option("path", path).option("frames", frames.count()).save()


def write_dcd_parts(frames: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the columns to files of at most ``FILE_BYTES`` in the folder ``path``, ranges of frames by ``parts`` tasks.

    A file's name and header tell its first frame, so that :func:`read_dcd_parts` gives the numbers back.
    """
    spark = frames.sparkSession
    spark.dataSource.register(DcdSource)
    system, place = _place(path)
    system.create_dir(place, recursive=True)
    rows = frames.select(F.lit(path).alias("path"), *_COLUMNS)
    rows = (rows.repartitionByRange(parts, "frame_idx") if parts else rows.repartitionByRange("frame_idx")).sortWithinPartitions("frame_idx")
    rows.write.format("dcd").mode("append").option("path", path).save()


def read_dcd_parts(spark: SparkSession, path: str, **options) -> DataFrame:
    """The frames of a folder of :func:`write_dcd_parts`, numbered as they were where they had no gaps."""
    first = F.regexp_extract("path", r"frames-(\d+)-[0-9a-f]+\.dcd$", 1).cast("long")
    return read_dcd(spark, path, **options).withColumn("frame_idx", F.col("frame_idx") + first)


def project(frames: DataFrame, atoms: list[int], second: list[int | None] | None = None) -> DataFrame:
    """frame_id, res, x, y, z(, cx, cy, cz): listed atoms in their order, repeats too; an index out of range fails.

    Where ``second`` has None, the second strand is built from the neighbouring points.
    """
    if second is not None and len(second) != len(atoms):
        raise ValueError(f"{len(atoms)} atoms, {len(second)} of the second strand")

    def at(c: str, k):
        return F.element_at(c, k + 1).cast("double")  # fails out of range in ANSI mode

    pairs = [F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(second[i] if second else None).cast("int").alias("b")) for i, a in enumerate(atoms)]
    rows = frames.select(F.col("frame_idx").alias("frame_id"), "x", "y", "z", F.explode(F.array(*pairs)).alias("p"))
    more = [F.when(F.col("p.b").isNotNull(), at(c, F.coalesce("p.b", F.lit(0)))).alias(f"c{c}") for c in "xyz"] if second else []
    out = rows.select("frame_id", F.col("p.i").alias("res"), *[at(c, F.col("p.a")).alias(c) for c in "xyz"], *more)
    if second and None in second:
        out = pseudo_strand(out)
        out = out.withColumns({f"c{c}": F.coalesce(f"c{c}", f"p{c}") for c in "xyz"}).drop("px", "py", "pz")
    return out
