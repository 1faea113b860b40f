"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every record (gzip member, version line, header block, declared length, record end and
block digest). After a failed check it searches on from the next byte for a gzip member or a version line,
recovers the records that follow, and logs the skipped bytes as a quarantined gap. A file is read in blocks. A declared
length is not believed before it is checked: of a file that can seek, the record's end is looked at first, and a
block of more than ``HOLD`` bytes is hashed (or inflated and hashed) piece by piece, so that only good records are
held and memory is bounded by the largest of these; records of any size are read unless the caller sets a bound. A
stream that cannot seek holds what is declared.

:func:`round_trip` keeps the gap log beside the records and fails where records read are not those written.

Defined cases: a null payload is empty; payloads shorter than the bound are never revisits; of rows with equal
payload one with the largest id (of several, one with the smallest url) is the response, and the others revisit this
id with this payload; every row gives one record, whatever ids are repeated; ids may be null (such rows come last in the
choice of a response; where all are null all are responses, as none can be named); an empty table gives empty
archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, small

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
BLOCK = 1 << 20
#: Records of more bytes are checked before they are held.
HOLD = 4 << 20
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_DATE = "2000-01-01T00:00:00Z"


def record(kind: str, uri: str, payload: bytes, headers: dict[str, str], payload_digest: str | None = None) -> bytes:
    """One record's bytes, not compressed. ``payload`` is the record's block."""
    digest = payload_digest or hashlib.sha1(payload).hexdigest()
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((kind, uri, digest, sorted(headers.items()))))}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type": "text/html; charset=utf-8",
        **headers,
        "Content-Length": str(len(payload)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member with no time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Window:
    """A forward view of a file of which only the part still needed is held."""

    def __init__(self, stream, start: int = 0):
        self.stream, self.base, self.buf, self.ended = stream, start, bytearray(), False
        self.size = None
        if stream.seekable():
            at = stream.tell()
            self.origin = at - start
            self.size = stream.seek(0, 2) - self.origin
            stream.seek(at)

    def need(self, n: int) -> bool:
        while len(self.buf) < n and not self.ended:
            more = self.stream.read(max(BLOCK, n - len(self.buf)))
            self.ended = not more
            self.buf += more
        return len(self.buf) >= n

    def drop(self, n: int) -> None:
        if n > len(self.buf) and self.size is not None:  # what was only looked at is passed over
            self.stream.seek(self.origin + self.base + n)
        del self.buf[:n]
        self.base += n

    def ahead(self, at: int, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from ``at`` (counted from the window's start) to ``stop`` in blocks, none of them kept."""
        here = self.stream.tell()
        try:
            self.stream.seek(self.origin + self.base + at)
            while stop is None or at < stop:
                part = self.stream.read(BLOCK if stop is None else min(BLOCK, stop - at))
                if not part:
                    return
                at += len(part)
                yield part
        finally:
            self.stream.seek(here)


def _head(data: bytes | bytearray, whole: bool, most: int | None) -> tuple[dict[str, str], int, int] | str:
    """Headers, start and end of the block of the record at the start of ``data``; else what is wrong, "more" if the headers are cut."""
    m = _VERSION.match(data)
    if not m:
        return "version" if whole or len(data) >= 10 else "more"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "header" if whole or len(data) > BLOCK else "more"
    headers: dict[str, str] = {}
    for line in bytes(data[m.end() : end]).split(b"\r\n"):
        if not line:
            continue
        k, sep, v = line.partition(b":")
        if not sep or not re.fullmatch(rb"[A-Za-z0-9-]+", k):
            return "header"
        headers[k.decode().lower()] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", size := headers.get("content-length", "")):
        return "length"
    if most is not None and int(size) > most:
        return "size"
    return headers, end + 4, end + 4 + int(size)


def _sum(headers: dict[str, str]) -> str | None:
    """The SHA-1 that the headers tell of the block."""
    digest = headers.get("warc-block-digest", "")
    return digest[5:].lower() if digest.startswith("sha1:") else None


def _plain(w: _Window, most: int | None) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and length of the record that is not compressed at the window's start; else what is wrong."""
    while (got := _head(w.buf, w.ended, most)) == "more":
        w.need(max(BLOCK, 2 * len(w.buf)))
    if isinstance(got, str):
        return got
    headers, start, stop = got
    if w.size is not None and len(w.buf) < stop + 4:
        if w.base + stop + 4 > w.size:
            return "cut"
        if b"".join(w.ahead(stop, stop + 4)) != b"\r\n\r\n":
            return "end"
        if stop - start > HOLD and _sum(headers):
            digest = hashlib.sha1()
            for part in w.ahead(start, stop):
                digest.update(part)
            if digest.hexdigest() != _sum(headers):
                return "digest"
    if not w.need(stop + 4):
        return "cut"
    if w.buf[stop : stop + 4] != b"\r\n\r\n":
        return "end"
    block = bytes(w.buf[start:stop])
    if _sum(headers) not in (None, hashlib.sha1(block).hexdigest()):
        return "digest"
    return headers, block, stop + 4


def _inflated(w: _Window, most: int | None, hold: bool) -> tuple[dict[str, str], bytes | None, int] | str:
    """As :func:`_plain` for a gzip member. Without ``hold`` nothing beyond the headers is kept, and the block is None."""

    def parts() -> Iterator[bytes]:
        if hold or w.size is None:
            at = 0
            while at < len(w.buf) or w.need(at + 1):
                yield (part := bytes(w.buf[at : at + (1 << 16)]))
                at += len(part)
        else:
            for part in w.ahead(0):
                yield from (part[i : i + (1 << 16)] for i in range(0, len(part), 1 << 16))

    z, out, size, read, head, digest, tail = zlib.decompressobj(31), bytearray(), 0, 0, "more", hashlib.sha1(), b""
    try:
        for part in parts():
            data = part
            while True:
                piece = z.decompress(data, BLOCK)
                size += len(piece)
                if isinstance(head, str):
                    out += piece
                    head = _head(out, z.eof, most)
                    if isinstance(head, str):
                        if head != "more":
                            return head
                    elif not hold and head[2] - head[1] > HOLD:
                        digest.update(out[head[1] : head[2]])
                        tail = bytes(out[head[2] :])
                        out.clear()
                elif not hold and head[2] - head[1] > HOLD:
                    left = max(0, head[2] - (size - len(piece)))
                    digest.update(piece[:left])
                    tail += piece[left:]
                else:
                    out += piece
                if not isinstance(head, str) and size > head[2] + 4:
                    return "member"
                data = z.unconsumed_tail
                if z.eof or not data and len(piece) < BLOCK:
                    break
            read += len(part)
            if z.eof:
                break
    except zlib.error:
        return "gzip"
    if not z.eof:
        return "cut"
    if isinstance(head, str):
        return "header" if head == "more" else head
    headers, start, stop = head
    if size < stop + 4:
        return "cut"
    large = not hold and stop - start > HOLD
    if (tail if large else bytes(out[stop:])) != b"\r\n\r\n":
        return "end"
    if not large:
        digest.update(out[start:stop])
    if _sum(headers) not in (None, digest.hexdigest()):
        return "digest"
    return headers, None if large else bytes(out[start:stop]), read - len(z.unused_data)


def _member(w: _Window, most: int | None) -> tuple[dict[str, str], bytes, int] | str:
    """The record in the gzip member at the window's start. A large one is inflated twice: to check it, then to hold it."""
    got = _inflated(w, most, w.size is None)
    return _inflated(w, most, True) if not isinstance(got, str) and got[1] is None else got


def salvage(stream, max_record: int | None = None) -> Iterator[tuple[str, dict[str, str], bytes, int, int]]:
    """Yield ("record", headers, block, offset, length) and ("gap", {"reason"}, b"", offset, length) in file order.

    Records with blocks of more than ``max_record`` bytes, if it is set, are gaps.
    """
    w, gap, reason = _Window(stream), -1, ""
    while w.need(1):
        w.need(16)
        found = (_member if w.buf.startswith(_GZIP) else _plain)(w, max_record)
        if isinstance(found, str):
            found, why = None, found
        if found:
            if gap >= 0:
                yield "gap", {"reason": reason}, b"", gap, w.base - gap
                gap = -1
            yield "record", found[0], found[1], w.base, found[2]
            w.drop(found[2])
            continue
        if gap < 0:
            gap, reason = w.base, why
        w.drop(1)
        while True:  # to the next byte at which a record may begin
            places = [p for p in (w.buf.find(_GZIP), w.buf.find(b"WARC/1.")) if p >= 0]
            if places:
                w.drop(min(places))
                break
            w.drop(max(0, len(w.buf) - 8))
            if not w.need(len(w.buf) + 1):
                w.drop(len(w.buf))
                break
    if gap >= 0:
        yield "gap", {"reason": reason}, b"", gap, w.base - gap


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


WRITTEN = "path string, records long, bytes long"
READ = "path string, offset long, length long, kind string, reason string, record_type string, uri string, page_id long, payload binary, payload_digest string, refers_to long, payload_bytes long"


def write_warc(rows: DataFrame, folder: str, *, level: int = 1) -> DataFrame:
    """Write ``rows`` (page_id, url, payload, payload_digest, refers_to) as one archive for each partition below ``folder``.

    The folder is a URI on shared storage. A task writes under a name of its own and renames it at the end, so a
    repeated or speculative attempt replaces a file by an equal one. Returns lazily: path, records, bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, top = _open(folder)
        where.create_dir(top, recursive=True)
        final = f"{top}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{top}/.{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        n = size = 0
        with where.open_output_stream(draft) as out:
            for b in batches:
                ids, urls, bodies, digests, refs = (b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))
                for i in range(b.num_rows):
                    page, ref, digest = ids[i].as_py(), refs[i].as_py(), digests[i].as_py()
                    own = {} if page is None else {"X-Page-Id": str(page)}
                    uri = urls[i].as_py() or ""
                    if ref is None:
                        data = record("response", uri, bodies[i].as_py() or b"", own, digest)
                    else:
                        own |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(ref)}
                        data = record("revisit", uri, b"", own | {"X-Payload-Bytes": str(len(bodies[i].as_py() or b""))}, digest)
                    out.write(z := member(data, level))
                    n, size = n + 1, size + len(z)
        where.move(draft, final)
        yield pa.RecordBatch.from_pydict({"path": [final], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(write, WRITTEN)


def read_warc(spark, folder: str, *, max_record: int | None = None) -> DataFrame:
    """All records and quarantined gaps of the archives in ``folder`` (a URI on shared storage).

    ``payload_bytes`` is a record's own block's length, of a revisit that of the payload it stands for, from its header.
    The file names become a table (one small row each) that is dealt one file to a task.
    """
    from pyarrow import fs

    where, top = _open(folder)
    names = [x.path for x in where.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.is_file and not x.base_name.startswith(".")]
    if not names:
        return spark.createDataFrame([], READ)
    # a file name has no scheme here: the folder's file system is asked for it
    files = spark.createDataFrame([(x,) for x in sorted(names)], "path string").repartition(len(names), "path")
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsys, _ = _open(folder)
        number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fsys.open_input_file(path) as stream:
                    for kind, h, block, offset, length in salvage(stream, max_record):
                        digest = h.get("warc-payload-digest", "")
                        rows.append((path, offset, length, kind, h.get("reason"), h.get("warc-type"), h.get("warc-target-uri"), number(h.get("x-page-id")), block if kind == "record" else None, digest[5:] if digest.startswith("sha1:") else None, number(h.get("x-refers-to-page-id")), None if kind != "record" else number(h.get("x-payload-bytes")) if h.get("warc-type") == "revisit" else len(block)))
                        held += len(block)
                        if held > 2 * BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(read, READ)


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: what :func:`write_warc` takes.

    The largest id of each digest comes from grouped counts, reduced before the shuffle and written as a table; the
    join back to the rows is one that Spark can split where a digest has very many rows. Where that id is repeated
    with the payload, its rows are counted by url, and one of them is the response.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("long_digest", F.when(F.octet_length("payload") >= least_bytes, F.col("payload_digest")))
    counts = rows.where("long_digest is not null").groupBy(F.col("long_digest").alias("of_digest"), "page_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("of_digest").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "n")).alias("top"), F.sum("n").alias("copies")).where("copies > 1")
    best = scratch.save(best.select("of_digest", F.col("top.page_id").alias("best"), (F.col("top.n") > 1).alias("several")).where("best is not null"), "best")
    joined = rows.join(best, rows["long_digest"] == best["of_digest"], "left")
    first = F.col("page_id").eqNullSafe(F.col("best"))
    columns = ["page_id", "url", "payload", "payload_digest"]
    out = joined.where(~(first & F.coalesce("several", F.lit(False)))).select(*columns, F.when(F.col("best").isNotNull() & ~first, F.col("best")).alias("refers_to"))
    several = best.where("several")
    n = several.count()
    if not n:
        return out
    again = rows.join(small(several, n, 96), (rows["long_digest"] == several["of_digest"]) & (rows["page_id"] == several["best"]))
    again = again.groupBy("page_id", "url", "payload_digest").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    again = again.withColumn("place", F.row_number().over(Window.partitionBy("payload_digest").orderBy(F.col("url").asc_nulls_last())))
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.unionByName(again.select(*columns, F.when((F.col("place") > 1) | (F.col("copy") > 1), F.col("page_id")).alias("refers_to")))


def round_trip(pages: DataFrame, *, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write an archive record for every page and read the archives back: one row for each record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.base}/archive"
    scratch.save(write_warc(with_revisits(pages, least_bytes=least_bytes), folder), "written")
    digest = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload"))
    got = read_warc(spark, folder)
    got = scratch.save(got.select("kind", "path", "offset", "length", "reason", "page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to"), "read")
    wrote = spark.read.schema(WRITTEN).parquet(f"{scratch.base}/written").agg(F.coalesce(F.sum("records"), F.lit(0))).head()[0]
    read, gaps = got.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).head()
    if read != wrote or gaps:
        raise RuntimeError(f"{wrote} records were written and {read} read, with {gaps} gaps, which are listed in {scratch.base}/read; the archives stay in {folder}")
    scratch.drop("archive", "written")
    return got.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best,
  payload_bytes >= 1000 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) > 1 AS later FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN later AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN later THEN best END AS refers_to
FROM b
"""
