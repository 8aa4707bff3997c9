"""WARC records in ZIP packages: written by tasks, range-read without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (offset and length of each
record). The reader parses the end of the central directory, the ZIP64 locator,
record and extra fields, finds the stored archive members and their indexes,
and reads only the ranges of the records. Nothing is unpacked to disk. An
archive member without an index, and what an index leaves out, is scanned once
for its record boundaries. A gzip stream of many records is one range, and all
its records are read.

Writing: every task streams its rows into packages of at most
``PACKAGE_RECORDS`` records or ``PACKAGE_BYTES``, under names of their own; the
manifest (a table written by Spark) lists the packages of the attempts that
were committed, so a lost executor leaves at most unlisted files. Reading:
records are listed as runs of about ``RUN_BYTES`` and dealt to tasks, each run
is one range read.

Files are opened through ``pyarrow.fs`` (file, hdfs, s3, gs). Payload copies are
found by one aggregation on their SHA-1, of counts and the largest page_id
only, and joined back on the digest; small payloads get a key of their own, so
the empty one is no hot key.

Nulls: a null payload is empty; a null url has no target header; a null
page_id is read back as null and is never referred to, so copies whose ids are
all null are all responses. Rows that share the largest page_id of a payload
are all responses. Members that are compressed in the ZIP cannot be range-read
and raise an error that names them.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bowline.llm.tables import materialize, work_path

REVISIT_BYTES = 1000
PACKAGE_RECORDS = 50_000
PACKAGE_BYTES = 256 * 1024 * 1024
RUN_BYTES = 4 * 1024 * 1024
TASK_BYTES = 64 * 1024 * 1024
GZIP_LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ZIP signatures and the marks that send a reader to the ZIP64 fields (fixed values of the format)
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]  # (offset, length) -> bytes


# ---- records -----------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(rid: str | None) -> int | None:
    number = (rid or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None) -> bytes:
    """A response record, or a revisit (HTTP head only) where ``refers_to`` is given."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one uncompressed record."""
    fields, rest = _head(raw)
    block = rest[:int(fields.get("content-length", len(rest)))]
    if fields.get("content-type", "").startswith("application/http"):
        return fields, *_head(block)
    return fields, {}, block


# ---- ZIP directories ---------------------------------------------------------

def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """Replace each of ``wanted`` that is a ZIP64 mark by the next value of the 0x0001 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values) if w == MAX32 else w for w in wanted]
        at += 4 + size
    return wanted


def zip_members(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, local header offset, size) from the central directory."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    end = tail_at + at
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = read_at(end - 20, 20) if end >= 76 else b""
    if locator[:4] == LOCATOR64:
        # where bytes stand in front of the archive, the record is just before its locator
        places = (struct.unpack_from("<Q", locator, 8)[0], end - 76)
        end = next((at for at in places if at + 56 <= size and read_at(at, 4) == END64), -1)
        if end < 0:
            raise ValueError("the ZIP64 locator does not point to its record")
        count, length, start = struct.unpack_from("<QQQ", read_at(end, 56), 32)
    elif MAX16 == count or MAX32 in (length, start):
        raise ValueError("a ZIP64 archive without its locator")
    shift = end - length - start  # bytes in front of the archive
    directory, at, found = read_at(start + shift, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        plain, packed, offset = _zip64(extra, [plain, packed, offset])
        found[name] = (method, offset + shift, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def data_offset(read_at: ReadAt, header: int) -> int:
    local = read_at(header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header where the central directory says")
    return header + 30 + sum(struct.unpack_from("<HH", local, 26))


def scan_records(read_at: ReadAt, start: int, size: int, gzipped: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of an archive member that has no index."""
    at, chunk = 0, 1 << 20
    while at < size:
        begin = at
        if gzipped:
            inflate = zlib.decompressobj(31)
            while not inflate.eof and at < size:
                piece = read_at(start + at, min(chunk, size - at))
                inflate.decompress(piece)
                at += len(piece) - len(inflate.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head and begin + len(head) < size:
                head += read_at(start + begin + len(head), min(chunk, size - begin - len(head)))
            n = head.index(b"\r\n\r\n") + 4
            at = begin + n + int(_head(head[:n])[0]["content-length"]) + 4
        yield begin, at - begin


def unpacked(raw: bytes, gzipped: bool, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Every uncompressed record of a range; a gzip stream may hold many, of which one at a time is kept."""
    if not gzipped:
        yield raw
        return
    rest = b""
    while raw:
        inflate = zlib.decompressobj(31)
        while raw and not inflate.eof:
            rest += inflate.decompress(raw, chunk)
            raw = inflate.unconsumed_tail or inflate.unused_data
            at = 0
            while (n := _record_end(rest, at)) is not None:
                yield rest[at:n]
                at = n
            rest = rest[at:]
        if not inflate.eof:
            raise ValueError("a gzip stream of the archive is cut off")
    if rest.strip(b"\r\n"):
        yield rest  # the last record may lack the line ends after it


def _record_end(data: bytes, at: int) -> int | None:
    """Where the record that starts at ``at`` ends with its two line ends, if ``data`` reaches as far."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    end = head + 4 + int(_head(data[at:head + 4])[0]["content-length"]) + 4
    return end if end <= len(data) else None


def list_records(read_at: ReadAt, size: int) -> Iterator[tuple[str, int, int]]:
    """(member, absolute offset, length) of every record of a package, in file order.

    A gzip stream that holds many records is listed once; ``unpacked`` gives them all.
    """
    members = zip_members(read_at, size)
    known: dict[str, list] = {}
    for name, (method, header, length) in members.items():
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")):
            raw = read_at(data_offset(read_at, header), length)
            for line in (raw if method == 0 else zlib.decompress(raw, -15)).decode().splitlines():
                entry = json.loads(line[line.index("{"):])
                known.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for name, (method, header, length) in members.items():
        if name.startswith("archive/") and name.endswith((".warc", ".warc.gz")):
            if method:
                raise ValueError(f"{name} is compressed in the ZIP; only stored members are range-read")
            start = data_offset(read_at, header)
            gzipped, at = name.endswith(".gz"), 0
            for offset, n in [*sorted(set(known.get(name.removeprefix("archive/"), []))), (length, 0)]:
                # what the index leaves out is scanned
                for gap, m in scan_records(read_at, start + at, offset - at, gzipped) if offset > at else ():
                    yield name, start + at + gap, m
                if n:
                    yield name, start + offset, n
                at = max(at, offset + n)


# ---- writing -----------------------------------------------------------------

class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class _Package:
    def __init__(self, uri: str):
        self.uri = uri
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(path)
        self.sink = _Sink(self.stream)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, url: str | None, digest: str, record: bytes) -> None:
        raw = gzip.compress(record, GZIP_LEVEL, mtime=0)
        self.member.write(raw)
        entry = {"url": url or "", "digest": f"sha1:{digest}", "offset": str(self.at), "length": str(len(raw)),
                 "filename": "data.warc.gz"}
        key = "".join((url or "-").split()) or "-"
        self.index.append(f"{key} {DATE.translate({45: None, 58: None})} {json.dumps(entry)}")
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(sorted(self.index)))
        self.zip.close()
        self.stream.close()
        return self.uri, self.sink.at, len(self.index)


def _write(folder: str, max_records: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                package = package or _Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(url, digest, warc_record(page_id, url, (html or "").encode(), digest, refers_to))
                if len(package.index) >= max_records or package.at >= max_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "bytes", "records"])
    return run


def revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with the payload digest and, for revisits, the response's page_id."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= min_bytes
    kept = (pages.filter(large).groupBy("digest")
            .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
            .select(F.col("digest").alias("key"), "kept"))
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("page "), F.xxhash64("page_id", "url")))
    rows = pages.select("*", key.alias("key")).join(kept, "key", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("kept"))
    return rows.select("page_id", "url", "html", "digest",
                       F.when(F.col("kept").isNotNull() & other, F.col("kept")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, max_records: int = PACKAGE_RECORDS,
                   max_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a WARC record per row of ``revisits()``; return the manifest (path, bytes, records)."""
    folder = folder or work_path(pages.sparkSession, "warc")
    return materialize(pages.mapInArrow(_write(folder, max_records, max_bytes),
                                        "path string, bytes long, records long"), "manifest")


# ---- reading -----------------------------------------------------------------

def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _read_at(f) -> ReadAt:
    def read(offset: int, length: int) -> bytes:
        return f.read_at(length, offset)
    return read


RUN_TYPE = pa.schema([("path", pa.string()), ("member", pa.string()), ("at", pa.int64()),
                      ("lengths", pa.list_(pa.int64()))])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of adjoining records of each package."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            runs: list[dict] = []
            with _open(path) as f:
                for member, at, n in list_records(_read_at(f), f.size()):
                    last = runs[-1] if runs else None
                    if last and last["member"] == member and last["end"] == at and at + n - last["at"] <= RUN_BYTES:
                        last["lengths"].append(n)
                        last["end"] += n
                    else:
                        runs.append({"path": path, "member": member, "at": at, "lengths": [n], "end": at + n})
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in RUN_TYPE.names} for r in runs], RUN_TYPE)


def _row_of(record: bytes, run: dict, at: int, length: int, with_payload: bool) -> dict:
    fields, http, payload = parse_record(record)
    whole = fields.get("warc-type") != "revisit"
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
        "refers_to": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if whole else int(http.get("content-length", 0)),
        "payload_digest": hashlib.sha1(payload).hexdigest() if whole
        else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "path": run["path"], "member": run["member"], "offset": run["at"] + at, "length": length,
        "payload": payload if with_payload and whole else None}


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    raw = f.read_at(sum(r["lengths"]), r["at"])
                out, at = [], 0
                for n in r["lengths"]:
                    for record in unpacked(raw[at:at + n], r["member"].endswith(".gz")):
                        out.append(_row_of(record, r, at, n, with_payload))
                    at += n
                yield pa.RecordBatch.from_pylist(out, RECORD_TYPE)
    return run


RECORD_TYPE = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "refers_to", "url")]
                        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("path", pa.string()),
                           ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                           ("payload", pa.binary())])
RECORD_SCHEMA = ("record_id string, record_type string, refers_to string, url string, payload_bytes long, "
                 "payload_digest string, path string, member string, offset long, length long, payload binary")


def read_packages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages at ``path``; digests are computed from the payloads read."""
    spark = manifest.sparkSession
    found = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    runs = materialize(manifest.select("path").repartition(max(1, found[0])).mapInArrow(
        _list, "path string, member string, at long, lengths array<long>"), "runs")
    tasks = max(spark.sparkContext.defaultParallelism, found[1] // TASK_BYTES)
    return runs.repartition(max(1, min(tasks, runs.count()))).mapInArrow(_read(with_payload), RECORD_SCHEMA)


def pages_of(records: DataFrame) -> DataFrame:
    """Records of ``write_packages`` with the page ids their record ids name."""
    def number(c: str):
        return F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
                          "path", "offset", "length")
