"""Operator 4: web archives in ZIP packages, read in place.

A package holds one WARC file and its index as stored members. Readers take the end of the package, parse the central
directory (with its ZIP64 forms), find where the stored members lie, read the index and then fetch records by byte range;
nothing is unpacked. Every record of the WARC file is a gzip member of its own.

Of records with equal payloads the one with the largest page id is written whole, the others as revisits that name it.
Packages are written below the shared folder; their file systems are those Arrow knows by address.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.texts import slices
from vacantia.session import stage, stage_folder

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 128 << 20
READ_BYTES = 8 << 20
# More ranges than this share reading tasks.
MOST_TASKS = 50_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if re.match(r"[a-z][a-z0-9+.-]*:", address) else f"file://{address}")


# ---- writing ----


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; without payload it is a revisit whose HTTP head keeps the length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


class Package:
    """One archive being written; records go straight to the file system."""

    def __init__(self, address: str):
        self.system, path = file_system(address)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.address, self.stream = address, self.system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC, "w", force_zip64=True)
        self.index: list[tuple[int, int]] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.member.write(data)
        self.index.append((self.size, len(data)))
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(f"{offset} {length}\n" for offset, length in self.index))
        self.zip.close()
        self.stream.close()
        return self.address, len(self.index), self.size


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, sha1, refers_to of every page.

    Pages are told apart narrowly: digests are reduced to the largest id of each, and only rows of repeated digests are
    looked up again.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    facts = stage(rows.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "payloads")
    repeated = facts.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    originals = stage(repeated.where("n > 1").select("sha1", "original"), "originals")
    revisits = facts.join(originals, "sha1").where("page_id < original OR page_id IS NULL AND original IS NOT NULL")
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("sha1").alias("of_sha1"), "original").distinct()
    rows = rows.withColumn("sha1", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")))
    joined = rows.join(revisits, (F.col("page_id").eqNullSafe(F.col("of"))) & (F.col("sha1") == F.col("of_sha1")), "left")
    return joined.select("page_id", "url", "html", F.col("original").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages; gives (package, records, bytes), one row per finished package.

    A null html is an empty payload, a null url the address `urn:none`. Of rows with equal payloads of at least `min_bytes`
    bytes those of the largest page id are responses, the others revisits; null ids are smaller than all others, and
    among null ids alone all are responses. Other columns are left out. A task that fails leaves packages no row names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode()
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(record(page_id, url, payload if refers_to is None else None, len(payload), digest(payload), refers_to))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["package", "records", "bytes"])

    return stage(with_originals(pages, min_bytes).mapInArrow(run, "package string, records long, bytes long"), "packages")


# ---- reading ----

END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF


def read_at(file: BinaryIO, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the package ends early")
    return data


def directory_place(file: BinaryIO, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory."""
    tail_at = max(0, size - 22 - FULL_16)
    tail = read_at(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    locator = read_at(file, tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == LOCATOR and (entries == FULL_16 or length == FULL_32 or offset == FULL_32):
        end = read_at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of the central directory")
        entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    return offset, length, entries


def members(file: BinaryIO, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of every stored member; others are left out."""
    offset, length, entries = directory_place(file, size)
    data, at, out = read_at(file, offset, length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("malformed central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, whole, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", data, at + 20)
        start = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_size].decode("utf-8", "replace")
        extra, here = data[at + 46 + name_size : at + 46 + name_size + extra_size], 0
        while here + 4 <= len(extra):
            kind, span = struct.unpack_from("<HH", extra, here)
            if kind == 1:  # 64-bit forms of those fields, in this order, that are full
                wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, here + 4))
                whole = next(wide) if whole == FULL_32 else whole
                packed = next(wide) if packed == FULL_32 else packed
                start = next(wide) if start == FULL_32 else start
            here += 4 + span
        at += 46 + name_size + extra_size + comment_size
        if method == 0 and packed == whole:
            head = read_at(file, start, 30)
            if head[:4] != LOCAL:
                raise ValueError("malformed member")
            out[name] = (start + 30 + sum(struct.unpack_from("<HH", head, 26)), whole)
    return out


def parsed(data: bytes) -> tuple[int | None, str, int, str, int | None]:
    """(page_id, type, payload bytes, digest, refers_to) of one record; a response is measured, a revisit tells its own."""
    text = gzip.decompress(data)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    page_id, kind = None if name == "null" else int(name), fields["WARC-Type"]
    if kind == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return page_id, kind, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return page_id, kind, len(payload), digest(payload), None


def record_ranges(packages: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(package, begin, lengths): neighbouring records of a package, about `read_bytes` together, by its index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for address in (a for batch in batches for a in batch.column("package").to_pylist()):
            system, path = file_system(address)
            with system.open_input_file(path) as file:
                inside = members(file, file.size())
                at, size = inside[INDEX]
                index = np.fromstring(read_at(file, at, size).decode(), np.int64, sep=" ").reshape(-1, 2)
                group = np.cumsum(index[:, 1]) // read_bytes
                bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(index)]
                rows = [(address, inside[WARC][0] + int(index[a, 0]), index[a:b, 1].tolist()) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["package", "begin", "lengths"])

    return packages.select("package").mapInArrow(run, "package string, begin long, lengths array<long>")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Every record of the packages (package, bytes): page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, begin, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, path = file_system(address)
                with system.open_input_file(path) as file:
                    data = io.BytesIO(read_at(file, begin, sum(lengths)))
                rows = [parsed(data.read(n)) for n in lengths]
                columns = [[r[i] for r in rows] for i in (0, 2, 3, 1, 4)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORD.split(", ")])

    # Ranges are dealt out anew, so one large package is read by many tasks. Their rows are tiny, so the number is given by the bytes.
    tasks = packages.agg(F.sum(F.ceil(F.col("bytes") / read_bytes))).first()[0] or 1
    return record_ranges(packages, read_bytes).repartition(min(int(tasks), MOST_TASKS), "package", "begin").mapInArrow(run, RECORD)


def package_folder(spark: SparkSession) -> str:
    return f"{stage_folder(spark).rstrip('/')}/vacantia/packages-{uuid.uuid4().hex}"
