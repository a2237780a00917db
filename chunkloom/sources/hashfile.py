"""Binary hash files (versions 1 to 7): scans of file systems as files and chunk hashes, packed and little-endian.

Read by Spark's binary reader and taken apart in Arrow functions, so any store that Spark reaches will do. Version 7 can be written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import parsed

# Fixed values of the format.
MAGIC = 0xDEADDEAD
PATH_BYTES = 4096
PARAMETER_BYTES = 44
FIXED, VARIABLE = 1, 2
CHUNKING = {1: "fixed", 2: "variable"}
HASHING = {1: "MD5", 2: "SHA256", 3: "MD5, 48 bits", 4: "Murmur", 5: "MD5, 64 bits", 6: "SHA1"}
#: The last version whose files have only size, chunk count and path.
LAST_SHORT = 3
LINK_MASK, LINK = 0o170000, 0o120000


class HashFileError(ValueError):
    """Not a hash file, or one that ends early."""


@dataclass
class Header:
    version: int
    files: int
    root: str
    chunks: int
    method: int
    parameters: bytes
    hashing: int
    hash_bits: int
    system: str = ""
    start_time: int = 0
    end_time: int = 0
    total_bytes: int = 0

    @property
    def chunk_size(self) -> int:
        return struct.unpack_from("<I", self.parameters)[0]

    def describe(self) -> tuple[str, str]:
        """(chunking, hashing) in words; both are known for every method here."""
        how = f"fixed, {self.chunk_size} bytes" if self.method == FIXED else "variable"
        return how, HASHING.get(self.hashing, f"unknown ({self.hashing})")


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise HashFileError("the file ends early")
        self.at += n
        return out

    def numbers(self, fmt: str) -> tuple:
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def read_header(c: Cursor) -> Header:
    magic, version, files = c.numbers("IIQ")
    if magic != MAGIC:
        raise HashFileError("wrong magic number")
    if not 1 <= version <= 7:
        raise HashFileError(f"version {version} is unknown")
    root = _text(c.take(PATH_BYTES))
    chunks, method = c.numbers("QI")
    parameters = c.take(PARAMETER_BYTES)
    hashing, bits = c.numbers("II")
    h = Header(version, files, root, chunks, method, parameters, hashing, bits)
    if version >= 3:
        h.system = _text(c.take(PATH_BYTES))
        h.start_time, h.end_time = c.numbers("QQ")
    if version >= 5:
        (h.total_bytes,) = c.numbers("Q")
    return h


FILE_FIELDS = ("path", "target_path", "file_size", "blocks", "uid", "gid", "perm", "atime", "mtime", "ctime", "hardlinks", "deviceid", "inodenum", "chunks")


def read_file(c: Cursor, version: int) -> dict:
    """A file's header and its path: three layouts, the last with a block count from version 5 on."""
    f = dict.fromkeys(FILE_FIELDS, 0) | {"path": "", "target_path": ""}
    if version == 1:
        f["path"] = _text(c.take(PATH_BYTES))
        f["file_size"], f["chunks"] = c.numbers("QQ")
    elif version <= LAST_SHORT:
        f["file_size"], f["chunks"], n = c.numbers("QQI")
        f["path"] = _text(c.take(n))
    else:
        (f["file_size"],) = c.numbers("Q")
        if version >= 5:
            (f["blocks"],) = c.numbers("Q")
        *values, n, target = c.numbers("IIQQQQQQQQII")
        f |= dict(zip(("uid", "gid", "perm", "atime", "mtime", "ctime", "hardlinks", "deviceid", "inodenum", "chunks"), values, strict=True))
        f["path"] = _text(c.take(n))
        if f["perm"] & LINK_MASK == LINK:
            f["target_path"] = _text(c.take(target))
    return f


def chunk_sizes(h: Header, f: dict, i: int, c: Cursor) -> int:
    if h.method == FIXED:
        if i < f["chunks"] - 1:
            return h.chunk_size
        return min(max(f["file_size"] - i * h.chunk_size, 0), h.chunk_size)
    if h.version >= 7:
        return c.numbers("I")[0]
    if h.version >= 3:
        return c.numbers("Q")[0]
    return 0  # not recorded


def parse(data: bytes) -> Iterator[tuple[Header, int, dict, list[tuple[bytes, int, int]]]]:
    """(header, file number, file, [(hash, size, compression ratio)]) of each file."""
    c = Cursor(data)
    h = read_header(c)
    for number in range(h.files):
        f = read_file(c, h.version)
        chunks = []
        for i in range(f["chunks"]):
            size = chunk_sizes(h, f, i, c)
            digest = c.take(h.hash_bits // 8)
            ratio = c.numbers("B")[0] if h.version >= 6 else 0
            chunks.append((digest, size, ratio))
        yield h, number, f, chunks


def to_fingerprint(digest: bytes) -> bytes:
    """20 bytes: shorter hashes are filled with zeros, longer ones keep their beginning."""
    return digest[:20].ljust(20, b"\0")


CHUNK_SCHEMA = "file_no bigint, chunk_no bigint, path string, fp binary, size bigint, cratio int"
FILE_SCHEMA = "file_no bigint, path string, target_path string, file_size bigint, blocks bigint, uid bigint, gid bigint, perm bigint, atime timestamp, mtime timestamp, ctime timestamp, hardlinks bigint, deviceid bigint, inodenum bigint, chunks bigint"
HEADER_SCHEMA = "version int, files bigint, path_root string, chunks bigint, chunking string, hashing string, hash_bits int, system string, total_bytes bigint"


def _parsed(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path), schema, rows_of)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their fingerprints as 20 bytes."""
    return _parsed(spark, path, CHUNK_SCHEMA, chunk_rows)


def chunk_rows(data: bytes) -> Iterator[tuple]:
    return ((n, i, f["path"], to_fingerprint(d), s, r) for _, n, f, chunks in parse(data) for i, (d, s, r) in enumerate(chunks))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with owner, times and links (from version 3 or 4 on)."""
    return _parsed(spark, path, FILE_SCHEMA, file_rows)


def file_rows(data: bytes) -> Iterator[tuple]:
    import datetime as dt

    utc = lambda s: dt.datetime.fromtimestamp(s, dt.UTC)
    return ((n, *[utc(f[k]) if k in ("atime", "mtime", "ctime") else f[k] for k in FILE_FIELDS]) for _, n, f, _ in parse(data))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, HEADER_SCHEMA, header_rows)


def header_rows(data: bytes) -> list[tuple]:
    h = read_header(Cursor(data))
    return [(h.version, h.files, h.root, h.chunks, *h.describe(), h.hash_bits, h.system, h.total_bytes)]


def stream(spark: SparkSession, path: str, bv: int) -> DataFrame:
    """A hash file as one version's chunk stream (bv, file_no, chunk_no, fp, size)."""
    return read_chunks(spark, path).select(F.lit(bv).alias("bv"), "file_no", "chunk_no", "fp", F.col("size").cast("int").alias("size"))


def build(files: Iterable[dict], method: int = VARIABLE, chunk_size: int = 0, hashing: int = 6, hash_bits: int = 160, version: int = 7, root: str = "/", system: str = "") -> bytearray:
    """A hash file of any version. files: dicts with path, ``hashes`` [(hash, size, ratio)] and any of FILE_FIELDS; they pass by once."""
    def header(count: int, total: int, size: int) -> bytes:
        head = [struct.pack("<IIQ", MAGIC, version, count), root.encode().ljust(PATH_BYTES, b"\0"), struct.pack("<QI", total, method), struct.pack("<I", chunk_size).ljust(PARAMETER_BYTES, b"\0"), struct.pack("<II", hashing, hash_bits)]
        if version >= 3:
            head += [system.encode().ljust(PATH_BYTES, b"\0"), struct.pack("<QQ", 0, 0)]
        if version >= 5:
            head.append(struct.pack("<Q", size))
        return b"".join(head)

    content, count, total, whole = bytearray(header(0, 0, 0)), 0, 0, 0
    for f in files:
        out = []
        count, total, whole = count + 1, total + len(f["hashes"]), whole + f.get("file_size", 0)
        get = lambda k, f=f: f.get(k, 0)
        path, target = f["path"].encode(), f.get("target_path", "").encode()
        n = len(f["hashes"])
        if version == 1:
            out += [path.ljust(PATH_BYTES, b"\0"), struct.pack("<QQ", get("file_size"), n)]
        elif version <= LAST_SHORT:
            out += [struct.pack("<QQI", get("file_size"), n, len(path)), path]
        else:
            if version >= 5:
                out.append(struct.pack("<QQ", get("file_size"), get("blocks")))
            else:
                out.append(struct.pack("<Q", get("file_size")))
            out.append(struct.pack("<IIQQQQQQQQII", get("uid"), get("gid"), get("perm"), get("atime"), get("mtime"), get("ctime"), get("hardlinks"), get("deviceid"), get("inodenum"), n, len(path), len(target)))
            out += [path, target if get("perm") & LINK_MASK == LINK else b""]
        for digest, size, ratio in f["hashes"]:
            if method == VARIABLE and version >= 3:
                out.append(struct.pack("<I" if version >= 7 else "<Q", size))
            out.append(digest)
            if version >= 6:
                out.append(struct.pack("<B", ratio))
        content += b"".join(out)
    head = header(count, total, whole)
    content[: len(head)] = head
    return content


def write(spark: SparkSession, files: DataFrame, chunks: DataFrame, path: str) -> None:
    """One version's files (file_no, filename) and chunks (file_no, chunk_no, fp, size) as a version 7 hash file in ``path``.

    The format is one file with counts in front, so it is put together in one place, as a trace of one version.
    """
    import os

    own: dict[int, dict] = {r["file_no"]: {"path": r["filename"], "hashes": [], "file_size": 0} for r in files.orderBy("file_no").toLocalIterator()}
    for r in chunks.orderBy("file_no", "chunk_no").toLocalIterator():
        own[r["file_no"]]["hashes"].append((bytes(r["fp"]), r["size"], 0))
        own[r["file_no"]]["file_size"] += r["size"]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as out:
        out.write(build(list(own.values())))
