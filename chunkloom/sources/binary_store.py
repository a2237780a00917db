"""Binary state files of a store in the native layout: container pool, recipes, file recipes, access records, index dump.

They are read by Spark's binary reader (2 GB a file at most) and taken apart in Arrow functions, so that a store made elsewhere can be analysed or moved
into Parquet tables; the ``build_*`` functions write the same bytes. Numbers are little-endian, but for a container's directory header, which is big-endian.
"""

from __future__ import annotations

import struct
import sys
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..config import CONTAINER_BYTES, DIRECTORY_BYTES
from .images import parsed

# Fixed values of the layout: the counter in front of a pool, the marks of a segment's ends in a recipe, and the end of access records.
POOL_HEADER = 8
SEGMENT_START, SEGMENT_END = -4, -8
NO_ID = -1
_POINTER = struct.Struct("<20sqi")
_ENTRY = struct.Struct("<20sii")


def _table(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path), schema, rows_of)


def pool_blocks(data: bytes, directory_only: bool = False) -> Iterator[tuple[int, list[tuple[bytes, int, int]], bytes]]:
    """(cid, [(fp, off, len)], bytes of the chunks) of each container; a pool of a simulated store has directories only."""
    size = DIRECTORY_BYTES if directory_only else CONTAINER_BYTES
    for at in range(POOL_HEADER, len(data) - size + 1, size):
        base = at + size - DIRECTORY_BYTES
        cid, n, used = struct.unpack_from(">qii", data, base)
        if not n:
            continue
        entries = []
        for i in range(n):
            fp, length, off = _ENTRY.unpack_from(data, base + 16 + i * _ENTRY.size)
            entries.append((fp, off, length))
        yield cid, sorted(entries, key=lambda e: e[1]), b"" if directory_only else data[at : at + used]


def read_entries(spark: SparkSession, path: str, directory_only: bool = False) -> DataFrame:
    """(cid, fp, off, len) of a container pool."""
    return _table(spark, path, ENTRIES, lambda d: entry_rows(d, directory_only))


ENTRIES = "cid bigint, fp binary, off int, len int"


def entry_rows(data: bytes, directory_only: bool = False) -> Iterator[tuple[int, bytes, int, int]]:
    return ((cid, *e) for cid, entries, _ in pool_blocks(data, directory_only) for e in entries)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(cid, data) of a container pool."""
    return _table(spark, path, "cid bigint, data binary", lambda d: ((cid, block) for cid, _, block in pool_blocks(d)))


def recipe_rows(data: bytes) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(seq, segment_no, fp, cid, size): segment marks become numbers."""
    seq, segment = 0, -1
    for fp, cid, size in _POINTER.iter_unpack(data[: len(data) // _POINTER.size * _POINTER.size]):
        if cid == SEGMENT_START:
            segment += 1
        elif cid != SEGMENT_END:
            yield seq, max(segment, 0), fp, cid, size
            seq += 1


def read_recipe(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "seq bigint, segment_no bigint, fp binary, cid bigint, size int", recipe_rows)


def meta(data: bytes) -> tuple[tuple[int, str, bool, int, int], list[tuple[int, str, int, int]]]:
    """((bv, path, deleted, files, chunks), [(file_no, filename, chunknum, filesize)])."""
    bv, deleted, files, chunks, n = struct.unpack_from("<iiqqi", data, 0)
    at = struct.calcsize("<iiqqi")
    path, at = data[at : at + n].decode("utf-8", "replace"), at + n
    rows = []
    for i in range(files):
        (n,) = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 4 + n].decode("utf-8", "replace")
        rows.append((i, name, *struct.unpack_from("<qq", data, at + 4 + n)))
        at += 4 + n + 16
    return (bv, path, bool(deleted), files, chunks), rows


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "bv int, path string, deleted boolean, number_of_files bigint, number_of_chunks bigint", lambda d: [meta(d)[0]])


def read_file_recipes(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "file_no bigint, filename string, chunknum bigint, filesize bigint", lambda d: meta(d)[1])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, cid): containers in the order in which a restore asks for them."""
    return _table(spark, path, "record bigint, cid bigint", record_rows)


def record_rows(d: bytes) -> Iterator[tuple[int, int]]:
    for i, (cid,) in enumerate(struct.iter_unpack("<q", d[: len(d) // 8 * 8])):
        if cid == NO_ID:
            return
        yield i, cid


def read_index(spark: SparkSession, path: str, key_size: int = 20) -> DataFrame:
    """(feature, unit_id, ord) of an index dump, the newest unit first; empty places are left out."""
    return _table(spark, path, "feature binary, unit_id bigint, ord int", lambda d: index_rows(d, key_size))


def index_rows(d: bytes, key_size: int = 20) -> Iterator[tuple[bytes, int, int]]:
    (n,) = struct.unpack_from("<i", d, 0)
    at = 4
    for _ in range(n):
        key = d[at : at + key_size]
        (k,) = struct.unpack_from("<i", d, at + key_size)
        at += key_size + 4
        for ord_, unit in enumerate(struct.unpack_from(f"<{k}q", d, at)):
            if unit != NO_ID:
                yield key, unit, ord_
        at += 8 * k


# ---- the same bytes, written


def build_pool(containers: Iterable[tuple[int, list[tuple[bytes, bytes]]]], directory_only: bool = False) -> bytearray:
    """A pool of (cid, [(fp, data)]), which pass by once; cids count from 0."""
    size = DIRECTORY_BYTES if directory_only else CONTAINER_BYTES
    out, count = bytearray(POOL_HEADER), 0
    for cid, chunks in containers:
        count += 1
        out += bytes(max(POOL_HEADER + (cid + 1) * size - len(out), 0))
        block = b"".join(d for _, d in chunks)
        at, off = POOL_HEADER + cid * size, 0
        directory = bytearray(struct.pack(">qii", cid, len(chunks), len(block)))
        for fp, d in chunks:
            directory += _ENTRY.pack(fp, len(d), off)
            off += len(d)
        if len(directory) > DIRECTORY_BYTES or not directory_only and len(block) > size - DIRECTORY_BYTES:
            raise ValueError(f"container {cid} overflows")
        if not directory_only:
            out[at : at + len(block)] = block
        base = at + size - DIRECTORY_BYTES
        out[base : base + len(directory)] = directory
    struct.pack_into("<q", out, 0, count)
    return out


def build_recipe(segments: Iterable[list[tuple[bytes, int, int]]]) -> bytearray:
    """A recipe of segments of (fp, cid, size), which pass by once."""
    out = bytearray()
    for s in segments:
        out += b"".join([_POINTER.pack(bytes(20), SEGMENT_START, len(s)), *[_POINTER.pack(*p) for p in s], _POINTER.pack(bytes(20), SEGMENT_END, len(s))])
    return out


def build_meta(bv: int, path: str, deleted: bool, chunks: int, files: list[tuple[str, int, int]]) -> bytes:
    raw = path.encode()
    head = struct.pack("<iiqqi", bv, deleted, len(files), chunks, len(raw)) + raw
    return head + b"".join(struct.pack("<i", len(n.encode())) + n.encode() + struct.pack("<qq", k, s) for n, k, s in files)


def build_records(cids: Iterable[int]) -> bytes:
    held = array("q", cids)
    held.append(NO_ID)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def build_index(index: dict[bytes, list[int]] | Iterable[tuple[bytes, list[int]]], value_length: int) -> bytearray:
    out, count = bytearray(4), 0
    for key, units in index.items() if isinstance(index, dict) else index:
        count += 1
        padded = [*units[:value_length], *[NO_ID] * (value_length - len(units))]
        out += key + struct.pack("<i", value_length) + struct.pack(f"<{value_length}q", *padded)
    struct.pack_into("<i", out, 0, count)
    return out
