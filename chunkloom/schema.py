"""Schemas of the chunk-stream tables, as DDL. State marks are columns, never rows; a missing container id is null."""

from __future__ import annotations

FILES = "bv int, file_no bigint, filename string, content binary"
CHUNKS = "bv int, file_no bigint, chunk_no bigint, seq bigint, fp binary, size int"
RECIPES = "bv int, seq bigint, file_no bigint, segment_no bigint, fp binary, cid bigint, size int"
FILE_RECIPES = "bv int, file_no bigint, filename string, chunknum bigint, filesize bigint"
VERSIONS = "bv int, path string, deleted boolean, number_of_files bigint, number_of_chunks bigint"
CONTAINERS = "cid bigint, bv int, chunk_num int, data_size int"
CONTAINER_ENTRIES = "cid bigint, fp binary, off int, len int"
FEATURE_INDEX = "feature binary, unit_id bigint, ord int"
SPARSE_CONTAINERS = "bv int, cid bigint, size bigint"
MANIFEST = "cid bigint, last_bv int"
TRACE = "bv int, file_no bigint, chunk_no bigint, filename string, fp binary, size int"
JOB_STATS = ("bv int, number_of_files bigint, number_of_chunks bigint, data_size bigint, unique_chunks bigint, unique_size bigint, rewritten_chunks bigint, rewritten_size bigint, "
    "zero_chunks bigint, zero_size bigint, stored_data_size bigint, dedup_ratio double, rewrite_ratio double, total_containers int, sparse_containers int, inherited_sparse int, "
    "lookup_requests bigint, update_requests bigint, lookups_for_unique bigint, prefetched_units bigint"
)
RESTORE_STATS = "bv int, policy string, cache_size int, data_size bigint, chunk_num bigint, read_containers bigint, speed_factor double"

#: Bits of a chunk's state, for export: unique 0, then duplicate, sparse, out of order, in cache, rewrite denied.
FLAGS = {"is_dup": 0x100, "is_sparse": 0x200, "is_ooo": 0x400, "in_cache": 0x800, "rewrite_denied": 0x1000}
