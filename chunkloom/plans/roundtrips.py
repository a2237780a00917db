"""Queries that write a format and read it again: traces, hash files, folders, stores, index dumps, Bloom filters; and the choices a configuration makes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace
from itertools import chain, groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SMALL, DedupConfig
from ..functions import bloom
from ..functions import fingerprints as fx
from ..operators import chunking, lookup, packing, restore, sampling, segmenting
from ..sources import binary_store, hashfile, images, snapshots, store, trace
from .catalog import _CH, _CONTENT, _FILES, _FIRST, _K, _RANDOM, _RANKED, _RECIPE, _RECORDS, CAPACITY, CHUNK, RATIO, SEGMENT, _fixed, _hex, _long, _recipe, query
from .folds import work_dir
from .workspace import Workspace, packing_offsets


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the files of one version, in the order of their ids."""
    return snapshots.document_files(spark, sf_dir, versions=1)


_ONE = f"""f AS (SELECT 0 AS bv, doc_id AS file_no, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT file_no, unnest(range(0, CAST(ceil(n / {CHUNK}.0) AS BIGINT))) AS chunk_no, b, n FROM f),
ch AS (SELECT file_no, chunk_no, upper(sha1(b[chunk_no * {CHUNK} + 1 : chunk_no * {CHUNK} + {CHUNK}])) AS fp, CAST(least({CHUNK}, n - chunk_no * {CHUNK}) AS BIGINT) AS size FROM x)"""


@query(f"WITH {_ONE}, o AS (SELECT file_no, row_number() OVER (ORDER BY file_no) - 1 AS i FROM f) SELECT o.i AS file_no, ch.chunk_no, 'doc-' || ch.file_no::VARCHAR AS filename, ch.fp, ch.size FROM ch JOIN o ON o.file_no = ch.file_no")
def trace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native text trace, written and read: chunks in the order of its lines."""
    files = _documents(spark, sf_dir)
    path = f"{work_dir(spark)}/trace-{uuid.uuid4().hex}"
    trace.write_trace(trace.trace_lines(chunking.fixed_chunks(files, CHUNK), files), 0, path)
    return _long(_hex(trace.read_trace(spark, path, 0), "fp"), "size").select("file_no", "chunk_no", "filename", "fp", "size")


@query("WITH f AS (SELECT doc_id, coalesce(text, '') || chr(10) AS t FROM documents) SELECT row_number() OVER (ORDER BY encode('doc=' || doc_id::VARCHAR || '/')) - 1 AS file_no, 'doc=' || doc_id::VARCHAR AS folder, octet_length(encode(t))::BIGINT AS bytes, sha1(encode(t)) AS content_hash FROM f")
def directory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of folders, a file in each, read as one version: files in the order of their paths, whole contents."""
    path = f"{work_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs = snapshots.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("doc").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)
    files = snapshots.directory_files(spark, path, 0)
    return files.select("file_no", F.substring_index("filename", "/", 1).alias("folder"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha1("content").alias("content_hash"))


def _hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash file a version, of its files and their chunks."""
    chunks = chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), CHUNK)
    files = snapshots.document_files(spark, sf_dir).select("bv", "file_no", F.col("filename").alias("path"), F.octet_length("content").alias("file_size"))
    hashes = chunks.groupBy("bv", "file_no").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "fp", "size"))).alias("hashes"))
    whole = files.join(hashes, ["bv", "file_no"], "left")

    def build(rows: Iterator[dict]) -> bytearray:
        return hashfile.build(({"path": r["path"], "file_size": r["file_size"], "hashes": [(h["fp"], h["size"], 0) for h in r["hashes"] or []]} for r in rows), root="/root", system="table")

    return images.imaged(whole, ["bv"], ["file_no"], build)


@query(f"{_CH}, o AS (SELECT bv, file_no, doc_id, row_number() OVER (PARTITION BY bv ORDER BY file_no) - 1 AS i FROM f) SELECT ch.bv, o.i AS file_no, ch.chunk_no, 'doc-' || o.doc_id::VARCHAR AS path, ch.fp, ch.size, 0::BIGINT AS cratio FROM ch JOIN o ON o.bv = ch.bv AND o.file_no = ch.file_no")
def hash_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of binary hash files, read in the order of their files."""
    rows = images.parsed(_hash_files(spark, sf_dir), hashfile.CHUNK_SCHEMA, hashfile.chunk_rows, ["bv"])
    return _long(_hex(rows, "fp"), "bv", "cratio").select("bv", "file_no", "chunk_no", "path", "fp", "size", "cratio")


@query(f"WITH {_FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY bv ORDER BY file_no) - 1 AS i FROM f) SELECT bv, i AS file_no, 'doc-' || doc_id::VARCHAR AS path, n::BIGINT AS file_size, ceil(n / {CHUNK}.0)::BIGINT AS chunks, 0::BIGINT AS uid FROM o")
def hash_file_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.parsed(_hash_files(spark, sf_dir), hashfile.FILE_SCHEMA, hashfile.file_rows, ["bv"])
    return _long(rows, "bv").select("bv", "file_no", "path", "file_size", "chunks", "uid")


@query(f"WITH {_FILES} SELECT bv, 7::BIGINT AS version, count(*) AS files, sum(ceil(n / {CHUNK}.0))::BIGINT AS chunks, sum(n)::BIGINT AS total_bytes, '/root' AS path_root, 'variable' AS chunking, 'SHA1' AS hashing, 160::BIGINT AS hash_bits, 'table' AS system FROM f GROUP BY bv")
def hash_file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.parsed(_hash_files(spark, sf_dir), hashfile.HEADER_SCHEMA, hashfile.header_rows, ["bv"])
    return _long(rows, "bv", "version", "hash_bits").select("bv", "version", "files", "chunks", "total_bytes", "path_root", "chunking", "hashing", "hash_bits", "system")


_PACKED = f"""WITH RECURSIVE {_FIRST[5:]}, s AS (SELECT *, row_number() OVER (PARTITION BY bv ORDER BY seq) AS i FROM d WHERE k = 1),
r AS (SELECT bv, i, fp, size, 0::BIGINT AS l, size AS used, 1::BIGINT AS n FROM s WHERE i = 1 UNION ALL
SELECT s.bv, s.i, s.fp, s.size, CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN r.l + 1 ELSE r.l END, CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN s.size ELSE r.used + s.size END,
CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN 1 ELSE r.n + 1 END FROM r JOIN s ON s.bv = r.bv AND s.i = r.i + 1)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_offsets(packing.pack_containers(lookup.first_occurrences(_fixed(spark, sf_dir)), SMALL))


@query(f"{_PACKED} SELECT bv, l AS cid, fp, (used - size)::BIGINT AS off, size AS len FROM r")
def container_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of binary container pools, one a version, written and read."""
    packed = _packed(spark, sf_dir)
    base = packed.groupBy("bv").agg(F.min("cid").alias("base"))
    local = packed.join(base, "bv").select("bv", (F.col("cid") - F.col("base")).alias("cid"), "seq", "fp", "size")

    def build(rows: Iterator[dict]) -> bytearray:
        own = ((cid, [(r["fp"], bytes(r["size"])) for r in g]) for cid, g in groupby(rows, key=lambda r: r["cid"]))
        return binary_store.build_pool(own, directory_only=True)

    rows = images.parsed(images.imaged(local, ["bv"], ["cid", "seq"], build), binary_store.ENTRIES, lambda d: binary_store.entry_rows(d, True), ["bv"])
    return _long(_hex(rows, "fp"), "bv", "off", "len")


@query(f"{_PACKED}, nc AS (SELECT bv, max(l) + 1 AS c FROM r GROUP BY bv), ba AS (SELECT bv, coalesce(sum(c) OVER (ORDER BY bv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nc) SELECT (r.l + ba.b)::BIGINT AS cid, r.fp, r.size AS len FROM r JOIN ba ON ba.bv = r.bv")
def container_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written to the store's tables, directories and blocks, and read: each chunk cut out of its block and hashed again."""
    chunks = chunking.with_seq(chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), CHUNK, with_data=True))
    packed = _packed(spark, sf_dir)
    root = f"{work_dir(spark)}/store-{uuid.uuid4().hex}"
    data = packed.join(chunks.select("bv", "seq", "data"), ["bv", "seq"])
    store.write_containers(packed.select("cid", "fp", "off", F.col("size").alias("len")), root, restore.container_payload(data))
    entries, blocks = (spark.read.parquet(f"{root}/{n}").drop("cid_group") for n in ("container_entries", "containers"))
    cut = restore.chunk_from_container(blocks, entries)
    return cut.select("cid", fx.encode_hex(fx.fingerprint(F.col("data"))).alias("fp"), F.octet_length("data").cast("bigint").alias("len"))


@query(f"{_RECIPE} SELECT bv, row_number() OVER (PARTITION BY bv ORDER BY seq) - 1 AS seq, segment_no, fp, cid, size FROM rc")
def recipe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary recipes, one a version, written and read: pointers in the order of the stream, numbered by segment."""

    def build(rows: Iterator[dict]) -> bytearray:
        return binary_store.build_recipe([(r["fp"], r["cid"], r["size"]) for r in g] for _, g in groupby(rows, key=lambda r: r["segment_no"]))

    made = images.imaged(_recipe(spark, sf_dir).select("bv", "seq", "segment_no", "fp", "cid", "size"), ["bv"], ["seq"], build)
    return _long(_hex(images.parsed(made, "seq bigint, segment_no bigint, fp binary, cid bigint, size int", binary_store.recipe_rows, ["bv"]), "fp"), "bv", "size")


@query(f"WITH {_FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY bv ORDER BY file_no) - 1 AS i FROM f) SELECT bv, i AS file_no, 'doc-' || doc_id::VARCHAR AS filename, ceil(n / {CHUNK}.0)::BIGINT AS chunknum, n::BIGINT AS filesize FROM o")
def version_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary version files (number, path, files with their sizes), written and read."""
    files = snapshots.document_files(spark, sf_dir).select("bv", "file_no", "filename", F.octet_length("content").cast("bigint").alias("filesize"))

    def build(rows: Iterator[dict]) -> bytes:
        first = next(rows)
        own = [(r["filename"], -(-r["filesize"] // CHUNK), r["filesize"]) for r in chain((first,), rows)]
        return binary_store.build_meta(first["bv"], "/documents", False, sum(k for _, k, _ in own), own)

    rows = images.parsed(images.imaged(files, ["bv"], ["file_no"], build), "file_no bigint, filename string, chunknum bigint, filesize bigint", lambda d: binary_store.meta(d)[1], ["bv"])
    return _long(rows, "bv")


@query(f"{_RECORDS} SELECT bv, record, cid FROM ar")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary access records, one file a version, written and read."""
    made = images.imaged(packing.access_records(_recipe(spark, sf_dir)).select("bv", "record", "cid"), ["bv"], ["record"], lambda rows: binary_store.build_records(r["cid"] for r in rows))
    return _long(images.parsed(made, "record bigint, cid bigint", binary_store.record_rows, ["bv"]), "bv")


@query(f"{_RANDOM}, k AS (SELECT feature, bv * 1000000 + segment_no AS unit_id, row_number() OVER (PARTITION BY feature ORDER BY bv DESC, segment_no DESC) - 1 AS ord FROM ft) SELECT feature, unit_id, ord FROM k WHERE ord < 2")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature index as binary dumps, dealt by feature, written and read."""
    unit = (F.col("bv").cast("bigint") * 1_000_000 + F.col("segment_no")).cast("bigint")
    segmented = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)
    rows = sampling.feature_index(sampling.sample_random(segmented, ["bv", "segment_no"], RATIO), unit, ["bv", "segment_no"], 2)

    def build(own: Iterator[dict]) -> bytearray:
        return binary_store.build_index(((f, [r["unit_id"] for r in g]) for f, g in groupby(own, key=lambda r: r["feature"])), 2)

    made = images.imaged(rows.withColumn("part", F.pmod(F.xxhash64("feature"), F.lit(16)).cast("int")), ["part"], ["feature", "ord"], build)
    return _long(_hex(images.parsed(made, "feature binary, unit_id bigint, ord int", binary_store.index_rows), "feature"), "ord")


@query(f"{_CH} SELECT DISTINCT fp FROM ch WHERE bv >= 10 AND fp IN (SELECT fp FROM ch WHERE bv < 10)")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the later versions that a Bloom filter of the earlier ones lets pass, and that the index then knows: none is lost by the filter."""
    chunks = _fixed(spark, sf_dir)
    old = chunks.where("bv < 10").select("fp").distinct()
    maybe = bloom.might_contain(chunks.where("bv >= 10"), "fp", bloom.build(old, "fp"))
    return _hex(maybe.join(old, "fp", "left_semi"), "fp")


@query("""WITH g AS (SELECT event_id % 8 AS bv, sum(length(props))::BIGINT AS bytes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events GROUP BY 1) SELECT bv, bytes, CASE WHEN seconds > 0 THEN round(bytes / (1048576.0 * seconds) * 1e9) END::BIGINT AS nano_mib_a_second FROM g""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes a second of event time, as a job's report has them."""
    e = snapshots.table(spark, sf_dir, "events")
    g = e.groupBy((F.col("event_id") % 8).alias("bv")).agg(F.sum(F.length("props")).cast("bigint").alias("bytes"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)).alias("seconds"))
    return g.select("bv", "bytes", F.round(fx.throughput(F.col("bytes"), F.col("seconds")) * 1e9).cast("bigint").alias("nano_mib_a_second"))


@query("SELECT DISTINCT o_custkey AS n, (1::BIGINT << (length(bin(o_custkey)) - 1)::INT)::BIGINT AS rounded FROM orders WHERE o_custkey > 0")
def chunk_size_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average chunk sizes as the rolling chunkers round them."""
    return snapshots.table(spark, sf_dir, "orders").where("o_custkey > 0").select(F.col("o_custkey").alias("n"), fx.power_of_two(F.col("o_custkey")).alias("rounded")).distinct()


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS switch FROM events")
def yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches as directive lines spell them."""
    word = F.element_at(F.array(F.lit("Yes"), F.lit("no"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int"))
    return snapshots.table(spark, sf_dir, "events").select("event_id", fx.yes_no(word).alias("switch"))


@query(f"""{_CONTENT} SELECT 'fixed' AS algorithm, bv, seq // {SEGMENT} AS segment_no, count(*) AS chunks FROM ch GROUP BY 1, 2, 3 UNION ALL SELECT 'file-defined', bv, file_no, count(*) FROM ch GROUP BY 1, 2, 3
UNION ALL SELECT 'content-defined', bv, segment_no, count(*) FROM sg GROUP BY 1, 2, 3""")
def segmenting_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by the algorithm that a configuration names. No segment is empty, the last one neither."""
    chunks, out = _fixed(spark, sf_dir), None
    base = replace(SMALL, index_logical=True)
    for cfg in (replace(base, segment_algorithm="fixed"), replace(base, segment_algorithm="file-defined"), replace(base, segment_algorithm="content-defined", segment_average=32, segment_min=1, segment_max=1 << 30)):
        rows = segmenting.segments(chunks, cfg).groupBy("bv", "segment_no").agg(F.count("*").alias("chunks")).select(F.lit(cfg.segment_algorithm).alias("algorithm"), F.col("bv").cast("bigint").alias("bv"), "segment_no", "chunks")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{_RANKED}, hit AS (SELECT DISTINCT bv, segment_no, fp AS feature FROM sg WHERE concat('0x', substr(fp, 39, 2), substr(fp, 37, 2), substr(fp, 35, 2), substr(fp, 33, 2))::BIGINT % {RATIO} = 0)
SELECT 'min' AS method, bv, segment_no, fp AS feature FROM r WHERE k <= {_K} UNION SELECT 'optmin', bv, segment_no, back FROM r WHERE k <= {_K}
UNION SELECT 'uniform', bv, segment_no, fp FROM (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY seq) - 1 AS i FROM sg) WHERE i % {RATIO} = 0
UNION SELECT 'random', bv, segment_no, feature FROM hit UNION SELECT 'random', bv, segment_no, '{"0" * 40}' FROM sg WHERE (bv, segment_no) NOT IN (SELECT (bv, segment_no) FROM hit)""")
def sampling_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by the method that a configuration names."""
    segmented, out = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT), None
    for method in ("min", "optmin", "uniform", "random"):
        rows = sampling.features(segmented, ["bv", "segment_no"], DedupConfig(sampling_method=method, sampling_ratio=RATIO)).select(F.lit(method).alias("method"), F.col("bv").cast("bigint").alias("bv"), "segment_no", F.hex("feature").alias("feature"))
        out = rows if out is None else out.unionByName(rows)
    return out


_PAGES = """f AS (SELECT page_id % 3 AS bv, page_id, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
x AS (SELECT bv, page_id, unnest(range(0, CAST(ceil(n / 512.0) AS BIGINT))) AS chunk_no, b, n FROM f),
ch AS (SELECT bv, sha1(b[chunk_no * 512 + 1 : chunk_no * 512 + 512]) AS fp, least(512, n - chunk_no * 512) AS size FROM x),
g AS (SELECT fp, min(bv) AS bv, min(size) AS size FROM ch GROUP BY fp),
j AS (SELECT f.bv, count(*) AS files, max(c.chunks) AS chunks, max(c.data_size) AS data_size, max(s.unique_chunks) AS unique_chunks, max(s.stored_size) AS stored_size FROM f
JOIN (SELECT bv, count(*) AS chunks, sum(size) AS data_size FROM ch GROUP BY bv) c ON c.bv = f.bv JOIN (SELECT bv, count(*) AS unique_chunks, sum(size) AS stored_size FROM g GROUP BY bv) s ON s.bv = f.bv GROUP BY f.bv)"""


@query(f"""WITH {_PAGES} SELECT bv, files, chunks, bv = 0 AS deleted, concat_ws(' ', bv, files, chunks, data_size, unique_chunks, stored_size, printf('%.6f', (data_size - stored_size) / data_size::DOUBLE), (sum(stored_size) OVER (ORDER BY bv))::BIGINT) AS line FROM j""")
def workspace_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three backups of pages into a working directory without payload, the first deleted; a version a row, with its line of the log. A deleted version can't be restored, and a cleared directory counts from 0."""
    root = f"{work_dir(spark)}/workspace-{uuid.uuid4().hex}"
    space = Workspace(spark, DedupConfig(chunk_algorithm="fixed", chunk_avg_size=512, index_exact=True, simulation_level="append"), root)
    pages = snapshots.page_files(spark, sf_dir)
    for v in range(3):
        space.backup(pages.where(F.col("file_no") % 3 == v).select("file_no", "filename", "content"), f"/pages/{v}")
    space.delete(0)
    try:
        space.restore(0)
    except ValueError:
        state = space.versions().select(F.col("bv").cast("bigint").alias("bv"), F.col("number_of_files").cast("bigint").alias("files"), F.col("number_of_chunks").cast("bigint").alias("chunks"), "deleted")
        return state.join(space.log().select(F.col("bv").cast("bigint").alias("bv"), "line"), "bv")
    raise AssertionError("a deleted version was restored")
