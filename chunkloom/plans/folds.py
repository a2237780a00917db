"""Queries whose operators are folds: content-defined chunking, packing, replayed backups, restore simulations, streams, configuration."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, SMALL, DedupConfig, as_rows, parse_config
from ..functions import fingerprints as fx
from ..operators import chunking, lookup, packing, segmenting
from ..operators.ordered import ordered_fold
from ..sources import snapshots
from . import backup, restore
from .catalog import _CH, _FIRST, _RECORDS, _SEG, _TAIL, CAPACITY, CHUNK, _fixed, _hex, _long, _recipe, query
from .shared import work_dir

#: Small content-defined geometry: documents have some kilobytes.
CDC = DedupConfig(chunk_avg_size=512, chunk_min_size=128, chunk_max_size=2048)


def _content(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    rows = chunking.content_chunks(snapshots.document_files(spark, sf_dir), replace(CDC, chunk_algorithm=algorithm))
    return _hex(rows, "fp")


@query()
def rabin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir, "rabin")


@query()
def normalized_rabin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir, "normalized rabin")


@query()
def tttd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir, "tttd")


@query()
def ae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir, "ae")


@query()
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version stores after content-defined chunking."""
    rows = chunking.content_chunks(snapshots.document_files(spark, sf_dir), replace(CDC, chunk_algorithm="rabin"))
    path = f"{work_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # metadata: bytes are cut once, however often it is asked about
    return lookup.dedup_by_version(spark.read.parquet(path).withColumn("seq", F.col("file_no") * (1 << 32) + F.col("chunk_no")))


@query(f"""WITH RECURSIVE {_CH[5:]}, s AS (SELECT *, {_TAIL} AS t FROM ch),
r AS (SELECT bv, seq, 0::BIGINT AS segment_no, 1::BIGINT AS held FROM s WHERE seq = 0 UNION ALL
SELECT s.bv, s.seq, CASE WHEN r.held >= 96 OR (r.held >= 16 AND s.t % 32 = 0) THEN r.segment_no + 1 ELSE r.segment_no END, CASE WHEN r.held >= 96 OR (r.held >= 16 AND s.t % 32 = 0) THEN 1 ELSE r.held + 1 END FROM r JOIN s ON s.bv = r.bv AND s.seq = r.seq + 1)
SELECT bv, segment_no, count(*) AS chunks, min(seq) AS first_seq FROM r GROUP BY 1, 2""")
def content_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmenting.content_segments(_fixed(spark, sf_dir), 32, 16, 96)
    return _long(rows.groupBy("bv", "segment_no").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq")), "bv")


@query(f"""WITH RECURSIVE {_FIRST[5:]}, s AS (SELECT *, row_number() OVER (PARTITION BY bv ORDER BY seq) AS i FROM d WHERE k = 1),
r AS (SELECT bv, i, size, 0::BIGINT AS l, size AS used, 1::BIGINT AS n FROM s WHERE i = 1 UNION ALL
SELECT s.bv, s.i, s.size, CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN r.l + 1 ELSE r.l END, CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN s.size ELSE r.used + s.size END,
CASE WHEN r.used + s.size > {CAPACITY} OR r.n + 1 > {SMALL.container_entries} THEN 1 ELSE r.n + 1 END FROM r JOIN s ON s.bv = r.bv AND s.i = r.i + 1),
nc AS (SELECT bv, max(l) + 1 AS c FROM r GROUP BY bv), ba AS (SELECT bv, coalesce(sum(c) OVER (ORDER BY bv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nc)
SELECT (r.l + ba.b)::BIGINT AS cid, r.bv, count(*) AS chunk_num, sum(r.size)::BIGINT AS data_size FROM r JOIN ba ON ba.bv = r.bv GROUP BY 1, 2""")
def container_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-fit packing of each version's new chunks."""
    return _long(packing.containers(packing.pack_containers(lookup.first_occurrences(_fixed(spark, sf_dir)), SMALL)), "bv", "chunk_num")


_ROWS = ("unique_chunks", "unique_size", "number_of_chunks", "data_size")


@query(f"{_FIRST} SELECT bv, count(*) FILTER (WHERE k = 1) AS unique_chunks, coalesce(sum(size) FILTER (WHERE k = 1), 0)::BIGINT AS unique_size, count(*) AS number_of_chunks, sum(size)::BIGINT AS data_size FROM d GROUP BY bv")
def exact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed backup with an exact index stores what exact deduplication says, however it is configured."""
    cfg = replace(SMALL, index_preset="ddfs")
    return _long(backup.job_stats(_fixed(spark, sf_dir), {"ddfs": cfg}).select("bv", *_ROWS), "bv")


def presets() -> dict[str, DedupConfig]:
    """Every published index design, and the four quadrants without a name."""
    named = {k: replace(SMALL, index_preset=k, index_value_length=2) for k in PRESETS}
    plain = {
        "exact physical": replace(SMALL, index_exact=True, sampling_ratio=1),
        "exact logical": replace(SMALL, index_exact=True, index_logical=True, sampling_ratio=1, selection="base"),
        "near-exact physical": SMALL,
        "near-exact logical": replace(SMALL, index_logical=True, sampling_method="random", selection="top", selection_top=4, prefetching=4),
    }
    return named | plain


@query()
def index_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job statistics of each version under each index design."""
    return backup.job_stats(_fixed(spark, sf_dir), presets())


@query()
def near_exact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = replace(SMALL, index_logical=True, sampling_method="min", sampling_ratio=32, selection="top", selection_top=2, prefetching=2)
    return _hex(backup.replayed_recipes(_fixed(spark, sf_dir), {"near-exact": cfg}), "fp")


def rewriters() -> dict[str, DedupConfig]:
    base = replace(SMALL, index_preset="ddfs")
    return {
        "none": base,
        "cap": replace(base, rewrite_algorithm="cap"),
        "cfl": replace(base, rewrite_algorithm="cfl"),
        "cfl switched": replace(base, rewrite_algorithm="cfl", cfl_switch=True),
        "cbr": replace(base, rewrite_algorithm="cbr"),
        "har": replace(base, har=True),
        "har and cap, cache-aware": replace(base, har=True, rewrite_algorithm="cap", cache_aware=True),
    }


@query()
def rewrite_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rewriting algorithm writes again."""
    return backup.job_stats(_fixed(spark, sf_dir), rewriters())


def _one_rewriter(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _hex(backup.replayed_recipes(_fixed(spark, sf_dir), {name: rewriters()[name]}), "fp")

    return run


for _name, _key in (("cbr_rewrite", "cbr"), ("har_rewrite", "har"), ("cache_aware", "har and cap, cache-aware"), ("cfl_rewrite", "cfl switched"), ("cap_rewrite", "cap")):
    _f = _one_rewriter(_key)
    _f.__name__ = _name
    query()(_f)


@query(f"""{_RECORDS}, a AS (SELECT *, lag(record) OVER (PARTITION BY bv, cid ORDER BY record) AS prev FROM ar),
h AS (SELECT a.bv, a.record, a.prev, count(DISTINCT b.cid) AS between_ FROM a LEFT JOIN ar b ON b.bv = a.bv AND b.record > a.prev AND b.record < a.record GROUP BY 1, 2, 3),
m AS (SELECT bv, count(*) FILTER (WHERE prev IS NULL OR between_ >= 4) AS read_containers FROM h GROUP BY bv), t AS (SELECT bv, sum(size) AS s, count(*) AS n FROM rc GROUP BY bv)
SELECT m.bv, m.read_containers, least(1.0, ceil((t.s + 28 * t.n) / 4194304.0) / m.read_containers)::DOUBLE AS cfl, (t.s / (1048576.0 * m.read_containers))::DOUBLE AS speed_factor FROM m JOIN t ON t.bv = m.bv""")
def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses of a cache of 4 containers over each version's accesses, and the fragmentation level they mean."""
    recipe = _recipe(spark, sf_dir)

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield key[0], restore.lru_misses((r[2] for r in rows), 4)

    misses = ordered_fold(packing.access_records(recipe).select("bv", "record", "cid"), ["bv"], ["record"], "__bv int, read_containers bigint", fold)
    totals = recipe.groupBy("bv").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    out = totals.join(misses, F.col("bv") == F.col("__bv"))
    return _long(out.select("bv", "read_containers", fx.fragmentation_level(F.col("s"), F.col("n"), F.col("read_containers")).alias("cfl"), fx.speed_factor(F.col("s"), F.col("read_containers")).alias("speed_factor")), "bv")


POLICIES = [(p, s) for p in ("lru", "opt", "asm") for s in (2, 4, 8)]


def _simulated(spark: SparkSession, sf_dir: str, policies: list[tuple[str, int]]) -> DataFrame:
    rows = backup.replayed_recipes(_fixed(spark, sf_dir), {k: v for k, v in rewriters().items() if k in ("none", "har")})
    path = f"{work_dir(spark)}/recipes-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # a backup is replayed once, as a store keeps its recipes
    return restore.simulate(spark.read.parquet(path), policies, area=CAPACITY)


@query()
def restore_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers read by each cache policy and size, without rewriting and with history-aware rewriting."""
    return _simulated(spark, sf_dir, POLICIES)


@query()
def lru_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, [("lru", 4)])


@query()
def opt_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, [("opt", 4)])


@query()
def asm_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, [("asm", 4)])


@query()
def gc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions of a store that keeps its newest five versions."""
    cfg = replace(SMALL, index_preset="ddfs", retention=5)
    return backup.gc_stats(_fixed(spark, sf_dir), {"physical": cfg, "logical": replace(SMALL, index_logical=True, selection="base", retention=5)})


@query("""SELECT * FROM (VALUES ('working_directory', '/home/data/working/'), ('simulation_level', 'no'), ('trace_format', 'native'), ('log_level', 'warning'), ('chunk_algorithm', 'normalized rabin'), ('chunk_avg_size', '8192'),
('chunk_max_size', '65536'), ('chunk_min_size', '1024'), ('index_exact', 'False'), ('index_logical', 'True'), ('index_preset', 'sparse index'), ('index_cache_size', '4096'), ('index_key_value', 'htable'), ('index_key_size', '20'),
('index_value_length', '1'), ('index_bloom_filter', '0'), ('sampling_method', 'random'), ('sampling_ratio', '128'), ('segment_algorithm', 'content-defined'), ('segment_average', '1024'), ('segment_min', '128'), ('segment_max', '10240'),
('selection', 'top'), ('selection_top', '1'), ('prefetching', '1'), ('rewrite_algorithm', 'no'), ('rewrite_buffer', '1024'), ('cfl_switch', 'False'), ('cfl_require', '0.0'), ('cfl_usage_threshold', '0.0'), ('cbr_limit', '0.0'),
('cbr_minimal_utility', '0.0'), ('capping_level', '0'), ('har', 'True'), ('har_utilization_threshold', '0.5'), ('har_rewrite_limit', '0.05'), ('cache_aware', 'False'), ('restore_cache', 'lru'), ('restore_cache_size', '30'),
('restore_opt_window', '1000000'), ('retention', '30'), ('container_data', '4161536'), ('container_entries', '1169')) AS t(setting, value)""")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by directive lines, with an overriding one."""
    text = 'chunk-algorithm "normalized rabin"\nfingerprint-index near-exact logical "sparse index" # a preset\nrestore-cache opt 64\nbackup-retention-time 30\nrewrite-enable-har YES'
    return spark.createDataFrame(as_rows(parse_config(text, ("restore-cache lru 30",)).resolved()), "setting string, value string")


@query(f"{_CH}, g AS (SELECT fp, min(size) AS size FROM ch GROUP BY fp) SELECT fp, size FROM g")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a stream through an incremental index, a micro-batch at a time."""
    from ..streaming.incremental import IncrementalIndex

    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    chunks = _fixed(spark, sf_dir)
    for part in range(3):
        chunks.where(F.col("bv") % 3 == part).write.mode("append").parquet(f"{base}/in")
    index = IncrementalIndex(spark, base)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", "8").parquet(f"{base}/in")
    index.run(stream, f"{base}/progress")
    return _long(_hex(index.stored(), "fp"), "size").select("fp", "size")


@query("""SELECT date_trunc('day', ts) AS start, count(*) AS chunks, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1""")
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of their properties, counted by event-time day in a stream that ends."""
    from ..streaming.incremental import running_totals

    name = f"totals_{uuid.uuid4().hex}"
    schema = snapshots.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("size"))
    q = running_totals(events, "ts", "1 day", "1 hour").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "chunks", F.col("bytes").cast("bigint").alias("bytes"))


@query(f"{_SEG} SELECT bv, segment_no, count(DISTINCT fp) AS distinct_chunks FROM sg GROUP BY 1, 2")
def segment_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers of each segment: of a repeated fingerprint the last one counts."""
    recipe = _recipe(spark, sf_dir)
    last = recipe.groupBy("bv", "segment_no", "fp").agg(F.max_by("cid", "seq").alias("cid"))
    return _long(last.groupBy("bv", "segment_no").agg(F.count("*").alias("distinct_chunks")), "bv")


__all__ = ["CDC", "CHUNK", "POLICIES", "presets", "rewriters", "work_dir"]
