"""The queries of the deduplication engine over the provided tables, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SMALL
from ..functions import fingerprints as fx
from ..operators import chunking, collection, lookup, packing, rewriting, sampling, segmenting, statistics
from ..sources import snapshots, trace

CHUNK = 64
CAPACITY = SMALL.container_data
SEGMENT = SMALL.segment_average
RATIO = SMALL.sampling_ratio
BUFFER = SMALL.rewrite_buffer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- the views that the checking SQL starts from

_FILES = "f AS (SELECT doc_id % 20 AS bv, doc_id // 20 AS file_no, doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)"


def _chunks(size: int) -> str:
    return f"""{_FILES},
x AS (SELECT bv, file_no, unnest(range(0, CAST(ceil(n / {size}.0) AS BIGINT))) AS chunk_no, b, n FROM f),
ch AS (SELECT bv, file_no, chunk_no, upper(sha1(b[chunk_no * {size} + 1 : chunk_no * {size} + {size}])) AS fp, CAST(least({size}, n - chunk_no * {size}) AS BIGINT) AS size,
       row_number() OVER (PARTITION BY bv ORDER BY file_no, chunk_no) - 1 AS seq FROM x)"""


_CH = "WITH " + _chunks(CHUNK)
_FIRST = f"{_CH}, d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY bv, seq) AS k, count(*) OVER (PARTITION BY fp) AS copies FROM ch)"
_RECIPE = f"""{_FIRST},
pk AS (SELECT *, CAST(bv * 100000 + floor((sum(size) OVER (PARTITION BY bv ORDER BY seq) - size) / {CAPACITY}.0) AS BIGINT) AS cid FROM d WHERE k = 1),
rc AS (SELECT d.bv, d.file_no, d.chunk_no, d.seq, d.seq // {SEGMENT} AS segment_no, d.fp, d.size, pk.cid, d.k > 1 AS is_dup FROM d JOIN pk ON d.fp = pk.fp)"""


def _fixed(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    return chunking.with_seq(chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), size))


def _recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes over the packing that SQL can check."""
    chunks = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)
    packed = packing.simple_pack(lookup.first_occurrences(chunks), CAPACITY)
    where = packed.select(F.col("fp").alias("__fp"), F.col("bv").alias("__bv"), F.col("seq").alias("__seq"), "cid")
    joined = chunks.join(where, F.col("fp") == F.col("__fp"))
    return joined.withColumn("is_dup", ~((F.col("bv") == F.col("__bv")) & (F.col("seq") == F.col("__seq")))).drop("__fp", "__bv", "__seq")


def _hex(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.hex(c) for c in names})


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


# ---- chunks and exact deduplication


@query(f"{_CH} SELECT bv, file_no, chunk_no, seq, fp, size FROM ch")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hex(_fixed(spark, sf_dir), "fp"), "bv", "size").select("bv", "file_no", "chunk_no", "seq", "fp", "size")


@query("WITH " + _FILES + ", g AS (SELECT sha1(b) AS fp, min(n) AS size, count(*) AS copies FROM f WHERE n > 0 GROUP BY 1) SELECT count(*) AS distinct_files, sum(copies)::BIGINT AS files, sum(size)::BIGINT AS stored_size, sum(size * copies)::BIGINT AS data_size FROM g")
def file_level_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as chunks (of a container's capacity at most)."""
    whole = chunking.with_seq(chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), 4_161_536))
    first = lookup.first_occurrences(whole)
    return first.agg(F.count("*").alias("distinct_files"), F.sum("copies").alias("files"), F.sum("size").cast("bigint").alias("stored_size"), F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("data_size"))


@query(f"""{_FIRST} SELECT bv, count(*) AS chunks, sum(size)::BIGINT AS data_size, count(*) FILTER (WHERE k = 1) AS unique_chunks, coalesce(sum(size) FILTER (WHERE k = 1), 0)::BIGINT AS stored_size,
(sum(size) - coalesce(sum(size) FILTER (WHERE k = 1), 0)) / sum(size)::DOUBLE AS dedup_ratio, sum(size)::DOUBLE / nullif(sum(size) FILTER (WHERE k = 1), 0) AS dedup_factor, (sum(size) // count(*))::BIGINT AS avg_chunk FROM d GROUP BY bv""")
def exact_dedup_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(statistics.version_stats(lookup.dedup_by_version(_fixed(spark, sf_dir))), "bv")


@query(f"{_FIRST} SELECT bv, seq, fp, k > 1 AS is_dup, CASE WHEN k > 1 THEN 256 ELSE 0 END AS state FROM d")
def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lookup.mark_duplicates(_fixed(spark, sf_dir))
    return _long(_hex(marked, "fp"), "bv").select("bv", "seq", "fp", "is_dup", fx.state_bits(is_dup=F.col("is_dup")).alias("state"))


@query(f"""{_FIRST}, v AS (SELECT bv, count(*) AS chunks, sum(size) AS data_size, count(*) FILTER (WHERE k = 1) AS unique_chunks, coalesce(sum(size) FILTER (WHERE k = 1), 0) AS stored_size FROM d GROUP BY bv)
SELECT count(*) AS versions, sum(chunks)::BIGINT AS chunks, sum(data_size)::BIGINT AS data_size, sum(unique_chunks)::BIGINT AS unique_chunks, sum(stored_size)::BIGINT AS stored_size,
(sum(data_size) - sum(stored_size)) / sum(data_size)::DOUBLE AS dedup_ratio, sum(data_size)::DOUBLE / sum(stored_size) AS dedup_factor FROM v""")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.global_stats(lookup.dedup_by_version(_fixed(spark, sf_dir)))


@query(f"""{_FIRST}, v AS (SELECT bv, sum(size) AS data_size, coalesce(sum(size) FILTER (WHERE k = 1), 0) AS stored_size FROM d GROUP BY bv)
SELECT bv, data_size::BIGINT AS data_size, stored_size::BIGINT AS stored_size, (sum(data_size) OVER (ORDER BY bv))::BIGINT AS total_data, (sum(stored_size) OVER (ORDER BY bv))::BIGINT AS total_stored FROM v""")
def cumulative_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(statistics.cumulative_capacity(lookup.dedup_by_version(_fixed(spark, sf_dir))), "bv")


@query(f"{_FIRST} SELECT copies, count(*) AS fingerprints, sum(size * copies)::BIGINT AS bytes FROM d WHERE k = 1 GROUP BY copies")
def duplicate_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.duplicate_groups(lookup.first_occurrences(_fixed(spark, sf_dir)))


@query("WITH " + _chunks(1024) + " SELECT floor(log2(size))::INT AS log2_size, count(*) AS chunks, sum(size)::BIGINT AS bytes, min(size) AS min_size, max(size) AS max_size FROM ch GROUP BY 1")
def chunk_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(statistics.size_histogram(chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), 1024)), "min_size", "max_size")


@query("""SELECT event_id % 8 AS bv, count(*) AS chunks, sum((event_id % 3 = 0)::INT)::BIGINT AS zero_chunks, sum(CASE WHEN event_id % 3 = 0 THEN 32 ELSE 0 END)::BIGINT AS zero_size FROM events GROUP BY 1""")
def zero_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event as a chunk of 32 zero bytes, the others as their number in text."""
    e = snapshots.table(spark, sf_dir, "events")
    data = F.when(F.col("event_id") % 3 == 0, F.unhex(F.repeat(F.lit("00"), 32))).otherwise(F.encode(F.concat(F.lit("e"), F.col("event_id").cast("string")), "UTF-8"))
    rows = e.select((F.col("event_id") % 8).alias("bv"), data.alias("data")).select("bv", F.octet_length("data").alias("size"), fx.is_zero(F.col("data")).alias("is_zero"))
    return statistics.zero_stats(rows)


@query("""WITH r AS (SELECT l_orderkey % 8 AS bv, l_orderkey // 8 AS seq, sha1(concat_ws('|', l_returnflag, l_linestatus, l_linenumber::VARCHAR)) AS fp, length(concat_ws('|', l_returnflag, l_linestatus, l_linenumber::VARCHAR)) AS size FROM lineitem),
g AS (SELECT fp, min(bv) AS bv, min(size) AS size FROM r GROUP BY fp), s AS (SELECT bv, count(*) AS unique_chunks, sum(size) AS stored_size FROM g GROUP BY bv)
SELECT r.bv, count(*) AS chunks, sum(r.size)::BIGINT AS data_size, coalesce(max(s.unique_chunks), 0)::BIGINT AS unique_chunks, coalesce(max(s.stored_size), 0)::BIGINT AS stored_size FROM r LEFT JOIN s ON r.bv = s.bv GROUP BY r.bv""")
def hot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as chunks with very few fingerprints, each very hot."""
    rows = snapshots.row_chunks(snapshots.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"), "l_orderkey")
    return _long(lookup.dedup_by_version(rows), "bv")


@query("""WITH x AS (SELECT page_id, unnest(range(0, CAST(ceil(octet_length(encode(html)) / 512.0) AS BIGINT))) AS chunk_no, encode(html) AS b FROM pages),
g AS (SELECT sha1(b[chunk_no * 512 + 1 : chunk_no * 512 + 512]) AS fp, count(*) AS copies FROM x GROUP BY 1) SELECT count(*) AS unique_chunks, sum(copies)::BIGINT AS chunks, max(copies) AS most_copies FROM g""")
def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lookup.first_occurrences(chunking.with_seq(chunking.fixed_chunks(snapshots.page_files(spark, sf_dir), 512)))
    return first.agg(F.count("*").alias("unique_chunks"), F.sum("copies").alias("chunks"), F.max("copies").alias("most_copies"))


@query(f"""{_CH} SELECT DISTINCT fp, lower(fp) AS code, substr(fp, 1, 16) AS feature_key, (concat('0x', substr(fp, 39, 2), substr(fp, 37, 2), substr(fp, 35, 2), substr(fp, 33, 2))::BIGINT) AS tail,
(concat('0x', substr(fp, 39, 2), substr(fp, 37, 2), substr(fp, 35, 2), substr(fp, 33, 2))::BIGINT) % 8 = 0 AS sampled FROM ch""")
def fingerprint_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.col("fp")
    rows = chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), CHUNK).select("fp").distinct()
    return rows.select(fx.encode_hex(fx.decode_hex(F.lower(F.hex(fp)))).alias("fp"), F.lower(fx.encode_hex(fp)).alias("code"), F.hex(fx.feature_key(fp, 8)).alias("feature_key"), fx.tail(fp).alias("tail"), (F.pmod(fx.tail(fp), F.lit(8)) == 0).alias("sampled"))


@query(f"""{_CH}, s AS (SELECT bv, seq // {SEGMENT} AS sg, min(seq) AS off, count(*) AS n FROM ch GROUP BY 1, 2)
SELECT bv::BIGINT * 281474976710656 + off * 65536 + n AS segment_id, bv, off AS segment_offset, n AS segment_size FROM s""")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT).groupBy("bv", "segment_no").agg(F.min("seq").alias("o"), F.count("*").alias("n"))
    sid = per.select(fx.segment_id(F.col("bv"), F.col("o"), F.col("n")).alias("segment_id"))
    return sid.select("segment_id", fx.segment_version(F.col("segment_id")).alias("bv"), fx.segment_offset(F.col("segment_id")).alias("segment_offset"), fx.segment_size(F.col("segment_id")).alias("segment_size"))


# ---- segments, samples, the feature index


@query(f"{_CH} SELECT bv, seq // {SEGMENT} AS segment_no, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM ch GROUP BY 1, 2")
def segments_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT).groupBy("bv", "segment_no").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes")), "bv")


@query(f"{_CH} SELECT bv, file_no AS segment_no, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM ch GROUP BY 1, 2")
def segments_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segmenting.file_segments(_fixed(spark, sf_dir)).groupBy("bv", "segment_no").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes")), "bv")


_TAIL = "concat('0x', substr(fp, 39, 2), substr(fp, 37, 2), substr(fp, 35, 2), substr(fp, 33, 2))::BIGINT"
_CONTENT = f"{_CH}, sg AS (SELECT *, sum(CASE WHEN seq > 0 AND {_TAIL} % 32 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY bv ORDER BY seq) AS segment_no FROM ch)"


@query(f"{_CONTENT}, p AS (SELECT bv, segment_no, count(*) AS n FROM sg GROUP BY 1, 2) SELECT bv, count(*) AS segments, sum(n)::BIGINT AS chunks, avg(n) AS avg_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM p GROUP BY bv")
def content_segments_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segmenting.segment_stats(segmenting.content_segments_simple(_fixed(spark, sf_dir), 32)), "bv")


@query(f"{_CH}, p AS (SELECT bv, seq // {SEGMENT} AS s, count(*) AS n FROM ch GROUP BY 1, 2) SELECT bv, count(*) AS segments, sum(n)::BIGINT AS chunks, avg(n) AS avg_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM p GROUP BY bv")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(segmenting.segment_stats(segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)), "bv")


_ZERO = "0" * 40
_SEG = f"{_CH}, sg AS (SELECT *, seq // {SEGMENT} AS segment_no FROM ch)"
_K = f"CASE WHEN n <= {RATIO} THEN 1 ELSE n // {RATIO} + CASE WHEN (n % {RATIO}) * 2 > {RATIO} THEN 1 ELSE 0 END END"
_RANDOM = f"{_SEG}, hit AS (SELECT DISTINCT bv, segment_no, fp AS feature FROM sg WHERE {_TAIL} % {RATIO} = 0), ft AS (SELECT * FROM hit UNION ALL SELECT DISTINCT bv, segment_no, '{_ZERO}' FROM sg WHERE (bv, segment_no) NOT IN (SELECT (bv, segment_no) FROM hit))"
_RANKED = f"{_SEG}, r AS (SELECT *, count(*) OVER (PARTITION BY bv, segment_no) AS n, row_number() OVER (PARTITION BY bv, segment_no ORDER BY fp, seq) AS k, coalesce(lag(fp, 8) OVER (PARTITION BY bv, segment_no ORDER BY seq), first(fp) OVER (PARTITION BY bv, segment_no ORDER BY seq)) AS back FROM sg)"
_MIN = f"{_RANKED}, ft AS (SELECT DISTINCT bv, segment_no, fp AS feature FROM r WHERE k <= {_K})"


def _features(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    segmented = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)
    return sampling.SAMPLERS[method](segmented, ["bv", "segment_no"], RATIO)


@query(f"{_RANDOM} SELECT bv, segment_no, feature FROM ft")
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hex(_features(spark, sf_dir, "random"), "feature"), "bv")


@query(f"{_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY seq) - 1 AS i FROM sg) SELECT DISTINCT bv, segment_no, fp AS feature FROM r WHERE i % {RATIO} = 0")
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hex(_features(spark, sf_dir, "uniform"), "feature"), "bv")


@query(f"{_MIN} SELECT bv, segment_no, feature FROM ft")
def sample_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hex(_features(spark, sf_dir, "min"), "feature"), "bv")


@query(f"{_RANKED} SELECT DISTINCT bv, segment_no, back AS feature FROM r WHERE k <= {_K}")
def sample_optmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hex(_features(spark, sf_dir, "optmin"), "feature"), "bv")


@query(f"{_RANDOM}, k AS (SELECT feature, bv * 1000000 + segment_no AS unit_id, row_number() OVER (PARTITION BY feature ORDER BY bv DESC, segment_no DESC) - 1 AS ord FROM ft) SELECT feature, unit_id, ord FROM k WHERE ord < 2")
def feature_index_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = (F.col("bv").cast("bigint") * 1_000_000 + F.col("segment_no")).cast("bigint")
    return _long(_hex(sampling.feature_index(_features(spark, sf_dir, "random"), unit, ["bv", "segment_no"], 2), "feature"), "ord")


@query(f"{_RANDOM} SELECT count(DISTINCT feature) AS features, count(DISTINCT feature) * (20 + 8 * 2 + 4) AS footprint FROM ft")
def index_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.index_footprint(_features(spark, sf_dir, "random"), 20, 2)


@query(f"{_RANDOM} SELECT bv, count(*) AS update_requests FROM ft GROUP BY bv")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(sampling.update_requests(_features(spark, sf_dir, "random")), "bv")


_SIMILAR = f"{_MIN}, g AS (SELECT a.bv, a.segment_no, b.bv AS cand_bv, b.segment_no AS cand_segment, count(*) AS shared FROM ft a JOIN ft b ON a.feature = b.feature AND (b.bv < a.bv OR (b.bv = a.bv AND b.segment_no < a.segment_no)) GROUP BY 1, 2, 3, 4)"


@query(f"{_SIMILAR}, k AS (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY shared DESC, cand_bv DESC, cand_segment DESC) AS r FROM g) SELECT bv, segment_no, cand_bv, cand_segment, shared, 1 AS rank FROM k WHERE r = 1")
def similar_segments_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(lookup.similar_segments(_features(spark, sf_dir, "min")), "bv", "cand_bv")


@query(f"""{_SIMILAR}, b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY shared DESC, cand_bv DESC, cand_segment DESC) AS r FROM g) WHERE r = 1),
used AS (SELECT DISTINCT b1.bv, b1.segment_no, a.feature FROM b1 JOIN ft a ON a.bv = b1.bv AND a.segment_no = b1.segment_no JOIN ft c ON c.bv = b1.cand_bv AND c.segment_no = b1.cand_segment AND c.feature = a.feature),
g2 AS (SELECT a.bv, a.segment_no, b.bv AS cand_bv, b.segment_no AS cand_segment, count(*) AS shared FROM ft a JOIN ft b ON a.feature = b.feature AND (b.bv < a.bv OR (b.bv = a.bv AND b.segment_no < a.segment_no))
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.bv = a.bv AND u.segment_no = a.segment_no AND u.feature = a.feature) GROUP BY 1, 2, 3, 4),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY shared DESC, cand_bv DESC, cand_segment DESC) AS r FROM g2) WHERE r = 1)
SELECT bv, segment_no, cand_bv, cand_segment, shared, 1 AS rank FROM b1 UNION ALL SELECT bv, segment_no, cand_bv, cand_segment, shared, 2 FROM b2""")
def similar_segments_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(lookup.similar_segments(_features(spark, sf_dir, "min"), k=2), "bv", "cand_bv")


@query(f"""{_MIN}, o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY bv, segment_no) AS i FROM ft),
g AS (SELECT a.bv, a.segment_no, b.bv AS cand_bv, b.segment_no AS cand_segment, count(*) AS shared FROM o a JOIN o b ON a.feature = b.feature AND b.i BETWEEN a.i - 2 AND a.i - 1 GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY bv, segment_no ORDER BY shared DESC, cand_bv DESC, cand_segment DESC) AS r FROM g) SELECT bv, segment_no, cand_bv, cand_segment, shared, 1 AS rank FROM k WHERE r = 1""")
def similar_segments_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar segment among those that an index with two units a feature names."""
    return _long(lookup.similar_segments(_features(spark, sf_dir, "min"), newest=2), "bv", "cand_bv")


@query(f"{_MIN}, v AS (SELECT DISTINCT bv, feature FROM ft) SELECT a.bv, b.bv AS other_bv, count(*) AS shared FROM v a JOIN v b ON a.feature = b.feature AND a.bv < b.bv GROUP BY 1, 2")
def shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(lookup.shared_features(_features(spark, sf_dir, "min")), "bv", "other_bv")


@query(f"""{_MIN}, nw AS (SELECT feature, bv, segment_no, lag(bv) OVER w AS cand_bv, lag(segment_no) OVER w AS cand_segment FROM ft WINDOW w AS (PARTITION BY feature ORDER BY bv, segment_no)),
pr AS (SELECT DISTINCT bv, segment_no, cand_bv, cand_segment FROM nw WHERE cand_bv IS NOT NULL),
ct AS (SELECT DISTINCT bv, segment_no, fp FROM sg), re AS (SELECT DISTINCT pr.bv, pr.segment_no, ct.fp FROM pr JOIN ct ON ct.bv = pr.cand_bv AND ct.segment_no = pr.cand_segment),
fi AS (SELECT bv, segment_no, fp, min(size) AS size FROM sg GROUP BY 1, 2, 3),
st AS (SELECT fi.bv, count(*) AS stored_chunks, sum(size) AS stored_size FROM fi WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.bv = fi.bv AND re.segment_no = fi.segment_no AND re.fp = fi.fp) GROUP BY 1)
SELECT sg.bv, count(*) AS chunks, sum(size)::BIGINT AS data_size, max(st.stored_chunks)::BIGINT AS stored_chunks, max(st.stored_size)::BIGINT AS stored_size FROM sg JOIN st ON st.bv = sg.bv GROUP BY sg.bv""")
def near_exact_infinite_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    segmented = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)
    return _long(lookup.near_exact_unbounded(segmented, sampling.sample_min(segmented, ["bv", "segment_no"], RATIO)), "bv")


# ---- containers, recipes, fragmentation


@query(f"{_RECIPE} SELECT cid, bv, count(*) AS chunk_num, sum(size)::BIGINT AS data_size FROM pk GROUP BY cid, bv")
def simple_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(packing.containers(packing.simple_pack(lookup.first_occurrences(_fixed(spark, sf_dir)), CAPACITY)), "bv", "chunk_num")


@query(f"{_RECIPE} SELECT bv, file_no, count(*) AS chunknum, sum(size)::BIGINT AS filesize FROM rc GROUP BY 1, 2")
def recipe_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(packing.file_recipes(_recipe(spark, sf_dir)), "bv")


@query(f"{_RECIPE}, sg AS (SELECT DISTINCT bv, segment_no FROM rc), la AS (SELECT bv, segment_no, fp, max_by(cid, seq) AS cid FROM rc GROUP BY 1, 2, 3) SELECT la.bv, sg.segment_no AS asked_segment, la.segment_no, la.fp, la.cid FROM sg JOIN la ON la.bv = sg.bv AND la.segment_no BETWEEN sg.segment_no AND sg.segment_no + 1")
def segment_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asking for any segment brings in: it and the one behind it."""
    recipe = _recipe(spark, sf_dir)
    return _long(_hex(lookup.prefetched(recipe, recipe.select("bv", "segment_no").distinct(), 2), "fp"), "bv")


@query(f"{_RECIPE} SELECT bv, cid, sum(size)::BIGINT AS size, sum(size) / {CAPACITY}.0::DOUBLE AS utilization FROM rc GROUP BY 1, 2")
def container_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rewriting.container_use(_recipe(spark, sf_dir)).withColumn("utilization", fx.utilization(F.col("size"), CAPACITY)), "bv")


_USE = f"{_RECIPE}, us AS (SELECT bv, cid, sum(size) AS size FROM rc GROUP BY 1, 2)"
_SPARSE = f"{_USE}, sp AS (SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY bv ORDER BY size, cid) AS run FROM (SELECT *, sum(size) OVER (PARTITION BY bv) AS total FROM us) WHERE size / {CAPACITY}.0 < 0.5) WHERE run / total::DOUBLE <= 0.05)"


@query(f"{_SPARSE} SELECT bv, cid, size::BIGINT AS size FROM sp")
def har_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rewriting.sparse_containers(rewriting.container_use(_recipe(spark, sf_dir)), CAPACITY, 0.5, 0.05), "bv")


@query(f"""{_USE}, fl AS (SELECT *, size / {CAPACITY}.0 < 0.5 AS sparse FROM us)
SELECT a.bv, count(*) AS total_containers, sum(a.sparse::INT)::BIGINT AS sparse_containers, sum((a.sparse AND b.cid IS NOT NULL)::INT)::BIGINT AS inherited_sparse FROM fl a LEFT JOIN fl b ON b.bv + 1 = a.bv AND b.cid = a.cid AND b.sparse GROUP BY a.bv""")
def har_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rewriting.sparse_counts(rewriting.container_use(_recipe(spark, sf_dir)), CAPACITY, 0.5), "bv", "sparse_containers", "inherited_sparse")


@query(f"{_SPARSE} SELECT rc.bv, sum((rc.is_dup AND sp.cid IS NOT NULL)::INT)::BIGINT AS sparse_chunks, sum(CASE WHEN rc.is_dup AND sp.cid IS NOT NULL THEN rc.size ELSE 0 END)::BIGINT AS sparse_bytes FROM rc LEFT JOIN sp ON sp.bv + 1 = rc.bv AND sp.cid = rc.cid GROUP BY rc.bv")
def har_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = _recipe(spark, sf_dir)
    marked = rewriting.mark_sparse(recipe, rewriting.sparse_containers(rewriting.container_use(recipe), CAPACITY, 0.5, 0.05))
    return _long(marked.groupBy("bv").agg(F.sum(F.col("is_sparse").cast("bigint")).alias("sparse_chunks"), F.sum(F.when(F.col("is_sparse"), F.col("size")).otherwise(0)).cast("bigint").alias("sparse_bytes")), "bv")


@query(f"""{_RECIPE}, bf AS (SELECT *, seq // {BUFFER} AS buf FROM rc), pc AS (SELECT bv, buf, cid, sum(size) AS s FROM bf WHERE is_dup GROUP BY 1, 2, 3),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bv, buf ORDER BY s DESC, cid) AS r FROM pc) WHERE r <= {SMALL.capping_level})
SELECT bf.bv, sum((is_dup AND kp.cid IS NULL)::INT)::BIGINT AS rewritten_chunks, sum(CASE WHEN is_dup AND kp.cid IS NULL THEN size ELSE 0 END)::BIGINT AS rewritten_size, sum(CASE WHEN is_dup AND kp.cid IS NULL THEN size ELSE 0 END) / sum(size)::DOUBLE AS rewrite_ratio
FROM bf LEFT JOIN kp ON kp.bv = bf.bv AND kp.buf = bf.buf AND kp.cid = bf.cid GROUP BY bf.bv""")
def capping_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = rewriting.capping(_recipe(spark, sf_dir), BUFFER, SMALL.capping_level)
    out = capped.groupBy("bv").agg(F.sum(F.col("is_ooo").cast("bigint")).alias("rewritten_chunks"), F.sum(F.when(F.col("is_ooo"), F.col("size")).otherwise(0)).cast("bigint").alias("rewritten_size"), F.sum("size").alias("s"))
    return _long(out.select("bv", "rewritten_chunks", "rewritten_size", fx.rewrite_ratio(F.col("s"), F.col("rewritten_size")).alias("rewrite_ratio")), "bv")


@query(f"""{_RECIPE}, kn AS (SELECT *, CASE WHEN is_dup THEN cid END AS kc FROM rc),
cl AS (SELECT *, CASE WHEN lag(kc) OVER w IS NOT NULL AND (kc IS NULL OR kc <> lag(kc) OVER w OR file_no <> lag(file_no) OVER w OR segment_no <> lag(segment_no) OVER w) THEN 1 ELSE 0 END AS nw FROM kn WINDOW w AS (PARTITION BY bv ORDER BY seq)),
il AS (SELECT *, sum(nw) OVER (PARTITION BY bv ORDER BY seq) AS island FROM cl), sz AS (SELECT *, sum(size) OVER (PARTITION BY bv, island) AS isz FROM il)
SELECT bv, count(DISTINCT island) AS islands, sum((is_dup AND isz < 0.03 * {CAPACITY})::INT)::BIGINT AS out_of_order FROM sz GROUP BY bv""")
def cfl_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rewriting.cfl_marks(_recipe(spark, sf_dir), CAPACITY, 0.03)
    return _long(marked.groupBy("bv").agg(F.countDistinct("island").alias("islands"), F.sum(F.col("is_ooo").cast("bigint")).alias("out_of_order")), "bv")


_COVER = f"{_RECIPE}, cv AS (SELECT *, sum(size) OVER (PARTITION BY bv, cid ORDER BY seq RANGE BETWEEN CURRENT ROW AND {BUFFER - 1} FOLLOWING) AS coverage FROM rc)"


@query(f"{_COVER} SELECT bv, seq, cid, coverage::BIGINT AS coverage, greatest(0.0, 1 - (coverage + size) / {CAPACITY}.0)::DOUBLE AS utility FROM cv")
def cbr_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = rewriting.cbr_coverage(_recipe(spark, sf_dir), BUFFER)
    return _long(covered.select("bv", "seq", "cid", "coverage", fx.rewrite_utility(F.col("coverage"), F.col("size"), CAPACITY).alias("utility")), "bv")


@query(f"""{_COVER}, ut AS (SELECT bv, least(floor(CASE WHEN is_dup THEN greatest(0.0::DOUBLE, 1 - (coverage + size) / {CAPACITY}.0::DOUBLE) ELSE 0 END * 10000), 9999)::INT AS bucket FROM cv),
pb AS (SELECT bv, bucket, count(*) AS chunks FROM ut GROUP BY 1, 2) SELECT bv, bucket, chunks, (sum(chunks) OVER (PARTITION BY bv ORDER BY bucket DESC))::BIGINT AS chunks_from FROM pb""")
def cbr_utility_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(statistics.utility_histogram(rewriting.cbr_coverage(_recipe(spark, sf_dir), BUFFER), CAPACITY), "bv")


_RECORDS = f"{_RECIPE}, lg AS (SELECT *, lag(cid) OVER (PARTITION BY bv ORDER BY seq) AS l FROM rc), ar AS (SELECT bv, seq, cid, row_number() OVER (PARTITION BY bv ORDER BY seq) - 1 AS record FROM lg WHERE l IS NULL OR l <> cid)"


@query(f"{_RECORDS} SELECT bv, record, seq, cid FROM ar")
def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(packing.access_records(_recipe(spark, sf_dir)), "bv")


@query(f"{_RECORDS} SELECT bv, record, cid, lead(record) OVER (PARTITION BY bv, cid ORDER BY record) AS next_record FROM ar")
def next_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(packing.next_use(packing.access_records(_recipe(spark, sf_dir))), "bv").select("bv", "record", "cid", "next_record")


@query(f"WITH {_FILES} SELECT bv, file_no, upper(sha1(b)) AS content_hash, n AS filesize FROM f WHERE n > 0")
def restore_bytes_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file put together again from stored chunks by way of its recipe: its bytes hash as the original's."""
    from ..operators import restore

    files = snapshots.document_files(spark, sf_dir)
    with_data = chunking.with_seq(chunking.fixed_chunks(files, CHUNK, with_data=True))
    stored = with_data.groupBy("fp").agg(F.min(F.struct("bv", "seq", "size", "data")).alias("f")).select("fp", "f.bv", "f.seq", "f.size", "f.data")
    packed = packing.simple_pack(stored, CAPACITY)
    recipe = packing.recipes(with_data.drop("data"), packed.select("fp", "cid"))
    out = restore.restore_files(recipe, packed.select("cid", "fp", "data"))
    return out.select(F.col("bv").cast("bigint").alias("bv"), "file_no", F.upper(F.sha1("content")).alias("content_hash"), F.octet_length("content").cast("bigint").alias("filesize"))


# ---- garbage collection


@query(f"{_RECIPE} SELECT cid, max(bv) AS last_bv FROM rc GROUP BY cid")
def gc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = _recipe(spark, sf_dir)
    old = collection.manifest(recipe.where("bv < 19"))
    return _long(collection.update_manifest(old, recipe.where("bv >= 19")), "last_bv")


@query(f"{_RECIPE} SELECT cid, max(bv) AS last_bv FROM rc GROUP BY cid HAVING max(bv) <= 9")
def gc_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(collection.reclaimable(collection.manifest(_recipe(spark, sf_dir)), 9), "last_bv")


@query(f"{_RECIPE}, m AS (SELECT cid, max(bv) AS last_bv FROM rc GROUP BY cid) SELECT count(*) AS live_containers FROM m WHERE last_bv > 9")
def gc_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.live_containers(collection.manifest(_recipe(spark, sf_dir)), 9)


@query("SELECT DISTINCT doc_id % 20 AS bv FROM documents WHERE doc_id % 20 <= (SELECT max(doc_id % 20) FROM documents) - 5")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(collection.expired(snapshots.document_files(spark, sf_dir).select("bv").distinct(), 5), "bv")


@query(f"""{_RANDOM} SELECT feature, bv * 1000000 + segment_no AS unit_id FROM ft WHERE bv > 9""")
def gc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a logical store after versions up to 9 are deleted."""
    found = _features(spark, sf_dir, "random").withColumn("unit_id", (F.col("bv").cast("bigint") * 1_000_000 + F.col("segment_no")).cast("bigint"))
    return _hex(lookup.remove_units(found, found.where("bv <= 9").select("feature", "unit_id")), "feature").select("feature", "unit_id")


@query(f"""{_CH}, nm AS (SELECT bv, file_no, 'doc-' || doc_id::VARCHAR AS filename FROM f),
l AS (SELECT bv, file_no, 0 AS part, 0::BIGINT AS chunk_no, 'file start ' || length(filename)::VARCHAR AS line FROM nm UNION ALL SELECT bv, file_no, 1, 0, filename FROM nm UNION ALL
SELECT bv, file_no, 2, chunk_no, fp || ' ' || size::VARCHAR FROM ch UNION ALL SELECT bv, file_no, 3, 0, 'file end' FROM nm UNION ALL SELECT DISTINCT bv, 4611686018427387904, 4, 0::BIGINT, 'stream end' FROM nm) SELECT bv, file_no, part, chunk_no, line FROM l""")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = snapshots.document_files(spark, sf_dir)
    return _long(trace.trace_lines(chunking.fixed_chunks(files, CHUNK), files), "bv")


# ---- predicates, sets, containers


@query("""WITH e AS (SELECT event_id, event_id % 2 = 1 AS dup, (event_id // 2) % 2 = 1 AS denied, (event_id // 4) % 2 = 1 AS sparse, (event_id // 8) % 2 = 1 AS ooo, (event_id // 16) % 2 = 1 AS cached, (event_id // 32) % 2 = 1 AS sw FROM events)
SELECT event_id, (NOT dup OR (NOT denied AND (sparse OR (sw AND ooo AND NOT cached)))) AS written,
(CASE WHEN dup THEN 256 ELSE 0 END + CASE WHEN sparse THEN 512 ELSE 0 END + CASE WHEN ooo THEN 1024 ELSE 0 END + CASE WHEN cached THEN 2048 ELSE 0 END + CASE WHEN denied THEN 4096 ELSE 0 END)::INT AS state FROM e""")
def write_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write predicate over all combinations of marks, and the marks as bits."""
    bit = lambda i: F.pmod(F.floor(F.col("event_id") / (1 << i)), F.lit(2)) == 1
    dup, denied, sparse, ooo, cached, switch = (bit(i) for i in range(6))
    e = snapshots.table(spark, sf_dir, "events")
    return e.select("event_id", fx.write_predicate(dup, denied, sparse, ooo, cached, switch).alias("written"), fx.state_bits(is_dup=dup, is_sparse=sparse, is_ooo=ooo, in_cache=cached, rewrite_denied=denied).alias("state"))


@query(f"{_RECIPE} SELECT cid, fp, size AS len FROM pk")
def container_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut out of whole containers by their entries, known again by their hashes."""
    from ..operators import restore
    from .workspace import packing_offsets

    rows = chunking.with_seq(chunking.fixed_chunks(snapshots.document_files(spark, sf_dir), CHUNK, with_data=True))
    stored = rows.groupBy("fp").agg(F.min(F.struct("bv", "seq", "size", "data")).alias("f")).select("fp", "f.bv", "f.seq", "f.size", "f.data")
    packed = packing_offsets(packing.simple_pack(stored, CAPACITY))
    entries = packed.select("cid", "fp", "off", F.col("size").alias("len"))
    cut = restore.chunk_from_container(restore.container_payload(packed), entries)
    return cut.select("cid", fx.encode_hex(fx.fingerprint(F.col("data"))).alias("fp"), F.octet_length("data").cast("bigint").alias("len"))


@query(f"{_RANDOM}, d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY bv, seq) AS k FROM sg) SELECT bv, segment_no, feature FROM ft UNION SELECT bv, segment_no, fp FROM d WHERE k = 1")
def exact_logical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an exact index over segments learns of each: its sampled features and the fingerprints it is the first to hold."""
    segmented = segmenting.fixed_segments(_fixed(spark, sf_dir), SEGMENT)
    new = lookup.first_occurrences(segmented).select("bv", F.floor(F.col("seq") / SEGMENT).alias("segment_no"), F.col("fp").alias("feature"))
    return _long(_hex(sampling.sample_random(segmented, ["bv", "segment_no"], RATIO).unionByName(new).distinct(), "feature"), "bv")
