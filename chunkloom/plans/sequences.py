"""Queries of sequential operators over inputs that recursive SQL can follow step by step: content-defined chunking byte by byte, restore caches access by access."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SMALL, DedupConfig
from ..operators import chunking
from ..sources import snapshots
from . import restore, rewriting
from .catalog import _RECIPE, BUFFER, CAPACITY, _hex, _long, _recipe, query

#: Geometry for conversations, which have a kilobyte or two.
TURNS = DedupConfig(chunk_avg_size=256, chunk_min_size=64, chunk_max_size=700)
LOW, AVERAGE, HIGH = TURNS.chunk_min_size, TURNS.chunk_avg_size, TURNS.chunk_max_size


def _conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a file: its turns, a line each."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = snapshots.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select(F.lit(0).alias("bv"), F.col("conv_id").alias("file_no"), F.encode(F.concat_ws("\n", F.transform("t", lambda x: x["text"])), "UTF-8").alias("content"))


_TURN_FILES = """f AS (SELECT conv_id AS file_no, hex(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, ''), coalesce(text, '')))) AS h, octet_length(encode(string_agg(coalesce(text, ''), chr(10)))) AS n FROM conversations GROUP BY conv_id)"""

#: Windows of up to 48 bytes that end pos e and their residues' low bits: byte values times powers of x modulo the polynomial, added up.
_RESIDUES = f"""WITH RECURSIVE {_TURN_FILES},
pw AS (SELECT 0 AS p, 1::HUGEINT AS v UNION ALL SELECT p + 1, CASE WHEN v * 2 >= 9223372036854775808::HUGEINT THEN xor(v * 2, {chunking.POLYNOMIAL}::HUGEINT) ELSE v * 2 END FROM pw WHERE p < {8 * chunking.WINDOW - 1}),
tb AS MATERIALIZED (SELECT j, b, coalesce(bit_xor(CASE WHEN (b >> k) & 1 = 1 THEN (pw.v % 1024)::INT ELSE 0 END), 0) AS r FROM range({chunking.WINDOW}) a(j), range(256) c(b), range(8) d(k) JOIN pw ON pw.p = 8 * a.j + d.k GROUP BY 1, 2),
bt AS MATERIALIZED (SELECT file_no, i, ('0x' || substr(h, 2 * i::INT + 1, 2))::INT AS v FROM (SELECT file_no, h, unnest(range(0, n)) AS i FROM f)),
te AS (SELECT x.file_no, x.e, x.j, tb.r FROM (SELECT file_no, i AS e, j, i - j AS i FROM bt, range({chunking.WINDOW}) a(j) WHERE i >= j) x JOIN bt q ON q.file_no = x.file_no AND q.i = x.i JOIN tb ON tb.j = x.j AND tb.b = q.v),
wi AS (SELECT file_no, e, j + 1 AS t, bit_xor(r) OVER (PARTITION BY file_no, e ORDER BY j) AS r FROM te),
hi AS MATERIALIZED (SELECT file_no, e, t, r % {2 * AVERAGE} = {chunking.BREAK_MARK} AS hard, r % {AVERAGE} = {chunking.BREAK_MARK} AS main, r % {AVERAGE // 2} = {chunking.BREAK_MARK} AS easy FROM wi WHERE r % {AVERAGE // 2} = {chunking.BREAK_MARK})"""


def _walk(cut: str, backup: str = "0") -> str:
    """A step a byte: chunk pos ``pos`` has i bytes; ``cut`` says whether it ends there, ``backup`` is the length to fall back to."""
    end = f"least(r.n - r.pos, {HIGH})"
    return f"""{_RESIDUES},
r AS (SELECT file_no, n, 0::BIGINT AS pos, 0::BIGINT AS i, 0::BIGINT AS bk FROM f WHERE n > 0 UNION ALL
SELECT r.file_no, r.n, CASE WHEN s.size > 0 THEN r.pos + s.size ELSE r.pos END, CASE WHEN s.size > 0 THEN 0 ELSE r.i + 1 END, CASE WHEN s.size > 0 THEN 0 ELSE s.bk END FROM r
JOIN (SELECT r.file_no AS file_no, CASE WHEN r.n - r.pos <= {LOW} THEN r.n - r.pos WHEN r.i + 1 >= {end} THEN CASE WHEN r.bk > 0 THEN r.bk ELSE {end} END WHEN r.i + 1 >= {LOW} AND ({cut}) THEN r.i + 1 ELSE 0 END AS size,
CASE WHEN r.i + 1 >= {LOW} AND coalesce(hi.easy, false) THEN greatest(r.bk, {backup}) ELSE r.bk END AS bk
FROM r LEFT JOIN hi ON hi.file_no = r.file_no AND hi.e = r.pos + r.i AND hi.t = least(r.i + 2 - {LOW}, {chunking.WINDOW})) s ON s.file_no = r.file_no WHERE r.pos < r.n),
st AS (SELECT DISTINCT file_no, n, pos FROM r WHERE i = 0 AND pos < n),
cu AS (SELECT file_no, pos, row_number() OVER (PARTITION BY file_no ORDER BY pos) - 1 AS chunk_no, coalesce(lead(pos) OVER (PARTITION BY file_no ORDER BY pos), n) - pos AS size FROM st)
SELECT cu.file_no, cu.chunk_no, upper(sha1(unhex(substr(f.h, 2 * cu.pos::INT + 1, 2 * cu.size::INT)))) AS fp, cu.size::BIGINT AS size FROM cu JOIN f ON f.file_no = cu.file_no"""


def _turn_chunks(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    rows = chunking.content_chunks(_conversation_files(spark, sf_dir), replace(TURNS, chunk_algorithm=algorithm))
    return _long(_hex(rows, "fp"), "size").select("file_no", "chunk_no", "fp", "size")


@query(_walk("coalesce(hi.main, false)"))
def rabin_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_chunks(spark, sf_dir, "rabin")


@query(_walk(f"CASE WHEN r.i + 1 < {AVERAGE} THEN coalesce(hi.hard, false) ELSE coalesce(hi.easy, false) END"))
def normalized_rabin_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_chunks(spark, sf_dir, "normalized rabin")


@query(_walk("coalesce(hi.main, false)", "r.i + 1"))
def tttd_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_chunks(spark, sf_dir, "tttd")


_EXTREMUM = chunking.extremum_window(AVERAGE)


@query(f"""WITH RECURSIVE {_TURN_FILES},
va AS (SELECT file_no, n, i, substr(h, 2 * i::INT + 1, 16) AS v FROM (SELECT file_no, h, n, unnest(range(0, n)) AS i FROM f)),
r AS (SELECT file_no, n, 0::BIGINT AS pos, 0::BIGINT AS i, 0::BIGINT AS best, v AS low FROM va WHERE i = 0 UNION ALL
SELECT r.file_no, r.n, CASE WHEN s.cut THEN r.pos + r.i + 1 ELSE r.pos END, CASE WHEN s.cut THEN 0 ELSE r.i + 1 END, CASE WHEN s.cut THEN 0 WHEN s.v <= r.low THEN r.i + 1 ELSE r.best END, CASE WHEN s.cut OR s.v <= r.low THEN s.v ELSE r.low END
FROM r JOIN (SELECT r.file_no AS file_no, va.v AS v, va.v > r.low AND (r.i + 1 = r.best + {_EXTREMUM} OR r.i + 1 = {HIGH}) AS cut FROM r JOIN va ON va.file_no = r.file_no AND va.i = r.pos + r.i + 1) s ON s.file_no = r.file_no
WHERE r.n - r.pos > {_EXTREMUM + 8} AND r.i + 1 <= r.n - r.pos - 8),
st AS (SELECT DISTINCT file_no, n, pos FROM r WHERE i = 0),
cu AS (SELECT file_no, pos, row_number() OVER (PARTITION BY file_no ORDER BY pos) - 1 AS chunk_no, coalesce(lead(pos) OVER (PARTITION BY file_no ORDER BY pos), n) - pos AS size FROM st)
SELECT cu.file_no, cu.chunk_no, upper(sha1(unhex(substr(f.h, 2 * cu.pos::INT + 1, 2 * cu.size::INT)))) AS fp, cu.size::BIGINT AS size FROM cu JOIN f ON f.file_no = cu.file_no""")
def ae_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_chunks(spark, sf_dir, "ae")


# ---- restore caches over exact recipes: every fingerprint lies in one container

SIZES = (2, 4)


def _simulated(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    recipe = _recipe(spark, sf_dir).select(F.lit("exact").alias("config"), "bv", "seq", "fp", "size", "cid")
    out = restore.simulate(recipe, [(policy, n) for n in SIZES], area=CAPACITY, exact=True)
    return _long(out.select("bv", "cache_size", "chunk_num", "data_size", "read_containers"), "bv", "cache_size")


_TOTALS = "t AS (SELECT bv, count(*) AS chunk_num, sum(size)::BIGINT AS data_size FROM rc GROUP BY bv)"
_ACCESS = f"{_RECIPE}, lg AS (SELECT *, lag(cid) OVER (PARTITION BY bv ORDER BY seq) AS l FROM rc), ar AS (SELECT bv, cid, row_number() OVER (PARTITION BY bv ORDER BY seq) - 1 AS record FROM lg WHERE l IS NULL OR l <> cid), {_TOTALS}, cs AS (SELECT unnest([{', '.join(map(str, SIZES))}])::BIGINT AS cache_size)"


@query(f"""{_ACCESS}, a AS (SELECT *, lag(record) OVER (PARTITION BY bv, cid ORDER BY record) AS prev FROM ar),
h AS (SELECT a.bv, a.record, a.prev, count(DISTINCT b.cid) AS apart FROM a LEFT JOIN ar b ON b.bv = a.bv AND b.record > a.prev AND b.record < a.record GROUP BY 1, 2, 3)
SELECT h.bv, cs.cache_size, t.chunk_num, t.data_size, count(*) FILTER (WHERE h.prev IS NULL OR h.apart >= cs.cache_size) AS read_containers FROM h JOIN t ON t.bv = h.bv, cs GROUP BY 1, 2, 3, 4""")
def lru_restore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, "lru")


@query(f"""WITH RECURSIVE {_ACCESS[5:]}, al AS (SELECT bv, list(cid ORDER BY record) AS q, count(*) AS m FROM ar GROUP BY bv),
r AS (SELECT bv, cache_size, q, m, 0::BIGINT AS p, []::BIGINT[] AS held, 0::BIGINT AS reads FROM al, cs UNION ALL
SELECT bv, cache_size, q, m, p + 1, CASE WHEN hit THEN list_concat([x FOR x IN held IF x <> c], [c]) WHEN len(held) < cache_size THEN list_concat(held, [c])
ELSE list_concat(list_concat(held[1:far - 1], held[far + 1:]), [c]) END, CASE WHEN hit THEN reads ELSE reads + 1 END
FROM (SELECT *, q[p + 1] AS c, list_contains(held, q[p + 1]) AS hit, list_position(nx, list_max(nx)) AS far FROM (SELECT *, [coalesce(nullif(list_position(q[p + 2:], x), 0), 1000000000) FOR x IN held] AS nx FROM r WHERE p < m)))
SELECT r.bv, r.cache_size, t.chunk_num, t.data_size, r.reads AS read_containers FROM r JOIN t ON t.bv = r.bv WHERE r.p = r.m""")
def opt_restore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, "opt")


@query(f"""WITH RECURSIVE {_RECIPE[5:]}, {_TOTALS}, cs AS (SELECT unnest([{', '.join(map(str, SIZES))}])::BIGINT AS cache_size),
po AS (SELECT bv, row_number() OVER (PARTITION BY bv ORDER BY seq) AS p, dense_rank() OVER (PARTITION BY bv ORDER BY cid) AS k, sum(size) OVER (PARTITION BY bv ORDER BY seq) AS upto, size FROM rc),
al AS (SELECT bv, list(k ORDER BY p) AS ks, list((upto - size)::BIGINT ORDER BY p) AS before, list(upto::BIGINT ORDER BY p) AS upto, count(*) AS n, max(k) AS m FROM po GROUP BY bv),
r AS (SELECT bv, cache_size, 1::BIGINT AS head, [0::BIGINT FOR x IN range(m)] AS tails, 0::BIGINT AS reads FROM al, cs UNION ALL
SELECT bv, cache_size, CASE WHEN go = 0 THEN n + 1 ELSE head + go - 1 END, tails, reads + 1
FROM (SELECT bv, cache_size, n, head, tails, reads, coalesce(list_position([tails[al_ks[x]] < x FOR x IN range(head, n + 1)], true), 0) AS go
FROM (SELECT r.bv, r.cache_size, al.n, r.head, r.reads, al.ks AS al_ks, list_concat(list_concat(r.tails[1:al.ks[r.head] - 1], [greatest(r.head, len([u FOR u IN al.upto IF u - al.before[r.head] <= greatest(r.cache_size - 1, 1) * {CAPACITY}]))]), r.tails[al.ks[r.head] + 1:]) AS tails
FROM r JOIN al ON al.bv = r.bv WHERE r.head <= al.n)))
SELECT r.bv, r.cache_size, t.chunk_num, t.data_size, max(r.reads) AS read_containers FROM r JOIN t ON t.bv = r.bv GROUP BY 1, 2, 3, 4""")
def asm_restore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, "asm")


# ---- rewriting marks over the stream of a version, one buffer a version

LEVEL, USED = 1, 0.03
LEAST, LIMIT = 0.5, 0.05


def _marks(spark: SparkSession, sf_dir: str, cfg: DedupConfig) -> DataFrame:
    return _long(rewriting.streamed_marks(_segmented_recipe(spark, sf_dir), cfg), "bv")


def _segmented_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipe(spark, sf_dir).select("bv", "seq", "file_no", "segment_no", "size", F.when(F.col("is_dup"), F.col("cid")).alias("known"))


_KNOWN = f"{_RECIPE}, kn AS (SELECT *, CASE WHEN is_dup THEN cid END AS known FROM rc)"


@query(f"""{_KNOWN}, bf AS (SELECT *, seq // {BUFFER} AS buf FROM kn), pc AS (SELECT bv, buf, known, sum(size) AS s FROM bf WHERE known IS NOT NULL GROUP BY 1, 2, 3),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bv, buf ORDER BY s DESC, known) AS r FROM pc) WHERE r <= {LEVEL})
SELECT bf.bv, bf.seq, bf.known IS NOT NULL AND kp.known IS NULL AS is_ooo FROM bf LEFT JOIN kp ON kp.bv = bf.bv AND kp.buf = bf.buf AND kp.known = bf.known""")
def capping_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capping at one container a buffer."""
    return _marks(spark, sf_dir, replace(SMALL, rewrite_algorithm="cap", capping_level=LEVEL))


@query(f"""{_KNOWN}, cl AS (SELECT *, CASE WHEN lag(known) OVER w IS NOT NULL AND (known IS NULL OR known <> lag(known) OVER w OR file_no <> lag(file_no) OVER w OR segment_no <> lag(segment_no) OVER w) THEN 1 ELSE 0 END AS nw FROM kn WINDOW w AS (PARTITION BY bv ORDER BY seq)),
il AS (SELECT *, sum(nw) OVER (PARTITION BY bv ORDER BY seq) AS island FROM cl), pt AS (SELECT *, (row_number() OVER (PARTITION BY bv, island ORDER BY seq) - 1) // {BUFFER} AS part FROM il)
SELECT bv, seq, known IS NOT NULL AND sum(size) OVER (PARTITION BY bv, island, part) < {USED} * {CAPACITY} AS is_ooo FROM pt""")
def island_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands, those longer than the buffer cut."""
    return _marks(spark, sf_dir, replace(SMALL, rewrite_algorithm="cfl", cfl_usage_threshold=USED))


@query(f"""WITH RECURSIVE {_KNOWN[5:]}, nm AS (SELECT *, row_number() OVER (PARTITION BY bv ORDER BY seq) AS i, count(*) OVER (PARTITION BY bv) AS n FROM kn),
cv AS MATERIALIZED (SELECT bv, seq, i, n, known, 1 - (sum(size) OVER (PARTITION BY bv, known ORDER BY i RANGE BETWEEN CURRENT ROW AND {BUFFER - 1} FOLLOWING) + size)::DOUBLE / {CAPACITY}.0::DOUBLE AS u, lag(i) OVER (PARTITION BY bv, known ORDER BY i) AS prev FROM nm),
r AS (SELECT bv, 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS high, {LEAST}::DOUBLE AS threshold, false AS is_ooo FROM cv WHERE i = 1 UNION ALL
SELECT bv, i, CASE WHEN known IS NOT NULL AND NOT ooo THEN list_append([x FOR x IN kept IF x > i - {BUFFER}], i) ELSE kept END, high,
CASE WHEN i < 100 THEN {LEAST}::DOUBLE WHEN floor(i * {LIMIT}::DOUBLE) = 0 THEN 1.0::DOUBLE ELSE (greatest(coalesce(high[floor(i * {LIMIT}::DOUBLE)::BIGINT], -1), {int(LEAST * 10000) - 1}) + 1) / 10000.0::DOUBLE END, ooo
FROM (SELECT bv, i, known, kept, ooo, CASE WHEN bucket >= {int(LEAST * 10000)} THEN list_reverse_sort(list_append(high, bucket)) ELSE high END AS high
FROM (SELECT bv, i, known, kept, high, NOT stays AND known IS NOT NULL AND u >= {LEAST} AND u >= threshold AS ooo, CASE WHEN known IS NULL OR stays THEN 0 ELSE least(floor(greatest(u, 0) * 10000)::BIGINT, 9999) END AS bucket
FROM (SELECT r.bv, cv.i, cv.known, r.kept, r.high, r.threshold, cv.u, cv.known IS NOT NULL AND cv.prev IS NOT NULL AND cv.prev > cv.i - {BUFFER} AND list_contains(r.kept, cv.prev) AS stays
FROM r JOIN cv ON cv.bv = r.bv AND cv.i = r.i + 1 WHERE cv.i <= cv.n - {BUFFER - 1}))))
SELECT nm.bv, nm.seq, coalesce(r.is_ooo, false) AS is_ooo FROM nm LEFT JOIN r ON r.bv = nm.bv AND r.i = nm.i""")
def context_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ahead rewriting: sticky containers, the running utility histogram and its threshold."""
    return _marks(spark, sf_dir, replace(SMALL, rewrite_algorithm="cbr", cbr_minimal_utility=LEAST, cbr_limit=LIMIT))
