"""SimHash near-duplicates: fingerprints of three-word shingles, linked at 3 or fewer differing bits by meet-in-the-middle ball hashing.

Fingerprints. One pass over whole texts, in Arrow batches: A-Z lower-cased, words joined by one space, XXH64 (seed 42) of each run of three words
(fewer words: of the whole sequence; none: fingerprint zero). A bit is 1 if set in over half of the hashes.

Links. Radius 3 is met in the middle: every distinct fingerprint emits all variants at up to 1 bit, and those with an odd number of bits set also
variants at 2 bits, so that any two at distance 3 or less share a variant. Two economies lose no pair. Fingerprints at distance 3 differ in parity, so only
one parity needs the wider ball. And of three differing bits two always lie in the same half of the 64, whichever bit the other side flips; so only pairs of
bits in one half are flipped. Variants leave a batch as packed, hashed-out blocks (a row for each bucket, not for each variant) of 10 bytes a variant.

In a bucket, equal variants make a group. Those who reached it by 2 flips are within 3 bits of those who reached it by 1 or none, and these are
within 2 of each other; so if one of the latter is there, the group is a star around it: a link for each member and never all pairs. (Members that came by
2 flips only may be 4 apart and are not linked by this group.) Every link's distance is verified. Links of a bucket shrink to a spanning forest before they
leave it. Components follow by large-star and small-star rounds.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows are rows like any other; a null id never becomes a component id while
its component has another one, else the component id is null; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batch_limit, extended, large_binary, written

SEED = 42
RADIUS = 3
BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)
_HALF = [(i, j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
#: Flips by code: 0 none, 1..64 one bit, then pairs inside a half.
FLIPS = np.concatenate([[np.uint64(0)], BITS, np.array([BITS[i] | BITS[j] for i, j in _HALF], np.uint64)])
NARROW = 65
#: Variants that one bucket holds on average, and fingerprints whose variants are made at once.
BUCKET_VARIANTS = 1 << 20
CHUNK = 1024
#: Fingerprints whose variants one task emits, on average.
EMIT_EACH = 1 << 15
_MASK = np.uint64((1 << 64) - 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(BITS[2 * ones > len(hashes)].sum(dtype=np.uint64)) if (2 * ones > len(hashes)).any() else 0


def fingerprint(text: bytes, size: int = 3) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII separators
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return majority(np.array([digest(joined, SEED)], np.uint64))
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
    starts, ends = at[: n - size + 1].tolist(), (at[size:] - 1).tolist()
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n - size + 1))


def fingerprints(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp`` (long, the 64 bits)."""
    batch_limit(documents.sparkSession)
    picked = documents.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = extended(picked.drop("__text").schema, "fp bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = large_binary(b.column(b.num_columns - 1))
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return picked.mapInArrow(run, schema)


def _scatter(v: np.ndarray) -> np.ndarray:
    """A bijection whose high bits name the bucket."""
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def variant_blocks(fps: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets that occur, their bounds, variants, codes) of the balls of some fingerprints, ordered by bucket."""
    odd = np.bitwise_count(fps) % 2 == 1
    for some, flips, first in ((fps, FLIPS[:NARROW], 0), (fps[odd], FLIPS[NARROW:], NARROW)):
        if not len(some):
            continue
        v = (some[:, None] ^ flips[None, :]).ravel()
        codes = np.tile(np.arange(first, first + len(flips), dtype=np.uint16), len(some))
        bucket = ((_scatter(v) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
        if buckets <= 1 << 16:
            order = np.argsort(bucket.astype(np.uint16), kind="stable")  # radix sort
        else:
            order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        yield bucket[bounds[:-1]], bounds, v[order], codes[order]


def bucket_links(v: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a bucket's variants: a star for each variant that a member reached by one flip or none."""
    order = np.argsort(v, kind="stable")
    v, codes = v[order], codes[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    several = sizes[group] > 1 if len(group) else np.zeros(0, bool)
    v, codes, group = v[several], codes[several], group[several]
    if not len(v):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    fps = v ^ FLIPS[codes]
    # the centre: the smallest code of the group, which is a narrow one if there is any
    order = np.lexsort((fps, codes, group))
    fps, codes, group = fps[order], codes[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    ok = (codes[at] < NARROW) & (fps != fps[at])
    a, b = fps[at][ok], fps[ok]
    assert not len(a) or int(np.bitwise_count(a ^ b).max()) <= RADIUS
    return a, b


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as (smallest of its tree, node); repeated min-propagation with pointer jumping."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low, high = np.minimum(px, py), np.maximum(px, py)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    leaf = parent != np.arange(len(nodes))
    return nodes[parent[leaf]], nodes[leaf]


def linked(distinct: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at 3 or fewer differing bits: enough of them to connect whatever is connected."""
    spark = distinct.sparkSession
    per_fp = NARROW + (len(FLIPS) - NARROW) / 2
    buckets = int(max(1, round(total * per_fp / BUCKET_VARIANTS)))
    wide = int(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets = max(buckets, wide if total * per_fp / wide > 1 << 14 else 1)
    # enough fingerprints at once that a block has some hundred variants, within a bounded memory
    chunk = int(min(max(CHUNK, buckets), 4 * CHUNK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fps), chunk):
                for ids, bounds, v, codes in variant_blocks(fps[lo : lo + chunk], buckets):
                    raw, raw_codes = v.tobytes(), codes.tobytes()
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(ids.astype(np.int64)),
                        "v": pa.array([raw[8 * s : 8 * e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        "code": pa.array([raw_codes[2 * s : 2 * e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    })

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's rows come sorted by bucket: one bucket is held at a time
        now, held = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            v, codes = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.uint64, np.uint16), strict=True))
            a, b = forest(*bucket_links(v, codes))
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            for i, k in enumerate(batch.column("bucket").to_pylist()):
                if k != now:
                    if now is not None:
                        yield from close()
                    now, held = k, ([], [])
                held[0].append(batch.column("v")[i].as_py())
                held[1].append(batch.column("code")[i].as_py())
        if now is not None:
            yield from close()

    # so many tasks that each emits a bounded number of variants
    spread = distinct.select("fp").repartition(int(max(-(-total // EMIT_EACH), 1)), "fp")
    blocks = spread.mapInArrow(emit, "bucket bigint, v binary, code binary")
    dealt = blocks.repartition(wide, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(match, "a bigint, b bigint").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp): the smallest fingerprint and the smallest id that links reach."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    links = written(linked(nodes.select("fp"), nodes.count()), "simhash-links")
    found = components(links)  # by fingerprint
    tagged = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = tagged.groupBy("component").agg(F.min("low").alias("component_id"))
    return written(tagged.join(least, "component").select("fp", "component", "component_id"), "simhash-classes")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row. The join back to rows meets hot fingerprints (copies); its sides are plain shuffles, which may be split."""
    prints = written(fingerprints(documents, ["doc_id"]), "simhash-prints")
    by_fp = classes(prints).select(F.col("fp").alias("__fp"), "component_id")
    out = prints.join(by_fp, F.col("fp") == F.col("__fp"), "left")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: of the rows with its smallest id (null ids last) the one whose content hashes are smallest.

    Rows are told apart by two 64-bit hashes of all columns with marks for nulls; of rows equal in every column one stays. Equal rows meet in partial aggregates before the one
    exchange of texts, and the join with the chosen rows keeps its partitioning. Null and empty texts have fingerprint zero and are near duplicates of one another; an empty table
    stays empty; all columns, whatever their names, come back as they were.
    """
    names = documents.columns
    marked = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    keys = [F.xxhash64(F.lit(seed), *marked).alias(k) for seed, k in ((1, "__a"), (2, "__b"))]
    prints = written(fingerprints(documents.select(F.col("doc_id"), F.col("text"), *keys), ["doc_id", "__a", "__b"]), "simhash-prints")
    by_fp = classes(prints).select(F.col("fp").alias("__fp"), "component")
    tagged = prints.join(by_fp, F.col("fp") == F.col("__fp")).select("doc_id", "__a", "__b", "component")
    # by the component and not by its id, which components without ids, or with the same id, have in common
    best = tagged.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), "__a", "__b")).alias("best"))
    kept = best.select(F.col("best.__a").alias("__a"), F.col("best.__b").alias("__b"))
    rows = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], *keys)
    out = rows.dropDuplicates(["__a", "__b"]).join(kept, ["__a", "__b"], "left_semi")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
