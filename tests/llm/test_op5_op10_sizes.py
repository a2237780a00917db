import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chunkloom.llm import mixing, queries, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, copies int"


def docs(spark, n=700, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(int(rng.paretovariate(1.2) * 8) % 3000)), "en", rng.choice(["a", "a", "a", "b", "ç", "z", None]), 1, "s", 2) for i in range(n)]
    rows += [(None, "null id", None, "a", 1, None, None), (n, None, "en", "b", 0, "s", 1), (n + 1, "", "en", None, 0, "s", 1), (3, rows[3][1], "en", rows[3][3], 1, "s", 2), (n + 2, "x " * 30_000, "en", "z", 1, "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_matrix_margins_and_distribution():
    counts, capacity = np.array([5, 0, 9, 2]), np.array([6, 5, 5])
    draws = np.stack([sharding.communication_matrix(counts, capacity, s) for s in range(3000)])
    assert (draws.sum(2) == counts).all() and (draws.sum(1) == capacity).all()
    # hypergeometric mean: n_p * c_s / N
    assert np.abs(draws.mean(0) - np.outer(counts, capacity) / 16).max() < 0.1
    assert abs(draws[:, 0, 0].var() - 5 * 6 / 16 * 10 / 16 * 11 / 15) < 0.1


def test_shards(spark, tmp_path):
    frame = docs(spark)
    out = sharding.shard_rows(frame, 16)
    assert sorted(out.columns) == sorted({*frame.columns, "slot"})
    rows = out.collect()
    n = frame.count()
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shard_rows(frame.repartition(9), 16).collect()}
    assert sum(again[r.doc_id, r.text] == (r.shard, r.slot) for r in rows) >= n - 2  # equal rows may swap
    assert sharding.shard_rows(frame.limit(0), 16).count() == 0
    assert [r.shard for r in sharding.shard_rows(frame.limit(1), 16).collect()] == [0]


def test_exact_draws_beyond_numpys(monkeypatch):
    """Margins hold above the limit, and the draw of places has the hypergeometric law: no room is drawn twice, which a rounded normal doesn't know."""
    big = np.array([1 << 31, 1 << 31, (1 << 31) - 5])
    matrix = sharding.communication_matrix(np.array([5000, 3_000_000, 0, 7]), big, 3)
    assert matrix.sum(1).tolist() == [5000, 3_000_000, 0, 7] and (matrix <= big).all()
    assert all(abs(x - 1_000_000) < 6 * (2 / 9 * 3_000_000) ** 0.5 for x in matrix[1])
    monkeypatch.setattr(sharding, "NUMPY_DRAWS", 4, raising=False)
    monkeypatch.setattr(sharding, "DRAWN_AT_ONCE", 2, raising=False)
    seen = [tuple(sharding.communication_matrix(np.array([3, 3]), np.array([2, 4]), seed)[0]) for seed in range(4000)]
    # three of six rooms, two of them in the first shard: 4, 12 and 4 of 20 ways
    assert all(abs(seen.count((k, 3 - k)) / 4000 - ways / 20) < 0.03 for k, ways in ((0, 4), (1, 12), (2, 4)))
    monkeypatch.undo()
    # a few draws from many rooms: a rounded normal has no such skew (1 in 1001 rooms, 1000 draws: e^-1 of all have none)
    many = [sharding.communication_matrix(np.array([1000]), np.array([2_000_000, 2_000_000_000]), seed)[0, 0] for seed in range(1500)]
    assert abs(np.mean(np.array(many) == 0) - np.exp(-1)) < 0.05


def test_shards_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 8)
    rows = sharding.shard_rows(spark.range(1000).withColumnRenamed("id", "doc_id"), 7).collect()
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) and len(v) in (142, 143) for v in by.values())
    # uniform: neighbours in the input are no neighbours in the output
    at = {r.doc_id: r.slot for r in rows}
    assert abs(np.corrcoef([at[i] for i in range(1000)], range(1000))[0, 1]) < 0.12


def test_op5_columns(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op5_sharding(spark, str(tmp_path)).collect():
        assert r.law == "rows" and r.grown_shard is None
    got = {r.doc_id: (r.size, r.text_crc32) for r in queries.op5_sharding(spark, str(tmp_path)).collect()}
    for r in docs(spark).collect():
        if r.doc_id != 3:
            t = (r.text or "").encode()
            assert got[r.doc_id] == (len(t) + 1, zlib.crc32(t))


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = sum(w[k] for k in names if k not in fixed)
        now = {k: fixed.get(k, rest * w[k] / free if free else 0) for k in names}
        over = {k: cap * sizes[k] for k in names if k not in fixed and now[k] > cap * sizes[k] + 1e-9}
        if not over:
            return now
        fixed |= over


def test_targets_equal_water_filling(spark):
    rng = random.Random(5)
    for _ in range(6):
        sizes = {k: rng.choice([0, 1, 10, 1000, 100_000]) for k in rng.sample(["a", "b", "B", "é", "zz", "𝒜", "￿", None], rng.randint(1, 8))}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in sizes), (sizes, got, want)


def test_mix(spark):
    frame = docs(spark)
    rows = mixing.mix_sizes(frame).collect()
    assert len(rows) == frame.count()
    words = lambda t: len((t or "").encode().split())
    sizes, want = {}, {}
    for r in frame.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        assert r.size == 0 or int(ratio + 1e-9) <= r.copies <= int(np.ceil(ratio - 1e-9))
    for s in sizes:
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - want[s]) <= max(r.size for r in rows if r.source == s)
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, mixing.mix_sizes(frame.repartition(11)).collect())) == sorted(map(key, rows))
    copied = mixing.mix_documents(frame)
    assert copied.columns == frame.columns
    by = {}
    for r in copied.collect():
        by.setdefault(r.source, []).append(words(r.text))
    for s in sizes:  # rows equal in every column are a unit here
        assert abs(sum(by.get(s, [])) - want[s]) <= max(r.size for r in rows if r.source == s)
    assert mixing.mix_sizes(frame.limit(0)).count() == 0 and mixing.mix_documents(frame.limit(0)).count() == 0


def test_repeated_rows_share_whole_copies(spark, monkeypatch):
    """A row that is repeated a thousand times is drawn about once, not all or nothing; its copies are spread out in pieces."""
    monkeypatch.setattr(mixing, "SPREAD", 64)
    rows = [(1, "a b c d", "s0")] * 1000 + [(i, "x " * (i % 7 + 1), f"s{i % 4}") for i in range(2, 400)]
    frame = spark.createDataFrame([(d, t, "en", s, i, "d1", 2) for i, (d, t, s) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, d1 string, __copies int")
    got = mixing.mix_sizes(frame).collect()
    assert len(got) == len(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
    assert len({r.copies for r in got if r.doc_id == 1}) <= 2
    same = frame.withColumn("n_chars", F.lit(7).cast("bigint"))
    copied = mixing.mix_documents(same)
    assert copied.columns == frame.columns
    taken = {r.source: r.n for r in copied.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(taken[r.source] - r.target) <= 8 for r in got)


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 32)
    rows = [(1, "same", None)] * 700 + [(i, f"t{i}", "5") for i in range(2, 300)] + [(None, "5", None), (5, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, slot string").repartition(7)
    keyed = frame.drop("slot").select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(["doc_id", "text"])], sharding.row_hash(frame.drop("slot"), 11).alias("__h"))
    apart = sharding.numbered_apart(keyed, len(rows))
    assert apart.count() == len(rows) and apart.groupBy("__h").count().agg(F.max("count")).first()[0] == 1
    got = sharding.shard_rows(frame, 16).collect()
    sizes = [sorted(r.slot for r in got if r["shard"] == s) for s in range(16)]
    assert len(got) == len(rows) and max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(x == list(range(len(x))) for x in sizes)
    assert sum(r.doc_id == 1 for r in got) == 700


def test_rounding_keeps_expectations(spark):
    """Over many seeds each unit is taken as often as its probability says, and the words taken stay within one unit."""
    rng = random.Random(8)
    size = {u: rng.choice([1, 3, 10, 40]) for u in range(30)}
    units = spark.createDataFrame([(s, s * 1000 + u, float(a), 0.3, 30) for s in range(200) for u, a in size.items()], "s bigint, u bigint, a double, p double, k bigint")
    out = mixing.pivotal(units).collect()
    assert len(out) == 6000 and {r.taken for r in out} == {0, 1}
    share = {u: np.mean([r.taken for r in out if r.u % 1000 == u]) for u in size}
    assert np.abs(np.array(list(share.values())) - 0.3).max() < 0.13 and abs(np.mean([r.taken for r in out]) - 0.3) < 0.02
    for s in range(200):
        assert abs(sum(size[r.u % 1000] * r.taken for r in out if r.s == s) - 0.3 * sum(size.values())) <= 40


def test_rounding_through_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 24)
    units = spark.range(3000).select(F.lit(1).cast("bigint").alias("s"), F.xxhash64("id").alias("u"), F.lit(5.0).alias("a"), F.lit(0.37).alias("p"), F.lit(3000).cast("bigint").alias("k"))
    out = mixing.pivotal(units)
    assert out.count() == 3000 and out.select("u").distinct().count() == 3000
    assert abs(out.agg(F.sum("taken")).first()[0] - 1110) <= 1
