import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chunkloom.llm import chat_format, components, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"
rng = random.Random(9)


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    runs = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest index reachable over links of 3 bits or fewer."""
    f = np.array(fps, np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(f))]


def words(n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a B", "É é x", "A b C d", "x " * 400, words(3000), "\x0ba\x0cb\rc\td"])
def test_fingerprints(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_links_lose_no_pair(spark, monkeypatch):
    """Planted balls and chains at 0 to 4 bits, in both parities, against all pairs."""
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1 << 12)
    fps = []
    for _ in range(120):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randint(0, 4)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps) | {0, 1, 7, (1 << 64) - 1, (1 << 64) - 2})
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    links = [(r.a, r.b) for r in simhash.linked(frame, len(fps)).collect()]
    index = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(fps)}
    assert all(bin(fps[index[a]] ^ fps[index[b]]).count("1") <= 64 for a, b in links)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(index[a]), find(index[b])))
        parent[y] = x
    assert [find(i) for i in range(len(fps))] == brute_components(fps)


def test_every_link_is_within_the_radius():
    x = np.array([rng.getrandbits(64) for _ in range(50)], np.uint64)
    near = np.unique(np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(1 << 40), x ^ np.uint64((1 << 40) + 3)]))
    v, codes = [], []
    for _, _, a, b in simhash.variant_blocks(near, 1):
        v.append(a)
        codes.append(b)
    a, b = simhash.bucket_links(np.concatenate(v), np.concatenate(codes))
    assert len(a) and int(np.bitwise_count(a ^ b).max()) <= 3
    assert len(a) < len(np.concatenate(v))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = dict((r.node, r.component) for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 400)} | {500: 500, 501: 500}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def corpus():
    rows = []
    for i in range(150):
        t = words(rng.randint(20, 200))
        rows.append((i, t))
    rows += [(150 + i, rows[i][1]) for i in range(10)]  # copies
    for i in range(20, 30):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((160 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (299, " "), (None, words(50)), (None, rows[3][1]), (302, words(20_000)), (4, rows[4][1]), (303, "one"), (304, "ONE")]
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "z") for d, t in rows], DOCS).repartition(5)
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    least = {}
    for i, c in enumerate(brute_components(fps)):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), rows[i][0])
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", str(least.get(c))) for i, c in enumerate(brute_components(fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(set(brute_components(fps)))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 and simhash.keep_one(frame.limit(0)).count() == 0


def test_one_row_of_each_component_whatever_its_ids(spark):
    """Rows that share an id, or have none, but not their texts, are components of their own."""
    a, b, c, d, e = (words(60) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, c), (7, d), (None, e), (9, e)]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "en", "s", 1, "z") for i, t in rows], DOCS).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", a), ("None", b), ("7", c), ("7", d), ("9", e)])


def test_rows_differ_in_which_column_is_null(spark):
    """(null, '5') and (5, null) are two rows; columns may be called like ours."""
    frame = spark.createDataFrame([(None, "5", "x", "y"), (5, None, "x", "y"), (5, None, "x", "y"), (6, words(30), None, "x"), (6, words(31), "x", None)], "doc_id bigint, text string, __row string, __a string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, {tuple(r) for r in frame.collect()}))


def test_pairs_share_none_some_or_all(spark):
    """Prefixes of every kind, ids beyond 2^53, neighbours that aren't there, repeated turns, null ids."""
    base = 1 << 60
    turns = [(base + k, i, "user" if i % 2 == 0 else "assistant", f"{k}-{i}") for k in range(64) for i in range(4)]
    turns += [(base + 200, 0, "user", "alone"), (None, 0, "user", "lost"), (base + 3, 2, "user", "3-2")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    pairs = {r.pair_id: r for r in chat_format.rejected_variants(frame).collect()}
    out = {r.pair_id: r for r in chat_format.format_pairs(chat_format.rejected_variants(frame)).collect()}
    assert set(out) == {base + k for k in range(64)} | {base + 200}
    for k, r in out.items():
        a, b = [(t.role, t.text) for t in pairs[k].a], [(t.role, t.text) for t in pairs[k].b]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert r.prompt_turns == n
        show = lambda x: "".join(f"<|im_start|>{role}\n{text or ''}<|im_end|>\n" for role, text in x)
        assert (r.prompt, r.chosen, r.rejected) == (show(a[:n]), show(a[n:]), show(b[n:]))
    assert len(pairs[base + 3].a) == 5
    assert {r.prompt_turns for r in out.values()} >= {0, 3}
    assert chat_format.rejected_variants(frame.limit(0)).count() == 0


def test_preferences(spark):
    turns = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, True, 2, "user", "ok"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"),
        (2, True, 0, "user", "a"), (2, True, 1, "assistant", "b"), (2, False, 0, "user", "a"), (2, False, 1, "assistant", "b"),
        (3, True, 0, "user", "only"), (4, False, None, None, None), (4, True, None, None, None), (4, True, 1, "assistant", "x" * 50_000),
        (None, True, 0, "user", "lost"), (5, None, 0, "user", "lost"), (6, True, 0, "user", ""), (6, False, 0, "user", None),
    ]
    frame = spark.createDataFrame(turns, "pair_id bigint, chosen boolean, turn bigint, role string, text string").withColumn("prompt", F.lit("clash"))
    out = chat_format.preference_pairs(frame).withColumn("trained", chat_format.masked(F.col("chosen"), F.col("chosen_segments")))
    got = {r.pair_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    block = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (block("user", "hi"), block("assistant", "yes") + block("user", "ok"), block("assistant", "no"))
    assert got[1].trained == "yes<|im_end|>\n"
    assert [(s.start, s.end, s.train) for s in got[1].rejected_segments] == [(22, 22 + 13, True)]
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_segments) == (2, "", "", [])
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("", block("user", "only"), "")
    assert got[4].prompt == block("", "") and len(got[4].trained) == 50_000 + len("<|im_end|>\n")
    assert got[6].prompt_turns == 0 and got[6].chosen == got[6].rejected == block("user", "")
    assert chat_format.preference_pairs(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on its own input: what the operators say takes effect, and nothing else goes."""
    rows = [(i, words(rng.randint(60, 150)) + ".", f"s{i % 3}") for i in range(200)]
    rows += [(200 + i, "### $$$ " * 60, "s1") for i in range(60)]
    item = words(30)
    rows += [(300 + i, words(50) + f" {item} " + words(50), "s2") for i in range(5)]
    rows += [(400 + i, rows[i][1], "s0") for i in range(20)]
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(not 200 <= d < 300), 0) for d, _, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted(r.doc_id for r in docs.collect()))
        assert docs.columns == before if name != "sharding" else {"shard", "slot"} <= set(docs.columns)
    clean = set(range(200)) | set(range(300, 305)) | set(range(400, 420))
    assert set(seen[0]) == clean
    assert len(seen[1]) == len(set(seen[1])) and set(seen[1]) == set(range(200)) | set(range(300, 305))
    assert set(seen[2]) == set(range(200))
    assert set(seen[3]) <= set(range(200)) and max(seen[3].count(i) for i in set(seen[3])) <= 3
    assert seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, clashing names, no rows at all."""
    item = words(30)
    long = words(30_000)
    rows = [(i, words(80), f"s{i % 2}") for i in range(40)] + [(None, None, None), (None, "", "s0"), (50, None, "s1"), (51, long, "s0"), (52, item, None), (1, words(90), "s0"), (None, words(70), "s1")]
    rows += [rows[3], rows[3], rows[40]]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string, __d int, __copy int, shard string, d1 int, __text string"
    spark.createDataFrame([(d, t, "en", s, 5, "r", 1, 2, "old", 3, "q") for d, t, s in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _, _ in rows] + [(None, 0, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == want if name != "sharding" else set(docs.columns) == set(want) | {"slot"}
        texts = [r.text for r in docs.collect()]
        assert long in texts or name in ("mixing", "sharding")
        if name == "simhash_near_dedup":
            assert len(texts) == 45 and sum(not t for t in texts) == 1
        if name == "benchmark_decontamination":
            assert len(texts) == 44 and item not in texts
