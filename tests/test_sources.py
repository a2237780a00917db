import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import chunking, packing, restore
from chunkloom.sources import hashfile, snapshots, store, trace

rng = random.Random(3)


def files(spark):
    rows = [(0, 0, "a b.txt", b"x" * 200), (0, 1, "file start 3", b""), (0, 2, "ü", b"y" * 64), (0, 3, "z", rng.randbytes(300))]
    return spark.createDataFrame(rows, "bv int, file_no bigint, filename string, content binary")


def test_trace_round_trip(spark, tmp_path):
    f = files(spark)
    chunks = chunking.fixed_chunks(f, 64)
    trace.write_trace(trace.trace_lines(chunks, f), 0, f"{tmp_path}/t")
    back = trace.read_trace(spark, f"{tmp_path}/t", 0)
    key = lambda r: (r.file_no, r.chunk_no, bytes(r.fp), r.size)
    assert sorted(map(key, back.collect())) == sorted(map(key, chunks.collect()))
    assert {(r.file_no, r.filename) for r in back.collect()} == {(0, "a b.txt"), (2, "ü"), (3, "z")}


def test_trace_in_lower_case(spark, tmp_path):
    fp = hashlib.sha1(b"1").hexdigest()
    (tmp_path / "t").write_text(f"file start 1\nq\n{fp} 7\nfile end\nstream end")
    assert [(bytes(r.fp).hex(), r.size) for r in trace.read_trace(spark, str(tmp_path / "t"), 4).collect()] == [(fp, 7)]


def test_directories(spark, tmp_path):
    for name, data in (("b/2", b"two"), ("a", b"one"), ("b/empty", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = [(r.file_no, r.filename, bytes(r.content)) for r in snapshots.directory_files(spark, str(tmp_path), 1).orderBy("file_no").collect()]
    assert got == [(0, "a", b"one"), (1, "b/2", b"two"), (2, "b/empty", b"")]


@pytest.mark.parametrize("version", range(1, 8))
@pytest.mark.parametrize("method,bits", [(hashfile.FIXED, 160), (hashfile.VARIABLE, 48), (hashfile.VARIABLE, 256)])
def test_hash_files(spark, tmp_path, version, method, bits):
    made = []
    for i, (n, tail) in enumerate([(3, 100), (0, 0), (1, 4096)]):
        size = max(n - 1, 0) * 4096 + tail
        made.append({"path": f"/p/{i}", "file_size": size, "blocks": 8, "uid": 5, "perm": 0o100644, "mtime": 86400, "hardlinks": 1, "inodenum": 77, "hashes": [(rng.randbytes(bits // 8), 4096 if k < n - 1 else tail, 9) for k in range(n)]})
    made.append({"path": "/link", "target_path": "/p/0", "perm": 0o120777, "hashes": []})
    (tmp_path / "h").write_bytes(hashfile.build(made, method, 4096, 6, bits, version, "/root", "sys"))
    path = str(tmp_path / "h")
    got = {(r.file_no, r.chunk_no): r for r in hashfile.read_chunks(spark, path).collect()}
    assert len(got) == 4
    for i, f in enumerate(made):
        for k, (digest, size, ratio) in enumerate(f["hashes"]):
            r = got[i, k]
            assert bytes(r.fp) == digest[:20].ljust(20, b"\0") and r.path == f["path"]
            assert r.size == (size if method == hashfile.FIXED or version >= 3 else 0)
            assert r.cratio == (ratio if version >= 6 else 0)
    listed = {r.path: r for r in hashfile.read_files(spark, path).collect()}
    assert set(listed) == {f["path"] for f in made}
    assert listed["/link"].target_path == ("/p/0" if version >= 4 else "")
    assert listed["/p/0"].uid == (5 if version >= 4 else 0) and listed["/p/0"].blocks == (8 if version >= 5 else 0)
    head = hashfile.read_headers(spark, path).first()
    assert (head.version, head.files, head.chunks, head.path_root, head.hash_bits) == (version, 4, 4, "/root", bits)
    assert head.system == ("sys" if version >= 3 else "")


def test_bad_hash_files():
    good = hashfile.build([{"path": "p", "file_size": 1, "hashes": [(b"1" * 20, 1, 0)]}])
    for bad in (b"", b"\0" * 10_000, good[:-3], good[:4] + b"\x09" + good[5:]):
        with pytest.raises(hashfile.HashFileError):
            list(hashfile.parse(bad))


def test_written_hash_file(spark, tmp_path):
    f = files(spark)
    chunks = chunking.fixed_chunks(f, 64)
    hashfile.write(spark, f.select("file_no", "filename"), chunks, f"{tmp_path}/w")
    key = lambda r: (r.file_no, r.chunk_no, bytes(r.fp), r.size)
    assert sorted(map(key, hashfile.stream(spark, f"{tmp_path}/w", 0).collect())) == sorted(map(key, chunks.collect()))


def test_store(spark, tmp_path):
    root = f"{tmp_path}/work"
    assert store.next_version(spark, root) == 0
    f = files(spark)
    chunks = chunking.with_seq(chunking.fixed_chunks(f, 64, with_data=True))
    from chunkloom.config import DedupConfig

    packed = packing.pack_containers(chunks.groupBy("fp").agg(F.min(F.struct("bv", "seq", "size")).alias("f")).select("fp", "f.bv", "f.seq", "f.size"), DedupConfig(container_data=256, container_entries=3))
    data = packed.join(chunks.select("bv", "seq", "data"), ["bv", "seq"])
    store.write_containers(packed.select("cid", "fp", "off", F.col("size").alias("len")), root, restore.container_payload(data))
    store.add_version(spark, root, 0, "/p", 4, chunks.count())
    assert store.next_version(spark, root) == 1
    entries = spark.read.parquet(f"{root}/container_entries").drop("cid_group")
    blocks = spark.read.parquet(f"{root}/containers").drop("cid_group")
    got = {(r.cid, bytes(r.fp)): bytes(r.data) for r in restore.chunk_from_container(blocks, entries).collect()}
    assert all(hashlib.sha1(d).digest() == fp for (_, fp), d in got.items()) and len(got) == packed.count()
    assert store.read_container(spark, root, 0).count() == 1
    assert store.read_container(spark, root, 1, directory_only=True).count() <= 3
    recipe = packing.recipes(chunks.drop("data"), packed.select("fp", "cid"))
    store.write_versions(recipe, root, "recipes")
    out = restore.restore_files(store.read_versions(spark, root, "recipes", 0), restore.chunk_from_container(blocks, entries))
    want = {r.file_no: bytes(r.content) for r in f.collect() if r.content}
    assert {r.file_no: bytes(r.content) for r in out.collect()} == want
    store.reset(spark, root)
    assert store.next_version(spark, root) == 0


def test_binary_store_round_trip(spark, tmp_path):
    from chunkloom.sources import binary_store as bs

    chunks = [(rng.randbytes(20), rng.randbytes(rng.randint(1, 900))) for _ in range(30)]
    pool = [(0, chunks[:10]), (1, chunks[10:29]), (2, chunks[29:])]
    (tmp_path / "pool").write_bytes(bs.build_pool(pool))
    (tmp_path / "dirs").write_bytes(bs.build_pool(pool, directory_only=True))
    want = {(cid, fp, len(d)) for cid, own in pool for fp, d in own}
    for name, only in (("pool", False), ("dirs", True)):
        assert {(r.cid, bytes(r.fp), r.len) for r in bs.read_entries(spark, str(tmp_path / name), only).collect()} == want
    got = restore.chunk_from_container(bs.read_payload(spark, str(tmp_path / "pool")), bs.read_entries(spark, str(tmp_path / "pool"))).collect()
    assert {(r.cid, bytes(r.fp), bytes(r.data)) for r in got} == {(cid, fp, d) for cid, own in pool for fp, d in own}
    with pytest.raises(ValueError):
        bs.build_pool([(0, [(bytes(20), bytes(4_200_000))])])

    pointers = [(fp, cid, len(d)) for cid, own in pool for fp, d in own]
    (tmp_path / "r").write_bytes(bs.build_recipe([pointers[:7], pointers[7:30]]))
    rows = bs.read_recipe(spark, str(tmp_path / "r")).orderBy("seq").collect()
    assert [(bytes(r.fp), r.cid, r.size) for r in rows] == pointers and [r.segment_no for r in rows] == [0] * 7 + [1] * 23

    (tmp_path / "m").write_bytes(bs.build_meta(4, "/p/ü/", True, 30, [("a", 7, 100), ("ü/empty", 0, 0)]))
    assert tuple(bs.read_version(spark, str(tmp_path / "m")).first()) == (4, "/p/ü/", True, 2, 30)
    assert [tuple(r) for r in bs.read_file_recipes(spark, str(tmp_path / "m")).orderBy("file_no").collect()] == [(0, "a", 7, 100), (1, "ü/empty", 0, 0)]

    (tmp_path / "a").write_bytes(bs.build_records([0, 1, 0, 2]))
    assert [r.cid for r in bs.read_records(spark, str(tmp_path / "a")).orderBy("record").collect()] == [0, 1, 0, 2]

    index = {rng.randbytes(20): [5, 3], rng.randbytes(20): [9]}
    (tmp_path / "i").write_bytes(bs.build_index(index, 2))
    got = sorted((bytes(r.feature), r.ord, r.unit_id) for r in bs.read_index(spark, str(tmp_path / "i")).collect())
    assert got == sorted((k, i, u) for k, units in index.items() for i, u in enumerate(units))


def test_files_are_made_from_passing_rows(spark):
    """A file's rows are Python objects a few at a time, in their order, keys apart."""
    from chunkloom.sources import images

    frame = spark.range(20_000).selectExpr("cast(id % 2 as int) AS k", "19999 - id AS place", "repeat('x', 50) AS ballast").repartition(6)

    def build(rows):
        import gc

        content, most = bytearray(), 0
        for i, r in enumerate(rows):
            content += r["place"].to_bytes(4, "little")
            if i % 4_000 == 0:
                most = max(most, sum(type(o) is dict and o.keys() == {"k", "place", "ballast"} for o in gc.get_objects()))
        return content + most.to_bytes(4, "little")

    for k, content in images.imaged(frame, ["k"], ["place"], build).collect():
        *places, most = [int.from_bytes(content[i : i + 4], "little") for i in range(0, len(content), 4)]
        assert places == [p for p in range(20_000) if (19_999 - p) % 2 == k]
        assert most <= 2 * images.SLICE


@pytest.mark.parametrize("split", [64, 97, 1_000, 1 << 20])
def test_a_trace_is_read_in_splits(spark, tmp_path, split):
    """Whatever line a split ends with, files, names and places are those of the whole trace."""
    from chunkloom.sources import trace

    names = ["a", "file end", "x" * 90, "stream end", "é b"]
    lines, want = [], []
    for n, name in enumerate(names):
        lines += [f"file start {len(name.encode())}", name]
        for c in range(n * 2):
            fp = bytes([n, c]) * 10
            lines.append(f"{fp.hex().upper() if c % 2 else fp.hex()} {c + 1}")
            want.append((n, c, name, fp, c + 1))
        lines.append("file end")
    (tmp_path / "t").write_text("\n".join([*lines, "stream end"]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        frame = trace.read_trace(spark, str(tmp_path / "t"), 0)
        got = sorted((r.file_no, r.chunk_no, r.filename, bytes(r.fp), r.size) for r in frame.collect())
        plan = frame._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(want)
    assert "posexplode" not in plan  # no row holds the whole trace
