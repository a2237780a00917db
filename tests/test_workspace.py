import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chunkloom.__main__ import main
from chunkloom.config import SMALL, DedupConfig
from chunkloom.functions import bloom
from chunkloom.operators import chunking
from chunkloom.plans.workspace import Workspace
from chunkloom.sources import trace
from chunkloom.streaming.incremental import unique_chunks

rng = random.Random(2)


def versions(n=3):
    files = {f"d/{i}": rng.randbytes(rng.randint(0, 900)) for i in range(6)} | {"empty": b""}
    for _ in range(n):
        yield dict(files)
        k = rng.choice(sorted(files))
        files[k] = files[k][:50] + b"changed" + files[k][50:]
        files[f"n{rng.randint(0, 999)}"] = files["d/1"]


CONFIGS = {
    "exact": replace(SMALL, index_exact=True, sampling_ratio=1, container_data=1000),
    "content-defined": replace(SMALL, chunk_algorithm="rabin", chunk_avg_size=256, chunk_min_size=64, chunk_max_size=512, index_exact=True, container_data=1000),
    "near-exact": replace(SMALL, index_logical=True, sampling_method="random", segment_algorithm="content-defined", segment_average=8, segment_min=2, container_data=1000),
    "har": replace(SMALL, index_preset="ddfs", har=True, container_data=1000, restore_cache="opt"),
}


def write(base, content):
    for name, data in content.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)


@pytest.mark.parametrize("name", CONFIGS)
def test_backup_and_restore(spark, tmp_path, name):
    ws = Workspace(spark, CONFIGS[name], f"{tmp_path}/work")
    made = list(versions())
    for v, content in enumerate(made):
        write(tmp_path / f"src{v}", content)
        assert ws.backup_directory(f"{tmp_path}/src{v}") == v
    for v, content in enumerate(made):
        got = {r.filename: bytes(r.content) for r in ws.restore(v).collect()}
        assert got == content
    (tmp_path / "out").mkdir()
    assert ws.restore_to(1, f"{tmp_path}/out") == len(made[1])
    assert all((tmp_path / "out" / k).read_bytes() == d for k, d in made[1].items())
    total = ws.stat().first()
    assert total.versions == 3 and total.data_size == sum(len(d) for c in made for d in c.values())
    assert total.stored_size < total.data_size
    reads = ws.simulate_restore(2).first()
    assert reads.data_size == sum(len(d) for d in made[2].values()) and reads.read_containers > 0
    assert len(ws.log().collect()) == 3


def test_retention(spark, tmp_path):
    ws = Workspace(spark, replace(CONFIGS["exact"], retention=2), f"{tmp_path}/work")
    made = list(versions(4))
    for v, content in enumerate(made):
        write(tmp_path / f"src{v}", content)
        ws.backup_directory(f"{tmp_path}/src{v}")
    assert {r.bv for r in ws.versions().where("deleted").collect()} == {0, 1}
    for v in (0, 1, 9):
        with pytest.raises(ValueError):
            ws.restore(v)
    lost = {c for r in spark.read.parquet(f"{ws.root}/gc_stats").collect() for c in r.reclaimed}
    for v in (2, 3):
        assert not lost & {r.cid for r in ws.recipe(v).collect()}


def test_traces_store_what_payload_stores(spark, tmp_path):
    content = next(versions(1))
    write(tmp_path / "src", content)
    cfg = CONFIGS["exact"]
    a = Workspace(spark, cfg, f"{tmp_path}/a")
    a.backup_directory(f"{tmp_path}/src")
    from chunkloom.sources.snapshots import directory_files

    files = directory_files(spark, f"{tmp_path}/src", 0)
    trace.write_trace(trace.trace_lines(chunking.chunks(files, cfg), files), 0, f"{tmp_path}/t")
    b = Workspace(spark, replace(cfg, simulation_level="all"), f"{tmp_path}/b")
    b.backup_trace(f"{tmp_path}/t")
    same = lambda w: w.stat().select("chunks", "data_size", "unique_chunks", "stored_size").first()
    assert same(a) == same(b)
    with pytest.raises(ValueError):  # a store without payload can't be restored from later
        Workspace(spark, cfg, f"{tmp_path}/b")


def test_command_line(spark, tmp_path, capsys):
    content = next(versions(1))
    write(tmp_path / "src", content)
    (tmp_path / "c").write_text("chunk-algorithm fixed\nchunk-avg-size 128\nfingerprint-index exact physical\n")
    common = ["-c", f"{tmp_path}/c", "-p", f"working-directory {tmp_path}/w"]
    assert main([*common, f"{tmp_path}/src"]) == 0
    (tmp_path / "out").mkdir()
    assert main([*common, "-r", "0", f"{tmp_path}/out"]) == 0
    assert all((tmp_path / "out" / k).read_bytes() == d for k, d in content.items())
    assert main([*common, "-s"]) == 0 and main([*common, "-t", f"{tmp_path}/src"]) == 0 and main([*common, "-d", "0"]) == 0
    assert "version 0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(common)


def test_bloom_filter(spark):
    keys = spark.range(500).select(F.sha1(F.col("id").cast("string")).alias("k"))
    words = bloom.build(keys, "k", bits=1 << 14)
    asked = spark.range(0, 4000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    got = {r.k for r in bloom.might_contain(asked, "k", words, bits=1 << 14).collect()}
    inside = {r.k for r in keys.collect()}
    assert inside <= got and len(got - inside) < 200


def test_streaming_dedup_keeps_first_copies(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("fp"), F.col("id").alias("seq"))
    rows.write.parquet(f"{tmp_path}/in")
    q = unique_chunks(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 7


def test_defaults_are_a_valid_configuration():
    assert DedupConfig().resolved().chunk_avg_size == 8192
