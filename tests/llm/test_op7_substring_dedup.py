import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import substring_dedup as sd

DOCS = "doc_id bigint, text string, chunk string, n_words int"


def brute(rows):
    """rows: (id, text); ids null last."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - sd.WINDOW + 1):
            key = tuple(w[s : s + sd.WINDOW])
            if key in seen:
                gone[s : s + sd.WINDOW] = [True] * sd.WINDOW
            seen.add(key)
        out.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def run(spark, rows, parts=5):
    frame = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], DOCS).repartition(parts)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(frame).collect())


@pytest.mark.parametrize("seed,chunk", [(1, 8 << 20), (2, 300), (3, 2000)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(sd, "CHUNK_BYTES", chunk)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "the", "x" * rng.randint(1, 9)])
    passages = [[word() for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                s = rng.randint(0, 10)
                body += p[s : s + rng.randint(5, 80)]
        if rng.random() < 0.1:
            body = ["z"] * rng.randint(1, 60)
        rows.append((i * 7 % 121, rng.choice([" ", "\n", "\t ", "  "]).join(body)))
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{i % 9973}" for i in range(40_000))
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(5, None), (6, ""), (7, " \n\t"), (1, p), (1, p), (None, p), (2, p + " tail"), (3, "x " + p[:-1]), (9, long), (8, long), (4, "one"), (10, "\x0b".join(p.split()))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_one_passage_in_every_document(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"head{i} {p} tail{i}") for i in range(400)]
    got = run(spark, rows)
    assert sum(r[2] for r in got) == 60 * 399 and got == brute(rows)


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    v = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.int64)).astype(np.uint64) * np.uint64(2)
    assert (sd.unpack(sd.pack(v)) == v).all()
    assert len(sd.unpack(sd.pack(v[:0]))) == 0


def test_one_first_hash_for_two_texts(spark, monkeypatch):
    """If first hashes collide, the second ones still tell windows apart."""
    h = np.array([5, 5, 9, 5, 9, 5], np.uint64)
    second = np.array([1, 2, 7, 1, 7, 2], np.uint64)
    first, group = sd.firsts(h, second)
    assert sorted(first.tolist()) == [0, 1, 2] and first[group].tolist() == [0, 1, 2, 0, 2, 1]


def chunk_table(texts, number=1):
    n = len(texts)
    return pa.table({"chunk": pa.array([number] * n, pa.int64()), "row": pa.array(range(n), pa.int64()), "doc_id": pa.array(range(n), pa.int64()), "tie": pa.array([0] * n, pa.int64()), "text": pa.array(texts, pa.string())})


def test_nothing_goes_without_anchors():
    """Every repeat is found through an anchor, inside a chunk too."""
    p = " ".join(f"p{i}" for i in range(40))
    table, extend = chunk_table([p + " x " + p, p, p]), sd._extender(20, 1)
    none = pa.schema([("chunk", pa.int64()), ("keys", pa.binary())]).empty_table()
    assert extend((1,), table, none).num_rows == 0
    probes = sd._prober(20, 1)(table)
    hits = pa.Table.from_batches(list(sd._anchored(iter(probes.to_batches()))))
    found = extend((1,), table, hits)
    lost = pa.Table.from_batches(list(sd._beaten(iter(found.to_batches()))), schema=sd.LOST)
    more = [pa.field("n", pa.int64()), pa.field("words", pa.binary())]
    told = lost.append_column(more[0], pa.nulls(lost.num_rows, pa.int64())).append_column(more[1], pa.nulls(lost.num_rows, pa.binary()))
    assert sd._cut((1,), table, told).column("n_removed").to_pylist() == [40, 40, 40]
    assert sd._cut((1,), table, told.slice(0, 0)).column("n_removed").to_pylist() == [0, 0, 0]


def test_a_collision_stops_the_job():
    """Windows whose hashes agree are compared word by word, inside a chunk and between chunks."""
    p = " ".join(f"p{i}" for i in range(20))
    table = chunk_table([p, p, p.replace("p19", "q19"), p.replace("p0 ", "pp0 ")])
    c = sd.Chunk(table)
    sd._compare_inside(c, np.array([20]), np.array([0]))
    for other in (40, 60):
        with pytest.raises(ValueError, match="different words"):
            sd._compare_inside(c, np.array([other]), np.array([0]))
    schema = pa.schema([*sd.LOST, ("n", pa.int64()), ("words", pa.binary())])
    ask = lambda words: pa.table([pa.array([1], pa.int64()), *[pa.nulls(1, pa.binary())] * 3, pa.array([b"0"], pa.binary()), pa.array([20], pa.int64()), pa.array([words], pa.binary())], schema=schema)
    assert sd._cut((1,), table, ask(p.encode())).column("n_removed").to_pylist() == [0] * 4
    with pytest.raises(ValueError, match="different words"):
        sd._cut((1,), table, ask(p.replace("p7", "p8").encode()))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_rows_of_one_id_stand_in_the_order_of_their_texts(spark, monkeypatch, parts):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 400)
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"{p} {i}") for i in range(9)] + [(None, p), (None, "x " + p)]
    got = run(spark, rows, parts)
    assert got == run(spark, rows, 5) and sum(r[2] == 0 for r in got) == 1


def test_null_texts_fill_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_ROWS", 50)
    table, _ = sd.chunked(spark.createDataFrame([(i, None, "x", 1) for i in range(400)], DOCS))
    assert table.groupBy("chunk").count().agg({"count": "max"}).first()[0] <= 50 and table.count() == 400
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
