"""Restore simulations over runs read what the policies read chunk by chunk."""

import random

import numpy as np
import pytest

from chunkloom.plans import restore


def recipes(seed, several):
    """Versions over shared containers: long stretches of one container, returns, sizes that differ, and (if asked for) fingerprints that moved to other containers."""
    rng = random.Random(seed)
    place = {i.to_bytes(20, "big"): (i // 30, 20 if i % 7 else 1 + i % 50) for i in range(900)}
    out = []
    for bv in range(4):
        seq = 0
        for _ in range(25):
            at = rng.randrange(860)
            for i in range(at, at + rng.choice((1, 3, 20, 40))):
                fp = i.to_bytes(20, "big")
                cid, size = place[fp]
                if several and rng.random() < 0.1:
                    place[fp] = cid, size = rng.randrange(40), size
                out.append((bv, seq, fp, size, cid))
                seq += 1
    return out


POLICIES = [(p, n) for p in ("lru", "opt", "asm") for n in (0, 1, 2, 4, 8)]


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("window,area", [(1_000_000, 300), (10, 4000), (40, 7)])
def test_runs_read_what_chunks_read(spark, several, window, area):
    rows = recipes(window + area, several)
    content: dict[int, set[bytes]] = {}
    for _, _, fp, _, cid in rows:
        content.setdefault(cid, set()).add(fp)
    want = {}
    for bv in range(4):
        own = [(fp, size, cid) for v, _, fp, size, cid in rows if v == bv]
        for p, n in POLICIES:
            want[bv, p, n] = (restore.lru_reads(own, content, n) if p == "lru" else restore.optimal_reads(own, content, n, window) if p == "opt" else restore.assembly_reads(own, content, n, area), len(own), sum(s for _, s, _ in own))
    frame = spark.createDataFrame([("a", *r) for r in rows], "config string, bv int, seq bigint, fp binary, size int, cid bigint").repartition(5)
    got = {(r.bv, r.policy, r.cache_size): (r.read_containers, r.chunk_num, r.data_size) for r in restore.simulate(frame, POLICIES, window, area).collect()}
    assert got == want
    one = {(r.bv, r.policy, r.cache_size): (r.read_containers, r.chunk_num, r.data_size) for r in restore.simulate(frame, POLICIES, window, area, only=2).collect()}
    assert one == {k: v for k, v in want.items() if k[0] == 2}


def test_a_stretch_of_one_container_is_a_run():
    """A million chunks behind one another hold a handful of numbers and are stepped over, whatever the policy."""
    runs = restore.Runs()
    runs.add(np.array([1, 2, 1]), np.array([64, 64, 64]), np.array([400_000, 200_000, 400_000]))
    assert len(runs.cids) == 3
    assert (runs.lru(1), runs.optimal(1, 100), runs.assembly(2, 64 * 700_000)) == (3, 3, 3)
    assert runs.assembly(2, 64 * 1_000_000) == 2
