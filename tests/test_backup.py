"""The fold's invariants under every configuration, and simulations against plain models."""

import random
from dataclasses import replace
from itertools import accumulate, permutations

import pytest

from chunkloom.config import SMALL, DedupConfig
from chunkloom.plans import backup as bk
from chunkloom.plans import folds, restore

rng = random.Random(11)


def stream(versions=6, n=400, seed=1):
    """Versions that change a little: copies, moves, new chunks, repeats."""
    rng = random.Random(seed)
    fps = [rng.randbytes(20) for _ in range(n)]
    for v in range(versions):
        for i, fp in enumerate(fps):
            yield v, i, i // 25, fp, 20 + fp[0] % 60
        for _ in range(n // 12):
            at, kind = rng.randrange(len(fps)), rng.random()
            if kind < 0.4:
                fps[at] = rng.randbytes(20)
            elif kind < 0.6:
                fps.insert(at, fps[rng.randrange(len(fps))])
            elif kind < 0.8:
                del fps[at]
            else:
                fps.insert(at, bytes(20))


TINY = replace(SMALL, container_data=2000, container_entries=40, segment_average=32, segment_min=4, segment_max=64, index_cache_size=4, rewrite_buffer=48, restore_cache_size=3, sampling_ratio=4)
CONFIGS = {
    **{f"preset {k}": replace(TINY, index_preset=k) for k in folds.PRESETS},
    **{f"rewrite {k}": replace(v, container_data=2000, container_entries=40, rewrite_buffer=48, restore_cache_size=3) for k, v in folds.rewriters().items()},
    "mix": replace(TINY, index_logical=True, selection="mix", selection_top=2, sampling_method="optmin", prefetching=3),
    "base": replace(TINY, index_logical=True, selection="base", segment_algorithm="content-defined", segment_average=16),
    "short keys": replace(TINY, index_exact=True, sampling_ratio=1, index_key_size=2),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_invariants(name):
    cfg = CONFIGS[name]
    rows = list(stream())
    held: dict[int, dict[bytes, int]] = {}
    exact = set()
    for stats, chunks, _ in bk.replay(rows, cfg):
        for c in chunks:
            assert c.cid is not None
            if c.written:
                held.setdefault(c.cid, {})[c.fp] = c.size
        # every chunk can be read where the recipe says
        assert all(c.fp in held[c.cid] for c in chunks)
        assert stats["number_of_chunks"] == len(chunks) and stats["data_size"] == sum(c.size for c in chunks)
        exact |= {c.fp for c in chunks}
    assert all(sum(x.values()) <= 2000 and len(x) <= 40 for x in held.values())
    total = sum(sum(x.values()) for x in held.values())
    least = sum(20 + fp[0] % 60 for fp in exact)
    assert total >= least
    if cfg.resolved().index_exact and cfg.rewrite_algorithm == "no" and not cfg.har and cfg.index_key_size == 20:
        assert total == least


def test_rewriting_lessens_reads():
    none, har = (list(bk.replay(stream(12, 600), CONFIGS[f"rewrite {k}"])) for k in ("none", "har"))
    reads = lambda jobs: len({c.cid for c in jobs[-1][1]})
    assert reads(har) <= reads(none)
    assert sum(s["rewritten_chunks"] for s, _, _ in har) > 0 == sum(s["rewritten_chunks"] for s, _, _ in none)


def test_deletion_keeps_what_lives():
    cfg = replace(CONFIGS["preset ddfs"], retention=2)
    jobs = list(bk.replay(stream(8), cfg))
    lost = {c for _, _, gone in jobs if gone for c in gone["reclaimed"]}
    for _, chunks, _ in jobs[-2:]:
        assert not lost & {c.cid for c in chunks}
    assert [g["bv"] for _, _, g in jobs if g] == list(range(6))
    assert not any(g for _, _, g in bk.replay(stream(8), replace(cfg, retention=-1)))
    assert all(g is None for _, _, g in bk.replay(stream(8), replace(cfg, retention=8)))


def test_capping_keeps_the_fullest():
    chunks = [bk.Chunk(i, 0, bytes([i]), s, cid=c, is_dup=True) for i, (c, s) in enumerate([(1, 5), (2, 9), (3, 5), (1, 1), (4, 2)])]
    bk.marked(chunks, bk.Capping(5, 2))
    assert [c.is_ooo for c in chunks] == [False, False, True, False, True]
    again = [replace(c, is_ooo=False) for c in chunks]
    bk.marked(again, bk.Capping(5, 9))
    assert not any(c.is_ooo for c in again)


def test_islands():
    make = lambda *cids: [bk.Chunk(i, 0, b"", 10, cid=c, is_dup=c is not None) for i, c in enumerate(cids)]
    a = make(None, 1, 1, 1, 2, None, 1)
    bk.marked(a, bk.Islands(100, 35))
    # new, 1, 1, 1 are an island of 40; 2 alone; new and 1 another
    assert [c.is_ooo for c in a] == [False, False, False, False, True, False, True]
    b = make(1, 1, 1, 1)
    bk.marked(b, bk.Islands(2, 25))  # the buffer's end cuts
    assert all(c.is_ooo for c in b)


def test_context_rewriting_spares_well_used_containers():
    chunks = [bk.Chunk(i, 0, b"", 100, cid=1 if i % 10 else 2, is_dup=True) for i in range(600)]
    bk.marked(chunks, bk.Context(50, 0.3, 0.2, 4000))
    assert not any(c.is_ooo for c in chunks if c.cid == 1)
    assert any(c.is_ooo for c in chunks if c.cid == 2)
    assert not any(c.is_ooo for c in chunks[-49:])


def literal_marks(stream, cfg):
    """The three algorithms written out over one buffer a version, with every list recomputed at each step. stream: (known container or None, size, file, segment)."""
    n, marks = cfg.rewrite_buffer, [False] * len(stream)
    if cfg.rewrite_algorithm == "cap":
        for b in range(0, len(stream), n):
            part = range(b, min(b + n, len(stream)))
            use = {c: sum(stream[i][1] for i in part if stream[i][0] == c) for c in {stream[i][0] for i in part} - {None}}
            top = sorted(use, key=lambda c: (-use[c], c))[: cfg.capping_level]
            for i in part:
                marks[i] = stream[i][0] is not None and stream[i][0] not in top
    elif cfg.rewrite_algorithm == "cfl":
        island = []
        for i in [*range(len(stream)), None]:
            if island:
                last, now = stream[island[-1]], stream[i] if i is not None else None
                if now is None or last[0] is not None and (now[0] != last[0] or now[2:] != last[2:]) or len(island) >= n:
                    if sum(stream[j][1] for j in island) < cfg.cfl_usage_threshold * cfg.container_data:
                        for j in island:
                            marks[j] = stream[j][0] is not None
                    island = []
            island.append(i)
    else:
        buckets, keep, threshold = [0] * 10_000, {}, cfg.cbr_minimal_utility
        lowest = min(int(cfg.cbr_minimal_utility * 10_000), 9_999)
        for i in range(len(stream) - n + 1):
            ahead = stream[i : i + n]
            keep = {c: k for c, k in keep.items() if any(x[0] == c for x in ahead[:-1])}  # forgotten when its last chunk leaves
            c, utility = ahead[0][0], 0.0
            if c is not None and not keep.get(c):
                utility = max(0.0, 1 - (sum(x[1] for x in ahead if x[0] == c) + ahead[0][1]) / cfg.container_data)
                if utility < cfg.cbr_minimal_utility or utility < threshold:
                    keep[c] = True
                else:
                    marks[i] = True
            buckets[min(int(utility * 10_000), 9_999)] += 1
            if i + 1 >= 100:
                wanted = int((i + 1) * cfg.cbr_limit)
                upwards = list(accumulate(reversed(buckets)))  # chunks in the highest k + 1 buckets
                edges = [b for b in range(9_999, lowest - 1, -1) if upwards[9_999 - b] >= wanted][:1]
                threshold = (edges[0] + 1 if edges else lowest) / 10_000
    return marks


@pytest.mark.parametrize("algorithm", ["cap", "cfl", "cbr"])
@pytest.mark.parametrize("segment,buffer", [(16, 48), (48, 48), (100, 48), (1000, 48), (32, 7)])
def test_rewriting_has_one_buffer_a_version(monkeypatch, algorithm, segment, buffer):
    cfg = replace(TINY, index_preset="ddfs", segment_average=segment, rewrite_buffer=buffer, rewrite_algorithm=algorithm, capping_level=2, cfl_usage_threshold=0.1, cbr_limit=0.05, cbr_minimal_utility=0.2)
    seen = []
    for kind in (bk.Rewriter, bk.Islands):
        def push(self, c, push=kind.push):
            seen[-1].append((c, (c.cid if c.is_dup else None, c.size, c.file_no, c.segment_no)))
            return push(self, c)

        monkeypatch.setattr(kind, "push", push)
    of = bk.rewriter_of
    monkeypatch.setattr(bk, "rewriter_of", lambda *a: (seen.append([]), of(*a))[1])
    some = 0
    for _, chunks, _ in bk.replay(stream(5, 300), cfg):
        assert [c for c, _ in seen[-1]] == chunks
        got = [c.is_ooo for c, _ in seen[-1]]
        assert got == literal_marks([x for _, x in seen[-1]], cfg)
        some += sum(got)
    assert some


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_caches_against_models(size):
    keys = [rng.randrange(7) for _ in range(300)]
    held, misses = [], 0
    for k in keys:
        if k in held:
            held.remove(k)
        else:
            misses += 1
            del held[: max(len(held) - size + 1, 0)]
        held.append(k)
    assert restore.lru_misses(keys, size) == misses
    assert restore.optimal_misses(keys, size) <= misses


def test_optimal_is_optimal():
    def fewest(keys, size):
        best = {frozenset(): 0}
        for k in keys:
            nxt = {}
            for held, cost in best.items():
                if k in held:
                    options = [held]
                elif len(held) < size:
                    options = [held | {k}]
                else:
                    options = [held - {x} | {k} for x in held]
                for o in options:
                    c = cost + (k not in held)
                    nxt[o] = min(nxt.get(o, 1 << 30), c)
            best = nxt
        return min(best.values())

    for _ in range(30):
        keys = [rng.randrange(5) for _ in range(25)]
        assert restore.optimal_misses(keys, 2) == fewest(keys, 2)
        recipe = [(bytes([k]), 1, k) for k in keys]
        content = {k: {bytes([k])} for k in range(5)}
        assert restore.optimal_reads(recipe, content, 2, 10_000) == fewest(keys, 2)
        assert restore.lru_reads(recipe, content, 2) == restore.lru_misses(keys, 2) >= fewest(keys, 2)


def test_hits_by_fingerprint():
    """A chunk that any cached container holds needs no read, whatever its recipe says."""
    content = {1: {b"a", b"b"}, 2: {b"a", b"c"}}
    recipe = [(b"b", 1, 1), (b"a", 1, 2), (b"c", 1, 2)]
    assert restore.lru_reads(recipe, content, 2) == 2
    assert restore.lru_reads(recipe[:2], content, 2) == 1


def test_forward_assembly():
    content = {1: {b"a", b"c"}, 2: {b"b"}}
    recipe = [(b"a", 10, 1), (b"b", 10, 2), (b"c", 10, 1)]
    assert restore.assembly_reads(recipe, content, 4, area=10) == 2
    assert restore.assembly_reads(recipe, content, 2, area=10) == 3
    assert restore.assembly_reads([], content, 2, area=10) == 0


@pytest.mark.parametrize("order", list(permutations(["cap", "har", "none"]))[:2])
def test_a_sweep_equals_single_runs(spark, order):
    rows = list(stream(3, 120))
    frame = spark.createDataFrame(rows, "bv int, seq bigint, file_no bigint, fp binary, size int").repartition(5)
    configs = {k: CONFIGS[f"rewrite {k}"] for k in order}
    got = {(r.config, r.bv): (r.unique_size, r.rewritten_size) for r in bk.job_stats(frame, configs).collect()}
    for k, cfg in configs.items():
        for s, _, _ in bk.replay(rows, cfg):
            assert got[k, s["bv"]] == (s["unique_size"], s["rewritten_size"])


def test_sampling_matches_the_relational_form(spark):
    from chunkloom.operators import sampling

    fps = [rng.randbytes(20) for _ in range(37)]
    fps[5] = fps[9]
    frame = spark.createDataFrame([(0, 0, i, f) for i, f in enumerate(fps)], "bv int, segment_no bigint, seq bigint, fp binary")
    for method in ("random", "uniform", "min", "optmin"):
        for ratio in (0, 1, 4, 10, 100):
            cfg = DedupConfig(sampling_method=method, sampling_ratio=ratio)
            got = sorted(bytes(r.feature) for r in sampling.features(frame, ["bv", "segment_no"], cfg).collect())
            assert got == bk.sample(fps, method, ratio, 20), (method, ratio)
