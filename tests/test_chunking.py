"""Chunkers against byte-by-byte models written from their definitions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import DedupConfig
from chunkloom.operators import chunking as ck

P = ck.POLYNOMIAL


def residue(data):
    """The bytes as a polynomial over GF(2), modulo P, by long division."""
    v = int.from_bytes(bytes(data), "big")
    while v.bit_length() > 63:
        v ^= P << (v.bit_length() - 64)
    return v


def model_rabin(p, avg, low, high, kind):
    out = []
    while p:
        n = len(p)
        if n <= low:
            size = n
        else:
            end, i, backup, size = min(n, high), low, 0, None
            while i < end:
                r = residue(p[max(low - 1, i - 48) : i])
                if kind == "rabin":
                    hit = r & (avg - 1) == 0x78
                elif kind == "normalized rabin":
                    hit = r & ((avg * 2 - 1) if i < avg else (avg // 2 - 1)) == 0x78
                else:
                    hit = False
                    if r & (avg // 2 - 1) == 0x78:
                        if r & (avg - 1) == 0x78:
                            hit = True
                        else:
                            backup = i
                if hit:
                    size = i
                    break
                i += 1
            if size is None:
                size = backup or i
        out.append(size)
        p = p[size:]
    return out


def model_ae(p, avg, high):
    window, out = int(avg / (2.718281828 - 1)), []
    while p:
        n, size = len(p), None
        if n > window + 8:
            best = 0
            for i in range(1, n - 8 + 1):
                if p[i : i + 8] <= p[best : best + 8]:
                    best = i
                    continue
                if i == best + window or i == high:
                    size = i
                    break
        size = size or n
        out.append(size)
        p = p[size:]
    return out


def texts():
    rng = random.Random(4)
    yield b""
    yield b"a"
    for n in (63, 64, 65, 1023, 1024, 1025, 4096):
        yield rng.randbytes(n)
    yield bytes(5000)
    yield b"\x07" * 3000
    yield rng.randbytes(20_000)
    yield bytes(rng.choice(b"ab") for _ in range(6000))
    yield bytes(range(256))[::-1] * 8


@pytest.mark.parametrize("kind", ["rabin", "normalized rabin", "tttd"])
@pytest.mark.parametrize("avg,low,high", [(256, 64, 1024), (512, 10, 600), (128, 64, 500), (1024, 1, 2000)])
def test_rabin_family(kind, avg, low, high):
    for data in texts():
        if len(data) > 6000 and low != 64:
            continue
        assert ck.rabin_lengths(np.frombuffer(data, np.uint8), avg, low, high, kind) == model_rabin(data, avg, low, high, kind)


@pytest.mark.parametrize("avg,high", [(64, 200), (512, 1000), (512, 300), (100, 5000)])
def test_ae(avg, high):
    for data in texts():
        assert ck.ae_lengths(np.frombuffer(data, np.uint8), avg, high) == model_ae(data, avg, high)


def test_extremum_windows():
    assert (ck.extremum_window(4096), ck.extremum_window(8192)) == (2383, 4767)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["fixed", "rabin", "normalized rabin", "tttd", "ae", "file"]))
def test_chunks_make_up_the_file(data, kind):
    cfg = DedupConfig(chunk_algorithm=kind, chunk_avg_size=256, chunk_min_size=64, chunk_max_size=1024).resolved()
    sizes = ck.chunk_lengths(data, cfg)
    assert sum(sizes) == len(data) and all(s > 0 for s in sizes)
    if kind in ("rabin", "normalized rabin", "tttd"):
        assert all(s <= 1024 for s in sizes) and all(s >= 64 for s in sizes[:-1])


def test_an_insertion_moves_few_cuts():
    data = random.Random(1).randbytes(200_000)
    for kind in ("rabin", "normalized rabin", "tttd", "ae"):
        cfg = DedupConfig(chunk_algorithm=kind, chunk_avg_size=1024, chunk_min_size=256, chunk_max_size=8192)

        def parts(d, cfg=cfg):
            at, out = 0, set()
            for s in ck.chunk_lengths(d, cfg):
                out.add(d[at : at + s])
                at += s
            return out

        a, b = parts(data), parts(data[:70_000] + b"!" + data[70_000:])
        assert len(b - a) <= 6


def test_chunk_tables(spark):
    content = [(0, 0, b"x" * 150), (0, 1, b""), (0, 2, b"y" * 64), (1, 0, random.Random(2).randbytes(5000))]
    files = spark.createDataFrame([(v, n, f"f{n}", c) for v, n, c in content], "bv int, file_no bigint, filename string, content binary")
    for cfg in (DedupConfig(chunk_algorithm="fixed", chunk_avg_size=64), DedupConfig(chunk_algorithm="rabin", chunk_avg_size=256, chunk_min_size=64, chunk_max_size=1024), DedupConfig(chunk_algorithm="file")):
        rows = ck.with_seq(ck.chunks(files, cfg, with_data=True)).orderBy("bv", "seq").collect()
        for v in (0, 1):
            own = [r for r in rows if r.bv == v]
            assert [r.seq for r in own] == list(range(len(own)))
            assert b"".join(bytes(r.data) for r in own) == b"".join(c for w, _, c in content if w == v)
        assert all(bytes(r.fp) == hashlib.sha1(bytes(r.data)).digest() and r.size == len(r.data) for r in rows)
