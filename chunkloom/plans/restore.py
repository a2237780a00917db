"""Restore simulations: how many containers a cache policy reads for a version, from recipes (seq, fp, size, cid).

A fingerprint that was only ever located in one container is a hit if that container is cached: its chunks need no fingerprint, and those of one container and size that lie behind one
another are one run. Only chunks that several containers hold bring the list of these. ``lru_reads``, ``optimal_reads`` and ``assembly_reads`` say chunk by chunk what the policies do;
``simulate`` asks the same of runs, which tests hold to them.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import written

AREA = 4 * 1024 * 1024


def lru_reads(recipe: list[tuple[bytes, int, int]], content: dict[int, set[bytes]], size: int) -> int:
    """Least recently used containers; a chunk is a hit if any cached container holds its fingerprint."""
    cache: OrderedDict[int, None] = OrderedDict()
    where: dict[bytes, set[int]] = {}
    reads = 0
    for fp, _, cid in recipe:
        held = where.get(fp)
        if held:
            cache.move_to_end(cid if cid in held else max(held, key=lambda c: c))
            continue
        reads += 1
        if 0 < size <= len(cache):
            gone, _ = cache.popitem(last=False)
            for f in content[gone]:
                where[f].discard(gone)
        cache[cid] = None
        for f in content[cid]:
            where.setdefault(f, set()).add(cid)
    return reads


def optimal_reads(recipe: list[tuple[bytes, int, int]], content: dict[int, set[bytes]], size: int, window: int) -> int:
    """Belady's choice over the next ``window`` access records, refilled when half of them are used: the container asked for last leaves; of those not asked for in sight the least recently used."""
    records = [cid for i, (_, _, cid) in enumerate(recipe) if not i or recipe[i - 1][2] != cid]
    uses: dict[int, list[int]] = {}
    for i, cid in enumerate(records):
        uses.setdefault(cid, []).append(i)
    pointer = dict.fromkeys(uses, 0)
    cache: OrderedDict[int, None] = OrderedDict()
    where: dict[bytes, int] = {}
    reads, at, seen = 0, -1, window
    last = None
    for fp, _, cid in recipe:
        if cid != last:
            at, last = at + 1, cid
            if at >= seen - window // 2:
                seen = at + window
        if cid in cache:
            cache.move_to_end(cid)
            continue
        if where.get(fp, 0) > 0:
            continue
        reads += 1
        if 0 < size <= len(cache):
            def following(c: int) -> int:
                u = uses[c]
                while pointer[c] < len(u) and u[pointer[c]] <= at:
                    pointer[c] += 1
                n = u[pointer[c]] if pointer[c] < len(u) else 1 << 62
                return n if n < seen else 1 << 62

            gone = max(cache, key=following)  # the first of equals is the least recently used
            del cache[gone]
            for f in content[gone]:
                where[f] -= 1
        cache[cid] = None
        for f in content[cid]:
            where[f] = where.get(f, 0) + 1
    return reads


def assembly_reads(recipe: list[tuple[bytes, int, int]], content: dict[int, set[bytes]], size: int, area: int = AREA) -> int:
    """Forward assembly: an area of (size - 1) containers' bytes is filled from the recipe; the container of its first missing chunk is read and gives all its chunks of the area; the ready prefix leaves."""
    room = max(size - 1, 1) * area
    reads, used, head, tail, n = 0, 0, 0, 0, len(recipe)
    ready = bytearray(n)
    waiting: dict[int, list[int]] = {}  # by the container that a recipe names
    by_fp: dict[bytes, list[int]] = {}
    while head < n:
        while tail < n and (used + recipe[tail][1] <= room or tail == head):
            by_fp.setdefault(recipe[tail][0], []).append(tail)
            used += recipe[tail][1]
            tail += 1
        if not ready[head]:
            reads += 1
            cid = recipe[head][2]
            for f in content[cid] & by_fp.keys() if len(content[cid]) < len(by_fp) else [f for f in by_fp if f in content[cid]]:
                for i in by_fp.pop(f):
                    ready[i] = 1
        while head < tail and ready[head]:
            used -= recipe[head][1]
            head += 1
    return reads


class Runs:
    """A version's chunks as (container, bytes of a chunk, chunks); ``others`` has the containers of a run whose fingerprint lies in several."""

    def __init__(self) -> None:
        self.cids, self.sizes, self.counts = array("q"), array("q"), array("q")
        self.others: dict[int, list[int]] = {}

    def add(self, cids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, others: Iterable[tuple[int, list[int]]] = ()) -> None:
        base = len(self.cids)
        for mine, new in ((self.cids, cids), (self.sizes, sizes), (self.counts, counts)):
            mine.frombytes(np.ascontiguousarray(new, np.int64).tobytes())
        self.others.update((base + i, held) for i, held in others)

    def lru(self, size: int) -> int:
        cache: OrderedDict[int, None] = OrderedDict()
        reads, others = 0, self.others
        for i, cid in enumerate(self.cids):
            if cid in cache:
                cache.move_to_end(cid)
                continue
            if i in others:
                held = [c for c in others[i] if c in cache]
                if held:
                    cache.move_to_end(max(held))
                    continue
            reads += 1
            if 0 < size <= len(cache):
                cache.popitem(last=False)
            cache[cid] = None
        return reads

    def optimal(self, size: int, window: int) -> int:
        cids = np.frombuffer(self.cids, np.int64) if self.cids else np.zeros(0, np.int64)
        records = cids[np.concatenate([[True], cids[1:] != cids[:-1]])] if len(cids) else cids
        never = 1 << 62
        following = np.full(len(records), never, np.int64)  # the record that asks for the same container again
        order = np.argsort(records, kind="stable")
        same = records[order[1:]] == records[order[:-1]]
        following[order[:-1][same]] = order[1:][same]
        following = array("q", following.tobytes())
        cache: OrderedDict[int, None] = OrderedDict()
        latest: dict[int, int] = {}
        reads, at, seen, last, others = 0, -1, window, None, self.others
        for i, cid in enumerate(self.cids):
            if cid != last:
                at, last = at + 1, cid
                latest[cid] = at
                if at >= seen - window // 2:
                    seen = at + window
            if cid in cache:
                cache.move_to_end(cid)
                continue
            if i in others and any(c in cache for c in others[i]):
                continue
            reads += 1
            if 0 < size <= len(cache):
                gone, far = None, -1
                for c in cache:  # the first of equals is the least recently used
                    n = following[latest[c]]
                    n = n if n < seen else never
                    if n > far:
                        gone, far = c, n
                del cache[gone]
            cache[cid] = None
        return reads

    def assembly(self, size: int, area: int) -> int:
        """A chunk is ready if it lay in the area when a container that holds it was last read: ``upto`` keeps where the area ended then."""
        room, n = max(size - 1, 1) * area, len(self.cids)
        counts, sizes = (np.frombuffer(x, np.int64) if n else np.zeros(0, np.int64) for x in (self.counts, self.sizes))
        chunks, before = (array("q", np.concatenate([[0], np.cumsum(x)]).astype(np.int64).tobytes()) for x in (counts, counts * sizes))  # ahead of each run
        upto: dict[int, int] = {}
        reads = head = tail = r = 0
        while r < n:
            start = before[r] + (head - chunks[r]) * self.sizes[r]
            k = bisect_right(before, start + room, r, n + 1) - 1  # the run in which the area ends
            end = chunks[k] if k == n else chunks[k] + (min((start + room - before[k]) // self.sizes[k], self.counts[k]) if self.sizes[k] else self.counts[k])
            tail = max(tail, end, head + 1)
            reads += 1
            upto[self.cids[r]] = tail
            while r < n:
                ready = max(upto.get(c, 0) for c in self.others[r]) if r in self.others else upto.get(self.cids[r], 0)
                head = max(head, min(chunks[r + 1], tail, ready))
                if head < chunks[r + 1]:
                    break
                r += 1
        return reads


SCHEMA = "config string, bv int, policy string, cache_size int, data_size bigint, chunk_num bigint, read_containers bigint, speed_factor double"


def simulate(recipes: DataFrame, policies: list[tuple[str, int]], window: int = 1_000_000, area: int = AREA, only: int | None = None, exact: bool = False) -> DataFrame:
    """(.., policy, cache size, containers read, MiB a container) for each version of recipes (config, bv, seq, fp, size, cid).

    What a container holds is taken from all recipes of the configuration: the chunks that were ever located there. ``only`` one version may be simulated; the others then only
    say what its containers hold. ``exact`` recipes name one container a fingerprint by their making, so that none has to be looked for.
    """
    spark = recipes.sparkSession
    asked_for = recipes if only is None else recipes.where(F.col("bv") == only)
    if exact:
        stream = asked_for.withColumn("others", F.lit(None))
    else:
        # written on their way: they are few or none, often small enough to be sent instead of the recipes
        places = recipes.groupBy("config", "fp").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b")
        places = written(places.select(F.col("config").alias("__config"), F.col("fp").alias("__fp")), "places")
        several = (F.col("config") == F.col("__config")) & (F.col("fp") == F.col("__fp"))
        held = recipes.join(places, several, "left_semi").groupBy("config", "fp").agg(F.collect_set("cid").alias("others"))
        held = written(held.select(F.col("config").alias("__config"), F.col("fp").alias("__fp"), "others"), "places")
        stream = asked_for.join(held, several, "left")
    stream = stream.select("config", F.col("bv").cast("int").alias("bv"), F.col("seq").cast("bigint").alias("seq"), F.col("size").cast("bigint").alias("size"), F.col("cid").cast("bigint").alias("cid"), F.col("others").cast("array<bigint>").alias("others"))
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def simulated(key: tuple, runs: Runs) -> pa.RecordBatch:
        counts, sizes = np.frombuffer(runs.counts, np.int64), np.frombuffer(runs.sizes, np.int64)
        data, rows = int((counts * sizes).sum()), []
        for policy, size in policies:
            reads = runs.lru(size) if policy == "lru" else runs.optimal(size, window) if policy == "opt" else runs.assembly(size, area)
            rows.append((*key, policy, size, data, int(counts.sum()), reads, data / (1048576.0 * reads) if reads else None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, Runs()
        for b in batches:
            n = len(b)
            if not n:
                continue
            config, others = b.column("config"), b.column("others")
            bv, cid, size = (b.column(c).to_numpy() for c in ("bv", "cid", "size"))
            several = others.is_valid().to_numpy(zero_copy_only=False)
            moved, new = np.zeros(n, bool), np.ones(n, bool)
            moved[1:] = (bv[1:] != bv[:-1]) | pc.not_equal(config.slice(1), config.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = moved[1:] | (cid[1:] != cid[:-1]) | (size[1:] != size[:-1]) | several[1:] | several[:-1]
            at = np.flatnonzero(new)
            counts = np.diff(at, append=n)
            cuts = [0, *np.flatnonzero(moved).tolist(), n]
            for i, j in zip(cuts, cuts[1:], strict=False):
                now = (config[i].as_py(), int(bv[i]))
                if key is not None and now != key:
                    yield simulated(key, runs)
                    runs = Runs()
                key = now
                own = slice(*np.searchsorted(at, [i, j]))
                mine = at[own]
                runs.add(cid[mine], size[mine], counts[own], [(k, others[int(mine[k])].as_py()) for k in np.flatnonzero(several[mine]).tolist()])
        if key is not None:
            yield simulated(key, runs)

    dealt = stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "config", "bv").sortWithinPartitions("config", "bv", "seq")
    return dealt.select("config", "bv", "size", "cid", "others").mapInArrow(run, SCHEMA)


def lru_misses(keys: Iterable, size: int) -> int:
    """Misses of a plain cache of ``size`` units: an access misses if as many others or more came since its last one."""
    cache: OrderedDict = OrderedDict()
    misses = 0
    for k in keys:
        if k in cache:
            cache.move_to_end(k)
            continue
        misses += 1
        if 0 < size <= len(cache):
            cache.popitem(last=False)
        cache[k] = None
    return misses


def optimal_misses(keys: list, size: int) -> int:
    """The fewest misses possible, by the farthest next use."""
    nxt, last = [0] * len(keys), {}
    for i in range(len(keys) - 1, -1, -1):
        nxt[i] = last.get(keys[i], 1 << 62)
        last[keys[i]] = i
    held: dict = {}
    heap: list = []
    misses = 0
    for i, k in enumerate(keys):
        if k not in held:
            misses += 1
            while len(held) >= size > 0:
                far, old = heapq.heappop(heap)
                if held.get(old) == -far:
                    del held[old]
        held[k] = nxt[i]
        heapq.heappush(heap, (-nxt[i], k))
    return misses
