"""Substring dedup: fixed-block anchors find exact repeats of at least ``WINDOW`` words, across and inside documents.

Words are runs of bytes other than the six ASCII separators. A window is 20 consecutive words of a document. A word goes if a window covers it
whose word sequence also starts earlier (smaller id; in the same document at an earlier word).

The texts are copied once into a table of chunks (some MB and at most ``CHUNK_ROWS`` rows each), bucketed by chunk, so that every later pass reads a chunk where it lies; between the passes
only packed arrays are shuffled, a row for each chunk and bucket of the hash space, and the words that are compared.

1. Index and probe. The non-overlapping reference blocks of ``BLOCK`` = 10 words of every document are the anchors; every rolling run of 10 words of every document
   probes them. Any 20-word window holds a whole reference block of the document it stands in, so each repeat hits an anchor. Chunks send their distinct runs
   (shortened to log2(words) + 13 bits, sorted, as differences), marked where a reference block lies; a bucket answers each chunk which of its runs are
   anchors that also stand elsewhere, in other chunks or in this one. Shortened runs may hit falsely; nothing is decided here.
2. Extend. The windows around a chunk's hits, up to a whole window on both sides, are the candidates; no other window is looked at. Of equal candidates in a chunk the first is found by two
   hashes (96 bits), and the words of the others are compared with its words. The chunk sends each distinct candidate once, with the place where it first stands; a bucket finds the first
   place of all and tells the chunks whose own first place is not it where that is.
3. Compare. Windows whose first places follow one another as they do themselves join to maximal runs. Each run's words go to the chunk that holds their first place (once for each map
   task, however many chunks have the run), and are compared there, word by word, while that chunk is cut. A difference would be a collision of 96 bits: it stops the job, and nothing wrong comes out.
4. Cut. The words that the repeating windows cover go.

A passage that every document shares costs one entry a chunk in the shuffles, not one an occurrence.

Defined results: null and empty texts have no words and an empty remainder; texts under 20 words never lose a word; a null id counts as larger than all others; rows of the same id stand
in the order of a hash of their texts (of equal rows one keeps its words), whatever the partitioning; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_limit, large_binary, shared_dir, slices, written
from .textkit import SECOND_BASE, U, Words, covered, windows

WINDOW = 20
BLOCK = 10
#: Bytes of text (a longer document is a chunk of its own) and rows in a chunk, hashes that one bucket holds on average, bytes that are compared at once.
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 15
BUCKET_HASHES = 1 << 21
COMPARED = 1 << 20
LAST = np.int64((1 << 63) - 1)


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values as differences, byte plane by byte plane (high planes are mostly zero and compress away)."""
    if not len(values):
        return b""
    return planes(np.diff(values, prepend=U(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=U)


def planes(values: np.ndarray) -> bytes:
    """Values of 4 or 8 bytes, all lowest bytes first."""
    n = values.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, n).T).tobytes()


def unplanes(raw: bytes, kind: type = U) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, -1).T).view(kind).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def firsts(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair, in the order of the pairs, and the number of its pair for each place."""
    order = np.argsort(h, kind="stable")
    a = h[order]
    tied = np.flatnonzero((a[1:] == a[:-1]) & (second[order][1:] != second[order][:-1]))
    if len(tied):  # one hash, two texts: the second tells them apart
        order = np.lexsort((np.arange(len(h)), second, h))
        a = h[order]
    b = second[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def bounds_of(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Chunk:
    """Words of a chunk's documents, in the order of (id, hash of the text where ids repeat, row)."""

    def __init__(self, table: pa.Table, hashed: bool = True):
        ids = table.column("doc_id").combine_chunks()
        self.void = np.asarray(ids.is_null())
        ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        row, tie = table.column("row").to_numpy(), table.column("tie").to_numpy()
        self.order = np.lexsort((row, tie, self.void, ids))
        self.ids, self.tie, self.void = ids[self.order], tie[self.order], self.void[self.order]
        self.texts = large_binary(table.column("text")).take(pa.array(self.order))
        parts, counts, starts, ends, data, base = [], [], [], [], [], 0
        for _, _, own, offsets in slices(self.texts):
            w = Words(own, offsets)
            if hashed:
                parts.append(w.hashes())
            counts.append(np.diff(w.first))
            starts.append(w.start + base)
            ends.append(w.end + base)
            data.append(own)
            base += len(own)
        none = np.zeros(0, np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, U)
        self.count = np.concatenate(counts) if counts else none
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.start, self.end = (np.concatenate(x) if x else none for x in (starts, ends))
        self.data = np.concatenate(data) if data else np.zeros(0, np.uint8)

    def same_words(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the words numbered a equal those numbered b, byte by byte."""
        size = self.end[a] - self.start[a]
        if (size != self.end[b] - self.start[b]).any():
            return False
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + COMPARED, COMPARED))
        for i, j in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1), strict=True):
            x, y = self.start[a[i:j]], self.start[b[i:j]]
            if (self.data[_ranges(x, x + size[i:j])] != self.data[_ranges(y, y + size[i:j])]).any():
                return False
        return True

    def text_of(self, word: int, n: int) -> bytes:
        """Words ``word`` to ``word + n``, joined by one space."""
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[word : word + n].tolist(), self.end[word : word + n].tolist(), strict=True)])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.words, self.doc, size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, half of a second hash) of every window."""
        at, h = self.runs(WINDOW)
        return at, h, (windows(self.words, self.doc, WINDOW, SECOND_BASE)[1] >> U(32)).astype(np.uint32)

    def anchors(self, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, shortened hash, whether a reference block) of runs of BLOCK words in documents of WINDOW words or more."""
        at, key = self.runs(BLOCK)
        long = self.count[self.doc[at]] >= WINDOW
        at, key = at[long], key[long]
        return at, key >> U(shift), (at - self.first[self.doc[at]]) % BLOCK == 0

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Places of the windows that hold one of the runs at ``at``."""
        low = np.maximum(at - (WINDOW - BLOCK), self.first[self.doc[at]])
        high = np.minimum(at, self.first[self.doc[at] + 1] - WINDOW)
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, low, 1)
        np.add.at(marks, high + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def _cut_rows(chunk: int, buckets: np.ndarray, columns: dict[str, np.ndarray], pack_keys: bool) -> dict[str, list]:
    """Columns (in the order of buckets) cut to a row a bucket; wide values go plane by plane, so that what hardly changes compresses away."""
    b = bounds_of(buckets)
    cut = list(zip(b[:-1].tolist(), b[1:].tolist(), strict=True))
    out: dict[str, list] = {"bucket": [int(buckets[s]) for s, _ in cut], "chunk": [chunk] * len(cut)}
    for name, x in columns.items():
        write = pack if pack_keys and name == "keys" else planes if x.itemsize > 1 else np.ndarray.tobytes
        out[name] = [write(x[s:e]) for s, e in cut]
    return out


def chunked(documents: DataFrame) -> tuple[DataFrame, int]:
    """The table of chunks (chunk, row, doc_id, tie, text), bucketed by chunk, and the number of its words."""
    spark = documents.sparkSession
    batch_limit(spark)
    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids that repeat need an order of their rows; where none does, the column is empty and costs nothing
    repeats = not picked.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()
    picked = picked.select("doc_id", (F.xxhash64("text") if repeats else F.lit(0).cast("bigint")).alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, filled, n = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            sizes = np.diff(np.frombuffer(large_binary(b.column(2)).buffers()[1], np.int64)[: b.num_rows + 1])
            chunk, row = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for i, size in enumerate(sizes.tolist()):
                if n and (filled + size > CHUNK_BYTES or n >= CHUNK_ROWS):
                    now, filled, n = now + 1, 0, 0
                chunk[i], row[i] = now, n
                filled, n = filled + size, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(row), *b.columns], names=["chunk", "row", "doc_id", "tie", "text"])

    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(99_999, max(size // CHUNK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    name = f"chunks_{uuid.uuid4().hex}"
    out = picked.mapInArrow(run, "chunk bigint, row bigint, doc_id bigint, tie bigint, text string")
    out.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved, with its buckets, before the catalog forgets it; the files stay in the shared folder
    spark.sql(f"DROP TABLE {name}")
    return table, size // 4


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """A partition's rows, sorted by bucket, one bucket at a time."""
    now, held = None, {c: [] for c in columns}
    for batch in batches:
        lists = {c: batch.column(c) for c in columns}
        for i, k in enumerate(batch.column("bucket").to_pylist()):
            if k != now:
                if now is not None:
                    yield held
                now, held = k, {c: [] for c in columns}
            for c in columns:
                held[c].append(lists[c][i].as_py())
    if now is not None:
        yield held


def _hits(chunks: list[int], keys: list[np.ndarray], said: np.ndarray) -> Iterator[pa.RecordBatch]:
    at, out = 0, {"chunk": [], "keys": []}
    for c, k in zip(chunks, keys, strict=True):
        mine = said[at : at + len(k)]
        if mine.any():
            out["chunk"].append(c)
            out["keys"].append(pack(k[mine]))
        at += len(k)
    if out["chunk"]:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(out["chunk"], pa.int64()), "keys": pa.array(out["keys"], pa.binary())})


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _windows_of(intervals: bytes) -> np.ndarray:
    """Places from (first, last) pairs."""
    pairs = np.frombuffer(intervals, np.int64).reshape(-1, 2)
    return _ranges(pairs[:, 0], pairs[:, 1] + 1)


def _intervals(places: np.ndarray) -> bytes:
    """Rising places as (first, last) pairs."""
    opens = np.ones(len(places), bool)
    opens[1:] = places[1:] != places[:-1] + 1
    return np.stack([places[opens], places[np.append(np.flatnonzero(opens)[1:] - 1, len(places) - 1)]], 1).astype(np.int64).tobytes() if len(places) else b""


PROBES = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])
FOUND = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "second", "place", "ids", "tie", "own")]])
#: Places of a chunk's windows that repeat: inside it (intervals), or those that start earlier in another chunk, and where.
LOST = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("own", "place", "owner", "owner_place")]])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _lost_places(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places that repeat inside the chunk; places that start earlier elsewhere, in order, with the chunk and the place where)."""
    own = [_windows_of(x.as_py()) for x in answers.column("own") if x.is_valid and len(x.as_py())]
    rows = [(unplanes(p.as_py(), np.int32), unplanes(o.as_py(), np.int64), unplanes(q.as_py(), np.int32)) for p, o, q in zip(*[answers.column(c) for c in ("place", "owner", "owner_place")], strict=True) if p.is_valid and len(p.as_py())]
    none = np.zeros(0, np.int64)
    place, owner, at = (np.concatenate([r[i] for r in rows]).astype(np.int64) if rows else none for i in range(3))
    order = np.argsort(place, kind="stable")
    return np.concatenate(own) if own else none, place[order], owner[order], at[order]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept_text is the words that stay, joined by one space."""
    table, words = chunked(documents)
    spark = table.sparkSession
    bits = min(60, max(32, int(words).bit_length() + 13))
    shift = 64 - bits
    buckets = int(max(1, words // BUCKET_HASHES, min(int(spark.conf.get("spark.sql.shuffle.partitions")), words >> 12)))
    wide = int(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(wide, "bucket").sortWithinPartitions("bucket")

    probes = table.groupBy("chunk").applyInArrow(_prober(shift, buckets), _ddl(PROBES))
    hits = dealt(probes).mapInArrow(_anchored, "chunk bigint, keys binary")
    found = table.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extender(shift, buckets), _ddl(FOUND))
    lost = written(dealt(found).mapInArrow(_beaten, _ddl(LOST)), "repeats")
    runs = table.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(_runs, "owner bigint, owner_place bigint, n bigint, words binary").distinct()
    told = lost.select("*", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("words"))
    asked = runs.select(F.col("owner").alias("chunk"), *[F.lit(None).cast("binary").alias(c) for c in ("own", "place", "owner")], F.encode(F.col("owner_place").cast("string"), "UTF-8").alias("owner_place"), "n", "words")
    return table.groupBy("chunk").cogroup(told.unionByName(asked).groupBy("chunk")).applyInArrow(_cut, _ddl(RESULT))


def _prober(shift: int, buckets: int):
    def probe(t: pa.Table) -> pa.Table:
        c = Chunk(t)
        _, key, block = c.anchors(shift)
        unique, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        anchor = np.zeros(len(unique), bool)
        anchor[inverse[block]] = True
        flags = anchor.astype(np.uint8) | ((count > 1).astype(np.uint8) << 1)
        return pa.table(_cut_rows(t.column("chunk")[0].as_py(), bucket_of(unique << U(shift), buckets), {"keys": unique, "flags": flags}, True), schema=PROBES)

    return probe


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which runs of each chunk are anchors that stand elsewhere too."""
    for held in _gathered(batches, ["chunk", "keys", "flags"]):
        keys = [unpack(x) for x in held["keys"]]
        key, flags = np.concatenate(keys), np.frombuffer(b"".join(held["flags"]), np.uint8)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1) | (np.bincount(group, weights=flags[order] >> 1) > 0)
        anchored = np.bincount(group, weights=flags[order] & 1) > 0
        said = np.zeros(len(key), bool)
        said[order] = (several & anchored)[group]
        yield from _hits(held["chunk"], keys, said)


def _extender(shift: int, buckets: int):
    def extend(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return FOUND.empty_table()
        c = Chunk(t)
        at, short, _ = c.anchors(shift)
        known = np.sort(np.concatenate([unpack(x.as_py()) for x in answers.column("keys")]))
        starts = c.candidates(at[_member(short, known)])
        place, h, second = c.pairs()
        which = np.searchsorted(place, starts)
        h, second = h[which], second[which]
        first, group = firsts(h, second)  # of equal windows the first in the order of (id, row, place)
        rest = np.ones(len(starts), bool)
        rest[first] = False
        _compare_inside(c, starts[rest], starts[first[group[rest]]])
        number = t.column("chunk")[0].as_py()
        first = np.sort(first)
        bucket = bucket_of(h[first], buckets)
        by = np.argsort(bucket, kind="stable")  # by place in each bucket: ids hardly change from one to the next
        first, bucket = first[by], bucket[by]
        doc = c.doc[starts[first]]
        rows = _cut_rows(number, bucket, {"keys": h[first], "second": second[first], "place": starts[first].astype(np.int32), "ids": c.ids[doc], "tie": c.tie[doc]}, False)
        rows["own"] = [b""] * len(rows["bucket"])
        if rest.any():
            for name, value in zip(FOUND.names, (number % buckets, number, b"", b"", b"", b"", b"", _intervals(starts[rest])), strict=True):
                rows[name].append(value)
        return pa.table(rows, schema=FOUND)

    return extend


def _compare_inside(c: Chunk, later: np.ndarray, first: np.ndarray) -> None:
    """Compares the words of windows with those of the first window that has their hashes: whole windows where a run begins, one more word where it goes on."""
    if not len(later):
        return
    goes_on = np.zeros(len(later), bool)
    goes_on[1:] = (later[1:] == later[:-1] + 1) & (first[1:] == first[:-1] + 1)
    a = np.concatenate([_ranges(later[~goes_on], later[~goes_on] + WINDOW), later[goes_on] + WINDOW - 1])
    b = np.concatenate([_ranges(first[~goes_on], first[~goes_on] + WINDOW), first[goes_on] + WINDOW - 1])
    if not c.same_words(a, b):
        raise ValueError("different words share 96 bits of two hashes")


def _beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk its windows that another chunk has earlier, and where."""
    for held in _gathered(batches, ["chunk", "keys", "second", "place", "ids", "tie", "own"]):
        out: dict[str, list] = {c: [] for c in LOST.names}
        key, second, place, ids, tie = (np.concatenate([unplanes(x, kind) for x in held[c]]) for c, kind in (("keys", U), ("second", np.uint32), ("place", np.int32), ("ids", np.int64), ("tie", np.int64)))
        sizes = [len(x) // 8 for x in held["keys"]]
        chunk = np.repeat(np.array(held["chunk"], np.int64), sizes)
        order = np.lexsort((chunk, tie, ids, second, key))
        a, b = key[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        owner = np.empty(len(order), np.int64)  # of each entry the first of its group
        owner[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        at = 0
        for number, n, own in zip(held["chunk"], sizes, held["own"], strict=True):
            mine = np.arange(at, at + n)
            mine = mine[owner[mine] != mine]
            at += n
            if len(mine) or own:
                for name, value in zip(LOST.names, (number, own, planes(place[mine]), planes(chunk[owner[mine]]), planes(place[owner[mine]])), strict=True):
                    out[name].append(value)
        if out["chunk"]:
            yield pa.RecordBatch.from_pydict(out, schema=LOST)


def _runs(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
    """The maximal runs of words that start earlier elsewhere: (chunk and place of the first, number of words, the words)."""
    schema = pa.schema([("owner", pa.int64()), ("owner_place", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
    if not t.num_rows or not answers.num_rows:
        return schema.empty_table()
    _, place, owner, at = _lost_places(answers)
    if not len(place):
        return schema.empty_table()
    c = Chunk(t, hashed=False)
    opens = np.ones(len(place), bool)
    opens[1:] = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(opens)
    n = np.diff(np.append(begin, len(place))) + WINDOW - 1
    words = [c.text_of(p, m) for p, m in zip(place[begin].tolist(), n.tolist(), strict=True)]
    return pa.table([pa.array(owner[begin]), pa.array(at[begin]), pa.array(n), pa.array(words, pa.binary())], schema=schema)


def _cut(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
    if not t.num_rows:
        return RESULT.empty_table()
    c = Chunk(t, hashed=False)
    asks = np.asarray(answers.column("words").is_valid()) if answers.num_rows else np.zeros(0, bool)
    own, place, _, _ = _lost_places(answers.filter(pa.array(~asks)))
    for at, n, words in zip(*[answers.filter(pa.array(asks)).column(x).to_pylist() for x in ("owner_place", "n", "words")], strict=True):
        if c.text_of(int(at), n) != words:
            raise ValueError("different words share 96 bits of two hashes")
    gone = covered(np.concatenate([own, place]), WINDOW, len(c.start))
    texts = []
    for i, text in enumerate(c.texts):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        g = gone[c.first[i] : c.first[i + 1]]
        texts.append((b" ".join([x for x, out in zip(words, g.tolist(), strict=True) if not out]) if g.any() else b" ".join(words)).decode())
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), c.first[:-1]) if len(c.count) else np.zeros(0, np.int64)
    removed = np.where(c.count > 0, removed, 0)
    return pa.table([pa.array(c.ids, mask=c.void), pa.array(c.count), pa.array(removed), pa.array(texts, pa.string())], schema=RESULT)
