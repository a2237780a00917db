import random

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import decontamination as dc

DOCS = "doc_id bigint, text string, lang string, distance int"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
#: A heavy head, so that common short runs occur by chance.
sentence = lambda n: [rng.choice(VOCAB[:20] if rng.random() < 0.6 else VOCAB) for _ in range(n)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(prev[j + 1] + 1, row[j] + 1, prev[j] + (x != y))
    return row[-1]


def brute(words, item):
    n = len(item)
    return min(distance(words[s : s + n], item) for s in range(max(len(words) - n, 0) + 1))


def edited(words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[at] = rng.choice(VOCAB)
        elif kind < 0.67:
            words.insert(at, rng.choice(VOCAB))
        else:
            del words[at]
    return words


def test_recall_and_precision_against_brute_force(spark):
    items = [sentence(rng.randint(6, 50)) for _ in range(24)]
    docs = []
    for i in range(240):
        it = rng.choice(items)
        body = edited(it, rng.randint(0, int(0.2 * len(it)))) if i % 3 else []
        docs.append(sentence(rng.randint(0, 30)) + body + sentence(rng.randint(0, 30)))
    want = {(d, i): x for d, words in enumerate(docs) for i, item in enumerate(items) if words and (x := brute(words, item)) <= int(0.2 * len(item) + 1e-9)}
    frame = spark.createDataFrame([(d, ", ".join(w).title() + "!", "en", 1) for d, w in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(frame, bench).collect()}
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.95 * len(want), (len(got), len(want))
    assert all(k in got for k, x in want.items() if x == 0)
    kept = {r.doc_id for r in dc.remove_leaks(frame, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}
    assert dc.remove_leaks(frame, bench).columns == frame.columns


def test_unbalanced_edits_before_the_shared_run(spark):
    item = [f"w{i}" for i in range(1, 11)]
    text = ["a", "b", "w1", *item[2:8], "x", "w9", "w10", "c", "d"]  # w2 is gone, x came: distance 2, and the shared runs stand one word off
    frame = spark.createDataFrame([(1, " ".join(text), "en", 1)], DOCS)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert brute(text, item) == 2
    assert [tuple(r) for r in dc.leaks(frame, bench, dc.LeakParameters(walks=64)).collect()] == [(1, 7, 2, 10, 2)]


def test_proposed_windows_hold_every_shift():
    """The starts alone, without keys: every copy at the threshold is among them, and each window is proposed once."""
    own = np.random.default_rng(8)
    items = [own.integers(1, 1 << 62, n).astype(np.uint64) for n in (5, 9, 10, 12, 20, 33, 60) for _ in range(12)]
    seen = []
    text = lambda words: " ".join(map("w{}".format, words.tolist()))
    of = dc.item_words([text(x) for x in items])
    index = dc.LeakIndex(dc.LeakParameters(walks=1), list(range(len(of))), of)
    index._verify = lambda w, h, windows: seen.append(windows) or tuple(np.zeros(0, np.int64) for _ in range(4))
    noise = lambda: own.integers(1, 1 << 62, 25).astype(np.uint64)
    copies = [dc.edited_copy(x, int(0.2 * len(x) + 1e-9), own) for x in items]
    docs = [text(np.concatenate([noise(), c, noise()])) for c in copies]
    (_, _, w, h), = dc.lower_words(dc.pa.array(docs))
    index.search(w, h)
    found = np.concatenate(seen)
    assert len(np.unique(found, axis=0)) == len(found)
    pairs = set(map(tuple, found.tolist()))
    assert all((i, int(w.first[i]) + 25, len(x)) in pairs for i, x in enumerate(items))


def test_recall_at_the_threshold_length_by_length(spark):
    """Copies with exactly as many edits as the threshold allows."""
    own = np.random.default_rng(4)
    fresh = lambda n: own.integers(1, 1 << 62, n).astype(np.uint64)
    text = lambda words: " ".join(map("w{}".format, words.tolist()))
    items = [fresh(n) for n in (5, 10, 16, 25, 40, 80) for _ in range(60)]
    docs = [np.concatenate([fresh(20), dc.edited_copy(x, int(0.2 * len(x) + 1e-9), own), fresh(20)]) for x in items]
    frame = spark.createDataFrame([(i, text(x), "en", 1) for i, x in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, text(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {r.doc_id for r in dc.leaks(frame, bench).collect() if r.doc_id == r.item_id}
    found = {n: [i in got for i, x in enumerate(items) if len(x) == n] for n in {len(x) for x in items}}
    assert all(np.mean(x) >= 0.95 for x in found.values()), {n: np.mean(x) for n, x in found.items()}


def test_blocks_give_the_same_result(spark, monkeypatch):
    items = [sentence(20) for _ in range(12)]
    frame = spark.createDataFrame([(i, " ".join(sentence(9) + it + sentence(4)), None, None) for i, it in enumerate(items)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    whole = sorted(map(tuple, dc.leaks(frame, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    assert len(list(dc.blocks(bench, dc.LeakParameters()))) > 1
    assert sorted(map(tuple, dc.leaks(frame, bench).collect())) == whole
    assert [(r[0], r[1], r[4]) for r in whole] == [(i, i, 0) for i in range(12)]


def test_edge_cases(spark):
    long = " ".join(sentence(30_000))
    passage = " ".join(sentence(15))
    bench = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, None), (3, ""), (4, "one two three"), (5, " ".join(passage.split()[:5]))], "item_id bigint, text string")
    rows = [(1, None), (None, passage), (2, ""), (3, f"{long} {passage} {long}"), (3, passage), (4, "one two three"), (5, " ".join(passage.split()[:13]))]
    frame = spark.createDataFrame([(a, b, None, 7) for a, b in rows], DOCS)
    got = sorted((str(r.doc_id), str(r.item_id), r.start_word, r.distance) for r in dc.leaks(frame, bench).collect() if r.item_id != 5)
    each = lambda d, s, x: [(d, "1", s, x), (d, "1", s, x), (d, "None", s, x)]
    assert got == sorted(each("None", 0, 0) + each("3", 30_000, 0) + each("3", 0, 0) + each("5", 0, 2))
    assert dc.leaks(frame.limit(0), bench).count() == 0
    assert dc.leaks(frame, bench.limit(0)).count() == 0
    assert dc.remove_leaks(frame, bench.limit(0)).count() == len(rows)
    assert {f.name for f in dc.leaks(frame, bench).schema} == {"doc_id", "item_id", "start_word", "item_words", "distance"}


@pytest.mark.parametrize("n", [1, 5, 12])
def test_edit_distances(n):
    a = [sentence(rng.randint(0, n + 3))[:n] for _ in range(30)]
    b = [sentence(n) for _ in range(30)]
    code = {w: i for i, w in enumerate(VOCAB)}
    padded = np.array([[code[x] for x in w] + [-1] * (n - len(w)) for w in a])
    got = dc.edit_distances(padded, np.array([len(w) for w in a]), np.array([[code[x] for x in w] for w in b]))
    assert got.tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_memory_does_not_follow_the_longest_item():
    """300 items of 20 words and one of 10,000: what the index and a search hold at once is bounded by HELD, not by items times longest item."""
    import tracemalloc

    rng = np.random.default_rng(2)
    texts = [" ".join(f"i{i}w{j}" for j in range(20)) for i in range(300)] + [" ".join(f"v{k}" for k in rng.integers(0, 5000, 10_000))]
    words = dc.item_words(texts)
    tracemalloc.start()
    index = dc.LeakIndex(dc.LeakParameters(walks=6), list(range(301)), words)
    edited = texts[-1].split()
    for k in range(0, 10_000, 2000):
        edited[k] = "changed"
    found = []
    for _, _, w, h in dc.lower_words(pa.array([texts[5] + " tail", "head " + " ".join(edited), "nothing here at all"])):
        found += list(zip(*[x.tolist() for x in index.search(w, h)], strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, 5, 0, 0) in found and any(item == 300 and 0 < d <= 5 for _, item, _, d in found)
    assert peak < 20 * 8 * dc.HELD
