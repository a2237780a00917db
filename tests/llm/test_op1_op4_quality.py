import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import fitting, quality_classifier as qc, quality_rules as qr, textstats as ts
from chunkloom.llm.shared import slices

DOCS = "doc_id bigint, text string, lang string, score double, __c0 string"
LABELS = "doc_id bigint, quality int, toxic int"
rng = random.Random(1)


def good():
    return ".\n".join(" ".join(rng.choice(["alpha", "beta", "of", "the", "gamma", "réel"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(3, 9))) + "."


def junk():
    return " ".join(rng.choice(["###", "$$$", "WIN!!", "|", "%%%a"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 200)))


def corpus(n=300):
    rows = [(i, good() if (i * 7) % 5 else junk()) for i in range(n)]
    labels = [(i, int(bool((i * 7) % 5)), 0) for i in range(n) if i % 4 or i % 3]
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(d, t, "x", 9.0, "y") for d, t in rows], DOCS), spark.createDataFrame(labels, LABELS)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)]


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_counts_equal_brute_force(limit):
    rng = random.Random(limit)
    texts = [None, "", " ", "\n", "a", "a\n\na\n", "é é é é", "\x0bx\x0cx\x0bx x x x", "x" * 5000, "l1\r\nl1\r\nl1"]
    texts += ["".join(rng.choice("ab \n#é|\t") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = np.concatenate([ts.measure(d, o)[0] for _, _, d, o in slices(pa.array(texts), limit)])
    assert got.tolist() == [brute_counts(t) for t in texts]


def test_normal_equations_equal_a_direct_solution(spark):
    rows, labels = corpus()
    docs, known = frames(spark, rows, labels)
    stats = ts.text_stats(docs.repartition(7), ["doc_id"])
    train = qc.training_rows(stats, known, "quality", 3, 1).selectExpr("stats_ratios", "__y", "doc_id % 5 AS f")
    model = qc.fit_quality(train, "__y", "f", n_features=24)
    data = train.collect()
    x, y = model.features(np.array([r["stats_ratios"] for r in data])), np.array([float(r["__y"]) for r in data])

    def direct(rows, penalty):
        ridge = np.full(x.shape[1], penalty * len(y) / 1000)
        ridge[-1] = 1e-9
        return np.linalg.solve(x[rows].T @ x[rows] + np.diag(ridge + 1e-9), x[rows].T @ y[rows])

    everything = np.ones(len(y), bool)
    assert min(np.abs(direct(everything, p) - model.folds[-1]).max() for p in qc.PENALTIES) < 1e-4


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    d = len(ts.RATIOS)
    model = qc.QualityModel(np.zeros(d), np.ones(d), rng.normal(0, 1 / 4.0, (d, 6000)), rng.uniform(0, 2 * np.pi, 6000), np.zeros((6, 1)), (np.zeros(0), np.zeros(0)))
    a = rng.normal(size=(20, d))
    z = model.features(a)[:, :6000]
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(-1) / (2 * 4.0**2))
    assert np.abs(z @ z.T - kernel).max() < 0.08


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 12, 60).astype(float), rng.random(60), rng.integers(1, 4, 60).astype(float)
    xs, ys = fitting.isotonic(x, y, w)
    assert (np.diff(ys) >= 0).all()
    # max-min formula over the distinct x
    u = np.unique(x)
    s, t = np.array([(w * y)[x == v].sum() for v in u]), np.array([w[x == v].sum() for v in u])
    for k in range(len(u)):
        want = max(min(s[i : j + 1].sum() / t[i : j + 1].sum() for j in range(k, len(u))) for i in range(k + 1))
        assert abs(np.interp(u[k], xs, ys) - want) < 1e-9


def test_classifier_separates_held_out_rows(spark):
    rows, labels = corpus()
    rows += [(None, junk()), (9001, None), (9002, ""), (9003, good() * 300), (5, rows[5][1])]
    docs, known = frames(spark, rows, labels + [(None, 1, 0), (7, None, 0)])
    out, _ = qc.classify_quality(docs, known)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == q for i, q, _ in labels if by[i].held_out]
    assert np.mean(right) > 0.95
    kept = qc.filter_quality(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)
    again = {r.doc_id: r.score for r in qc.classify_quality(docs.repartition(3), known)[0].collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_classifier_without_labels_or_rows(spark):
    rows, labels = corpus(20)
    docs, known = frames(spark, rows, labels)
    assert {r.score for r in qc.classify_quality(docs, known.limit(0))[0].collect()} == {0.5}
    assert qc.classify_quality(docs.limit(0), known)[0].count() == 0
    one = qc.classify_quality(docs, known.where("quality = 1"))[0].collect()
    assert all(r.predicted == 1 for r in one)


def test_rules_learn_and_apply(spark):
    rows, labels = corpus(600)
    rows += [(None, junk()), (9001, None), (9002, ""), (5, rows[5][1])]
    docs, known = frames(spark, rows, labels)
    out, rules = qr.apply_rules(docs, known)
    got = out.collect()
    assert rules and len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        counts = brute_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        x = np.concatenate([ts.measure(d, o)[1] for _, _, d, o in slices(pa.array([texts[r.doc_id]]))])
        first = next((i for i, rule in enumerate(rules) if rule.holds(x)[0]), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
    by = {r.doc_id: r for r in got}
    long = [(by[i], q) for i, q, _ in labels if not by[i].base_failed]
    assert np.mean([r.kept == bool(q) for r, q in long]) > 0.97
    none, rules = qr.apply_rules(docs, known.limit(0))
    assert rules == [] and all(r.kept == (not r.base_failed) for r in none.collect())
    assert qr.apply_rules(docs.limit(0), known)[0].count() == 0


def test_growing_takes_the_condition_of_the_largest_gain():
    rng = np.random.default_rng(4)
    x = rng.random((400, len(ts.RATIOS)))
    bad = (x[:, 3] > 0.7) & (x[:, 5] <= 0.5)
    rules = qr.learn_rules(x, bad, min_precision=0.8)
    hit = np.zeros(400, bool)
    for r in rules:
        hit |= r.holds(x)
    assert {c.feature for c in rules[0].conditions} == {3, 5}
    assert (hit == bad).mean() > 0.97
    assert qr.learn_rules(x, np.zeros(400, bool)) == []


def brute_grow(x, bad, most):
    """All thresholds of all statistics tried one by one, from the definition of the gain."""
    from math import log2

    chosen, inside = [], list(range(len(x)))
    while len(chosen) < most:
        p0, n0 = sum(bad[i] for i in inside), sum(not bad[i] for i in inside)
        if not p0 or not n0:
            break
        best = None
        for f in range(x.shape[1]):
            values = sorted({x[i, f] for i in inside})[:-1]
            for above in (False, True):
                for t in values:
                    got = [i for i in inside if (x[i, f] > t) == above]
                    p = sum(bad[i] for i in got)
                    if p:
                        gain = p * (log2(p / len(got)) - log2(p0 / (p0 + n0)))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = gain, qr.Condition(f, above, float(t)), got
        if best is None:
            break
        chosen.append(best[1])
        inside = best[2]
    return chosen


@pytest.mark.parametrize("seed", range(6))
def test_grow_and_prune_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (120, 4)).astype(float)  # few values: every threshold is tried, ties abound
    bad = (x[:, 0] > 5) & (x[:, 2] <= 4) | (rng.random(120) < 0.1)
    rule = qr.grow(x, bad, 4)
    want = brute_grow(x, bad, 4)

    def covered(conditions):
        return [qr.Rule(tuple(conditions[: i + 1])).holds(x).tolist() for i in range(len(conditions))]

    assert list(rule.conditions) == want or covered(rule.conditions) == covered(want)
    y = rng.integers(0, 9, (80, 4)).astype(float)
    worse = (y[:, 0] > 5) & (rng.random(80) < 0.6)
    pruned = qr.prune(rule, y, worse)
    worth = []
    for i in range(1, len(rule.conditions) + 1):
        inside = qr.Rule(rule.conditions[:i]).holds(y)
        p, n = int((inside & worse).sum()), int((inside & ~worse).sum())
        worth.append((p - n) / (p + n) if p + n else -1.0)
    assert len(pruned.conditions) == worth.index(max(worth)) + 1


def test_labels_that_disagree_and_samples(spark):
    """The more frequent label counts, 0 if none is; a sample is bounded in rows, whatever the ids."""
    from chunkloom.llm.fitting import agreed_labels

    labels = spark.createDataFrame([(d, y, 0) for d, y in [(2, 1), (2, 0), (3, 1), (3, 1), (3, 0), (5, None), (6, 0), (None, 1)]], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.y for r in agreed_labels(labels, "quality", 1000, 999).collect()}
    assert got == {2: 0, 3: 1, 6: 0}
