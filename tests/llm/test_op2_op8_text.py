import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chunkloom.llm import language_id as li
from chunkloom.llm import toxicity as tx

DOCS = "doc_id bigint, text string, lang string, score double, terms string"
LABELS = "doc_id bigint, quality int, toxic int"
rng = random.Random(6)
WORDS = {
    "en": ["the", "of", "and", "thing", "water", "house", "with", "over", "under", "night"],
    "de": ["der", "die", "und", "straße", "wasser", "haus", "über", "nicht", "schön", "ich"],
    "fr": ["le", "la", "été", "eau", "maison", "avec", "où", "pas", "très", "nuit"],
}


def prose(lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def brute_probability(texts, order=li.ORDER):
    """Interpolated Kneser-Ney by dictionaries, from the definition."""
    count = Counter()
    for t in texts:
        s = " " + t + " "
        for i in range(1, len(s)):
            count[("\0" * order + s[: i + 1])[-order:]] += 1
    tables = {order: dict(count)}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(k[1:] for k in tables[n + 1])
    discount = {}
    for n, t in tables.items():
        one, two = (sum(c == i for c in t.values()) for i in (1, 2))
        discount[n] = min(max(one / max(one + 2 * two, 1), 0.05), 0.95)

    def p(run):
        n = len(run)
        t, d = tables[n], discount[n]
        if n == 1:
            return (max(t.get(run, 0) - d, 0) + d * len(t) / (len(t) + 1)) / sum(t.values())
        own = {k: c for k, c in t.items() if k[:-1] == run[:-1]}
        if not own:
            return p(run[1:])
        return (max(own.get(run, 0) - d, 0) + d * len(own) * p(run[1:])) / sum(own.values())

    return p


def pairs(texts):
    sizes = [len(t.encode()) for t in texts]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer("".join(texts).encode(), np.uint8), at


def test_kneser_ney_equals_the_definition():
    train = ["abab abc", "été ab", "b"]
    data, offsets = pairs(train)
    symbol, text = li.symbols(data, offsets)
    key, _ = li.runs(symbol, text)
    opens = np.concatenate([[True], text[1:] != text[:-1]])
    unique, count = np.unique(key[~opens], return_counts=True)
    model = li.estimate(["x"], [(unique, count)])
    p = brute_probability(train)
    for probe in ["abab", "zab cé", "é", "bbbb abc"]:
        d, o = pairs([probe])
        ce, n = model.cross_entropy(d, o)
        s = " " + probe + " "
        want = -np.mean([np.log(p(("\0" * li.ORDER + s[: i + 1])[-li.ORDER :])) for i in range(1, len(s))])
        assert n[0] == len(s) and abs(ce[0, 0] - want) < 1e-9


def test_probabilities_sum_to_one():
    train = ["abab abc", "cab ba"]
    p = brute_probability(train)
    for context in ["aba", "  a", "zzz"]:
        total = sum(p(context + c) for c in " abc")
        assert total < 1 and total + sum(p(context + c) for c in "z") == pytest.approx(1, abs=1e-9)


def test_symbols():
    texts = ["", "12 ,", "aB", "a1b", "é𝒜z", " x "]
    data, offsets = pairs([t.lower() for t in texts])
    s, t = li.symbols(data, offsets)
    got = defaultdict(str)
    for a, b in zip(s.tolist(), t.tolist(), strict=True):
        got[b] += chr(a) if not 0xD800 <= a < 0xE000 else "?"
    assert dict(got) == {2: " ab ", 3: " a b ", 4: " é?z ", 5: " x "}


def test_languages_of_held_out_rows(spark):
    rows = [(i, prose(lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (None, prose("de", 30), "de"), (1003, prose("fr", 20_000), None), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS)
    got = li.predict_languages(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == x for d, t, x in rows[:300])
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "de" and by[1003].lang_pred == "fr"
    assert li.predict_languages(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in li.predict_languages(frame.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


@pytest.mark.parametrize("common", [False, True])
def test_block_max_search_equals_brute_force(monkeypatch, common):
    monkeypatch.setattr(tx, "COMMON", 16 if common else 1)
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(900):
        ids = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        v = rng.integers(1, 4, len(ids)).astype(float)  # many ties
        vectors.append((ids, v / np.sqrt(v @ v) if len(v) else v))
    term, weight = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
    first = np.concatenate([[0], np.cumsum([len(i) for i, _ in vectors])])
    index = tx.BlockMaxIndex(term.astype(np.int64), weight, first, 40)
    assert sorted(index.order.tolist()) == list(range(900)) and (index.order[index.place] == np.arange(900)).all()
    dense = np.zeros((900, 40))
    for i, k in enumerate(index.order):
        dense[i, vectors[k][0]] = vectors[k][1]
    assert len(index.rows) if common else not len(index.rows)
    for without in (-1, 7):
        out = index.search(term[: first[200]].astype(np.int64), weight[: first[200]], first[:201], 24, None if without < 0 else index.order[np.full(200, without)])
        for (near, got), (ids, v) in zip(out, vectors[:200], strict=True):
            full = np.zeros(40)
            full[ids] = v
            cos = np.round(dense @ full, 12)
            want = [i for i in np.lexsort((np.arange(900), -cos)) if cos[i] > 0 and i != without][:24]
            assert near.tolist() == want and np.allclose(got, cos[want])


def brute_toxicity(rows, labels):
    """Evidence and scores of all rows from the definition, by dictionaries; every labelled row outside the held-out remainder is an example."""
    import re
    from math import log, sqrt

    counts = [Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t in rows]
    df, total = Counter(w for c in counts for w in c), len(rows)
    known = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            known.setdefault(d, []).append(y)
    known = {d: int(sum(y) / len(y) > 0.5) for d, y in known.items()}
    examples, seen = [], set()
    for i, (d, t) in enumerate(rows):
        if d in known and (d, t) not in seen:
            seen.add((d, t))
            examples.append(i)
    n1 = sum(known[rows[i][0]] for i in examples)
    n0 = len(examples) - n1
    of = {w: [sum(1 for i in examples if w in counts[i] and known[rows[i][0]] == y) for y in (1, 0)] for w in df}

    def factor(w):
        a, b = of[w]
        n = a + b
        low = n * (n1 + n0 - n) * n1 * n0
        return tx.FLOOR + ((a * (n0 - b) - b * (n1 - a)) ** 2 / low if low else 0.0)

    def vector(c):
        v = {w: (1 + log(tf)) * log((2 + total) / (1 + df[w])) * factor(w) for w, tf in c.items()}
        length = sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / length for w, x in v.items()}

    vectors = [vector(c) for c in counts]
    base = n1 / len(examples)

    def vote(i, own):
        near = sorted(((sum(x * vectors[e].get(w, 0.0) for w, x in vectors[i].items()), e) for e in examples if not (own and e == i)), reverse=True)[: tx.NEIGHBOURS]
        near = [(c, e) for c, e in near if c > 1e-12]
        return (sum(c * known[rows[e][0]] for c, e in near) + tx.PRIOR * base) / (sum(c for c, _ in near) + tx.PRIOR), near

    votes = np.array([vote(e, True)[0] for e in examples])
    y = np.array([known[rows[e][0]] for e in examples], float)
    from chunkloom.llm.fitting import calibrated, isotonic

    bins, inverse = np.unique(np.round(votes, 3), return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    knots = isotonic(bins, np.bincount(inverse, weights=y) / weight, weight)
    raw = [vote(i, False) for i in range(len(rows))]
    return calibrated(np.array([v for v, _ in raw]), knots, 0.0), [[c for c, _ in near] for _, near in raw]


def test_scores_equal_brute_force(spark):
    """The whole result: document frequencies, all terms of whole texts, neighbours, votes, calibration."""
    word = lambda: rng.choice([f"w{int(rng.expovariate(0.01))}", "Éa", "été", "THE", "the", "of"])
    rows, labels = [], []
    for i in range(260):
        words = [word() for _ in range(rng.randint(0, 40))]
        if i % 4 == 0:
            words += [rng.choice(["moron", "scum"])]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
        if i % 3:
            labels.append((i, int(i % 4 == 0)))
    rows += [(300, None), (301, ""), (5, rows[5][1]), (6, "another text of one id"), (None, rows[8][1])]
    labels += [(7, 1 - int(7 % 4 == 0)), (4, 0), (4, 0), (None, 1)]
    frame = spark.createDataFrame([(d, t, "x", 1.0, "y") for d, t in rows], DOCS).repartition(4)
    known = spark.createDataFrame([(d, 1, y) for d, y in labels], LABELS)
    score, near = brute_toxicity(rows, labels)
    got = tx.classify_toxicity(frame, known, max_examples=10_000).collect()
    key = lambda d, s, c: (str(d), round(s, 6), [round(x, 6) for x in c])
    assert sorted(key(r.doc_id, r.score, [e.similarity for e in r.evidence]) for r in got) == sorted(key(d, s, c[:3]) for (d, _), s, c in zip(rows, score, near, strict=True))


def test_sample_is_bounded_in_rows(spark):
    """Copies of one id can't exceed the bound; both labels are drawn."""
    rows = [(1, "moron")] * 500 + [(3, f"text {i}") for i in range(500)] + [(i, f"clean {i}") for i in range(10, 400)]
    frame = spark.createDataFrame([(d, t, "x", 1.0, "y") for d, t in rows], DOCS)
    labels = spark.createDataFrame([(d, 1, int(d < 4)) for d in {r[0] for r in rows}], LABELS)
    from chunkloom.llm.fitting import agreed_labels, drawn_rows

    drawn = drawn_rows(frame, agreed_labels(labels, "toxic", 4, 2), {0: 60, 1: 60}, 31).collect()
    assert len({(r.doc_id, r.text) for r in drawn}) == len(drawn) < 200 and {r.y for r in drawn} <= {0, 1}


def test_rejection_is_a_rank_of_the_excess(spark):
    """About one in a hundred of ordinary texts is rejected, and texts of another kind are."""
    rows = [(i, prose(lang, rng.randint(20, 60)), lang) for i in range(3000) for lang in [rng.choice(list(WORDS))]]
    rows += [(10_000 + i, " ".join("".join(rng.choice("qxzjkv") for _ in range(6)) for _ in range(30)), None) for i in range(20)]
    got = {r.doc_id: r.rejected for r in li.predict_languages(spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS)).collect()}
    assert np.mean([got[i] for i in range(3000)]) < 0.04 and all(got[10_000 + i] for i in range(20))


def test_counts_grow_with_the_input_and_keep_their_bound(spark):
    rows = [(i, prose("en", 30), "en") for i in range(300)]
    frame = spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS)
    few, many = (li.fit_languages(frame.where(f"doc_id < {n}"), max_calibrating=10) for n in (5, 300))
    assert len(few.keys[-1]) < len(many.keys[-1])
    assert len(li.fit_languages(frame, 10, max_runs=50).keys[-1]) <= 50


@pytest.mark.parametrize(("max_runs", "block"), [(0, 1 << 22), (50, 1 << 9), (600, 1 << 14)])
def test_runs_beyond_memory_stay_in_the_model(spark, monkeypatch, max_runs, block):
    """Whatever memory holds of the runs, each text's cross-entropies are those of the whole model, and so is all that follows."""
    monkeypatch.setattr(li, "BLOCK", block)
    monkeypatch.setattr(li, "batch_limit", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20"))  # several slices a task
    own = random.Random(7)
    rows = [(i, " ".join(own.choice(WORDS[lang]) + own.choice(["", "s", "én", "x"]) for _ in range(own.randint(1, 40))), lang) for i in range(400) for lang in [own.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "12 !", "fr"), (1002, "", None), (None, "der die und", None), (1003, "Ωμέγα 漢字 𐐀𐐁 the", None), (1003, "water", "en"), (1004, "qqq", "xx"), (1005, "...", "yy")]
    frame = spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS).repartition(5)
    whole, part = li.fit_languages(frame, 10), li.fit_languages(frame, 10, max_runs)
    held = len(part.keys[-1]) * len(part.languages)
    assert part.languages == whole.languages and held <= max_runs < sum(map(len, whole.keys)) and (held > 0) == (max_runs > 0)
    assert part.steepness == whole.steepness and part.limit == pytest.approx(whole.limit)
    one, two = ({(r.doc_id, r.text): r for r in li.cross_entropies(frame, m, ["doc_id", "text"]).collect()} for m in (whole, part))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert two[k].symbols == r.symbols and two[k].ce == pytest.approx(r.ce, abs=1e-12)
    one, two = ({(r.doc_id, r.held_out, r.lang_pred, r.rejected): r.score for r in li.predict_languages(frame, 10, n).collect()} for n in (1 << 24, max_runs))
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(x) for k, x in one.items())


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words here", lang) for i in range(40) for lang in ("zz", "aa")]
    frame = spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS)
    assert {r.lang_pred for r in li.predict_languages(frame).collect()} == {"aa"}


def test_ties_and_empty_texts_without_memory_for_runs(spark):
    rows = [(i, f"same words here {'again ' * (i % 7)}", lang) for i in range(40) for lang in ("zz", "aa")]
    frame = spark.createDataFrame([(d, t, x, 0.5, "q") for d, t, x in rows], DOCS)
    assert {r.lang_pred for r in li.predict_languages(frame, max_runs=0).collect()} == {"aa"}
    model = li.fit_languages(frame, max_runs=0)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 2")], "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in li.identify(odd, model, ["doc_id"]).collect()} == {("und", 0.0)}
    assert li.identify(odd.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_of_held_out_rows(spark):
    bad = ["moron", "scumbag", "vileword"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "moron"), (5000, None), (5001, ""), (5002, "fine " * 30_000 + "moron"), (6, rows[6][1])]
    frame = spark.createDataFrame([(d, t, "x", 1.0, "y") for d, t in rows], DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 1), (8, 1, None)], LABELS)
    got = tx.classify_toxicity(frame, known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([by[i].predicted == int(i % 6 == 0) for i in range(900)]) > 0.98
    assert by[None].predicted == 1 and by[5002].predicted == 1 and by[5000].score == by[5001].score < 0.3
    toxic = by[0]
    assert len(toxic.evidence) == 3 and all(e.toxic == 1 and e.similarity > 0 for e in toxic.evidence)
    assert {r.score for r in tx.classify_toxicity(frame, known.limit(0)).collect()} == {0.0}
    assert tx.classify_toxicity(frame.limit(0), known).count() == 0
