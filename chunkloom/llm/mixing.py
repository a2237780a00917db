"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words; its documents' copies are target / size of the source on average, the same for all of them.
The whole part is certain; the fractional part p is rounded by the pivotal method: two documents with words a, b and probabilities p, q
meet, and words move at random from one to the other, a p + b q staying as it is and each expectation too, until one of them is 0 or 1.
Documents meet in small groups (about ``FAN_IN`` rows, the longest first, so that short ones are left; folded by a higher-order SQL function); what a group can't decide, one document at most,
goes up a distributed reduction tree, whose levels shrink by FAN_IN. At the root one document of a source is left, rounded by a last draw, so that
the words a source takes differ from its target by less than the words of one document.

All randomness is a keyed hash of the row's content: reruns and recomputed tasks agree.

Defined results: a null text has size 0, and a document without words is taken as often as the whole part says and adds nothing; a null source is
the last one in the order; rows equal in every used column are one unit, whose copies are dealt out evenly among them; a source without words has
target 0; an empty table gives an empty result; other columns are ignored by ``mix_sizes`` and kept by ``mix_documents``. A tree that has more than ``LEVELS`` levels
(some 10^14 units) is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 1024
#: Of a group's units in the order of their lengths, each KEEP-th goes up unmet, so that the root still has short ones to even out a long one.
KEEP = 12
#: Levels of the tree at most: each shrinks it by FAN_IN / (FAN_IN / KEEP + 1), over 11.
LEVELS = 12
MAX_COPIES = 3


def identity(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes (d1, d2) of columns, with marks for nulls: rows equal in all of them are one unit."""
    marked = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    return [F.xxhash64(F.lit(seed), *marked).alias(k) for seed, k in ((1, "d1"), (2, "d2"))]


def sized(documents: DataFrame, columns: list[str]) -> DataFrame:
    """Units: (doc_id, source, d1, d2, size, rows) with one row for all rows equal in ``columns``, which name id, source and text at least."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    narrow = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), *identity(columns), size)
    return narrow.groupBy("doc_id", "source", "d1", "d2", "size").agg(F.count("*").alias("rows"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): shares of all words by repeating weights in the order of code points, null last;
    no target exceeds cap times its source, and what is over is shared anew by weight among those below. In closed form: sources
    sorted by cap * size / weight are capped up to the first whose share of the rest fits. One row a source; window functions over them only."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__i") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("__i", F.row_number().over(order)).withColumn("__w", weight.cast("double"))
    fill = Window.orderBy((F.lit(cap) * F.col("source_size")) / F.col("__w"), "__i")
    w = w.withColumn("__total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    w = w.withColumn("__capped_before", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("__weight_left", F.sum("__w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("__total") - F.col("__capped_before")) / F.col("__weight_left")
    w = w.withColumn("__share", share).withColumn("__fits", F.col("__w") * F.col("__share") <= F.lit(cap) * F.col("source_size"))
    # the share of the first that fits holds for all after it
    level = F.min(F.when(F.col("__fits"), F.struct((F.lit(cap) * F.col("source_size") / F.col("__w")).alias("o"), F.col("__i").alias("i"), F.col("__share").alias("share")))).over(Window.partitionBy())["share"]
    return w.withColumn("__level", level).select(*[F.col(c) for c in sizes.columns], F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.coalesce(F.col("__w") * F.col("__level"), (F.lit(cap) * F.col("source_size")).cast("double"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a keyed hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


_UNIT = "struct<u:bigint,a:double,p:double>"


def _fold(units: Column, seed: int) -> Column:
    """Folds [{u, a, p}] by pivotal meetings into {open: at most one unit, done: [{u, a, p in 0, 1}]}."""

    def meet(state: Column, x: Column) -> Column:
        held = state["open"]
        a, p, b, q = held["a"], held["p"], x["a"], x["p"]
        up = F.least(a * (1 - p), b * q)  # words that can go to the held unit
        down = F.least(a * p, b * (1 - q))  # and from it
        draw = uniform(F.xxhash64(held["u"], x["u"]), seed)
        # words +up with chance down / (up + down), else -down: no expectation changes
        gain = draw * (up + down) < down
        p_full, q_empty = up == a * (1 - p), up == b * q
        p_empty, q_full = down == a * p, down == b * (1 - q)
        p2 = F.when(gain, F.when(p_full, F.lit(1.0)).otherwise(p + up / a)).otherwise(F.when(p_empty, F.lit(0.0)).otherwise(p - down / a))
        q2 = F.when(gain, F.when(q_empty, F.lit(0.0)).otherwise(q - up / b)).otherwise(F.when(q_full, F.lit(1.0)).otherwise(q + down / b))
        unit = lambda u, size, prob: F.struct(u.alias("u"), size.alias("a"), prob.alias("p"))
        first, second = unit(held["u"], a, p2), unit(x["u"], b, q2)
        integral = lambda v: (v <= 0) | (v >= 1)
        none = F.lit(None).cast(_UNIT)
        still = F.when(~integral(p2), first).when(~integral(q2), second).otherwise(none)
        settled = F.filter(F.array(first, second), lambda z: (z["p"] <= 0) | (z["p"] >= 1))
        met = F.struct(still.alias("open"), F.concat(state["done"], settled).alias("done"))
        alone = F.struct(F.struct(x["u"].alias("u"), x["a"].alias("a"), x["p"].alias("p")).alias("open"), state["done"].alias("done"))
        return F.when(held.isNull(), alone).otherwise(met)

    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(units, start, meet)


def pivotal(units: DataFrame, seed: int = 17) -> DataFrame:
    """(s, u, taken 0/1) from (s: group, u: unit's hash, a: words > 0, p: probability in (0, 1), k: units of the group)."""
    parts: list[DataFrame] = []
    level = units.select("s", "u", "a", "p", "k")
    for depth in range(LEVELS):
        # a group's rows go to so many buckets that each holds about FAN_IN of them; one bucket ends its tree
        buckets = F.ceil(F.col("k") / F.lit(float(FAN_IN))).cast("long")
        dealt = level.withColumn("n", F.greatest(buckets, F.lit(1))).withColumn("b", F.pmod(F.xxhash64(F.lit(seed + depth), "u"), F.col("n")))
        by_length = F.transform(F.sort_array(F.collect_list(F.struct("a", "u", "p")), asc=False), lambda x: F.struct(x["u"].alias("u"), x["a"].alias("a"), x["p"].alias("p")))
        groups = dealt.groupBy("s", "n", "b").agg(by_length.alias("units"))
        root = F.col("n") == 1
        now = F.filter("units", lambda x, i: root | (i % KEEP != KEEP - 1))
        later = F.filter("units", lambda x, i: ~root & (i % KEEP == KEEP - 1))
        folded = written(groups.select("s", "n", "b", _fold(now, seed + 100 + depth).alias("f"), later.alias("later")), f"mix-{depth}")
        parts.append(folded.select("s", F.explode("f.done").alias("x")).select("s", F.col("x.u").alias("u"), F.col("x.p").cast("int").alias("taken")))
        parts.append(folded.where((F.col("n") == 1) & F.col("f.open").isNotNull()).select("s", F.col("f.open.u").alias("u"), (uniform(F.col("f.open.u"), seed + 999) < F.col("f.open.p")).cast("int").alias("taken")))
        up = F.concat(F.when(F.col("f.open").isNotNull(), F.array("f.open")).otherwise(F.array().cast(f"array<{_UNIT}>")), F.col("later"))
        level = folded.where(F.col("n") > 1).select("s", (F.col("n") * (FAN_IN // KEEP + 1)).alias("k"), F.explode(up).alias("x")).select("s", F.col("x.u").alias("u"), F.col("x.a").alias("a"), F.col("x.p").alias("p"), "k")
        if level.isEmpty():
            break
    else:
        raise ValueError("more units than the reduction tree has levels for")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def mix_units(documents: DataFrame, columns: list[str], weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """Units with source_size, target, ``whole`` copies of each of their ``rows`` and ``extra`` rows that are taken once more.

    Of a unit's rows * p copies the whole part is certain; only a row for the rest goes to the meetings, so that no draw decides about more than one row.
    """
    units = written(sized(documents, columns), "mix-units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("k"))
    goal = written(targets(per_source, weights), "mix-targets")
    s = goal.select(F.col("source").alias("__source"), "source_size", "target", "k")
    joined = units.join(s, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("whole", F.least(F.floor(ratio), F.lit(MAX_COPIES))).withColumn("__p", F.when(F.col("whole") < MAX_COPIES, ratio - F.col("whole")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("__sure", F.floor(F.col("rows") * F.col("__p"))).withColumn("__p", F.col("rows") * F.col("__p") - F.col("__sure"))
    joined = joined.withColumn("u", F.xxhash64("d1", "d2", F.lit(seed)))
    open_units = joined.where((F.col("__p") > 0) & (F.col("size") > 0)).select(F.xxhash64("source", F.col("source").isNull()).alias("s"), "u", F.col("size").cast("double").alias("a"), F.col("__p").alias("p"), "k")
    chosen = pivotal(open_units, seed)
    rounded = joined.join(chosen.select("u", "taken"), "u", "left")
    return written(rounded.withColumn("extra", F.col("__sure") + F.coalesce(F.col("taken"), F.lit(0))).drop("__sure", "__p", "taken", "u", "k"), "mix-copies")


#: Rows that one row spreads out to where it stands; more are dealt to as many tasks first.
SPREAD = 1024


def _spread(df: DataFrame, n: str, keys: list[str], share: str, before: str) -> DataFrame:
    """Rows ``__i`` = 1 .. ``n`` of each row of ``df``: a row that stands for many is cut in pieces of SPREAD, which are dealt out before they spread."""
    few = df.where(F.col(n) <= SPREAD).withColumn(share, F.col(n)).withColumn(before, F.lit(0).cast("long"))
    if not df.where(F.col(n) > SPREAD).isEmpty():
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / F.lit(SPREAD))))
        many = df.where(F.col(n) > SPREAD).withColumn("__piece", pieces)
        many = many.withColumn(before, F.col("__piece") * F.lit(SPREAD)).withColumn(share, F.least(F.lit(SPREAD).cast("long"), F.col(n) - F.col(before)))
        few = few.unionByName(many.repartition(*keys, "__piece").drop("__piece"))
    return few.where(F.col(share) > 0).withColumn("__i", F.explode(F.sequence(F.col(before) + 1, F.col(before) + F.col(share)))).drop(share, before)


def mix_sizes(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies): a row for each row of ``documents``."""
    out = _spread(mix_units(documents, ["doc_id", "source", "text"], weights, seed), "rows", ["d1", "d2"], "__n", "__o")
    copies = (F.col("whole") + (F.col("__i") <= F.col("extra")).cast("int")).cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """``documents`` with every row as often as the mix takes it.

    Rows equal in every column meet in partial aggregates before the one exchange of texts; their copies are spread out behind the join, in pieces on several tasks if there are many.
    Null texts have size 0; a null source is the last one; an empty table stays empty; all columns, whatever their names, come back as they were.
    """
    names = documents.columns
    units = mix_units(documents, names, weights, seed).select("d1", "d2", (F.col("rows") * F.col("whole") + F.col("extra")).cast("long").alias("__copies"))
    rows = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], *identity(names)).dropDuplicates(["d1", "d2"])
    if units.where(F.col("__copies") > SPREAD).isEmpty():
        out = rows.join(units.where(F.col("__copies") > 0), ["d1", "d2"]).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    else:
        # a row with many copies goes to several tasks with a share of them
        out = _spread(written(rows.join(units.where(F.col("__copies") > 0), ["d1", "d2"]), "mix-rows"), "__copies", ["d1", "d2"], "__n", "__o")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
