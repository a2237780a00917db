"""Quality rules: a decision list learnt by sequential covering from labelled statistics, applied as one ordered Spark conditional expression.

Each rule is a conjunction of thresholds on a text's statistics (``textstats``). It is grown on two thirds of the labelled rows that no earlier rule covers, one
condition at a time by FOIL's gain for the label 0, and pruned on the other third: conditions are cut from the end while that raises (p - n) / (p + n). A rule that is
right on less than ``min_precision`` of the rows it covers there ends the list. What no rule covers is kept. The rules are plain text and a ``CASE WHEN`` in order.

Learning reads at most about ``max_rows`` labelled rows (a sample by a hash of id and statistics, of a fixed number of statistics each); applying them reads every whole text once.
Parameters of the method bound the list: ``BINS`` thresholds a statistic at each step (all of them where it has no more values), ``max_conditions`` conditions a rule, ``max_rules`` rules.

Defined results: null and empty texts have zero statistics (and fail the base rules); a null id is never a training row; of labels that disagree about an id the more frequent counts, and 0 if none is; repeated rows are judged one by one; without labelled rows of both
classes the list is empty and keeps everything; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import agreed_labels
from .shared import id_remainder, written
from .textstats import COUNTS, RATIOS, text_stats

BINS = 48


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self, ratios: Column) -> Column:
        value = ratios[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{RATIOS[self.feature]} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return "drop if " + " and ".join(map(str, self.conditions))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain of going from (p0, n0) covered rows to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _thresholds(x: np.ndarray) -> np.ndarray:
    values = np.unique(x)
    if len(values) > BINS:
        values = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1), method="lower"))
    return values[:-1]


def grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> Rule:
    """Adds the condition of the largest gain until no good row is covered, or none helps."""
    inside, chosen = np.ones(len(x), bool), []
    while len(chosen) < max_conditions:
        p0, n0 = float((inside & bad).sum()), float((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for f in range(x.shape[1]):
            t = _thresholds(x[inside, f])
            if not len(t):
                continue
            at = np.searchsorted(t, x[inside, f])  # rows <= t[i] have at <= i
            p = np.cumsum(np.bincount(at, weights=bad[inside], minlength=len(t) + 1))[:-1]
            n = np.cumsum(np.bincount(at, weights=~bad[inside], minlength=len(t) + 1))[:-1]
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                g = _gain(a, b, p0, n0)
                i = int(np.argmax(g))
                if g[i] > 1e-9 and (best is None or g[i] > best[0]):
                    best = float(g[i]), Condition(f, above, float(t[i]))
        if best is None:
            break
        chosen.append(best[1])
        inside &= best[1].holds(x)
    return Rule(tuple(chosen))


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n); of equal ones the shortest."""

    def worth(r: Rule) -> float:
        inside = r.holds(x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.conditions[:i]) for i in range(1, len(rule.conditions) + 1)), key=worth, default=rule)


def learn_rules(x: np.ndarray, bad: np.ndarray, max_rules: int = 24, max_conditions: int = 5, min_precision: float = 0.75, min_covered: int = 3, seed: int = 3) -> list[Rule]:
    """The ordered list; x: rows x RATIOS, bad: label 0."""
    third = np.random.default_rng(seed).permutation(len(x)) % 3 == 0
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (left & ~third & bad).any():
        g, v = left & ~third, left & third
        rule = prune(grow(x[g], bad[g], max_conditions), x[v], bad[v])
        if not rule.conditions:
            break
        inside = rule.holds(x)
        p, n = (inside & v & bad).sum(), (inside & v & ~bad).sum()
        if p + n < 1 or (p + 0.0) / (p + n) < min_precision or (inside & left & bad).sum() < min_covered:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def rule_column(rules: list[Rule], ratios: Column) -> Column:
    """The number of the first rule that holds, null if none does: ``CASE WHEN ... THEN 0 WHEN ... THEN 1 ... END``."""
    out: Column | None = None
    for i, r in enumerate(rules):
        holds = r.conditions[0].column(ratios)
        for c in r.conditions[1:]:
            holds = holds & c.column(ratios)
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def fit_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 60_000) -> list[Rule]:
    """Learns from about ``max_rows`` rows of ``stats`` (doc_id, stats_ratios) at most that have a quality label and whose crc32(id) mod 3 is not 1.

    Rows are drawn by a hash of id and statistics, and rows equal in both count once: the copies of an id can't exceed the bound.
    """
    known = agreed_labels(labels, "quality", 3, 1).withColumnRenamed("y", "__y")
    rows = stats.where(F.coalesce(id_remainder("doc_id", 3) != 1, F.lit(False))).withColumn("__h", F.xxhash64("doc_id", "stats_ratios", F.lit(37)))
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id").agg(F.sum("n")).first()[0] or 0
    draw = F.pmod(F.col("__h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.lit(min(1.0, max_rows / max(n, 1)))).dropDuplicates(["doc_id", "__h"])
    found = sample.join(known, "doc_id").select("doc_id", "__y", "stats_ratios").toArrow()
    if not found.num_rows:
        return []
    x = found.column("stats_ratios").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    ids, y = found.column("doc_id").to_numpy(), found.column("__y").to_numpy()
    order = np.lexsort((*x.T[::-1], ids))  # the same rows in the same order, however they arrive
    return learn_rules(x[order], y[order] == 0)


def apply_rules(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, the counts, base_failed, rule, kept) of every row of ``documents``, and the rules."""
    stats = written(text_stats(documents, ["doc_id"]), "rule-stats")
    rules = fit_rules(stats.select("doc_id", "stats_ratios"), labels)
    out = stats.select("doc_id", *[F.col("stats_counts")[i].alias(c) for i, c in enumerate(COUNTS)], rule_column(rules, F.col("stats_ratios")).alias("rule"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
