"""Quality rules: a learned decision list over text statistics.

Sequential covering on labelled documents: a rule, a conjunction of thresholds, is grown on two thirds of them until
it covers no good document, condition by condition by information gain, then pruned from its end on the other third;
what it covers is set aside and the next rule is learned. The list becomes one Spark ``CASE`` expression in rule order.

Scale: the list is learned from a bounded sample; every text is then read once, whole, in one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import table
from hyperweave.llm.labelled import FEATURES, feature_column, labelled_sample, with_stats

MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION, THRESHOLDS = 16, 4, 8, 0.95, 48


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        v = feature_column(self.feature)
        return v >= self.threshold if self.above else v < self.threshold


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (on & ~bad).any() and (on & bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, name in enumerate(FEATURES):
            v = x[on, j]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS)[1:], method="nearest"))
            order = np.argsort(v, kind="stable")
            b = np.concatenate([[0], np.cumsum(bad[on][order])])
            at = np.searchsorted(v[order], cuts)
            for above in (True, False):
                p = (p0 - b[at]) if above else b[at]
                n = (len(v) - at - p) if above else (at - p)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return rule


def learn_decision_list(x: np.ndarray, label: np.ndarray) -> list[list[Condition]]:
    """Rules that reject, in order; a document that none covers is kept. Deterministic."""
    bad = label == 0
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        rule = _grow(x[left & ~part], bad[left & ~part])
        xs, ys = x[left & part], bad[left & part]

        def worth(r: list[Condition]) -> float:
            on = _covers(r, xs)
            return (2 * ys[on].sum() - on.sum()) / on.sum() if on.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        on = _covers(rule, x) & left if rule else np.zeros(len(x), bool)
        if on.sum() < MIN_COVER or bad[on].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~on
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """True where the list keeps: a conditional expression over the statistics, first rule first."""
    out = None
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond &= c.column()
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed, kept) of each document.

    A null or empty text has no words and fails the base rules; so its verdict is not asked. A null id stays null;
    repeated rows stay repeated; other columns of ``docs`` are not read. Without labels only the base rules decide.
    Very long texts are read whole. An empty table gives an empty result.
    """
    keeps = as_column(learn_decision_list(*labelled_sample(docs, labels, "quality")))
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return with_stats(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(keeps))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: statistics and verdict of all documents."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
