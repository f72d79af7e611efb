"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; shallow trees over one feature at a time are boosted in turn, round after round, and
add up to one lookup table for each feature. Then the pairs whose coarse grid explains most of what is left get
tables of their own, boosted likewise by trees with one cut on each side. A document's score is the logistic function
of the intercept and the table entries of its bins, which is a vectorised addition.

Scale: fitted on a bounded sample of labelled rows; every text is then read once, whole, in one narrow stage, with
tables of a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm import textkernel
from hyperweave.llm.common import free_name, parts, table, trimmed
from hyperweave.llm.labelled import feature_matrix, labelled_sample

BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 32, 8, 150, 60, 6, 0.1, 2.0
THRESHOLD = 0.7


@dataclass
class Gam:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (cuts, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best single cut."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + L2) + (g.sum() - gl) ** 2 / (h.sum() - hl + L2) - g.sum() ** 2 / (h.sum() + L2)
    i = int(gain.argmax())
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin, of a tree with at most three leaves."""
    parts, cut = [(0, len(g))], None
    for _ in range(2):
        options = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, cut, a, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut on each side of a pair's grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((gs**2 / (hs + L2)).sum())
            if gain > best:
                best, at = gain, (i + 1, j + 1, gs / (hs + L2))
    out = np.zeros_like(g)
    if at:
        i, j, v = at
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Deterministic. Without both labels the score is the labels' mean, or 1 where there is none at all."""
    features = x.shape[1]
    cuts = [_cuts(x[:, j], BINS) if len(x) else np.empty(0) for j in range(features)]
    coarse = [_cuts(x[:, j], PAIR_BINS) if len(x) else np.empty(0) for j in range(features)]
    model = Gam(0.0, cuts, [np.zeros(len(c) + 1) for c in cuts], [], coarse, [])
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
    model.intercept = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
    z = np.full(len(x), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(features):
            n = len(cuts[j]) + 1
            if n > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
                model.tables[j] += step
                z += step[bins[j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        g, h = slopes()
        both = fine[i] * shape[1] + fine[j]
        return np.bincount(both, g, shape[0] * shape[1]).reshape(shape), np.bincount(both, h, shape[0] * shape[1]).reshape(shape)

    able = [j for j in range(features) if len(coarse[j])]
    gains = sorted(((-_quadrants(*grid(i, j))[0], i, j) for i, j in combinations(able, 2)))[:PAIRS]
    model.pairs = [(i, j) for _, i, j in gains]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            step = RATE * _quadrants(*grid(i, j))[1]
            t += step
            z += step[fine[i], fine[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> Gam:
    return fit(*labelled_sample(docs, labels, "quality", keep))


def add_score(docs: DataFrame, model: Gam, name: str = "score", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only ``columns`` of it) with the score of each whole text; a null text is scored as an empty one.

    No row is dropped; repeated rows stay; nulls in other columns stay. The name must be free in ``docs``. Very long
    texts are read whole. An empty table gives an empty result.
    """
    columns = docs.columns if columns is None else columns
    text = free_name(docs, "__text")
    took = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                score = model.score(feature_matrix(textkernel.text_stats(part.column(part.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[*columns, name])

    schema = took.select(*[F.col(f"`{c}`") for c in columns]).schema.add(name, "double")
    return took.mapInArrow(trimmed(run), schema)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: Column | None = None) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they are."""
    name = free_name(docs, "__score")
    return add_score(docs, learn(docs, labels, keep), name).where(F.col(name) >= threshold).drop(name)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: score of all documents, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = add_score(docs, learn(docs, labels, ~held_out), columns=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
