"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its share of the target, divided by what it holds. Each document's number
of copies is the inverse of the Poisson distribution function with that mean at a uniform number hashed from the
seed and the document's id; a document is exploded by that number, and all copies are shuffled globally by a hash.

Scale: one small aggregate over (listed) sources, then a narrow stage and one shuffle by a hash of document and copy,
so a source with a third of all rows spreads over all tasks. The only data that goes to the driver is one row for each
source that the weights list, and one for all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import free_name, shuffle_partitions, table

SEED = 17
# Production weights for the query: the source that holds a third of all rows is brought down to 10 %.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.08}
OTHER_WEIGHT = 0.58
UNIT = 2**-52


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of an MD5 (which every SQL engine has)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(UNIT)


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """(k0, [P(X <= k0), P(X <= k0 + 1), ...]) up to 1 - 2**-53; below k0 the function is under 2**-53."""
    if rate <= 0:
        return 0, []
    spread = 12 * math.sqrt(rate) + 30
    low, high = max(0, int(rate - spread)), int(rate + spread) + 2
    steps, total, k0 = [], 0.0, low
    for k in range(low, high):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if not steps and total < 2**-53:
            k0 = k + 1
            continue
        steps.append(min(total, 1.0))
        if total >= 1 - 2**-53:
            break
    return k0, steps


def copies(u: Column, rate: float) -> Column:
    """How many copies: the smallest k with u < P(X <= k)."""
    k0, steps = poisson_steps(rate)
    if not steps:
        return F.lit(0)
    return F.lit(k0) + F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= u))


def mix_sources(docs: DataFrame, weights: dict[str, float], other_weight: float, *, target_rows: float | None = None, source_col: str = "source", id_col: str = "doc_id", seed: int = SEED, copy_name: str = "copy", key_name: str = "mix_key") -> DataFrame:
    """``docs`` with each row repeated, plus the number of the copy (from 0) and its place in the global order.

    ``weights``: shares of the listed sources; ``other_weight``: of all other sources together, null ones included
    (they share one rate). Shares are normalised over the sources that hold rows, and sum to ``target_rows`` (default:
    as many as ``docs`` has). A row with a null id counts as one with the id "null"; repeated rows get the same number
    of copies each. Text, empty, null or long, does not matter. If ``docs`` has a column of the name of a new one, the
    new one gets underscores in front. An empty table gives an empty result.
    """
    if any(w < 0 for w in [*weights.values(), other_weight]):
        raise ValueError("weights must not be negative")
    listed = list(weights)
    slot = F.lit(-1)
    for i, s in enumerate(listed):
        slot = F.when(F.col(f"`{source_col}`") == s, i).otherwise(slot)
    held = {r[0]: r[1] for r in docs.groupBy(slot.alias("slot")).count().collect()}  # a row for each listed source, and one
    share = {i: (other_weight if i < 0 else weights[listed[i]]) for i in held}
    total, rows = sum(share.values()), target_rows if target_rows is not None else sum(held.values())
    rates = {i: (rows * w / total / held[i] if total > 0 else 0.0) for i, w in share.items()}
    copy, key = free_name(docs, copy_name), free_name(docs, key_name)
    n = F.lit(0)
    for i, rate in rates.items():
        n = F.when(slot == i, copies(uniform(F.col(f"`{id_col}`"), seed), rate)).otherwise(n)
    out = docs.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias(copy))
    out = out.withColumn(key, F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col(copy).cast("string"))))
    # The key is uniform, so its first digits deal the rows out evenly in the global order; no sample of keys is drawn.
    n = shuffle_partitions(docs.sparkSession)
    part = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * F.lit(n * 2.0**-32)).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions(key)


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: documents mixed to the production weights, in global order (texts travel along as their lengths and hashes
    are asked of the shuffled rows)."""
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, OTHER_WEIGHT)


def _values(rows) -> str:
    return ", ".join(f"({a!r}, {b!r})" for a, b in rows)


OP2_SQL = f"""
WITH weights(slot, weight) AS (VALUES {_values([*WEIGHTS.items(), ("", OTHER_WEIGHT)])}),
d AS (SELECT *, CASE WHEN source IN ({", ".join(repr(s) for s in WEIGHTS)}) THEN source ELSE '' END AS slot,
        CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) * {UNIT!r}::DOUBLE AS u FROM documents),
held AS (SELECT slot, count(*) AS n FROM d GROUP BY slot),
rates AS (SELECT slot, (SELECT sum(n) FROM held) * weight::DOUBLE / (SELECT sum(weight::DOUBLE) FROM held JOIN weights USING (slot)) / n AS rate FROM held JOIN weights USING (slot)),
steps AS (SELECT slot, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY slot ORDER BY k) AS p
          FROM rates, range(0, CAST((SELECT max(rate) + 12 * sqrt(max(rate)) + 32 FROM rates) AS BIGINT)) t(k)),
copies AS (SELECT d.*, (SELECT count(*) FROM steps WHERE steps.slot = d.slot AND steps.p <= d.u AND steps.p < 1 - 1e-15) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy) AS mix_key
FROM copies, LATERAL (SELECT unnest(range(0, n)) AS copy)
"""
