"""Exact quantiles with linear interpolation, at any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
Here the same exact values come from narrowing: sketches bracket each wanted
rank, counts confirm the bracket, and the scan is repeated inside the bracket
until few values are left.  Each pass is one map-side aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT_VALUES = 20_000
SKETCH_SIZE = 16_000
RANK_ERROR = 0.0005


def sketched(value: Column, probabilities: list[float], size: int) -> Column:
    """Approximate quantiles from a mergeable sketch; null without values."""
    sketch = F.kll_sketch_agg_double(value, F.lit(size))
    wanted = F.array(*[F.lit(p) for p in probabilities])
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, wanted))


@dataclass
class _Target:
    """A wanted rank and the values between which it lies."""

    name: str
    slot: int
    rank: float
    low: float
    high: float
    outer: tuple[float, float]
    pad: float


def narrowed(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: list[float],
    keep: int = KEPT_VALUES,
    size: int = SKETCH_SIZE,
    error: float = RANK_ERROR,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several value expressions over one table.

    ``values`` must be double expressions without NaN (null where missing).
    """
    names = list(values)
    pad = 2 * error
    around = [x for p in probabilities for x in (max(0.0, p - pad), min(1.0, p + pad))]
    first = df.agg(*[
        c
        for i, n in enumerate(names)
        for c in (
            F.count(values[n]).alias(f"n{i}"), F.min(values[n]).alias(f"lo{i}"), F.max(values[n]).alias(f"hi{i}"),
            sketched(values[n], around, size).alias(f"s{i}"))
    ]).first()
    result: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names}
    targets = []
    for i, name in enumerate(names):
        for k, p in enumerate(probabilities):
            if first[f"n{i}"]:
                low, high = first[f"s{i}"][2 * k : 2 * k + 2]
                outer = (first[f"lo{i}"], first[f"hi{i}"])
                targets.append(_Target(name, k, p * (first[f"n{i}"] - 1), low, high, outer, pad))
    while targets:
        targets = _narrow(df, values, targets, result, keep, size)
    return result


def _narrow(df, values, targets: list[_Target], result, keep: int, size: int) -> list[_Target]:
    """Confirm the brackets by counting; answer, narrow or reopen each of them."""
    checks = []
    for i, t in enumerate(targets):
        v = values[t.name]
        checks += [
            F.count_if(v < t.low).alias(f"below{i}"),
            F.count_if(v <= t.high).alias(f"upto{i}"),
            F.count_if((v > t.low) & (v < t.high)).alias(f"inside{i}"),
        ]
    seen = df.agg(*checks).first()
    wanted, answers, following, brackets = [], [], [], []
    for i, t in enumerate(targets):
        below, held = seen[f"below{i}"], seen[f"upto{i}"] - seen[f"below{i}"]
        if not (below <= math.floor(t.rank) and math.ceil(t.rank) < seen[f"upto{i}"]):
            following.append(replace(t, low=t.outer[0], high=t.outer[1], pad=t.pad * 4))
            continue
        if t.low == t.high:
            result[t.name][t.slot] = t.low
            continue
        v = values[t.name]
        bracket = (v >= t.low) & (v <= t.high)
        within = F.when(bracket, v)
        brackets.append(bracket)
        share = min(1.0, max(0.0, (t.rank - below) / max(1, held - 1)))
        if seen[f"inside{i}"] <= keep:
            answers.append(t)
            wanted.append(F.percentile(within, share).alias(f"a{len(answers) - 1}"))
        else:
            ends = [max(0.0, share - t.pad), min(1.0, share + t.pad)]
            wanted.append(sketched(within, ends, size).alias(f"s{len(following)}"))
            following.append(replace(t, outer=(t.low, t.high)))
    if wanted:
        # Few rows lie in a bracket; the others leave before the aggregate.
        found = df.filter(reduce(Column.__or__, brackets)).agg(*wanted).first().asDict()
        for j, t in enumerate(answers):
            result[t.name][t.slot] = found[f"a{j}"]
        for j, t in enumerate(following):
            if f"s{j}" in found:
                t.low, t.high = found[f"s{j}"]
    return following
