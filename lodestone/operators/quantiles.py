"""Exact quantiles of a column of any length.

A single exact-percentile aggregate holds all distinct values in one task. Here approximate quantiles only bracket the
order statistics that are asked for; counting tells exactly which bracket holds each, and brackets are narrowed until
what is in them is few values. Two passes a round; a round cuts a bracket to about a thousandth.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values of all brackets that the driver takes, with their counts.
KEEP = 50_000


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], keep: int = KEEP) -> list[float] | None:
    """Linearly interpolated quantiles of the values that are neither null nor NaN; None if there are none."""
    x = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, low, high = x.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    ranks = sorted({r for s in shares for r in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})
    known: dict[int, float] = {}
    brackets = [(low, high, 0, n)]  # values from low to high, rows below low, rows inside
    while brackets:
        inside = x.filter(reduce(lambda a, b: a | b, (F.col("v").between(lo, hi) for lo, hi, _, _ in brackets)))
        few = inside.groupBy("v").agg(F.count("*").alias("c")).limit(keep + 1).collect()
        if len(few) <= keep:
            few.sort()
            for lo, hi, below, _ in brackets:
                for v, c in few:
                    if lo <= v <= hi:
                        known |= {r: v for r in ranks if below <= r < below + c}
                        below += c
            break
        cuts = set()
        for lo, hi, below, m in brackets:
            wanted = sorted({min(1.0, max(0.0, (r - below + d) / m)) for r in ranks if below <= r < below + m for d in (-m / 1000, m / 1000)})
            got = x.filter(F.col("v").between(lo, hi)).agg(F.percentile_approx("v", wanted, 10_000)).first()[0]
            cuts |= {lo, hi, *got}
        edges = sorted(cuts)
        counted = x.agg(*(F.count_if(F.col("v") < e) for e in edges), *(F.count_if(F.col("v") <= e) for e in edges)).first()
        under, upto = counted[: len(edges)], counted[len(edges) :]
        for e, a, b in zip(edges, under, upto, strict=True):
            known |= {r: e for r in ranks if a <= r < b}
        left = [r for r in ranks if r not in known]
        brackets = [(a, b, under[i], upto[i + 1] - under[i]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if any(upto[i] <= r < under[i + 1] for r in left)]
    out = []
    for s in shares:
        h = s * (n - 1)
        a, b = known[int(h)], known[min(int(h) + 1, n - 1)]
        out.append(a + (b - a) * (h - int(h)))
    return out


def median(df: DataFrame, column: str) -> Column:
    """The exact median as a value, null without any."""
    found = exact_quantiles(df, f"`{column}`", [0.5])
    return F.lit(found[0] if found else None).cast("double")
