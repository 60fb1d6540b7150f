"""Scores of outside judges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_quality(logits: Column, missing: float = 3.0) -> Column:
    """The mean of 1 to 6 under the softmax of six logits; ``missing`` if there are not six finite ones."""
    fit = (F.size(logits) == 6) & ~F.exists(logits, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    weight = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = add(F.transform(weight, lambda x, i: x * (i + 1))) / add(weight)
    return F.when(F.coalesce(fit, F.lit(False)), mean).otherwise(F.lit(missing))


def sort_keys(text: str) -> list[str]:
    """Names of score columns from one text, split at the first kind of sign it has: comma, full stop or plus."""
    for sign in ",.+":
        if sign in text:
            return [k.strip() for k in text.split(sign) if k.strip()]
    return [text.strip()] if text.strip() else []
