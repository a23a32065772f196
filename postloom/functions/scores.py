"""Logit and probability arrays with higher-order functions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside per-element lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax in double precision. Null or empty logits give an empty array."""

    def normalized(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return _bind(total, lambda s: F.transform(weights, lambda x: x / s))

    def shifted(top: Column) -> Column:
        return _bind(F.transform(logits, lambda x: F.exp(x.cast("double") - top)), normalized)

    return F.when(F.size(logits) > 0, _bind(F.array_max(logits).cast("double"), shifted)).otherwise(
        F.array().cast("array<double>")
    )


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(probs: Column, k: int = 3) -> Column:
    """``k`` largest as ``(index, prob)``, ties in index order, clipped to the array length."""
    ranked = F.array_sort(
        F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), i.cast("int").alias("index")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda s: F.struct(s["index"].alias("index"), (-s["minus"]).alias("prob"))
    )
