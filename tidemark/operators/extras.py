"""Additions to the core reads: covering and composite index reads, time-to-live helpers, exact vector search."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, compile_filter
from ..functions.update import Action, Remove, Set
from .read import DocTable


def set_ttl(table: DocTable, expires: float) -> Action:
    """An update action that lets an item expire at a time."""
    return Set(table.schema.ttl_attribute, expires)


def remove_ttl(table: DocTable) -> Action:
    return Remove(table.schema.ttl_attribute)


def get_ttl(table: DocTable, partition_key: Any, sort_key: Any = None) -> float | None:
    """When an item expires; None where it has no such time or there is no item."""
    item = table.get(partition_key, sort_key)
    value = None if item is None else item.get(table.schema.ttl_attribute)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and value else None


def composite_index(table: DocTable, attributes: Sequence[str], values: Sequence[Any], order_by: str | None = None, include: Sequence[str] | None = None) -> DataFrame:
    """Items whose attributes equal the values, ordered by another attribute and the keys.

    include: None for all attributes, a list for keys and those, an empty list for keys only.
    """
    rows = table.visible()
    for name, value in zip(attributes, values, strict=True):
        rows = rows.where(F.col(f"`{name}`") == F.lit(value))
    order = ([F.col(f"`{order_by}`")] if order_by else []) + table.order()
    ordered = rows.orderBy(*order)
    if include is None:
        return ordered
    return ordered.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*table.schema.keys, *include])])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(column: Column, query: Sequence[float], metric: str) -> Column:
    """Similarity (cosine, dot) or distance (euclidean) of an array column to a vector, in doubles."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    wide = F.transform(column, lambda x: x.cast("double"))
    if metric == "dot":
        return _dot(wide, vector)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(wide, vector, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "cosine":
        length = sum(float(x) ** 2 for x in query) ** 0.5
        return _dot(wide, vector) / (F.sqrt(_dot(wide, wide)) * F.lit(length))
    raise ValueError(f"unknown metric: {metric}")


def vector_topk(table: DocTable, attribute: str, query: Sequence[float], k: int, metric: str = "cosine", where: Expr | None = None) -> DataFrame:
    """The k items nearest to a vector, exactly, with ``score``: one scan and a distributed top-k, filter first."""
    rows = table.visible()
    if where is not None:
        rows = rows.where(compile_filter(where, table.resolver))
    scored = rows.where(F.col(f"`{attribute}`").isNotNull()).withColumn("score", similarity(F.col(f"`{attribute}`"), query, metric))
    first = F.col("score").asc() if metric == "euclidean" else F.col("score").desc()
    return scored.orderBy(first, *table.order()).limit(k)
