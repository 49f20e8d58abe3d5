"""Paths and literals as values the filter compiler can compare.

A resolved value answers, for each kind (num, str, bool), with a Column of that kind or None where it can't be of
it, says when it is null, and compares itself. Over typed columns the kind is known from the schema, so mismatches
fold away and comparisons stay in the column's own type; over a VARIANT each kind is guarded at run time.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = (-(2**63), 2**63 - 1)


class Value:
    attribute = False

    def typed(self, kind: str, other: Value) -> Column | bool | None:
        return None

    def null(self) -> Column | bool:
        return False

    def order(self, kind: str, op: str, other: Value) -> Column | bool | None:
        """self op other for one kind, or None where either can't be of it."""
        x, y = self.typed(kind, other), other.typed(kind, self)
        if x is None or y is None:
            return None
        if isinstance(x, bool) or isinstance(y, bool):
            return self._bounded(op, other)
        return {"Lt": x < y, "Le": x <= y, "Gt": x > y, "Ge": x >= y}[op]

    def _bounded(self, op: str, other: Value) -> Column | bool:
        """An integral column against a literal that isn't of its type."""
        flip = {"Lt": "Gt", "Le": "Ge", "Gt": "Lt", "Ge": "Le"}
        if isinstance(self, Literal):
            return other._bounded(flip[op], self)
        number = other.value
        column = self.typed("num", self)
        if number > _LONG[1] or number < _LONG[0]:
            return column.isNotNull() if (op in ("Lt", "Le")) == (number > 0) else F.lit(False)
        whole = math.floor(number)
        return column <= F.lit(whole) if op in ("Lt", "Le") else column > F.lit(whole)

    def begins(self, prefix: str) -> Column | bool:
        return False

    def contains(self, wanted: Any) -> Column | bool:
        return False


class Literal(Value):
    def __init__(self, value: Any):
        self.value = value

    def typed(self, kind: str, other: Value) -> Column | bool | None:
        v = self.value
        if kind == "bool" and isinstance(v, bool):
            return F.lit(v)
        if kind == "str" and isinstance(v, str):
            return F.lit(v)
        if kind == "num" and isinstance(v, (int, float)) and not isinstance(v, bool):
            if getattr(other, "integral", False):
                if isinstance(v, float) and (not math.isfinite(v) or v != math.floor(v)) or not _LONG[0] <= v <= _LONG[1]:
                    return False
                return F.lit(int(v))
            return F.lit(float(v))
        return None

    def null(self) -> bool:
        return self.value is None

    def begins(self, prefix: str) -> bool:
        return isinstance(self.value, str) and self.value.startswith(prefix)

    def contains(self, wanted: Any) -> bool:
        from .expr import same

        if isinstance(self.value, str) and isinstance(wanted, str):
            return wanted in self.value
        return isinstance(self.value, list) and any(same(x, wanted) for x in self.value)


class Missing(Value):
    """A path that the schema doesn't have."""

    attribute = True

    def null(self) -> bool:
        return True


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


class TypedAttribute(Value):
    attribute = True

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.type = column, kind
        self.integral = isinstance(kind, _INTEGRAL)

    def typed(self, kind: str, other: Value) -> Column | None:
        if kind == "num" and isinstance(self.type, _NUMERIC):
            return self.column
        if kind == "str" and isinstance(self.type, (T.StringType, T.CharType, T.VarcharType)):
            return self.column
        if kind == "bool" and isinstance(self.type, T.BooleanType):
            return self.column
        return None

    def null(self) -> Column:
        return self.column.isNull()

    def begins(self, prefix: str) -> Column | bool:
        return self.column.startswith(prefix) if isinstance(self.type, T.StringType) else False

    def contains(self, wanted: Any) -> Column | bool:
        if isinstance(self.type, T.StringType):
            return F.contains(self.column, F.lit(wanted)) if isinstance(wanted, str) else False
        if not isinstance(self.type, T.ArrayType):
            return False
        element = self.type.elementType
        if wanted is None:
            return F.exists(self.column, lambda x: x.isNull())
        if isinstance(wanted, bool):
            fits = isinstance(element, T.BooleanType)
        elif isinstance(wanted, int):
            fits = isinstance(element, _INTEGRAL) and _LONG[0] <= wanted <= _LONG[1]
        elif isinstance(wanted, float):
            fits = isinstance(element, (T.FloatType, T.DoubleType))
        elif isinstance(wanted, str):
            fits = isinstance(element, T.StringType)
        else:
            text = json.dumps(wanted, sort_keys=False, separators=(",", ":"))
            return F.exists(self.column, lambda x: F.to_json(x) == text) if isinstance(element, (T.StructType, T.ArrayType, T.MapType)) else False
        return F.array_contains(self.column, wanted) if fits else False


class TypedResolver:
    """Paths over a DataFrame's columns; json_columns gives the type of JSON text columns that paths may enter."""

    def __init__(self, df: DataFrame, json_columns: dict[str, str] | None = None):
        self.schema, self.json = df.schema, json_columns or {}

    def attribute(self, path: str) -> Value:
        first, *rest = path.split(".")
        if first not in self.schema.names:
            return Missing()
        column, kind = F.col(f"`{first}`"), self.schema[first].dataType
        if rest and first in self.json:
            kind = T.StructType.fromDDL(self.json[first])
            column = F.from_json(column, kind)
        for part in rest:
            if isinstance(kind, T.StructType) and part in kind.names:
                column, kind = column.getField(part), kind[part].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
            else:
                return Missing()
        if isinstance(kind, T.VariantType):
            return VariantAttribute(column)
        return TypedAttribute(column, kind)

    def literal(self, value: Any) -> Value:
        return Literal(value)


class VariantAttribute(Value):
    """A value inside a VARIANT, of a kind known at run time only."""

    attribute = True

    def __init__(self, column: Column):
        self.column = column
        self.kind = F.schema_of_variant(column)

    def _when(self, test: Column, kind: str) -> Column:
        return F.when(test, F.try_variant_get(self.column, "$", kind))

    def typed(self, kind: str, other: Value) -> Column:
        if kind == "num":
            return self._when(self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "double")
        if kind == "str":
            return self._when(self.kind == "STRING", "string")
        return self._when(self.kind == "BOOLEAN", "boolean")

    def null(self) -> Column:
        return self.column.isNull() | F.coalesce(F.is_variant_null(self.column), F.lit(True))

    def begins(self, prefix: str) -> Column:
        return self.typed("str", self).startswith(prefix)

    def contains(self, wanted: Any) -> Column:
        items = F.when(self.kind.startswith("ARRAY"), F.try_variant_get(self.column, "$", "array<variant>"))
        found = F.exists(items, lambda x: _variant_same(x, wanted))
        if isinstance(wanted, str):
            return F.coalesce(F.contains(self.typed("str", self), F.lit(wanted)), F.lit(False)) | F.coalesce(found, F.lit(False))
        return found


def _variant_same(x: Column, wanted: Any) -> Column:
    """Deep equality of a variant with a JSON value; whole and fractional numbers differ by kind."""
    kind = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(x, "$", "boolean") == wanted, F.lit(False))
    if isinstance(wanted, str):
        return (kind == "STRING") & F.coalesce(F.try_variant_get(x, "$", "string") == wanted, F.lit(False))
    if isinstance(wanted, int):
        return (kind == "BIGINT") & F.coalesce(F.try_variant_get(x, "$", "bigint") == F.lit(wanted), F.lit(False))
    if isinstance(wanted, float):
        return kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & F.coalesce(F.try_variant_get(x, "$", "double") == F.lit(wanted), F.lit(False))
    return F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def variant_at(column: Column, parts: list[str]) -> Column:
    """The variant inside a variant. Names that Spark's variant paths can't spell are looked up in a map instead."""
    steps = "$"
    for part in parts:
        if re.fullmatch(r"[^'?]+", part):
            steps += f"['{part}']"
            continue
        column = F.try_element_at(F.try_variant_get(column, steps, "map<string,variant>"), F.lit(part))
        steps = "$"
    return column if steps == "$" else F.try_variant_get(column, steps, "variant")


class VariantResolver:
    """Paths into one VARIANT column."""

    def __init__(self, column: str = "doc"):
        self.column = column

    def attribute(self, path: str) -> Value:
        return VariantAttribute(variant_at(F.col(self.column), path.split(".")))

    def literal(self, value: Any) -> Value:
        return Literal(value)
