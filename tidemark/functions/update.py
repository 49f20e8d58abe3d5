"""Partial updates: SET, REMOVE, ADD and DELETE, over single documents and over typed columns."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import InvalidUpdateAction, KeyAttributeUpdate, UpdateTypeMismatch
from .expr import same


@dataclass(frozen=True)
class Action:
    op: str  # set, remove, add or delete
    path: str
    value: Any = None


def Set(path: str, value: Any) -> Action:
    return Action("set", path, value)


def Remove(path: str) -> Action:
    return Action("remove", path)


def Add(path: str, value: Any) -> Action:
    return Action("add", path, value)


def Delete(path: str, value: Any) -> Action:
    return Action("delete", path, value)


def from_wire(actions: Sequence[dict]) -> list[Action]:
    """Actions of the wire form {"action", "path", "value"}."""
    out = []
    for a in actions:
        op = a.get("action")
        if op not in ("set", "remove", "add", "delete"):
            raise InvalidUpdateAction(f"unknown update action: {op}")
        if op != "remove" and "value" not in a:
            raise InvalidUpdateAction(f"{op} needs a value")
        out.append(Action(op, a["path"], a.get("value")))
    return out


def check_keys(actions: Sequence[Action], keys: Sequence[str]) -> None:
    for a in actions:
        if a.path.split(".")[0] in keys:
            raise KeyAttributeUpdate(f"cannot update key attribute: {a.path.split('.')[0]}")


# --- single documents ---


def _parent(doc: dict, path: str, create: bool) -> tuple[dict | None, str]:
    *parts, last = path.split(".")
    for part in parts:
        if part not in doc:
            if not create:
                return None, last
            doc[part] = {}
        doc = doc[part]
        if not isinstance(doc, dict):
            return None, last
    return doc, last


def _mismatch(path: str, message: str) -> UpdateTypeMismatch:
    return UpdateTypeMismatch(f"type mismatch for update action on '{path}': {message}")


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def apply(doc: dict, actions: Sequence[Action]) -> dict:
    """A new document with the actions applied in order."""
    doc = copy.deepcopy(doc)
    for a in actions:
        if a.op == "set":
            at, name = _parent(doc, a.path, True)
            if at is not None:
                at[name] = copy.deepcopy(a.value)
        elif a.op == "remove":
            at, name = _parent(doc, a.path, False)
            if at is not None:
                at.pop(name, None)
        elif a.op == "add":
            _add(doc, a)
        else:
            _delete(doc, a)
    return doc


def _add(doc: dict, a: Action) -> None:
    if not _is_number(a.value) and not isinstance(a.value, list):
        raise _mismatch(a.path, "ADD takes a number or an array")
    at, name = _parent(doc, a.path, True)
    if at is None:
        return
    if name not in at:
        at[name] = copy.deepcopy(a.value)
    elif _is_number(at[name]) and _is_number(a.value):
        at[name] = float(at[name]) + float(a.value)
    elif isinstance(at[name], list) and isinstance(a.value, list):
        for x in a.value:
            if not any(same(x, y) for y in at[name]):
                at[name].append(copy.deepcopy(x))
    else:
        raise _mismatch(a.path, "ADD needs a number on a number or an array on an array")


def _delete(doc: dict, a: Action) -> None:
    if not isinstance(a.value, list):
        raise _mismatch(a.path, "DELETE takes an array")
    at, name = _parent(doc, a.path, False)
    if at is None or name not in at:
        return
    if not isinstance(at[name], list):
        raise _mismatch(a.path, "DELETE needs an array")
    left = [y for y in at[name] if not any(same(x, y) for x in a.value)]
    if left:
        at[name] = left
    else:
        del at[name]


# --- typed columns ---


def apply_columns(df: DataFrame, actions: Sequence[Action], keys: Sequence[str] = ()) -> DataFrame:
    """df with the actions applied to every row, in order. A new top-level attribute becomes a column.

    ADD on a number gives a double where a value was and keeps the operand where none was; as a column has one type,
    both are doubles here. Intermediate structs are rebuilt; a missing one is created by SET.
    """
    check_keys(actions, keys)
    for a in actions:
        first, *rest = a.path.split(".")
        known = first in df.columns
        kind = df.schema[first].dataType if known else None
        column = F.col(f"`{first}`") if known else None
        if rest:
            made = _nested(column, kind, rest, a)
        else:
            made = _changed(column, kind, a)
        if made is not None:
            df = df.withColumn(first, made)
    return df


def _literal(value: Any) -> Column:
    if isinstance(value, list):
        return F.array(*map(_literal, value))
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    return F.lit(value)


def _holds(items: Column, wanted: Column) -> Column:
    """Whether an array holds a value; a null is a value like any other."""
    return F.exists(items, lambda y: y.eqNullSafe(wanted))


def _changed(column: Column | None, kind: T.DataType | None, a: Action) -> Column | None:
    """The new value of an attribute; None: no change."""
    if a.op == "set":
        value = _literal(a.value)
        return value.cast(kind) if kind is not None and a.value is None else value
    if a.op == "remove":
        return None if column is None else F.lit(None).cast(kind)
    if a.op == "add":
        if _is_number(a.value):
            if column is None:
                return F.lit(a.value)
            if not isinstance(kind, T.NumericType):
                raise _mismatch(a.path, "ADD needs a number on a number")
            return F.coalesce(column.cast("double") + F.lit(float(a.value)), F.lit(float(a.value)))
        if not isinstance(a.value, list):
            raise _mismatch(a.path, "ADD takes a number or an array")
        if column is None:
            return _literal(a.value)
        if not isinstance(kind, T.ArrayType):
            raise _mismatch(a.path, "ADD needs an array on an array")
        new = _literal(a.value).cast(kind)
        return F.when(column.isNull(), new).otherwise(F.concat(column, F.filter(F.array_distinct(new), lambda x: ~_holds(column, x))))
    if not isinstance(a.value, list):
        raise _mismatch(a.path, "DELETE takes an array")
    if column is None:
        return None
    if not isinstance(kind, T.ArrayType):
        raise _mismatch(a.path, "DELETE needs an array")
    gone = _literal(a.value).cast(kind)
    left = F.filter(column, lambda x: ~_holds(gone, x))
    return F.when(F.size(left) > 0, left)


def _nested(column: Column | None, kind: T.DataType | None, path: list[str], a: Action) -> Column | None:
    """A struct with one field inside it changed."""
    if kind is not None and not isinstance(kind, T.StructType):
        return None  # an intermediate that is no object: the action is ignored
    if kind is None and a.op in ("remove", "delete"):
        return None
    name, *rest = path
    fields = {} if kind is None else {f.name: column.getField(f.name) for f in kind.fields}
    inner_kind = kind[name].dataType if kind is not None and name in fields else None
    inner = fields.get(name)
    made = _nested(inner, inner_kind, rest, a) if rest else _changed(inner, inner_kind, a)
    if made is None:
        return None
    fields[name] = made
    rebuilt = F.struct(*[c.alias(n) for n, c in fields.items()])
    if column is not None and a.op in ("remove", "delete"):
        return F.when(column.isNotNull(), rebuilt)
    return rebuilt
