"""The filter algebra: its nodes, their JSON form, an interpreter for single documents and a compiler to Columns.

Logic has two values. A missing path is null; values of different kinds don't compare, so every comparison of them
is false and ``Ne`` is true; null equals null. Where a condition stands positively, SQL's null and false mean the
same and plain comparisons are emitted, which Parquet can use; under ``Not`` null-safe forms are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MAX_DEPTH, InvalidExpression

COMPARISONS = ("Eq", "Ne", "Lt", "Le", "Gt", "Ge")


@dataclass(frozen=True)
class Expr:
    """A node: its operator and arguments (nodes, JSON values or strings, as the operator asks)."""

    op: str
    args: tuple

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


def _node(op: str) -> Callable[..., Expr]:
    return lambda *args: Expr(op, args)


def _operand(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


Attr, Literal = _node("Attr"), _node("Literal")
AttributeExists, AttributeNotExists = _node("AttributeExists"), _node("AttributeNotExists")
And, Or, Not = _node("And"), _node("Or"), _node("Not")


def _comparison(op: str) -> Callable[[Any, Any], Expr]:
    return lambda a, b: Expr(op, (_operand(a), _operand(b)))


Eq, Ne, Lt, Le, Gt, Ge = map(_comparison, COMPARISONS)


def Between(e: Any, low: Any, high: Any) -> Expr:
    return Expr("Between", (_operand(e), _operand(low), _operand(high)))


def BeginsWith(e: Any, prefix: str) -> Expr:
    return Expr("BeginsWith", (_operand(e), prefix))


def Contains(e: Any, value: Any) -> Expr:
    return Expr("Contains", (_operand(e), value))


# --- JSON form: {"Gt": [{"Attr": "age"}, {"Literal": 25}]} ---

_ONE = ("Attr", "Literal", "AttributeExists", "AttributeNotExists")


def to_json(e: Expr) -> dict:
    if e.op in _ONE:
        return {e.op: e.args[0]}
    if e.op == "Not":
        return {"Not": to_json(e.args[0])}
    return {e.op: [to_json(a) if isinstance(a, Expr) else a for a in e.args]}


def from_json(d: Any) -> Expr:
    if not isinstance(d, dict) or len(d) != 1:
        raise InvalidExpression(f"an expression is an object with one operator: {d!r}")
    (op, value), = d.items()
    if op in ("Attr", "AttributeExists", "AttributeNotExists"):
        if not isinstance(value, str):
            raise InvalidExpression(f"{op} takes a path")
        return Expr(op, (value,))
    if op == "Literal":
        return Expr(op, (value,))
    if op == "Not":
        return Expr(op, (from_json(value),))
    if not isinstance(value, list):
        raise InvalidExpression(f"{op} takes a list")
    if op in ("And", "Or"):
        return Expr(op, tuple(map(from_json, value)))
    if op in COMPARISONS and len(value) == 2:
        return Expr(op, tuple(map(from_json, value)))
    if op == "Between" and len(value) == 3:
        return Expr(op, tuple(map(from_json, value)))
    if op == "BeginsWith" and len(value) == 2 and isinstance(value[1], str):
        return Expr(op, (from_json(value[0]), value[1]))
    if op == "Contains" and len(value) == 2:
        return Expr(op, (from_json(value[0]), value[1]))
    raise InvalidExpression(f"unknown operator or wrong number of arguments: {op}")


# --- interpreter, for conditions on single documents ---


def resolve(doc: Any, path: str) -> Any:
    """The value at a dotted path through objects; None where it is missing."""
    for part in path.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return None
        doc = doc[part]
    return doc


def kind(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "bool"
    return {int: "num", float: "num", str: "str", list: "list", dict: "dict"}[type(x)]


def same(a: Any, b: Any) -> bool:
    """Deep JSON equality, in which 1 and 1.0 differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def _order(a: Any, b: Any) -> int | None:
    k = kind(a)
    if k != kind(b) or k in ("list", "dict"):
        return None
    if k == "null":
        return 0
    if k == "num":
        a, b = float(a), float(b)
    elif k == "str":
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


_HOLDS = {"Eq": lambda o: o == 0, "Lt": lambda o: o < 0, "Le": lambda o: o <= 0, "Gt": lambda o: o > 0, "Ge": lambda o: o >= 0}


def evaluate(e: Expr, doc: Any, depth: int = 0) -> bool:
    """Whether the document satisfies the expression; raises at the first invalid node reached."""
    if depth > MAX_DEPTH:
        raise InvalidExpression(f"expression is nested deeper than {MAX_DEPTH}")

    def value(x: Expr) -> Any:
        if x.op == "Attr":
            return resolve(doc, x.args[0])
        if x.op == "Literal":
            return x.args[0]
        raise InvalidExpression("an attribute or a literal is expected here")

    if e.op == "And":
        return all(evaluate(x, doc, depth + 1) for x in e.args)
    if e.op == "Or":
        return any(evaluate(x, doc, depth + 1) for x in e.args)
    if e.op == "Not":
        return not evaluate(e.args[0], doc, depth + 1)
    if e.op in ("AttributeExists", "AttributeNotExists"):
        return (resolve(doc, e.args[0]) is not None) == (e.op == "AttributeExists")
    if e.op in COMPARISONS:
        order = _order(value(e.args[0]), value(e.args[1]))
        if e.op == "Ne":
            return order != 0
        return order is not None and _HOLDS[e.op](order)
    if e.op == "Between":
        v, low, high = map(value, e.args)
        over, under = _order(v, low), _order(v, high)
        return over is not None and over >= 0 and under is not None and under <= 0
    if e.op == "BeginsWith":
        v = value(e.args[0])
        return isinstance(v, str) and v.startswith(e.args[1])
    if e.op == "Contains":
        v, wanted = value(e.args[0]), e.args[1]
        if isinstance(v, str) and isinstance(wanted, str):
            return wanted in v
        return isinstance(v, list) and any(same(x, wanted) for x in v)
    raise InvalidExpression(f"{e.op} is no condition")


# --- compiler ---


def _valid(e: Expr, depth: int = 0) -> bool:
    if depth > MAX_DEPTH:
        return False
    if e.op in ("And", "Or", "Not"):
        return all(_valid(x, depth + 1) for x in e.args)
    if e.op in COMPARISONS or e.op == "Between":
        return all(x.op in ("Attr", "Literal") for x in e.args)
    if e.op in ("BeginsWith", "Contains"):
        return e.args[0].op in ("Attr", "Literal")
    return e.op in ("AttributeExists", "AttributeNotExists")


TRUE, FALSE = True, False
Condition = Column | bool  # a bool where the types decide


def _col(c: Condition) -> Column:
    return F.lit(c) if isinstance(c, bool) else c


def _any(parts: list[Condition]) -> Condition:
    if any(p is True for p in parts):
        return True
    rest = [p for p in parts if p is not False]
    return reduce(lambda a, b: a | b, rest) if rest else False


def _all(parts: list[Condition]) -> Condition:
    if any(p is False for p in parts):
        return False
    rest = [p for p in parts if p is not True]
    return reduce(lambda a, b: a & b, rest) if rest else True


def _strict(c: Condition) -> Condition:
    return c if isinstance(c, bool) else F.coalesce(c, F.lit(False))


def _equal(a, b, strict: bool) -> Condition:
    """Equality of two resolved values; never null when strict."""
    parts: list[Condition] = []
    for k in ("num", "str", "bool"):
        x, y = a.typed(k, b), b.typed(k, a)
        if x is None or y is None:
            continue
        if isinstance(x, bool) or isinstance(y, bool):  # the literal can't be a value of the column's type
            parts.append(False)
        elif strict and not (a.attribute and b.attribute):
            parts.append(x.eqNullSafe(y))
        elif strict:
            parts.append(F.coalesce(x == y, F.lit(False)))
        else:
            parts.append(x == y)
    return _any([*parts, _all([a.null(), b.null()])])


def _compare(op: str, a, b, strict: bool) -> Condition:
    parts: list[Condition] = []
    for k in ("num", "str", "bool"):
        found = a.order(k, op, b)
        if found is not None:
            parts.append(_strict(found) if strict else found)
    if op in ("Le", "Ge"):
        parts.append(_all([a.null(), b.null()]))
    return _any(parts)


def _leaf(e: Expr, resolver, strict: bool) -> Condition:
    value = lambda x: resolver.attribute(x.args[0]) if x.op == "Attr" else resolver.literal(x.args[0])
    if e.op == "Eq":
        return _equal(value(e.args[0]), value(e.args[1]), strict)
    if e.op == "Ne":
        c = _equal(value(e.args[0]), value(e.args[1]), True)
        return (not c) if isinstance(c, bool) else ~c
    if e.op in COMPARISONS:
        return _compare(e.op, value(e.args[0]), value(e.args[1]), strict)
    if e.op == "Between":
        v = value(e.args[0])
        return _all([_compare("Ge", v, value(e.args[1]), strict), _compare("Le", v, value(e.args[2]), strict)])
    if e.op == "BeginsWith":
        c = value(e.args[0]).begins(e.args[1])
        return _strict(c) if strict else c
    if e.op == "Contains":
        c = value(e.args[0]).contains(e.args[1])
        return _strict(c) if strict else c
    missing = resolver.attribute(e.args[0]).null()
    if e.op == "AttributeNotExists":
        return missing
    return (not missing) if isinstance(missing, bool) else ~missing


def _compiled(e: Expr, resolver, strict: bool) -> Condition:
    if e.op == "And":
        return _all([_compiled(x, resolver, strict) for x in e.args])
    if e.op == "Or":
        return _any([_compiled(x, resolver, strict) for x in e.args])
    if e.op == "Not":
        c = _compiled(e.args[0], resolver, True)
        return (not c) if isinstance(c, bool) else ~c
    return _leaf(e, resolver, strict)


def _states(e: Expr, resolver, depth: int) -> Column:
    """0 false, 1 true, 2 an invalid node was reached, in the order of evaluation."""
    if depth > MAX_DEPTH:
        return F.lit(2)
    if e.op in ("And", "Or"):
        going = 1 if e.op == "And" else 0
        state = F.lit(going)
        for x in e.args:
            state = F.when(state != going, state).otherwise(_states(x, resolver, depth + 1))
        return state
    if e.op == "Not":
        inner = _states(e.args[0], resolver, depth + 1)
        return F.when(inner == 2, 2).otherwise(1 - inner)
    if not _valid(e):
        return F.lit(2)
    return F.when(_col(_strict(_leaf(e, resolver, True))), 1).otherwise(0)


def compile_filter(e: Expr, resolver) -> Column:
    """The expression as a filter of reads: a reached invalid node makes the whole filter false. May be null for false."""
    if _valid(e):
        return _col(_compiled(e, resolver, False))
    return _states(e, resolver, 0) == 1


def compile_condition(e: Expr, resolver) -> Column:
    """The expression as a write condition: never null, and a reached invalid node raises."""
    if _valid(e):
        return _col(_strict(_compiled(e, resolver, True)))
    state = _states(e, resolver, 0)
    return F.when(state == 2, F.raise_error(F.lit("invalid filter expression")).cast("boolean")).otherwise(state == 1)
