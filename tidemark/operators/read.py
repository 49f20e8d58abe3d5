"""Reads of document tables: get, batch get, query, scan, index query, key lists, with cursors and projections.

A DocTable binds a DataFrame of typed columns (or keys and a VARIANT) to a TableSchema. Every read is a lazy plan:
key conditions and time-to-live first, then order, then the limit, then the filter (a limit counts the items it
evaluates), then the projection. Only ``execute`` brings a page to the driver.
"""

from __future__ import annotations

import dataclasses
import json
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import Expr, compile_filter
from ..functions.resolve import TypedResolver, VariantResolver
from ..types import (
    MAX_SORT_KEY,
    IndexDefinition,
    IndexKeyRequired,
    IndexNotFound,
    InvalidIndexCursor,
    KeyType,
    KeyTypeMismatch,
    MissingKeyAttribute,
    Page,
    PartitionKeyRequired,
    SortKeyNotSupported,
    SortKeyRequired,
    TableSchema,
    check_key,
    key_to_json,
)

#: Up to so many keys a batch get is sent as literals of the plan; more come as a DataFrame and are joined.
BATCH_LITERALS = 1000
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class DocTable:
    """A table to read. doc: name of the VARIANT column where documents are schemaless, else all columns are the document."""

    df: DataFrame
    schema: TableSchema
    doc: str | None = None
    indexes: dict[str, IndexDefinition] = field(default_factory=dict)
    json_columns: dict[str, str] | None = None
    now: float | None = None  # seconds since the epoch; read from the clock once per operation where unset
    version: str | None = None  # the column that holds an item's version

    # --- building blocks ---

    @property
    def resolver(self):
        return VariantResolver(self.doc) if self.doc else TypedResolver(self.df, self.json_columns)

    def key_literal(self, name: str, value: Any) -> Any:
        """A key value as the key column holds it; raises when the type is wrong. None: the column can't hold it."""
        kind = self.schema.partition_type if name == self.schema.partition_key else self.schema.sort_type
        stored = check_key(value, kind, name, 2048 if name == self.schema.partition_key else MAX_SORT_KEY)
        if kind is KeyType.NUMBER and isinstance(self.df.schema[name].dataType, _INTEGRAL):
            if isinstance(value, int):
                return value if -(2**63) <= value < 2**63 else None
            return int(stored) if math.isfinite(stored) and stored == int(stored) else None
        return stored

    def equals(self, name: str, value: Any) -> Column:
        literal = self.key_literal(name, value)
        return F.lit(False) if literal is None else F.col(f"`{name}`") == F.lit(literal)

    def bound(self, name: str, op: str, value: Any) -> Column:
        """An order condition on a key column."""
        literal, column = self.key_literal(name, value), F.col(f"`{name}`")
        if literal is None:  # a fraction, or out of range, against an integral column
            if math.isinf(value) or abs(value) >= 2**63:
                return F.lit((op in ("Lt", "Le")) == (value > 0)) & column.isNotNull()
            return column <= F.lit(math.floor(value)) if op in ("Lt", "Le") else column > F.lit(math.floor(value))
        return {"Lt": column < literal, "Le": column <= literal, "Gt": column > literal, "Ge": column >= literal}[op]

    def at(self) -> float:
        return time.time() if self.now is None else self.now

    def alive(self) -> Column | None:
        """Not expired: the top-level time-to-live attribute is missing, not a number, 0, or later than now."""
        name = self.schema.ttl_attribute
        if not name:
            return None
        if self.doc:
            value = VariantResolver(self.doc).attribute(name) if "." not in name else None
            number = value.typed("num", value) if value is not None else F.try_variant_get(F.col(self.doc), f"$['{name}']", "double")
        elif name not in self.df.columns:
            return None
        elif isinstance(self.df.schema[name].dataType, T.NumericType):
            number = F.col(f"`{name}`")
        else:
            return None
        return ~F.coalesce((number != 0) & (number <= F.lit(self.at())), F.lit(False))

    def visible(self) -> DataFrame:
        alive = self.alive()
        return self.df if alive is None else self.df.where(alive)

    def order(self, forward: bool = True) -> list[Column]:
        return [F.col(f"`{k}`").asc() if forward else F.col(f"`{k}`").desc() for k in self.schema.keys]

    def after(self, cursor: dict, forward: bool = True) -> Column:
        """Strictly beyond a cursor's key in the direction of the read."""
        pk, sk = self.schema.partition_key, self.schema.sort_key
        if pk not in cursor:
            raise MissingKeyAttribute(f"missing key attribute: {pk}")
        op = "Gt" if forward else "Lt"
        beyond = self.bound(pk, op, cursor[pk])
        if not sk:
            return beyond
        same = self.equals(pk, cursor[pk])
        if sk not in cursor:  # the bare partition key sorts before all its items
            return beyond | same if forward else beyond
        return beyond | (same & self.bound(sk, op, cursor[sk]))

    def item(self, row: Row, paths: Sequence[str] | None) -> dict:
        """A row as a document."""
        if self.doc:
            value = row[self.doc]
            found = plain(value.toPython()) if hasattr(value, "toPython") else json.loads(value)
            if not paths:
                return found
            return project(found, paths, self.schema.keys)
        cells = {c: row[c] for c in row.asDict() if not c.startswith("_")}
        found = {k: _plain(v, bool(paths)) for k, v in cells.items()}
        return {k: v for k, v in found.items() if v is not None} if paths else found

    def cursor(self, row: Row) -> dict:
        return {k: key_to_json(row[k]) for k in self.schema.keys}

    def selected(self, df: DataFrame, paths: Sequence[str] | None, *extra: str) -> DataFrame:
        """Keys, then the projected paths, nested ones as structs; no paths: everything."""
        if not paths or self.doc:
            return df
        tree: dict = {}
        for path in paths:
            at, parts = tree, path.split(".")
            for i, part in enumerate(parts):
                if at.get(part, {}) is None:  # the whole parent is selected already
                    break
                at[part] = None if i == len(parts) - 1 else at.get(part) or {}
                at = at[part]
        resolver = self.resolver

        def build(node: dict, path: list[str]) -> Column | None:
            fields = []
            for name, inner in node.items():
                if inner is None:
                    value = resolver.attribute(".".join([*path, name]))
                    if hasattr(value, "column"):
                        fields.append(value.column.alias(name))
                else:
                    made = build(inner, [*path, name])
                    if made is not None:
                        fields.append(made.alias(name))
            if not fields:
                return None
            if not path:
                return fields
            present = reduce(lambda a, b: a | b, [f.isNotNull() for f in fields])
            return F.when(present, F.struct(*fields))

        keys = [k for k in self.schema.keys]
        columns = build({k: v for k, v in tree.items() if k not in keys}, []) or []
        return df.select(*[F.col(f"`{k}`") for k in keys], *columns, *extra)

    # --- operations ---

    def get_item(self, partition_key: Any = None, sort_key: Any = None, projection: Sequence[str] | None = None) -> DataFrame:
        """The item of a key, as a DataFrame of at most one row."""
        found = self.visible().where(self.key_condition(partition_key, sort_key)).limit(1)
        return self.selected(found, projection)

    def key_condition(self, partition_key: Any, sort_key: Any) -> Column:
        if partition_key is None:
            raise PartitionKeyRequired("partition key is required")
        if sort_key is not None and not self.schema.sort_key:
            raise SortKeyNotSupported("sort key not supported on this table")
        condition = self.equals(self.schema.partition_key, partition_key)
        if self.schema.sort_key:
            if sort_key is None:
                raise SortKeyRequired(f"sort key is required: {self.schema.sort_key}")
            condition = condition & self.equals(self.schema.sort_key, sort_key)
        return condition

    def get(self, partition_key: Any = None, sort_key: Any = None, projection: Sequence[str] | None = None) -> dict | None:
        rows = self.get_item(partition_key, sort_key, projection).collect()
        return self.item(rows[0], projection) if rows else None

    def get_versioned(self, partition_key: Any = None, sort_key: Any = None) -> dict | None:
        """{"item", "version"} of a key."""
        rows = self.get_item(partition_key, sort_key).collect()
        return {"item": self.item(rows[0], None), "version": rows[0][self.version]} if rows else None

    def batch_get(self, keys: Sequence[Any] | DataFrame, projection: Sequence[str] | None = None) -> DataFrame:
        """``_pos`` and the items of the keys, one row per key in its place; no item's row has null keys beside _pos.

        keys: a list of partition keys or (partition key, sort key) pairs, or a DataFrame with _pos and key columns.
        """
        names = self.schema.keys
        if not isinstance(keys, DataFrame):
            pairs = [k if isinstance(k, (tuple, list)) and self.schema.partition_type is not KeyType.BINARY else (k,) for k in keys]
            rows = []
            for i, pair in enumerate(pairs):
                if len([x for x in pair if x is not None]) != len(names):
                    raise SortKeyRequired("each key needs a partition key and, on this table, a sort key") if len(pair) < len(names) or self.schema.sort_key else SortKeyNotSupported("sort key not supported on this table")
                rows.append((i, *(self.key_literal(n, v) for n, v in zip(names, pair, strict=True))))
            kinds = T.StructType([T.StructField("_pos", T.LongType())] + [T.StructField(n, self.df.schema[n].dataType) for n in names])
            wanted = self.df.sparkSession.createDataFrame(rows, kinds)
            if len(rows) <= BATCH_LITERALS:
                wanted = F.broadcast(wanted)  # at most BATCH_LITERALS rows of two keys
        else:
            wanted = keys.select("_pos", *names)
        found = self.visible()
        if projection and not self.doc:
            found = self.selected(found, projection)
        present = found.withColumn("_found", F.lit(True))
        return wanted.join(present, names, "left").select("_pos", *[c for c in present.columns])

    def batch_get_items(self, keys: Sequence[Any], projection: Sequence[str] | None = None) -> list[dict | None]:
        if not keys:
            return []
        rows = {r["_pos"]: r for r in self.batch_get(keys, projection).collect()}
        return [self.item(rows[i], projection) if rows[i]["_found"] else None for i in range(len(keys))]

    def query(self) -> QueryBuilder:
        return QueryBuilder(self)

    def scan(self) -> ScanBuilder:
        return ScanBuilder(self)

    def query_index(self, name: str) -> IndexQueryBuilder:
        if name not in self.indexes:
            raise IndexNotFound(f"index not found: {name}")
        return IndexQueryBuilder(self, index=self.indexes[name])

    def list_partition_keys(self, limit: int | None = None) -> DataFrame:
        """Distinct partition keys in order; expired items count."""
        pk = F.col(f"`{self.schema.partition_key}`")
        keys = self.df.select(pk).distinct().orderBy(pk)
        return keys if limit is None else keys.limit(limit)

    def list_sort_key_prefixes(self, partition_key: Any, limit: int | None = None, distinct: bool = False) -> DataFrame:
        """``prefix``: text of the sort keys before '#', in key order, runs of one prefix as one; expired items count.

        Keys "P#..." are neighbours, and "P" is one key, so a run is at most those two groups: they are found by an
        aggregation, and only groups, not rows, are compared with their predecessors. distinct: no prefix twice.
        """
        pk, sk = self.schema.partition_key, self.schema.sort_key
        if not sk:
            raise SortKeyNotSupported("sort key not supported on this table")
        key = F.col(f"`{sk}`")
        rows = self.df.where(self.equals(pk, partition_key))
        if self.schema.sort_type is KeyType.STRING:
            rows = rows.select(key.alias("_key"), F.substring_index(key, "#", 1).alias("prefix"), F.contains(key, F.lit("#")).alias("_more"))
        elif self.schema.sort_type is KeyType.NUMBER:
            whole = key == F.rint(key.cast("double"))
            text = F.when(whole, F.format_string("%.0f", key.cast("double"))).otherwise(key.cast("string"))  # shortest text of fractions
            rows = rows.select(key.alias("_key"), text.alias("prefix"), F.lit(False).alias("_more"))
        else:
            rows = rows.select(key.alias("_key"), F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10)), ", "), F.lit("]")).alias("prefix"), F.lit(False).alias("_more"))
        groups = rows.groupBy("prefix", "_more").agg(F.min("_key").alias("_key"))
        if distinct:
            starts = groups.groupBy("prefix").agg(F.min("_key").alias("_key"))
        else:
            before = F.lag("prefix").over(Window.orderBy("_key"))
            starts = groups.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("prefix")))
        ordered = starts.orderBy("_key")
        return (ordered if limit is None else ordered.limit(limit)).select("prefix")


def plain(value: Any) -> Any:
    """A VARIANT's Python value as JSON has it: decimals become floats."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def _plain(value: Any, trim: bool) -> Any:
    if isinstance(value, Row):
        value = {k: _plain(v, trim) for k, v in value.asDict().items()}
        return {k: v for k, v in value.items() if v is not None} if trim else value
    if isinstance(value, list):
        return [_plain(v, trim) for v in value]
    return value


def project(doc: dict, paths: Sequence[str], keys: Sequence[str]) -> dict:
    """A document reduced to its keys and the given paths; missing and null paths stay away."""
    from ..functions.expr import resolve

    out = {k: doc[k] for k in keys if k in doc}
    for path in paths:
        value = resolve(doc, path)
        if value is None:
            continue
        at, parts = out, path.split(".")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                break
        else:
            at[parts[-1]] = value
    return out


@dataclass(frozen=True)
class ScanBuilder:
    """All items in key order."""

    table: DocTable
    where: Expr | None = None
    most: int | None = None
    start: dict | None = None
    paths: tuple[str, ...] = ()
    forward: bool = True

    def _with(self, **changed):
        return dataclasses.replace(self, **changed)

    def filter(self, e: Expr):
        return self._with(where=e)

    def limit(self, n: int):
        return self._with(most=n)

    def exclusive_start_key(self, key: dict):
        return self._with(start=key)

    def projection(self, paths: Sequence[str]):
        return self._with(paths=tuple(paths))

    # what differs between the reads

    def _base(self) -> DataFrame:
        return self.table.visible()

    def _after(self) -> Column:
        return self.table.after(self.start, self.forward)

    def _cursor(self, row: Row) -> dict:
        return self.table.cursor(row)

    def _order(self) -> list[Column]:
        return self.table.order(self.forward)

    def _rows(self, extra: int = 0, ordered: bool = True) -> DataFrame:
        rows = self._base()
        if self.start is not None:
            rows = rows.where(self._after())
        if ordered or self.most is not None:
            rows = rows.orderBy(*self._order())
        return rows if self.most is None else rows.limit(self.most + extra)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """The read as a lazy DataFrame: limit before filter, filter before projection. Unlimited reads may go unordered."""
        rows = self._rows(ordered=ordered)
        if self.where is not None:
            rows = rows.where(compile_filter(self.where, self.table.resolver))
        return self.table.selected(rows, self.paths)

    def count(self) -> DataFrame:
        """``count``: how many items the read returns."""
        rows = self._rows(ordered=False)
        if self.where is not None:
            rows = rows.where(compile_filter(self.where, self.table.resolver))
        return rows.agg(F.count("*").alias("count"))

    def execute(self) -> Page:
        """One page: one job that fetches one row more than the limit, to know whether anything is left."""
        rows = self._rows(extra=1)
        passes = F.lit(True) if self.where is None else F.coalesce(compile_filter(self.where, self.table.resolver), F.lit(False))
        marked = rows.withColumn("_pass", passes)
        fetched = marked.collect()
        more = self.most is not None and len(fetched) > self.most
        evaluated = fetched[: self.most] if self.most is not None else fetched
        paths = list(self.paths)
        items = []
        for row in evaluated:
            if row["_pass"]:
                whole = self.table.item(row, None)
                items.append(project(whole, paths, self.table.schema.keys) if paths else whole)
        cursor = self._cursor(evaluated[-1]) if more and evaluated else None
        return Page(items, cursor)

    def pages(self):
        """Pages until nothing is left."""
        builder = self
        while True:
            page = builder.execute()
            yield page
            if page.last_evaluated_key is None:
                return
            builder = builder.exclusive_start_key(page.last_evaluated_key)


@dataclass(frozen=True)
class QueryBuilder(ScanBuilder):
    """The items of one partition, with at most one sort-key condition; the last one set counts."""

    pk: Any = None
    condition: tuple | None = None

    def partition_key(self, value: Any):
        return self._with(pk=value)

    def scan_forward(self, forward: bool):
        return self._with(forward=forward)

    def _sort(self, *condition):
        return self._with(condition=condition)

    def sort_key_eq(self, v: Any):
        return self._sort("Eq", v)

    def sort_key_lt(self, v: Any):
        return self._sort("Lt", v)

    def sort_key_le(self, v: Any):
        return self._sort("Le", v)

    def sort_key_gt(self, v: Any):
        return self._sort("Gt", v)

    def sort_key_ge(self, v: Any):
        return self._sort("Ge", v)

    def sort_key_between(self, low: Any, high: Any):
        return self._sort("Between", low, high)

    def sort_key_begins_with(self, prefix: str):
        return self._sort("BeginsWith", prefix)

    def _base(self) -> DataFrame:
        if self.pk is None:
            raise PartitionKeyRequired("partition key is required")
        table = self.table
        rows = table.visible().where(table.equals(table.schema.partition_key, self.pk))
        if self.condition is None:
            return rows
        sk = table.schema.sort_key
        if not sk:
            raise SortKeyNotSupported("sort key not supported on this table")
        op, *values = self.condition
        if op == "Eq":
            return rows.where(table.equals(sk, values[0]))
        if op == "Between":
            return rows.where(table.bound(sk, "Ge", values[0]) & table.bound(sk, "Le", values[1]))
        if op == "BeginsWith":
            if not isinstance(values[0], str):
                raise KeyTypeMismatch("a prefix is a string")
            return rows.where(F.col(f"`{sk}`").startswith(values[0]) if table.schema.sort_type is KeyType.STRING else F.lit(False))
        return rows.where(table.bound(sk, op, values[0]))


@dataclass(frozen=True)
class IndexQueryBuilder(ScanBuilder):
    """Items whose indexed attribute equals a value, in key order.

    An index is metadata: as it is kept in step with every write, reading it is the same as a filter on the
    attribute, its type and the index's scope.
    """

    index: IndexDefinition | None = None
    value: Any = None

    def key_value(self, value: Any):
        return self._with(value=value)

    def scan_forward(self, forward: bool):
        return self._with(forward=forward)

    def _attribute(self):
        name = self.index.attribute
        return self.table.resolver.attribute(name) if "." not in name else None

    def _base(self) -> DataFrame:
        from ..functions.expr import _equal
        from ..functions.resolve import Literal

        if self.value is None:
            raise IndexKeyRequired("index key value is required")
        stored = check_key(self.value, self.index.key_type, self.index.attribute)
        table, attribute = self.table, self._attribute()
        literal = Literal(self.value if isinstance(stored, float) else stored)
        if isinstance(stored, bytes):
            raise KeyTypeMismatch("indexes over binary attributes are read by their JSON form only")
        matched = False if attribute is None else _equal(attribute, literal, False)
        rows = table.visible().where(F.lit(matched) if isinstance(matched, bool) else matched)
        if self.index.partition_schema is not None:
            pk = F.col(f"`{table.schema.partition_key}`")
            rows = rows.where(F.substring_index(pk, "#", 1) == self.index.partition_schema)
        return rows

    def _after(self) -> Column:
        names = [self.index.attribute, *self.table.schema.keys]
        if not isinstance(self.start, dict) or any(n not in self.start for n in names):
            raise InvalidIndexCursor(f"invalid index pagination cursor: needs {', '.join(names)}")
        try:
            check_key(self.start[self.index.attribute], self.index.key_type, self.index.attribute)
            return self.table.after(self.start, self.forward)
        except (KeyTypeMismatch, MissingKeyAttribute) as e:
            raise InvalidIndexCursor(f"invalid index pagination cursor: {e}") from e

    def _cursor(self, row: Row) -> dict:
        return {self.index.attribute: self.value} | self.table.cursor(row)
