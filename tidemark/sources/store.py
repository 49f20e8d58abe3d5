"""Managed document tables over an append-only log.

A commit writes the new versions of its items as Parquet under ``<table>/data/txn=N`` and then creates
``_log/N.json``; that file's existence is the commit, and of two writers of N one loses. A version row holds the
keys, the document as VARIANT, its transaction, its place in it and whether it puts or deletes. The state at a
snapshot is the latest row per key among the committed transactions up to it. All items of a transaction share its
number as their version.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import update as updates
from ..functions.expr import Expr, evaluate
from ..operators.read import DocTable, plain
from ..types import (
    MAX_DOCUMENT,
    MAX_SORT_KEY,
    AttrType,
    ConditionCheckFailed,
    DatabaseLocked,
    DocumentTooLarge,
    IndexAlreadyExists,
    IndexDefinition,
    IndexNotFound,
    KeyType,
    MissingKeyAttribute,
    PartitionKeyRequired,
    PartitionSchema,
    PartitionSchemaAlreadyExists,
    PartitionSchemaHasIndexes,
    PartitionSchemaNotFound,
    PartitionSchemaRequiresStringKey,
    SnapshotUnavailable,
    SortKeyNotSupported,
    SortKeyRequired,
    TableAlreadyExists,
    TableNotFound,
    TableSchema,
    ValidationFailed,
    VersionMismatch,
    check_key,
    key_to_json,
    prefix_of,
)
from .files import Files

_KINDS = {KeyType.STRING: T.StringType(), KeyType.NUMBER: T.DoubleType(), KeyType.BINARY: T.BinaryType()}


@dataclass
class Entry:
    """Catalog entry of one table."""

    schema: TableSchema
    partition_schemas: dict[str, PartitionSchema] = field(default_factory=dict)
    indexes: dict[str, IndexDefinition] = field(default_factory=dict)
    born: int = 0  # the transaction that created the table; a dropped name may be created anew

    def to_json(self) -> dict:
        return {"schema": self.schema.to_json(), "partition_schemas": [s.to_json() for s in self.partition_schemas.values()], "indexes": [i.to_json() for i in self.indexes.values()], "born": self.born}

    @classmethod
    def from_json(cls, d: dict) -> Entry:
        return cls(TableSchema.from_json(d["schema"]), {s["prefix"]: PartitionSchema.from_json(s) for s in d["partition_schemas"]}, {i["name"]: IndexDefinition.from_json(i) for i in d["indexes"]}, d["born"])


def to_text(doc: Any) -> str:
    """A document as JSON text in which floats keep being floats when parsed as VARIANT."""
    if isinstance(doc, bool) or doc is None or isinstance(doc, (int, str)):
        return json.dumps(doc, ensure_ascii=False)
    if isinstance(doc, float):
        text = repr(doc)
        return text if "e" in text or "E" in text else text + "e0"
    if isinstance(doc, (list, tuple)):
        return "[" + ",".join(map(to_text, doc)) + "]"
    return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{to_text(v)}" for k, v in doc.items()) + "}"


def validate(doc: dict, schema: PartitionSchema) -> list[str]:
    """All errors of a document against a partition schema; an explicit null is of no type."""
    fits = {AttrType.STRING: lambda v: isinstance(v, str), AttrType.NUMBER: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), AttrType.BOOLEAN: lambda v: isinstance(v, bool)}
    errors = []
    for a in schema.attributes:
        if a.name not in doc:
            if a.required:
                errors.append(f"missing required attribute '{a.name}'")
        elif not fits[a.type](doc[a.name]):
            errors.append(f"attribute '{a.name}' must be {a.type.value}")
    return errors


def validation_errors(table: DocTable, schema: PartitionSchema) -> Column:
    """The errors of each row of a typed table as an array of strings; a null reads as missing there."""
    found = []
    kinds = {AttrType.STRING: "str", AttrType.NUMBER: "num", AttrType.BOOLEAN: "bool"}
    for a in schema.attributes:
        value = table.resolver.attribute(a.name) if "." not in a.name else None
        missing = F.lit(True) if value is None or value.null() is True else value.null()
        if a.required:
            found.append(F.when(missing, F.lit(f"missing required attribute '{a.name}'")))
        typed = None if value is None or not hasattr(value, "column") else value.typed(kinds[a.type], value)
        wrong = ~missing if typed is None else ~missing & typed.isNull()
        found.append(F.when(wrong, F.lit(f"attribute '{a.name}' must be {a.type.value}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


class Database:
    """A database under one root folder; writers of one process take turns, those of others are detected at commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._lock = threading.RLock()
        self._logs: dict[int, dict] = {}

    # --- open and create ---

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Database:
        db = cls(spark, root)
        db.files.make("_log")
        if not db.files.create("_log/00000000000000000000.json", json.dumps({"txn": 0, "tables": {}, "catalog": {}})):
            raise TableAlreadyExists(f"a database exists at {root}")
        return db

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Database:
        db = cls(spark, root)
        db.latest()
        return db

    def _log(self) -> list[dict]:
        """All log entries in order; each is read once."""
        for name in self.files.names("_log"):
            if name.endswith(".json") and int(name[:-5]) not in self._logs:
                self._logs[int(name[:-5])] = json.loads(self.files.read(f"_log/{name}"))
        return [self._logs[n] for n in sorted(self._logs)]

    def latest(self) -> int:
        return self._log()[-1]["txn"]

    def catalog(self, snapshot: int | None = None) -> dict[str, Entry]:
        found: dict = {}
        for entry in self._log():
            if (snapshot is None or entry["txn"] <= snapshot) and entry.get("catalog") is not None:
                found = entry["catalog"]
        return {n: Entry.from_json(e) for n, e in found.items()}

    def entry(self, table: str, snapshot: int | None = None) -> Entry:
        found = self.catalog(snapshot).get(table)
        if found is None:
            raise TableNotFound(f"table not found: {table}")
        return found

    def _commit(self, txn: int, tables: dict[str, str], catalog: dict[str, Entry] | None, base: dict[str, int] | None = None) -> None:
        text = json.dumps({"txn": txn, "tables": tables, "base": base or {}, "catalog": None if catalog is None else {n: e.to_json() for n, e in catalog.items()}})
        if not self.files.create(f"_log/{txn:020d}.json", text):
            raise DatabaseLocked(f"another writer committed transaction {txn}")

    # --- definitions ---

    def _define(self, change: Callable[[dict[str, Entry], int], Any]) -> Any:
        with self._lock:
            catalog, txn = self.catalog(), self.latest() + 1
            result = change(catalog, txn)
            self._commit(txn, {}, catalog)
            return result

    def create_table(self, schema: TableSchema) -> None:
        def change(catalog, txn):
            if schema.name in catalog:
                raise TableAlreadyExists(f"table already exists: {schema.name}")
            if not schema.partition_key:
                raise PartitionKeyRequired("partition key is required")
            catalog[schema.name] = Entry(schema, born=txn)

        self._define(change)

    def drop_table(self, table: str) -> None:
        def change(catalog, txn):
            if catalog.pop(table, None) is None:
                raise TableNotFound(f"table not found: {table}")

        self._define(change)

    def list_tables(self) -> list[str]:
        return sorted(self.catalog())

    def describe_table(self, table: str) -> TableSchema:
        return self.entry(table).schema

    def _change(self, table: str, change: Callable[[Entry], None]) -> None:
        def run(catalog, txn):
            if table not in catalog:
                raise TableNotFound(f"table not found: {table}")
            change(catalog[table])

        self._define(run)

    def create_partition_schema(self, table: str, schema: PartitionSchema) -> None:
        def change(entry):
            if entry.schema.partition_type is not KeyType.STRING:
                raise PartitionSchemaRequiresStringKey("partition schemas require a String partition key")
            if schema.prefix in entry.partition_schemas:
                raise PartitionSchemaAlreadyExists(f"partition schema already exists: {schema.prefix}")
            entry.partition_schemas[schema.prefix] = schema

        self._change(table, change)

    def drop_partition_schema(self, table: str, prefix: str) -> None:
        def change(entry):
            if prefix not in entry.partition_schemas:
                raise PartitionSchemaNotFound(f"partition schema not found: {prefix}")
            if any(i.partition_schema == prefix for i in entry.indexes.values()):
                raise PartitionSchemaHasIndexes(f"cannot drop partition schema '{prefix}': has associated indexes")
            del entry.partition_schemas[prefix]

        self._change(table, change)

    def list_partition_schemas(self, table: str) -> list[PartitionSchema]:
        return [s for _, s in sorted(self.entry(table).partition_schemas.items())]

    def describe_partition_schema(self, table: str, prefix: str) -> PartitionSchema:
        found = self.entry(table).partition_schemas.get(prefix)
        if found is None:
            raise PartitionSchemaNotFound(f"partition schema not found: {prefix}")
        return found

    def create_index(self, table: str, index: IndexDefinition) -> None:
        def change(entry):
            if index.name in entry.indexes:
                raise IndexAlreadyExists(f"index already exists: {index.name}")
            if index.partition_schema is not None and index.partition_schema not in entry.partition_schemas:
                raise PartitionSchemaNotFound(f"partition schema not found: {index.partition_schema}")
            entry.indexes[index.name] = index

        self._change(table, change)

    def drop_index(self, table: str, name: str) -> None:
        def change(entry):
            if entry.indexes.pop(name, None) is None:
                raise IndexNotFound(f"index not found: {name}")

        self._change(table, change)

    def list_indexes(self, table: str) -> list[IndexDefinition]:
        return [i for _, i in sorted(self.entry(table).indexes.items())]

    def describe_index(self, table: str, name: str) -> IndexDefinition:
        found = self.entry(table).indexes.get(name)
        if found is None:
            raise IndexNotFound(f"index not found: {name}")
        return found

    # --- state ---

    def row_type(self, schema: TableSchema) -> T.StructType:
        keys = [T.StructField(schema.partition_key, _KINDS[schema.partition_type], False)]
        if schema.sort_key:
            keys.append(T.StructField(schema.sort_key, _KINDS[schema.sort_type], False))
        rest = [T.StructField("doc", T.VariantType()), T.StructField("_txn", T.LongType()), T.StructField("_seq", T.IntegerType()), T.StructField("_op", T.StringType())]
        return T.StructType(keys + rest)

    def versions(self, table: str, snapshot: int | None = None) -> DataFrame:
        """Every committed version row of a table up to a snapshot, from its last compaction on."""
        entry = self.entry(table, snapshot)
        paths: list[str] = []
        for e in self._log():
            if e["txn"] < entry.born or snapshot is not None and e["txn"] > snapshot:
                if e.get("base", {}).get(table) is not None and e["txn"] >= entry.born:
                    raise SnapshotUnavailable(f"snapshot {snapshot} lies before the compaction at {e['txn']}")
                continue
            if table in e.get("base", {}):
                paths = []
            if table in e["tables"]:
                paths.append(self.files.uri(e["tables"][table]))
        kind = self.row_type(entry.schema)
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*paths)

    def state(self, table: str, snapshot: int | None = None, tombstones: bool = False) -> DataFrame:
        """The latest version of every item."""
        keys = self.entry(table, snapshot).schema.keys
        order = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(F.desc("_txn"), F.desc("_seq"))
        last = self.versions(table, snapshot).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        return last if tombstones else last.where("_op = 'put'")

    def table(self, table: str, snapshot: int | None = None, now: float | None = None) -> DocTable:
        """The table at a snapshot, the newest by default, to read from."""
        snapshot = self.latest() if snapshot is None else snapshot
        entry = self.entry(table, snapshot)
        df = self.state(table, snapshot).withColumnRenamed("_txn", "_version").drop("_seq", "_op")
        return DocTable(df, entry.schema, doc="doc", indexes=entry.indexes, now=now, version="_version")

    # --- writes ---

    def transact(self, body: Callable[[Transaction], Any]) -> Any:
        """Runs body in a transaction: all of its writes are committed together, none if it raises."""
        with self._lock:
            txn = Transaction(self)
            result = body(txn)
            txn.commit()
            return result

    def put_item(self, table: str, item: dict, condition: Expr | None = None, return_old: bool = False) -> dict | None:
        return self.transact(lambda t: t.put(table, item, condition, return_old))

    def put_item_conditional(self, table: str, item: dict, expected_version: int) -> None:
        self.transact(lambda t: t.put_conditional(table, item, expected_version))

    def delete_item(self, table: str, partition_key: Any, sort_key: Any = None, condition: Expr | None = None, return_old: bool = False) -> dict | None:
        return self.transact(lambda t: t.delete(table, partition_key, sort_key, condition, return_old))

    def update_item(self, table: str, partition_key: Any, sort_key: Any = None, actions: Sequence[updates.Action] = (), condition: Expr | None = None, return_values: str = "none") -> dict | None:
        return self.transact(lambda t: t.update(table, partition_key, sort_key, actions, condition, return_values))

    def write_batch(self, operations: Sequence[tuple], sync: str = "full") -> None:
        """("put", table, item) and ("delete", table, pk[, sk]) in order, in one commit; the last one of a key counts.

        Unconditional, so no state is read: any number of items is one job. sync is accepted and has no effect: a
        commit is durable where its file system makes it so.
        """

        def body(t: Transaction):
            for op, table, *rest in operations:
                if op == "put":
                    t.put(table, *rest)
                else:
                    t.delete(table, *rest)

        self.transact(body)

    def bulk_put(self, table: str, documents: DataFrame, doc: str | None = None) -> int:
        """Puts every row in one job and one commit, without passing the driver. Returns the transaction.

        documents: columns are attributes (nulls are left out), or doc names a column of JSON text. Rows that break
        the table's rules (keys, size, validating schemas) make the job fail, and nothing is committed. Of rows with
        one key the one with the greatest document text stays.
        """
        with self._lock:
            entry, txn = self.entry(table), self.latest() + 1
            schema = entry.schema
            text = F.col(doc) if doc else F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns]))
            if doc:
                parsed = F.parse_json(text)
                keys = [F.try_variant_get(parsed, f"$['{k}']", _KINDS[kind].simpleString()).alias(k) for k, kind in self._key_kinds(schema)]
            else:
                keys = [F.col(f"`{k}`").cast(_KINDS[kind]).alias(k) for k, kind in self._key_kinds(schema)]
            rows = documents.select(*keys, text.alias("_text"))
            rows = rows.select(*[self._checked(k, kind) for k, kind in self._key_kinds(schema)], F.when(F.octet_length("_text") > MAX_DOCUMENT, F.raise_error(F.lit("document exceeds maximum size")).cast("string")).otherwise(F.col("_text")).alias("_text"))
            rows = self._validated(rows, entry)
            order = Window.partitionBy(*[f"`{k}`" for k in schema.keys]).orderBy(F.desc("_text"))
            rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
            rows = rows.select(*[f"`{k}`" for k in schema.keys], F.parse_json("_text").alias("doc"), F.lit(txn).cast("long").alias("_txn"), F.lit(0).alias("_seq"), F.lit("put").alias("_op"))
            self._write(table, txn, rows, schema)
            self._commit(txn, {table: f"{table}/data/txn={txn}"}, None)
            return txn

    def bulk_delete(self, table: str, keys: DataFrame) -> int:
        """Deletes the items of a DataFrame of keys in one commit; absent keys do no harm."""
        with self._lock:
            entry, txn = self.entry(table), self.latest() + 1
            rows = keys.select(*[F.col(f"`{k}`").cast(_KINDS[kind]).alias(k) for k, kind in self._key_kinds(entry.schema)]).distinct()
            rows = rows.select("*", F.lit(None).cast("variant").alias("doc"), F.lit(txn).cast("long").alias("_txn"), F.lit(0).alias("_seq"), F.lit("delete").alias("_op"))
            self._write(table, txn, rows, entry.schema)
            self._commit(txn, {table: f"{table}/data/txn={txn}"}, None)
            return txn

    @staticmethod
    def _key_kinds(schema: TableSchema) -> list[tuple[str, KeyType]]:
        return [(schema.partition_key, schema.partition_type)] + ([(schema.sort_key, schema.sort_type)] if schema.sort_key else [])

    @staticmethod
    def _checked(name: str, kind: KeyType) -> Column:
        column = F.col(f"`{name}`")
        bad = column.isNull()
        if kind is KeyType.NUMBER:
            bad = bad | F.isnan(column)
            column = F.when(column == 0, F.lit(0.0)).otherwise(column)
        elif kind is KeyType.STRING:
            bad = bad | F.contains(column, F.lit("\0")) | (F.octet_length(column) > 2048)
        return F.when(bad, F.raise_error(F.lit(f"invalid key attribute: {name}")).cast(_KINDS[kind])).otherwise(column).alias(name)

    def _validated(self, rows: DataFrame, entry: Entry) -> DataFrame:
        """rows whose documents must satisfy the validating schema of their prefix; a breach fails the job."""
        if entry.schema.partition_type is not KeyType.STRING:
            return rows
        prefix = F.substring_index(F.col(f"`{entry.schema.partition_key}`"), "#", 1)
        text = F.col("_text")
        for schema in entry.partition_schemas.values():
            if not schema.validate:
                continue
            parsed = rows.select(F.parse_json("_text").alias("doc"))
            errors = validation_errors(DocTable(parsed, entry.schema, doc="doc"), schema)
            del parsed
            rows = rows.withColumn("doc", F.parse_json("_text"))
            text = F.when((prefix == schema.prefix) & (F.size(errors) > 0), F.raise_error(F.concat(F.lit(f"validation failed for prefix '{schema.prefix}': "), F.array_join(errors, "; "))).cast("string")).otherwise(F.col("_text"))
            rows = rows.withColumn("_text", text).drop("doc")
        return rows

    def _write(self, table: str, txn: int, rows: DataFrame, schema: TableSchema) -> None:
        ordered = rows.sortWithinPartitions(*[f"`{k}`" for k in schema.keys])
        ordered.write.mode("overwrite").parquet(self.files.uri(f"{table}/data/txn={txn}"))

    def sweep_expired(self, table: str, limit: int = 100, now: float | None = None) -> int:
        """Deletes at most ``limit`` expired items, in key order, as one commit; returns how many."""
        with self._lock:
            now = time.time() if now is None else now
            snapshot = self.table(table, now=now)
            alive = snapshot.alive()
            if alive is None:
                return 0
            expired = snapshot.df.where(~alive).orderBy(*snapshot.order()).limit(limit).select(*[f"`{k}`" for k in snapshot.schema.keys])
            rows = expired.collect()  # at most ``limit``
            if rows:
                self.bulk_delete(table, self.spark.createDataFrame(rows, expired.schema))
            return len(rows)

    def compact(self, table: str) -> int:
        """Writes the live state as a new base and drops what lies before it from the table's log; returns its transaction."""
        with self._lock:
            entry, txn = self.entry(table), self.latest() + 1
            rows = self.state(table)
            self._write(table, txn, rows, entry.schema)
            self._commit(txn, {table: f"{table}/data/txn={txn}"}, None, {table: txn})
            return txn

    def vacuum(self, table: str) -> int:
        """Removes the files of versions before the last compaction; returns how many transactions' files went."""
        with self._lock:
            base = max((e["txn"] for e in self._log() if table in e.get("base", {})), default=0)
            old = [e["tables"][table] for e in self._log() if table in e["tables"] and e["txn"] < base]
            for path in old:
                self.files.remove(path)
            return len(old)


class Transaction:
    """Writes gathered on the driver over a snapshot; its reads see its own writes and ignore time-to-live."""

    def __init__(self, db: Database):
        self.db, self.snapshot = db, db.latest()
        self.txn = self.snapshot + 1
        self.entries = db.catalog(self.snapshot)
        self.writes: dict[str, dict[tuple, dict | None]] = {}
        self.known: dict[tuple, tuple[dict | None, int, bool]] = {}

    def entry(self, table: str) -> Entry:
        if table not in self.entries:
            raise TableNotFound(f"table not found: {table}")
        return self.entries[table]

    def key(self, table: str, partition_key: Any, sort_key: Any = None) -> tuple:
        schema = self.entry(table).schema
        if partition_key is None:
            raise PartitionKeyRequired("partition key is required")
        key = [check_key(partition_key, schema.partition_type, schema.partition_key)]
        if schema.sort_key:
            if sort_key is None:
                raise SortKeyRequired(f"sort key is required: {schema.sort_key}")
            key.append(check_key(sort_key, schema.sort_type, schema.sort_key, MAX_SORT_KEY))
        elif sort_key is not None:
            raise SortKeyNotSupported("sort key not supported on this table")
        return tuple(key)

    def item_key(self, table: str, item: dict) -> tuple:
        schema = self.entry(table).schema
        for k in schema.keys:
            if k not in item:
                raise MissingKeyAttribute(f"missing key attribute: {k}")
        return self.key(table, item[schema.partition_key], item[schema.sort_key] if schema.sort_key else None)

    def _stored(self, table: str, key: tuple) -> tuple[dict | None, int, bool]:
        """Document, version of the last put, and whether it lives, of a key in the snapshot."""
        at = (table, *key)
        if at not in self.known:
            schema = self.entry(table).schema
            where = F.lit(True)
            for name, value in zip(schema.keys, key, strict=True):
                where = where & (F.col(f"`{name}`") == F.lit(value))
            # however often the item was deleted since, its version is that of its last put
            put = F.max(F.when(F.col("_op") == "put", F.col("_txn"))).over(Window.partitionBy(*[f"`{k}`" for k in schema.keys])).alias("_put")
            rows = self.db.versions(table, self.snapshot).where(where).select("doc", "_txn", "_seq", "_op", put).orderBy(F.desc("_txn"), F.desc("_seq")).limit(1).collect()
            live = bool(rows) and rows[0]["_op"] == "put"
            self.known[at] = (plain(rows[0]["doc"].toPython()) if live else None, (rows[0]["_put"] or 0) if rows else 0, live)
        return self.known[at]

    def _current(self, table: str, key: tuple) -> dict | None:
        if key in self.writes.get(table, {}):
            return self.writes[table][key]
        return self._stored(table, key)[0]

    def get(self, table: str, partition_key: Any, sort_key: Any = None) -> dict | None:
        return self._current(table, self.key(table, partition_key, sort_key))

    def get_versioned(self, table: str, partition_key: Any, sort_key: Any = None) -> dict | None:
        key = self.key(table, partition_key, sort_key)
        doc = self._current(table, key)
        if doc is None:
            return None
        return {"item": doc, "version": self.txn if key in self.writes.get(table, {}) else self._stored(table, key)[1]}

    def _accept(self, table: str, item: dict) -> None:
        size = len(to_text(item).encode())
        if size > MAX_DOCUMENT:
            raise DocumentTooLarge(f"document exceeds maximum size of {MAX_DOCUMENT} bytes (got {size})")
        entry = self.entry(table)
        prefix = prefix_of(item.get(entry.schema.partition_key))
        schema = entry.partition_schemas.get(prefix) if prefix is not None else None
        if schema is not None and schema.validate:
            errors = validate(item, schema)
            if errors:
                raise ValidationFailed(prefix, errors)

    @staticmethod
    def _require(condition: Expr | None, doc: dict | None) -> None:
        if condition is not None and not evaluate(condition, doc or {}):
            raise ConditionCheckFailed("condition check failed: the condition evaluated to false")

    def put(self, table: str, item: dict, condition: Expr | None = None, return_old: bool = False) -> dict | None:
        key = self.item_key(table, item)
        self._accept(table, item)
        old = self._current(table, key) if condition is not None or return_old else None
        self._require(condition, old)
        self.writes.setdefault(table, {})[key] = item
        return old if return_old else None

    def put_conditional(self, table: str, item: dict, expected_version: int) -> None:
        """Puts if the item's version is the expected one; 0 stands for a key never put. A deleted item has its last version."""
        key = self.item_key(table, item)
        self._accept(table, item)
        actual = self.txn if key in self.writes.get(table, {}) else self._stored(table, key)[1]
        if actual != expected_version:
            raise VersionMismatch(expected_version, actual)
        self.writes.setdefault(table, {})[key] = item

    def delete(self, table: str, partition_key: Any, sort_key: Any = None, condition: Expr | None = None, return_old: bool = False) -> dict | None:
        key = self.key(table, partition_key, sort_key)
        old = self._current(table, key) if condition is not None or return_old else None
        self._require(condition, old)
        self.writes.setdefault(table, {})[key] = None
        return old if return_old else None

    def update(self, table: str, partition_key: Any, sort_key: Any = None, actions: Sequence[updates.Action] = (), condition: Expr | None = None, return_values: str = "none") -> dict | None:
        """Changes an item, or makes it; return_values: none, all_old or all_new."""
        schema = self.entry(table).schema
        key = self.key(table, partition_key, sort_key)
        updates.check_keys(actions, schema.keys)
        old = self._current(table, key)
        self._require(condition, old)
        start = old if old is not None else {k: key_to_json(v) for k, v in zip(schema.keys, key, strict=True)}
        new = updates.apply(start, actions)
        self._accept(table, new)
        self.writes.setdefault(table, {})[key] = new
        return {"all_old": old, "all_new": new}.get(return_values)

    def commit(self) -> int:
        """Writes what has been gathered; a transaction without writes still takes a number."""
        tables = {}
        for table, writes in self.writes.items():
            schema = self.entry(table).schema
            kind = self.db.row_type(schema)
            names = [*schema.keys, "_text", "_txn", "_seq", "_op"]
            fields = [T.StructField(k, kind[k].dataType) for k in schema.keys] + [T.StructField("_text", T.StringType()), T.StructField("_txn", T.LongType()), T.StructField("_seq", T.IntegerType()), T.StructField("_op", T.StringType())]
            rows = [(*key, None if doc is None else to_text(doc), self.txn, i, "delete" if doc is None else "put") for i, (key, doc) in enumerate(writes.items())]
            frame = self.db.spark.createDataFrame(rows, T.StructType(fields))
            frame = frame.select(*[f"`{k}`" for k in schema.keys], F.parse_json("_text").alias("doc"), *names[-3:])
            if len(rows) < 10_000:
                frame = frame.coalesce(1)
            self.db._write(table, self.txn, frame, schema)
            tables[table] = f"{table}/data/txn={self.txn}"
        self.db._commit(self.txn, tables, None)
        return self.txn
