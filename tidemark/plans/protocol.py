"""The wire protocol: one JSON object in, one out; a server on a Unix socket and a client for it."""

from __future__ import annotations

import asyncio
import json
import socket
import socketserver
from typing import Any

from ..functions import expr
from ..functions.update import from_wire
from ..sources.store import Database
from ..types import (
    MAX_BATCH_GET,
    AttributeDef,
    AttrType,
    BatchSizeLimitExceeded,
    ConditionCheckFailed,
    DocError,
    IndexDefinition,
    InvalidAttrType,
    InvalidCondition,
    InvalidKeyType,
    InvalidUpdateAction,
    KeyType,
    PartitionSchema,
    TableAlreadyExists,
    TableNotFound,
    TableSchema,
    VersionMismatch,
    key_to_json,
)

#: Errors that keep their names on the wire; others are InternalError.
NAMED = (ConditionCheckFailed, TableNotFound, TableAlreadyExists, InvalidUpdateAction, InvalidKeyType, InvalidAttrType, BatchSizeLimitExceeded)
RETURNS = {"ALL_OLD": "all_old", "all_old": "all_old", "AllOld": "all_old", "ALL_NEW": "all_new", "all_new": "all_new", "AllNew": "all_new"}
MAX_BATCH_WRITE = 25


class BadRequest(DocError):
    """ParseError on the wire."""


def _field(request: dict, name: str) -> Any:
    if name not in request:
        raise BadRequest(f"missing field `{name}`")
    return request[name]


def _expression(request: dict, name: str):
    found = request.get(name)
    return None if found is None else expr.from_json(found)


def _item(item: dict | None, **more: Any) -> dict:
    return {"ok": True} | ({} if item is None else {"item": item}) | more


def _schema(s: PartitionSchema) -> dict:
    return {"prefix": s.prefix, "description": s.description, "attributes": [{"name": a.name, "type": a.type.value, "required": a.required} for a in s.attributes], "validate": s.validate}


def _index(i: IndexDefinition) -> dict:
    scope = {} if i.partition_schema is None else {"partition_schema": i.partition_schema}
    return {"name": i.name} | scope | {"index_key": {"name": i.attribute, "type": i.key_type.value}}


class Dispatcher:
    """Runs requests against a database."""

    def __init__(self, db: Database):
        self.db = db

    def __call__(self, request: Any) -> dict:
        try:
            if isinstance(request, str):
                try:
                    request = json.loads(request)
                except ValueError as e:
                    raise BadRequest(str(e)) from e
            if not isinstance(request, dict) or "op" not in request:
                raise BadRequest("a request is an object with a field `op`")
            run = getattr(self, f"op_{request['op']}", None)
            if run is None:
                raise BadRequest(f"unknown variant `{request['op']}`")
            return run(request)
        except VersionMismatch as e:
            return {"error": "VersionMismatch", "message": f"expected version {e.expected}, actual {e.actual}", "expected": e.expected, "actual": e.actual}
        except BadRequest as e:
            return {"error": "ParseError", "message": str(e)}
        except NAMED as e:
            return {"error": type(e).__name__, "message": str(e)}
        except DocError as e:
            return {"error": "InternalError", "message": str(e)}

    def _table(self, request: dict):
        return self.db.table(_field(request, "table"))

    # --- items ---

    def op_get_item(self, r: dict) -> dict:
        return _item(self._table(r).get(_field(r, "partition_key"), r.get("sort_key"), r.get("projection")))

    def op_get_item_versioned(self, r: dict) -> dict:
        found = self._table(r).get_versioned(_field(r, "partition_key"), r.get("sort_key"))
        return {"ok": True} if found is None else {"ok": True} | found

    def op_put_item(self, r: dict) -> dict:
        table, item, condition = _field(r, "table"), _field(r, "item"), _expression(r, "condition")
        wanted = RETURNS.get(r.get("return_values"), "none")
        if r.get("expected_version") is not None:
            if condition is not None or wanted != "none":
                raise BadRequest("expected_version excludes condition and return_values")
            self.db.put_item_conditional(table, item, r["expected_version"])
            return {"ok": True}
        old = self.db.put_item(table, item, condition, wanted == "all_old")
        return _item(old) if wanted == "all_old" else {"ok": True}

    def op_delete_item(self, r: dict) -> dict:
        wanted = RETURNS.get(r.get("return_values"), "none") == "all_old"
        old = self.db.delete_item(_field(r, "table"), _field(r, "partition_key"), r.get("sort_key"), _expression(r, "condition"), wanted)
        return _item(old) if wanted else {"ok": True}

    def op_update_item(self, r: dict) -> dict:
        wanted = RETURNS.get(r.get("return_values"), "none")
        found = self.db.update_item(_field(r, "table"), _field(r, "partition_key"), r.get("sort_key"), from_wire(_field(r, "updates")), _expression(r, "condition"), wanted)
        return _item(found) if wanted != "none" else {"ok": True}

    def op_batch_get_item(self, r: dict) -> dict:
        keys = _field(r, "keys")
        if len(keys) > MAX_BATCH_GET:
            raise BatchSizeLimitExceeded(f"at most {MAX_BATCH_GET} keys, got {len(keys)}")
        table = self._table(r)
        pairs = [(k["partition_key"], *([k["sort_key"]] if k.get("sort_key") is not None else [])) for k in keys]
        return {"ok": True, "items": table.batch_get_items(pairs, r.get("projection"))}

    def op_batch_write_item(self, r: dict) -> dict:
        """Puts {"put": item} and deletes {"delete": {"partition_key", "sort_key"?}} of one table, at most 25, in one commit."""
        table, operations = _field(r, "table"), _field(r, "operations")
        if len(operations) > MAX_BATCH_WRITE:
            raise BatchSizeLimitExceeded(f"at most {MAX_BATCH_WRITE} operations, got {len(operations)}")
        self.db.write_batch([("put", table, o["put"]) if "put" in o else ("delete", table, o["delete"]["partition_key"], o["delete"].get("sort_key")) for o in operations])
        return {"ok": True}

    # --- reads of many ---

    def _page(self, builder, r: dict) -> dict:
        if r.get("filter") is not None:
            builder = builder.filter(_expression(r, "filter"))
        if r.get("limit") is not None:
            builder = builder.limit(r["limit"])
        if r.get("exclusive_start_key") is not None:
            builder = builder.exclusive_start_key(r["exclusive_start_key"])
        if r.get("projection"):
            builder = builder.projection(r["projection"])
        page = builder.execute()
        return {"ok": True, "items": page.items} | ({} if page.last_evaluated_key is None else {"last_evaluated_key": page.last_evaluated_key})

    def _query(self, r: dict):
        builder = self._table(r).query().partition_key(_field(r, "partition_key"))
        condition = r.get("sort_key_condition")
        if condition is not None:
            op = condition.get("op")
            try:
                if op == "between":
                    builder = builder.sort_key_between(condition["low"], condition["high"])
                elif op == "begins_with":
                    builder = builder.sort_key_begins_with(condition["prefix"])
                elif op in ("eq", "lt", "le", "gt", "ge"):
                    builder = getattr(builder, f"sort_key_{op}")(condition["value"])
                else:
                    raise InvalidCondition(f"invalid sort key condition: {op}")
            except KeyError as e:
                raise BadRequest(f"missing field `{e.args[0]}`") from e
        return builder.scan_forward(r.get("scan_forward") is not False)

    def op_query(self, r: dict) -> dict:
        return self._page(self._query(r), r)

    def op_scan(self, r: dict) -> dict:
        return self._page(self._table(r).scan(), r)

    def op_query_index(self, r: dict) -> dict:
        builder = self._table(r).query_index(_field(r, "index_name")).key_value(_field(r, "key_value"))
        return self._page(builder.scan_forward(r.get("scan_forward") is not False), r)

    def op_count(self, r: dict) -> dict:
        builder = self._query(r) if "partition_key" in r else self._table(r).scan()
        if r.get("filter") is not None:
            builder = builder.filter(_expression(r, "filter"))
        return {"ok": True, "count": builder.count().first()["count"]}

    def op_list_partition_keys(self, r: dict) -> dict:
        return {"ok": True, "keys": [key_to_json(row[0]) for row in self._table(r).list_partition_keys(r.get("limit")).collect()]}

    def op_list_sort_key_prefixes(self, r: dict) -> dict:
        rows = self._table(r).list_sort_key_prefixes(_field(r, "partition_key"), r.get("limit")).collect()
        return {"ok": True, "keys": [row["prefix"] for row in rows]}

    # --- definitions ---

    def op_create_table(self, r: dict) -> dict:
        pk, sk = _field(r, "partition_key"), r.get("sort_key")
        self.db.create_table(TableSchema(_field(r, "table"), pk["name"], KeyType.parse(pk["type"]), sk["name"] if sk else None, KeyType.parse(sk["type"]) if sk else None, r.get("ttl_attribute")))
        return {"ok": True}

    def op_drop_table(self, r: dict) -> dict:
        self.db.drop_table(_field(r, "table"))
        return {"ok": True}

    def op_list_tables(self, r: dict) -> dict:
        return {"ok": True, "tables": self.db.list_tables()}

    def op_describe_table(self, r: dict) -> dict:
        s = self.db.describe_table(_field(r, "table"))
        found: dict = {"name": s.name, "partition_key": {"name": s.partition_key, "type": s.partition_type.value}}
        if s.sort_key:
            found["sort_key"] = {"name": s.sort_key, "type": s.sort_type.value}
        if s.ttl_attribute:
            found["ttl_attribute"] = s.ttl_attribute
        return {"ok": True, "schema": found}

    def op_create_schema(self, r: dict) -> dict:
        attributes = tuple(AttributeDef(a["name"], AttrType.parse(a["type"]), a.get("required", False)) for a in r.get("attributes", []))
        self.db.create_partition_schema(_field(r, "table"), PartitionSchema(_field(r, "prefix"), r.get("description") or "", attributes, r.get("validate", False)))
        return {"ok": True}

    def op_drop_schema(self, r: dict) -> dict:
        self.db.drop_partition_schema(_field(r, "table"), _field(r, "prefix"))
        return {"ok": True}

    def op_list_schemas(self, r: dict) -> dict:
        return {"ok": True, "schemas": [_schema(s) for s in self.db.list_partition_schemas(_field(r, "table"))]}

    def op_describe_schema(self, r: dict) -> dict:
        return {"ok": True, "schema": _schema(self.db.describe_partition_schema(_field(r, "table"), _field(r, "prefix")))}

    def op_create_index(self, r: dict) -> dict:
        key = _field(r, "index_key")
        self.db.create_index(_field(r, "table"), IndexDefinition(_field(r, "name"), key["name"], KeyType.parse(key["type"]), r.get("partition_schema")))
        return {"ok": True}

    def op_drop_index(self, r: dict) -> dict:
        self.db.drop_index(_field(r, "table"), _field(r, "name"))
        return {"ok": True}

    def op_list_indexes(self, r: dict) -> dict:
        return {"ok": True, "indexes": [_index(i) for i in self.db.list_indexes(_field(r, "table"))]}

    def op_describe_index(self, r: dict) -> dict:
        return {"ok": True, "index": _index(self.db.describe_index(_field(r, "table"), _field(r, "name")))}


def server(db: Database, path: str) -> socketserver.ThreadingUnixStreamServer:
    """A server on a Unix socket: a request per line, a response per line. Call serve_forever() on it."""
    dispatch = Dispatcher(db)

    class Lines(socketserver.StreamRequestHandler):
        def handle(self):
            for line in self.rfile:
                if line.strip():
                    self.wfile.write(json.dumps(dispatch(line.decode("utf-8", "replace"))).encode() + b"\n")
                    self.wfile.flush()

    class Server(socketserver.ThreadingUnixStreamServer):
        daemon_threads = True

    return Server(path, Lines)


class ServerError(Exception):
    def __init__(self, response: dict):
        super().__init__(f"{response['error']}: {response.get('message', '')}")
        self.name, self.response = response["error"], response


class Client:
    """Requests over a socket path, or straight to a Dispatcher: client.get_item(table=..., partition_key=...)."""

    def __init__(self, target: str | Dispatcher):
        self.dispatch, self.file = (None, None) if isinstance(target, str) else (target, None)
        if isinstance(target, str):
            self.socket = socket.socket(socket.AF_UNIX)
            self.socket.connect(target)
            self.file = self.socket.makefile("rwb")

    def request(self, **request: Any) -> dict:
        """The response; raises ServerError for an error."""
        if self.dispatch is not None:
            response = self.dispatch(request)
        else:
            self.file.write(json.dumps(request).encode() + b"\n")
            self.file.flush()
            response = json.loads(self.file.readline())
        if "error" in response:
            raise ServerError(response)
        return response

    def __getattr__(self, op: str):
        if op.startswith("_") or not hasattr(Dispatcher, f"op_{op}"):
            raise AttributeError(op)
        return lambda **fields: self.request(op=op, **fields)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.socket.close()


class AsyncClient:
    """The client for asyncio: ``client = await AsyncClient.connect(path)``, then ``await client.get_item(table=..., ...)``."""

    def __init__(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter):
        self.reader, self.writer, self.turn = reader, writer, asyncio.Lock()

    @classmethod
    async def connect(cls, path: str) -> AsyncClient:
        return cls(*await asyncio.open_unix_connection(path, limit=1 << 26))

    async def request(self, **request: Any) -> dict:
        """The response; raises ServerError for an error. Requests of one client go one after the other."""
        async with self.turn:
            self.writer.write(json.dumps(request).encode() + b"\n")
            await self.writer.drain()
            response = json.loads(await self.reader.readline())
        if "error" in response:
            raise ServerError(response)
        return response

    def __getattr__(self, op: str):
        if op.startswith("_") or not hasattr(Dispatcher, f"op_{op}"):
            raise AttributeError(op)
        return lambda **fields: self.request(op=op, **fields)

    async def close(self) -> None:
        self.writer.close()
        await self.writer.wait_closed()
