"""The console's command language: text to protocol requests, and answers to JSON or plain text.

Run ``python -m tidemark.plans.console ROOT`` for a prompt, with ``-e COMMAND`` for single commands, or with commands
on standard input; ``-j`` prints JSON. The first error of -e or piped commands ends the run with exit code 1.
"""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass, field
from typing import Any

from ..sources.store import Database
from .protocol import Dispatcher

HELP = {
    "CREATE": "CREATE TABLE name PK attr TYPE [SK attr TYPE] [TTL attr]\nCREATE SCHEMA [table] PREFIX p [DESCRIPTION text] (ATTR name TYPE [REQUIRED])* [VALIDATE]\nCREATE INDEX [table] name SCHEMA p KEY attr TYPE",
    "DROP": "DROP TABLE name | DROP SCHEMA [table] prefix | DROP INDEX [table] name",
    "LIST": "LIST TABLES | LIST KEYS [table] [LIMIT n] | LIST PREFIXES [table] pk=value [LIMIT n] | LIST SCHEMAS [table] | LIST INDEXES [table]",
    "DESCRIBE": "DESCRIBE TABLE [table] | DESCRIBE SCHEMA [table] prefix | DESCRIBE INDEX [table] name",
    "PUT": "PUT [table] {json}",
    "GET": "GET [table] pk=value [sk=value]",
    "DELETE": "DELETE [table] pk=value [sk=value]",
    "UPDATE": "UPDATE [table] pk=value [sk=value] (SET path=value | REMOVE path | ADD path=value | DELETE path=value)+",
    "QUERY": "QUERY [table] pk=value [SK op value] [BETWEEN lo AND hi] [BEGINS_WITH prefix] [LIMIT n] [DESC]\nQUERY INDEX [table] name key=value [LIMIT n] [DESC]",
    "SCAN": "SCAN [table] [LIMIT n]",
    "USE": "USE [table]",
}


class ParseError(Exception):
    """A command that isn't one."""


TOKEN = re.compile(r'\s*(?:(?P<json>[{\[])|(?P<text>"(?:\\.|[^"\\])*")|(?P<op><=|>=|<|>)|(?P<word>[^\s"{\[<>]+(?:(?<==)"(?:\\.|[^"\\])*")?))')


def tokenize(line: str) -> list[str]:
    """Words, quoted texts and whole JSON values; comparison signs stand alone."""
    out, at = [], 0
    line = line.strip()
    while at < len(line):
        found = TOKEN.match(line, at)
        if not found:
            raise ParseError("Unterminated quoted string")
        if found["json"]:
            start = found.start("json")
            try:
                _, at = json.JSONDecoder().raw_decode(line, start)
            except ValueError as e:
                raise ParseError(f"Unterminated JSON {'object' if line[start] == '{' else 'array'}") from e
            out.append(line[start:at])
        else:
            out.append(found[found.lastgroup])
            at = found.end()
        while at < len(line) and line[at].isspace():
            at += 1
    return out


def value(token: str) -> Any:
    """Quoted text as it stands, a finite number as a float, anything else as text."""
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return token[1:-1]
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", token):
        return float(token)
    return token


@dataclass
class Command:
    kind: str
    request: dict = field(default_factory=dict)
    keys: dict = field(default_factory=dict)  # what key=value pairs say, by position


class _Reader:
    def __init__(self, tokens: list[str], name: str):
        self.tokens, self.at, self.name = tokens, 0, name

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def is_word(self, *words: str) -> bool:
        token = self.peek()
        return token is not None and token.upper() in words

    def take(self, what: str = "a value") -> str:
        token = self.peek()
        if token is None:
            raise ParseError(f"{self.name}: expected {what}\nUsage: {HELP.get(self.name.split()[0], self.name)}")
        self.at += 1
        return token

    def accept(self, word: str) -> bool:
        if self.is_word(word):
            self.at += 1
            return True
        return False

    def expect(self, word: str) -> None:
        token = self.take(word)
        if token.upper() != word:
            raise ParseError(f"Expected {word}, got '{token}'")

    def pair(self, what: str) -> tuple[str, Any]:
        token = self.take(f"{what}=<value>")
        name, sign, text = token.partition("=")
        if not sign or not name:
            raise ParseError(f"Expected {what}=<value>, got '{token}'")
        if not text:
            raise ParseError(f"Missing value after '=' in '{token}'")
        return name, value(text)

    def number(self) -> int:
        token = self.take("a number")
        if not token.isdigit():
            raise ParseError(f"LIMIT requires a number, got '{token}'")
        return int(token)

    def end(self) -> None:
        if self.peek() is not None:
            raise ParseError(f"Unexpected token '{self.peek()}' in {self.name}")


def _is_pair(token: str | None) -> bool:
    return token is not None and "=" in token and token[0] not in '{["='


def parse(line: str, table: str | None = None) -> Command:
    """One command; table stands in where a command leaves its table out."""
    tokens = tokenize(line.rstrip().removesuffix(";") if line.rstrip().endswith(";") else line)
    if not tokens:
        raise ParseError("Empty command")
    verb = tokens[0].upper()
    r = _Reader(tokens, verb)
    r.at = 1
    run = _VERBS.get(verb)
    if run is None:
        raise ParseError(f"Unknown command '{tokens[0]}'")
    return run(r, table)


def _need(table: str | None) -> str:
    if table is None:
        raise ParseError("No table named, and none in use (USE <table>)")
    return table


def _table_first(r: _Reader, table: str | None, given: bool) -> str:
    return r.take("a table") if given else _need(table)


def _limits(r: _Reader, request: dict, desc: bool) -> None:
    while r.peek() is not None:
        if r.accept("LIMIT"):
            request["limit"] = r.number()
        elif desc and r.accept("DESC"):
            request["scan_forward"] = False
        elif desc and r.accept("ASC"):
            request["scan_forward"] = True
        else:
            r.end()


def _create(r: _Reader, table: str | None) -> Command:
    if r.accept("TABLE"):
        r.name = "CREATE TABLE"
        request: dict = {"op": "create_table", "table": r.take("a name")}
        r.expect("PK")
        request["partition_key"] = {"name": r.take("an attribute"), "type": r.take("a type")}
        if r.accept("SK"):
            request["sort_key"] = {"name": r.take("an attribute"), "type": r.take("a type")}
        if r.accept("TTL"):
            request["ttl_attribute"] = r.take("an attribute")
        r.end()
        return Command("ok", request)
    if r.accept("SCHEMA"):
        r.name = "CREATE SCHEMA"
        request = {"op": "create_schema", "table": _table_first(r, table, not r.is_word("PREFIX")), "attributes": [], "validate": False}
        r.expect("PREFIX")
        request["prefix"] = str(value(r.take("a prefix")))
        while r.peek() is not None:
            if r.accept("DESCRIPTION"):
                request["description"] = str(value(r.take("a description")))
            elif r.accept("ATTR"):
                request["attributes"].append({"name": r.take("a name"), "type": r.take("a type"), "required": r.accept("REQUIRED")})
            elif r.accept("VALIDATE"):
                request["validate"] = True
            else:
                r.end()
        return Command("ok", request)
    if r.accept("INDEX"):
        r.name = "CREATE INDEX"
        request = {"op": "create_index", "table": _table_first(r, table, (r.peek(1) or "").upper() != "SCHEMA"), "name": r.take("a name")}
        r.expect("SCHEMA")
        request["partition_schema"] = str(value(r.take("a prefix")))
        r.expect("KEY")
        request["index_key"] = {"name": r.take("an attribute"), "type": r.take("a type")}
        r.end()
        return Command("ok", request)
    raise ParseError("Expected TABLE, SCHEMA, or INDEX after CREATE")


def _drop(r: _Reader, table: str | None) -> Command:
    if r.accept("TABLE"):
        request = {"op": "drop_table", "table": r.take("a name")}
    elif r.is_word("SCHEMA", "INDEX"):
        kind = r.take().lower()
        request = {"op": f"drop_{kind}", "table": _table_first(r, table, r.peek(1) is not None)}
        request["prefix" if kind == "schema" else "name"] = str(value(r.take("a name")))
    else:
        raise ParseError("Expected TABLE, SCHEMA, or INDEX after DROP")
    r.end()
    return Command("ok", request)


def _list(r: _Reader, table: str | None) -> Command:
    kind = r.take("TABLES, KEYS, PREFIXES, SCHEMAS, or INDEXES").upper()
    if kind == "TABLES":
        r.end()
        return Command("tables", {"op": "list_tables"})
    if kind in ("SCHEMAS", "INDEXES"):
        request = {"op": f"list_{kind.lower()}", "table": _table_first(r, table, r.peek() is not None)}
        r.end()
        return Command(kind.lower(), request)
    if kind == "KEYS":
        request = {"op": "list_partition_keys", "table": _table_first(r, table, r.peek() is not None and not r.is_word("LIMIT"))}
        _limits(r, request, False)
        return Command("keys", request)
    if kind == "PREFIXES":
        request = {"op": "list_sort_key_prefixes", "table": _table_first(r, table, not _is_pair(r.peek()))}
        request["partition_key"] = r.pair("pk")[1]
        _limits(r, request, False)
        return Command("prefixes", request)
    raise ParseError(f"Expected TABLES, KEYS, PREFIXES, SCHEMAS, or INDEXES after LIST, got '{kind}'")


def _describe(r: _Reader, table: str | None) -> Command:
    kind = r.take("TABLE, SCHEMA, or INDEX").upper()
    if kind == "TABLE":
        request = {"op": "describe_table", "table": _table_first(r, table, r.peek() is not None)}
    elif kind in ("SCHEMA", "INDEX"):
        request = {"op": f"describe_{kind.lower()}", "table": _table_first(r, table, r.peek(1) is not None)}
        request["prefix" if kind == "SCHEMA" else "name"] = str(value(r.take("a name")))
    else:
        raise ParseError("Expected TABLE, SCHEMA, or INDEX after DESCRIBE")
    r.end()
    return Command(f"describe_{kind.lower()}", request)


def _put(r: _Reader, table: str | None) -> Command:
    request: dict = {"op": "put_item", "table": _table_first(r, table, not (r.peek() or "").startswith("{"))}
    try:
        request["item"] = json.loads(r.take("{json}"))
    except ValueError as e:
        raise ParseError(f"Invalid JSON: {e}") from e
    r.end()
    return Command("ok", request)


def _keyed(r: _Reader, table: str | None, op: str) -> dict:
    request: dict = {"op": op, "table": _table_first(r, table, not _is_pair(r.peek()))}
    request["partition_key"] = r.pair("pk")[1]
    if _is_pair(r.peek()):
        request["sort_key"] = r.pair("sk")[1]
    return request


def _get(r: _Reader, table: str | None) -> Command:
    request = _keyed(r, table, "get_item")
    r.end()
    return Command("item", request)


def _delete(r: _Reader, table: str | None) -> Command:
    request = _keyed(r, table, "delete_item")
    r.end()
    return Command("ok", request)


def _update(r: _Reader, table: str | None) -> Command:
    request = _keyed(r, table, "update_item")
    request["updates"] = []
    while r.peek() is not None:
        action = r.take().lower()
        if action == "remove":
            request["updates"].append({"action": "remove", "path": r.take("a path")})
        elif action in ("set", "add", "delete"):
            token = r.take("path=value")
            path, sign, text = token.partition("=")
            if not sign:
                raise ParseError(f"{action.upper()} requires path=value, got '{token}'")
            request["updates"].append({"action": action, "path": path, "value": value(text) if text else json.loads(r.take("a value"))})
        else:
            raise ParseError(f"Expected SET, REMOVE, ADD, or DELETE, got '{action}'")
    if not request["updates"]:
        raise ParseError("UPDATE needs at least one action")
    return Command("ok", request)


def _query(r: _Reader, table: str | None) -> Command:
    if r.accept("INDEX"):
        r.name = "QUERY INDEX"
        request: dict = {"op": "query_index", "table": _table_first(r, table, not _is_pair(r.peek(1))), "index_name": r.take("an index")}
        request["key_value"] = r.pair("key")[1]
        _limits(r, request, True)
        return Command("items", request)
    request = {"op": "query", "table": _table_first(r, table, not _is_pair(r.peek()))}
    request["partition_key"] = r.pair("pk")[1]
    names = {"=": "eq", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    while r.peek() is not None:
        if r.accept("SK"):
            op = r.take("an operator")
            if op not in names:
                raise ParseError(f"Unknown sort key operator '{op}'")
            request["sort_key_condition"] = {"op": names[op], "value": value(r.take("a value"))}
        elif r.accept("BETWEEN"):
            low = value(r.take("a value"))
            r.expect("AND")
            request["sort_key_condition"] = {"op": "between", "low": low, "high": value(r.take("a value"))}
        elif r.accept("BEGINS_WITH"):
            request["sort_key_condition"] = {"op": "begins_with", "prefix": str(value(r.take("a prefix")))}
        elif r.accept("LIMIT"):
            request["limit"] = r.number()
        elif r.accept("DESC"):
            request["scan_forward"] = False
        elif r.accept("ASC"):
            request["scan_forward"] = True
        else:
            r.end()
    return Command("items", request)


def _scan(r: _Reader, table: str | None) -> Command:
    request = {"op": "scan", "table": _table_first(r, table, r.peek() is not None and not r.is_word("LIMIT"))}
    _limits(r, request, False)
    return Command("items", request)


def _use(r: _Reader, table: str | None) -> Command:
    name = r.take() if r.peek() is not None else None
    r.end()
    return Command("use", {"table": name})


def _help(r: _Reader, table: str | None) -> Command:
    return Command("help", {"topic": " ".join(r.tokens[1:]).upper()})


def _exit(r: _Reader, table: str | None) -> Command:
    return Command("exit")


_VERBS = {
    "CREATE": _create, "DROP": _drop, "LIST": _list, "DESCRIBE": _describe, "PUT": _put, "GET": _get, "DELETE": _delete,
    "UPDATE": _update, "QUERY": _query, "SCAN": _scan, "USE": _use, "HELP": _help, "EXIT": _exit, "QUIT": _exit,
}


class Console:
    """Runs commands against a database and keeps the table in use."""

    def __init__(self, db: Database):
        self.dispatch, self.table = Dispatcher(db), None

    def run(self, line: str) -> dict | None:
        """The answer as JSON has it; {"error": text} for errors; None to leave."""
        try:
            command = parse(line, self.table)
        except (ParseError, ValueError) as e:
            return {"error": str(e)}
        if command.kind == "exit":
            return None
        if command.kind == "use":
            self.table = command.request["table"]
            return {"ok": True, "active_table": self.table}
        if command.kind == "help":
            topic = command.request["topic"]
            return {"help": HELP.get(topic.split(" ")[0], "\n".join(HELP.values()))}
        response = self.dispatch(command.request)
        if "error" in response:
            return {"error": f"{response['error']}: {response['message']}"}
        return self.shaped(command, response)

    @staticmethod
    def shaped(command: Command, response: dict) -> dict:
        kind = command.kind
        if kind == "item":
            return {"found": True, "item": response["item"]} if "item" in response else {"found": False}
        if kind == "items":
            return {"items": response["items"], "count": len(response["items"]), "has_more": "last_evaluated_key" in response}
        if kind == "tables":
            return {"tables": response["tables"]}
        if kind == "keys":
            return {"partition_keys": response["keys"]}
        if kind == "prefixes":
            return {"sort_key_prefixes": response["keys"]}
        if kind == "schemas":
            return {"partition_schemas": response["schemas"]}
        if kind == "indexes":
            return {"indexes": response["indexes"]}
        if kind.startswith("describe_"):
            return response.get("schema") or response["index"]
        return {"ok": True, "message": "OK"}


def render(answer: dict) -> str:
    """An answer for people."""
    if "error" in answer:
        return f"Error: {answer['error']}"
    if "help" in answer:
        return answer["help"]
    if "items" in answer:
        return "\n".join([*(json.dumps(i, indent=2, ensure_ascii=False) for i in answer["items"]), f"({answer['count']} items{', more available' if answer['has_more'] else ''})"])
    if "found" in answer:
        return json.dumps(answer["item"], indent=2, ensure_ascii=False) if answer["found"] else "(not found)"
    for name in ("tables", "partition_keys", "sort_key_prefixes"):
        if name in answer:
            return "\n".join(map(str, answer[name])) or "(none)"
    return answer.get("message") or json.dumps(answer, indent=2, ensure_ascii=False)


def main(arguments: list[str] | None = None) -> int:
    import argparse

    from pyspark.sql import SparkSession

    options = argparse.ArgumentParser(prog="tidemark-console")
    options.add_argument("root")
    options.add_argument("-e", "--execute", action="append")
    options.add_argument("-j", "--json", action="store_true")
    given = options.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    db = Database(spark, given.root)
    db = Database.open(spark, given.root) if db.files.exists("_log") else Database.create(spark, given.root)
    console = Console(db)
    prompt = given.execute is None and sys.stdin.isatty()
    lines = given.execute if given.execute is not None else iter(lambda: input("> "), None) if prompt else sys.stdin
    try:
        for line in lines:
            if not line.strip():
                continue
            answer = console.run(line)
            if answer is None:
                break
            failed = "error" in answer
            print(json.dumps(answer, ensure_ascii=False) if given.json else render(answer), file=sys.stderr if failed else sys.stdout)
            if failed and not prompt:
                return 1
    except EOFError:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
