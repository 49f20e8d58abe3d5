"""Queries through managed tables: the store, the wire protocol and the console, each with SQL that gives the same rows.

``places`` holds a managed table of nations keyed by region and name, with a validated prefix and an index. Answers of
single requests are flattened to rows; which rows are touched comes from the test tables.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import update as U
from ..sources.store import Database
from ..types import AttributeDef, AttrType, DocError, IndexDefinition, KeyType, PartitionSchema, TableSchema, VersionMismatch
from .console import Console
from .protocol import Dispatcher
from .workload import _ALIVE, NOW, _read, events, query

S, N = KeyType.STRING, KeyType.NUMBER
A = E.Attr


def _database(spark: SparkSession) -> Database:
    """A database in a folder of its own, which goes when the driver's Python ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tidemark-")
    db = Database.create(spark, f"{root}/managed-{uuid.uuid4().hex}")

    def remove() -> None:
        try:
            db.files.remove("")
        except Exception:  # the JVM may be gone already
            return

    atexit.register(remove)
    return db


def places(spark: SparkSession, sf: str) -> Database:
    db = _database(spark)
    db.create_table(TableSchema("places", "pk", S, "sk", S))
    nations = _read(spark, sf, "nation")
    db.bulk_put("places", nations.select(F.concat(F.lit("REGION#"), "n_regionkey").alias("pk"), F.col("n_name").alias("sk"), F.col("n_nationkey").alias("num"), F.expr("right(n_name, 1)").alias("letter")))
    db.create_partition_schema("places", PartitionSchema("REGION", "nations by region", (AttributeDef("num", AttrType.NUMBER, True), AttributeDef("letter", AttrType.STRING))))
    db.create_index("places", IndexDefinition("by_letter", "letter", S, "REGION"))
    return db


_PLACES = "(SELECT 'REGION#' || n_regionkey AS pk, n_name AS sk, n_nationkey::BIGINT AS num, right(n_name, 1) AS letter FROM nation)"
_ITEM = "pk string, sk string, num long, letter string"


def _items(spark: SparkSession, items: list[dict], schema: str = _ITEM) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def _state(db: Database, table: str = "places") -> DataFrame:
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return db.state(table).select("pk", "sk", get("$.num", "long").alias("num"), get("$.letter", "string").alias("letter"))


# --- the store ---


@query(f"""SELECT user_id, event_id FROM events EXCEPT SELECT user_id, event_id FROM (SELECT user_id, event_id FROM events WHERE NOT ({_ALIVE}) ORDER BY 1, 2 LIMIT 100)""")
def sweep_expired_100(spark, sf):
    db = _database(spark)
    db.create_table(TableSchema("events", "user_id", N, "event_id", N, ttl_attribute="ttl"))
    db.bulk_put("events", events(spark, sf, ttl=True).df.select("user_id", "event_id", "ttl"))
    db.sweep_expired("events", 100, now=NOW)
    return db.state("events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"))


def _tried(run: Callable[[], object]) -> tuple[str, int | None]:
    """The error's name, and the actual version it tells; ok if there was none."""
    try:
        run()
    except VersionMismatch as e:
        return "VersionMismatch", e.actual
    except DocError as e:
        return type(e).__name__, None
    return "ok", None


@query("""SELECT n_nationkey::BIGINT AS num, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'ConditionCheckFailed' END AS outcome, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 ELSE n_nationkey END::BIGINT AS now
FROM nation WHERE n_regionkey = 2""")
def managed_conditional_put(spark, sf):
    """Puts that want an even number there, in one transaction each."""
    db, found = places(spark, sf), []
    for p in db.table("places").query().partition_key("REGION#2").execute().items:
        outcome, _ = _tried(lambda p=p: db.put_item("places", p | {"num": p["num"] + 100}, E.Or(*[E.Eq(A("num"), n) for n in range(0, 200, 2)])))
        found.append((p["num"], outcome, db.table("places").get(p["pk"], p["sk"])["num"]))
    return spark.createDataFrame(found, "num long, outcome string, now long")


@query("""SELECT * FROM (VALUES (1, 'first put, expecting 0', 'ok', NULL::BIGINT), (2, 'put, expecting another version', 'VersionMismatch', 0), (3, 'put, expecting its version', 'ok', NULL),
(4, 'after two deletes, expecting 0', 'VersionMismatch', 2), (5, 'after two deletes, expecting the last put', 'ok', NULL), (6, 'new key, expecting 3', 'VersionMismatch', -1)) AS t(step, what, outcome, actual_put)""")
def managed_expected_version(spark, sf):
    """Optimistic puts; ``actual_put`` is the number of the put whose version was found (-1: none, version 0)."""
    db = _database(spark)
    db.create_table(TableSchema("t", "k", S))
    versions: list[int] = []

    def put(expected, key="a"):
        db.put_item_conditional("t", {"k": key, "n": len(versions)}, expected)
        versions.append(db.latest())

    found = []

    def step(what, run):
        outcome, actual = _tried(run)
        found.append((len(found) + 1, what, outcome, None if actual is None else -1 if actual == 0 else versions.index(actual) + (len(versions) > 1)))

    step("first put, expecting 0", lambda: put(0))
    step("put, expecting another version", lambda: put(versions[0] + 5))
    step("put, expecting its version", lambda: put(versions[0]))
    db.delete_item("t", "a")
    db.delete_item("t", "a")
    step("after two deletes, expecting 0", lambda: put(0))
    step("after two deletes, expecting the last put", lambda: put(versions[1]))
    step("new key, expecting 3", lambda: put(3, "b"))
    return spark.createDataFrame(found, "step int, what string, outcome string, actual_put long")


@query(f"""SELECT what, pk, sk, num, letter FROM (SELECT 'old' AS what, * FROM {_PLACES} UNION ALL SELECT 'new', pk, sk, num + 7, 'x' FROM {_PLACES} UNION ALL SELECT 'put', pk, sk, num + 7, 'x' FROM {_PLACES}
UNION ALL SELECT 'deleted', pk, sk, 0, NULL FROM {_PLACES}) WHERE sk = 'NATION_7'""")
def managed_return_values(spark, sf):
    """What update, put and delete return: the item before or after."""
    db = places(spark, sf)
    home = db.table("places").scan().filter(E.Eq(A("sk"), "NATION_7")).execute().items[0]["pk"]
    found = [("old", db.update_item("places", home, "NATION_7", [U.Set("num", 1)], return_values="all_old"))]
    db.put_item("places", found[0][1])
    found.append(("new", db.update_item("places", home, "NATION_7", [U.Add("num", 7), U.Set("letter", "x")], return_values="all_new")))
    found.append(("put", db.put_item("places", {"pk": home, "sk": "NATION_7", "num": 0}, return_old=True)))
    found.append(("deleted", db.delete_item("places", home, "NATION_7", return_old=True)))
    return spark.createDataFrame([(w, i["pk"], i["sk"], int(i["num"]), i.get("letter")) for w, i in found], f"what string, {_ITEM}")


@query(f"""SELECT pk, sk, CASE WHEN pk = 'REGION#1' THEN num * 2 ELSE num END AS num, letter FROM {_PLACES} WHERE pk <> 'REGION#3'""")
def managed_transaction(spark, sf):
    """One transaction reads items, its own writes included, and writes; another raises and leaves nothing."""
    db = places(spark, sf)
    table = db.table("places")

    def body(t):
        for p in table.query().partition_key("REGION#1").execute().items:
            t.put("places", p | {"num": t.get("places", p["pk"], p["sk"])["num"] + 1})
            t.put("places", p | {"num": 2 * (t.get("places", p["pk"], p["sk"])["num"] - 1)})
        for p in table.query().partition_key("REGION#3").execute().items:
            t.delete("places", p["pk"], p["sk"])

    db.transact(body)

    def broken(t):
        t.delete("places", "REGION#0", table.query().partition_key("REGION#0").execute().items[0]["sk"])
        t.put("places", {"pk": "REGION#0"})

    _tried(lambda: db.transact(broken))
    return _state(db)


@query(f"SELECT pk, sk, num, letter, version FROM (SELECT *, CASE WHEN num % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM {_PLACES}) WHERE pk = 'REGION#0' OR version = 2")
def managed_versions(spark, sf):
    """Versions as counted from the load: a later batch gives its items the next one."""
    db = places(spark, sf)
    loaded, rows = db.latest(), db.table("places").scan().execute().items
    again = [r for r in rows if r["num"] % 5 == 0]
    db.write_batch([("put", "places", r) for r in again])
    now, found = db.table("places"), []
    for r in rows:
        if r["pk"] == "REGION#0" or r in again:
            versioned = now.get_versioned(r["pk"], r["sk"])
            found.append(versioned["item"] | {"version": 2 if versioned["version"] > loaded else 1})
    return _items(spark, found, f"{_ITEM}, version long")


@query(f"SELECT pk, sk, num, letter FROM {_PLACES} WHERE num % 2 = 1 UNION ALL SELECT pk, sk, num, 'z' FROM {_PLACES} WHERE num % 10 = 0")
def managed_compaction(spark, sf):
    """Deletes, puts, a compaction and a removal of the files before it keep the state."""
    db = places(spark, sf)
    rows = _read(spark, sf, "nation").select(F.concat(F.lit("REGION#"), "n_regionkey").alias("pk"), F.col("n_name").alias("sk"), F.col("n_nationkey").alias("num"))
    db.bulk_delete("places", rows.where("num % 2 = 0").select("pk", "sk"))
    db.bulk_put("places", rows.where("num % 10 = 0").withColumn("letter", F.lit("z")))
    db.compact("places")
    db.vacuum("places")
    return _state(db)


@query(f"SELECT pk, sk, num, letter FROM {_PLACES}")
def managed_snapshot(spark, sf):
    """The state as of a snapshot, after all items changed and some went."""
    db = places(spark, sf)
    before = db.latest()
    db.bulk_delete("places", db.state("places").select("pk", "sk"))
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return db.table("places", snapshot=before).scan().to_df(ordered=False).select("pk", "sk", get("$.num", "long").alias("num"), get("$.letter", "string").alias("letter"))


@query("""SELECT * FROM (VALUES ('create table again', 'TableAlreadyExists'), ('create schema again', 'PartitionSchemaAlreadyExists'), ('create index again', 'IndexAlreadyExists'), ('index of no schema', 'PartitionSchemaNotFound'),
('drop a schema with an index', 'PartitionSchemaHasIndexes'), ('drop no index', 'IndexNotFound'), ('drop the index', 'ok'), ('drop the schema', 'ok'), ('drop no schema', 'PartitionSchemaNotFound'), ('drop the table', 'ok'),
('drop no table', 'TableNotFound'), ('key update', 'TableNotFound'), ('create the table anew', 'ok'), ('update of a key', 'KeyAttributeUpdate'), ('add of a string', 'UpdateTypeMismatch'), ('put without a key', 'MissingKeyAttribute')) AS t(what, outcome)""")
def managed_definitions(spark, sf):
    """What definitions and guarded writes answer."""
    db = places(spark, sf)
    schema, prefix, index = db.describe_table("places"), db.describe_partition_schema("places", "REGION"), db.describe_index("places", "by_letter")
    steps = [
        ("create table again", lambda: db.create_table(schema)), ("create schema again", lambda: db.create_partition_schema("places", prefix)), ("create index again", lambda: db.create_index("places", index)),
        ("index of no schema", lambda: db.create_index("places", IndexDefinition("other", "num", N, "NONE"))), ("drop a schema with an index", lambda: db.drop_partition_schema("places", "REGION")),
        ("drop no index", lambda: db.drop_index("places", "none")), ("drop the index", lambda: db.drop_index("places", "by_letter")), ("drop the schema", lambda: db.drop_partition_schema("places", "REGION")),
        ("drop no schema", lambda: db.drop_partition_schema("places", "REGION")), ("drop the table", lambda: db.drop_table("places")), ("drop no table", lambda: db.drop_table("places")),
        ("key update", lambda: db.update_item("places", "x", "y", [U.Set("pk", "z")])), ("create the table anew", lambda: db.create_table(schema)), ("update of a key", lambda: db.update_item("places", "x", "y", [U.Set("pk", "z")])),
        ("add of a string", lambda: db.update_item("places", "x", "y", [U.Add("num", "z")])), ("put without a key", lambda: db.put_item("places", {"pk": "x"})),
    ]
    return spark.createDataFrame([(what, _tried(run)[0]) for what, run in steps], "what string, outcome string")


# --- the wire protocol ---


def _wire(name: str, sql: str, requests: list[dict], take: Callable[[list[dict]], list[tuple]] | None = None, schema: str = _ITEM) -> None:
    """A query that sends requests and returns the last answer's items, or what take makes of all answers, or with take
    None and schema "" the table's state after them."""

    def run(spark, sf):
        db = places(spark, sf)
        send = Dispatcher(db)
        answers = [send({"table": "places"} | r) for r in requests]
        if take is not None:
            return spark.createDataFrame(take(answers), schema)
        if schema:
            last = answers[-1]
            return _items(spark, last["items"] if "items" in last else [last["item"]], schema)
        return _state(db)

    run.__name__ = f"protocol_{name}"
    query(sql)(run)


_KEY = {"partition_key": "REGION#4", "sort_key": "NATION_9"}
_wire("get_item", f"SELECT * FROM {_PLACES} WHERE pk = 'REGION#4' AND sk = 'NATION_9'", [{"op": "get_item"} | _KEY])
_wire("get_item_versioned", f"SELECT pk, sk, num, letter, true AS versioned FROM {_PLACES} WHERE pk = 'REGION#4' AND sk = 'NATION_9'", [{"op": "get_item_versioned"} | _KEY],
      lambda x: [(*(x[0]["item"][k] for k in ("pk", "sk", "num", "letter")), x[0]["version"] > 0)], f"{_ITEM}, versioned boolean")
_wire("put_item", f"SELECT * FROM {_PLACES} WHERE sk <> 'NATION_9' UNION ALL SELECT 'REGION#4', 'NATION_9', 77, 'e' UNION ALL SELECT 'REGION#9', 'MARS', 1, NULL",
      [{"op": "put_item", "item": {"pk": "REGION#4", "sk": "NATION_9", "num": 77, "letter": "e"}}, {"op": "put_item", "item": {"pk": "REGION#9", "sk": "MARS", "num": 1}}, {"op": "put_item", "item": {"pk": "REGION#4", "sk": "NATION_9", "num": 5}, "condition": {"Eq": [{"Attr": "num"}, {"Literal": 5}]}}], schema="")
_wire("delete_item", f"SELECT * FROM {_PLACES} WHERE sk <> 'NATION_9'", [{"op": "delete_item"} | _KEY, {"op": "delete_item", "partition_key": "REGION#4", "sort_key": "NOWHERE"}], schema="")
_wire("update_item", f"SELECT pk, sk, CASE WHEN sk = 'NATION_9' THEN num + 10 ELSE num END AS num, CASE WHEN sk <> 'NATION_9' THEN letter END AS letter FROM {_PLACES}",
      [{"op": "update_item", "updates": [{"action": "add", "path": "num", "value": 10}, {"action": "remove", "path": "letter"}]} | _KEY], schema="")
_wire("scan", f"SELECT * FROM (SELECT * FROM {_PLACES} ORDER BY pk, sk LIMIT 12) WHERE num >= 5", [{"op": "scan", "limit": 12, "filter": {"Ge": [{"Attr": "num"}, {"Literal": 5}]}}])
_wire("query_index", f"SELECT * FROM (SELECT * FROM {_PLACES} WHERE letter = '3' ORDER BY pk DESC, sk DESC LIMIT 3)", [{"op": "query_index", "index_name": "by_letter", "key_value": "3", "limit": 3, "scan_forward": False}])
_wire("batch_get_item", f"SELECT place, sk FROM (VALUES (0, 'NATION_9'), (1, NULL), (2, 'NATION_5')) AS t(place, sk) WHERE sk IS NULL OR sk IN (SELECT sk FROM {_PLACES} WHERE pk IN ('REGION#4', 'REGION#0'))",
      [{"op": "batch_get_item", "keys": [_KEY, {"partition_key": "REGION#4", "sort_key": "NOWHERE"}, {"partition_key": "REGION#0", "sort_key": "NATION_5"}]}],
      lambda x: [(i, item and item["sk"]) for i, item in enumerate(x[0]["items"])], "place int, sk string")
_wire("batch_write_item", f"SELECT * FROM {_PLACES} WHERE sk <> 'NATION_5' UNION ALL SELECT 'REGION#0', 'ATLANTIS', 99, NULL",
      [{"op": "batch_write_item", "operations": [{"put": {"pk": "REGION#0", "sk": "ATLANTIS", "num": 99}}, {"delete": {"partition_key": "REGION#0", "sort_key": "NATION_5"}}]}], schema="")
_wire("count", f"SELECT count(*) AS n FROM {_PLACES} WHERE pk = 'REGION#2' AND num > 8", [{"op": "count", "partition_key": "REGION#2", "filter": {"Gt": [{"Attr": "num"}, {"Literal": 8}]}}], lambda x: [(x[0]["count"],)], "n long")
_wire("list_partition_keys", f"SELECT DISTINCT pk FROM {_PLACES}", [{"op": "list_partition_keys"}], lambda x: [(k,) for k in x[0]["keys"]], "pk string")
_wire("list_sort_key_prefixes", f"SELECT DISTINCT sk AS prefix FROM {_PLACES} WHERE pk = 'REGION#3'", [{"op": "list_sort_key_prefixes", "partition_key": "REGION#3"}], lambda x: [(k,) for k in x[0]["keys"]], "prefix string")

_PETS = {"op": "create_table", "table": "pets", "partition_key": {"name": "id", "type": "Number"}, "ttl_attribute": "until"}
_wire("create_table", "SELECT * FROM (VALUES ('pets', 'id', 'Number', NULL, 'until'), ('places', 'pk', 'String', 'sk', NULL)) AS t(name, pk, type, sk, ttl)", [_PETS, {"op": "describe_table", "table": "pets"}, {"op": "describe_table"}],
      lambda x: [(s["name"], s["partition_key"]["name"], s["partition_key"]["type"], s.get("sort_key", {}).get("name"), s.get("ttl_attribute")) for s in (y["schema"] for y in x[1:])], "name string, pk string, type string, sk string, ttl string")
_wire("drop_table", "SELECT * FROM (VALUES (0, 'places'), (1, 'pets'), (1, 'places'), (2, 'pets')) AS t(step, name)", [{"op": "list_tables"}, _PETS, {"op": "list_tables"}, {"op": "drop_table"}, {"op": "list_tables"}],
      lambda x: [(i, n) for i, y in enumerate((x[0], x[2], x[4])) for n in y["tables"]], "step int, name string")
_CAT = {"op": "create_schema", "prefix": "CAT", "description": "cats", "attributes": [{"name": "age", "type": "Number", "required": True}], "validate": True}
_wire("create_schema", "SELECT * FROM (VALUES (0, 'CAT', 'cats', true), (0, 'REGION', 'nations by region', false), (1, 'REGION', 'nations by region', false)) AS t(step, prefix, description, validate)",
      [_CAT, {"op": "list_schemas"}, {"op": "drop_schema", "prefix": "CAT"}, {"op": "list_schemas"}], lambda x: [(i, s["prefix"], s["description"], s["validate"]) for i, y in enumerate((x[1], x[3])) for s in y["schemas"]], "step int, prefix string, description string, validate boolean")
_wire("describe_schema", "SELECT * FROM (VALUES ('num', 'Number', true), ('letter', 'String', false)) AS t(name, type, required)", [{"op": "describe_schema", "prefix": "REGION"}],
      lambda x: [(a["name"], a["type"], a["required"]) for a in x[0]["schema"]["attributes"]], "name string, type string, required boolean")
_wire("validated_put", "SELECT * FROM (VALUES (0, 'InternalError'), (1, NULL), (2, NULL)) AS t(step, error)",
      [_CAT, {"op": "put_item", "item": {"pk": "CAT#1", "sk": "a", "age": "old"}}, {"op": "put_item", "item": {"pk": "CAT#1", "sk": "a", "age": 4}}, {"op": "put_item", "item": {"pk": "DOG#1", "sk": "a"}}], lambda x: [(i, y.get("error")) for i, y in enumerate(x[1:])], "step int, error string")
_NUMBERS = {"op": "create_index", "name": "by_num", "index_key": {"name": "num", "type": "Number"}}
_wire("create_index", "SELECT * FROM (VALUES (0, 'by_letter', 'letter', 'REGION'), (0, 'by_num', 'num', NULL), (1, 'by_letter', 'letter', 'REGION')) AS t(step, name, attribute, scope)",
      [_NUMBERS, {"op": "list_indexes"}, {"op": "drop_index", "name": "by_num"}, {"op": "list_indexes"}], lambda x: [(i, d["name"], d["index_key"]["name"], d.get("partition_schema")) for i, y in enumerate((x[1], x[3])) for d in y["indexes"]], "step int, name string, attribute string, scope string")
_wire("describe_index", "SELECT 'by_letter' AS name, 'String' AS type", [{"op": "describe_index", "name": "by_letter"}], lambda x: [(x[0]["index"]["name"], x[0]["index"]["index_key"]["type"])], "name string, type string")
_wire("query_new_index", f"SELECT * FROM {_PLACES} WHERE num = 7", [_NUMBERS, {"op": "query_index", "index_name": "by_num", "key_value": 7}])


@query("SELECT conv_id::DOUBLE AS conv_id, turn::DOUBLE AS turn, role FROM conversations WHERE conv_id = 5 AND turn >= 1 AND role = 'assistant'")
def protocol_query(spark, sf):
    request = {"op": "query", "table": "turns", "partition_key": 5, "sort_key_condition": {"op": "ge", "value": 1}, "filter": {"Eq": [{"Attr": "role"}, {"Literal": "assistant"}]}, "projection": ["role"]}
    return _turned(spark, Dispatcher(_turns(spark, sf))(request))


# --- the console ---


def _turns(spark: SparkSession, sf: str) -> Database:
    db = _database(spark)
    db.create_table(TableSchema("turns", "conv_id", N, "turn", N))
    db.bulk_put("turns", _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return db


def _turned(spark: SparkSession, answer: dict) -> DataFrame:
    return spark.createDataFrame([(float(i["conv_id"]), float(i["turn"]), i["role"]) for i in answer["items"]], "conv_id double, turn double, role string")


def _lines(name: str, sql: str, lines: list[str], take: Callable[[list[dict]], list[tuple]] | None = None, schema: str = _ITEM) -> None:
    """A query that runs lines and returns the last answer's items, or what take makes of all, or with schema "" the state."""

    def run(spark, sf):
        db = places(spark, sf)
        console = Console(db)
        answers = [console.run(line) for line in lines]
        if take is not None:
            return spark.createDataFrame(take(answers), schema)
        if schema:
            last = answers[-1]
            return _items(spark, last["items"] if "items" in last else [last["item"]], schema)
        return _state(db)

    run.__name__ = f"console_{name}"
    query(sql)(run)


@query("SELECT conv_id::DOUBLE AS conv_id, turn::DOUBLE AS turn, role FROM (SELECT * FROM conversations WHERE conv_id = 5 ORDER BY turn DESC LIMIT 3)")
def console_query(spark, sf):
    return _turned(spark, Console(_turns(spark, sf)).run("QUERY turns pk=5 LIMIT 3 DESC"))


_lines("get", f"SELECT * FROM {_PLACES} WHERE pk = 'REGION#4' AND sk = 'NATION_9'", ["USE places", 'GET pk="REGION#4" sk=NATION_9'])
_lines("put", f"SELECT * FROM {_PLACES} UNION ALL SELECT 'REGION#9', 'MARS', 3, NULL", ['PUT places {"pk": "REGION#9", "sk": "MARS", "num": 3}'], schema="")
_lines("delete", f"SELECT * FROM {_PLACES} WHERE sk <> 'NATION_9'", ["DELETE places pk=REGION#4 sk=NATION_9"], schema="")
_lines("update", f"SELECT pk, sk, CASE WHEN sk = 'NATION_9' THEN num + 2 ELSE num END AS num, CASE WHEN sk = 'NATION_9' THEN 'two words' ELSE letter END AS letter FROM {_PLACES}", ['UPDATE places pk=REGION#4 sk=NATION_9 SET letter="two words" ADD num=2'], schema="")
_lines("scan", f"SELECT * FROM {_PLACES} ORDER BY pk, sk LIMIT 6", ["SCAN places LIMIT 6"])
_lines("query_range", f"SELECT * FROM {_PLACES} WHERE pk = 'REGION#3' AND sk BETWEEN 'NATION_1' AND 'NATION_3'", ["QUERY places pk=REGION#3 BETWEEN NATION_1 AND NATION_3"])
_lines("query_index", f"SELECT * FROM {_PLACES} WHERE letter = '4'", ["USE places", 'QUERY INDEX by_letter letter="4"'])
_lines("list", f"SELECT 'keys' AS kind, pk AS name FROM (SELECT DISTINCT pk FROM {_PLACES} ORDER BY 1 LIMIT 2) UNION ALL SELECT 'tables', 'places' UNION ALL SELECT 'prefixes', sk FROM {_PLACES} WHERE pk = 'REGION#1'",
       ["LIST TABLES", "LIST KEYS places LIMIT 2", "LIST PREFIXES places pk=REGION#1"], lambda x: [("tables", n) for n in x[0]["tables"]] + [("keys", n) for n in x[1]["partition_keys"]] + [("prefixes", n) for n in x[2]["sort_key_prefixes"]], "kind string, name string")
_lines("definitions", "SELECT * FROM (VALUES (0, 'boats'), (1, 'places'), (2, 'places')) AS t(step, name)",
       ["CREATE TABLE boats PK harbour STRING SK berth NUMBER TTL gone", "LIST TABLES", "DROP TABLE boats", "LIST TABLES"], lambda x: [(i, n) for i, n in enumerate([*x[1]["tables"], *x[3]["tables"]])], "step int, name string")
_lines("schemas", "SELECT * FROM (VALUES (0, 'CAT'), (0, 'REGION'), (1, 'REGION')) AS t(step, prefix)", ["USE places", "CREATE SCHEMA PREFIX CAT ATTR age NUMBER REQUIRED VALIDATE", "LIST SCHEMAS", "DROP SCHEMA CAT", "LIST SCHEMAS"],
       lambda x: [(i, s["prefix"]) for i, y in enumerate((x[2], x[4])) for s in y["partition_schemas"]], "step int, prefix string")
_lines("indexes", "SELECT * FROM (VALUES (0, 'by_letter'), (0, 'by_num'), (1, 'by_letter')) AS t(step, name)", ["USE places", "CREATE INDEX by_num SCHEMA REGION KEY num NUMBER", "LIST INDEXES", "DROP INDEX by_num", "LIST INDEXES"],
       lambda x: [(i, d["name"]) for i, y in enumerate((x[2], x[4])) for d in y["indexes"]], "step int, name string")
_lines("describe", "SELECT * FROM (VALUES ('table', 'pk'), ('schema', 'false'), ('index', 'by_letter')) AS t(what, answer)", ["USE places", "DESCRIBE TABLE", "DESCRIBE SCHEMA REGION", "DESCRIBE INDEX by_letter"],
       lambda x: [("table", x[1]["partition_key"]["name"]), ("schema", str(x[2]["validate"]).lower()), ("index", x[3]["name"])], "what string, answer string")


@query("SELECT conv_id::DOUBLE AS conv_id, turn::DOUBLE AS turn, length(text)::BIGINT AS n FROM conversations WHERE role <> 'user' AND contains(text, 'the')")
def variant_scan_filter(spark, sf):
    rows = _turns(spark, sf).table("turns").scan().filter(E.And(E.Ne(A("role"), "user"), E.Contains(A("text"), "the"), E.Ne(A("absent.path"), 1))).to_df(ordered=False)
    return rows.select("conv_id", "turn", F.length(F.try_variant_get("doc", "$.text", "string")).cast("long").alias("n"))
