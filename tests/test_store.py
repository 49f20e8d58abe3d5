"""Managed tables: writes, reads, versions, definitions, feeds, protocol and console."""

import asyncio
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions import update as U
from tidemark.plans.console import Console, ParseError, parse, tokenize, value
from tidemark.plans.protocol import AsyncClient, Client, Dispatcher, ServerError, server
from tidemark.sources.store import Database
from tidemark.streaming import feed as feeds
from tidemark.types import (
    AttributeDef, AttrType, ConditionCheckFailed, DatabaseLocked, DocumentTooLarge, IndexAlreadyExists, IndexDefinition, IndexNotFound, InvalidIndexCursor, KeyAttributeUpdate, KeyTooLarge, KeyType,
    KeyTypeMismatch, MissingKeyAttribute, NaN, NullByteInKey, PartitionKeyRequired, PartitionSchema, PartitionSchemaAlreadyExists, PartitionSchemaHasIndexes, PartitionSchemaNotFound, SnapshotUnavailable,
    SortKeyNotSupported, SortKeyRequired, TableAlreadyExists, TableNotFound, TableSchema, UpdateTypeMismatch, ValidationFailed, VersionMismatch,
)

A = E.Attr
S, N, B = KeyType.STRING, KeyType.NUMBER, KeyType.BINARY


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, str(tmp_path / "db"))


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    db = Database.create(spark, str(tmp_path_factory.mktemp("users") / "db"))
    db.create_table(TableSchema("users", "pk", S, "sk", S))
    rows = [{"pk": "ORG#acme", "sk": f"USER#{i:04d}", "name": f"user{i}", "age": 20 + i, "status": ["active", "inactive"][i % 2], "score": i * 10} for i in range(10)]
    db.write_batch([("put", "users", r) for r in rows])
    return db


def test_limit_counts_evaluated_items(users):
    q = users.table("users").query().partition_key("ORG#acme").filter(E.Eq(A("status"), "active"))
    one = q.limit(5).execute()
    assert [i["age"] for i in one.items] == [20, 22, 24] and one.last_evaluated_key == {"pk": "ORG#acme", "sk": "USER#0004"}
    two = q.limit(5).exclusive_start_key(one.last_evaluated_key).execute()
    assert len(two.items) == 2 and two.last_evaluated_key is None
    assert q.limit(0).execute().last_evaluated_key is None and q.limit(0).execute().items == []
    assert q.limit(10).execute().last_evaluated_key is None
    none = q.limit(1).filter(E.Eq(A("status"), "inactive")).execute()
    assert none.items == [] and none.last_evaluated_key is not None


def test_directions_and_cursors(users):
    t = users.table("users")
    q = t.query().partition_key("ORG#acme").scan_forward(False).limit(4)
    pages = list(q.pages())
    assert [i["age"] for p in pages for i in p.items] == list(range(29, 19, -1)) and len(pages) == 3
    assert [i["age"] for p in t.scan().limit(3).pages() for i in p.items] == list(range(20, 30))
    assert t.scan().exclusive_start_key({"pk": "ORG#acme"}).execute().items[0]["age"] == 20
    with pytest.raises(MissingKeyAttribute):
        t.scan().exclusive_start_key({"sk": "x"}).execute()


def test_sort_conditions_and_projection(users):
    q = users.table("users").query().partition_key("ORG#acme")
    ages = lambda b: [i["age"] for i in b.execute().items]
    assert ages(q.sort_key_begins_with("USER#000")) == list(range(20, 30))
    assert ages(q.sort_key_between("USER#0002", "USER#0003")) == [22, 23]
    assert ages(q.sort_key_gt("USER#0007")) == [28, 29] and ages(q.sort_key_le("USER#0000")) == [20]
    assert q.sort_key_eq("USER#0001").projection(["name", "none"]).execute().items == [{"pk": "ORG#acme", "sk": "USER#0001", "name": "user1"}]
    with pytest.raises(KeyTypeMismatch):
        q.sort_key_eq(5).execute()
    with pytest.raises(PartitionKeyRequired):
        users.table("users").query().execute()


def test_keys(db):
    db.create_table(TableSchema("n", "k", N))
    db.create_table(TableSchema("b", "k", B))
    db.create_table(TableSchema("s", "k", S))
    db.put_item("n", {"k": -0.0, "v": 1})
    db.put_item("n", {"k": 5, "v": 2})
    assert db.table("n").get(0)["v"] == 1 and [r.k for r in db.table("n").list_partition_keys().collect()] == [0.0, 5.0]
    for k in ([1, 0, 255], [1], [0]):
        db.put_item("b", {"k": k})
    assert [i["k"] for i in db.table("b").scan().execute().items] == [[0], [1], [1, 0, 255]]
    for bad, error in ((float("nan"), NaN), ("x", KeyTypeMismatch), (True, KeyTypeMismatch)):
        with pytest.raises(error):
            db.put_item("n", {"k": bad})
    with pytest.raises(KeyTypeMismatch):
        db.put_item("b", {"k": [300]})
    for bad, error in (("a\0b", NullByteInKey), ("x" * 2049, KeyTooLarge), (7, KeyTypeMismatch)):
        with pytest.raises(error):
            db.put_item("s", {"k": bad})
    with pytest.raises(MissingKeyAttribute):
        db.put_item("s", {"v": 1})
    with pytest.raises(SortKeyNotSupported):
        db.table("s").get("a", "b")
    with pytest.raises(DocumentTooLarge):
        db.put_item("s", {"k": "a", "v": "x" * 420_000})


def test_batch_get(users):
    t = users.table("users")
    got = t.batch_get_items([("ORG#acme", "USER#0003"), ("x", "y"), ("ORG#acme", "USER#0003")], ["name"])
    assert got == [{"pk": "ORG#acme", "sk": "USER#0003", "name": "user3"}, None, {"pk": "ORG#acme", "sk": "USER#0003", "name": "user3"}]
    assert t.batch_get_items([]) == []
    with pytest.raises(SortKeyRequired):
        t.batch_get_items([("ORG#acme",)])


def test_conditions_and_returned_items(db):
    db.create_table(TableSchema("t", "k", S))
    assert db.put_item("t", {"k": "a", "v": 1}, E.AttributeNotExists("k"), return_old=True) is None
    with pytest.raises(ConditionCheckFailed):
        db.put_item("t", {"k": "a", "v": 2}, E.AttributeNotExists("k"))
    assert db.put_item("t", {"k": "a", "v": 3}, E.Eq(A("v"), 1), return_old=True) == {"k": "a", "v": 1}
    assert db.update_item("t", "a", actions=[U.Add("v", 2)], return_values="all_old") == {"k": "a", "v": 3}
    assert db.update_item("t", "new", actions=[U.Set("x.y", 1)], condition=E.AttributeNotExists("k"), return_values="all_new") == {"k": "new", "x": {"y": 1}}
    with pytest.raises(KeyAttributeUpdate):
        db.update_item("t", "a", actions=[U.Set("k", "z")])
    with pytest.raises(ConditionCheckFailed):
        db.delete_item("t", "a", condition=E.Eq(A("v"), 99))
    assert db.delete_item("t", "a", return_old=True) == {"k": "a", "v": 5.0} and db.delete_item("t", "a", return_old=True) is None
    assert db.table("t").get("a") is None


def test_versions_and_snapshots(db):
    db.create_table(TableSchema("t", "k", S))
    db.put_item_conditional("t", {"k": "a", "v": 1}, 0)
    first = db.table("t").get_versioned("a")
    with pytest.raises(VersionMismatch) as e:
        db.put_item_conditional("t", {"k": "a", "v": 2}, first["version"] + 7)
    assert e.value.actual == first["version"]
    db.put_item_conditional("t", {"k": "a", "v": 2}, first["version"])
    second = db.latest()
    db.delete_item("t", "a")
    db.delete_item("t", "a")
    with pytest.raises(VersionMismatch) as e:
        db.put_item_conditional("t", {"k": "a", "v": 3}, 0)
    assert e.value.actual == second
    db.put_item_conditional("t", {"k": "a", "v": 3}, second)  # a deleted item has its last version, however often it was deleted
    assert db.table("t", snapshot=second).get("a") == {"k": "a", "v": 2}
    assert db.table("t", snapshot=first["version"]).get("a") == {"k": "a", "v": 1}
    db.compact("t")
    assert db.table("t").get("a") == {"k": "a", "v": 3} and db.vacuum("t") == 5 and db.table("t").get("a") == {"k": "a", "v": 3}
    with pytest.raises(SnapshotUnavailable):
        db.table("t", snapshot=second)


def test_transactions(db):
    db.create_table(TableSchema("t", "k", S, ttl_attribute="ttl"))

    def body(t):
        t.put("t", {"k": "a", "v": 1})
        assert t.get("t", "a") == {"k": "a", "v": 1}
        t.update("t", "a", actions=[U.Add("v", 1)])
        t.delete("t", "b")
        return t.get_versioned("t", "a")["version"]

    assert db.transact(body) == db.latest()
    before = db.latest()
    with pytest.raises(ZeroDivisionError):
        db.transact(lambda t: (t.put("t", {"k": "c"}), 1 / 0))
    assert db.latest() == before and db.table("t").get("c") is None
    db.put_item("t", {"k": "old", "ttl": 1000})
    assert db.table("t").get("old") is None and db.transact(lambda t: t.get("t", "old")) == {"k": "old", "ttl": 1000}


def test_expiry_and_sweep(db):
    db.create_table(TableSchema("t", "k", S, ttl_attribute="ttl"))
    values = {"a": 1000, "b": 2000, "c": 9999999999, "d": 0, "e": "1000", "f": -5, "g": 1500}
    db.write_batch([("put", "t", {"k": k, "ttl": v}) for k, v in values.items()] + [("put", "t", {"k": "h"})])
    seen = lambda now: sorted(i["k"] for i in db.table("t", now=now).scan().execute().items)
    assert seen(1500) == ["b", "c", "d", "e", "h"] and seen(999) == ["a", "b", "c", "d", "e", "g", "h"]
    assert [r.k for r in db.table("t").list_partition_keys().collect()] == list("abcdefgh")
    assert db.sweep_expired("t", limit=2, now=1500) == 2 and db.sweep_expired("t", now=1500) == 1 and db.sweep_expired("t", now=1500) == 0
    assert [r.k for r in db.table("t").list_partition_keys().collect()] == list("bcdeh")


def test_prefixes(db):
    db.create_table(TableSchema("t", "p", S, "s", S))
    db.write_batch([("put", "t", {"p": "x", "s": s}) for s in ("A", "A!", "A#1", "A#2", "B#1", "C")])
    t = db.table("t")
    assert [r.prefix for r in t.list_sort_key_prefixes("x").collect()] == ["A", "A!", "A", "B", "C"]
    assert [r.prefix for r in t.list_sort_key_prefixes("x", limit=2, distinct=True).collect()] == ["A", "A!"]
    db.create_table(TableSchema("n", "p", S, "s", N))
    db.write_batch([("put", "n", {"p": "x", "s": s}) for s in (1, 2.5, 1e21)])
    assert [r.prefix for r in db.table("n").list_sort_key_prefixes("x").collect()] == ["1", "2.5", "1000000000000000000000"]
    db.create_table(TableSchema("m", "p", S))
    with pytest.raises(SortKeyNotSupported):
        db.table("m").list_sort_key_prefixes("x")


def test_definitions(db):
    db.create_table(TableSchema("t", "pk", S))
    for call, error in (
        (lambda: db.create_table(TableSchema("t", "pk", S)), TableAlreadyExists), (lambda: db.drop_table("u"), TableNotFound), (lambda: db.table("u"), TableNotFound),
        (lambda: db.create_index("t", IndexDefinition("i", "a", S, "NOPE")), PartitionSchemaNotFound), (lambda: db.drop_index("t", "i"), IndexNotFound), (lambda: db.describe_partition_schema("t", "X"), PartitionSchemaNotFound),
    ):
        with pytest.raises(error):
            call()
    contact = PartitionSchema("CONTACT", "people", (AttributeDef("email", AttrType.STRING, True), AttributeDef("age", AttrType.NUMBER)), True)
    db.put_item("t", {"pk": "CONTACT#old"})  # existing rows aren't checked
    db.create_partition_schema("t", contact)
    with pytest.raises(PartitionSchemaAlreadyExists):
        db.create_partition_schema("t", contact)
    with pytest.raises(ValidationFailed) as e:
        db.put_item("t", {"pk": "CONTACT#x", "age": None})
    assert len(e.value.errors) == 2
    db.put_item("t", {"pk": "CONTACT#alice", "email": "a@b.c"})
    with pytest.raises(ValidationFailed):
        db.update_item("t", "CONTACT#alice", actions=[U.Remove("email")])
    db.put_item("t", {"pk": "OTHER#x"})
    with pytest.raises(Exception, match="validation failed"):
        db.bulk_put("t", db.spark.createDataFrame([("CONTACT#z", 3)], "pk string, age long"))
    db.create_index("t", IndexDefinition("mail", "email", S, "CONTACT"))
    with pytest.raises(IndexAlreadyExists):
        db.create_index("t", IndexDefinition("mail", "email", S))
    with pytest.raises(PartitionSchemaHasIndexes):
        db.drop_partition_schema("t", "CONTACT")
    assert [i["pk"] for i in db.table("t").query_index("mail").key_value("a@b.c").execute().items] == ["CONTACT#alice"]
    assert Database.open(db.spark, db.files.root).describe_partition_schema("t", "CONTACT") == contact
    db.drop_index("t", "mail")
    db.drop_partition_schema("t", "CONTACT")
    db.drop_table("t")
    db.create_table(TableSchema("t", "pk", S))
    assert db.table("t").df.count() == 0  # a new table of an old name is empty


def test_index_pages(db):
    db.create_table(TableSchema("d", "pk", S, "sk", S))
    db.create_index("d", IndexDefinition("status", "status", S))
    db.create_index("d", IndexDefinition("score", "score", N))
    rows = [{"pk": f"ITEM#{i:03d}", "sk": "info", "status": "active", "seq": i, "score": i if i % 2 else "not-a-number"} for i in range(25)]
    db.write_batch([("put", "d", r) for r in rows])
    q = db.table("d").query_index("status").key_value("active").limit(10)
    assert [len(p.items) for p in q.pages()] == [10, 10, 5]
    back = q.scan_forward(False)
    assert [i["seq"] for p in back.pages() for i in p.items] == list(range(24, -1, -1))
    assert back.execute().last_evaluated_key == {"status": "active", "pk": "ITEM#015", "sk": "info"}
    for bad in ({}, {"status": "active", "pk": "ITEM#015"}, {"status": 3, "pk": "ITEM#015", "sk": "info"}, {"status": "active", "pk": 4, "sk": "info"}):
        with pytest.raises(InvalidIndexCursor):
            q.exclusive_start_key(bad).execute()
    assert [i["seq"] for i in db.table("d").query_index("score").key_value(3).execute().items] == [3]
    with pytest.raises(IndexNotFound):
        db.table("d").query_index("none")


@pytest.mark.parametrize(("doc", "action", "after"), [
    ({"a": 1}, U.Set("b.c", 2), {"a": 1, "b": {"c": 2}}), ({"a": 1}, U.Set("a.b", 2), {"a": 1}), ({"a": 1}, U.Remove("b"), {"a": 1}),
    ({"a": {"b": 1}}, U.Remove("a.b"), {"a": {}}), ({}, U.Add("n", 5), {"n": 5}), ({"n": 1}, U.Add("n", 2), {"n": 3.0}),
    ({"d": [1, 1, 2]}, U.Add("d", [2, 3, 3]), {"d": [1, 1, 2, 3]}), ({"d": [1]}, U.Add("d", [1.0]), {"d": [1, 1.0]}),
    ({"d": [1, 1, 2]}, U.Delete("d", [2]), {"d": [1, 1]}), ({"d": [1, 1, 2]}, U.Delete("d", [1, 2]), {}), ({}, U.Delete("d", [1]), {}),
])
def test_update_actions(doc, action, after):
    got = U.apply(doc, [action])
    assert got == after and json.dumps(got) == json.dumps(after)


@pytest.mark.parametrize(("doc", "action"), [({"n": None}, U.Add("n", 1)), ({"n": "x"}, U.Add("n", 1)), ({"n": 1}, U.Add("n", "x")), ({"n": 1}, U.Add("n", [1])), ({"n": 1}, U.Delete("n", [1])), ({"n": [1]}, U.Delete("n", 1))])
def test_update_type_errors(doc, action):
    with pytest.raises(UpdateTypeMismatch):
        U.apply(doc, [action])


def test_nulls_in_arrays_of_columns(spark):
    rows = [["a", None], [], None, [None], ["z"], [None, "a", None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, d array<string>")
    for action in (U.Add("d", ["z"]), U.Add("d", [None, "z", None]), U.Delete("d", [None]), U.Delete("d", ["a"]), U.Delete("d", [None, "a"]), U.Delete("d", [])):
        got = {r.i: r.d for r in U.apply_columns(df, [action]).collect()}
        want = {i: U.apply({} if x is None else {"d": x}, [action]).get("d") for i, x in enumerate(rows)}
        assert [got[i] for i in range(6)] == [want[i] for i in range(6)], action


def test_writes_match_a_dictionary(db):
    db.create_table(TableSchema("t", "k", N))
    r, model = random.Random(1), {}
    for _ in range(12):
        batch = []
        for _ in range(r.randint(1, 6)):
            k = float(r.randint(0, 8))
            if r.random() < 0.7:
                doc = {"k": k, "v": r.randint(0, 99)}
                batch.append(("put", "t", doc))
                model[k] = doc
            else:
                batch.append(("delete", "t", k))
                model.pop(k, None)
        db.write_batch(batch)
        if r.random() < 0.2:
            db.compact("t")
    assert {i["k"]: i for i in db.table("t").scan().execute().items} == model


def test_two_writers(db):
    db.create_table(TableSchema("t", "k", N))
    other = Database.open(db.spark, db.files.root)
    from tidemark.sources.store import Transaction

    one, two = Transaction(db), Transaction(other)
    one.put("t", {"k": 1, "by": "one"})
    two.put("t", {"k": 1, "by": "two"})
    one.commit()
    with pytest.raises(DatabaseLocked):
        two.commit()
    assert db.table("t").scan().execute().items == [{"k": 1, "by": "one"}] or db.table("t").get(1)["by"] == "two"


def test_change_feed(db, tmp_path):
    db.create_table(TableSchema("t", "k", S))
    db.put_item("t", {"k": "a", "v": 1})
    db.put_item("t", {"k": "a", "v": 2})
    db.delete_item("t", "a")
    db.delete_item("t", "never")
    rows = feeds.feed(db, "t").orderBy("_txn").collect()
    assert [r.event for r in rows] == ["INSERT", "MODIFY", "REMOVE"]
    assert [json.loads(r.old_image)["v"] if r.old_image else None for r in rows] == [None, 1, 2]
    assert "new_image" not in feeds.feed(db, "t", "keys_only").columns and feeds.feed(db, "t", after=2).count() == 2
    got = []
    q = feeds.follow(db, "t", lambda batch, i: got.extend(batch.select("k", "_txn", "_op").collect()), str(tmp_path / "c1"), once=True)
    q.awaitTermination(60)
    assert sorted((r.k, r._op) for r in got) == [("a", "delete"), ("a", "put"), ("a", "put"), ("never", "delete")]
    images = feeds.with_images(feeds.stream(db, "t"), ["k"])
    q = images.writeStream.format("memory").queryName("images").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.event for r in db.spark.table("images").collect()) == ["INSERT", "MODIFY", "REMOVE"]


def test_windowed_counts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = feeds.windowed_counts(events, "ts", "1 day", "1 hour", "event_type")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_protocol(db, tmp_path):
    path = str(tmp_path / "s")
    listener = server(db, path)
    threading.Thread(target=listener.serve_forever, daemon=True).start()
    c = Client(path)
    c.create_table(table="u", partition_key={"name": "id", "type": "s"}, sort_key={"name": "n", "type": "Number"}, ttl_attribute="ttl")
    assert c.list_tables()["tables"] == ["u"] and c.describe_table(table="u")["schema"]["sort_key"] == {"name": "n", "type": "Number"}
    for n in range(4):
        c.put_item(table="u", item={"id": "a", "n": n, "v": n * n})
    assert c.get_item(table="u", partition_key="a", sort_key=2)["item"]["v"] == 4
    assert "item" not in c.get_item(table="u", partition_key="zz", sort_key=2)
    assert c.query(table="u", partition_key="a", sort_key_condition={"op": "between", "low": 1, "high": 2}, projection=["v"])["items"] == [{"id": "a", "n": 1, "v": 1}, {"id": "a", "n": 2, "v": 4}]
    page = c.scan(table="u", limit=3, filter={"Gt": [{"Attr": "v"}, {"Literal": 0}]})
    assert len(page["items"]) == 2 and page["last_evaluated_key"] == {"id": "a", "n": 2.0}
    assert c.update_item(table="u", partition_key="a", sort_key=3, updates=[{"action": "add", "path": "v", "value": 1}], return_values="ALL_NEW")["item"]["v"] == 10.0
    version = c.get_item_versioned(table="u", partition_key="a", sort_key=3)["version"]
    with pytest.raises(ServerError) as e:
        c.put_item(table="u", item={"id": "a", "n": 3}, expected_version=version + 1)
    assert e.value.response["error"] == "VersionMismatch" and e.value.response["actual"] == version
    with pytest.raises(ServerError, match="ConditionCheckFailed"):
        c.put_item(table="u", item={"id": "a", "n": 3}, condition={"AttributeNotExists": "id"})
    assert c.delete_item(table="u", partition_key="a", sort_key=3, return_values="ALL_OLD")["item"]["v"] == 10.0
    assert c.batch_get_item(table="u", keys=[{"partition_key": "a", "sort_key": 0}, {"partition_key": "q", "sort_key": 0}])["items"] == [{"id": "a", "n": 0, "v": 0}, None]
    c.batch_write_item(table="u", operations=[{"put": {"id": "b", "n": 1}}, {"delete": {"partition_key": "a", "sort_key": 0}}])
    assert c.list_partition_keys(table="u")["keys"] == ["a", "b"] and c.count(table="u")["count"] == 3
    assert c.list_sort_key_prefixes(table="u", partition_key="a")["keys"] == ["1", "2"]
    c.create_schema(table="u", prefix="a", attributes=[{"name": "v", "type": "n", "required": True}], validate=True)
    c.create_index(table="u", name="v", index_key={"name": "v", "type": "n"}, partition_schema="a")
    assert c.list_schemas(table="u")["schemas"][0]["attributes"] == [{"name": "v", "type": "Number", "required": True}]
    assert c.query_index(table="u", index_name="v", key_value=4)["items"][0]["n"] == 2
    assert c.describe_index(table="u", name="v")["index"]["index_key"] == {"name": "v", "type": "Number"} and c.list_indexes(table="u")["indexes"]
    assert c.describe_schema(table="u", prefix="a")["schema"]["validate"] is True
    c.drop_index(table="u", name="v")
    c.drop_schema(table="u", prefix="a")
    c.drop_table(table="u")
    d = Dispatcher(db)
    for request, name in (("{", "ParseError"), ({"op": "nope"}, "ParseError"), ({"op": "get_item", "table": "u"}, "TableNotFound"), ({"op": "create_table", "table": "x", "partition_key": {"name": "a", "type": "q"}}, "InvalidKeyType")):
        assert d(request)["error"] == name
    db.create_table(TableSchema("v", "k", S))
    assert d({"op": "update_item", "table": "v", "partition_key": "a", "updates": [{"action": "SET", "path": "x", "value": 1}]})["error"] == "InvalidUpdateAction"
    assert d({"op": "batch_get_item", "table": "v", "keys": [{"partition_key": "a"}] * 1001})["error"] == "BatchSizeLimitExceeded"
    assert d({"op": "get_item", "table": "v"})["error"] == "ParseError" and d({"op": "get_item", "table": "v", "partition_key": 3})["error"] == "InternalError"
    asyncio.run(_by_async_client(path))
    c.close()
    listener.shutdown()
    listener.server_close()


async def _by_async_client(path):
    client = await AsyncClient.connect(path)
    await client.put_item(table="v", item={"k": "z", "n": 1})
    answers = await asyncio.gather(*[client.get_item(table="v", partition_key=k) for k in ("z", "none")])
    assert answers == [{"ok": True, "item": {"k": "z", "n": 1}}, {"ok": True}]
    with pytest.raises(ServerError, match="TableNotFound"):
        await client.scan(table="nope")
    await client.close()


def test_console(db):
    console = Console(db)
    run = console.run
    assert run("create table boats pk harbour string sk berth STRING") == {"ok": True, "message": "OK"}
    assert run("USE boats") == {"ok": True, "active_table": "boats"}
    for line in ('PUT {"harbour": "oslo", "berth": "west#12", "n": 1}', 'PUT boats {"harbour": "oslo", "berth": "east#3", "tags": ["a"]}', 'PUT {"harbour": "oslo", "berth": "west#04"}'):
        assert run(line)["ok"]
    assert run("GET pk=oslo sk=west#12") == {"found": True, "item": {"harbour": "oslo", "berth": "west#12", "n": 1}}
    assert run("GET boats pk=oslo sk=none") == {"found": False}
    assert run("LIST PREFIXES pk=oslo") == {"sort_key_prefixes": ["east", "west"]} and run("LIST KEYS LIMIT 3") == {"partition_keys": ["oslo"]}
    assert run("UPDATE pk=oslo sk=west#12 SET title=\"Two words\" ADD n=2 REMOVE none SET deep.x={\"y\": 1}")["ok"]
    assert run("GET pk=oslo sk=west#12")["item"] == {"harbour": "oslo", "berth": "west#12", "n": 3.0, "title": "Two words", "deep": {"x": {"y": 1}}}
    assert run("UPDATE pk=oslo sk=east#3 DELETE tags=[\"a\"]")["ok"]
    answer = run("QUERY pk=oslo BEGINS_WITH west LIMIT 1 DESC")
    assert answer["count"] == 1 and answer["has_more"] and answer["items"][0]["berth"] == "west#12"
    assert run("QUERY boats pk=oslo SK >= m")["count"] == 2 and run("QUERY pk=oslo BETWEEN a AND m")["count"] == 1 and run("SCAN LIMIT 2")["has_more"]
    assert run("CREATE SCHEMA PREFIX oslo DESCRIPTION \"a b\" ATTR n NUMBER REQUIRED ATTR t STRING VALIDATE")["ok"]
    assert run("CREATE INDEX byn SCHEMA oslo KEY n NUMBER")["ok"] and run("QUERY INDEX byn n=3")["count"] == 1
    assert run("DESCRIBE INDEX byn")["name"] == "byn" and run("LIST INDEXES")["indexes"] and run("LIST SCHEMAS boats")["partition_schemas"][0]["description"] == "a b"
    assert run("DESCRIBE TABLE")["partition_key"]["name"] == "harbour" and run("DESCRIBE SCHEMA oslo")["validate"] is True
    assert run("DROP INDEX byn")["ok"] and run("DROP SCHEMA boats oslo")["ok"] and run("LIST TABLES") == {"tables": ["boats"]}
    assert run("DELETE pk=oslo sk=east#3")["ok"] and run("DROP TABLE boats")["ok"] and "error" in run("SCAN boats") and "help" in run("HELP QUERY") and run("exit") is None


@pytest.mark.parametrize("line", ["", "FLY", "CREATE", "CREATE TABLE t", "CREATE TABLE t PX a S", "GET t", "GET t pk", "GET t pk=", "PUT t {", "QUERY t pk=1 SK ! 3", "QUERY t pk=1 LIMIT x", "QUERY t pk=1 BETWEEN 1 OR 2", "SCAN t 5", "UPDATE t pk=1", "UPDATE t pk=1 JUMP x", 'GET t pk="x', "LIST", "LIST THINGS", "DROP THING x", "SCAN"])
def test_console_errors(line):
    with pytest.raises((ParseError, ValueError)):
        parse(line)


def test_console_tokens():
    assert tokenize('PUT t {"a": [1, {"b": "}"}]}') == ["PUT", "t", '{"a": [1, {"b": "}"}]}']
    assert tokenize('GET t pk="hello world" sk=3') == ["GET", "t", 'pk="hello world"', "sk=3"] and tokenize("SK<=5") == ["SK", "<=", "5"]
    assert [value(x) for x in ('"a b"', "4", "-2.5e3", "nan", "true", "x")] == ["a b", 4.0, -2500.0, "nan", "true", "x"]
    assert parse("QUERY t pk=1 SK > 2 SK < 9").request["sort_key_condition"] == {"op": "lt", "value": 9.0}
