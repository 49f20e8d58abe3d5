"""The document-table queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import update as U
from ..operators import extras
from ..operators import write as W
from ..operators.read import DocTable
from ..sources.store import validation_errors
from ..types import AttributeDef, AttrType, IndexDefinition, KeyType, PartitionSchema, TableSchema

S, N, B = KeyType.STRING, KeyType.NUMBER, KeyType.BINARY
A = E.Attr
NOW = 1705276800.0

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- tables: how the test tables are bound ---


def events(spark: SparkSession, sf: str, ttl: bool = False) -> DocTable:
    df = _read(spark, sf, "events")
    if ttl:
        seconds = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
        df = df.withColumn("ttl", seconds / 1e6)
    return DocTable(df, TableSchema("events", "user_id", N, "event_id", N, "ttl" if ttl else None), json_columns={"props": "k BIGINT"}, now=NOW if ttl else None)


def orders(spark: SparkSession, sf: str) -> DocTable:
    return DocTable(_read(spark, sf, "orders"), TableSchema("orders", "o_custkey", N, "o_orderkey", N))


def parties(spark: SparkSession, sf: str) -> DocTable:
    """Customers, suppliers and nations in one table; the key's prefix says which."""
    none = lambda kind: F.lit(None).cast(kind)
    c = _read(spark, sf, "customer").select(F.concat(F.lit("CUSTOMER#"), "c_custkey").alias("pk"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("mktsegment"))
    s = _read(spark, sf, "supplier").select(F.concat(F.lit("SUPPLIER#"), "s_suppkey").alias("pk"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"), none("string").alias("mktsegment"))
    n = _read(spark, sf, "nation").select(F.concat(F.lit("NATION#"), "n_nationkey").alias("pk"), F.col("n_name").alias("name"), none("double").alias("acctbal"), F.col("n_nationkey").alias("nationkey"), none("string").alias("mktsegment"))
    indexes = {
        "nation": IndexDefinition("nation", "nationkey", N),
        "segment": IndexDefinition("segment", "mktsegment", S),
        "supplier-nation": IndexDefinition("supplier-nation", "nationkey", N, "SUPPLIER"),
    }
    return DocTable(c.unionByName(s).unionByName(n), TableSchema("parties", "pk", S), indexes=indexes)


_PARTIES = """(SELECT 'CUSTOMER#' || c_custkey AS pk, c_name AS name, c_acctbal AS acctbal, c_nationkey AS nationkey, c_mktsegment AS mktsegment FROM customer
 UNION ALL SELECT 'SUPPLIER#' || s_suppkey, s_name, s_acctbal, s_nationkey, NULL FROM supplier
 UNION ALL SELECT 'NATION#' || n_nationkey, n_name, NULL, n_nationkey, NULL FROM nation)"""


def texts(spark: SparkSession, sf: str) -> DocTable:
    df = _read(spark, sf, "documents").select("lang", F.concat("source", F.lit("#"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("sk"), "n_chars")
    return DocTable(df, TableSchema("texts", "lang", S, "sk", S))


_TEXTS = "(SELECT lang, source || '#' || lpad(doc_id::VARCHAR, 8, '0') AS sk, n_chars FROM documents)"


def turns(spark: SparkSession, sf: str) -> DocTable:
    return DocTable(_read(spark, sf, "conversations"), TableSchema("turns", "conv_id", N, "turn", N))


def judged(spark: SparkSession, sf: str) -> DocTable:
    """Documents with their labels where they have any: sparse attributes."""
    docs = _read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return DocTable(docs.join(_read(spark, sf, "labels"), "doc_id", "left"), TableSchema("judged", "doc_id", N))


_JUDGED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def vectors(spark: SparkSession, sf: str) -> DocTable:
    return DocTable(_read(spark, sf, "embeddings"), TableSchema("vectors", "vec_id", N))


def tagged(spark: SparkSession, sf: str) -> DocTable:
    df = _read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("level")).alias("rank")).alias("info"))
    return DocTable(df, TableSchema("tagged", "o_custkey", N, "o_orderkey", N))


def _ranked(df: DataFrame, *order) -> DataFrame:
    """An ordered, limited result with its places, so that order is compared too. Pages are small by their limit."""
    from pyspark.sql.window import Window

    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The first query of the build plan."""
    q = events(spark, sf).query().partition_key(8).sort_key_between(100, 5000)
    return q.filter(E.Eq(A("event_type"), "click")).projection(["value"]).to_df(ordered=False)


# --- lookups ---


@query("SELECT * FROM orders WHERE o_custkey = 7 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def get_item(spark, sf):
    table = orders(spark, sf)
    first = table.df.where("o_custkey = 7").agg(F.min("o_orderkey")).first()[0]
    return table.get_item(7, -1 if first is None else first)


@query("SELECT * FROM orders WHERE false")
def get_item_missing(spark, sf):
    return orders(spark, sf).get_item(-5, 1)


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 10 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 10)")
def get_item_projection(spark, sf):
    table = orders(spark, sf)
    first = table.df.where("o_custkey = 10").agg(F.min("o_orderkey")).first()[0]
    return table.get_item(10, -1 if first is None else first, ["o_orderstatus", "o_totalprice", "absent"])


@query("""WITH k AS (SELECT (row_number() OVER (ORDER BY o_orderkey))::BIGINT - 1 AS p, o_custkey, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)),
w AS (SELECT p AS _pos, o_custkey AS a, o_orderkey AS b FROM k UNION ALL SELECT p + 5, o_custkey, -o_orderkey FROM k UNION ALL SELECT p + 10, o_custkey, o_orderkey FROM k)
SELECT _pos, o.o_orderstatus, o.o_totalprice, o.o_orderkey IS NOT NULL AS found FROM w LEFT JOIN orders o ON o.o_custkey = a AND o.o_orderkey = b""")
def batch_get_positional(spark, sf):
    table = orders(spark, sf)
    some = [tuple(r) for r in table.df.orderBy("o_orderkey").limit(5).select("o_custkey", "o_orderkey").collect()]
    keys = some + [(a, -b) for a, b in some] + some
    got = table.batch_get(keys, ["o_orderstatus", "o_totalprice"])
    return got.select("_pos", "o_orderstatus", "o_totalprice", F.col("_found").isNotNull().alias("found"))


@query("""SELECT e.event_id AS _pos, o.o_totalprice, o.o_orderkey IS NOT NULL AS found FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderkey = e.event_id""")
def batch_get_joined(spark, sf):
    table = orders(spark, sf)
    keys = _read(spark, sf, "events").select(F.col("event_id").alias("_pos"), F.col("user_id").alias("o_custkey"), F.col("event_id").alias("o_orderkey"))
    return table.batch_get(keys, ["o_totalprice"]).select("_pos", "o_totalprice", F.col("_found").isNotNull().alias("found"))


# --- sort-key conditions ---


@query("SELECT user_id, event_id, value FROM events WHERE user_id = 8 AND event_id BETWEEN 100 AND 5000 AND event_type = 'click'")
def query_between_filter_project(spark, sf):
    return flagship(spark, sf)


def _sort_key(name: str, sql: str, build: Callable) -> None:
    def run(spark, sf):
        return build(events(spark, sf).query().partition_key(8)).to_df(ordered=False).select("user_id", "event_id", "event_type", "value")

    run.__name__ = f"query_sk_{name}"
    query(f"SELECT user_id, event_id, event_type, value FROM events WHERE user_id = 8 AND {sql}")(run)


_sort_key("none", "true", lambda q: q)
_sort_key("eq", "event_id = 103", lambda q: q.sort_key_eq(103))
_sort_key("eq_fraction", "event_id = 103.5", lambda q: q.sort_key_eq(103.5))
_sort_key("lt", "event_id < 900", lambda q: q.sort_key_lt(900))
_sort_key("le", "event_id <= 900.5", lambda q: q.sort_key_le(900.5))
_sort_key("gt", "event_id > 900", lambda q: q.sort_key_gt(900))
_sort_key("ge", "event_id >= 900.5", lambda q: q.sort_key_ge(900.5))
_sort_key("between", "event_id BETWEEN 200 AND 800", lambda q: q.sort_key_between(200, 800))
_sort_key("between_empty", "event_id BETWEEN 800 AND 200", lambda q: q.sort_key_between(800, 200))
_sort_key("last_condition_counts", "event_id > 500", lambda q: q.sort_key_eq(1).sort_key_gt(500))
_sort_key("begins_with_number", "false", lambda q: q.sort_key_begins_with("1"))


@query(f"SELECT lang, sk, n_chars FROM {_TEXTS} WHERE lang = 'en' AND starts_with(sk, 'src1')")
def query_sk_begins_with(spark, sf):
    return texts(spark, sf).query().partition_key("en").sort_key_begins_with("src1").to_df(ordered=False)


# --- order, limits and cursors ---


@query("SELECT event_id, value, row_number() OVER (ORDER BY event_id DESC)::INT AS place FROM (SELECT * FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 7)")
def query_reverse_limit(spark, sf):
    rows = events(spark, sf).query().partition_key(8).scan_forward(False).limit(7).to_df()
    return _ranked(rows.select("event_id", "value"), F.desc("event_id"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events WHERE user_id = 8 ORDER BY event_id LIMIT 50) WHERE event_type = 'click'")
def query_limit_then_filter(spark, sf):
    return events(spark, sf).query().partition_key(8).limit(50).filter(E.Eq(A("event_type"), "click")).to_df().select("event_id", "event_type")


@query("SELECT * FROM events WHERE false")
def query_limit_zero(spark, sf):
    return events(spark, sf).query().partition_key(8).limit(0).to_df()


@query("""WITH c AS (SELECT o_custkey p, o_orderkey s FROM orders ORDER BY 1, 2 LIMIT 1 OFFSET 19)
SELECT o_custkey, o_orderkey, o_totalprice FROM orders, c WHERE o_custkey > p OR (o_custkey = p AND o_orderkey > s) ORDER BY o_custkey, o_orderkey LIMIT 25""")
def scan_page2_cursor(spark, sf):
    table = orders(spark, sf)
    first = table.scan().limit(20).execute()
    return table.scan().exclusive_start_key(first.last_evaluated_key).limit(25).projection(["o_totalprice"]).to_df()


@query("""WITH c AS (SELECT event_id s FROM events WHERE user_id = 8 ORDER BY 1 DESC LIMIT 1 OFFSET 9)
SELECT event_id, value FROM events, c WHERE user_id = 8 AND event_id < s ORDER BY event_id DESC LIMIT 10""")
def query_reverse_page2(spark, sf):
    q = events(spark, sf).query().partition_key(8).scan_forward(False).limit(10)
    return q.exclusive_start_key(q.execute().last_evaluated_key).to_df().select("event_id", "value")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")
def page_walk_union(spark, sf):
    table = turns(spark, sf)
    items = [i for page in table.query().partition_key(3).limit(2).pages() for i in page.items]
    return spark.createDataFrame([(i["conv_id"], i["turn"], i["role"]) for i in items], "conv_id long, turn long, role string")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def scan_filter_project(spark, sf):
    return orders(spark, sf).scan().filter(E.Gt(A("o_totalprice"), 300000)).projection(["o_totalprice"]).to_df(ordered=False)


# --- filters ---


def _filter(name: str, table: Callable, source: str, e: E.Expr, sql: str, columns: str) -> None:
    def run(spark, sf):
        return table(spark, sf).scan().filter(e).to_df(ordered=False).select(*columns.split(", "))

    run.__name__ = f"filter_{name}"
    query(f"SELECT {columns} FROM {source} AS t WHERE {sql}")(run)


_Q, _J = "doc_id, quality", _JUDGED
_filter("eq", judged, _J, E.Eq(A("quality"), 1), "quality = 1", _Q)
_filter("eq_null", judged, _J, E.Eq(A("quality"), None), "quality IS NULL", _Q)
_filter("ne", judged, _J, E.Ne(A("lang"), "en"), "lang <> 'en'", "doc_id, lang")
_filter("ne_missing", judged, _J, E.Ne(A("quality"), 1), "quality IS DISTINCT FROM 1", _Q)
_filter("lt", judged, _J, E.Lt(A("n_chars"), 500), "n_chars < 500", "doc_id, n_chars")
_filter("le", judged, _J, E.Le(A("n_chars"), 500.5), "n_chars <= 500", "doc_id, n_chars")
_filter("gt", judged, _J, E.Gt(A("n_chars"), 5000), "n_chars > 5000", "doc_id, n_chars")
_filter("ge", judged, _J, E.Ge(A("n_chars"), 5000.5), "n_chars > 5000", "doc_id, n_chars")
_filter("le_nulls", judged, _J, E.Le(A("quality"), A("toxic")), "quality <= toxic OR (quality IS NULL AND toxic IS NULL)", "doc_id, quality, toxic")
_filter("between", judged, _J, E.Between(A("n_chars"), 500, 900), "n_chars BETWEEN 500 AND 900", "doc_id, n_chars")
_filter("not_lt_missing", judged, _J, E.Not(E.Lt(A("quality"), 1)), "NOT coalesce(quality < 1, false)", _Q)
_filter("exists", judged, _J, E.AttributeExists("quality"), "quality IS NOT NULL", _Q)
_filter("not_exists", judged, _J, E.AttributeNotExists("quality"), "quality IS NULL", _Q)
_filter("begins_with", texts, _TEXTS, E.BeginsWith(A("sk"), "src1"), "starts_with(sk, 'src1')", "lang, sk")
_filter("contains_string", texts, _TEXTS, E.Contains(A("sk"), "c1#"), "contains(sk, 'c1#')", "lang, sk")
_filter("and_or_not_nested", judged, _J, E.Or(E.And(E.Eq(A("lang"), "fr"), E.Not(E.Eq(A("quality"), 1))), E.And(E.Gt(A("n_chars"), 4000), E.Not(E.Or(E.Eq(A("toxic"), 1), E.AttributeNotExists("toxic"))))),
        "(lang = 'fr' AND quality IS DISTINCT FROM 1) OR (n_chars > 4000 AND NOT (toxic IS NOT DISTINCT FROM 1 OR toxic IS NULL))", "doc_id, lang, quality, toxic")
_filter("empty_and", judged, _J, E.And(), "true", "doc_id")
_filter("empty_or", judged, _J, E.Or(), "false", "doc_id")
_filter("type_mismatch", judged, _J, E.Eq(A("lang"), 42), "false", "doc_id")
_filter("type_mismatch_ne", judged, _J, E.Ne(A("lang"), 42), "true", "doc_id")
_filter("invalid_reached", judged, _J, E.Not(E.And(E.Eq(A("lang"), "en"), A("lang"))), "lang IS DISTINCT FROM 'en'", "doc_id, lang")
_filter("nested_path", events, "events", E.Ge(A("props.k"), 50), "CAST(json_extract(props, '$.k') AS BIGINT) >= 50", "user_id, event_id")
_filter("attr_vs_attr", lambda s, d: DocTable(_read(s, d, "lineitem"), TableSchema("lineitem", "l_orderkey", N, "l_linenumber", N)), "lineitem", E.Gt(A("l_discount"), A("l_tax")), "l_discount > l_tax", "l_orderkey, l_linenumber, l_discount, l_tax")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = 'O'")
def filter_contains_array(spark, sf):
    return tagged(spark, sf).scan().filter(E.Contains(A("tags"), "O")).to_df(ordered=False).select("o_custkey", "o_orderkey")


# --- projections and lists ---


@query("SELECT o_custkey, o_orderkey, o_orderstatus AS status, o_orderpriority AS level FROM orders")
def project_nested(spark, sf):
    rows = tagged(spark, sf).scan().projection(["info.status", "info.rank.level", "info.none"]).to_df(ordered=False)
    return rows.select("o_custkey", "o_orderkey", F.col("info.status").alias("status"), F.col("info.rank.level").alias("level"))


@query("SELECT DISTINCT user_id FROM events")
def list_partition_keys(spark, sf):
    return events(spark, sf).list_partition_keys()


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 9")
def list_partition_keys_limit(spark, sf):
    return events(spark, sf).list_partition_keys(9)


@query(f"""SELECT prefix FROM (SELECT sk, split_part(sk, '#', 1) AS prefix, lag(split_part(sk, '#', 1)) OVER (ORDER BY sk) AS before FROM {_TEXTS} WHERE lang = 'en')
WHERE before IS DISTINCT FROM prefix""")
def list_sort_key_prefixes(spark, sf):
    return texts(spark, sf).list_sort_key_prefixes("en")


# --- indexes ---


@query(f"SELECT pk, name, nationkey FROM {_PARTIES} WHERE nationkey = 3")
def index_query_global(spark, sf):
    return parties(spark, sf).query_index("nation").key_value(3).to_df(ordered=False).select("pk", "name", "nationkey")


@query(f"SELECT pk, name FROM {_PARTIES} WHERE mktsegment = 'BUILDING'")
def index_query_sparse(spark, sf):
    return parties(spark, sf).query_index("segment").key_value("BUILDING").to_df(ordered=False).select("pk", "name")


@query(f"SELECT pk, name FROM {_PARTIES} WHERE nationkey = 3 AND split_part(pk, '#', 1) = 'SUPPLIER'")
def index_query_scoped(spark, sf):
    return parties(spark, sf).query_index("supplier-nation").key_value(3).to_df(ordered=False).select("pk", "name")


@query(f"""WITH m AS (SELECT pk, name FROM {_PARTIES} WHERE nationkey = 3), c AS (SELECT pk AS p FROM m ORDER BY pk DESC LIMIT 1 OFFSET 3)
SELECT pk, name FROM m, c WHERE pk < p ORDER BY pk DESC LIMIT 6""")
def index_reverse_page(spark, sf):
    q = parties(spark, sf).query_index("nation").key_value(3).scan_forward(False)
    start = q.limit(4).execute().last_evaluated_key
    return q.exclusive_start_key(start).limit(6).to_df().select("pk", "name")


# --- time to live ---

_ALIVE = f"NOT (epoch_us(ts) / 1e6 <> 0 AND epoch_us(ts) / 1e6 <= {NOW})"


@query(f"SELECT user_id, event_id FROM events WHERE {_ALIVE}")
def ttl_scan(spark, sf):
    return events(spark, sf, ttl=True).scan().to_df(ordered=False).select("user_id", "event_id")


@query(f"SELECT event_id, event_type FROM (SELECT * FROM events WHERE user_id = 8 AND {_ALIVE} ORDER BY event_id LIMIT 12) WHERE event_type <> 'view'")
def ttl_query_limit(spark, sf):
    q = events(spark, sf, ttl=True).query().partition_key(8).limit(12)
    return q.filter(E.Ne(A("event_type"), "view")).to_df().select("event_id", "event_type")


# --- writes ---

_KEYS = ["o_custkey", "o_orderkey"]


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1 - o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderkey % 7 = 0")
def put_upsert_state(spark, sf):
    base = _read(spark, sf, "orders").select(*_KEYS, "o_orderstatus")
    puts = base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")).union(base.where("o_orderkey % 7 = 0").select(-1 - F.col("o_custkey"), "o_orderkey", F.lit("new")))
    return W.put(base, puts, _KEYS)


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'second' WHEN o_orderkey % 2 = 0 THEN 'first' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def batch_last_wins(spark, sf):
    base = _read(spark, sf, "orders").select(*_KEYS, "o_orderstatus")
    part = lambda where, seq, op, value: base.where(where).select(*_KEYS, F.lit(value).alias("o_orderstatus"), F.lit(seq).alias("_seq"), F.lit(op).alias("_op"))
    batch = part("o_orderkey % 2 = 0", 1, "put", "first").union(part("o_orderkey % 3 = 0", 2, "put", "second")).union(part("o_orderkey % 5 = 0", 3, "delete", None))
    return W.apply_batch(base, batch, _KEYS)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_state(spark, sf):
    base = _read(spark, sf, "orders").select(*_KEYS, "o_orderstatus")
    return W.delete(base, base.where("o_orderstatus = 'F'"), _KEYS).select(*_KEYS)


@query("""SELECT o_custkey, o_orderkey, o_totalprice < 100000 AS ok FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT -1 - o_custkey, o_orderkey, false FROM orders WHERE o_orderkey % 9 = 0""")
def put_condition_state(spark, sf):
    base = _read(spark, sf, "orders").select(*_KEYS, "o_totalprice")
    puts = base.where("o_orderkey % 4 = 0").select(*_KEYS).union(base.where("o_orderkey % 9 = 0").select(-1 - F.col("o_custkey"), "o_orderkey"))
    return W.conditional(base, puts, _KEYS, E.Lt(A("o_totalprice"), 100000)).select(*_KEYS, F.col("_ok").alias("ok"))


@query("SELECT o_custkey, o_orderkey, o_totalprice AS old FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT -1 - o_custkey, o_orderkey, NULL FROM orders WHERE o_orderkey % 9 = 0")
def put_return_old(spark, sf):
    base = _read(spark, sf, "orders").select(*_KEYS, "o_totalprice")
    puts = base.where("o_orderkey % 4 = 0").select(*_KEYS).union(base.where("o_orderkey % 9 = 0").select(-1 - F.col("o_custkey"), "o_orderkey"))
    return W.conditional(base, puts, _KEYS, E.And()).select(*_KEYS, F.col("_old.o_totalprice").alias("old"))


def _log(spark, sf) -> DataFrame:
    """Three transactions: all orders, a change of every second, a deletion of every fifth."""
    base = _read(spark, sf, "orders").select(*_KEYS, "o_orderstatus")
    first = W.as_log(base, 1)
    second = W.as_log(base.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("U")), 2)
    third = W.as_log(base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit(None).cast("string")), 3, op="delete")
    return first.union(second).union(third)


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS version FROM orders WHERE o_orderkey % 5 <> 0")
def occ_version_state(spark, sf):
    return W.state(_log(spark, sf), _KEYS).withColumnRenamed("_txn", "version")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def snapshot_as_of(spark, sf):
    return W.state(_log(spark, sf), _KEYS, snapshot=2).drop("_txn")


@query("""SELECT o_custkey, o_orderkey, 1::BIGINT AS _txn FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0
UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 = 0
UNION ALL SELECT o_custkey, o_orderkey, 3 FROM orders WHERE o_orderkey % 5 = 0""")
def version_gc_garbage(spark, sf):
    return W.garbage(_log(spark, sf), _KEYS, 3).select(*_KEYS, "_txn")


@query("""SELECT o_custkey, o_orderkey, 1::BIGINT AS _txn, 'INSERT' AS event, o_orderstatus AS new, NULL AS old FROM orders
UNION ALL SELECT o_custkey, o_orderkey, 2, 'MODIFY', 'U', o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_custkey, o_orderkey, 3, 'REMOVE', NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 5 = 0""")
def change_feed_images(spark, sf):
    found = W.changes(_log(spark, sf), _KEYS)
    return found.select(*_KEYS, "_txn", "event", F.col("new_image.o_orderstatus").alias("new"), F.col("old_image.o_orderstatus").alias("old"))


def _update(name: str, sql: str, actions: list[U.Action], columns: dict[str, F.Column], where: str = "o_orderkey % 3 = 0", extra: Callable | None = None) -> None:
    def run(spark, sf):
        table = tagged(spark, sf)
        targets = table.df.where(where)
        if extra is not None:
            targets = extra(table.df)
        return W.update(table.df, targets, _KEYS, actions).select(*_KEYS, *[F.expr(c).alias(n) for n, c in columns.items()])

    run.__name__ = f"update_{name}"
    query(sql)(run)


_T = "[o_orderstatus, o_orderpriority]"
_update("set", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderpriority AS level FROM orders", [U.Set("info.status", "done")], {"status": "info.status", "level": "info.rank.level"})
_update("set_new_path", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS b FROM orders", [U.Set("a.b", 1)], {"b": "a.b"})
_update("remove", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS level FROM orders", [U.Remove("info.rank.level")], {"level": "info.rank.level"})
_update("add_number", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS price FROM orders", [U.Add("o_totalprice", 10)], {"price": "o_totalprice"})
_update("add_array", f"SELECT o_custkey, o_orderkey, array_to_string(CASE WHEN o_orderkey % 3 = 0 THEN {_T} || list_filter(['O', 'z', 'z'], lambda x, i: NOT list_contains({_T}, x) AND i < 3) ELSE {_T} END, '|') AS tags FROM orders", [U.Add("tags", ["O", "z", "z"])], {"tags": "array_join(tags, '|')"})
_update("delete_array", f"SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN nullif(array_to_string(list_filter({_T}, lambda x: x NOT IN ('O', '1-URGENT')), '|'), '') ELSE array_to_string({_T}, '|') END AS tags FROM orders", [U.Delete("tags", ["O", "1-URGENT"])], {"tags": "array_join(tags, '|')"})
_update("upsert", "SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders UNION ALL SELECT -1 - o_custkey, o_orderkey, 5.0 FROM orders WHERE o_orderkey % 11 = 0", [U.Add("o_totalprice", 5)], {"price": "o_totalprice"}, extra=lambda df: df.where("o_orderkey % 11 = 0").select((-1 - F.col("o_custkey")).alias("o_custkey"), "o_orderkey"))


# --- validation, counts, vectors ---


@query(f"""SELECT pk, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'missing required attribute ''name''' END,
 CASE WHEN mktsegment IS NULL THEN 'missing required attribute ''mktsegment''' END,
 CASE WHEN acctbal IS NOT NULL THEN 'attribute ''acctbal'' must be String' END], lambda x: x IS NOT NULL), '; ') AS errors FROM {_PARTIES}""")
def validate_schema_errors(spark, sf):
    table = parties(spark, sf)
    schema = PartitionSchema("CUSTOMER", "", (AttributeDef("name", AttrType.STRING, True), AttributeDef("mktsegment", AttrType.STRING, True), AttributeDef("acctbal", AttrType.STRING)), True)
    return table.df.select("pk", F.array_join(validation_errors(table, schema), "; ").alias("errors"))


@query("SELECT count(*) AS count FROM events WHERE user_id = 8 AND event_id > 100 AND event_type = 'click'")
def count_query(spark, sf):
    return events(spark, sf).query().partition_key(8).sort_key_gt(100).filter(E.Eq(A("event_type"), "click")).count()


@query(f"SELECT pk, acctbal FROM {_PARTIES} WHERE nationkey = 3 AND mktsegment = 'BUILDING'")
def composite_index(spark, sf):
    return extras.composite_index(parties(spark, sf), ["nationkey", "mktsegment"], [3, "BUILDING"], "acctbal", ["acctbal"])


def _topk(metric: str, sql: str, order: str) -> None:
    def run(spark, sf):
        table = vectors(spark, sf)
        probe = [float(x) for x in table.df.where("vec_id = 0").select("embedding").first()[0]]
        found = extras.vector_topk(table, "embedding", probe, 10, metric, E.Ge(A("label"), 1))
        return found.select("vec_id", F.round("score", 4).alias("score"))

    run.__name__ = f"vector_topk_{metric}"
    query(f"""WITH p AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {sql} AS score FROM embeddings, p WHERE label >= 1)
SELECT vec_id, round(score, 4) AS score FROM (SELECT * FROM s ORDER BY score {order}, vec_id LIMIT 10)""")(run)


_topk("cosine", "list_cosine_similarity(embedding::DOUBLE[], q)", "DESC")
_topk("dot", "list_inner_product(embedding::DOUBLE[], q)", "DESC")
_topk("euclidean", "list_distance(embedding::DOUBLE[], q)", "ASC")


def _all() -> None:
    from . import managed  # noqa: F401  registers the queries over managed tables


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
