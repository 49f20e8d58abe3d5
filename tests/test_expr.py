"""The compiler against the interpreter, on typed and schemaless bindings, and the JSON form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions.resolve import TypedResolver, VariantResolver
from tidemark.sources.store import to_text
from tidemark.types import InvalidExpression

A = E.Attr
DOC = {
    "sku": "lamp-7", "title": "Harbour lamp", "stock": 12, "listed": True, "weight": 3.25,
    "maker": {"town": "Tromso", "since": 1931, "line": {"tier": "b"}}, "finishes": ["brass", "slate", None], "recalled": None,
}

CASES = [
    (E.Eq(A("stock"), 12), True), (E.Eq(A("stock"), 12.0), True), (E.Eq(A("stock"), "12"), False), (E.Ne(A("stock"), "12"), True),
    (E.Eq(A("colour"), None), True), (E.Eq(A("recalled"), None), True), (E.Ne(A("colour"), 0), True), (E.Eq(A("finishes"), ["brass", "slate", None]), False),
    (E.Lt(A("stock"), 12.5), True), (E.Lt(A("colour"), 12.5), False), (E.Not(E.Lt(A("colour"), 12.5)), True), (E.Le(A("colour"), None), True),
    (E.Ge(A("recalled"), A("colour")), True), (E.Gt(A("weight"), 3), True), (E.Between(A("stock"), 12, 12), True), (E.Between(A("colour"), None, None), True),
    (E.BeginsWith(A("title"), "Harb"), True), (E.BeginsWith(A("stock"), "1"), False), (E.Contains(A("finishes"), "slate"), True), (E.Contains(A("finishes"), "sla"), False),
    (E.Contains(A("finishes"), None), True), (E.Contains(A("title"), "our l"), True), (E.Contains(A("maker"), "town"), False), (E.Eq(A("maker.town"), "Tromso"), True),
    (E.Eq(A("maker.line.tier"), "b"), True), (E.Eq(A("maker.town.x"), None), True), (E.Eq(A("finishes.1"), None), True), (E.AttributeExists("recalled"), False),
    (E.AttributeNotExists("recalled"), True), (E.AttributeExists("maker.since"), True), (E.And(), True), (E.Or(), False), (E.Eq(A("listed"), True), True),
    (E.Gt(A("listed"), False), True), (E.Eq(A("sku"), A("sku")), True), (E.Eq(E.Literal(2), E.Literal(2.0)), True),
]


@pytest.mark.parametrize(("e", "holds"), CASES)
def test_interpreter(e, holds):
    assert E.evaluate(e, DOC) is holds


def test_json_form():
    for e, _ in CASES:
        assert E.from_json(json.loads(json.dumps(E.to_json(e)))) == e
    assert E.to_json(E.Gt(A("stock"), 4)) == {"Gt": [{"Attr": "stock"}, {"Literal": 4}]}
    for bad in ({}, {"Gt": [1]}, {"Wat": []}, {"And": 3}, {"BeginsWith": [{"Attr": "a"}, 3]}, 7):
        with pytest.raises(InvalidExpression):
            E.from_json(bad)


def test_errors_surface_only_where_reached():
    bad, no, yes = A("title"), E.Eq(A("stock"), 1), E.Eq(A("stock"), 12)
    assert E.evaluate(E.And(no, bad), DOC) is False
    assert E.evaluate(E.Or(yes, bad), DOC) is True
    for reached in (E.And(yes, bad), E.Or(no, bad), E.Not(bad), E.Eq(E.And(), E.Literal(1))):
        with pytest.raises(InvalidExpression):
            E.evaluate(reached, DOC)


def _nested(n):
    e = E.Eq(A("stock"), 12)
    for _ in range(n):
        e = E.Not(e)
    return e


def test_depth():
    assert E.evaluate(_nested(16), DOC) is True
    with pytest.raises(InvalidExpression):
        E.evaluate(_nested(17), DOC)


def _random(r, depth=0, bad=True):
    value = lambda: r.choice([A(r.choice(["a", "b", "s", "t", "f", "n", "o.x", "o.y", "none", "xs"])), E.Literal(r.choice([None, 0, 1, 2.5, 1.0, -3, "", "a", "ab", True, False, 10**20, 0.5]))])
    kind = r.random()
    if depth < 3 and kind < 0.45:
        op = r.choice([E.And, E.Or, E.Not])
        return op(_random(r, depth + 1, bad)) if op is E.Not else op(*[_random(r, depth + 1, bad) for _ in range(r.randint(0, 3))])
    if bad and kind > 0.97:
        return A("a")
    pick = r.randint(0, 9)
    if pick < 6:
        return E.Expr(E.COMPARISONS[pick], (value(), value()))
    if pick == 6:
        return E.Between(value(), value(), value())
    if pick == 7:
        return E.BeginsWith(value(), r.choice(["", "a", "ab"]))
    if pick == 8:
        return E.Contains(value(), r.choice(["a", "", 1, 1.0, None, True]))
    return r.choice([E.AttributeExists, E.AttributeNotExists])(r.choice(["a", "o.x", "none", "o"]))


def _expected(e, doc):
    try:
        return E.evaluate(e, doc)
    except InvalidExpression:
        return False


def test_typed_compiler_matches_interpreter(spark):
    r = random.Random(4)
    pool = {"a": [None, 0, 1, 2, -3, 7], "b": [None, 1, 2], "s": [None, "", "a", "ab", "b"], "t": [None, "a", "zz"], "f": [None, True, False], "n": [None, 0.5, 1.0, 2.5, -3.0]}
    docs = []
    for i in range(60):
        d = {k: r.choice(v) for k, v in pool.items()}
        d |= {"i": i, "o": r.choice([None, {"x": r.choice([None, 1, 2]), "y": r.choice([None, "a"])}]), "xs": r.choice([None, [], [1, 2], [1, None]])}
        docs.append(d)
    schema = "i long, a long, b int, s string, t string, f boolean, n double, o struct<x:long,y:string>, xs array<long>"
    df = spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in docs], schema)
    resolver = TypedResolver(df)
    exprs = [_random(r) for _ in range(400)]
    for at in range(0, len(exprs), 50):
        part = exprs[at : at + 50]
        rows = df.select("i", *[F.coalesce(E.compile_filter(e, resolver), F.lit(False)).alias(f"c{j}") for j, e in enumerate(part)]).collect()
        for row in rows:
            for j, e in enumerate(part):
                assert row[f"c{j}"] == _expected(e, docs[row["i"]]), (E.to_json(e), docs[row["i"]])


def test_variant_compiler_matches_interpreter(spark):
    r = random.Random(9)
    pool = [None, 0, 1, 1.0, 2.5, -3, "", "a", "ab", "1", True, False, [1, "a"], [1.0, None], {"x": 1}, {"x": "a", "y": 2.5}]
    docs = [{k: r.choice(pool) for k in ("a", "b", "s", "t", "f", "n", "o", "xs") if r.random() < 0.85} for _ in range(50)]
    df = spark.createDataFrame([(i, to_text(d)) for i, d in enumerate(docs)], "i long, text string").select("i", F.parse_json("text").alias("doc"))
    resolver = VariantResolver("doc")
    exprs = [_random(r) for _ in range(90)]
    for at in range(0, len(exprs), 15):
        part = exprs[at : at + 15]
        rows = df.select("i", *[F.coalesce(E.compile_filter(e, resolver), F.lit(False)).alias(f"c{j}") for j, e in enumerate(part)]).collect()
        for row in rows:
            for j, e in enumerate(part):
                assert row[f"c{j}"] == _expected(e, docs[row["i"]]), (E.to_json(e), docs[row["i"]])


def test_conditions_raise_when_an_error_is_reached(spark):
    df = spark.createDataFrame([(1,)], "a long")
    resolver = TypedResolver(df)
    assert df.select(E.compile_condition(E.And(E.Eq(A("a"), 2), A("a")), resolver)).first()[0] is False
    with pytest.raises(Exception, match="invalid filter expression"):
        df.select(E.compile_condition(E.And(E.Eq(A("a"), 1), A("a")), resolver)).collect()


def _pushed(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.rindex("PushedFilters") :].split("]")[0]


def test_filters_reach_the_scan(spark, sf):
    from tidemark.plans import workload as w

    rows = w.orders(spark, sf).scan().filter(E.And(E.Gt(A("o_totalprice"), 1000), E.Not(E.Eq(A("o_orderstatus"), "F")))).projection(["o_totalprice"]).to_df(ordered=False)
    assert "GreaterThan(o_totalprice,1000.0)" in _pushed(rows) and "Not(EqualNullSafe(o_orderstatus,F))" in _pushed(rows)
    rows = w.events(spark, sf).query().partition_key(8).sort_key_between(10, 20.5).to_df(ordered=False)
    for part in ("EqualTo(user_id,8)", "GreaterThanOrEqual(event_id,10)", "LessThanOrEqual(event_id,20)"):
        assert part in _pushed(rows)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in w.orders(spark, sf).scan().filter(E.Eq(A("o_orderstatus"), "F")).projection(["o_totalprice"]).to_df(ordered=False)._jdf.queryExecution().toString()


def test_big_integers_compare_exactly(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "a long")
    assert df.where(E.compile_filter(E.Eq(A("a"), 2**53 + 1), TypedResolver(df))).count() == 1
    assert df.where(E.compile_filter(E.Lt(A("a"), 1e300), TypedResolver(df))).count() == 2
    assert df.where(E.compile_filter(E.Ge(A("a"), -1e300), TypedResolver(df))).count() == 2
    assert df.where(E.compile_filter(E.Gt(A("a"), 1e300), TypedResolver(df))).count() == 0


def test_any_name_can_be_a_path(spark):
    names = ["it's", 'say "x"', "a[0]", "why?", "['q']", "plain"]
    df = spark.createDataFrame([(to_text({n: i, "in": {n: {"deep": i}}}),) for i, n in enumerate(names)], "text string").select(F.parse_json("text").alias("doc"))
    resolver = VariantResolver("doc")
    for i, n in enumerate(names):
        for path in (n, f"in.{n}.deep"):
            assert df.where(E.compile_filter(E.Eq(A(path), i), resolver)).count() == 1
    assert df.where(E.compile_filter(E.AttributeExists("none.it's"), resolver)).count() == 0
