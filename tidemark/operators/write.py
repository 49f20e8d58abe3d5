"""Set-oriented writes as plans over whole tables: version logs, batches, conditions, returned images, change feeds.

A log is any DataFrame with key columns, ``_txn``, ``_seq`` and ``_op`` ('put' or 'delete'). Everything here is a
lazy DataFrame, one shuffle on the keys where versions meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import Expr, compile_condition, evaluate
from ..functions.resolve import TypedResolver
from ..functions.update import Action, _changed, _nested, check_keys
from ..types import ConditionCheckFailed, InvalidExpression


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def as_log(df: DataFrame, txn: int, seq: int = 0, op: str = "put") -> DataFrame:
    """Rows as one transaction of a log."""
    return df.select("*", F.lit(txn).cast("long").alias("_txn"), F.lit(seq).alias("_seq"), F.lit(op).alias("_op"))


def latest(log: DataFrame, keys: Sequence[str], snapshot: int | None = None) -> DataFrame:
    """Each key's last version at a snapshot, tombstones included."""
    if snapshot is not None:
        log = log.where(F.col("_txn") <= snapshot)
    order = Window.partitionBy(*_keys(keys)).orderBy(F.desc("_txn"), F.desc("_seq"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def state(log: DataFrame, keys: Sequence[str], snapshot: int | None = None) -> DataFrame:
    """The live items at a snapshot, with their versions in _txn."""
    return latest(log, keys, snapshot).where("_op = 'put'").drop("_seq", "_op")


def garbage(log: DataFrame, keys: Sequence[str], oldest: int) -> DataFrame:
    """Versions that no snapshot from ``oldest`` on can see: those followed by another at or before it, and tombstones then."""
    order = Window.partitionBy(*_keys(keys)).orderBy("_txn", "_seq")
    after = log.withColumn("_next", F.lead("_txn").over(order))
    dead = (F.col("_next") <= oldest) | ((F.col("_op") == "delete") & (F.col("_txn") <= oldest) & F.col("_next").isNull())
    return after.where(dead).drop("_next")


def apply_batch(base: DataFrame, mutations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base after a batch of unconditional mutations (columns of base, ``_seq``, ``_op``); the last one of a key wins."""
    marked = base.select("*", F.lit(-1).alias("_seq"), F.lit("put").alias("_op"))
    both = marked.unionByName(mutations, allowMissingColumns=True)
    order = Window.partitionBy(*_keys(keys)).orderBy(F.desc("_seq"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND _op = 'put'").drop("_n", "_seq", "_op")


def conditional(base: DataFrame, puts: DataFrame, keys: Sequence[str], condition: Expr, version: str | None = None) -> DataFrame:
    """puts with ``_ok`` (the condition on the present item holds; an absent item is an empty document) and the
    present item as ``_old``. version names a column of both: expected in puts, actual in base, 0 where absent."""
    attributes = [c for c in base.columns if c not in keys]
    inner = base.withColumn("_met", compile_condition(condition, TypedResolver(base)))
    try:
        absent = F.lit(evaluate(condition, {}))
    except InvalidExpression as e:
        absent = F.raise_error(F.lit(str(e))).cast("boolean")
    old = inner.select(*_keys(keys), "_met", F.struct(*_keys(keys), *[F.col(f"`{c}`") for c in attributes]).alias("_old"))
    joined = puts.join(old, list(keys), "left")
    met = F.when(F.col("_old").isNull(), absent).otherwise(F.col("_met"))
    if version is not None:
        met = met & (F.col(f"`{version}`") == F.coalesce(F.col(f"_old.`{version}`"), F.lit(0)))
    return joined.withColumn("_ok", met).drop("_met")


def require(checked: DataFrame) -> DataFrame:
    """The puts of ``conditional`` if all of them may go; raises ConditionCheckFailed, and writes nothing, if one may not."""
    failed = checked.where(~F.col("_ok")).limit(1).count()
    if failed:
        raise ConditionCheckFailed("condition check failed: the condition evaluated to false")
    return checked.drop("_ok", "_old")


def put(base: DataFrame, puts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with whole items put; puts hold a key once."""
    return apply_batch(base, puts.select("*", F.lit(0).alias("_seq"), F.lit("put").alias("_op")), keys)


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the items of the given keys."""
    return base.join(gone.select(*_keys(keys)), list(keys), "left_anti")


def update(base: DataFrame, targets: DataFrame, keys: Sequence[str], actions: Sequence[Action], upsert: bool = True) -> DataFrame:
    """base with the actions applied to the items of the target keys; absent items are made of their keys first."""
    hit = base.join(targets.select(*_keys(keys)).distinct().withColumn("_hit", F.lit(True)), list(keys), "full" if upsert else "left")
    made = {}
    for name in dict.fromkeys(a.path.split(".")[0] for a in actions):
        new = _expression(hit, [a for a in actions if a.path.split(".")[0] == name], keys, name)
        kind = loose(hit.select(new.alias("x")).schema["x"].dataType)
        old = F.col(f"`{name}`").cast(kind) if name in hit.columns else F.lit(None).cast(kind)
        made[name] = F.when(F.col("_hit"), new.cast(kind)).otherwise(old)
    return hit.withColumns(made).drop("_hit")


def loose(kind: T.DataType) -> T.DataType:
    """A type whose fields and elements may all be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(loose(kind.elementType), True)
    return kind


def _expression(df: DataFrame, actions: Sequence[Action], keys: Sequence[str], name: str) -> Column:
    """What several actions on one attribute make of it, as a single column."""
    check_keys(actions, keys)
    known = name in df.columns
    column, kind = (F.col(f"`{name}`"), df.schema[name].dataType) if known else (None, None)
    for a in actions:
        rest = a.path.split(".")[1:]
        made = _nested(column, kind, rest, a) if rest else _changed(column, kind, a)
        if made is not None:
            column = made
            kind = df.select(made.alias("x")).schema["x"].dataType
    return column if column is not None else F.lit(None)


def changes(log: DataFrame, keys: Sequence[str], view: str = "new_and_old_images") -> DataFrame:
    """The change feed of a log: per version its kind (INSERT, MODIFY, REMOVE), and the images the view shows.

    Views: keys_only, new_image, old_image, new_and_old_images. A deletion of an absent item is no change.
    """
    payload = [c for c in log.columns if c not in (*keys, "_txn", "_seq", "_op")]
    image = F.when(F.col("_op") == "put", F.struct(*[F.col(f"`{c}`") for c in payload]))
    order = Window.partitionBy(*_keys(keys)).orderBy("_txn", "_seq")
    rows = log.select(*_keys(keys), "_txn", "_seq", "_op", image.alias("new_image"))
    rows = rows.withColumn("old_image", F.lag("new_image").over(order))
    kind = F.when(F.col("_op") == "delete", "REMOVE").when(F.col("old_image").isNull(), "INSERT").otherwise("MODIFY")
    rows = rows.where("_op = 'put' OR old_image IS NOT NULL").withColumn("event", kind)
    shown = {"keys_only": [], "new_image": ["new_image"], "old_image": ["old_image"], "new_and_old_images": ["new_image", "old_image"]}[view]
    return rows.select(*_keys(keys), "_txn", "_seq", "event", *shown)
