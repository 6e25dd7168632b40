"""Update operations, folded left to right over documents as column rewrites.

Works on typed columns and on the VARIANT column ``doc`` of schemaless collections. Paths may be dotted. Missing
fields start from 0 (INCREMENT), 1 (MULTIPLY), the operand (MIN, MAX) or an empty array (PUSH and the like); so do
fields of a wrong type.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docgraph.functions.predicate import NUMERIC, Fields, json_path, type_at, typed_field

OPERATIONS = ("set", "now", "unset", "inc", "mul", "min", "max", "push", "push_all", "pull", "pull_all", "add_to_set", "pop", "rename")


@dataclass(frozen=True)
class Operation:
    """One rewrite of ``path``; value is the operand, or the new name for RENAME."""

    name: str
    path: str
    value: Any = None


@dataclass
class UpdateSpec:
    """An ordered list of operations; ``upsert`` inserts a document made of them where nothing matches."""

    operations: list[Operation] = field(default_factory=list)
    upsert: bool = False

    def _add(self, name: str, path: str, value: Any = None) -> UpdateSpec:
        self.operations.append(Operation(name, path, value))
        return self

    def set(self, path: str, value: Any) -> UpdateSpec:
        return self._add("set", path, value)

    def touch_date(self, path: str) -> UpdateSpec:
        return self._add("now", path)

    def unset(self, path: str) -> UpdateSpec:
        return self._add("unset", path)

    def inc(self, path: str, by: float) -> UpdateSpec:
        return self._add("inc", path, by)

    def mul(self, path: str, by: float) -> UpdateSpec:
        return self._add("mul", path, by)

    def min(self, path: str, value: Any) -> UpdateSpec:
        return self._add("min", path, value)

    def max(self, path: str, value: Any) -> UpdateSpec:
        return self._add("max", path, value)

    def push(self, path: str, value: Any) -> UpdateSpec:
        return self._add("push", path, value)

    def push_all(self, path: str, values: list) -> UpdateSpec:
        return self._add("push_all", path, values)

    def pull(self, path: str, value: Any) -> UpdateSpec:
        return self._add("pull", path, value)

    def pull_all(self, path: str, values: list) -> UpdateSpec:
        return self._add("pull_all", path, values)

    def add_to_set(self, path: str, value: Any) -> UpdateSpec:
        return self._add("add_to_set", path, value)

    def pop(self, path: str, side: int = 1) -> UpdateSpec:
        """Removes the last element, or the first for -1."""
        return self._add("pop", path, side)

    def rename(self, path: str, name: str) -> UpdateSpec:
        return self._add("rename", path, name)


def variant(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _members(doc: Column) -> Column:
    return F.coalesce(doc.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def put(doc: Column, path: list[str], value: Column) -> Column:
    """``doc`` with the field at ``path`` replaced; objects on the way are made where they are missing."""
    name, rest = path[0], path[1:]
    inner = put(F.try_variant_get(doc, json_path(name), "variant"), rest, value) if rest else value
    others = F.map_filter(_members(doc), lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(name), inner)))


def drop(doc: Column, path: list[str]) -> Column:
    """``doc`` without the field at ``path``; the same where there is none."""
    if len(path) == 1:
        return F.to_variant_object(F.map_filter(_members(doc), lambda k, _: k != path[0]))
    inner = F.try_variant_get(doc, json_path(path[0]), "map<string,variant>")
    return F.when(inner.isNotNull(), put(doc, path[:1], drop(F.to_variant_object(inner), path[1:]))).otherwise(doc)


def _variant_value(op: Operation, doc: Column, now: Column) -> Column:
    """The new value of the field of a document."""
    path, value = json_path(op.path), op.value
    old = F.try_variant_get(doc, path, "variant")
    items = F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))
    number = F.try_variant_get(doc, path, "double")
    numeric = F.schema_of_variant(old)
    is_number = number.isNotNull() & ~numeric.isin("STRING", "BOOLEAN")
    if op.name == "set":
        return variant(value)
    if op.name == "now":
        return F.parse_json(now.cast("string"))
    integer = F.when(numeric == "BIGINT", F.try_variant_get(doc, path, "bigint"))
    if op.name in ("inc", "mul"):
        start = F.when(is_number, number).otherwise(F.lit(0.0 if op.name == "inc" else 1.0))
        changed = start + value if op.name == "inc" else start * value
        if not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63:
            return F.parse_json(changed.cast("string"))
        # Integers stay integers, beyond what a double holds exactly, unless they outgrow 64 bits.
        base = F.coalesce(integer, F.when(~is_number | numeric.isNull(), F.lit(0 if op.name == "inc" else 1).cast("bigint")))
        by = F.lit(value).cast("bigint")
        exact = F.try_add(base, by) if op.name == "inc" else F.try_multiply(base, by)
        return F.parse_json(F.coalesce(exact.cast("string"), changed.cast("string")))
    if op.name in ("min", "max"):
        if isinstance(value, int | float):
            better = number < value if op.name == "min" else number > value
            if isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
                better = F.coalesce(integer < value if op.name == "min" else integer > value, better)
        else:
            text = F.try_variant_get(doc, path, "string")
            better = text < value if op.name == "min" else text > value
        return F.when(F.coalesce(better, F.lit(False)), old).otherwise(variant(value))
    if op.name == "push":
        return F.to_variant_object(F.array_append(items, variant(value)))
    if op.name == "push_all":
        return F.to_variant_object(F.concat(items, *[F.array(variant(v)) for v in value]))
    if op.name in ("pull", "pull_all"):
        gone = [F.to_json(variant(v)) for v in (value if op.name == "pull_all" else [value])]
        return F.to_variant_object(F.filter(items, lambda x: ~F.to_json(x).isin(gone)))
    if op.name == "add_to_set":
        there = F.exists(items, lambda x: F.to_json(x) == F.to_json(variant(value)))
        return F.to_variant_object(F.when(there, items).otherwise(F.array_append(items, variant(value))))
    if op.name == "pop":
        size = F.size(items)
        return F.to_variant_object(F.slice(items, F.lit(2 if value == -1 else 1), F.greatest(size - 1, F.lit(0))))
    raise ValueError(f"unknown operation: {op.name}")


def _variant_document(op: Operation, doc: Column, now: Column) -> Column:
    path = op.path.split(".")
    if op.name == "unset":
        return drop(doc, path)
    if op.name == "rename":
        old = F.try_variant_get(doc, json_path(op.path), "variant")
        return F.when(old.isNull(), doc).otherwise(put(drop(doc, path), [*path[:-1], op.value], old))
    return put(doc, path, _variant_value(op, doc, now))


def _bound(column: Column, rewritten) -> Column:
    """``rewritten(column)`` with the column evaluated once: a chain of rewrites stays as long as it is."""
    return F.get(F.transform(F.array(column), rewritten), 0)


def _typed_value(op: Operation, kind: T.DataType | None, column: Column, now: Column) -> Column:
    value = op.value
    if op.name == "set":
        return F.lit(value).cast(kind) if kind is not None else F.lit(value)
    if op.name == "now":
        return now.cast(kind) if kind is not None else now
    if op.name in ("inc", "mul"):
        start = F.coalesce(column if isinstance(kind, NUMERIC) else column.try_cast("double"), F.lit(0 if op.name == "inc" else 1))
        return start + value if op.name == "inc" else start * value
    if op.name in ("min", "max"):
        pick = F.least if op.name == "min" else F.greatest
        return pick(F.coalesce(column, F.lit(value)), F.lit(value))
    if not isinstance(kind, T.ArrayType):
        if kind is not None and op.name in ("push", "push_all", "add_to_set"):
            raise ValueError(f"{op.path} is not an array")
        kind = T.ArrayType(F_type(value[0] if isinstance(value, list) and value else value))
        column = F.lit(None).cast(kind)
    items = F.coalesce(column, F.array().cast(kind))
    one = lambda v: F.lit(v).cast(kind.elementType)
    if op.name == "push":
        return F.array_append(items, one(value))
    if op.name == "push_all":
        return F.concat(items, *[F.array(one(v)) for v in value])
    if op.name in ("pull", "pull_all"):
        gone = value if op.name == "pull_all" else [value]
        return F.filter(items, lambda x: ~F.coalesce(x.isin([one(v) for v in gone]), F.lit(False)))
    if op.name == "add_to_set":
        return F.when(F.array_contains(items, one(value)), items).otherwise(F.array_append(items, one(value)))
    if op.name == "pop":
        return F.slice(items, F.lit(2 if value == -1 else 1), F.greatest(F.size(items) - 1, F.lit(0)))
    raise ValueError(f"unknown operation: {op.name}")


def F_type(value: Any) -> T.DataType:
    """The Spark type of a literal."""
    return T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()


def _replace(path: list[str], value: Column) -> tuple[str, Column]:
    if len(path) == 1:
        return path[0], value
    return path[0], F.col(f"`{path[0]}`").withField(".".join(f"`{p}`" for p in path[1:]), value)


def rewrite(df: DataFrame, operations: list[Operation], matched: Column, now: Column | None = None) -> DataFrame:
    """``df`` with the operations applied, one after the other, to rows where ``matched``.

    NOW() is in epoch milliseconds. In typed collections UNSET sets null, and a new field becomes a new column.
    ``_id`` cannot be changed.
    """
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    if any(op.path == "_id" or (op.name == "rename" and op.value == "_id") for op in operations):
        raise ValueError("_id cannot be changed")
    out = df.withColumn("__hit", matched)
    if Fields(df.schema).schemaless:
        doc = F.col("doc")
        for op in operations:
            doc = _bound(doc, _variant_step(op, now))
        return out.withColumn("doc", F.when(F.col("__hit"), doc).otherwise(F.col("doc"))).drop("__hit")
    for op in operations:
        path = op.path.split(".")
        kind = type_at(out.schema, op.path)
        column = typed_field(op.path) if kind is not None else F.lit(None)
        if op.name == "rename":
            if len(path) > 1:
                raise ValueError("only whole columns can be renamed in a typed collection")
            if kind is not None:
                out = out.withColumn(op.value, F.when(F.col("__hit"), column)).withColumn(op.path, F.when(~F.col("__hit"), column))
            continue
        if op.name == "unset" and kind is None:
            continue
        if kind is None:
            value = F.when(F.col("__hit"), _typed_value(op, None, column, now))
        else:
            value = _bound(column, _typed_step(op, kind, now))
        name, value = _replace(path, value)
        out = out.withColumn(name, value)
    return out.drop("__hit")


def _variant_step(op: Operation, now: Column):
    return lambda doc: _variant_document(op, doc, now)


def _typed_step(op: Operation, kind: T.DataType, now: Column):
    if op.name == "unset":
        return lambda c: F.when(~F.col("__hit"), c)
    return lambda c: F.when(F.col("__hit"), _typed_value(op, kind, c, now)).otherwise(c)


def apply_to(doc: dict, operations: list[Operation], now: int = 0) -> dict:
    """The same operations over one python document."""
    doc = json.loads(json.dumps(doc))
    for op in operations:
        *way, name = op.path.split(".")
        here = doc
        for part in way:
            if not isinstance(here.get(part), dict):
                here[part] = {}
            here = here[part]
        old, value = here.get(name), op.value
        number = old if isinstance(old, int | float) and not isinstance(old, bool) else None
        items = old if isinstance(old, list) else []
        if op.name == "unset":
            here.pop(name, None)
        elif op.name == "rename":
            if name in here:
                here[value] = here.pop(name)
        else:
            here[name] = {
                "set": lambda: value, "now": lambda: now, "inc": lambda: (number or 0) + value, "mul": lambda: (1 if number is None else number) * value,
                "min": lambda: value if old is None else min(old, value), "max": lambda: value if old is None else max(old, value),
                "push": lambda: [*items, value], "push_all": lambda: [*items, *value], "pull": lambda: [x for x in items if x != value], "pull_all": lambda: [x for x in items if x not in value],
                "add_to_set": lambda: items if value in items else [*items, value], "pop": lambda: items[1:] if value == -1 else items[:-1],
            }[op.name]()
    return doc
