"""Predicates over documents, lowered to Spark columns.

Logic is two-valued: a leaf over a missing field is false (only NOT EXISTS is true), and NOT of it is true. Comparisons
are typed: a number meets a string field through ``try_cast`` and a string meets a number field likewise.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "exists", "not exists", "like", "starts with", "contains")


@dataclass(frozen=True)
class Leaf:
    """``path op value``; value is a list for IN and NOT IN and unused for EXISTS."""

    path: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator: {self.op}")


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Nor:
    parts: tuple


@dataclass(frozen=True)
class Everything:
    """The empty predicate."""


class Condition:
    """Builds predicates by hand."""

    leaf = Leaf

    @staticmethod
    def and_(*parts) -> And:
        return And(tuple(parts))

    @staticmethod
    def or_(*parts) -> Or:
        return Or(tuple(parts))

    @staticmethod
    def nor_(*parts) -> Nor:
        return Nor(tuple(parts))

    @staticmethod
    def in_(path: str, values: list) -> Leaf:
        return Leaf(path, "in", list(values))

    @staticmethod
    def is_empty(condition) -> bool:
        return condition is None or isinstance(condition, Everything)

    @staticmethod
    def is_leaf(condition) -> bool:
        return isinstance(condition, Leaf)

    @staticmethod
    def is_composite(condition) -> bool:
        return isinstance(condition, And | Or | Not | Nor)


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path; None where there is no such field."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def typed_field(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def json_path(path: str) -> str:
    return "$" + "".join(f".{p}" for p in path.split("."))


class Fields:
    """How a leaf reads a field: from typed columns, or from the VARIANT column ``doc`` of a schemaless collection."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.schemaless = "doc" in schema.names and isinstance(schema["doc"].dataType, T.VariantType)

    def _variant(self, path: str) -> bool:
        return self.schemaless and path != "_id"

    def kind(self, path: str) -> T.DataType | None:
        return T.VariantType() if self._variant(path) else type_at(self.schema, path)

    def present(self, path: str) -> Column:
        """Whether the field is there; a JSON null is."""
        if self._variant(path):
            return F.try_variant_get("doc", json_path(path), "variant").isNotNull()
        return typed_field(path).isNotNull() if self.kind(path) is not None else F.lit(False)

    def null(self, path: str) -> Column:
        """Whether the field holds a null: a JSON null, or a null of a typed column."""
        if self._variant(path):
            return F.coalesce(F.is_variant_null(F.try_variant_get("doc", json_path(path), "variant")), F.lit(False))
        return typed_field(path).isNull() if self.kind(path) is not None else F.lit(False)

    def get(self, path: str, kind: str) -> Column:
        if self._variant(path):
            return F.try_variant_get("doc", json_path(path), kind)
        have = self.kind(path)
        if have is None:
            return F.lit(None).cast(kind)
        column = typed_field(path)
        if kind == "string" and isinstance(have, T.ArrayType | T.StructType | T.MapType):
            return F.to_json(column)
        return column if have.simpleString() == kind else column.try_cast(kind)

    def value(self, path: str) -> Column:
        return F.try_variant_get("doc", json_path(path), "variant") if self._variant(path) else typed_field(path)


def _pair(fields: Fields, path: str, value: Any) -> tuple[Column, Column] | None:
    """The field and the literal in a common type; None if they cannot be compared."""
    kind = fields.kind(path)
    if isinstance(kind, T.VariantType) and isinstance(value, bool | int | float):
        # A cast would turn booleans and numbers into each other.
        other = ("BOOLEAN", "STRING") if isinstance(value, bool) else ("BOOLEAN",)
        like = F.schema_of_variant(fields.value(path)).isin(*other)
        got = fields.get(path, "boolean" if isinstance(value, bool) else "double")
        return F.when(like if isinstance(value, bool) else ~like, got), F.lit(value if isinstance(value, bool) else float(value))
    if isinstance(value, bool):
        return (fields.get(path, "boolean"), F.lit(value)) if kind is None or isinstance(kind, T.VariantType | T.BooleanType | T.StringType) else None
    if isinstance(value, int | float):
        if isinstance(kind, NUMERIC):
            return fields.value(path), F.lit(value)
        return fields.get(path, "double"), F.lit(float(value))
    if isinstance(kind, NUMERIC):
        return fields.value(path).cast("double"), F.lit(str(value)).try_cast("double")
    if isinstance(kind, T.BooleanType):
        return fields.value(path), F.lit(str(value)).try_cast("boolean")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return fields.value(path), F.lit(str(value)).try_cast(kind)
    return fields.get(path, "string"), F.lit(str(value))


def _whole(value: Any) -> int | None:
    """A number without a fraction that fits 64 bits, as an int."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")):
        return None
    return int(value) if value == int(value) and -(1 << 63) <= value < 1 << 63 else None


_COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _is_integer(fields: Fields, path: str) -> Column:
    """Whether a field of a document holds an integer: a double would round large ones."""
    return F.coalesce(F.schema_of_variant(fields.value(path)) == "BIGINT", F.lit(False))


def _compare(fields: Fields, path: str, op: str, value: Any) -> Column:
    if value is None:
        return fields.null(path) if op == "=" else fields.present(path) & ~fields.null(path) if op == "!=" else F.lit(False)
    pair = _pair(fields, path, value)
    whole = _whole(value)
    if pair is not None and whole is not None and isinstance(fields.kind(path), T.VariantType):
        same, exact = "=" if op == "!=" else op, fields.get(path, "bigint")
        found = F.when(_is_integer(fields, path), _COMPARE[same](exact, F.lit(whole).cast("bigint"))).otherwise(_COMPARE[same](*pair))
        return fields.present(path) & ~F.coalesce(found, F.lit(False)) if op == "!=" else found
    if pair is None:
        return fields.present(path) if op == "!=" else F.lit(False)
    a, b = pair
    if op == "!=":
        # A present field of another type differs from the value.
        return fields.present(path) & ~F.coalesce(a == b, F.lit(False))
    return _COMPARE[op](a, b)


def _regex_ok(pattern: str) -> bool:
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _leaf(leaf: Leaf, fields: Fields) -> Column:
    path, op, value = leaf.path, leaf.op, leaf.value
    if op == "exists":
        return fields.present(path)
    if op == "not exists":
        return ~fields.present(path)
    if op in ("in", "not in"):
        kinds = {type(v) for v in value}
        pairs = [_pair(fields, path, v) for v in value] if kinds in ({int}, {float}, {int, float}, {str}) else []
        if pairs and all(p is not None for p in pairs):
            among = pairs[0][0].isin([p[1] for p in pairs])
            whole = [F.lit(w).cast("bigint") for v in value if (w := _whole(v)) is not None]
            if whole and isinstance(fields.kind(path), T.VariantType):
                among = F.when(_is_integer(fields, path), fields.get(path, "bigint").isin(whole)).otherwise(among)
            among = F.coalesce(among, F.lit(False))
        else:
            among = reduce(lambda x, y: x | y, (F.coalesce(_compare(fields, path, "=", v), F.lit(False)) for v in value), F.lit(False))
        return among if op == "in" else fields.present(path) & ~among
    if op == "like":
        return fields.get(path, "string").rlike(value) if _regex_ok(value) else F.lit(False)
    if op == "starts with":
        return fields.get(path, "string").startswith(value)
    if op == "contains":
        kind = fields.kind(path)
        if isinstance(kind, T.ArrayType):
            return F.array_contains(typed_field(path).cast("array<string>"), value)
        if isinstance(kind, T.VariantType):
            return F.coalesce(fields.get(path, "string").contains(value), F.array_contains(fields.get(path, "array<string>"), value))
        return fields.get(path, "string").contains(value)
    return _compare(fields, path, op, value)


def lower(condition, fields: Fields) -> Column:
    """A boolean column that is never null."""
    if condition is None or isinstance(condition, Everything):
        return F.lit(True)
    if isinstance(condition, Leaf):
        return F.coalesce(_leaf(condition, fields), F.lit(False))
    if isinstance(condition, Not):
        return ~lower(condition.part, fields)
    parts = [lower(p, fields) for p in condition.parts]
    if isinstance(condition, And):
        return reduce(lambda x, y: x & y, parts, F.lit(True))
    either = reduce(lambda x, y: x | y, parts, F.lit(False))
    return either if isinstance(condition, Or) else ~either


def _kept(condition, fields: Fields) -> Column:
    """A column that is true just where the predicate holds; elsewhere false or null, which a filter drops alike.

    AND and OR of leaves need no guard, so they reach the scan; what stands below NOT does.
    """
    if isinstance(condition, Leaf):
        return _leaf(condition, fields)
    if isinstance(condition, And | Or):
        parts = [_kept(p, fields) for p in condition.parts]
        return reduce(lambda x, y: x & y, parts, F.lit(True)) if isinstance(condition, And) else reduce(lambda x, y: x | y, parts) if parts else F.lit(False)
    return lower(condition, fields)


def where(df: DataFrame, condition) -> DataFrame:
    """The rows that match; what stands outside NOT without a guard so that it reaches the scan."""
    if Condition.is_empty(condition):
        return df
    fields = Fields(df.schema)
    if isinstance(condition, And):
        return reduce(where, condition.parts, df)
    return df.filter(_kept(condition, fields))


def matches(condition, doc: dict) -> bool:
    """The same predicate over one python document; for checks of constraints and tests."""
    if Condition.is_empty(condition):
        return True
    if isinstance(condition, Not):
        return not matches(condition.part, doc)
    if isinstance(condition, And):
        return all(matches(p, doc) for p in condition.parts)
    if isinstance(condition, Or | Nor):
        return any(matches(p, doc) for p in condition.parts) != isinstance(condition, Nor)
    import re

    value, there = doc, True
    for part in condition.path.split("."):
        there = isinstance(value, dict) and part in value
        if not there:
            break
        value = value[part]
    op, want = condition.op, condition.value
    if op in ("exists", "not exists"):
        return there == (op == "exists")
    if not there:
        return False
    if op in ("in", "not in"):
        return any(_same(value, w) for w in want) == (op == "in")
    if op in ("=", "!="):
        return _same(value, want) == (op == "=") if not (op == "!=" and want is None) else value is not None
    text = value if isinstance(value, str) else None if value is None else json.dumps(value, separators=(",", ":"))
    if op == "like":
        return text is not None and re.search(want, text) is not None
    if op == "starts with":
        return text is not None and text.startswith(want)
    if op == "contains":
        return want in value if isinstance(value, list) else text is not None and want in text
    if isinstance(want, bool) or isinstance(value, bool):
        return isinstance(want, bool) and isinstance(value, bool) and {">": value > want, ">=": value >= want, "<": value < want, "<=": value <= want}[op]
    if isinstance(want, int | float):
        try:
            # Two integers meet as such: floats would round large ones.
            value = value if isinstance(value, int) and isinstance(want, int) else float(value)
        except (TypeError, ValueError):
            return False
    else:
        value = text
    return value is not None and want is not None and {">": value > want, ">=": value >= want, "<": value < want, "<=": value <= want}[op]


def _same(value: Any, want: Any) -> bool:
    if want is None or value is None:
        return value is want
    if isinstance(want, bool) or isinstance(value, bool):
        return str(value).lower() == str(want).lower() if isinstance(value, str | bool) else False
    if isinstance(want, int | float):
        try:
            return not isinstance(value, bool) and (value == want if isinstance(value, int) and isinstance(want, int) else float(value) == float(want))
        except (TypeError, ValueError):
            return False
    return (value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))) == want
