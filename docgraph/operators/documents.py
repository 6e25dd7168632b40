"""Operators over collections: scans, projection, counting, lookup joins, constraints, updates and deletes.

Every operator takes and returns DataFrames. A collection is either typed (ordinary columns) or schemaless: the columns
``_id`` and ``doc``, a VARIANT.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgraph.functions.predicate import Fields, json_path, lower, type_at, typed_field, where
from docgraph.functions.update import Operation, rewrite


def scan(df: DataFrame, condition=None, limit: int = 0, skip: int = 0, order: str | None = "_id") -> DataFrame:
    """Matching documents. ``limit`` 0 is unlimited; rows are sorted only where limit or skip makes the order visible.

    The order is that of ``order`` (byte order of ids); pass the key column of a typed collection.
    """
    out = where(df, condition)
    if limit or skip:
        out = out.orderBy(order) if order and order in df.columns else out
        out = out.offset(skip) if skip else out
        out = out.limit(limit) if limit else out
    return out


def find_by_id(df: DataFrame, value, id_col: str = "_id") -> DataFrame:
    return df.filter(F.col(id_col) == F.lit(value))


def id_range(df: DataFrame, prefix: str, most: int, id_col: str = "_id") -> DataFrame:
    """At most ``most`` documents whose ids start with ``prefix``, in id order."""
    return df.filter(F.col(id_col).cast("string").startswith(prefix)).orderBy(id_col).limit(most)


def iterate(df: DataFrame) -> Iterable:
    """Rows one partition at a time; the caller may stop early."""
    return df.toLocalIterator()


def project(df: DataFrame, paths: list[str] | None, id_col: str = "_id") -> DataFrame:
    """The fields at dotted paths; ``_id`` is always kept, absent fields are left out (typed) or null (schemaless).

    A nested field is named by its whole path.
    """
    if not paths:
        return df
    fields = Fields(df.schema)
    wanted = ([id_col] if id_col in df.columns else []) + [p for p in paths if p != id_col]
    columns = []
    for path in dict.fromkeys(wanted):
        if fields.schemaless and path != "_id":
            columns.append(F.try_variant_get("doc", json_path(path), "variant").alias(path))
        elif type_at(df.schema, path) is not None:
            columns.append(typed_field(path).alias(path))
    return df.select(*columns)


def exclude(df: DataFrame, names: list[str]) -> DataFrame:
    """All top-level fields but these; ``_id`` stays."""
    names = [n for n in names if n != "_id"]
    if Fields(df.schema).schemaless:
        kept = F.map_filter(F.col("doc").cast("map<string,variant>"), lambda k, _: ~k.isin(names) if names else F.lit(True))
        return df.withColumn("doc", F.to_variant_object(kept))
    return df.drop(*names)


def count(df: DataFrame, condition=None) -> DataFrame:
    """One row: count."""
    return where(df, condition).agg(F.count("*").alias("count"))


def exists(df: DataFrame, condition=None) -> DataFrame:
    """One row: whether any document matches; stops at the first."""
    return where(df, condition).limit(1).agg((F.count("*") > 0).alias("exists"))


def _key(df: DataFrame, path: str) -> Column:
    fields = Fields(df.schema)
    return F.try_variant_get("doc", json_path(path), "string") if fields.schemaless and path != "_id" else typed_field(path)


def lookup_join(left: DataFrame, right: DataFrame, left_path: str, right_path: str, condition=None, how: str = "inner", many: bool = False, limit: int = 0, skip: int = 0, left_id: str = "_id", right_id: str = "_id", name: str = "__joined__") -> DataFrame:
    """Each left document with its match nested as ``name``: an equi-join on two paths.

    ``condition`` filters the left side before the join. One match per left document: the least right id (the whole
    array in id order with ``many``). ``how``: inner leaves out documents without a match, left keeps them with null.
    Missing and null keys match nothing. The right side is reduced to one row per key before the join, map-side first,
    so that a hot key does not multiply rows; Catalyst picks the join by size.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    matched = where(left, condition).withColumn("__key", _key(left, left_path))
    body = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    keyed = right.select(_key(right, right_path).alias("__right"), F.col(right_id).alias("__order"), body.alias("__doc")).filter("__right is not null")
    if many:
        # VARIANT cannot be sorted, so order by the id alone.
        grouped = keyed.groupBy("__right").agg(F.collect_list(F.struct("__order", "__doc")).alias("all"))
        ordered = F.array_sort(F.col("all"), lambda x, y: F.when(x["__order"] < y["__order"], -1).when(x["__order"] > y["__order"], 1).otherwise(0))
        best = grouped.select("__right", F.transform(ordered, lambda x: x["__doc"]).alias(name))
    else:
        best = keyed.groupBy("__right").agg(F.min_by("__doc", "__order").alias(name))
    out = matched.join(best, F.col("__key") == F.col("__right"), how).drop("__key", "__right")
    if limit or skip:
        out = out.orderBy(left_id)
        out = out.offset(skip) if skip else out
        out = out.limit(limit) if limit else out
    return out


def lookup_chain(left: DataFrame, joins: list[tuple[DataFrame, str, str]], condition=None, **options) -> DataFrame:
    """Several lookups, each from the left document; results are ``__joined__``, ``__joined_2__``, and so on."""
    out = where(left, condition)
    for number, (right, left_path, right_path) in enumerate(joins, 1):
        out = lookup_join(out, right, left_path, right_path, name="__joined__" if number == 1 else f"__joined_{number}__", **options)
    return out


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_path: str, parent_path: str) -> DataFrame:
    """Child documents whose reference has no parent; a missing or null reference passes."""
    keys = parent.select(_key(parent, parent_path).alias("__parent")).distinct()
    held = child.withColumn("__child", _key(child, child_path)).filter("__child is not null")
    return held.join(keys, F.col("__child") == F.col("__parent"), "left_anti").drop("__child")


def unique_violations(df: DataFrame, paths: list[str]) -> DataFrame:
    """(the paths' values, count) that occur in more than one document; documents without a value do not count."""
    keyed = df.select(*[_key(df, p).alias(p) for p in paths])
    return keyed.dropna("any").groupBy(*[F.col(f"`{p}`") for p in paths]).agg(F.count("*").alias("count")).filter("count > 1")


def missing_required(df: DataFrame, paths: list[str]) -> DataFrame:
    """Documents that lack one of the fields."""
    fields = Fields(df.schema)
    lacking = F.lit(False)
    for path in paths:
        lacking = lacking | ~fields.present(path)
    return df.filter(lacking)


def update(df: DataFrame, condition, operations: list[Operation], now: Column | None = None) -> DataFrame:
    """The whole collection after the operations on matching documents."""
    return rewrite(df, operations, lower(condition, Fields(df.schema)), now)


def delete(df: DataFrame, condition) -> DataFrame:
    """The whole collection without matching documents."""
    return df.filter(~lower(condition, Fields(df.schema)))


def upsert(df: DataFrame, fresh: DataFrame, id_col: str = "_id") -> DataFrame:
    """The collection with ``fresh`` documents; one of the same id is overwritten. Ids in ``fresh`` must be unique."""
    return df.join(fresh.select(id_col), id_col, "left_anti").unionByName(fresh, allowMissingColumns=True)


def last_of_each(df: DataFrame, order: str, id_col: str = "_id") -> DataFrame:
    """Of several documents with an id the one with the greatest ``order``: what a batch leaves behind."""
    newest = Window.partitionBy(id_col).orderBy(F.col(order).desc())
    return df.withColumn("__turn", F.row_number().over(newest)).filter("__turn = 1").drop("__turn", order)
