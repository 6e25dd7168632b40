"""Collections from files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A typed collection."""
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A schemaless collection from JSON lines; lines without an ``_id`` get one, broken lines are left out."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("doc")).filter("doc is not null")
    key = F.coalesce(F.try_variant_get("doc", "$._id", "string"), F.uuid())
    return lines.select(key.alias("_id"), "doc")


def to_schemaless(df: DataFrame, id_col: str) -> DataFrame:
    """A typed table as a schemaless collection."""
    return df.select(F.col(id_col).cast("string").alias("_id"), F.parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("doc"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    body = F.to_json("doc") if "doc" in df.columns else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    df.select(body.alias("value")).write.mode("overwrite").text(path)


def run_script(session, path: str) -> list[dict]:
    """Runs a script file of statements."""
    text = "\n".join(r.value for r in session.spark.read.text(path, wholetext=True).collect())
    return session.execute(text)
