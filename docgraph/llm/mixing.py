"""Mixing sources to target weights."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgraph.plans.durable import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; a null source comes last.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this on average.
MOST = 3
#: Hash seeds that are tried for each source; the one whose words come nearest to the target is used.
SEEDS = 32
#: Up to so many sources the plan goes to every executor (about 100 bytes each); beyond, the join is a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from a row's key and a seed: the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) for one row per source (source, source_size).

    The sources share the sum of all sizes by weight; who would get over ``most`` times its size gets just that, and
    the excess is shared again. Sorted by ``most * size / weight`` the sources fill up in that order, so the level at
    which the others stop follows from running sums. The windows hold one row per source, not per document. A source
    of size 0 has target and rate 0.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    full = F.lit(float(most)) * F.col("source_size")
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("full", full).withColumn("ratio", full / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    filled = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - filled) / open_weight)
    # The first source whose own level stays within its ratio sets the level of all after it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    planned = levels.withColumn("target", F.round(F.least("full", level * F.col("weight")), 6))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return planned.select("source", "source_size", "target", rate.alias("rate"))


def _copies(seed: Column) -> Column:
    return (F.floor("rate") + (draw(F.col("_key"), seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def _join_sources(rows: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    """``plan`` holds one row per source; a hot source's rows stay where they are."""
    small = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(plan) if small else plan, F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).withColumn("_size", size_of(F.col(text_col)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): slim rows (id, source, _key, _size) of the whole table, and (source, source_size, target, rate, seed) per source."""
    rows = cut(_keyed(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col).drop(text_col))
    plan = cut(targets(rows.select(F.col(source_col).alias("source"), "_size").groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most))
    tried = _join_sources(rows, plan, source_col).groupBy(F.col(source_col).alias("source")).agg(*[F.sum(F.col("_size") * _copies(F.lit(s))).alias(f"s{s}") for s in range(seeds)])
    off = tried.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))
    return rows, cut(off.select("source", "source_size", "target", "rate", best["seed"].alias("seed")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of ``docs``; other columns are not read.

    copies: floor(rate), and one more if the row's hash with its source's seed falls below the rest of the rate. Of
    ``seeds`` seeds each source uses the one whose words come nearest to its target. Null texts have size 0, null
    sources are one source, repeated rows share their draw; an empty table gives no rows.
    """
    rows, plan = plan_mix(docs, id_col, text_col, source_col, weights, most, seeds)
    return _join_sources(rows, plan, source_col).select(id_col, source_col, F.col("_size").alias("size"), "source_size", "target", _copies(F.col("seed")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """The mixed corpus: every row of ``docs`` with all its columns, as often as :func:`copies` says. Texts are not shuffled."""
    _, plan = plan_mix(docs, id_col, text_col, source_col, weights, most, seeds)
    plan = plan.select("source", F.col("rate"), F.col("seed").alias("_seed"))
    names = [F.col(f"_row.`{c}`") for c in docs.columns]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).alias("_from"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"))
    kept = _join_sources(kept, plan, "_from").withColumn("_n", _copies(F.col("_seed"))).filter("_n > 0")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*names)
