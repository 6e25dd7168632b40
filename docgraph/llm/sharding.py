"""Sharding by extendible hashing, with DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from docgraph.plans.durable import cut

#: Bytes that a shard may hold.
LIMIT = 1 << 20
#: Bits of a row's place: 60 of its key's hash, then 60 that tell rows of equal key apart.
KEY_BITS = 60
#: Prefix bits that one round looks at beyond the depth that an even spread would need.
SPARE = 4


def hash_bits(key: Column) -> Column:
    """The first 60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _leaves(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """For each cell (group, cell, bytes, docs) of ``depth`` bits below ``base`` its leaf: the shortest prefix that fits.

    A prefix with a single row is a leaf too, however long the row. Sums are pre-aggregated where the cells are. No
    cell meets a prefix shorter than the shortest that fits anywhere: at the first levels one prefix would get them all.
    """
    paths = cells.select("group", "cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
    paths = paths.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = paths.groupBy("group", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = cut(sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)))
    least = fits.agg(F.min("depth")).first()[0]
    near = paths.filter(F.col("depth") >= (depth + 1 if least is None else least))
    best = near.join(fits, ["group", "depth", "prefix"]).groupBy("group", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("leaf"))
    return best.select("group", "cell", "leaf.*")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, bytes, shard_id, depth, shard_bytes, shard_docs) for each row of ``docs``; other columns are not read.

    bytes: UTF-8 bytes of the text (null: 0). shard_id: the leaf's hash-prefix bits as a string of 0 and 1, as many as
    its local depth; the empty string if one shard holds all. No shard exceeds ``limit`` bytes unless it holds one row.
    A bucket is split on another bit only if it is oversized. Null ids hash as the string 'null'. Rows of equal id
    are split, if they must be, by bits from their place in the table. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"))
    slim = cut(slim.withColumn("bits", hash_bits(F.coalesce(F.col("id").cast("string"), F.lit("null")))).withColumn("more", hash_bits(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))))
    done = None
    left, path = slim.withColumn("group", F.lit("")), 0
    while True:
        total = left.groupBy("group").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
        if total is None:
            break
        base = path % KEY_BITS
        depth = min(KEY_BITS, base + max(0, -(-total // limit) - 1).bit_length() + SPARE)
        bits = F.col("bits" if path < KEY_BITS else "more")
        celled = left.withColumn("cell", F.shiftright(bits, KEY_BITS - depth))
        leaves = _leaves(celled.groupBy("group", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), base, depth, limit)
        placed = cut(celled.join(leaves, ["group", "cell"], "left"))
        name = F.concat("group", F.when(F.col("depth") > base, F.right(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), KEY_BITS, "0"), F.col("depth") - base)).otherwise(F.lit("")))
        found = placed.filter("depth is not null").select("id", "bytes", name.alias("shard_id"), (F.col("depth") + (path - base)).alias("depth"), "shard_bytes", "shard_docs")
        done = found if done is None else done.union(found)
        # What is left shares all bits so far; its group is that prefix.
        prefix = F.concat("group", F.right(F.lpad(F.conv(F.col("cell").cast("string"), 10, 2), KEY_BITS, "0"), F.lit(depth - base)))
        left = placed.filter("depth is null").withColumn("group", prefix).select(*left.columns)
        path += depth - base
        if path >= 2 * KEY_BITS:
            raise RuntimeError("rows share 120 bits")
    done = slim.limit(0).selectExpr("id", "bytes", "'' shard_id", "0 depth", "bytes shard_bytes", "0L shard_docs") if done is None else done
    return done.withColumnRenamed("id", id_col)


def directory(assigned: DataFrame) -> DataFrame:
    """The directory: (shard_id, depth, shard_bytes, shard_docs, global_depth, entries), one row per leaf.

    global_depth is the greatest local depth; entries is how many directory slots of that many bits point to the leaf.
    """
    leaves = assigned.select("shard_id", "depth", "shard_bytes", "shard_docs").distinct()
    deepest = leaves.agg(F.max("depth").alias("global_depth"))
    return leaves.join(F.broadcast(deepest)).withColumn("entries", F.pow(F.lit(2.0), F.col("global_depth") - F.col("depth")).cast("long"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes ``docs`` as Parquet, one folder ``shard=<bits>`` for each shard; ids must be unique to match rows."""
    places = assign(docs, id_col, text_col, limit).select(F.col(id_col).alias("_id"), F.concat(F.lit("b"), "shard_id").alias("shard"))
    docs.join(places, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id").repartition("shard").write.partitionBy("shard").parquet(path)
