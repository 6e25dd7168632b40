"""One document of each group of near-duplicates: SimHash and MinHash candidates, verified by the overlap of word shingles.

Whole texts that are equal after lower-casing and joining words count once. Each other text gets two 64-bit SimHash
fingerprints over its distinct words (a changed word moves few of their bits, while it breaks many shingles); texts
within four bits in either are candidates, found by Golay keys. An appended or missing passage moves more bits than
that, so texts that share a band are candidates too: the MinHash minima of their five-word shingles, 32 bands of five.
Two texts of similarity s share one with a probability of 1 - (1 - s^5)^32, which misses 3 of a million pairs at 0.8.
A pair is a link if the sets of five-word shingles have a similarity (intersection over union) of 0.8 or more; groups
are what links connect.

A group of n near copies has about n^2 candidate pairs. So each cluster of candidates first compares its members with
its most central text (n pairs). Where that leaves a cluster in several groups, all but the members of its largest group
are compared with each other and with that group, in blocks of bounded size: a task holds two blocks, counts common
shingles by an inverted index, and returns links between groups alone. Whatever stands in one cluster is compared
exactly, candidates or not.

Texts that share a key travel to its task one by one; of those that already meet in one batch only the first does, and
the others are linked to it at once, so a key of very many texts does not load one task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docgraph.llm import simhash
from docgraph.plans.components import connected_components
from docgraph.plans.durable import cut

SIZE = 5
SIMILARITY = 0.8
SEEDS = (42, 43)
#: MinHash bands, and minima in each.
BANDS, ROWS = 32, 5
#: Odd factors: the order of shingles' hashes times one of them is one of the random orders.
FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 42) | 1 for i in range(BANDS * ROWS)], np.uint64)
#: Bytes of shingle sets that one side of a comparison holds.
BLOCK = 4 << 20
#: Rows of a cluster's smaller table for each row, so that a large cluster's join is split.
SALTS = 8
#: Edges that a task holds before it turns them into stars.
HELD = 1 << 20
#: Keys of bands begin here; those of fingerprints are below.
BAND_KEYS = 1 << 62


def bands(shingles: np.ndarray) -> np.ndarray:
    """The keys of a text's bands, from ``BAND_KEYS`` up; a key holds the number of its band."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * FACTORS).min(axis=0))
    hashes = np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)
    return (hashes >> np.uint64(2)).view(np.int64) | BAND_KEYS


def _prints(text: Column, size: int) -> Column:
    @F.pandas_udf("whole string, p0 long, p1 long, bands array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                words = simhash.words_of(t)
                distinct = list(set(words))
                hashes = [np.fromiter((xxhash.xxh64_intdigest(w, s) for w in distinct), np.uint64, len(distinct)) for s in SEEDS]
                rows.append((_digest(words), *map(simhash.majority, hashes), bands(simhash.shingle_hashes(words, size, 42))))
            yield pd.DataFrame(rows, columns=["whole", "p0", "p1", "bands"])

    return run(text)


def _shingles(text: Column, size: int) -> Column:
    @F.pandas_udf("whole string, set binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield _sets(batch, size)

    return run(text)


def _sets(texts: pd.Series, size: int) -> pd.DataFrame:
    """(whole, set) of each text; the words of one text are held at a time."""
    rows = []
    for t in texts:
        words = simhash.words_of(t)
        rows.append((_digest(words), np.unique(simhash.shingle_hashes(words, size, 42)).tobytes()))
    return pd.DataFrame(rows, columns=["whole", "set"])


def _digest(words: list[bytes]) -> str:
    return xxhash.xxh128_hexdigest(b" ".join(words))


def _similarity(one: Column, two: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both) if len(p) + len(q) else 1.0)
        return pd.Series(out)

    return run(one, two)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("t")), "b")
    return both.filter(_similarity(F.col("s"), F.col("t")) >= similarity).select("a", "b")


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, print, node, head) of each text (number, p0, p1, bands): Golay keys of both fingerprints, and bands.

    Texts of a batch with one key and fingerprint are linked to the first of them here: a row with that ``head`` and a
    key that spreads evenly. Only the first goes to the key's task.
    """
    table = simhash.golay_table()
    for batch in batches:
        for at in range(0, len(batch), 10_000):
            part = batch.iloc[at : at + 10_000]
            number = part["number"].to_numpy(np.int64)
            rows, keys, prints = [np.repeat(np.arange(len(part)), BANDS)], [np.concatenate(part["bands"].to_numpy())], [np.zeros(len(part) * BANDS, np.int64)]
            for tag, column in enumerate(("p0", "p1")):
                values = part[column].to_numpy(np.int64)
                row, key = simhash.golay_keys(values.view(np.uint64), table)
                rows.append(row)
                keys.append(key | tag << 32)
                prints.append(values[row])
            row, key, value = np.concatenate(rows), np.concatenate(keys), np.concatenate(prints)
            node = number[row]
            order = np.lexsort((node, value, key))
            key, value, node = key[order], value[order], node[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
            head = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            pairs = _star(np.stack([node[~first], head[~first]], 1))
            yield pd.DataFrame({"key": key[first], "print": value[first], "node": node[first], "head": pd.array([None], "Int64").repeat(int(first.sum()))})
            if len(pairs):
                yield pd.DataFrame({"key": -1 - pairs[:, 0], "print": 0, "node": pairs[:, 0], "head": pd.array(pairs[:, 1], "Int64")})


def _star(pairs: np.ndarray) -> np.ndarray:
    """Edges from each node of ``pairs`` to the least that is connected with it: no more edges than nodes."""
    nodes, place = np.unique(pairs, return_inverse=True)
    one, two = place.reshape(-1, 2).T
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before = least.copy()
        low = np.minimum(least[one], least[two])
        for side in (one, two):
            np.minimum.at(least, least[side], low)
            np.minimum.at(least, side, low)
        least = least[least]
    away = least != np.arange(len(nodes))
    return np.stack([nodes[away], nodes[least[away]]], 1)


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) that connect texts which share a band, or a fingerprint's key and all but four of its bits.

    What a task finds leaves it as stars: one edge for each of its texts, however many keys connect them.
    """
    held, size = [np.empty((0, 2), np.int64)], 0

    def rest() -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = batch["head"].notna().to_numpy()
            held.append(batch.loc[done, ["node", "head"]].to_numpy(np.int64))
            yield batch[~done]

    for pairs in simhash._verified(rest(), simhash.MAX_BITS):
        held.append(pairs.to_numpy(np.int64))
        size += len(pairs)
        if size > HELD:
            held[:], size = [_star(np.concatenate(held))], 0
    pairs = _star(np.concatenate(held))
    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _candidates(texts: DataFrame) -> DataFrame:
    """(a, b): edges between texts' numbers that connect all that share a band or are within four bits in a fingerprint."""
    keyed = texts.select("number", "p0", "p1", "bands").mapInPandas(_keyed, "key long, print long, node long, head long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_met, "a long, b long").distinct()


def _join_split(big: DataFrame, small: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """An inner join on ``key`` whose largest key is dealt to ``salts`` tasks; ``small`` holds one row a key."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "_salt"]).drop("_salt")


def _centres(members: DataFrame) -> DataFrame:
    """(cluster, centre): the text that is nearest to the bitwise majority of a cluster's fingerprints."""
    votes = members.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.shiftright(p, i).bitwiseAND(F.lit(1).cast("long"))).alias(f"{p}_{i}") for p in ("p0", "p1") for i in range(64)])
    value = lambda p: sum((F.shiftleft((2 * F.col(f"{p}_{i}") > F.col("n")).cast("long"), i) for i in range(1, 64)), (2 * F.col(f"{p}_0") > F.col("n")).cast("long"))
    middle = votes.select("cluster", value("p0").alias("m0"), value("p1").alias("m1"))
    away = F.bit_count(F.col("p0").bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("p1").bitwiseXOR(F.col("m1")))
    return _join_split(members, middle, "cluster").groupBy("cluster").agg(F.min(F.struct(away.alias("away"), "number")).alias("c")).select("cluster", F.col("c.number").alias("centre"))


class Index:
    """Shingle sets as an inverted index: how many shingles a set has in common with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.values, starts = np.unique(values[order], return_index=True)
        self.starts = np.append(starts, len(values))

    def common(self, one: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, one)
        at = at[at < len(self.values)] if not len(self.values) else np.minimum(at, len(self.values) - 1)
        at = at[self.values[at] == one] if len(self.values) else at[:0]
        sizes = self.starts[at + 1] - self.starts[at]
        spots = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[spots], minlength=len(self.sizes))

    def similar(self, one: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the sets whose similarity to ``one`` is enough; two empty sets are equal."""
        both = self.common(one)
        whole = self.sizes + len(one) - both
        return np.flatnonzero((both / np.maximum(whole, 1) >= similarity) | (whole == 0))


def _compared(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """Links (a, b) between different groups of a cluster within a block, or between two blocks; groups go by their names."""
        group, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("set")]
        names, place = np.unique(group, return_inverse=True)
        root, links = np.arange(len(names)), []
        here = np.flatnonzero(side == side.min())
        there = np.flatnonzero(side == side.max())
        if len(here) > len(there):
            here, there = there, here
        index = Index([sets[i] for i in there])
        for i in here:
            for j in np.unique(place[there[index.similar(sets[i], similarity)]]):
                if (a := root[place[i]]) != (b := root[j]):
                    root[root == max(a, b)] = min(a, b)
                    links.append((int(names[place[i]]), int(names[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _across(open_: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the names of groups of one cluster that are not connected yet.

    ``open_`` holds (cluster, few, many, inside, number, component, set) of clusters with several groups: ``inside`` are
    the members of the largest group, cut into ``many`` blocks, the others into ``few``. Every two blocks that are not
    both of the largest group meet in one task; comparisons stay in the task, which returns links alone.
    """
    hashed = F.xxhash64("number")
    placed = open_.withColumn("block", F.when(F.col("inside"), F.col("few") + F.pmod(hashed, "many")).otherwise(F.pmod(hashed, "few")).cast("int"))
    # The blocks of the rest come first: they meet all blocks, themselves included; those of the largest group meet them alone.
    last = F.when(F.col("inside"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("side", F.col("block"))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return dealt.select("cluster", "low", "high", "side", "component", "set").groupBy("cluster", "low", "high").applyInArrow(_compared(similarity), "a long, b long")


def _labels(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, whole) of ``docs`` with an id, and (whole, group) of each distinct text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = cut(source.select("id", _prints(F.col("text"), size).alias("p")).select("id", "p.*"))
    # Distinct texts are numbered: steps between carry longs, whatever ids are.
    texts = cut(rows.groupBy("whole").agg(F.min("id").alias("id"), F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.first("bands").alias("bands")).withColumn("number", F.monotonically_increasing_id()))
    clusters = connected_components(_candidates(texts))
    members = cut(texts.drop("bands").join(clusters, F.col("number") == F.col("node")).select("id", "whole", "number", "p0", "p1", F.col("component").alias("cluster")))
    chosen = members.select("id", "whole", "number")
    # Rows of one id may have several texts: the digest tells which.
    found = source.join(chosen, "id").select("number", "whole", _shingles(F.col("text"), size).alias("s")).filter(F.col("s.whole") == F.col("whole"))
    sets = cut(found.dropDuplicates(["number"]).select(F.col("number").alias("id"), "s.set"))
    star = _join_split(members, _centres(members), "cluster").filter("number <> centre").select(F.col("number").alias("a"), F.col("centre").alias("b"))
    group = connected_components(_verified(star, sets, similarity))
    held = members.select("id", "number", "cluster").join(group, F.col("number") == F.col("node"), "left").select("id", "cluster", "number", F.coalesce("component", "number").alias("component"))
    held = cut(held.join(sets.select(F.col("id").alias("number"), F.octet_length("set").alias("bytes")), "number"))
    parts = cut(held.groupBy("cluster", "component").agg(F.sum(F.col("bytes") + 64).alias("n"), F.min("id").alias("least")))
    several = parts.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("groups")).filter("groups > 1")
    blocks = lambda n: F.ceil(n / block).cast("long")
    several = several.select("cluster", F.col("top.component").alias("main"), blocks(F.col("top.n")).alias("many"), blocks(F.col("n") - F.col("top.n")).alias("few"))
    open_ = _join_split(held, several, "cluster").withColumn("inside", F.col("component") == F.col("main"))
    more = connected_components(_across(open_.join(sets.withColumnRenamed("id", "number"), "number"), similarity)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    # A group goes by the least id of its texts.
    final = parts.join(more, "component", "left").select("component", "least", F.coalesce("joined", "component").alias("name"))
    named = final.groupBy("name").agg(F.min("least").alias("group"))
    labels = _join_split(held, final.join(named, "name").select("component", "group"), "component").select(F.col("number").alias("_number"), "group")
    return rows.select("id", "whole"), texts.join(labels, F.col("number") == F.col("_number"), "left").select("whole", F.coalesce("group", "id").alias("group"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, group) for each row of ``docs`` with an id: the smallest id of its group of near-duplicates, itself included.

    Null and empty texts are equal texts. Repeated rows stay repeated. Rows without an id are left out.
    """
    rows, labels = _labels(docs, id_col, text_col, size, similarity, block)
    return rows.join(labels, "whole").select(F.col("id").alias(id_col), "group")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of each group; of rows that share it, one.

    Rows without an id stay.
    """
    _, labels = _labels(docs, id_col, text_col, size, similarity, BLOCK)
    heads = cut(labels.select(F.col("group").alias("_head")).distinct())
    kept = docs.join(heads, F.col(id_col) == F.col("_head"), "left_semi")
    repeated = cut(kept.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id"))
    out = kept.unionByName(docs.filter(F.col(id_col).isNull()))
    if not repeated.take(1):
        return out
    again = kept.join(repeated, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col])
    return out.join(repeated, F.col(id_col) == F.col("_id"), "left_anti").unionByName(again)
