"""SimHash fingerprints and near-duplicate links found with the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to the 23 bits of the perfect
Golay code. If two fingerprints differ in at most four bits, some two of the three segments differ in at most two bits
together. Between them lies a word that differs from either in at most one bit. Each fingerprint therefore decodes its
two segments, and all words one bit away from them, to codeword indices (about ten distinct pairs of 12 bits); a pair
of fingerprints within four bits shares at least one such key. Keys are joined and every candidate is verified.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docgraph.plans.components import connected_components
from docgraph.plans.durable import cut

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Members of one key that are compared in one task (24 bytes each); larger keys take the way of shared neighbours.
BUCKET = 1 << 20
#: Runs up to this length are compared by shifts, longer ones by breadth-first search.
SHORT_RUN = 24
#: Longer runs are cut into smaller ones by parts of the fingerprint before that.
LONG_RUN = 512
#: The generator of the binary Golay code (23, 12), as a polynomial over GF(2).
GENERATOR = 0b110001110101


def golay_table() -> np.ndarray:
    """For each 23-bit word the index of the only codeword within three bits."""
    index = np.arange(4096, dtype=np.uint32)
    rest = index << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    words = (index << 11) | rest
    ones = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), ones]
    i, j = np.triu_indices(23, 1)
    errors.append(ones[i] | ones[j])
    errors.append(np.array([ones[x] | ones[y] | ones[z] for x in range(23) for y in range(x) for z in range(y)], np.uint32))
    table = np.empty(1 << 23, np.uint16)
    table[(words[:, None] ^ np.concatenate(errors)[None, :]).ravel()] = np.repeat(index.astype(np.uint16), 2048)
    return table


def golay_keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each distinct key of each fingerprint."""
    prints = prints.astype(np.uint64)
    exact, near = [], []
    for start, width in SEGMENTS:
        part = ((prints >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        exact.append(table[part].astype(np.int64))
        near.append(table[part[:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))].astype(np.int64))
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        found = np.hstack([(exact[i] << 12 | exact[j])[:, None], near[i] << 12 | exact[j][:, None], exact[i][:, None] << 12 | near[j]])
        found.sort(axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append(found[row, col] | pair << 24)
    return np.concatenate(rows), np.concatenate(keys)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by a space (all words if there are fewer, none if there is none)."""
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def fingerprint(text: Column, size: int = 4, seed: int = 42) -> Column:
    """SimHash over shingles of ``size`` words, repeats included, as a long; null and wordless texts give zero."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([majority(shingle_hashes(words_of(t), size, seed)) for t in batch], dtype="int64")

    return prints(text)


def _forest(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever is linked within ``most`` bits: a forest, found by breadth-first search in blocks."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            source = np.zeros(len(left), np.int64)
            for node in front:
                fresh = (np.bitwise_count(prints[left] ^ prints[node]) <= most) & ~reached
                source[fresh], reached = node, reached | fresh
                if reached.all():
                    break
            a.append(source[reached])
            b.append(left[reached])
            front, left = left[reached], left[~reached]
    return np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])


def _short_runs(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all links among runs of equal sorted keys that are at most ``SHORT_RUN`` long."""
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for shift in range(1, min(SHORT_RUN, len(keys))):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + shift]) <= most]
        one.append(near)
        two.append(near + shift)
    return np.concatenate(one), np.concatenate(two)


def _edges(keys: np.ndarray, prints: np.ndarray, most: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): edges that connect what is linked among rows of equal sorted keys.

    Runs over ``LONG_RUN`` are keyed again by each of five parts of the fingerprint: of five parts one has none of the
    four differing bits. ``whole`` tells that the keys are such parts.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    at = np.flatnonzero(np.repeat(sizes <= SHORT_RUN, sizes))
    i, j = _short_runs(keys[at], prints[at], most)
    one, two = [at[i]], [at[j]]
    for start, size in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        run = prints[start : start + size]
        if whole or size <= LONG_RUN:
            i, j = _forest(run, most)
            one.append(i + start)
            two.append(j + start)
            continue
        for first in range(0, 64, 13):
            part = (run >> np.uint64(first)) & np.uint64((1 << 13) - 1)
            order = np.argsort(part, kind="stable")
            i, j = _edges(part[order], run[order], most, True)
            one.append(order[i] + start)
            two.append(order[j] + start)
    return np.concatenate(one), np.concatenate(two)


def _verified(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Links among rows (key, print, node) of equal key; rows come sorted by key, and a key may go on in the next batch."""
    for keys, prints, nodes in _runs(batches):
        i, j = _edges(keys, prints, most)
        if len(i):
            pairs = np.unique(np.sort(np.stack([nodes[i], nodes[j]], 1), axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, fingerprints, nodes) in pieces that hold whole runs of equal keys."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        keys, prints, nodes = batch["key"].to_numpy(np.int64), batch["print"].to_numpy(np.int64).view(np.uint64), batch["node"].to_numpy(np.int64)
        last = np.searchsorted(keys, keys[-1])
        if last or (held and held[-1][0][-1] != keys[0]):
            yield tuple(np.concatenate(x) for x in zip(*held, (keys[:last], prints[:last], nodes[:last]), strict=True))
            held = []
        held.append((keys[last:], prints[last:], nodes[last:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = golay_table()
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            prints = batch["print"].to_numpy(np.int64)[at : at + 20_000]
            rows, keys = golay_keys(prints.view(np.uint64), table)
            yield pd.DataFrame({"key": keys, "print": prints[rows], "node": prints[rows]})


def links(prints: DataFrame, most: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges between the distinct values of ``prints(print long)`` within ``most`` (four at most) differing bits.

    Whatever is connected by links is connected by the edges; inside a large key only a spanning forest is kept, so
    that a group of n values gives about n edges for each key. Keys with over ``bucket`` members link their members
    through the values within half of ``most`` bits of each instead, which takes no comparison of pairs and is exact too.
    Nulls are ignored; no rows give no rows.
    """
    if not 0 <= most <= MAX_BITS:
        raise ValueError(f"the keys hold for at most {MAX_BITS} bits")
    keyed = prints.select("print").filter("print is not null").distinct().mapInPandas(_keyed, "key long, print long, node long")
    crowded = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"))
    busy = bool(crowded.take(1))
    quiet = keyed.join(crowded, "key", "left_anti") if busy else keyed
    near = quiet.repartition("key").sortWithinPartitions("key")
    found = near.mapInPandas(lambda batches: _verified(batches, most), "a long, b long")
    if busy:
        found = found.union(_through_neighbours(keyed.join(crowded, "key", "left_semi").select("print").distinct(), most))
    return found.distinct()


def _through_neighbours(prints: DataFrame, most: int) -> DataFrame:
    """Edges between values that have a common neighbour: within half of ``most`` bits of one and the rest of the other.

    Every value writes down its neighbours; the least value near each spot heads all that are near it.
    """
    near, far = most // 2, most - most // 2
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips if f.bit_count() <= far]
    around = prints.select("print", F.explode(F.array(*[F.lit(f).cast("long") for f in signed])).alias("flip"))
    around = around.select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("spot"), F.bit_count("flip").alias("bits"))
    heads = around.filter(F.col("bits") <= near).groupBy("spot").agg(F.min("print").alias("head"))
    return around.join(heads, "spot").filter("print <> head").select(F.greatest("print", "head").alias("a"), F.least("print", "head").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, most: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``; other columns are not read.

    fingerprint: 16 hex digits; component_id: the smallest id that is reachable over links of at most ``most``
    differing bits. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay
    repeated. A null id is never a component's id unless no member has another. An empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size, seed).alias("print")))
    # A fingerprint goes by its least id (nulls last), so that the least of a component names it.
    least = rows.groupBy("print").agg(F.min("id").alias("least"))
    named = cut(least.select("print", F.struct(F.col("least").isNull().alias("none"), "least", "print").alias("name")))
    found = links(named.select("print"), most)
    edges = found.join(named.select(F.col("print").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("print").alias("b"), F.col("name").alias("y")), "b")
    root = connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    linked = root.select(F.col("node.print").alias("print"), F.col("component.least").alias("other"), F.lit(True).alias("found"))
    labels = named.join(linked, "print", "left").select("print", F.when(F.col("found"), F.col("other")).otherwise(F.col("name.least")).alias("component_id"))
    return rows.join(labels, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
