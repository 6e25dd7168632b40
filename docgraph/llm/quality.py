"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities."""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docgraph.plans.durable import cut

#: Labelled rows that the model learns from at most; they are the first in the order of a hash of their ids.
SAMPLE = 12_000
#: Rows of the table of word vectors; units share rows by hash, so the table never grows with the corpus.
ROWS = 1 << 14
DIM = 48
#: Non-zero places of an index vector, half of them negative.
PLACES = 6
#: Units on either side that count as context.
SPAN = 2
HIDDEN = 24
#: Steps of training and rows of each, whatever the number of rows.
STEPS, BATCH = 1200, 256
#: Fewer labels than this cannot be split into a part that trains and one that calibrates.
LEAST = 10
THRESHOLD = 0.3
#: Units of a text that are looked at together.
PIECE = 1 << 16
#: Partial sums of the table that reach the driver, each ``ROWS * DIM`` 32-bit integers.
PARTIALS = 8
REMEMBERED = 300_000

_UNIT = re.compile(r"\w+|[^\w\s]+")
#: Rows for what the spelling shows besides the unit itself.
UPPER, CAPITAL, LOWER, DIGITS, MARKS, AGAIN, SHAPES = 0, 1, 2, 3, 4, 5, 6


def _shape(unit: str) -> int:
    if not (unit[0].isalnum() or unit[0] == "_"):
        return MARKS
    if unit.isdigit():
        return DIGITS
    if unit.isupper() and len(unit) > 1:
        return UPPER
    return CAPITAL if unit[0].isupper() else LOWER


class Units:
    """Turns texts into rows of the table and remembers units."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of each unit, shape row of each unit); a unit that repeats the one before it has the shape AGAIN."""
        units, known = _UNIT.findall(text or ""), self.known
        for u in set(units):
            if u not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                    return self(text)
                known[u] = SHAPES + xxhash.xxh32_intdigest(u.lower().encode()) % (ROWS - SHAPES), _shape(u)
        pairs = np.array([known[u] for u in units], np.int32).reshape(-1, 2)
        rows, shapes = pairs[:, 0], pairs[:, 1].copy()
        shapes[1:][rows[1:] == rows[:-1]] = AGAIN
        return rows, shapes


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse ternary vector for each row of the table."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), np.int32)
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :PLACES]
    np.put_along_axis(out, places, np.tile(np.array([1, -1] * (PLACES // 2), np.int32), (ROWS, 1)), axis=1)
    return out


def add_contexts(table: np.ndarray, index: np.ndarray, rows: np.ndarray, shapes: np.ndarray) -> None:
    """Adds to each unit's row the index vectors of the units and shapes around it."""
    for at in range(0, len(rows), PIECE):
        r, s = rows[at : at + PIECE + SPAN], shapes[at : at + PIECE + SPAN]
        own = index[r] + index[s]
        around = np.zeros_like(own)
        for shift in range(1, SPAN + 1):
            around[:-shift] += own[shift:]
            around[shift:] += own[:-shift]
        _add_rows(table, r, around)
        _add_rows(table, s, index[r])


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] += values`` where rows repeat."""
    order = np.argsort(rows, kind="stable")
    which, starts = np.unique(rows[order], return_index=True)
    table[which] += np.add.reduceat(values[order], starts, axis=0)


def pool(vectors: np.ndarray, rows: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The mean vector of the units, the shares of the shapes, and the logarithm of the number of units."""
    total, count = np.zeros(DIM), max(1, len(rows))
    for at in range(0, len(rows), PIECE):
        total += np.bincount(rows[at : at + PIECE], minlength=len(vectors))[None, :].astype(np.float32)[0] @ vectors if len(rows) > 4096 else vectors[rows[at : at + PIECE]].sum(axis=0)
    share = np.bincount(shapes, minlength=SHAPES)[:SHAPES] / count
    mean_shape = share @ vectors[:SHAPES]
    return np.concatenate([total / count, mean_shape, share, [np.log1p(len(rows)) / 10]])


FEATURES = 2 * DIM + SHAPES + 1


@dataclass
class Model:
    """Word vectors, a scaling of features, two layers, and the temperature that calibrates the last one."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def fit_network(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 7) -> Model:
    """Two layers trained by Adam on four fifths of the rows; the rest sets the temperature (least log loss).

    Without labels of both kinds, or with fewer than ``LEAST`` labels, the score is the share of label 1 (one half
    without any label).
    """
    mean, scale = (features.mean(axis=0), features.std(axis=0) + 1e-3) if len(features) else (np.zeros(FEATURES), np.ones(FEATURES))
    rng = np.random.default_rng(seed)
    model = Model(vectors, mean, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.b2 = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2 or len(labels) < LEAST:
        return model
    order = rng.permutation(len(labels))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    x, y = (features[train] - mean) / scale, labels[train].astype(float)
    model.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    params = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    shuffled = np.empty(0, np.int64)
    while step < STEPS:
        if not len(shuffled):
            shuffled = rng.permutation(len(y))
        b, shuffled = shuffled[:BATCH], shuffled[BATCH:]
        hidden = np.tanh(x[b] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
        off = (p - y[b]) / len(b)
        back = np.outer(off, params[2]) * (1 - hidden**2)
        grads = [x[b].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ off + 1e-4 * params[2], np.array([off.sum()])]
        step += 1
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = model.logits(features[held]), labels[held].astype(float)
    tried = np.geomspace(0.25, 8, 61)
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    return model


def held_out(id_column: Column) -> Column:
    """The fifth of the ids that nothing is learnt from; a null id is not of them."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learns word vectors and network from at most ``sample`` labelled rows outside the held-out fifth.

    Rows without id or label are not used; an id with several labels counts once, with its least label. The driver gets
    ``PARTIALS`` integer tables and one feature vector per sampled row, both of bounded size, never texts.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(~held_out(F.col("id")))
    chosen = usable.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(texts.join(F.broadcast(cut(chosen)), "id").select("id", "label", "text").repartition(PARTIALS * 2, "id"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, units, table = index_vectors(seed), Units(), np.zeros((ROWS, DIM), np.int32)
        for batch in batches:
            for text in batch["text"]:
                add_contexts(table, index, *units(text))
        yield pd.DataFrame({"table": [zlib.compress(table.tobytes(), 1)]})

    table = np.zeros((ROWS, DIM), np.int64)
    for part in rows.coalesce(PARTIALS).mapInPandas(contexts, "table binary").collect():
        table += np.frombuffer(zlib.decompress(part[0]), np.int32).reshape(ROWS, DIM)
    vectors = (table + index_vectors(seed)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype(str), "label": batch["label"], "features": [pool(vectors, *units(t)).astype(np.float32).tobytes() for t in batch["text"]]})

    got = sorted((tuple(r) for r in rows.mapInPandas(pooled, "id string, label int, features binary").collect()), key=lambda r: (r[0], bytes(r[2])))
    features = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float64).reshape(-1, FEATURES)
    return fit_network(features, np.array([r[1] for r in got], int), vectors, seed)


def score(model: Model, text: Column) -> Column:
    """The probability of label 1 for a text; null texts are empty."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = Units()
        for batch in texts:
            rows = [pool(model.vectors, *units(t)) for t in batch]
            yield pd.Series(model.scores(np.array(rows).reshape(-1, FEATURES)))

    return scores(text)


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= ``threshold``), one row for each row; columns of these names are replaced."""
    return docs.withColumn("score", score(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
