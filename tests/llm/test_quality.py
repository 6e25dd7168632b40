"""The score against a plain version of vectors, pooling and network, and what it owes to the vectors."""

import re
import zlib

import numpy as np
import pytest
import xxhash

from docgraph.llm import quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in texts}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    return texts, labels, held


def plain_units(text):
    units = re.findall(r"\w+|[^\w\s]+", text or "")
    rows = [quality.SHAPES + xxhash.xxh32_intdigest(u.lower().encode()) % (quality.ROWS - quality.SHAPES) for u in units]
    return rows, [quality.AGAIN if k and rows[k] == rows[k - 1] else quality._shape(u) for k, u in enumerate(units)]


def test_against_plain(spark, data):
    """Scores of the query, from sums written out unit by unit."""
    texts, labels, held = data
    index = quality.index_vectors()
    table = index.astype(np.int64).copy()
    chosen = {i: q for i, q in labels.items() if i not in held}
    for i in chosen:
        rows, shapes = plain_units(texts[i])
        for k in range(len(rows)):
            for j in range(max(0, k - quality.SPAN), min(len(rows), k + quality.SPAN + 1)):
                if j != k:
                    table[rows[k]] += index[rows[j]] + index[shapes[j]]
            table[shapes[k]] += index[rows[k]]
    vectors = table.astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6

    def features(text):
        rows, shapes = plain_units(text)
        n = max(1, len(rows))
        share = np.array([shapes.count(s) for s in range(quality.SHAPES)]) / n
        mean = sum((vectors[r].astype(float) for r in rows), np.zeros(quality.DIM)) / n
        return np.concatenate([mean, share @ vectors[: quality.SHAPES], share, [np.log1p(len(rows)) / 10]])

    order = sorted(chosen, key=str)
    # The operator keeps features of labelled rows as 32-bit floats.
    learnt = np.array([features(texts[i]) for i in order]).astype(np.float32).astype(float)
    model = quality.fit_network(learnt, np.array([chosen[i] for i in order]), vectors)
    got = {r.doc_id: (r.held_out, r.score) for r in queries.op10_quality(spark, SF).collect()}
    assert {i for i, (h, _) in got.items() if h} == held
    for i, t in texts.items():
        z = (np.tanh((features(t) - model.mean) / model.scale @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature
        assert got[i][1] == pytest.approx(1 / (1 + np.exp(-z)), abs=0.02), i


def test_vectors_carry_the_score(spark, data):
    """With the vectors' part alone, shape shares and length blanked, held-out labels are told apart as well."""
    texts, labels, held = data
    model = quality.train(queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    units = quality.Units()
    ids = sorted(labels)
    whole = np.array([quality.pool(model.vectors, *units(texts[i])) for i in ids])
    truth, out = np.array([labels[i] for i in ids]), np.array([i in held for i in ids])
    hits = {}
    for name, kept in (("all", slice(None)), ("words", slice(0, quality.DIM)), ("vectors", slice(0, 2 * quality.DIM))):
        part = np.zeros_like(whole)
        part[:, kept] = whole[:, kept]
        fitted = quality.fit_network(part[~out], truth[~out], model.vectors)
        hits[name] = float(((fitted.scores(part[out]) >= 0.5) == truth[out]).mean())
    assert min(hits.values()) >= 0.85, hits


def test_null_ids_and_few_labels(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c d")], "doc_id long, text string")
    rows = docs.select("doc_id", quality.held_out(docs["doc_id"]).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {None: False, 1: zlib.crc32(b"1") % 5 == 0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(quality.LEAST - 1)], "doc_id long, quality int")
    few = spark.createDataFrame([(i, f"text {i}") for i in range(quality.LEAST - 1)], "doc_id long, text string")
    model = quality.train(few, labels)
    assert len({round(r.score, 9) for r in quality.classify(few, model).collect()}) == 1
