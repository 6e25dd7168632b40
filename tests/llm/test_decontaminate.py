"""Alignments of items with texts that have other words, other names or other numbers of words."""

import random

import numpy as np
import pytest

from docgraph.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def found(spark, docs, items):
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_names_of_several_words(spark):
    items = [(1, "On market day Tom, Sue, Bob carried apples to town and then Tom sold half of the apples to Sue before the rain came down.")]
    docs = [
        (1, "Here: On market day Mary Ann, Jo Lee, Al Ray carried apples to town and then Mary Ann sold half of the apples to Jo Lee before the rain came down. So."),
        (2, "Here: On market day Mary Ann carried apples. Something else happened on the way and nobody ever sold a thing."),
        (3, "on market day tom, sue, bob carried apples to town and then tom sold half of the apples to sue before the rain came down."),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (3, 1)} and not got[1, 1].verbatim and got[3, 1].verbatim
    assert (got[3, 1].first_token, got[3, 1].last_token) == (0, 24)


@pytest.mark.parametrize("kind", ["insert", "drop", "replace"])
def test_changed_words(spark, kind):
    """An item with three changes, evenly spread, is found; texts of the same words in another order are not."""
    rng = random.Random(6)
    items, docs = [], []
    for k in range(30):
        words = [f"w{rng.randrange(400)}x" for _ in range(rng.randrange(28, 60))]
        items.append((k, " ".join(words)))
        changed = list(words)
        for c in (3, 2, 1):
            at = c * len(words) // 4
            changed[at : at + (kind != "insert")] = [] if kind == "drop" else ["other"]
        docs.append((k, "some words before it " + " ".join(changed) + " and some after"))
        docs.append((100 + k, " ".join(rng.sample(words, len(words)))))
    got = found(spark, docs, items)
    assert set(got) == {(k, k) for k in range(30)} and not any(r.verbatim for r in got.values())


def test_alignment_against_plain():
    """The score of the pairs is the best of a table filled cell by cell."""
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        sides = []
        for x in (a, b):
            codes = np.array([ord(c) for c in x], np.uint64)
            sides.append(decontaminate._Side(codes, x, codes, np.zeros(len(x), int), np.arange(len(x))))
        gap = decontaminate.GAP
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = max(0.0, table[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2 * gap), table[i - 1][j] - gap, table[i][j - 1] - gap)
        pairs = decontaminate.align(*sides)
        score = len(pairs) - gap * sum(i2 - i - 1 + j2 - j - 1 for (i, j), (i2, j2) in zip(pairs, pairs[1:]))
        assert score == pytest.approx(max(map(max, table)))
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_texts_together_or_alone(spark):
    """What is found in a text does not depend on the texts around it; windows do not cross from one to the next."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in queries.documents(spark, SF).orderBy("doc_id").collect()][:300] + [None, "", items[0][1][: len(items[0][1]) // 3], items[0][1][len(items[0][1]) // 3 :], "a\x1eb " + items[1][1]]
    templates = decontaminate.Templates(items)
    whole = list(templates.search(templates.canon(), texts))
    single = [(k, *f[1:]) for k, t in enumerate(texts) for f in templates.search(templates.canon(), [t])]
    assert whole == single and any(k == len(texts) - 1 for k, *_ in whole)
