"""Each stage against a plain version, on what the stage before it kept."""

import pytest

import brute
import corpus_pipeline
from docgraph.llm import quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = queries.documents(spark, SF)
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for name in ("quality", "near_duplicates", "decontamination", "mixing"):
        assert stages[name].columns == stages["input"].columns


def test_quality(spark, stages):
    before, after = dict(texts(stages["input"])), dict(texts(stages["quality"]))
    assert set(after.items()) <= set(before.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before]
    bad = [i for i, q in labels.items() if q == 0 and i in before]
    assert sum(i in after for i in good) >= 0.95 * len(good)
    assert sum(i not in after for i in bad) >= 0.5 * len(bad)
    assert quality.THRESHOLD == 0.3


def test_near_duplicates(stages):
    before, after = texts(stages["quality"]), dict(texts(stages["near_duplicates"]))
    group = brute.near_groups(before)
    want = set(group.values())
    assert set(after) == want
    exact = {}
    for i, t in before:
        exact.setdefault(t, []).append(i)
    assert all(sum(i in after for i in ids) <= 1 for ids in exact.values())


def test_decontamination(spark, stages):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages["near_duplicates"]), dict(texts(stages["decontamination"]))
    leaked = {i for i, t in before if any(x in " ".join(t.split()) for x in items)}
    gone = {i for i, _ in before} - set(after)
    assert leaked <= gone and len(gone - leaked) <= 2


def test_mixing(stages):
    before, after = stages["decontamination"].collect(), stages["mixing"].collect()
    size = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in before}
    source = {r.doc_id: r.source for r in before}
    total, taken = {}, {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    target = brute.mixing_targets(total)
    assert all(abs(taken.get(s, 0) - t) <= 0.02 * t + 50 for s, t in target.items())
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3


def test_tokens(stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    lengths, at = {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(stages["mixing"])}, 0
    rows = stages["token_ids"].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts(stages["mixing"]))
    for r in rows:
        assert (r.start, r.n_tokens) == (at, lengths[r.doc_id])
        at += r.n_tokens


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["token_ids"].count()
