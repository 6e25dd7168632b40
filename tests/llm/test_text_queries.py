"""The queries over the whole small tables against plain versions."""

import duckdb
import pytest

import brute
import public_tokenizers
from docgraph.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def test_simhash(spark, docs):
    assert rows(queries.op2_simhash(spark, SF), "fingerprint", "component_id") == brute.simhash(docs)


def test_mixing(spark, docs):
    got = queries.op3_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in queries.documents(spark, SF).collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in docs}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    target, taken = brute.mixing_targets(total), dict.fromkeys(total, 0)
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert abs(r.target - target[source[r.doc_id]]) < 1e-5
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 50 for s in total)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in queries.op3_mixing(spark, SF).collect()}


def test_substrings(spark, docs):
    assert rows(queries.op4_substrings(spark, SF), "n_words", "n_removed", "kept_sha256") == brute.substrings(docs)


def test_tokenids(spark, docs):
    from tokenizers import Tokenizer

    want = brute.tokens(docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert rows(queries.op5_tokenids(spark, SF), "start", "n_tokens", "ids_crc32") == want


def test_licences(spark, docs):
    got = rows(queries.op6_licences(spark, SF), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {i: v[:5] for i, v in got.items()} == brute.licence_base(docs)
    texts = dict(docs)
    for i, v in got.items():
        labels = set(v[5].split(",")) - {""}
        assert labels >= set(v[4].split(",")) - {""} and 0 <= v[6] <= 1
        assert ("cc-by-nc-4.0" in labels) == ("CC BY-NC 4.0" in texts[i])
        assert ("apache-2.0" in labels) == ("Apache License, Version 2.0" in texts[i])
        assert ("gpl-3.0" in labels) == ("GNU General Public License, version 3" in texts[i])


def test_decontaminate(spark, docs):
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, k) for i, t in docs for k, x in items if x in " ".join(t.split())}
    got = queries.op7_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= want
    assert {(r.doc_id, r.item_id) for r in got if r.verbatim} == want


def test_sharding(spark, docs):
    got = queries.op8_sharding(spark, SF).collect()
    assert {r.doc_id: (r.shard_id, r.shard_bytes, r.shard_docs) for r in got} == brute.shards(docs, 1 << 20)


def test_media(spark, docs):
    got = rows(queries.op9_media(spark, SF), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert got == {i: brute.media(t) for i, t in docs}


def test_quality(spark):
    got = rows(queries.op10_quality(spark, SF), "held_out", "score", "predicted")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i][2], q) for i, q in truth.items() if got[i][0]]
    assert sum(p == q for p, q in held) >= 0.85 * len(held)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in got.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.fetchall()))
