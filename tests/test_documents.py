"""Predicates and updates against plain python, for random documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docgraph.functions.predicate import And, Leaf, Nor, Not, Or, matches
from docgraph.functions.update import UpdateSpec, apply_to
from docgraph.operators import documents
from docgraph.sources import collections

DOCS = [
    {"_id": "0"}, {"_id": "1", "n": 1, "s": "abc", "b": True, "o": {"x": 5}}, {"_id": "2", "n": 2.5, "s": "", "b": False, "o": {"x": "abc"}},
    {"_id": "3", "n": None, "s": "nancy", "o": {}}, {"_id": "4", "n": "28", "s": "2024-01-05", "a": ["abc", "d"]}, {"_id": "5", "n": -3, "s": "ABC", "o": {"x": None}, "a": []},
    {"_id": "6", "s": "inf", "o": "scalar", "a": ["abc"]},
]


def collection(spark, docs=DOCS):
    return spark.createDataFrame([(d["_id"], json.dumps(d)) for d in docs], "_id string, body string").select("_id", F.parse_json("body").alias("doc"))


paths = st.sampled_from(["n", "s", "b", "o.x", "a", "none", "o.x.y"])
values = st.one_of(st.sampled_from([1, 2.5, -3, 28, 0]), st.sampled_from(["abc", "a", "", "28", "2024"]), st.booleans())
leaves = st.one_of(
    st.builds(Leaf, paths, st.sampled_from(["=", "!="]), values), st.builds(Leaf, st.sampled_from(["n", "o.x"]), st.sampled_from([">", ">=", "<", "<="]), st.sampled_from([1, 2.5, -3])),
    st.builds(Leaf, st.sampled_from(["s"]), st.sampled_from([">", ">=", "<", "<="]), st.sampled_from(["abc", "b", ""])),
    st.builds(Leaf, paths, st.sampled_from(["exists", "not exists"])), st.builds(Leaf, st.just("s"), st.sampled_from(["like", "starts with", "contains"]), st.sampled_from(["a", "abc", "n"])),
    st.builds(Leaf, st.sampled_from(["n", "s", "none"]), st.sampled_from(["in", "not in"]), st.one_of(st.lists(st.sampled_from([1, 2.5, 7]), min_size=1, max_size=3), st.lists(st.sampled_from(["abc", ""]), min_size=1, max_size=2))),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(Not, t), *[st.builds(k, st.tuples(t, t)) for k in (And, Or, Nor)]), max_leaves=5)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree=trees)
def test_predicates(spark, tree):
    got = sorted(r._id for r in documents.scan(collection(spark), tree).collect())
    assert got == [d["_id"] for d in DOCS if matches(tree, d)]


def test_updates(spark):
    spec = UpdateSpec().set("o.x", 9).inc("n", 2).unset("b").push("a", "z").add_to_set("a", "d").add_to_set("a", "d").pull("a", "abc").mul("m", 4).min("low", 3).max("n", 4).rename("s", "t").touch_date("at").pop("a", -1).push_all("l", [1, 2]).pull_all("l", [2])
    got = {r._id: r.doc.toPython() for r in documents.update(collection(spark, DOCS[:6]), None, spec.operations, F.lit(5).cast("long")).collect()}
    for d in DOCS[:6]:
        if d["_id"] != "2":
            assert got[d["_id"]] == apply_to(d, spec.operations, 5), d
    untouched = documents.update(collection(spark), Leaf("_id", "=", "none"), spec.operations)
    assert {r._id: r.doc.toPython() for r in untouched.collect()} == {d["_id"]: d for d in DOCS}


def test_typed(spark):
    df = spark.createDataFrame([("a", 1, ["x"], (1, "q")), ("b", None, None, None)], "_id string, n long, tags array<string>, o struct<k:long,t:string>")
    spec = UpdateSpec().inc("n", 2).push("tags", "y").add_to_set("tags", "y").set("o.t", "r").set("new", 1.5).unset("missing")
    rows = {r._id: r for r in documents.update(df, Leaf("_id", "=", "a"), spec.operations).collect()}
    assert (rows["a"].n, rows["a"].tags, rows["a"].o.t, rows["a"].new) == (3, ["x", "y"], "r", 1.5)
    assert (rows["b"].n, rows["b"].tags, rows["b"].new) == (None, None, None)
    assert [r._id for r in documents.scan(df, Leaf("tags", "contains", "x")).collect()] == ["a"]
    assert [r._id for r in documents.scan(df, Leaf("n", "=", None)).collect()] == ["b"]
    with pytest.raises(ValueError):
        documents.update(df, None, UpdateSpec().set("_id", "z").operations)


def test_lookup_edges(spark):
    left = spark.createDataFrame([("1", "a"), ("2", None), ("3", "zz")], "_id string, k string")
    right = spark.createDataFrame([("r2", "a"), ("r1", "a"), ("r3", None)], "_id string, k string")
    assert [(r._id, r["__joined__"]._id) for r in documents.lookup_join(left, right, "k", "k").collect()] == [("1", "r1")]
    both = {r._id: [x._id for x in r["__joined__"] or []] for r in documents.lookup_join(left, right, "k", "k", how="left", many=True).collect()}
    assert both == {"1": ["r1", "r2"], "2": [], "3": []}


def test_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"_id":"1","a":{"b":2}}\nbroken\n{"c":3}\n')
    df = collections.read_json(spark, str(tmp_path / "in.json"))
    assert df.count() == 2
    collections.write_json(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"_id":"1","a":{"b":2}}', '{"c":3}']
    typed = spark.createDataFrame([(1, "x")], "id long, v string")
    assert collections.to_schemaless(typed, "id").first().doc.toPython() == {"id": 1, "v": "x"}


def test_stream(spark, tmp_path):
    from docgraph.streaming.live import append_stream

    spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
