"""Large integers of schemaless collections, and filters that reach the scan."""

import pytest
from pyspark.sql import functions as F

from docgraph.functions.predicate import And, Leaf, Nor, Not, Or
from docgraph.functions.update import UpdateSpec
from docgraph.operators import documents

BIG = 1 << 53


@pytest.fixture(scope="module")
def numbers(spark):
    bodies = [("a", f'{{"n": {BIG}}}'), ("b", f'{{"n": {BIG + 1}}}'), ("c", f'{{"n": {BIG + 2}}}'), ("d", '{"n": 2.5}'), ("e", '{"n": "7"}'), ("f", '{"n": true}'), ("g", "{}"), ("h", '{"n": -3}'), ("i", '{"n": 9223372036854775807}')]
    return spark.createDataFrame(bodies, "_id string, body string").select("_id", F.parse_json("body").alias("doc"))


def ids(df):
    return "".join(sorted(r._id for r in df.collect()))


@pytest.mark.parametrize(
    ("leaf", "want"),
    [
        (Leaf("n", "=", BIG + 1), "b"), (Leaf("n", "!=", BIG + 1), "acdefhi"), (Leaf("n", ">", BIG), "bci"), (Leaf("n", "<=", BIG + 1), "abdeh"), (Leaf("n", "in", [BIG + 1, 7]), "be"), (Leaf("n", "not in", [BIG + 1, 7]), "acdfhi"),
        (Leaf("n", ">=", 2.5), "abcdei"), (Leaf("n", "=", 2.5), "d"), (Leaf("n", "<", 0), "h"), (Leaf("n", "=", float(BIG)), "a"), (Leaf("n", "=", (1 << 63) - 1), "i"), (Leaf("n", "=", True), "f"), (Not(Leaf("n", "=", BIG + 1)), "acdefghi"),
    ],
)
def test_comparisons(numbers, leaf, want):
    assert ids(documents.scan(numbers, leaf)) == want


def test_updates(numbers):
    def after(spec):
        out = documents.update(numbers, Leaf("n", "exists"), spec.operations)
        return {r._id: r.n for r in out.select("_id", F.to_json(F.try_variant_get("doc", "$.n", "variant")).alias("n")).collect()}

    added = after(UpdateSpec().inc("n", 2))
    assert (added["a"], added["b"], added["d"], added["e"], added["h"]) == (str(BIG + 2), str(BIG + 3), "4.5", "2", "-1")
    assert float(added["i"]) == 9223372036854775809.0
    tripled = after(UpdateSpec().mul("n", 3))
    assert (tripled["b"], tripled["d"], tripled["h"]) == (str(3 * BIG + 3), "7.5", "-9")
    assert after(UpdateSpec().min("n", BIG + 1))["c"] == str(BIG + 1) and after(UpdateSpec().max("n", BIG + 1))["a"] == str(BIG + 1)


def test_or_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    either = Or((Leaf("o_totalprice", "<", 5), And((Leaf("o_orderstatus", "=", "F"), Leaf("o_custkey", ">", 3)))))
    plan = lambda c: documents.scan(orders, c)._jdf.queryExecution().executedPlan().toString()
    pushed = plan(either).split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "LessThan(o_totalprice,5" in pushed and "EqualTo(o_orderstatus,F)" in pushed
    assert documents.scan(orders, Or(())).count() == 0
    with_nulls = spark.createDataFrame([(1, None, 2), (2, 1, None), (3, None, None), (4, 5, 6)], "_id long, x int, y int")
    either = Or((Leaf("x", "=", 1), Leaf("y", ">", 1)))
    for condition, want in ((either, [1, 2, 4]), (Not(either), [3]), (Nor(either.parts), [3]), (And((either, Not(Leaf("x", "=", 5)))), [1, 2]), (Not(Not(either)), [1, 2, 4])):
        assert sorted(r._id for r in documents.scan(with_nulls, condition).collect()) == want
