"""The programmatic surface."""

import pytest

from docgraph.engine import Documents, Graphs
from docgraph.functions.predicate import Condition, Leaf
from docgraph.functions.update import UpdateSpec
from docgraph.graph.model import EdgeMapping, GraphDefinition, NodeMapping
from docgraph.lang.parser import SemanticFailure
from docgraph.session import Session


def test_surface(spark):
    session = Session(spark, clock=lambda: 77)
    docs, graphs = Documents(session), Graphs(session)
    assert docs.is_healthy()
    docs.create_collection("u", [{"name": "n", "type": "INT64", "required": False, "unique": False}])
    docs.create_collection("f")
    assert docs.insert_many("u", [{"_id": "a", "n": 1}, {"_id": "b", "n": 2}, {"_id": "c", "n": 3, "o": {"x": 1}}]) == ["a", "b", "c"]
    docs.insert_many("f", [{"_id": "1", "s": "a", "t": "b"}, {"_id": "2", "s": "b", "t": "c"}])
    assert docs.find_by_id("u", "a").count() == 1 and docs.get_collection_size("u") == 3
    assert [r._id for r in docs.find_many("u", Condition.or_(Leaf("n", "=", 1), Condition.in_("n", [3])), order_by=["_id"]).collect()] == ["a", "c"]
    assert docs.find_range("u", "b", 5).count() == 1
    assert docs.update_by_id("u", "a", UpdateSpec().inc("n", 10).touch_date("at"))
    assert docs.count("u", Leaf("at", "=", 77)) == 1 and docs.exists("u", Leaf("n", "=", 11))
    assert docs.update_many("u", Leaf("_id", "=", "z"), UpdateSpec(upsert=True).set("n", 5)) == 0
    assert docs.count("u") == 4 and docs.delete_by_id("u", "z") and not docs.delete_by_id("u", "z")
    docs.replace("u", "c", {"n": 9})
    assert docs.find_by_id("u", "c").first().doc.toPython() == {"_id": "c", "n": 9}
    assert docs.lookup_join("f", "u", "s", "_id").count() == 2
    docs.create_index("u", "i", ["n"])
    docs.add_foreign_key("f", "k", "s", "u", "_id")
    assert len(docs.get_indexes("u")) == 1 and docs.get_foreign_keys("f")[0]["ref"] == "u._id"
    assert docs.get_schema("u")[0]["name"] == "n"
    seen = []
    docs.iterate_collection("u", lambda r: seen.append(r._id) or len(seen) < 2)
    assert len(seen) == 2
    tx = docs.begin_transaction()
    docs.insert_one_tx(tx, "u", {"_id": "t"})
    assert docs.find_by_id_tx(tx, "u", "t").count() == 1 and docs.delete_by_id_tx(tx, "u", "a")
    docs.rollback_transaction(tx)
    assert not tx.is_valid() and docs.count("u") == 3
    with pytest.raises(SemanticFailure):
        docs.insert_one_tx(tx, "u", {})
    docs.rename_collection("u", "people")
    assert docs.list_collections() == ["f", "people"]

    graphs.create_graph(GraphDefinition("g", nodes=[NodeMapping("P", "people")]))
    graphs.add_edge_mapping("g", EdgeMapping("E", "f", "s", "t"))
    assert graphs.startup() and graphs.is_ready("g")
    assert graphs.has_edge("g", "a", "b") and not graphs.has_edge("g", "b", "a")
    assert [r.id for r in graphs.neighbors("g", "b", "both").collect()] == ["a", "c"]
    assert graphs.run("AreConnected", "g", user1="a", user2="c")["hops"] == 2
    still = graphs.create_snapshot("g", "s")
    docs.insert_one("f", {"_id": "3", "s": "c", "t": "new"})
    assert still.edge_count() == 2 and graphs.get_stats("g")["active_edges"] == 3
    assert (still.node_count(), still.out_degree("b"), still.in_degree("a"), still.dense_id("b"), still.ext_id(2), still.node_type("a")) == (3, 1, 0, 1, "c", "P")
    assert still.has_node("a") and not still.has_node("q") and still.node_count_by_type() == {"P": 3} and still.edge_count_by_type() == {"E": 2}
    assert still.export_coo()[1].count() == 2 and still.stats()["active_nodes"] == 3
    assert graphs.get_recent_wal_entries("g") and graphs.purge_wal("g") and graphs.list_graphs() == ["g", "s"]
    assert graphs.render_graph("g") and graphs.compact_graph("g") and graphs.drop_graph("g")
    graphs.shutdown()
