"""The programmatic surface: documents, graphs and snapshots as objects over a session.

Reads return DataFrames; changes return what they changed. The same operators serve the language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from docgraph.functions.predicate import And, Leaf
from docgraph.functions.update import UpdateSpec, apply_to
from docgraph.graph import model
from docgraph.graph.model import EdgeMapping, Graph, GraphDefinition, NodeMapping
from docgraph.lang.parser import SemanticFailure, Statement
from docgraph.operators import documents, envelopes, graphs
from docgraph.session import Session


class Transaction:
    """A handle of the session's transaction; changes of any kind take part in it."""

    def __init__(self, session: Session):
        self.session = session
        session.run(Statement("begin_tx"))

    def is_valid(self) -> bool:
        return self.session.before is not None


class Documents:
    """Collections: catalog, constraints, reads, changes, transactions."""

    def __init__(self, session: Session):
        self.session = session

    def _run(self, kind: str, **args) -> dict:
        return self.session.run(Statement(kind, args))

    def _id(self, collection: str, value: Any) -> Leaf:
        return Leaf(self.session._collection(collection).id_col, "=", value)

    def is_healthy(self) -> bool:
        return self._run("system_status")["healthy"]

    # Catalog

    def create_collection(self, name: str, fields: list[dict] | None = None, strict: bool = False) -> dict:
        return self._run("create_collection", name=name, fields=fields or [], strict=strict)

    def drop_collection(self, name: str) -> dict:
        return self._run("drop_collection", name=name)

    def rename_collection(self, name: str, to: str) -> None:
        """References from foreign keys and graph mappings follow."""
        self.session._free(to)
        self.session.collections[to] = self.session._collection(name)
        del self.session.collections[name]
        for c in self.session.collections.values():
            for key in c.foreign_keys.values():
                key["ref_collection"] = to if key["ref_collection"] == name else key["ref_collection"]
        for definition in self.session.definitions.values():
            for mapping in [*definition.nodes, *definition.edges]:
                mapping.collection = to if mapping.collection == name else mapping.collection

    def collection_exists(self, name: str) -> bool:
        return name in self.session.collections

    def list_collections(self) -> list[str]:
        return sorted(self.session.collections)

    def set_schema(self, name: str, fields: list[dict]) -> dict:
        return self._run("alter_collection", name=name, fields=fields)

    def get_schema(self, name: str) -> list[dict]:
        return self._run("describe_collection", name=name).get("schema", [])

    def get_collection_size(self, name: str) -> int:
        return self._run("describe_collection", name=name)["size"]

    def create_index(self, collection: str, name: str, fields: list[str], unique: bool = False) -> dict:
        return self._run("create_index", name=name, collection=collection, fields=fields, unique=unique)

    def drop_index(self, collection: str, name: str) -> dict:
        return self._run("drop_index", name=name, collection=collection)

    def get_indexes(self, collection: str) -> list[dict]:
        return self._run("show_indexes", collection=collection)["indexes"]

    def add_foreign_key(self, collection: str, name: str, field: str, ref_collection: str, ref_field: str) -> dict:
        return self._run("add_fk", name=name, collection=collection, field=field, ref_collection=ref_collection, ref_field=ref_field)

    def drop_foreign_key(self, collection: str, name: str) -> dict:
        return self._run("drop_fk", name=name, collection=collection)

    def get_foreign_keys(self, collection: str) -> list[dict]:
        return self._run("show_fks", collection=collection)["foreign_keys"]

    # Reads

    def find_by_id(self, collection: str, value: Any) -> DataFrame:
        return documents.find_by_id(self.session.collection(collection), value, self.session._collection(collection).id_col)

    def find_many(self, collection: str, condition=None, include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 0, skip: int = 0, order_by: list | None = None) -> DataFrame:
        c = self.session._collection(collection)
        found = documents.scan(c.df, condition, 0 if order_by else limit, 0 if order_by else skip, c.id_col)
        if order_by:
            found = found.orderBy(*order_by)
            found = found.offset(skip) if skip else found
            found = found.limit(limit) if limit else found
        found = documents.exclude(found, exclude) if exclude else found
        return documents.project(found, include, c.id_col)

    def find_range(self, collection: str, prefix: str, most: int) -> DataFrame:
        return documents.id_range(self.session.collection(collection), prefix, most, self.session._collection(collection).id_col)

    def count(self, collection: str, condition=None) -> int:
        return documents.count(self.session.collection(collection), condition).first()[0]

    def exists(self, collection: str, condition=None) -> bool:
        return documents.exists(self.session.collection(collection), condition).first()[0]

    def lookup_join(self, left: str, right: str, left_path: str, right_path: str, condition=None, **options) -> DataFrame:
        one, two = self.session._collection(left), self.session._collection(right)
        return documents.lookup_join(one.df, two.df, left_path, right_path, condition, left_id=one.id_col, right_id=two.id_col, **options)

    def iterate_collection(self, collection: str, callback: Callable[[Any], bool | None] | None = None) -> Iterable:
        """All rows, one partition at a time; with a callback until it returns False."""
        rows = documents.iterate(self.session.collection(collection))
        if callback is None:
            return rows
        seen = []
        for row in rows:
            seen.append(1)
            if callback(row) is False:
                break
        return range(len(seen))

    # Changes

    def insert_one(self, collection: str, doc: dict) -> str:
        return self.insert_many(collection, [doc])[0]

    def insert_many(self, collection: str, docs: list[dict]) -> list[str]:
        with self.session.lock:
            return self.session.insert(collection, docs)

    def replace(self, collection: str, value: Any, doc: dict) -> str:
        """The document of an id, whole; it must exist."""
        if not self.exists(collection, self._id(collection, value)):
            raise SemanticFailure(f"no document '{value}'")
        return self.insert_one(collection, {**doc, "_id": value})

    def update_many(self, collection: str, condition, spec: UpdateSpec) -> int:
        changed = self._run("update", collection=collection, where=condition, operations=spec.operations, many=True)["updated"]
        if not changed and spec.upsert:
            doc: dict = {}
            for leaf in condition.parts if isinstance(condition, And) else [condition]:
                if isinstance(leaf, Leaf) and leaf.op == "=":
                    doc = apply_to(doc, UpdateSpec().set(leaf.path, leaf.value).operations)
            self.insert_one(collection, apply_to(doc, spec.operations, self.session.clock()))
        return changed

    def update_by_id(self, collection: str, value: Any, spec: UpdateSpec) -> bool:
        return self.update_many(collection, self._id(collection, value), spec) > 0

    def delete_many(self, collection: str, condition) -> int:
        return self._run("delete", collection=collection, where=condition)["deleted"]

    def delete_by_id(self, collection: str, value: Any) -> bool:
        return self.delete_many(collection, self._id(collection, value)) > 0

    # Transactions

    def begin_transaction(self) -> Transaction:
        return Transaction(self.session)

    def commit_transaction(self, tx: Transaction) -> dict:
        return self._run("commit_tx")

    def rollback_transaction(self, tx: Transaction) -> dict:
        return self._run("rollback_tx")

    def _in(self, tx: Transaction) -> None:
        if not tx.is_valid():
            raise SemanticFailure("no active transaction")

    def insert_one_tx(self, tx: Transaction, collection: str, doc: dict) -> str:
        self._in(tx)
        return self.insert_one(collection, doc)

    def update_by_id_tx(self, tx: Transaction, collection: str, value: Any, spec: UpdateSpec) -> bool:
        self._in(tx)
        return self.update_by_id(collection, value, spec)

    def delete_by_id_tx(self, tx: Transaction, collection: str, value: Any) -> bool:
        self._in(tx)
        return self.delete_by_id(collection, value)

    def find_by_id_tx(self, tx: Transaction, collection: str, value: Any) -> DataFrame:
        self._in(tx)
        return self.find_by_id(collection, value)


class Graphs:
    """Graphs: definitions, building, reading, algorithms, snapshots. Live graphs follow their collections by themselves."""

    def __init__(self, session: Session):
        self.session = session

    def startup(self) -> bool:
        """Builds every defined graph that is not built."""
        for name in self.session.definitions:
            if name not in self.session.built:
                self.build_graph(name)
        return True

    def shutdown(self) -> None:
        self.session.close()

    def _run(self, kind: str, **args) -> dict:
        return self.session.run(Statement(kind, args))

    def create_graph(self, definition: GraphDefinition) -> bool:
        self._run("create_graph", name=definition.name, mode=definition.mode, directed=definition.directed, heterogeneous=definition.heterogeneous, where=definition.where)
        self.session.definitions[definition.name].nodes += definition.nodes
        self.session.definitions[definition.name].edges += definition.edges
        return True

    def add_node_mapping(self, graph: str, mapping: NodeMapping) -> bool:
        self.session._definition(graph).nodes.append(mapping)
        return True

    def add_edge_mapping(self, graph: str, mapping: EdgeMapping) -> bool:
        self.session._definition(graph).edges.append(mapping)
        return True

    def drop_graph(self, name: str) -> bool:
        return self._run("drop_graph", name=name)["success"]

    def list_graphs(self) -> list[str]:
        return self._run("show_graphs")["graphs"]

    def get_definition(self, name: str) -> GraphDefinition:
        return self.session._definition(name)

    def is_ready(self, name: str) -> bool:
        return name in self.session.built or name in self.session.snapshots

    def build_graph(self, name: str, what: str = "all") -> dict:
        return self._run("build_graph", name=name, what=what, verbose=False)

    def render_graph(self, name: str) -> bool:
        return self._run("render_graph", name=name)["success"]

    def refresh_graph(self, name: str) -> dict:
        return self._run("refresh_graph", name=name, hours=None)

    def compact_graph(self, name: str) -> bool:
        return self._run("compact_graph", name=name)["success"]

    def graph(self, name: str) -> Graph:
        return self.session.graph(name)

    def neighbors(self, name: str, node: str, direction: str = "out", edge_type: str | None = None, limit: int = 0) -> DataFrame:
        return graphs.neighbors(self.graph(name), node, direction, edge_type, limit)

    def has_edge(self, name: str, source: str, target: str, edge_type: str | None = None) -> bool:
        return graphs.edge_exists(self.graph(name), source, target, edge_type).first()[0]

    def run(self, algorithm: str, name: str, **params) -> dict:
        """Any algorithm by its name in the language, for example ``run('MutualFriends', 'social', user1='a', user2='b')``."""
        return envelopes.ALGORITHMS[algorithm][1](self.graph(name), **envelopes.parameters(algorithm, params))

    def create_snapshot(self, name: str, into: str, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> Snapshot:
        return Snapshot(self.session.snapshot(name, into, node_types, edge_types))

    def on_document_inserted(self, collection: str, doc: dict) -> None:
        """Nothing to do: graphs are derived from their collections."""

    on_document_updated = on_document_deleted = on_document_inserted

    def get_stats(self, name: str) -> dict:
        return self._run("graph_stats", name=name)

    def get_wal_status(self, name: str) -> dict:
        return self._run("graph_wal_status", name=name)

    def get_recent_wal_entries(self, name: str, most: int = 100) -> list[dict]:
        return self.session.log.get(name, [])[-most:]

    def purge_wal(self, name: str) -> int:
        return self._run("purge_wal", name=name)["purged"]


class Snapshot:
    """A fixed graph, for reading."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def node_count(self) -> int:
        return self.graph.nodes.count()

    def edge_count(self) -> int:
        return self.graph.edges.count()

    def snapshot_version(self) -> int:
        return self.graph.version

    def has_node(self, node: str) -> bool:
        return graphs.has_node(self.graph, node).first()[0]

    def node_type(self, node: str) -> str | None:
        row = graphs.get_node(self.graph, node).first()
        return row.type if row else None

    def _degree(self, node: str) -> Any:
        return self.graph.degrees().filter(F.col("id") == node).first()

    def out_degree(self, node: str) -> int:
        return self._degree(node)["out"]

    def in_degree(self, node: str) -> int:
        return self._degree(node)["in"]

    def numbers(self) -> DataFrame:
        """(idx, id): dense numbers in id order."""
        return graphs.numbered(self.graph.nodes.select("id"), "id")

    def dense_id(self, node: str) -> int:
        return self.numbers().filter(F.col("id") == node).first().idx

    def ext_id(self, number: int) -> str:
        return self.numbers().filter(F.col("idx") == number).first().id

    def neighbors(self, node: str, direction: str = "out", edge_type: str | None = None) -> DataFrame:
        return graphs.neighbors(self.graph, node, direction, edge_type)

    def has_edge(self, source: str, target: str, edge_type: str | None = None) -> bool:
        return graphs.edge_exists(self.graph, source, target, edge_type).first()[0]

    def for_each_node(self, callback: Callable[[Any], bool | None]) -> None:
        for row in documents.iterate(self.graph.nodes):
            if callback(row) is False:
                return

    def for_each_edge(self, callback: Callable[[Any], bool | None]) -> None:
        for row in documents.iterate(self.graph.edges):
            if callback(row) is False:
                return

    def stats(self) -> dict:
        return model.stats(self.graph).first().asDict()

    def export_coo(self, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return graphs.export_coo(self.graph, node_types, edge_types)

    def export_csr(self, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return graphs.export_csr(self.graph, node_types, edge_types)

    def node_count_by_type(self) -> dict[str, int]:
        return {r.type: r["count"] for r in self.graph.nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).count().collect()}

    def edge_count_by_type(self) -> dict[str, int]:
        return {r.type: r["count"] for r in self.graph.edges.groupBy("type").count().collect()}
