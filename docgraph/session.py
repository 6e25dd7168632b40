"""A session: a catalog of collections and graphs, and the language over both.

Collections are DataFrames. A typed one has ordinary columns (a Parquet table, or a declared schema); a schemaless one
has ``_id`` and a VARIANT ``doc``. Changes copy on write: a statement swaps in a new DataFrame, and every few changes the
data are written to the shared folder, so that plans stay short. A transaction is a second catalog that COMMIT swaps in.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docgraph.functions.predicate import Condition, Fields, Leaf, lower, matches
from docgraph.functions.update import Operation, apply_to
from docgraph.graph import model
from docgraph.graph.model import EdgeMapping, Graph, GraphDefinition, NodeMapping
from docgraph.lang.parser import ExecutionFailure, LanguageError, SemanticFailure, Statement, UnsupportedFailure, parse, parse_one
from docgraph.operators import documents, envelopes, graphs
from docgraph.plans.durable import cut, shared_path

VERSION = "0.1.0"
RESERVED = "__"
#: Changes of a collection after which its data are written.
CHANGES = 8
SCHEMALESS = "_id string, doc variant"
JSON_TYPES = {"STRING": str, "INT32": int, "INT64": int, "FLOAT64": (int, float), "BOOL": bool, "ARRAY": list, "OBJECT": dict, "BINARY": str}


@dataclass
class Collection:
    """Data and metadata of a collection; never changed in place."""

    df: DataFrame
    fields: list[dict] = field(default_factory=list)
    strict: bool = False
    indexes: dict[str, dict] = field(default_factory=dict)
    foreign_keys: dict[str, dict] = field(default_factory=dict)
    id_col: str = "_id"
    changes: int = 0

    @property
    def schemaless(self) -> bool:
        return Fields(self.df.schema).schemaless


@dataclass
class Job:
    id: str
    algorithm: str
    graph: str
    future: Future
    tag: str
    cancelled: bool = False

    @property
    def status(self) -> str:
        if self.cancelled:
            return "cancelled"
        if not self.future.done():
            return "running"
        return "failed" if self.future.exception() else "done"


class Session:
    """Executes statements; every operator is also a DataFrame function under ``docgraph.operators``.

    ``clock`` gives NOW() in epoch milliseconds; ``wait`` makes RUN JOB return when the job is done; ``reject_unknown``
    makes STRICT collections refuse fields that are not declared.
    """

    def __init__(self, spark: SparkSession, clock: Callable[[], int] | None = None, wait: bool = True, reject_unknown: bool = False):
        self.spark, self.wait, self.reject_unknown = spark, wait, reject_unknown
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.collections: dict[str, Collection] = {}
        self.definitions: dict[str, GraphDefinition] = {}
        self.snapshots: dict[str, Graph] = {}
        self.built: dict[str, Graph] = {}
        self.saved: dict[str, str] = {}
        self.log: dict[str, list[dict]] = {}
        self.current: str | None = None
        self.before: dict[str, Collection] | None = None
        self.jobs: dict[str, Job] = {}
        self.custom: dict[str, tuple[str, Callable]] = {}
        self.lock = threading.RLock()
        self.pool = ThreadPoolExecutor(4)

    # Python surface

    def register(self, name: str, df: DataFrame, id_col: str = "_id") -> None:
        """Makes a DataFrame a typed collection; ``id_col`` is its key."""
        self._free(name)
        self.collections[name] = Collection(df, id_col=id_col)

    def collection(self, name: str) -> DataFrame:
        return self._collection(name).df

    def execute(self, text: str) -> list[dict]:
        """Runs a script; one result for each statement. Stops at the first that raises."""
        return [self.run(s) for s in parse(text)]

    def execute_one(self, text: str) -> dict:
        return self.run(parse_one(text))

    def query(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT, COUNT, EXISTS or TRAVERSE, not yet computed."""
        s = parse_one(text)
        make = {"select": self._select_df, "count": lambda s: documents.count(self.collection(s.collection), s.where), "exists": lambda s: documents.exists(self.collection(s.collection), s.where), "traverse": self._traverse_df}.get(s.kind)
        if make is None:
            raise SemanticFailure(f"{s.kind} has no DataFrame")
        return make(s)

    def register_algorithm(self, name: str, run: Callable[[Graph, dict], Any], kind: str = "lock") -> None:
        """``run(graph, params)`` returns a DataFrame or a JSON-like value."""
        self.custom[name] = (kind, run)

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)

    def run(self, s: Statement) -> dict:
        with self.lock:
            try:
                return getattr(self, f"_do_{s.kind}")(s)
            except LanguageError:
                raise
            except ValueError as e:
                raise SemanticFailure(str(e)) from e
            except Exception as e:
                raise ExecutionFailure(f"{s.kind}: {e}") from e

    # Catalog

    def _free(self, name: str) -> None:
        if name.startswith(RESERVED):
            raise SemanticFailure(f"'{name}' is reserved")
        if name in self.collections:
            raise SemanticFailure(f"collection '{name}' already exists")

    def _collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise SemanticFailure(f"collection '{name}' does not exist")
        return self.collections[name]

    def _swap(self, name: str, df: DataFrame) -> None:
        old = self.collections[name]
        changes = old.changes + 1
        if changes >= CHANGES:
            df, changes = cut(df), 0
        self.collections[name] = replace(old, df=df, changes=changes)
        for graph, definition in self.definitions.items():
            if any(m.collection == name for m in [*definition.nodes, *definition.edges]):
                self._logged(graph, "change", collection=name)
                if graph in self.built and definition.mode == "live":
                    self.built[graph] = self._derived(graph, self.built[graph].version + 1)

    def _do_create_collection(self, s: Statement) -> dict:
        self._free(s.name)
        self.collections[s.name] = Collection(self.spark.createDataFrame([], SCHEMALESS), s.fields, s.strict)
        return {"success": True, "collection": s.name}

    def _do_drop_collection(self, s: Statement) -> dict:
        self._collection(s.name)
        del self.collections[s.name]
        for other in self.collections.values():
            other.foreign_keys = {k: v for k, v in other.foreign_keys.items() if v["ref_collection"] != s.name}
        return {"success": True, "collection": s.name}

    def _do_alter_collection(self, s: Statement) -> dict:
        self.collections[s.name] = replace(self._collection(s.name), fields=s.fields)
        return {"success": True, "collection": s.name}

    def _do_show_collections(self, s: Statement) -> dict:
        return {"success": True, "collections": sorted(self.collections)}

    def _do_collection_exists(self, s: Statement) -> dict:
        return {"success": True, "exists": s.name in self.collections}

    def _do_describe_collection(self, s: Statement) -> dict:
        if s.name not in self.collections:
            return {"success": True, "collection": s.name, "exists": False, "size": -1, "foreign_keys": []}
        c = self.collections[s.name]
        out = {"success": True, "collection": s.name, "exists": True, "size": c.df.count()}
        if c.fields:
            out["schema"] = [{k: f[k] for k in ("name", "type", "required", "unique")} for f in c.fields]
        elif not c.schemaless:
            out["schema"] = [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable, "unique": False} for f in c.df.schema]
        return out | {"foreign_keys": self._keys(c)}

    @staticmethod
    def _keys(c: Collection) -> list[dict]:
        return [{"name": n, "field": k["field"], "ref": f"{k['ref_collection']}.{k['ref_field']}"} for n, k in c.foreign_keys.items()]

    def _do_create_index(self, s: Statement) -> dict:
        c = self._collection(s.collection)
        if s.name in c.indexes:
            raise SemanticFailure(f"index '{s.name}' already exists")
        if s.unique and documents.unique_violations(c.df, s.fields).take(1):
            raise SemanticFailure(f"'{s.collection}' has repeated values of {', '.join(s.fields)}")
        c.indexes[s.name] = {"name": s.name, "fields": s.fields, "type": "Unique" if s.unique else "Compound" if len(s.fields) > 1 else "Single"}
        return {"success": True, "index": s.name}

    def _do_drop_index(self, s: Statement) -> dict:
        if self._collection(s.collection).indexes.pop(s.name, None) is None:
            raise SemanticFailure(f"no index '{s.name}'")
        return {"success": True, "index": s.name}

    def _do_show_indexes(self, s: Statement) -> dict:
        return {"success": True, "indexes": list(self._collection(s.collection).indexes.values())}

    def _do_add_fk(self, s: Statement) -> dict:
        c = self._collection(s.collection)
        self._collection(s.ref_collection)
        if s.name in c.foreign_keys:
            raise SemanticFailure(f"foreign key '{s.name}' already exists")
        c.foreign_keys[s.name] = {k: s.args[k] for k in ("field", "ref_collection", "ref_field")}
        return {"success": True, "foreign_key": s.name}

    def _do_drop_fk(self, s: Statement) -> dict:
        if self._collection(s.collection).foreign_keys.pop(s.name, None) is None:
            raise SemanticFailure(f"no foreign key '{s.name}'")
        return {"success": True, "foreign_key": s.name}

    def _do_show_fks(self, s: Statement) -> dict:
        return {"success": True, "foreign_keys": self._keys(self._collection(s.collection))}

    # Inserts

    def _checked(self, c: Collection, doc: dict) -> dict:
        """The document with an id and defaults; what the schema forbids raises."""
        doc = {"_id": str(uuid.uuid4()), **doc}
        if not isinstance(doc["_id"], str):
            doc["_id"] = json.dumps(doc["_id"])
        for f in c.fields:
            if f["name"] not in doc and "default" in f:
                doc[f["name"]] = f["default"]
            if f["required"] and f["name"] not in doc:
                raise SemanticFailure(f"required field '{f['name']}' is missing")
            value = doc.get(f["name"])
            if value is not None and (not isinstance(value, JSON_TYPES[f["type"]]) or (isinstance(value, bool) and f["type"] != "BOOL")):
                raise SemanticFailure(f"field '{f['name']}' is not {f['type']}")
        if c.strict and self.reject_unknown and (unknown := set(doc) - {f["name"] for f in c.fields} - {"_id"}):
            raise SemanticFailure(f"unknown fields: {', '.join(sorted(unknown))}")
        return doc

    def insert(self, name: str, docs: list[dict]) -> list[str]:
        """Inserts documents as one change; of equal ids the last stays, and one that exists is overwritten."""
        c = self._collection(name)
        docs = list({d["_id"]: d for d in (self._checked(c, d) for d in docs)}.values())
        if not c.schemaless:
            fresh = self.spark.createDataFrame([json.dumps(d) for d in docs], "string").select(F.from_json("value", c.df.schema).alias("d")).select("d.*")
        else:
            fresh = self.spark.createDataFrame([(d["_id"], json.dumps(d)) for d in docs], "_id string, body string").select("_id", F.parse_json("body").alias("doc"))
        for key in c.foreign_keys.values():
            if documents.foreign_key_violations(fresh, self.collection(key["ref_collection"]), key["field"], key["ref_field"]).take(1):
                raise SemanticFailure(f"'{key['field']}' refers to nothing in {key['ref_collection']}.{key['ref_field']}")
        after = documents.upsert(c.df, fresh, c.id_col)
        for paths in self._unique(c):
            held = [tuple(_at(d, p) for p in paths) for d in docs]
            wanted = [h for h in held if None not in h]
            if not wanted:
                continue
            # Only documents that share a new value can clash.
            near = documents.where(after, Condition.or_(*[Condition.and_(*[Leaf(p, "=", v) for p, v in zip(paths, h, strict=True)]) for h in wanted]))
            if documents.unique_violations(near, paths).take(1):
                raise SemanticFailure(f"repeated value of {', '.join(paths)}")
        self._swap(name, after)
        return [d["_id"] for d in docs]

    @staticmethod
    def _unique(c: Collection) -> list[list[str]]:
        paths = [[f["name"]] for f in c.fields if f["unique"]] + [i["fields"] for i in c.indexes.values() if i["type"] == "Unique"]
        return [p for p in paths if p != [c.id_col]]

    @staticmethod
    def _json(text: str, number: int | None = None) -> dict:
        try:
            doc = json.loads(text)
        except ValueError as e:
            raise SemanticFailure(f"invalid JSON{'' if number is None else f' in document {number}'}: {e}") from e
        if not isinstance(doc, dict):
            raise SemanticFailure("a document is a JSON object")
        return doc

    def _do_insert(self, s: Statement) -> dict:
        ids = self.insert(s.collection, [self._json(s.document)])
        return {"success": True, "data": ids[0], "error": ""}

    def _do_insert_batch(self, s: Statement) -> dict:
        ids = self.insert(s.collection, [self._json(d, i) for i, d in enumerate(s.documents)])
        return {"success": True, "data": json.dumps(ids), "ids": ids, "error": ""}

    # Queries

    def _select_df(self, s: Statement) -> DataFrame:
        c = self._collection(s.collection)
        if not s.joins:
            return documents.project(documents.scan(c.df, s.where, s.limit, s.skip, c.id_col), s.fields, c.id_col)
        joins = []
        for other, one, two in s.joins:
            left, right = (p.split(".", 1)[1] if p.split(".", 1)[0] in (s.collection, other) and "." in p else p for p in (one, two))
            if one.split(".")[0] == other and two.split(".")[0] == s.collection:
                left, right = right, left
            joins.append((self.collection(other), left, right))
        first = self._collection(s.joins[0][0])
        out = documents.lookup_chain(c.df, joins, s.where, left_id=c.id_col, right_id=first.id_col)
        return documents.scan(out, None, s.limit, s.skip, c.id_col)

    def _do_select(self, s: Statement) -> dict:
        c = self._collection(s.collection)
        df = self._select_df(s)
        if s.fields and s.joins:
            df = df.select("*")
        found = [_document(r, c.schemaless, s.fields) for r in df.collect()]
        if s.joins and s.fields:
            tops = {p.split(".")[0] for p in s.fields} | {"_id"}
            found = [{k: v for k, v in d.items() if k in tops or k.startswith("__joined")} for d in found]
        return {"success": True, "count": len(found), "documents": found}

    def _do_count(self, s: Statement) -> dict:
        return {"success": True, "count": documents.count(self.collection(s.collection), s.where).first()[0], "error": ""}

    def _do_exists(self, s: Statement) -> dict:
        return {"success": True, "exists": documents.exists(self.collection(s.collection), s.where).first()[0], "error": ""}

    def _now(self) -> Column:
        return F.lit(self.clock()).cast("long")

    def _do_update(self, s: Statement) -> dict:
        c = self._collection(s.collection)
        changed = documents.count(c.df, s.where).first()[0]
        if changed:
            after = documents.update(c.df, s.where, s.operations, self._now())
            touched = {op.path.split(".")[0] for op in s.operations}
            for key in c.foreign_keys.values():
                if key["field"].split(".")[0] in touched and documents.foreign_key_violations(documents.where(after, None), self.collection(key["ref_collection"]), key["field"], key["ref_field"]).take(1):
                    raise SemanticFailure(f"'{key['field']}' would refer to nothing in {key['ref_collection']}.{key['ref_field']}")
            for paths in self._unique(c):
                if touched & {p.split(".")[0] for p in paths} and documents.unique_violations(after, paths).take(1):
                    raise SemanticFailure(f"repeated value of {', '.join(paths)}")
            self._swap(s.collection, after)
        return {"success": True, "updated": changed, "error": ""}

    def _do_delete(self, s: Statement) -> dict:
        c = self._collection(s.collection)
        gone = documents.count(c.df, s.where).first()[0]
        if gone:
            self._swap(s.collection, documents.delete(c.df, s.where))
        return {"success": True, "deleted": gone, "error": ""}

    # Transactions

    def _do_begin_tx(self, s: Statement) -> dict:
        if self.before is not None:
            raise SemanticFailure("a transaction is already active")
        self.before = {n: replace(c, indexes=dict(c.indexes), foreign_keys=dict(c.foreign_keys)) for n, c in self.collections.items()}
        return {"success": True, "transaction": "started"}

    def _do_commit_tx(self, s: Statement) -> dict:
        if self.before is None:
            raise SemanticFailure("no active transaction")
        self.before = None
        return {"success": True, "transaction": "committed"}

    def _do_rollback_tx(self, s: Statement) -> dict:
        if self.before is None:
            raise SemanticFailure("no active transaction")
        self.collections, self.before = self.before, None
        for name in list(self.built):
            if self.definitions[name].mode == "live":
                self.built[name] = self._derived(name, self.built[name].version + 1)
        return {"success": True, "transaction": "rolled back"}

    # Graphs

    def _definition(self, name: str | None) -> GraphDefinition:
        if name is None:
            raise SemanticFailure("no current graph: USE GRAPH first")
        if name not in self.definitions:
            raise SemanticFailure(f"graph '{name}' does not exist")
        return self.definitions[name]

    def graph(self, name: str) -> Graph:
        """A built graph or a snapshot."""
        if name in self.snapshots:
            return self.snapshots[name]
        self._definition(name)
        if name not in self.built:
            raise SemanticFailure(f"graph '{name}' is not built")
        return self.built[name]

    def _logged(self, graph: str, op: str, **more) -> None:
        entries = self.log.setdefault(graph, [])
        entries.append({"seq": len(entries) + 1, "op": op, "ts": self.clock(), **more})

    def _derived(self, name: str, version: int, what: str = "all", count: bool = False) -> Graph:
        definition = self._definition(name)
        held = {m.collection: self.collection(m.collection) for m in [*definition.nodes, *definition.edges]}
        graph = model.build(definition, held, self.spark, what, count)
        graph.version = version
        return graph

    def _do_create_graph(self, s: Statement) -> dict:
        if s.name in self.definitions or s.name in self.snapshots:
            raise SemanticFailure(f"graph '{s.name}' already exists")
        self.definitions[s.name] = GraphDefinition(s.name, s.mode, s.directed, s.heterogeneous, s.where)
        self.current = s.name
        return {"success": True, "graph": s.name, "mode": s.mode, "error": ""}

    def _do_use_graph(self, s: Statement) -> dict:
        if s.name not in self.snapshots:
            self._definition(s.name)
        self.current = s.name
        return {"success": True, "current_graph": s.name}

    def _do_show_graphs(self, s: Statement) -> dict:
        return {"success": True, "graphs": sorted([*self.definitions, *self.snapshots])}

    def _do_describe_graph(self, s: Statement) -> dict:
        out = {"success": True, "graph": s.name, "ready": s.name in self.built or s.name in self.snapshots}
        definition = None if s.name in self.snapshots else self._definition(s.name)
        if out["ready"]:
            row = model.stats(self.graph(s.name)).first()
            out |= {"active_nodes": row.active_nodes, "active_edges": row.active_edges, "version": self.graph(s.name).version}
        else:
            out |= {"active_nodes": 0, "active_edges": 0, "version": 0}
        maps = {m.type: m.collection for m in definition.nodes} if definition else {}
        edges = [{"type": m.type, "collection": m.collection, "method": "unwind" if m.unwind else "field"} for m in definition.edges] if definition else []
        return out | {"node_mappings": maps, "edge_mappings": edges}

    def _do_drop_graph(self, s: Statement) -> dict:
        if s.name not in self.snapshots:
            self._definition(s.name)
        for held in (self.definitions, self.snapshots, self.built, self.saved, self.log):
            held.pop(s.name, None)
        self.current = None if self.current == s.name else self.current
        return {"success": True, "dropped": s.name}

    def _do_map_node(self, s: Statement) -> dict:
        definition = self._definition(self.current)
        self._collection(s.collection)
        definition.nodes.append(NodeMapping(s.type, s.collection, s.key, s.properties, s.where))
        return {"success": True, "graph": definition.name, "node_type": s.type, "collection": s.collection}

    def _do_map_edge(self, s: Statement) -> dict:
        definition = self._definition(self.current)
        self._collection(s.collection)
        if s.unwind and s.alias not in (s.source, s.target):
            raise SemanticFailure(f"UNWIND alias '{s.alias}' must be the SOURCE or the TARGET")
        definition.edges.append(EdgeMapping(s.type, s.collection, s.source, s.target, s.source_type, s.target_type, s.unwind, s.alias, s.directed, s.properties))
        return {"success": True, "graph": definition.name, "edge_type": s.type, "method": "unwind" if s.unwind else "field"}

    def _build(self, name: str, what: str = "all") -> dict:
        began = time.time()
        graph = self._derived(name, self.built[name].version + 1 if name in self.built else 1, what, True)
        if self.definitions[name].mode == "static":
            graph.nodes, graph.edges = cut(graph.nodes), cut(graph.edges)
        self.built[name] = graph
        self.saved[name] = self.saved.get(name) or shared_path(self.spark, f"graph-{name}")
        self._logged(name, "build", nodes=graph.nodes_built, edges=graph.edges_built)
        return {"success": True, "nodes_built": graph.nodes_built, "edges_built": graph.edges_built, "elapsed_ms": round((time.time() - began) * 1000, 3), "error": ""}

    def _do_build_graph(self, s: Statement) -> dict:
        out = self._build(s.name, s.what)
        if s.verbose:
            row = model.stats(self.graph(s.name)).first()
            out |= {"nodes": row.active_nodes, "edges": row.active_edges}
        return out

    def _do_refresh_graph(self, s: Statement) -> dict:
        if s.hours is not None:
            raise UnsupportedFailure("REFRESH GRAPH ... EVERY n HOURS: schedule REFRESH GRAPH outside the session")
        return {k: v for k, v in self._build(s.name).items() if k != "elapsed_ms"}

    def save_graph(self, name: str) -> str:
        """Writes a built graph as Parquet; RENDER GRAPH reads it back."""
        path = shared_path(self.spark, f"graph-{name}")
        self.graph(name).write(path)
        self.saved[name] = path
        return path

    def _do_render_graph(self, s: Statement) -> dict:
        """Writes the graph as it is, and reads it back as a fixed copy."""
        graph = self.graph(s.name)
        path = self.save_graph(s.name)
        fixed = model.read(self.spark, path)
        self.built[s.name] = Graph(fixed.nodes, fixed.edges, graph.nodes_built, graph.edges_built, graph.version)
        return {"success": True, "graph": s.name}

    def _do_compact_graph(self, s: Statement) -> dict:
        graph = self.graph(s.name)
        graph.nodes, graph.edges = cut(graph.nodes), cut(graph.edges)
        self._logged(s.name, "compact")
        return {"success": True, "graph": s.name}

    def _do_graph_wal_status(self, s: Statement) -> dict:
        self._definition(s.name)
        entries = self.log.get(s.name, [])
        return {"success": True, "graph": s.name, "entries": len(entries), "pending": 0, "last_seq": entries[-1]["seq"] if entries else 0}

    def _do_purge_wal(self, s: Statement) -> dict:
        self._definition(s.name)
        return {"success": True, "graph": s.name, "purged": len(self.log.pop(s.name, []))}

    def _do_replay_wal(self, s: Statement) -> dict:
        raise UnsupportedFailure("REPLAY GRAPH WAL: graphs are derived from their collections; REFRESH GRAPH rebuilds one")

    def _do_graph_status(self, s: Statement) -> dict:
        ready = s.name in self.built or s.name in self.snapshots
        if not ready:
            self._definition(s.name)
            return {"success": True, "graph": s.name, "ready": False, "state": "NotBuilt", "nodes": 0, "edges": 0, "version": 0}
        row = model.stats(self.graph(s.name)).first()
        return {"success": True, "graph": s.name, "ready": True, "state": "Clean", "nodes": row.active_nodes, "edges": row.active_edges, "version": self.graph(s.name).version}

    def _do_graph_stats(self, s: Statement) -> dict:
        row = model.stats(self.graph(s.name)).first()
        return {"success": True, "graph": s.name, **row.asDict(), "deleted_nodes": 0, "deleted_edges": 0, "version": self.graph(s.name).version}

    def snapshot(self, name: str, into: str, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> Graph:
        """An immutable copy, written to the shared folder."""
        if into in self.definitions:
            raise SemanticFailure(f"graph '{into}' already exists")
        part = model.subgraph(self.graph(name), node_types, edge_types)
        self.snapshots[into] = Graph(cut(part.nodes), cut(part.edges), version=part.version)
        return self.snapshots[into]

    def _do_snapshot_graph(self, s: Statement) -> dict:
        graph = self.snapshot(s.name, s.into)
        return {"success": True, "snapshot": s.into, "nodes": graph.nodes.count(), "edges": graph.edges.count(), "version": graph.version}

    def _current(self) -> Graph:
        if self.current is None:
            raise SemanticFailure("no current graph: USE GRAPH first")
        return self.graph(self.current)

    def _traverse_df(self, s: Statement) -> DataFrame:
        return graphs.traverse(self._current(), s.node, s.direction, s.edge_type, s.depth, s.limit)

    def _do_traverse(self, s: Statement) -> dict:
        found = [{"id": r.id, "distance": r.distance} for r in self._traverse_df(s).collect()]
        return {"success": True, "source": s.node, "depth": s.depth, "count": len(found), "nodes": [f["id"] for f in found] if s.depth == 1 else found}

    def _do_get_node(self, s: Statement) -> dict:
        definition = self._definition(self.current)
        mapping = next((m for m in definition.nodes if m.type == s.type), None)
        if mapping is None:
            raise SemanticFailure(f"no mapping of node type '{s.type}'")
        c = self._collection(mapping.collection)
        rows = documents.where(c.df, Leaf(mapping.key, "=", s.node)).limit(1).collect()
        if not rows:
            return {"success": False, "error": f"no node '{s.node}'"}
        return {"success": True, "node_type": s.type, "document": _document(rows[0], c.schemaless, None)}

    def _do_edge_exists(self, s: Statement) -> dict:
        return {"success": True, "exists": graphs.edge_exists(self._current(), s.source, s.target, s.edge_type).first()[0]}

    def visualization(self, name: str, most: int = 1000) -> dict:
        """All nodes and edges as JSON-like values; more than ``most`` nodes raise."""
        graph = self.graph(name)
        nodes = graph.nodes.select("id", "type").limit(most + 1).collect()
        if len(nodes) > most:
            raise SemanticFailure(f"more than {most} nodes")
        return {"nodes": [r.asDict() for r in nodes], "edges": [r.asDict() for r in graph.edges.select("src", "dst", "type", "directed").collect()]}

    # Algorithms and jobs

    def _algorithm(self, s: Statement, kind: str) -> Callable[[], Any]:
        graph = self.graph(s.graph)
        if s.algorithm in self.custom:
            known, run = self.custom[s.algorithm]
            params = dict(s.params) | ({"limit": s.limit} if s.limit is not None else {}) | ({"top": s.top} if s.top is not None else {})
            work = lambda: envelopes.plain(run(graph, params))
        elif s.algorithm in envelopes.ALGORITHMS:
            known, run = envelopes.ALGORITHMS[s.algorithm]
            params = envelopes.parameters(s.algorithm, s.params, s.limit, s.top)
            work = lambda: run(graph, **params)
        else:
            raise SemanticFailure(f"unknown algorithm '{s.algorithm}'")
        if known != kind:
            raise SemanticFailure(f"'{s.algorithm}' is a {known} algorithm: RUN {known.upper()}")
        return work

    def _do_run_lock(self, s: Statement) -> dict:
        began = time.time()
        result = self._algorithm(s, "lock")()
        return {"success": True, "algorithm": s.algorithm, "graph": s.graph, "result": result, "elapsed_ms": round((time.time() - began) * 1000, 3)}

    def _do_run_job(self, s: Statement) -> dict:
        work, name = self._algorithm(s, "job"), f"job_{len(self.jobs) + 1}"
        tag = f"docgraph-{uuid.uuid4().hex}"

        def tagged() -> Any:
            self.spark.addTag(tag)
            try:
                return work()
            finally:
                self.spark.removeTag(tag)

        job = Job(name, s.algorithm, s.graph, self.pool.submit(inheritable_thread_target(self.spark)(tagged)), tag)
        self.jobs[name] = job
        if self.wait and (failure := job.future.exception()):
            raise failure if isinstance(failure, ValueError | LanguageError) else ExecutionFailure(str(failure))
        return {"success": True, "job_id": name, "algorithm": s.algorithm, "graph": s.graph, "status": job.status}

    def _job(self, name: str) -> Job:
        if name not in self.jobs:
            raise SemanticFailure(f"no job '{name}'")
        return self.jobs[name]

    def _do_job_status(self, s: Statement) -> dict:
        job = self._job(s.job)
        return {"success": True, "job_id": job.id, "status": job.status, "algorithm": job.algorithm, "graph": job.graph}

    def _do_job_result(self, s: Statement) -> dict:
        job = self._job(s.job)
        if job.status != "done":
            return {"success": False, "job_id": job.id, "status": job.status, "error": str(job.future.exception()) if job.status == "failed" else f"job is {job.status}"}
        return {"success": True, "job_id": job.id, "status": "done", "result": job.future.result()}

    def _do_job_cancel(self, s: Statement) -> dict:
        job = self._job(s.job)
        if job.status == "running":
            job.cancelled = True
            job.future.cancel()
            self.spark.interruptTag(job.tag)
        return {"success": True, "job_id": job.id, "status": job.status}

    def _do_show_jobs(self, s: Statement) -> dict:
        jobs = [j for j in self.jobs.values() if s.graph in (None, j.graph)]
        return {"success": True, "jobs": [{"job_id": j.id, "algorithm": j.algorithm, "graph": j.graph, "status": j.status} for j in jobs]}

    # System

    def _do_system_status(self, s: Statement) -> dict:
        return {"success": True, "healthy": not self.spark.sparkContext._jsc.sc().isStopped(), "collections": len(self.collections), "graphs": len(self.definitions), "transaction_active": self.before is not None}

    def _do_system_info(self, s: Statement) -> dict:
        return {"success": True, "version": VERSION, "engine": "docgraph", "spark": self.spark.version, "algorithms": sorted([*envelopes.ALGORITHMS, *self.custom])}


def _at(doc: dict, path: str) -> Any:
    for part in path.split("."):
        doc = doc.get(part) if isinstance(doc, dict) else None
    return doc


def _python(value: Any) -> Any:
    """Rows and variants as plain values."""
    if hasattr(value, "toPython"):
        return value.toPython()
    if hasattr(value, "asDict"):
        return {k: _python(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_python(v) for v in value]
    return {k: _python(v) for k, v in value.items()} if isinstance(value, dict) else value


def _document(row, schemaless: bool, fields: list[str] | None) -> dict:
    """A row as a document: absent fields are left out, the body of a schemaless one is unfolded."""
    held = row.asDict()
    out = {}
    if schemaless and "doc" in held:
        out = _python(held.pop("doc"))
        held.pop("_id", None)
    for name, value in held.items():
        value = _python(value)
        if name.startswith("__joined") and isinstance(value, dict) and "doc" in value and "_id" in value:
            value = value["doc"]
        if value is not None or fields is None:
            _set(out, name if fields and name in fields else name, value)
    return out


def _set(out: dict, path: str, value: Any) -> None:
    *way, name = path.split(".")
    for part in way:
        out = out.setdefault(part, {})
    out[name] = value


def rows_from_result(result: dict) -> dict:
    """A statement's result as a table: columns and rows."""
    body = next((result[k] for k in ("documents", "nodes", "collections", "graphs", "jobs", "indexes", "foreign_keys") if isinstance(result.get(k), list)), None)
    if body is None:
        body = [result]
    rows = [r if isinstance(r, dict) else {"value": r} for r in body]
    columns = list(dict.fromkeys(k for r in rows for k in r))
    return {"columns": columns, "rows": [[r.get(c) for c in columns] for r in rows]}


__all__ = ["Collection", "Job", "Operation", "Session", "apply_to", "lower", "matches", "rows_from_result"]
