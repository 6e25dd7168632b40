"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docgraph.functions.predicate import And, Condition, Leaf, Nor, Not, Or
from docgraph.functions.update import UpdateSpec
from docgraph.graph import model
from docgraph.graph.model import EdgeMapping, Graph, GraphDefinition, NodeMapping
from docgraph.operators import algorithms, documents, graphs
from docgraph.session import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str, **keys: str) -> Session:
    """A session with these tables as collections: name=key column."""
    out = Session(spark)
    for name, key in keys.items():
        out.register(name, table(spark, sf_dir, name), key)
    return out


# Documents


@query("select c_custkey, c_name, c_mktsegment from customer where c_acctbal > 5000 and c_mktsegment in ('BUILDING', 'MACHINERY') order by c_custkey limit 20")
def doc_select(spark, sf_dir):
    return session(spark, sf_dir, customer="c_custkey").query("SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING','MACHINERY') LIMIT 20;")


@query("select * from customer")
def doc_scan(spark, sf_dir):
    return documents.scan(table(spark, sf_dir, "customer"))


@query("select * from orders where o_orderkey = 7")
def doc_find_by_id(spark, sf_dir):
    return documents.find_by_id(table(spark, sf_dir, "orders"), 7, "o_orderkey")


@query("select * from part where starts_with(p_partkey::varchar, '12') order by p_partkey limit 25")
def doc_id_range(spark, sf_dir):
    return documents.id_range(table(spark, sf_dir, "part"), "12", 25, "p_partkey")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderkey limit 50 offset 30")
def doc_limit_skip(spark, sf_dir):
    return session(spark, sf_dir, orders="o_orderkey").query("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' LIMIT 50 SKIP 30;")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 and o_totalprice < 150000 and o_orderpriority <> '1-URGENT'")
def doc_compare(spark, sf_dir):
    condition = And((Leaf("o_totalprice", ">=", 1000), Leaf("o_totalprice", "<", 150000), Leaf("o_orderpriority", "!=", "1-URGENT")))
    return documents.scan(table(spark, sf_dir, "orders"), condition).select("o_orderkey", "o_totalprice")


@query("select s_suppkey from supplier where s_nationkey not in (1, 2, 3) and s_nationkey in (0, 1, 4, 5, 6, 7, 8, 9)")
def doc_in_not_in(spark, sf_dir):
    return documents.scan(table(spark, sf_dir, "supplier"), Condition.and_(Leaf("s_nationkey", "not in", [1, 2, 3]), Condition.in_("s_nationkey", [0, 1, 4, 5, 6, 7, 8, 9]))).select("s_suppkey")


@query("select p_partkey, p_name from part where regexp_matches(p_name, '[a-m]+.*[0-9]$') or contains(p_type, 'STEEL') or starts_with(p_brand, 'Brand#1')")
def doc_text_match(spark, sf_dir):
    return session(spark, sf_dir, part="p_partkey").query("SELECT p_name FROM part WHERE p_name LIKE '[a-m]+.*[0-9]$' OR p_type CONTAINS 'STEEL' OR p_brand STARTS WITH 'Brand#1';")


@query("select c_custkey from customer where not (c_acctbal > 0 or c_mktsegment = 'BUILDING') and not (c_nationkey = 3 or c_nationkey = 4)")
def doc_not_nor(spark, sf_dir):
    condition = And((Not(Or((Leaf("c_acctbal", ">", 0), Leaf("c_mktsegment", "=", "BUILDING")))), Nor((Leaf("c_nationkey", "=", 3), Leaf("c_nationkey", "=", 4)))))
    return documents.scan(table(spark, sf_dir, "customer"), condition).select("c_custkey")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a schemaless collection: props as an object, user and type beside it; every third has no type."""
    events = table(spark, sf_dir, "events")
    body = F.struct(F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("type"), F.col("value"), F.parse_json("props").alias("props"))
    return events.select(F.col("event_id").cast("string").alias("_id"), F.parse_json(F.to_json(body)).alias("doc"))


_EVENTS = "(select event_id::varchar as _id, user_id, case when event_id % 3 <> 0 then event_type end as type, value, (props::json->>'k')::bigint as k from events)"


@query(f"select _id from {_EVENTS} where k > 50 and type = 'click'")
def doc_variant_path(spark, sf_dir):
    return documents.scan(event_documents(spark, sf_dir), And((Leaf("props.k", ">", 50), Leaf("type", "=", "click")))).select("_id")


@query(f"select _id from {_EVENTS} where type is null and k is not null")
def doc_exists_leaf(spark, sf_dir):
    return documents.scan(event_documents(spark, sf_dir), And((Leaf("type", "not exists"), Leaf("props.k", "exists")))).select("_id")


@query(f"select _id from {_EVENTS} where type is not null and type <> 'view' or not coalesce(type = 'view' or type = 'error', false) and k < 20")
def doc_two_valued(spark, sf_dir):
    condition = Or((Leaf("type", "!=", "view"), And((Not(Or((Leaf("type", "=", "view"), Leaf("type", "=", "error")))), Leaf("props.k", "<", 20)))))
    return documents.scan(event_documents(spark, sf_dir), condition).select("_id")


@query("select c_custkey, c_name, c_mktsegment from customer")
def doc_exclude(spark, sf_dir):
    return documents.exclude(table(spark, sf_dir, "customer"), ["c_nationkey", "c_acctbal"])


@query("select count(*) as count from lineitem where l_quantity > 25 and l_returnflag = 'R'")
def doc_count(spark, sf_dir):
    return session(spark, sf_dir, lineitem="l_orderkey").query("COUNT FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R';")


@query("select count(*) > 0 as exists from orders where o_totalprice > 100000")
def doc_exists(spark, sf_dir):
    return session(spark, sf_dir, orders="o_orderkey").query("EXISTS IN orders WHERE o_totalprice > 100000;")


@query("""select o_orderkey, o_custkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'""")
def doc_lookup_join(spark, sf_dir):
    joined = documents.lookup_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", Leaf("o_orderstatus", "=", "O"), left_id="o_orderkey", right_id="c_custkey")
    return joined.select("o_orderkey", "o_custkey", "__joined__.c_name", "__joined__.c_mktsegment")


@query("""select c_custkey, min(o_orderkey) as first_order from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def doc_lookup_left(spark, sf_dir):
    joined = documents.lookup_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", how="left", left_id="c_custkey", right_id="o_orderkey")
    return joined.select("c_custkey", F.col("__joined__.o_orderkey").alias("first_order"))


@query("""select c_custkey, count(*) as orders, sum(o_orderkey)::bigint as key_sum from customer join orders on c_custkey = o_custkey group by c_custkey""")
def doc_lookup_many(spark, sf_dir):
    joined = documents.lookup_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", many=True, left_id="c_custkey", right_id="o_orderkey")
    return joined.select("c_custkey", F.size("__joined__").cast("long").alias("orders"), F.aggregate(F.col("__joined__.o_orderkey"), F.lit(0).cast("long"), lambda a, x: a + x).alias("key_sum"))


@query("""select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 200000""")
def doc_lookup_chain(spark, sf_dir):
    first = documents.lookup_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", Leaf("o_totalprice", ">", 200000), left_id="o_orderkey", right_id="c_custkey")
    second = documents.lookup_join(first, table(spark, sf_dir, "nation"), "__joined__.c_nationkey", "n_nationkey", right_id="n_nationkey", name="__joined_2__")
    return second.select("o_orderkey", "__joined__.c_name", "__joined_2__.n_name")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def doc_foreign_key(spark, sf_dir):
    parent = documents.scan(table(spark, sf_dir, "customer"), Leaf("c_acctbal", ">", 0))
    return documents.foreign_key_violations(table(spark, sf_dir, "orders"), parent, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_suppkey, count(*) as count from lineitem group by l_orderkey, l_suppkey having count(*) > 1")
def doc_unique(spark, sf_dir):
    return documents.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(f"select _id from {_EVENTS} where type is null")
def doc_required(spark, sf_dir):
    return documents.missing_required(event_documents(spark, sf_dir), ["user", "type", "props.k"]).select("_id")


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'HOUSING' else c_mktsegment end as c_mktsegment, case when c_mktsegment = 'BUILDING' then c_acctbal + 10 else c_acctbal end as c_acctbal, case when c_mktsegment = 'BUILDING' then greatest(c_nationkey, 5) else c_nationkey end as c_nationkey from customer")
def doc_update(spark, sf_dir):
    spec = UpdateSpec().set("c_mktsegment", "HOUSING").inc("c_acctbal", 10).max("c_nationkey", 5)
    return documents.update(table(spark, sf_dir, "customer"), Leaf("c_mktsegment", "=", "BUILDING"), spec.operations).select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")


@query(f"select _id, case when k > 50 then coalesce(k, 0) + 3 else k end as k, case when k > 50 then 'hot' end as label, case when k > 50 then null else user_id end as user, case when k > 50 then 6 end as tripled from {_EVENTS}")
def doc_update_variant(spark, sf_dir):
    spec = UpdateSpec().inc("props.k", 3).set("label", "hot").unset("user").inc("tripled", 2).mul("tripled", 3)
    out = documents.update(event_documents(spark, sf_dir), Leaf("props.k", ">", 50), spec.operations)
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return out.select("_id", get("$.props.k", "bigint").alias("k"), get("$.label", "string").alias("label"), get("$.user", "bigint").alias("user"), get("$.tripled", "bigint").alias("tripled"))


@query(f"select _id, case when k < 60 then 3 * k else k end as k, case when k < 60 then 7 end as low, case when k < 60 then 'b' end as tags, case when k < 60 then type end as kind, case when k >= 60 then type end as type from {_EVENTS}")
def doc_update_more(spark, sf_dir):
    """MULTIPLY, SET MIN, PULL ALL and RENAME."""
    spec = UpdateSpec().mul("props.k", 3).set("low", 9).min("low", 7).push_all("tags", ["a", "b", "a", "c"]).pull_all("tags", ["a", "c"]).rename("type", "kind")
    out = documents.update(event_documents(spark, sf_dir), Leaf("props.k", "<", 60), spec.operations)
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return out.select("_id", get("$.props.k", "bigint").alias("k"), get("$.low", "bigint").alias("low"), F.array_join(get("$.tags", "array<string>"), ",").alias("tags"), get("$.kind", "string").alias("kind"), get("$.type", "string").alias("type"))


@query(f"select _id, case when k < 30 then 'a,b' || case when k < 10 then '' else '' end else null end as tags from {_EVENTS}")
def doc_update_arrays(spark, sf_dir):
    spec = UpdateSpec().push("tags", "x").push_all("tags", ["a", "b", "a"]).pull("tags", "x").add_to_set("tags", "b").pop("tags")
    out = documents.update(event_documents(spark, sf_dir), Leaf("props.k", "<", 30), spec.operations)
    return out.select("_id", F.array_join(F.try_variant_get("doc", "$.tags", "array<string>"), ",").alias("tags"))


@query("select o_orderkey, o_totalprice from orders where not (o_totalprice < 50000 or o_orderpriority = '5-LOW')")
def doc_delete(spark, sf_dir):
    return documents.delete(table(spark, sf_dir, "orders"), Or((Leaf("o_totalprice", "<", 50000), Leaf("o_orderpriority", "=", "5-LOW")))).select("o_orderkey", "o_totalprice")


@query("select c_custkey, case when c_nationkey = 3 then 'replaced' else c_name end as c_name from customer")
def doc_upsert(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    fresh = customer.filter("c_nationkey = 3").withColumn("c_name", F.lit("replaced"))
    return documents.upsert(customer, fresh, "c_custkey").select("c_custkey", "c_name")


@query("select user_id as _id, max(event_id) as event_id from events group by user_id")
def doc_last_write(spark, sf_dir):
    return documents.last_of_each(table(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), "event_id", F.col("event_id").alias("order")), "order").select("_id", "event_id")


# Graphs

_PAIRS = "(select a.user_id::varchar as src, b.user_id::varchar as dst from events a join events b on b.event_id = a.event_id + 1 where a.user_id <> b.user_id)"
_DENSE = f"dense as (select distinct src, dst from {_PAIRS})"
_NODES = "nodes as (select distinct user_id::varchar as id from events)"
_BOTH = "both_ways as (select src, dst from {0} union select dst, src from {0})"


def interactions(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and an edge from the user of each event to that of the next, if they differ."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"))
    after = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user").alias("next"))
    pairs = events.join(after, "event_id").filter("user <> next")
    definition = GraphDefinition("interactions", nodes=[NodeMapping("User", "events", "user")], edges=[EdgeMapping("NEXT", "pairs", "user", "next")])
    return model.build(definition, {"events": events, "pairs": pairs}, spark, count=False)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, suppliers, nations and regions, joined by their embedded keys."""
    name = lambda prefix, column: F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))
    held = {
        "customer": table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("at")),
        "supplier": table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("at")),
        "nation": table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("at")),
        "region": table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id")),
    }
    nodes = [NodeMapping(t, t.lower(), "id") for t in ("Customer", "Supplier", "Nation", "Region")]
    edges = [EdgeMapping("IN_NATION", "customer", "id", "at"), EdgeMapping("IN_NATION", "supplier", "id", "at"), EdgeMapping("IN_REGION", "nation", "id", "at")]
    return model.build(GraphDefinition("geo", heterogeneous=True, nodes=nodes, edges=edges), held, spark, count=False)


_GEO_NODES = "geo_nodes as (select 'c:' || c_custkey as id, 'Customer' as type from customer union all select 's:' || s_suppkey, 'Supplier' from supplier union all select 'n:' || n_nationkey, 'Nation' from nation union all select 'r:' || r_regionkey, 'Region' from region)"
_GEO_EDGES = "geo_edges as (select 'c:' || c_custkey as src, 'n:' || c_nationkey as dst, 'IN_NATION' as type from customer union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'IN_NATION' from supplier union all select 'n:' || n_nationkey, 'r:' || n_regionkey, 'IN_REGION' from nation)"


@query(f"with {_NODES} select id, 'User' as type, false as implicit from nodes")
def graph_nodes(spark, sf_dir):
    return interactions(spark, sf_dir).nodes.select("id", "type", "implicit")


@query(f"with {_DENSE} select src, dst, 'NEXT' as type, true as directed from dense")
def graph_edges(spark, sf_dir):
    return interactions(spark, sf_dir).edges.select("src", "dst", "type", "directed")


@query("select distinct l_orderkey::varchar as src, l_partkey::varchar as dst from lineitem")
def graph_unwind(spark, sf_dir):
    baskets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    mapping = EdgeMapping("HOLDS", "baskets", "l_orderkey", "part", unwind="parts", alias="part")
    definition = GraphDefinition("basket", nodes=[NodeMapping("Order", "baskets", "l_orderkey")], edges=[mapping])
    return model.build(definition, {"baskets": baskets}, spark, count=False).edges.select("src", "dst")


@query("select 'p' || l_partkey as id, true as implicit from lineitem group by 1 union all select 'o' || o_orderkey, false from orders")
def graph_implicit_nodes(spark, sf_dir):
    held = {
        "orders": table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")),
        "lineitem": table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("o"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p")),
    }
    definition = GraphDefinition("implicit", nodes=[NodeMapping("Order", "orders", "id")], edges=[EdgeMapping("HOLDS", "lineitem", "o", "p")])
    return model.build(definition, held, spark, count=False).nodes.select("id", "implicit")


@query(f"with {_DENSE} select least(src, dst) as low, greatest(src, dst) as high from dense group by 1, 2")
def graph_undirected(spark, sf_dir):
    edges = interactions(spark, sf_dir).edges.withColumn("directed", F.lit(False))
    return model.unique_edges(edges).select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))


@query("select c_custkey::varchar as id, 'Customer' as type from customer where c_acctbal > 0 union all select s_suppkey::varchar, 'Supplier' from supplier where s_suppkey not in (select c_custkey from customer where c_acctbal > 0)")
def graph_mapped_where(spark, sf_dir):
    nodes = [NodeMapping("Customer", "customer", "c_custkey", where=Leaf("c_acctbal", ">", 0)), NodeMapping("Supplier", "supplier", "s_suppkey")]
    held = {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}
    return model.build(GraphDefinition("shared", nodes=nodes), held, spark, count=False).nodes.select("id", "type")


@query(f"with {_GEO_NODES}, {_GEO_EDGES}, d as (select id, type, (select count(*) from geo_edges where dst = id) + (select count(*) from geo_edges where src = id) as total from geo_nodes) select (select count(*) from geo_nodes) as active_nodes, (select count(*) from geo_edges) as active_edges, count(*) filter (where total > 1024) as heavy_nodes from d")
def graph_stats(spark, sf_dir):
    return model.stats(geography(spark, sf_dir))


@query(f"with {_GEO_NODES}, {_GEO_EDGES} select src, dst, e.type from geo_edges e join geo_nodes a on src = a.id join geo_nodes b on dst = b.id where a.type in ('Nation', 'Region') and b.type in ('Nation', 'Region')")
def graph_snapshot(spark, sf_dir):
    return model.subgraph(geography(spark, sf_dir), ["Nation", "Region"]).edges.select("src", "dst", "type")


@query(f"with {_DENSE} select dst as id from dense where src = '0'")
def graph_neighbors(spark, sf_dir):
    return graphs.neighbors(interactions(spark, sf_dir), "0", "out")


@query(f"with {_DENSE} select count(*) > 0 as exists from dense where src = '0' and dst = '1'")
def graph_edge_exists(spark, sf_dir):
    return graphs.edge_exists(interactions(spark, sf_dir), "0", "1", "NEXT")


@query("select c_custkey::varchar as id, c_name from customer where c_custkey = 1")
def graph_get_node(spark, sf_dir):
    definition = GraphDefinition("people", nodes=[NodeMapping("Customer", "customer", "c_custkey", ["c_name"])])
    found = graphs.get_node(model.build(definition, {"customer": table(spark, sf_dir, "customer")}, spark, count=False), "1", "Customer")
    return found.select("id", F.get_json_object("props", "$.c_name").alias("c_name"))


@query(f"""with {_GEO_EDGES}, up as (select dst as id, src as below from geo_edges),
a as (select below as id, 1 as distance from up where id = 'r:1'), b as (select u.below as id, 2 as distance from up u join a on u.id = a.id)
select id, distance from a union all select id, distance from b""")
def graph_traverse(spark, sf_dir):
    return graphs.traverse(geography(spark, sf_dir), "r:1", "in", None, 2, 0)


def _bfs(start: str) -> str:
    """Distances either way from a node, up to the operators' twelve steps."""
    return f"""with recursive {_DENSE}, {_BOTH.format("dense")},
walk(id, distance) as (select '{start}', 0 union select dst, distance + 1 from walk join both_ways on src = id where distance < 12),
far as (select id, min(distance) as distance from walk group by id)"""


@query(f"{_bfs('0')} select id, distance from far where distance between 1 and 12")
def graph_neighborhood(spark, sf_dir):
    return algorithms.neighborhood(interactions(spark, sf_dir), "0", 12, 0)


@query(f"with {_DENSE}, {_NODES}, ids as (select id, row_number() over (order by id) - 1 as idx from nodes) select a.idx as src_idx, b.idx as dst_idx, 'NEXT' as edge_type, 0 as edge_type_id from dense join ids a on src = a.id join ids b on dst = b.id")
def graph_coo(spark, sf_dir):
    return graphs.export_coo(interactions(spark, sf_dir))[1]


@query(f"with {_DENSE}, {_NODES}, ids as (select id, row_number() over (order by id) - 1 as idx from nodes), d as (select idx, (select count(*) from dense where src = id) as degree from ids) select idx, coalesce(sum(degree) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start, degree from d")
def graph_csr(spark, sf_dir):
    return graphs.export_csr(interactions(spark, sf_dir))[0]


@query(f"with {_DENSE}, {_NODES}, ids as (select id, row_number() over (order by id) - 1 as idx from nodes) select row_number() over (order by a.idx, b.idx) - 1 as position, b.idx as dst_idx from dense join ids a on src = a.id join ids b on dst = b.id")
def graph_csr_columns(spark, sf_dir):
    return graphs.export_csr(interactions(spark, sf_dir))[1].select("position", "dst_idx")


# Algorithms


@query(f"with {_DENSE} select dst as id from dense where src = '0' and dst not in ('0', '1') intersect select dst from dense where src = '1'")
def algo_mutual_friends(spark, sf_dir):
    return algorithms.mutual_friends(interactions(spark, sf_dir), "0", "1", "NEXT")


@query(f"with {_DENSE}, {_BOTH.format('dense')} select dst as id from both_ways where src = '0'")
def algo_get_friends(spark, sf_dir):
    return algorithms.friends(interactions(spark, sf_dir), "0")


@query(f"""with {_DENSE}, {_BOTH.format("dense")}, direct as (select dst from both_ways where src = '0')
select b.dst as id, count(*) as mutual_friends from direct d join both_ways b on b.src = d.dst
where b.dst <> '0' and b.dst not in (select dst from direct) group by 1 order by 2 desc, 1 limit 10""")
def algo_friend_suggestion(spark, sf_dir):
    return algorithms.friend_suggestions(interactions(spark, sf_dir), "0")


@query(f"""with {_DENSE}, {_NODES} select id, 'User' as type, (select count(*) from dense where dst = id) as "in", (select count(*) from dense where src = id) as "out", (select count(*) from dense where dst = id or src = id) as total from nodes order by total desc, id limit 10""")
def algo_most_connected(spark, sf_dir):
    return algorithms.most_connected(interactions(spark, sf_dir), 10, "total", "User")


@query(f"""with {_DENSE}, {_NODES}, d as (select id, (select count(*) from dense where dst = id) as i, (select count(*) from dense where src = id) as o from nodes),
r as (select i + o as total, row_number() over (order by i + o) as turn, count(*) over () as n from d)
select count(*) as active_nodes, min(i + o) as min_degree, max(i + o) as max_degree, avg(i + o) as avg_degree, max(i) as max_in, max(o) as max_out, avg(o) as avg_out,
count(*) filter (where i + o = 0) as isolated_nodes, (select count(*) from dense) as active_edges, (select total from r where turn = n // 2 + 1) as median_degree,
round((select count(*) from dense)::double / (count(*) * (count(*) - 1)), 6) as density from d""")
def algo_network_stats(spark, sf_dir):
    return algorithms.network_stats(interactions(spark, sf_dir))


@query(f"with {_GEO_NODES}, {_GEO_EDGES} select 'node' as kind, type, count(*) as count from geo_nodes group by type union all select 'edge', type, count(*) from geo_edges group by type")
def algo_type_counts(spark, sf_dir):
    return algorithms.type_counts(geography(spark, sf_dir))


@query(f"{_bfs('0')} select count(*) > 0 as connected, coalesce(min(distance), -1) as hops from far where id = '1'")
def algo_are_connected(spark, sf_dir):
    return algorithms.are_connected(interactions(spark, sf_dir), "0", "1")


# From the start, always on to the least node that is a step nearer to the target.
@query(f"""{_bfs("1")}, way(id, hops, path) as (
  select id, distance, ['0'] from far where id = '0'
  union all select min(b.dst), w.hops - 1, list_append(any_value(w.path), min(b.dst))
  from way w join both_ways b on b.src = w.id join far f on f.id = b.dst and f.distance = w.hops - 1 group by w.hops)
select count(*) > 0 as found, coalesce(min(len(path)) - 1, -1)::int as hops, coalesce(min(array_to_string(path, '>')), '') as path from way where hops = 0""")
def algo_shortest_path(spark, sf_dir):
    found = algorithms.shortest_path(interactions(spark, sf_dir), "0", "1")
    return found.select("found", "hops", F.array_join("path", ">").alias("path"))


@query(f"""with recursive {_DENSE}, {_NODES}, {_BOTH.format("dense")},
reach(id, other) as (select id, id from nodes union select r.id, b.dst from reach r join both_ways b on b.src = r.other)
select id, min(other) as component from reach group by id""")
def algo_components(spark, sf_dir):
    return algorithms.components(interactions(spark, sf_dir))


@query(f"""with recursive {_DENSE}, {_NODES}, walk(id, distance) as (select '0', 0 union select dst, distance + 1 from walk join dense on src = id where distance < (select count(*) from nodes))
select '0' as source, id, min(distance)::int as distance from walk where id <> '0' group by id""")
def algo_distances(spark, sf_dir):
    return algorithms.all_distances(interactions(spark, sf_dir), "0")


#: Steps at which the SQL of all pairs stops; no two nodes of the tables that it runs on are that far apart.
_FARTHEST = 16


@query(f"""with recursive {_DENSE}, {_NODES}, walk(source, id, distance) as (select id, id, 0 from nodes union select source, dst, distance + 1 from walk join dense on src = id where distance < {_FARTHEST})
select source, id, min(distance) as distance from walk group by source, id having min(distance) > 0""")
def algo_distances_all(spark, sf_dir):
    return algorithms.all_distances(interactions(spark, sf_dir), everything=True)


def _propagated(rounds: int) -> str:
    parts = [f"with {_DENSE}", _NODES, "steps as (select src, dst from dense union all select dst, src from dense)", "l0 as (select id, id as community from nodes)"]
    for k in range(1, rounds + 1):
        votes = f"(select s.src as id, l.community from steps s join l{k - 1} l on l.id = s.dst union all select id, community from l{k - 1})"
        parts.append(f"l{k} as materialized (select id, community from (select id, community, row_number() over (partition by id order by count(*) desc, community) as turn from {votes} v group by id, community) x where turn = 1)")
    return ", ".join(parts) + f" select id, community from l{rounds}"


@query(_propagated(10))
def algo_communities(spark, sf_dir):
    return algorithms.communities(interactions(spark, sf_dir))


def _ranked(rounds: int) -> str:
    parts = [f"with {_DENSE}", _NODES, "outs as (select src, count(*) as outs from dense group by src)", "r0 as (select id, 1.0::double / count(*) over () as rank from nodes)"]
    for k in range(1, rounds + 1):
        lost = f"(select coalesce(sum(rank), 0) from r{k - 1} where id not in (select src from outs))"
        got = f"(select s.dst as id, sum(r.rank / o.outs) as got from dense s join r{k - 1} r on r.id = s.src join outs o on o.src = s.src group by s.dst)"
        parts.append(f"r{k} as materialized (select n.id, (0.15::double + 0.85::double * {lost}) / (select count(*) from nodes) + 0.85::double * coalesce(g.got, 0) as rank from nodes n left join {got} g on g.id = n.id)")
    return ", ".join(parts) + f" select id, round(rank, 6) as rank from r{rounds}"


@query(_ranked(20))
def algo_pagerank(spark, sf_dir):
    return algorithms.pagerank(interactions(spark, sf_dir)).select("id", F.round("rank", 6).alias("rank"))


# Shortest paths are counted level by level; a node's score is its share of the paths between all others.
@query(f"""with recursive {_DENSE}, {_NODES}, {_BOTH.format("dense")},
walk(s, t, d) as (select id, id, 0 from nodes union select s, dst, d + 1 from walk join both_ways on src = t where d < {_FARTHEST}),
far as materialized (select s, t, min(d) as d from walk group by s, t),
counted(s, t, d, n) as (
  select id, id, 0, 1.0::double from nodes
  union all select c.s, b.dst, c.d + 1, sum(c.n) from counted c join both_ways b on b.src = c.t join far f on f.s = c.s and f.t = b.dst and f.d = c.d + 1 group by c.s, b.dst, c.d),
ways as materialized (select s, t, d, n from counted),
score as (
  select a.t as id, sum(a.n * b.n / w.n) as score from ways a join ways b on b.s = a.t join ways w on w.s = a.s and w.t = b.t and w.d = a.d + b.d
  where a.s <> a.t and b.s <> b.t and a.s <> b.t group by a.t)
select id, round(coalesce(score, 0) / greatest(1, ((select count(*) from nodes) - 1) * ((select count(*) from nodes) - 2)), 6) as betweenness from nodes left join score using (id)""")
def algo_betweenness(spark, sf_dir):
    return algorithms.betweenness(interactions(spark, sf_dir)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query()
def algo_influence(spark, sf_dir):
    """Five seeds of twenty random cascades: the coins are beyond SQL; a test compares them with plain cascades."""
    return algorithms.influence(interactions(spark, sf_dir))


@query("select n_name, count(*) as orders, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def frame_aggregate(spark, sf_dir):
    """Collections are DataFrames: what the language has no words for, the DataFrame API has."""
    s = session(spark, sf_dir, orders="o_orderkey", customer="c_custkey", nation="n_nationkey")
    joined = s.collection("orders").join(s.collection("customer"), F.col("o_custkey") == F.col("c_custkey")).join(s.collection("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most connected users of the interaction graph: mappings, building, degrees and a top-k in one plan."""
    return algorithms.most_connected(interactions(spark, sf_dir), 10, "total", "User")
