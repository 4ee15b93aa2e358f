"""A small project over the TPC-H-like tables: sources, models, tests, settings and an exposure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracewell import schemas

SOURCES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}

#: name: (parents, SQL). The SQL runs in Spark and, but for the dialect of a few functions, in DuckDB.
MODELS: dict[str, tuple[list[str], str]] = {
    "stg_customer": (["customer"], "select c_custkey as customer_id, c_name as name, c_nationkey as nation_id, c_acctbal as balance, c_mktsegment as segment from customer"),
    "stg_orders": (["orders"], "select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as total, o_orderdate as order_date from orders"),
    "stg_lineitem": (["lineitem"], "select l_orderkey as order_id, l_extendedprice * (1 - l_discount) as revenue, l_quantity as quantity, l_shipdate from lineitem"),
    "stg_nation": (["nation"], "select * from nation"),
    "order_revenue": (["stg_lineitem"], "select order_id, sum(revenue) as revenue, count(*) as n_lines from stg_lineitem group by order_id"),
    "customer_mart": (
        ["stg_customer", "stg_nation", "stg_orders", "order_revenue"],
        "with o as (select customer_id, min(order_date) as first_order, max(order_date) as last_order, count(order_id) as n_orders from stg_orders group by customer_id), "
        "r as (select s.customer_id, sum(v.revenue) as lifetime_value from stg_orders s left join order_revenue v on s.order_id = v.order_id group by s.customer_id) "
        "select c.customer_id, c.name, upper(c.segment) as segment, n.n_name as nation, o.first_order, o.last_order, o.n_orders, coalesce(r.lifetime_value, 0) as lifetime_value, r.lifetime_value / o.n_orders as average_value "
        "from stg_customer c left join stg_nation n on c.nation_id = n.n_nationkey left join o on c.customer_id = o.customer_id left join r on c.customer_id = r.customer_id",
    ),
    "party_union": (["customer", "supplier"], "select c_name as name, 'customer' as kind from customer union all select s_name, 'supplier' from supplier"),
    "customer_rank": (["customer_mart"], "select customer_id, lifetime_value, row_number() over (partition by nation order by lifetime_value desc, customer_id) as rank_in_nation from customer_mart"),
    "order_flags": (["stg_orders"], "select order_id, status = 'F' as is_final, 'v1' as version, case when total > 100000 then 'big' else 'small' end as size_class, current_date() as loaded_on from stg_orders"),
    "orders_history": (["stg_orders"], "select order_id, status from orders_history union all select order_id, status from stg_orders"),
    "customer_active": (["stg_customer", "stg_orders"], "select customer_id, name from stg_customer c where exists (select 1 from stg_orders o where o.customer_id = c.customer_id)"),
    "customer_inactive": (["stg_customer", "stg_orders"], "select customer_id, name from stg_customer c where not exists (select 1 from stg_orders o where o.customer_id = c.customer_id)"),
}

#: Lineage read off the SQL by hand: (model, column, type, sources, union branches).
GOLDEN = [
    ("stg_customer", "customer_id", "renamed", "customer.c_custkey", ""),
    ("stg_customer", "name", "renamed", "customer.c_name", ""),
    ("stg_customer", "nation_id", "renamed", "customer.c_nationkey", ""),
    ("stg_customer", "balance", "renamed", "customer.c_acctbal", ""),
    ("stg_customer", "segment", "renamed", "customer.c_mktsegment", ""),
    ("stg_orders", "order_id", "renamed", "orders.o_orderkey", ""),
    ("stg_orders", "customer_id", "renamed", "orders.o_custkey", ""),
    ("stg_orders", "status", "renamed", "orders.o_orderstatus", ""),
    ("stg_orders", "total", "renamed", "orders.o_totalprice", ""),
    ("stg_orders", "order_date", "renamed", "orders.o_orderdate", ""),
    ("stg_lineitem", "order_id", "renamed", "lineitem.l_orderkey", ""),
    ("stg_lineitem", "revenue", "derived", "lineitem.l_discount,lineitem.l_extendedprice", ""),
    ("stg_lineitem", "quantity", "renamed", "lineitem.l_quantity", ""),
    ("stg_lineitem", "l_shipdate", "direct", "lineitem.l_shipdate", ""),
    ("stg_nation", "n_nationkey", "direct", "nation.n_nationkey", ""),
    ("stg_nation", "n_name", "direct", "nation.n_name", ""),
    ("stg_nation", "n_regionkey", "direct", "nation.n_regionkey", ""),
    ("order_revenue", "order_id", "direct", "stg_lineitem.order_id", ""),
    ("order_revenue", "revenue", "aggregate", "stg_lineitem.revenue", ""),
    ("order_revenue", "n_lines", "aggregate", "", ""),
    ("customer_mart", "customer_id", "direct", "stg_customer.customer_id", ""),
    ("customer_mart", "name", "direct", "stg_customer.name", ""),
    ("customer_mart", "segment", "derived", "stg_customer.segment", ""),
    ("customer_mart", "nation", "renamed", "stg_nation.n_name", ""),
    ("customer_mart", "first_order", "aggregate", "stg_orders.order_date", ""),
    ("customer_mart", "last_order", "aggregate", "stg_orders.order_date", ""),
    ("customer_mart", "n_orders", "aggregate", "stg_orders.order_id", ""),
    ("customer_mart", "lifetime_value", "derived", "order_revenue.revenue", ""),
    ("customer_mart", "average_value", "derived", "order_revenue.revenue,stg_orders.order_id", ""),
    ("party_union", "name", "union", "", "customer.c_name,supplier.s_name"),
    ("party_union", "kind", "union", "", ""),
    ("customer_rank", "customer_id", "direct", "customer_mart.customer_id", ""),
    ("customer_rank", "lifetime_value", "direct", "customer_mart.lifetime_value", ""),
    ("customer_rank", "rank_in_nation", "window", "", ""),
    ("order_flags", "order_id", "direct", "stg_orders.order_id", ""),
    ("order_flags", "is_final", "derived", "stg_orders.status", ""),
    ("order_flags", "version", "literal", "", ""),
    ("order_flags", "size_class", "derived", "stg_orders.total", ""),
    ("order_flags", "loaded_on", "generated", "", ""),
    ("orders_history", "order_id", "direct", "stg_orders.order_id", ""),
    ("orders_history", "status", "direct", "stg_orders.status", ""),
    ("customer_active", "customer_id", "direct", "stg_customer.customer_id", ""),
    ("customer_active", "name", "direct", "stg_customer.name", ""),
    ("customer_inactive", "customer_id", "direct", "stg_customer.customer_id", ""),
    ("customer_inactive", "name", "direct", "stg_customer.name", ""),
]

#: (model, column): (declared type, description, tags, meta). Columns that aren't here are declared without text.
DECLARED = {
    ("customer", "c_custkey"): ("bigint", "Number of the customer", ["key"], {"owner": "crm"}),
    ("customer", "c_name"): ("string", "Full name of the customer", ["pii"], {"owner": "crm"}),
    ("customer", "c_nationkey"): ("int", "", [], {}),
    ("customer", "c_acctbal"): ("double", "Balance of the account", [], {"unit": "eur"}),
    ("customer", "c_mktsegment"): ("string", "Market segment", [], {}),
    ("supplier", "s_name"): ("string", "Full name of the supplier", ["pii"], {}),
    ("orders", "o_orderkey"): ("bigint", "Number of the order", ["key"], {"owner": "sales"}),
    ("orders", "o_orderstatus"): ("string", "Status: F, O or P", [], {"owner": "sales"}),
    ("orders", "o_orderdate"): ("timestamp", "Day of the order", [], {}),
    ("nation", "n_name"): ("string", "Name of the nation", ["geo"], {}),
    ("nation", "n_nationkey"): ("int", "Number of the nation", ["key"], {}),
    ("stg_customer", "customer_id"): ("bigint", "", ["core"], {"desc-owner": "upstream"}),
    ("stg_customer", "name"): ("string", "Not documented", [], {}),
    ("stg_customer", "segment"): ("string", "Segment of the customer, as marketing sees it", [], {"owner": "marketing"}),
    ("stg_orders", "order_id"): ("bigint", "Key of the order in the shop", [], {}),
    ("stg_orders", "status"): ("string", "", ["enum"], {}),
    ("stg_nation", "n_name"): ("string", "", ["core"], {"owner": "geo"}),
    ("stg_nation", "n_nationkey"): ("int", "Number of  the NATION", [], {}),
    ("customer_mart", "customer_id"): ("bigint", "", [], {}),
    ("customer_mart", "name"): ("string", "", [], {"renamed_from": "OLD.NAME"}),
    ("customer_mart", "segment"): ("string", "", [], {}),
    ("customer_mart", "n_orders"): ("int", "How many orders the customer has made\n\n__________\nTRACEWELL -> Aggregated here", [], {}),
    ("customer_mart", "lifetime_value"): ("double", "Revenue of all orders", ["kpi"], {}),
    ("customer_rank", "lifetime_value"): ("double", "", [], {"desc-owner": "upstream"}),
    ("customer_active", "name"): ("string", "Renamed from: OLD.TABLE", [], {}),
    ("order_flags", "order_id"): ("bigint", "", [], {}),
    ("orders_history", "order_id"): ("bigint", "An older text", [], {"desc-owner": "upstream"}),
    ("order_revenue", "order_id"): ("bigint", "", [], {}),
}

DESCRIPTIONS = {
    "customer": "Customers as the CRM system has them", "orders": "This is a table of orders", "stg_customer": "Staged customers", "stg_orders": "Orders with one row for each order",
    "customer_mart": "One row for each customer, with figures of their orders", "order_revenue": "Undefined", "order_flags": "contains data of order flags",
}

TESTS = [
    ("stg_customer", "customer_id", "unique", {}), ("stg_customer", "customer_id", "not_null", {}), ("stg_orders", "order_id", "unique", {}), ("stg_orders", "order_id", "not_null", {}),
    ("stg_orders", "customer_id", "relationships", {"to": "stg_customer", "field": "customer_id"}), ("stg_orders", "status", "accepted_values", {"values": "F,O,P"}),
    ("customer_mart", "customer_id", "unique", {}), ("customer_mart", "first_order", "not_null", {}), ("order_revenue", "revenue", "not_null", {}), ("order_flags", "is_final", "not_null", {}),
]

GLOSSARY = [("l_shipdate", "Day the goods left"), ("segment", "Market segment of a customer")]

#: (scope, node, column, rank, key, value); rank as in operators.settings.RANKS.
SETTINGS = [
    ("node", "stg_nation", None, 4, "annotate-origins", "always"), ("node", "customer_mart", None, 5, "annotate-origins", "if_altered"), ("column", "customer_mart", "nation", 1, "inherit-through-renames", "true"),
    ("node", "customer_mart", None, 7, "annotate-origins", "never"), ("column", "customer_mart", "nation", 3, "inherit-through-renames", "false"), ("node", "stg_customer", None, 8, "output-to-lower", "true"),
    ("node", "stg_customer", None, 6, "inherit-through-renames", "true"), ("node", "stg_orders", None, 8, "annotate-origins", "if_altered"),
]


def uid(name: str) -> str:
    return f"source.shop.{name}" if name in SOURCES else f"model.shop.{name}"


def columns_of(name: str) -> list[str]:
    return SOURCES[name] if name in SOURCES else [c for m, c, *_ in GOLDEN if m == name]


def declared(name: str) -> list[str]:
    """Declared columns: all of a source; of a model those that DECLARED has, and all of stg_nation and the marts."""
    full = name in SOURCES or name in ("stg_nation", "stg_customer", "stg_orders", "customer_mart", "party_union", "customer_rank", "order_flags", "orders_history", "customer_active", "order_revenue")
    return columns_of(name) if full else [c for m, c in DECLARED if m == name]


@dataclass
class Project:
    nodes: DataFrame
    columns: DataFrame
    exposures: DataFrame
    tests: DataFrame
    settings: DataFrame
    glossary: DataFrame


def load(spark: SparkSession) -> Project:
    names = [*SOURCES, *MODELS]
    nodes = []
    for i, n in enumerate(names):
        source = n in SOURCES
        layer = "sources" if source else "staging" if n.startswith("stg_") else "marts"
        parents = [] if source else [uid(p) for p in MODELS[n][0]]
        nodes.append((uid(n), n, n, "source" if source else "model", "shop", "main", "raw" if source else "shop", "sql", None if source else "view", None if source else f"models/{layer}/{n}.sql", None if source or n.startswith("customer_in") else f"shop://models/{layer}/schema.yml", ["shop", layer, n], DESCRIPTIONS.get(n, ""), [layer], {}, {}, None if source else MODELS[n][1], None if source else MODELS[n][1], parents, "raw" if source else None, i))
    columns = []
    for n in names:
        for i, c in enumerate(declared(n)):
            kind, text, tags, meta = DECLARED.get((n, c), (None, "", [], {}))
            columns.append((uid(n), n, c, i, kind, text, tags, meta, {}))
    exposures = [("revenue_dashboard", "dashboard", "https://bi.example.com/revenue", "Revenue by customer", {"name": "sales"}, [uid("customer_mart")])]
    tests = [(uid(m), c, t, k, [uid(m)]) for m, c, t, k in TESTS]
    return Project(
        spark.createDataFrame(nodes, schemas.NODES),
        spark.createDataFrame(columns, schemas.COLUMNS),
        spark.createDataFrame(exposures, schemas.EXPOSURES),
        spark.createDataFrame(tests, schemas.TESTS),
        spark.createDataFrame([(s, uid(n), c, r, k, v) for s, n, c, r, k, v in SETTINGS], schemas.SETTINGS),
        spark.createDataFrame(GLOSSARY, schemas.GLOSSARY),
    )
