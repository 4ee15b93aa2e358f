"""Further driver queries: operators over small metadata whose results are written down by hand, and one graph as large as the tables."""

from __future__ import annotations

import os
import tempfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import sample_project as sp
from tracewell import schemas
from tracewell.functions import text as tx
from tracewell.operators import annotate, assembly, diff, display, generate, graph, health, inherit, lint, reconcile, routing, select, settings, sql, validate, workflows
from tracewell.plans.lineage import Column, LineageParser, apply_placeholders, cte_tables
from tracewell.plans.reader import PlanReader, strip_comments
from tracewell.queries import DESCRIBED, LINKS, NODES, actual_columns, facts, lit, load, query, register, values
from tracewell.sources import catalog, files, manifest
from tracewell.storage import cut


def golden(columns: str, rows: list[tuple]):
    """A query whose result is written down: as DuckDB VALUES, or none of its rows where there are none."""
    if rows:
        return query(f"SELECT * FROM {values(rows, columns)}")
    return query(f"SELECT {', '.join(f'NULL AS {c.strip()}' for c in columns.split(','))} WHERE FALSE")


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Rows of texts, whole numbers and truth values as a DataFrame, types by the first row."""
    kinds = {str: "string", int: "int", bool: "boolean", float: "double", type(None): "string"}
    names = [c.strip() for c in columns.split(",")]
    types = [next((kinds[type(r[i])] for r in rows if r[i] is not None), "string") for i in range(len(names))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


# Lineage of single statements: (case, column, type, sources, branches); star sources as the column "*", with what they leave out.
LINEAGE = "case_name, column_name, kind, sources, branches"


def traced(spark: SparkSession, cases: dict[str, str], hints: dict[str, set[str]] | None = None, dialect: str | None = None, **how) -> DataFrame:
    parser = LineageParser(PlanReader(spark, dialect), hints or {}, **how)
    rows = []
    for case, text in cases.items():
        found = parser.parse(text)
        rows += [(case, c, x.kind, ",".join(sorted(x.sources)), ",".join(x.branches)) for c, x in found.columns.items()]
        rows += [(case, "*", "star", t, ",".join(sorted(e))) for t, e in found.star_sources]
        rows += [(f"{case}/{m}", c, x.kind, ",".join(sorted(x.sources)), ",".join(x.branches)) for m, cols in found.ephemeral.items() for c, x in cols.items()]
    return frame(spark, LINEAGE, rows)


def lineage_case(name: str, cases: dict[str, str], rows: list[tuple], **how) -> None:
    def run(spark, sf_dir):
        return traced(spark, cases, **how)

    run.__name__ = f"lineage_{name}"
    golden(LINEAGE, rows)(run)


lineage_case("unqualified", {"hint": "select a, b from t join u on t.i = u.i", "first": "select x from t, u"}, [("hint", "a", "direct", "t.a", ""), ("hint", "b", "direct", "u.b", ""), ("first", "x", "direct", "t.x", "")], hints={"t": {"a"}, "u": {"b"}})
lineage_case("star_except", {"except": "select * except (a, b) from t", "exclude": "select * exclude (a) from t", "one": "select t.* exclude a from t"}, [("except", "*", "star", "t", "a,b"), ("exclude", "*", "star", "t", "a"), ("one", "*", "star", "t", "a")])
lineage_case("star_join", {"both": "select * from t join u on t.i = u.i", "one": "select u.*, t.x from t join u on t.i = u.i"}, [("both", "*", "star", "t", ""), ("both", "*", "star", "u", ""), ("one", "*", "star", "u", ""), ("one", "x", "direct", "t.x", "")])
lineage_case("star_cte", {"one": "with c as (select a, b as z from t) select * from c", "deep": "with c as (select * from t), d as (select * from c) select * from d", "in": "with c as (select *, a + b as s from t) select s, k from c"}, [("one", "a", "direct", "t.a", ""), ("one", "z", "renamed", "t.b", ""), ("deep", "*", "star", "t", ""), ("in", "s", "derived", "t.a,t.b", ""), ("in", "k", "direct", "t.k", "")])
lineage_case("star_pivot", {"pivot": "select * from t pivot (sum(x) for k in ('a' as aa, 'b' as bb))", "two": "select * from t pivot (sum(x) as s, max(y) as m for k in ('a' as aa))", "unpivot": "select * from t unpivot (v for n in (a, b))"}, [("pivot", "*", "star", "t", "k,x"), ("pivot", "aa", "aggregate", "t.x", ""), ("pivot", "bb", "aggregate", "t.x", ""), ("two", "*", "star", "t", "k,x,y"), ("two", "aa_s", "aggregate", "t.x", ""), ("two", "aa_m", "aggregate", "t.y", ""), ("unpivot", "*", "star", "t", "a,b"), ("unpivot", "n", "generated", "", ""), ("unpivot", "v", "derived", "t.a,t.b", "")])
lineage_case("set_branches", {"three": "select a from t union all (select b from u union all select c from v)", "cte": "with c as (select a from t union select b from u) select a from c union all select d from w", "except": "select a from t except select b from u", "intersect": "select a from t intersect select b from u"}, [("three", "a", "union", "", "t.a,u.b,v.c"), ("cte", "a", "union", "", "t.a,u.b,w.d"), ("except", "a", "direct", "t.a", ""), ("intersect", "a", "direct", "t.a", "")])
lineage_case("unwrapped_select", {"sub": "select q.a, q.n from (select a, count(*) as n from t group by a) q", "nested": "select z from (select y as z from (select x as y from t) i) o"}, [("sub", "a", "direct", "t.a", ""), ("sub", "n", "aggregate", "", ""), ("nested", "z", "renamed", "t.x", "")])
lineage_case("ephemeral_stop", {"m": "with __dbt__cte__e as (select a, b as c from t) select a, c as d from __dbt__cte__e"}, [("m", "a", "direct", "__dbt__cte__e.a", ""), ("m", "d", "renamed", "__dbt__cte__e.c", ""), ("m/__dbt__cte__e", "a", "direct", "t.a", ""), ("m/__dbt__cte__e", "c", "renamed", "t.b", "")], stop_at_ephemeral=True)
lineage_case("scoped_alias", {"inner": "select x.a from t x where exists (select 1 from u x where x.b = 1)", "cte": "with c as (select x.a from t x), d as (select x.b from u x) select c.a, d.b from c join d on c.a = d.b"}, [("inner", "a", "direct", "t.a", ""), ("cte", "a", "direct", "t.a", ""), ("cte", "b", "direct", "u.b", "")])
lineage_case("merge_insert", {"insert": "insert into o select a, b as c from t", "merge": "merge into o using (select a, b from t) s on o.a = s.a when matched then update set b = s.b"}, [("insert", "a", "direct", "t.a", ""), ("insert", "c", "renamed", "t.b", ""), ("merge", "a", "direct", "t.a", ""), ("merge", "b", "direct", "t.b", "")])
lineage_case("tsql", {"top": "select top 3 [a], [my col] as b from [dbo].[t]", "percent": "select top (5) percent x.[a] from t as x"}, [("top", "a", "direct", "t.a", ""), ("top", "b", "renamed", "t.my col", ""), ("percent", "a", "direct", "t.a", "")], dialect="tsql")
lineage_case("snowflake", {"quoted": 'select "a", t."b" as c from "t"', "qualify": "select a, row_number() over (partition by b order by c) as n from t qualify n = 1", "cast": "select a::int as i from t"}, [("quoted", "a", "direct", "t.a", ""), ("quoted", "c", "renamed", "t.b", ""), ("qualify", "a", "direct", "t.a", ""), ("qualify", "n", "window", "", ""), ("cast", "i", "derived", "t.a", "")], dialect="snowflake")
lineage_case("handlers", {"own": "select cast(a as int) as i, b from t"}, [("own", "i", "literal", "handled", ""), ("own", "b", "direct", "t.b", "")], handlers={"Cast": lambda parser, e, scope, aliases: Column("literal", frozenset({"handled"}))})


@golden("case_name, out", [("block", "select a from t"), ("line", "select a, b"), ("text", "select '--kept' as c"), ("placeholder", "select TRUE from t"), ("ephemeral", "select __dbt__x from t")])
def text_of_statements(spark, sf_dir):
    rows = [("block", strip_comments("select /* x */ a\n from t")), ("line", strip_comments("select a, -- b\n b")), ("text", strip_comments("select '--kept' as c")), ("placeholder", apply_placeholders("select __ph_1__ from t", [r"__\w+__\w*|__ph_\d+__"])), ("ephemeral", apply_placeholders("select __dbt__x from t", [r"__\w+"]))]
    return frame(spark, "case_name, out", rows)


@golden("cte, table_name", [("c", "t"), ("d", "t"), ("e", "u")])
def lineage_cte_tables(spark, sf_dir):
    found = cte_tables(PlanReader(spark).parse("with c as (select * from t), d as (select * from c join u on c.i = u.i), e as (select x from (select x from u) q) select * from d"))
    return frame(spark, "cte, table_name", sorted(found.items()))


# Artifacts.
ARTIFACT = {
    "metadata": {"project_name": "p"},
    "nodes": {
        "model.p.a": {"name": "a", "resource_type": "model", "package_name": "p", "compiled_code": "select id from raw", "depends_on": {"nodes": ["source.p.s.raw"]}, "columns": {"ID": {"data_type": "int", "type": "bigint", "description": "Key"}}, "config": {"access": "public"}},
        "model.p.A2": {"name": "A", "resource_type": "model", "package_name": "p", "depends_on": {"nodes": ["model.p.a", "seed.p.x"]}, "columns": {}},
        "seed.p.x": {"name": "x", "resource_type": "seed", "package_name": "p", "columns": {"k": {"type": "string"}}},
        "test.p.t": {"name": "t", "resource_type": "test", "test_metadata": {"name": "unique"}, "column_name": "ID", "attached_node": "model.p.a"},
        "test.p.u": {"name": "u", "resource_type": "test", "test_metadata": {"name": "not_null"}, "column_name": "id", "depends_on": {"nodes": ["model.p.a"]}},
    },
    "sources": {"source.p.s.raw": {"name": "raw_table", "identifier": "RAW", "source_name": "s", "database": "db", "schema": "Sch", "columns": {}}},
    "exposures": {"exposure.p.e": {"name": "e", "type": "dashboard", "depends_on": {"nodes": ["model.p.a", "model.p.A2"]}}},
}


@golden("unique_id, name, lookup_name, kind, has_sql", [("model.p.a", "a", "a", "model", True), ("model.p.A2", "A", "a", "model", False), ("seed.p.x", "x", "x", "seed", False), ("source.p.s.raw", "raw_table", "raw", "source", False)])
def manifest_nodes(spark, sf_dir):
    return manifest.Manifest(ARTIFACT).nodes(spark).select("unique_id", "name", "lookup_name", F.col("resource_type").alias("kind"), F.col("compiled_sql").isNotNull().alias("has_sql"))


@golden("key, unique_id", [("first", "model.p.a"), ("last", "model.p.A2")])
def manifest_names(spark, sf_dir):
    n = manifest.Manifest(ARTIFACT).nodes(spark)
    return manifest.first_by_name(n).where("lower(name) = 'a'").select(F.lit("first").alias("key"), "unique_id").union(manifest.last_by_lookup_name(n).where("lookup_name = 'a'").select(F.lit("last").alias("key"), "unique_id"))


@golden("parent, children, seeds", [("raw", "a", False), ("a", "a", False), ("raw", "a", True), ("a", "a", True), ("x", "a", True)])
def manifest_downstream(spark, sf_dir):
    n = manifest.Manifest(ARTIFACT).nodes(spark)
    view = lambda seeds: manifest.downstream(n, seeds).select("parent", F.array_join("children", ",").alias("children"), F.lit(seeds).alias("seeds"))
    return view(False).union(view(True))


@golden("prefer, column_name, data_type", [("data_type", "id", "int"), ("data_type", "k", "string"), ("type", "id", "bigint"), ("type", "k", "string")])
def manifest_columns(spark, sf_dir):
    m = manifest.Manifest(ARTIFACT)
    view = lambda p: m.columns(spark, p).select(F.lit(p).alias("prefer"), F.col("column").alias("column_name"), "data_type")
    return view("data_type").union(view("type"))


@golden("unique_id, column_name, test_name", [("model.p.a", "id", "unique"), ("model.p.a", "id", "not_null")])
def manifest_tests(spark, sf_dir):
    m = manifest.Manifest(ARTIFACT)
    return manifest.tests_of(m.nodes(spark), m.tests(spark)).select("unique_id", F.col("column").alias("column_name"), "test_name")


@golden("unique_id, exposure", [("model.p.a", "e"), ("model.p.A2", "e")])
def manifest_exposures(spark, sf_dir):
    return manifest.exposure_models(manifest.Manifest(ARTIFACT).exposures(spark))


@golden("unique_id", [("model.q.z",), ("model.p.a",)])
def manifest_foreign_nodes(spark, sf_dir):
    own = manifest.Manifest({"nodes": {"model.q.z": {"name": "z", "resource_type": "model"}}}).nodes(spark)
    return manifest.with_foreign_nodes(own, manifest.Manifest(ARTIFACT).nodes(spark)).select("unique_id")


@golden("what, value", [("inline", "True"), ("sql", "select id from raw"), ("disk", "select 2"), ("version", "13"), ("newer", "True"), ("nested", "True"), ("type", "NUMBER"), ("glossary", "Key"), ("rename_threshold", "90.0"), ("annotate", "always"), ("other", "1"), ("managed", "models,version"), ("preserved", "macros")])
def artifacts_from_files(spark, sf_dir):
    with tempfile.TemporaryDirectory() as at:
        write = lambda name, text: open(os.path.join(at, name), "w", encoding="utf-8").write(text)
        os.makedirs(os.path.join(at, "compiled", "p"))
        write("manifest.json", '{"metadata": {"schema": "x/manifest/v13.json"}}')
        write("compiled/p/b.sql", "select 2\n")
        write("catalog.json", '{"nodes": {"model.p.a": {"columns": {"ID": {"type": "NUMBER", "index": 1}}}}}')
        write("g.yml", "ID: ' Key '\nempty: ''\n")
        write(".tracewell", "[tracewell]\nrename-threshold = 90\nannotate = always\nother = 1\n")
        write("s.yml", "version: 2\nmodels: []\nmacros: []\n")
        m, path = manifest.Manifest(ARTIFACT, at), os.path.join(at, "manifest.json")
        c, (managed, kept) = files.EngineConfig.load(os.path.join(at, ".tracewell")), files.read_schema_file(os.path.join(at, "s.yml"))
        rows = [("inline", m.has_inline_sql()), ("sql", m.compiled_sql("A", "model.p.a")), ("disk", m.compiled_sql_from_disk({"package_name": "p", "path": "b.sql"})), ("version", manifest.schema_version(path)), ("newer", manifest.is_newer_engine(path)), ("nested", manifest.nested_config(None, "1.9.6"))]
        rows += [("type", manifest.catalog_types(spark, os.path.join(at, "catalog.json")).head().data_type), ("glossary", files.read_glossary(spark, os.path.join(at, "g.yml")).head().description), ("rename_threshold", c.rename_threshold), ("annotate", c.annotate), ("other", c.unknown["other"]), ("managed", ",".join(sorted(managed))), ("preserved", ",".join(kept))]
    return frame(spark, "what, value", [(k, str(v)) for k, v in rows])


# Graphs.
_TABLES = {"lineitem": ("l_orderkey", "orders", None), "orders": ("o_custkey", "customer", "o_orderkey"), "customer": ("c_nationkey", "nation", "c_custkey"), "supplier": ("s_nationkey", "nation", "s_suppkey"), "nation": ("n_regionkey", "region", "n_nationkey")}
_LINKED = [("orders", "o_orderkey", "supplier", "l_suppkey", "lineitem"), ("orders", "o_orderkey", "customer", "o_custkey", "orders"), ("customer", "c_custkey", "nation", "c_nationkey", "customer"), ("supplier", "s_suppkey", "nation", "s_nationkey", "supplier"), ("nation", "n_nationkey", "region", "n_regionkey", "nation")]
_E = " UNION ".join(f"SELECT '{m}' AS cm, CAST({'l_orderkey' if t == 'lineitem' else c} AS VARCHAR) AS cc, '{p}' AS pm, CAST({k} AS VARCHAR) AS pc FROM {t}" for m, c, p, k, t in _LINKED)


def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables as a graph: an order comes from its suppliers and its customer, these from nations, those from regions. An order has an edge for each of its lines."""
    out = None
    for m, c, p, k, t in _LINKED:
        own = "l_orderkey" if t == "lineitem" else c
        e = load(spark, sf_dir, t).select(F.lit(m).alias("child_model"), F.col(own).cast("string").alias("child_column"), F.lit(p).alias("parent_model"), F.col(k).cast("string").alias("parent_column"))
        out = e if out is None else out.union(e)
    return out


@query(f"WITH RECURSIVE e AS ({_E}), w AS (SELECT cm AS root_model, cc AS root_column, pm AS model, pc AS column_name, 1 AS depth FROM e UNION SELECT w.root_model, w.root_column, e.pm, e.pc, w.depth + 1 FROM w JOIN e ON e.cm = w.model AND e.cc = w.column_name) SELECT root_model, root_column, model, column_name, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL")
def closure_of_rows(spark, sf_dir):
    return graph.closure(row_edges(spark, sf_dir)).withColumnRenamed("column", "column_name")


@query(f"WITH e AS ({_E}), n AS (SELECT DISTINCT m || ':' || c AS unique_id, m FROM (SELECT cm AS m, cc AS c FROM e UNION SELECT pm, pc FROM e)), d AS (SELECT unique_id, CASE m WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'orders' THEN 3 ELSE 2 END AS depth FROM n) SELECT unique_id, CAST(depth AS INTEGER) AS depth FROM d")
def depth_of_rows(spark, sf_dir):
    e = row_edges(spark, sf_dir).select(F.concat_ws(":", "parent_model", "parent_column").alias("parent_uid"), F.concat_ws(":", "child_model", "child_column").alias("child_uid"))
    nodes = e.select(F.col("parent_uid").alias("unique_id")).union(e.select("child_uid")).distinct()
    return graph.depths(nodes, e)


_DIAMONDS = [(f"d{i}", c, f"d{i - 1}", p) for i in range(1, 31) for c in "ab" for p in "ab"]
_CYCLE = [("x", "c", "y", "c"), ("y", "c", "z", "c"), ("z", "c", "x", "c")]


@query("SELECT * FROM (SELECT 'd' || i AS root, CAST(4 * i AS BIGINT) AS n, CAST(i AS INTEGER) AS depth FROM range(1, 31) r(i) UNION ALL SELECT k, 3, 3 FROM (VALUES ('x'), ('y'), ('z')) v(k))")
def closure_of_hard_graphs(spark, sf_dir):
    """30 diamonds in a row (both columns of a model counted together), and a cycle."""
    e = spark.createDataFrame(_DIAMONDS + _CYCLE, "child_model string, child_column string, parent_model string, parent_column string")
    return graph.closure(e).groupBy(F.col("root_model").alias("root")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@golden("model, column_name, reason", [("x", "c", "cycle"), ("y", "c", "cycle")])
def lineage_soft_failures(spark, sf_dir):
    rows = [("x", "c", "y"), ("y", "c", "x"), ("a", "c", "b"), ("b", "c", None)]
    flags = [F.lit(False).alias(f"is_{k}") for k in ("union", "aggregate", "window", "literal", "generated", "computed")]
    df = spark.createDataFrame(rows, "model string, column string, progenitor_model string").select("model", "column", "progenitor_model", F.when(F.col("progenitor_model").isNotNull(), "c").alias("progenitor_column"), *flags)
    return graph.soft_failures(df, max_depth=8).withColumnRenamed("column", "column_name")


@query("SELECT parent, name, kind FROM (VALUES ('', 'models', 'folder'), ('models', 'staging', 'folder'), ('models', 'marts', 'folder')) v(parent, name, kind) UNION ALL SELECT 'models/' || CASE WHEN name LIKE 'stg%' THEN 'staging' ELSE 'marts' END, name || '.sql', 'model' FROM " + NODES + " WHERE nodes.kind = 'model' UNION ALL SELECT 'sources/raw', name, 'source' FROM " + NODES + " WHERE nodes.kind = 'source'")
def folder_tree(spark, sf_dir):
    return graph.folder_tree(facts(spark).project.nodes).select("parent", "name", "kind")


@golden("direction, model, column_name, depth", [("upstream", "stg_orders", "order_date", 1), ("upstream", "orders", "o_orderdate", 2)])
def column_info(spark, sf_dir):
    f = facts(spark)
    return graph.column_info(f.edges, f.lineage, "customer_mart", "first_order").withColumnRenamed("column", "column_name")


@query(f"SELECT n.unique_id FROM {NODES.replace('AS nodes', 'AS n')} WHERE kind = 'model' AND (name IN ('customer_rank', 'stg_orders') OR name LIKE 'stg%')")
def select_by_file(spark, sf_dir):
    return select.by_file(facts(spark).project.nodes, ["models/staging", "customer_rank", "models/staging/stg_orders.sql"]).select("unique_id")


@golden("how, unique_id", [("full", "model.shop.stg_nation"), ("text", "model.shop.order_flags"), ("model", "party_union.kind"), ("model", "party_union.name"), ("column", "n_name"), ("column", "n_regionkey")])
def select_other_ways(spark, sf_dir):
    f = facts(spark)
    n = f.project.nodes
    parts = [select.by_full_fqn(n, "shop.staging.stg_nation").select(F.lit("full").alias("how"), "unique_id"), select.by_fqn_text(n, "order_fl").select(F.lit("text"), "unique_id"), select.by_models(f.rows, ["PARTY_UNION"]).select(F.lit("model"), F.concat_ws(".", "model", "column")), select.without_columns(f.project.columns.where("model = 'stg_nation'"), ("^n_nationkey$",)).select(F.lit("column"), "column")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"SELECT unique_id, CAST(n AS INTEGER) AS n_parents_before FROM (SELECT nodes.unique_id, (SELECT count(*) FROM {LINKS} WHERE links.child_uid = nodes.unique_id) AS n FROM {NODES})")
def topological_order(spark, sf_dir):
    """How many of its parents come before each node in the order: all of them."""
    f = facts(spark)
    order = graph.topological(f.project.nodes, f.node_edges).select("unique_id", F.monotonically_increasing_id().alias("at"))
    before = f.node_edges.join(order.select(F.col("unique_id").alias("child_uid"), F.col("at").alias("c")), "child_uid").join(order.select(F.col("unique_id").alias("parent_uid"), F.col("at").alias("p")), "parent_uid").where("p < c").groupBy(F.col("child_uid").alias("unique_id")).agg(F.count("*").alias("n"))
    return f.project.nodes.select("unique_id").join(before, "unique_id", "left").select("unique_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_parents_before"))


# Assembly.
@golden("model, column_name", [("order_revenue", "revenue"), ("order_revenue", "n_lines"), ("stg_lineitem", "order_id"), ("stg_lineitem", "revenue"), ("stg_lineitem", "quantity"), ("stg_lineitem", "l_shipdate")])
def stub_columns(spark, sf_dir):
    f = facts(spark)
    some = f.project.columns.where("model IN ('order_revenue', 'stg_lineitem')").where("column = 'order_id' AND model = 'order_revenue'")
    every = assembly.with_stub_columns(some, f.lineage.where("model IN ('order_revenue', 'stg_lineitem')"))
    return every.join(some.select("unique_id", "column"), ["unique_id", "column"], "left_anti").select("model", F.col("column").alias("column_name"))


@golden("model, column_name, progenitor, derived, renamed, begins, other_flags", [("e", "a", "t.a", False, False, True, 0), ("e", "c", "t.b", False, True, True, 0), ("e", "n", None, False, False, True, 0), ("e", "s", None, True, False, False, 0)])
def ephemeral_rows(spark, sf_dir):
    text = "with __dbt__cte__e as (select a, b as c, count(*) as n, a + b as s from t group by a, b) select a from __dbt__cte__e"
    m = manifest.Manifest({"nodes": {"model.p.m": {"name": "m", "resource_type": "model", "compiled_code": text, "depends_on": {"nodes": ["source.p.s.t"]}}}, "sources": {"source.p.s.t": {"name": "t"}}})
    n, c = m.nodes(spark), m.columns(spark)
    rows = assembly.public_rows(assembly.parse_models(spark, n, c, stop_at_ephemeral=True).lineage, n, include_ephemeral=True).where("model = 'e'")
    others = sum((F.col(f"is_{k}").cast("int") for k in ("aggregate", "window", "literal", "union", "generated")), F.lit(0))
    return rows.select("model", F.col("column").alias("column_name"), F.concat_ws(".", "progenitor_model", "progenitor_column").alias("p"), F.col("is_computed").alias("derived"), F.col("is_rename").alias("renamed"), F.col("is_first_in_chain").alias("begins"), others.alias("other_flags")).withColumn("progenitor", F.nullif("p", F.lit(""))).drop("p")


@golden("path", [("a.sql",), ("c.sql",)])
def stale_models(spark, sf_dir):
    nodes = frame(spark, "unique_id, name, path", [(p, p, p) for p in ("a.sql", "b.sql", "c.sql")])
    return assembly.stale_models(nodes, frame(spark, "path, kind, modified", [("a.sql", "source", 2), ("a.sql", "compiled", 1), ("b.sql", "source", 1), ("b.sql", "compiled", 1), ("c.sql", "source", 1)])).select("path")


@golden("identifier, unique_id", [("raw", "source.p.s.raw")])
def sources_by_address(spark, sf_dir):
    wanted = frame(spark, "database, schema_name, identifier", [("DB", "sch", "raw"), ("DB", "other", "raw")])
    return assembly.sources_by_address(manifest.Manifest(ARTIFACT).nodes(spark), wanted).select("identifier", "unique_id")


@query("SELECT model, col AS column_name, CAST(row_number() OVER (PARTITION BY model ORDER BY col) - 1 AS INTEGER) AS idx FROM " + values([g[:2] for g in sp.GOLDEN], "model, col"))
def columns_of_models(spark, sf_dir):
    return assembly.columns_of_models(facts(spark).rows).select("model", F.col("column").alias("column_name"), F.col("index").cast("int").alias("idx"))


@golden("cached, sources", [("nation.zz", "nation.zz"), ("region.zz", "region.zz")])
def lineage_cache(spark, sf_dir):
    """What the cache answers after the only hint has moved from one table to the other, against what parsing anew gives."""
    m = manifest.Manifest({"nodes": {"model.p.m": {"name": "m", "resource_type": "model", "compiled_code": "select zz from region, nation"}}, "sources": {"source.p.s.nation": {"name": "nation"}, "source.p.s.region": {"name": "region"}}})
    n, rows = m.nodes(spark), []
    with tempfile.TemporaryDirectory() as at:
        for t in ("nation", "region"):
            c = spark.createDataFrame([(f"source.p.s.{t}", t, "zz", 0, None, "", [], {}, {})], schemas.COLUMNS)
            rows.append(tuple(assembly.parse_models(spark, n, c, cache_dir=d).lineage.head().source_columns[0] for d in (at, None)))
    return frame(spark, "cached, sources", rows)


# Columns and files.
@query(f"SELECT relation, column_name, data_type, idx AS ordinal FROM {DESCRIBED} WHERE relation IN ({', '.join(map(lit, sp.SOURCES))})")
def refactor_columns(spark, sf_dir):
    """The whole sequence of steps over the sample project: its sources then have the tables' columns, types and order."""
    out = _refactored(spark, sf_dir)(facts(spark).project.columns)
    return out.where(F.col("model").isin(*sp.SOURCES)).select(F.col("model").alias("relation"), F.col("column").alias("column_name"), "data_type", "ordinal")


def _refactored(spark, sf_dir):
    f = facts(spark)
    modes = settings.flag(f.settings, "annotate-origins").select("unique_id", F.col("v").alias("mode")).distinct()
    return workflows.refactor(nodes=f.project.nodes, rows=f.rows, actual=actual_columns(spark, sf_dir, tuple(sp.SOURCES)), settings=f.settings, modes=modes, glossary=f.project.glossary)


@query("SELECT CAST(0 AS BIGINT) AS changes")
def refactor_idempotent(spark, sf_dir):
    """How many columns a run changes after two: the first clears placeholders and texts that were annotations only, the second fills them."""
    steps = _refactored(spark, sf_dir)
    twice = cut(steps(cut(steps(facts(spark).project.columns))))
    return reconcile.mutations(twice, steps(twice)).agg(F.count("*").alias("changes"))


@golden("entry, column_name, item", [("a", "", "{'access': 'public', 'tests': ['t'], 'description': 'Old'}"), ("a", "id", "{'tests': ['unique'], 'description': 'Key', 'tags': ['k']}"), ("a", "n", "{}"), ("b", "", "{'config': {'x': 1}}"), ("v", "", "{'versions': [{'v': 1, 'x': 2}, {'v': 2, 'columns': [{'name': 'id'}]}]}"), ("s.t", "", "{'tests': ['fresh']}"), ("s.u", "", "{}")])
def schema_file_merge(spark, sf_dir):
    old = {"version": 2, "models": [{"name": "a", "access": "public", "tests": ["t"], "description": "Old", "columns": [{"name": "ID", "tests": ["unique"]}, {"name": "gone"}]}, {"name": "b", "config": {"x": 1}}, {"name": "v", "versions": [{"v": 1, "x": 2}]}], "sources": [{"name": "s", "tables": [{"name": "t", "tests": ["fresh"]}]}]}
    new = {"version": 2, "models": [{"name": "a", "description": "New", "columns": [{"name": "id", "description": "Key", "tags": ["k"]}, {"name": "n"}]}, {"name": "v", "versions": [{"v": 2, "columns": [{"name": "id"}]}]}], "sources": [{"name": "s", "tables": [{"name": "u", "columns": []}]}]}
    doc, rows = routing.sync_doc(old, new), []
    for name, e in [(m["name"], m) for m in doc["models"]] + [(f"{s['name']}.{t['name']}", t) for s in doc["sources"] for t in s["tables"]]:
        rows.append((name, "", str({k: v for k, v in e.items() if k not in ("name", "columns")})))
        rows += [(name, c["name"], str({k: v for k, v in c.items() if k != "name"})) for c in e.get("columns") or []]
    return frame(spark, "entry, column_name, item", rows)


@golden("relation, column_name, description", [("customer", "c_custkey", "Number of the customer"), ("customer", "c_name", "From the database"), ("stg_customer", "customer_id", "")])
def source_texts(spark, sf_dir):
    f = facts(spark)
    actual = spark.createDataFrame([("customer", "c_custkey", "bigint", 0, "number of  the CUSTOMER"), ("customer", "c_name", "string", 1, "From the database"), ("stg_customer", "customer_id", "bigint", 0, "Not for models")], schemas.INTROSPECTED)
    c = f.project.columns.where("(model = 'customer' AND column IN ('c_custkey', 'c_name')) OR (model = 'stg_customer' AND column = 'customer_id')")
    return reconcile.refresh_source_texts(c, actual, f.project.nodes).select(F.col("model").alias("relation"), F.col("column").alias("column_name"), "description")


@golden("target, nodes, superseded", [("models/x/_a_view.yml", "model.p.a", "old.yml"), ("models/root.yml", "model.p.b,model.p.c", "old.yml")])
def restructure_plan(spark, sf_dir):
    n = [(f"model.p.{x}", x, x, "model", "p", "d", "s", "sql", "view", f"models/x/{x}.sql", None if x == "c" else "p://old.yml" if x != "d" else "p://models/x/_d_view.yml", ["p", x], "", [], {}, {}, None, None, [], None, i) for i, x in enumerate("abcd")]
    nodes = spark.createDataFrame(n, schemas.NODES)
    t = nodes.select("unique_id", F.when(F.col("name").isin("b", "c"), "/root").otherwise("_{node.name}_{node.materialized}").alias("template"))
    return routing.restructure_plan(routing.target_paths(nodes, t)).select("target", F.array_join("nodes", ",").alias("nodes"), F.array_join("superseded", ",").alias("superseded"))


# Diffs and migrations.
_CHANGED = [("t", "renamed", "a", "b", None, None, "safe", 90.0), ("t", "type_changed", "c", None, "int", "text", "breaking", None)]
_DDL = [
    ("snowflake", 1, 'ALTER TABLE "t" RENAME COLUMN "a" TO "b";'), ("snowflake", 2, 'ALTER TABLE "t" ALTER COLUMN "c" SET DATA TYPE text;'), ("bigquery", 1, "ALTER TABLE `t` RENAME COLUMN `a` TO `b`;"), ("bigquery", 2, "ALTER TABLE `t` ALTER COLUMN `c` SET DATA TYPE text;"),
    ("postgresql", 1, 'ALTER TABLE "t" RENAME COLUMN "a" TO "b";'), ("postgresql", 2, 'ALTER TABLE "t" ALTER COLUMN "c" TYPE text;'), ("sqlserver", 1, "EXEC sp_rename 't.a', 'b', 'COLUMN';"), ("sqlserver", 2, "ALTER TABLE [t] ALTER COLUMN [c] text;"),
    ("databricks", 1, "-- rename a to b needs a rewrite of t"), ("databricks", 2, "ALTER TABLE `t` ALTER COLUMN `c` TYPE text;"), ("spark", 1, "ALTER TABLE `t` RENAME COLUMN `a` TO `b`;"), ("spark", 2, "ALTER TABLE `t` CHANGE COLUMN `c` `c` text;"),
]


@golden("adapter, step, sql", _DDL)
def migration_dialects(spark, sf_dir):
    c = spark.createDataFrame(_CHANGED, "relation string, category string, column string, new_column string, old_type string, new_type string, severity string, score double")
    out = None
    for a in dict.fromkeys(d[0] for d in _DDL):
        part = diff.migration_steps(c, a).select(F.lit(a).alias("adapter"), "step", "sql")
        out = part if out is None else out.union(part)
    return out


@golden("style, script", [("sql", 'BEGIN;\n-- Rename a to b\nALTER TABLE "t" RENAME COLUMN "a" TO "b";\nCOMMIT;\n-- rollback\n-- ALTER TABLE "t" RENAME COLUMN "b" TO "a";'), ("markdown", '# t\n\n- Rename a to b: `ALTER TABLE "t" RENAME COLUMN "a" TO "b";`')])
def migration_scripts(spark, sf_dir):
    c = spark.createDataFrame(_CHANGED[:1], "relation string, category string, column string, new_column string, old_type string, new_type string, severity string, score double")
    steps = diff.migration_steps(c, "duckdb")
    return diff.migration_script(steps).select(F.lit("sql").alias("style"), "script").union(diff.migration_script(steps, "markdown").select(F.lit("markdown"), "script"))


@golden("column_name, severity", [("c", "breaking")])
def changes_by_severity(spark, sf_dir):
    c = spark.createDataFrame(_CHANGED, "relation string, category string, column string, new_column string, old_type string, new_type string, severity string, score double")
    return diff.by_severity(c, "breaking").select(F.col("column").alias("column_name"), "severity")


# Health, tests, lint, validation.
def _shelf(spark):
    n = [(f"{k}.p.{x}", x, x, k, "p", "d", "s", "sql", None, None, None, ["p"], text, [], {}, {}, None, None, [f"{p}"] if p else [], None, i) for i, (x, k, text, p) in enumerate([("a", "source", "", None), ("b", "model", "", "source.p.a"), ("c", "model", "A text of some length", "model.p.b"), ("d", "model", "This is a table", "model.p.b")])]
    c = [(f"{k}.p.{x}", x, f"c{i}", i, "int", text, [], {}, {}) for x, k, texts in (("b", "model", ("", "the id", "Number of the box")), ("d", "model", ("", "", "", "Day of sale"))) for i, text in enumerate(texts)]
    return spark.createDataFrame(n, schemas.NODES), spark.createDataFrame(c, schemas.COLUMNS)


@golden("unique_id, gap, score, band", [("model.p.b", "missing", 61.0, "medium"), ("model.p.d", "poor", 35.0, "low")])
def undocumented_models(spark, sf_dir):
    n, c = _shelf(spark)
    return health.undocumented_models(n, c, graph.node_edges(n))


@golden("unique_id, column_name, score", [("model.p.b", "c0", 30.5), ("model.p.b", "c1", 30.5), ("model.p.d", "c0", 27.5), ("model.p.d", "c1", 27.5), ("model.p.d", "c2", 27.5)])
def undocumented_columns(spark, sf_dir):
    n, c = _shelf(spark)
    return health.undocumented_columns(n, c, graph.node_edges(n)).withColumnRenamed("column", "column_name")


@query("SELECT CAST(3 AS BIGINT) AS models, CAST(1 AS BIGINT) AS documented_models, CAST(7 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS documented_columns, 33.33::DOUBLE AS model_coverage, 28.57::DOUBLE AS column_coverage, 30.95::DOUBLE AS overall")
def doc_coverage(spark, sf_dir):
    return health.coverage(*_shelf(spark))


@golden("unique_id, column_name, ok", [("source.p.a", None, False), ("model.p.b", None, False), ("model.p.c", None, True), ("model.p.d", None, True), ("model.p.b", "c0", False), ("model.p.b", "c1", True), ("model.p.b", "c2", True), ("model.p.d", "c0", False), ("model.p.d", "c1", False), ("model.p.d", "c2", False), ("model.p.d", "c3", True)])
def doc_lengths(spark, sf_dir):
    return health.check_lengths(*_shelf(spark)).withColumnRenamed("column", "column_name")


@golden("line", [(" 33.33%  b (3 columns, 1 undocumented)",), (" 25.00%  d (4 columns, 3 undocumented)",), ("100.00%  a (0 columns, 0 undocumented)",), ("100.00%  c (0 columns, 0 undocumented)",), ("passes 40: False",), ("passes 28: True",)])
def doc_report(spark, sf_dir):
    n, c = _shelf(spark)
    h = health.node_health(c.withColumn("description", F.when(F.col("description") == "the id", "Renamed from: X").otherwise(F.col("description"))), n, frame(spark, "column, description", [("c9", "x")]))
    h = h.cache()
    gate = [(f"passes {k}: {health.passes(h, k)}",) for k in (40, 28)]
    return health.health_lines(h, n).union(frame(spark, "line", gate))


@query("SELECT unique_id, CAST(n AS BIGINT) AS columns, CAST(t AS BIGINT) AS tested_columns, CAST(k AS BIGINT) AS tests, CAST(s AS BIGINT) AS suggested FROM " + values([("m1", 2, 1, 1, 0), ("m2", 1, 0, 0, 1), ("m3", 0, 0, 0, 0)], "unique_id, n, t, k, s"))
def suggestion_summary(spark, sf_dir):
    c = frame(spark, "unique_id, column, data_type", [("m1", "order_id", "int"), ("m1", "x", "text"), ("m2", "order_id", "int")])
    return health.suggestion_summary(frame(spark, "unique_id", [("m1",), ("m2",), ("m3",)]), c, frame(spark, "unique_id, column, test_name", [("m1", "order_id", "unique")]))


@golden("id, line, snippet", [("a", 1, "id"), ("a", 2, "name"), ("c", 1, "x")])
def lint_quoted_identifier(spark, sf_dir):
    t = frame(spark, "id, sql", [("a", 'select "id",\n `name` from t'), ("b", 'select "order", "two words", \'"x"\' from t'), ("c", "select `x` from t")])
    return lint.quoted_identifier(t).select("id", "line", "snippet")


@golden("id, rule_id", [("good", "select-star"), ("template", "select-star"), ("broken", "no-sql"), ("nobody", "not-found")])
def lint_compiles_first(spark, sf_dir):
    n = [("good", None, "select * from t"), ("template", "select * from {{ ref('t') }}", None), ("broken", "{% macro m %}", None), ("fine", "select a from {{ ref('t') }}", None)]
    nodes = spark.createDataFrame(n, "name string, raw_sql string, compiled_sql string").withColumns({"resource_type": F.lit("model"), "fqn": F.array(F.lit("p"))})
    rules = lint.Linter(spark, enabled=["select-star"])
    return rules.lint_project(nodes, renderer=sql.Renderer({"t": "t"})).select("id", "rule_id").union(rules.lint_model(nodes, "nobody").select("id", "rule_id"))


@query("SELECT level, rule_id, CAST(n AS BIGINT) AS n FROM " + values([("warning", "select-star", 2), ("info", "line-length", 1)], "level, rule_id, n"))
def lint_summary(spark, sf_dir):
    t = frame(spark, "id, sql", [("a", "select * from t"), ("b", "select * from t where " + "x = 1 and " * 12 + "y = 2")])
    return lint.summary(lint.Linter(spark, enabled=["select-star", "line-length"]).lint(t))


# SQL.
@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def sql_qualify(spark, sf_dir):
    register(spark, sf_dir)
    return sql.run(spark, "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")


@query("WITH c AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderkey > 3 QUALIFY r = 1) SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM c WHERE o_custkey IN (SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)")
def sql_qualify_nested(spark, sf_dir):
    register(spark, sf_dir)
    return sql.run(spark, "with c as (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders where o_orderkey > 3 qualify r = 1) select o_custkey, o_orderkey, r from c where o_custkey in (select c_custkey from customer qualify row_number() over (partition by c_nationkey order by c_custkey) = 1)")


@query("SELECT * EXCLUDE (n_regionkey) FROM nation")
def sql_exclude(spark, sf_dir):
    register(spark, sf_dir)
    return sql.run(spark, "select * exclude (n_regionkey) from [nation]")


@golden("case_name, table_name, column_name, txt", [("table", "t", None, "It's here"), ("column", "s.t", "c", "New"), ("other", None, None, None)])
def comment_changes(spark, sf_dir):
    cases = {"table": "alter table t comment = 'It''s here'", "column": "ALTER TABLE s.t MODIFY COLUMN c int COMMENT 'New';", "other": "alter table t add column c int"}
    return frame(spark, "case_name, table_name, column_name, txt", [(k, *(sql.comment_change(v) or (None, None, None))) for k, v in cases.items()])


@golden("what, value", [("templated", "True"), ("plain", "False"), ("preview", "a | b           |1 | xxxxxxxxx...")])
def sql_templates_and_preview(spark, sf_dir):
    shown = sql.preview(spark.sql("select 1 as a, repeat('x', 30) as b, 3 as c"), columns=2, width=12).split("\n")
    return frame(spark, "what, value", [("templated", str(sql.is_templated("{{ x }}"))), ("plain", str(sql.is_templated("select 1"))), ("preview", shown[0].ljust(16)[:16] + "|" + shown[1])])


# Generation, settings, display, texts.
@golden("relation, sql", [("Crew", "select\n    Id as id,\n    firstName as first_name,\n    ok\nfrom {{ source('ship', 'Crew') }}")])
def staging_models(spark, sf_dir):
    df = spark.createDataFrame([("Crew", "Id", "int", 0, None), ("Crew", "firstName", "string", 1, None), ("Crew", "ok", "boolean", 2, None)], schemas.INTROSPECTED)
    return generate.staging_sql("ship", df)


@golden("what, text", [("source", "version: 2\nsources:\n- name: ship\n  tables:\n  - name: crew\n    columns:\n    - name: id\n      data_type: int\n      description: Number\n"), ("staging", "version: 2\nmodels:\n- name: stg_ship__crew\n  description: Staged crew of ship\n  columns:\n  - name: id\n    description: Number\n    data_type: int\n")])
def generated_yaml(spark, sf_dir):
    df = spark.createDataFrame([("crew", "ID", "int", 0, "Number"), ("skip_me", "x", "int", 0, None)], schemas.INTROSPECTED)
    return frame(spark, "what, text", [("source", generate.as_yaml(generate.source_definition("ship", df, exclude=["skip*"]))), ("staging", generate.staging_yaml("ship", df)["crew"])])


@golden("column_name, description, owner", [("a", "Text of a", "docs"), ("b", "Own text", None), ("c", "", "frozen"), ("d", "", None)])
def enriched_columns(spark, sf_dir):
    c = spark.createDataFrame([("m", "model", x, i, None, t, [], o, {}) for i, (x, t, o) in enumerate([("a", "", {}), ("b", "Own text", {}), ("c", "", {"desc-owner": "frozen"}), ("d", "", {})])], schemas.COLUMNS)
    out = generate.enriched(c, lambda names: {n: f"Text of {n}" for n in names if n != "d"}, anchors=("mod*",), frozen=("frozen",), owner="docs")
    return out.select(F.col("column").alias("column_name"), "description", F.col("meta")["desc-owner"].alias("owner"))


@golden("key, value, source_rank", [("skip-add-tags", "column", 1), ("sort-by", "options", 2), ("output-to-lower", "config", 5), ("annotate-origins", "fallback", 8), ("skip-add-columns", "true", 9), ("prefer-yaml-values", "file", 10)])
def collected_settings(spark, sf_dir):
    n = spark.createDataFrame([("m", {"skip-add-tags": "node", "mine": "1"}, {"tracewell-output-to-lower": "config", "sort-by": "ignored"})], "unique_id string, meta map<string,string>, config map<string,string>")
    c = spark.createDataFrame([("m", "c", {"tracewell_skip_add_tags": "column", settings.OPTIONS: '{"sort_by": "options"}'}, {})], "unique_id string, column string, meta map<string,string>, config_meta map<string,string>")
    found = settings.collect(n, c, {"skip_add_columns": True}, {"prefer-yaml-values": "file"}, {"annotate-origins": "fallback"})
    return settings.resolve(found, c, extras=True).select("key", "value", "source_rank")


@golden("key, chain", [("sort-by", "1=x > 4=y > 8=z")])
def settings_chain(spark, sf_dir):
    s = spark.createDataFrame([("column", "m", "c", r, "sort_by", v) for r, v in ((8, "z"), (1, "x"), (4, "y"))], schemas.SETTINGS)
    return settings.chain(s).select("key", "chain")


@golden("mode, value", [("manifest", "Text"), ("yaml", "{{ doc('a') }}"), ("auto", "{{ doc('a') }}"), ("database", "Text")])
def property_values(spark, sf_dir):
    one = spark.range(1)
    out = None
    for mode in ("manifest", "yaml", "auto", "database"):
        part = one.select(F.lit(mode).alias("mode"), settings.property_value(mode, F.lit("Text"), F.lit("{{ doc('a') }}")).alias("value"))
        out = part if out is None else out.union(part)
    return out


@golden("unique_id, template", [("a", "by_config"), ("b", "by_meta"), ("c", "by_layer"), ("d", "by_default")])
def path_templates(spark, sf_dir):
    n = spark.createDataFrame([("a", ["p", "x"], {"tracewell": "m"}, {"tracewell": "by_config"}), ("b", ["p", "x"], {"tracewell": "by_meta"}, {}), ("c", ["p", "layer"], {}, {}), ("d", ["p"], {}, {})], "unique_id string, fqn array<string>, meta map<string,string>, config map<string,string>")
    return settings.path_template(n, {"layer": "by_layer"}, "by_default")


@golden("line", [("customer_rank.rank: customer_mart.x",), ("customer_rank.rank:   stg.y",)])
def lineage_text(spark, sf_dir):
    c = spark.createDataFrame([("customer_rank", "rank", "stg", "y", 1), ("customer_rank", "rank", "customer_mart", "x", 0)], "root_model string, root_column string, model string, column string, depth int")
    return display.text_lines(c)


@golden("nr, line", list(enumerate(["digraph lineage {", "  rankdir=LR;", '  subgraph cluster_0 { label="a";', '    "a.x" [label="x"];', "  }", '  subgraph cluster_1 { label="b";', '    "b.y" [label="y"];', "  }", '  "exposure.e" [shape=box];', '  "a.x" -> "b.y" [label="direct"];', '  "b.y" -> "exposure.e" [label="exposure"];', "}"])))
def lineage_dot(spark, sf_dir):
    v = frame(spark, "id, kind, model, column", [("a.x", "column", "a", "x"), ("b.y", "column", "b", "y"), ("exposure.e", "exposure", "e", None)])
    e = frame(spark, "source, target, type", [("a.x", "b.y", "direct"), ("b.y", "exposure.e", "exposure")])
    return frame(spark, "nr, line", list(enumerate(display.dot(v, e).split("\n"))))


@golden("form, text", [("json", '{"a":1,"b":"x"}'), ("markdown", "| a | b |\n|---|---|\n| 1 | x |"), ("yaml", "- a: 1\n  b: x"), ("text", "a\tb\n1\tx"), ("table", "a | b\n--+--\n1 | x")])
def report_forms(spark, sf_dir):
    df = spark.sql("select 1 as a, 'x' as b")
    return frame(spark, "form, text", [(f, display.rendered(df, f)) for f in ("json", "markdown", "yaml", "text", "table")])


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '--[^\\n]*', '', 'g'), '\\s+', ' ', 'g')) AS bare, regexp_extract(text, '([^.]*)$', 1) AS last_part, CASE WHEN position('.' IN text) > 0 THEN regexp_replace(text, '\\.[^.]*$', '') ELSE '' END AS head FROM documents".replace("\\\\", "\\"))
def text_parts(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", tx.without_comments(t).alias("bare"), tx.after_last_dot(t).alias("last_part"), tx.before_last_dot(t).alias("head"))


@golden("name, variants, bare, matches", [('"pre_one"', "one|ONE|One|pre_one|PRE_ONE|preOne|PreOne", "pre_one", True), ("`b`", "b|B", "b", False)])
def names_and_globs(spark, sf_dir):
    df = frame(spark, "name, prefix", [('"pre_one"', "pre_"), ("`b`", "")])
    bare = tx.unquoted(F.col("name"))
    return df.select("name", F.array_join(tx.name_variants(bare, F.col("prefix")), "|").alias("variants"), bare.alias("bare"), bare.rlike(tx.glob_to_regex("pre_*")).alias("matches"))


@golden("adapter, name, normal_name", [("snowflake", "abc", "ABC"), ("snowflake", '"aBc"', "aBc"), ("duckdb", "aBc", "aBc"), ("duckdb", '"aBc"', "aBc")])
def normalized_names(spark, sf_dir):
    df = frame(spark, "name", [("abc",), ('"aBc"',), ("aBc",)])
    view = lambda a, names: df.where(F.col("name").isin(*names)).select(F.lit(a).alias("adapter"), "name", catalog.normalized(F.col("name"), a).alias("normal_name"))
    return view("snowflake", ("abc", '"aBc"')).union(view("duckdb", ("aBc", '"aBc"')))


@golden("column_name, data_type", [("s", "struct<a:int,b:array<struct<c:string>>>"), ("s.a", "int"), ("s.b", "array<struct<c:string>>"), ("s.b.c", "string"), ("d", "decimal")])
def introspect_nested(spark, sf_dir):
    df = spark.createDataFrame([], "s struct<a:int,b:array<struct<c:string>>>, d decimal(10,2), skipped int")
    return catalog.introspect(spark, {"t": df}, ignore=("^skip",), precise=False).select(F.col("column").alias("column_name"), "data_type")


@golden("code", [("MISSING_SEED_NAME",)])
def validate_seeds(spark, sf_dir):
    return validate.validate_files(frame(spark, "path, text", [("s.yml", "version: 2\nseeds:\n  - columns:\n      - name: a\n")])).select("code")
