"""Files, reconciliation, diffs, health, lint, validation, SQL, generation, routing, streaming."""

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from tracewell import queries as Q
from tracewell import schemas
from tracewell.operators import diff, display, generate, graph, health, lint, reconcile, routing, select, sql, validate
from tracewell.sources import catalog, files, manifest
from tracewell.streaming import changes

MANIFEST = {
    "metadata": {"schema": "https://schemas.example.com/manifest/v12.json"},
    "nodes": {
        "model.p.orders": {"name": "orders", "resource_type": "model", "package_name": "p", "schema": "s", "database": "d", "path": "orders.sql", "compiled_code": "select id, 1 as one from raw_orders", "depends_on": {"nodes": ["source.p.shop.raw"]}, "columns": {"ID": {"name": "ID", "data_type": "int", "type": "bigint", "description": "Key", "tags": ["k"], "meta": {"a": 1}, "config": {"meta": {"b": "c"}}}}, "fqn": ["p", "orders"]},
        "model.p.Orders2": {"name": "Orders", "resource_type": "model", "package_name": "p", "compiled_code": "", "depends_on": {"nodes": ["model.p.orders", "seed.p.x"]}, "columns": {}},
        "seed.p.x": {"name": "x", "resource_type": "seed", "columns": {}},
        "test.p.u": {"name": "u", "resource_type": "test", "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}, "column_name": "ID", "attached_node": "model.p.orders", "depends_on": {"nodes": ["model.p.orders"]}},
        "test.p.n": {"name": "n", "resource_type": "test", "test_metadata": {"name": "not_null"}, "column_name": "id", "depends_on": {"nodes": ["model.p.orders"]}},
    },
    "sources": {"source.p.shop.raw": {"name": "raw", "identifier": "RAW_ORDERS", "source_name": "shop", "columns": {"id": {"data_type": None, "type": "int"}}}},
    "exposures": {"exposure.p.e": {"name": "e", "type": "dashboard", "owner": {"name": "o"}, "depends_on": {"nodes": ["model.p.orders"]}}},
}


@pytest.fixture()
def project(tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(MANIFEST))
    (tmp_path / "compiled" / "p").mkdir(parents=True)
    (tmp_path / "compiled" / "p" / "orders.sql").write_text("select 2")
    return str(path)


def test_manifest(spark, project):
    m = manifest.Manifest.load(project)
    n = m.nodes(spark)
    assert {r.unique_id: (r.lookup_name, r.schema_name, r.compiled_sql) for r in n.collect()}["source.p.shop.raw"] == ("raw_orders", "main", None)
    assert m.find_node("ORDERS")["package_name"] == "p" and m.find_node("none") is None
    m.find_node("orders")["name"] = "changed"
    assert m.find_node("orders")["name"] == "orders" and m.has_inline_sql()
    assert m.compiled_sql("orders") == "select id, 1 as one from raw_orders" and m.compiled_sql_from_disk(MANIFEST["nodes"]["model.p.orders"]) == "select 2"
    assert {(r.child, r.parent) for r in manifest.upstream(n).collect()} == {("orders", "raw_orders"), ("orders", "orders")}
    assert ("orders", "x") in {(r.child, r.parent) for r in manifest.upstream(n, seeds=True).collect()}
    assert {r.parent: r.children for r in manifest.downstream(n).collect()} == {"raw_orders": ["orders"], "orders": ["orders"]}
    c = {(r.unique_id, r.column): r for r in m.columns(spark).collect()}
    assert c[("model.p.orders", "id")].data_type == "int" and dict(c[("model.p.orders", "id")].meta) == {"a": "1"} and c[("source.p.shop.raw", "id")].data_type == "int"
    assert {r.data_type for r in m.columns(spark, "type").where("unique_id = 'model.p.orders'").collect()} == {"bigint"}
    assert [(r.unique_id, r.exposure) for r in manifest.exposure_models(m.exposures(spark)).collect()] == [("model.p.orders", "e")]
    assert sorted((r.unique_id, r.column, r.test_name) for r in manifest.tests_of(n, m.tests(spark)).collect()) == [("model.p.orders", "id", "not_null"), ("model.p.orders", "id", "unique")]
    assert not manifest.is_newer_engine(project) and manifest.nested_config(None, "1.9.6") and not manifest.nested_config(project, "1.8")
    foreign = n.withColumns({"unique_id": F.concat(F.lit("f."), "unique_id"), "config": F.create_map(F.lit("access"), F.lit("public"))})
    assert manifest.with_foreign_nodes(n, foreign).count() == n.count() + 2
    path = os.path.join(os.path.dirname(project), "catalog.json")
    with open(path, "w") as f:
        json.dump({"nodes": {"m": {"columns": {"A": {"type": "int", "index": 1, "comment": "c"}}}}}, f)
    assert tuple(manifest.catalog_types(spark, path).head()) == ("m", "a", "int", 1, "c")


def test_introspection(spark):
    df = spark.sql("select 1 as id, named_struct('a', 1, 'b', named_struct('c', 2)) as s, cast(1 as decimal(5,2)) as d, 2 as _tmp")
    got = catalog.introspect(spark, {"t": df, "gone": "no_such_table"}, ignore=("^_",), precise=False)
    assert [(r.column, r.data_type) for r in got.orderBy("index").collect()] == [("id", "int"), ("s", "struct<a:int,b:struct<c:int>>"), ("s.a", "int"), ("s.b", "struct<c:int>"), ("s.b.c", "int"), ("d", "decimal")]
    declared = spark.createDataFrame([("u", "gone", "x", 0, "int", "", [], {}, {})], schemas.COLUMNS)
    assert catalog.with_declared_fallback(got, declared).where("relation = 'gone'").count() == 1
    n = spark.createDataFrame([('"Q"',), ("q",)], "c string")
    assert [r[0] for r in n.select(catalog.normalized(F.col("c"), "snowflake")).collect()] == ["Q", "Q"]
    assert catalog.enclosing_schema({"s": {"t": {"c": "int"}}}) == [(None, "s", "t", "c", "int")] and catalog.enclosing_schema({"t": {"c": "int"}}) == [(None, None, "t", "c", "int")]


def test_files(spark, tmp_path):
    (tmp_path / "c.ini").write_text("[tracewell]\nmax-origin-depth = 5\ninherit-through-renames = yes\nplaceholders =\n  a\n  b\nodd = 1\n")
    c = files.EngineConfig.load(str(tmp_path / "c.ini"))
    assert (c.max_origin_depth, c.inherit_through_renames, c.placeholders, c.unknown) == (5, True, ("a", "b"), {"odd": "1"})
    (tmp_path / "g.yml").write_text("A: text\nb: ''\nc:\n")
    assert [tuple(r) for r in files.read_glossary(spark, str(tmp_path / "g.yml")).collect()] == [("a", "text")]
    (tmp_path / "s.yml").write_text("version: 2\nmodels: []\nother: 1\n")
    assert files.read_schema_file(str(tmp_path / "s.yml")) == ({"version": 2, "models": []}, {"other": 1})
    assert files.read_schema_files(spark, str(tmp_path / "*.yml")).count() == 2
    (tmp_path / "s.csv").write_text("id,name\n1,a\n")
    assert files.read_seed(spark, str(tmp_path / "s.csv")).dtypes == [("id", "int"), ("name", "string")]


def test_pipeline_and_mutations(spark):
    c = spark.createDataFrame([("u", "m", "b", 0, None, "", [], {}, {}), ("u", "m", "a", 1, None, "", [], {}, {})], schemas.COLUMNS)
    seen = []
    steps = reconcile.Step("sort", reconcile.sort_by_name) >> reconcile.Step("drop", lambda d: d.where("column <> 'b'"))
    steps.commit = "batch"
    out = steps(c, sink=lambda d: seen.append(d.count()))
    assert seen == [2, 1] and set(steps.seconds) == {"sort", "drop"}
    assert {(r.column, r.change) for r in reconcile.mutations(c, out).collect()} == {("a", "changed"), ("b", "removed")}
    with pytest.raises(ValueError):
        reconcile.sort_columns(c, c, c, by="size")
    n = spark.createDataFrame([("u", "m", "source")], "unique_id string, name string, resource_type string")
    actual = spark.createDataFrame([("m", "a", "int", 0, "From the database")], schemas.INTROSPECTED)
    assert {r.column: r.description for r in reconcile.refresh_source_texts(c, actual, n).collect()} == {"a": "From the database", "b": ""}


@pytest.mark.parametrize("adapter,category,sql_", [
    ("sqlserver", "renamed", "EXEC sp_rename 't.a', 'b', 'COLUMN';"), ("databricks", "type_changed", "ALTER TABLE `t` ALTER COLUMN `a` TYPE int;"), ("spark", "type_changed", "ALTER TABLE `t` CHANGE COLUMN `a` `a` int;"), ("postgresql", "added", 'ALTER TABLE "t" ADD COLUMN "a" int;'), ("snowflake", "type_changed", 'ALTER TABLE "t" ALTER COLUMN "a" SET DATA TYPE int;'), ("postgres", "removed", 'ALTER TABLE "t" DROP COLUMN "a";'),
])
def test_migration_dialects(spark, adapter, category, sql_):
    row = ("t", category, "a", "b" if category == "renamed" else None, "string", "int", "breaking", None)
    c = spark.createDataFrame([row], "relation string, category string, column string, new_column string, old_type string, new_type string, severity string, score double")
    steps = diff.migration_steps(c, adapter)
    assert steps.head().sql == sql_
    script = diff.migration_script(steps).head().script
    assert script.startswith("BEGIN;\n-- ") and "\nCOMMIT;\n-- rollback\n-- " in script
    assert diff.migration_script(steps, "markdown").head().script.startswith("# t") and json.loads(diff.migration_script(steps, "json").head().script)


def test_rename_can_serve_several(spark):
    d = spark.createDataFrame([("t", "customer_ids", "int"), ("t", "customerid", "int")], "relation string, column string, data_type string")
    a = spark.createDataFrame([("t", "customer_id", "int")], "relation string, column string, data_type string")
    got = diff.schema_changes(d, a).collect()
    assert {(r.category, r.column, r.new_column) for r in got} == {("renamed", "customer_ids", "customer_id"), ("renamed", "customerid", "customer_id")}


def test_health(spark):
    f = Q.facts(spark)
    p = f.project
    h = health.node_health(p.columns, p.nodes, p.glossary)
    assert health.passes(h, 10) and not health.passes(h, 100) and health.health_lines(h, p.nodes).count() == p.nodes.count()
    u = health.undocumented_models(p.nodes, p.columns, f.node_edges)
    assert u.count() and u.where("score > 100 OR score < 0").count() == 0 and {r.band for r in u.collect()} <= {"high", "medium", "low"}
    assert health.undocumented_columns(p.nodes, p.columns, f.node_edges, 40).where("score < 40").count() == 0
    c = health.coverage(p.nodes, p.columns).head()
    assert c.models == 12 and abs(c.overall - (c.model_coverage + c.column_coverage) / 2) < 0.011
    assert health.check_lengths(p.nodes, p.columns).where("ok").count() > 0
    s = health.suggestion_summary(p.nodes, p.columns, manifest.tests_of(p.nodes, p.tests))
    assert s.where("unique_id = 'model.shop.stg_orders'").head().tests == 4
    empty = p.columns.limit(0)
    assert health.project_health(health.node_health(empty, p.nodes, p.glossary)).head().coverage == 100.0


def test_lint(spark):
    t = spark.createDataFrame([("a", 'SELECT "col", x from t1\nwhere x = \'"q"\'\n' + "-" * 101), ("b", "select 1; select * from t")], "id string, sql string")
    got = {(r.id, r.rule_id, r.line) for r in lint.Linter(spark).lint(t).collect()}
    assert ("a", "quoted-identifier", 1) in got and ("a", "line-length", 3) in got and ("a", "keyword-case", 1) in got and not any(r == "select-star" for _, r, _ in got)
    li = lint.Linter(spark, disabled=["line-length"])
    li.add("no-limit", lambda plan, sql: [] if any(n.kind == "GlobalLimit" for n in plan.walk()) else [("no-limit", None, None, "no limit", None, None)])
    li.add("broken", lambda plan, sql: 1 / 0)
    v = li.lint(t)
    assert v.where("rule_id = 'line-length'").count() == 0 and v.where("rule_id = 'no-limit'").count() == 2 and len(li.failed) == 2
    assert not lint.passed(v) and {r.level for r in lint.summary(v).collect()} >= {"warning"}
    n = Q.facts(spark).project.nodes
    assert lint.Linter(spark).lint_model(n, "none").head().rule_id == "not-found"
    assert lint.Linter(spark, enabled=["select-star"]).lint_project(n).select("id").collect() == [("stg_nation",)]
    forced = lint.keyword_case(spark.createDataFrame([("a", "Select x FROM t")], "id string, sql string"), "lower")
    assert sorted((r.snippet, r.fix) for r in forced.collect()) == [("FROM", "from"), ("Select", "select")]


def test_validation_details():
    codes = lambda text: [c for c, *_ in validate.validate_text(text)]
    assert codes("version: 2\nmodels:\n  - name: 5\n") == ["INVALID_MODEL_NAME"]
    assert codes("version: 2\nseeds:\n  - name: s\n    columns: x\n") == ["INVALID_COLUMNS_TYPE"]
    assert codes("version: 2\nmodels:\n- name: a\n  tests:\n  - unique_combination_of_columns: {arguments: {combination_of_columns: [a]}}\n  - relationships: 5\n  - accepted_values: {values: x}\n  - {a: 1, b: 2}\n  - 7\n") == ["INSUFFICIENT_COMBINATION_COLUMNS", "INVALID_TEST_CONFIG_TYPE", "INVALID_ACCEPTED_VALUES_TYPE", "INVALID_TEST_CONFIG", "INVALID_TEST_TYPE"]
    assert codes("version: 2 \nmodels: [{name: a}]\r\n\n\n\n\n") == ["TRAILING_WHITESPACE", "EXCESSIVE_BLANK_LINES", "CRLF_LINE_ENDINGS"]
    assert codes("version: 2\nsources: [{name: s, tables: [{}, 5, {name: t, columns: [{name: c, tests: [x.y]}]}]}]\n") == ["MISSING_SOURCE_TABLE_NAME", "INVALID_SOURCE_TABLE_TYPE"]
    assert list(validate.fix_version({"models": [], "version": 1})) == ["version", "models"]


def test_renderer():
    r = sql.Renderer({"a": "main.a", "s.t": "raw.t"}, {"v": 3, "on": True})
    assert r.render("select {{ var('v') }}, {{ var('w', 'd') }} from {{ ref('a') }} join {{ source('s', 't') }}{# c #}") == "select 3, d from main.a join raw.t"
    assert r.render("{% for x in ['a', 'b'] -%} {{ x }}{% if not loop.last %}, {% endif %}{% endfor %}") == "a, b"
    assert r.render("{% if on %}y{% else %}n{% endif %}{% set z = [1, 2] %}{% for i in z %}{{ i }}{% endfor %}") == "y12"
    for bad in ("{{ nope }}", "{% for x in ['a'] %}", "{{ env('X') }}", "{% macro x %}"):
        with pytest.raises(ValueError):
            r.render(bad)
    assert sql.is_templated("{{ a }}") and not sql.is_templated("select 1")


def test_running(spark):
    out = {r.model: r.status for r in sql.validate_models(spark, {"ok": "select 1", "bad": "selec", "fails": "select raise_error('x')", "slow": "select sum(id) from range(0, 100000000000, 1, 200000)"}, timeout=10).collect()}
    assert out == {"ok": "success", "bad": "compile_error", "fails": "execution_error", "slow": "timeout"}
    assert sql.success_rate(sql.validate_models(spark, {"a": "select 1"})) == 100.0
    text = sql.preview(spark.sql("select 1 as a, 'a very long text that is cut' as b"), width=10)
    assert text.splitlines()[1] == "1 | a very ..."
    assert sql.comment_change("ALTER TABLE s.t MODIFY COLUMN c COMMENT 'it''s'") == ("s.t", "c", "it's") and sql.comment_change("alter table t comment = 'x';") == ("t", None, "x") and sql.comment_change("select 1") is None
    p = Q.facts(spark).project
    c, n = sql.apply_comment(p.columns, p.nodes, "ALTER TABLE stg_orders ALTER COLUMN total COMMENT 'Sum'")
    assert c.where("description = 'Sum'").count() == 1 and sql.apply_comment(p.columns, p.nodes, "ALTER TABLE orders COMMENT 'T'")[1].where("description = 'T'").count() == 1


def test_generation(spark):
    i = spark.createDataFrame([("t", "OrderId", "int", 0, "Key"), ("t", "b", "string", 1, None), ("skip", "x", "int", 0, None)], schemas.INTROSPECTED)
    doc = generate.source_definition("raw", i, exclude=("sk*",))
    assert [t["name"] for t in doc["sources"][0]["tables"]] == ["t"] and not [x for x in validate.validate_text(yaml.safe_dump(doc)) if x[1] == "error"]
    s = generate.models_of(spark, generate.staging_sql("raw", i))["t"]
    assert s == "select\n    OrderId as order_id,\n    b\nfrom {{ source('raw', 't') }}"
    calls = []
    c = Q.facts(spark).project.columns
    out = generate.enriched(c, lambda names: calls.append(sorted(names)) or {"status": "Fetched", "n_name": "Kept away"}, anchors=("stg_*",), skip=("n_name",), owner="crm")
    row = out.where("model = 'stg_orders' AND column = 'status'").head()
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0]) and row.description == "Fetched" and row.meta["desc-owner"] == "crm"
    assert out.where("description IN ('Fetched', 'Kept away')").count() == 1
    text = generate.render_model_yaml("m", [{"name": "a", "description": "x " * 80, "tags": []}])
    assert yaml.safe_load(text)["models"][0]["columns"][0]["description"].split() == ["x"] * 80 and ">" in text


def test_selection(spark):
    f = Q.facts(spark)
    n, e = f.project.nodes, f.node_edges
    names = lambda d: sorted(r.name for r in d.collect())
    assert names(select.select(n, e, "+order_revenue")) == ["lineitem", "order_revenue", "stg_lineitem"] and names(select.select(n, e, "1+customer_rank")) == ["customer_mart", "customer_rank"]
    assert names(select.select(n, e, "source:raw.nation path:models/staging,stg_n*")) == ["nation", "stg_nation"] and "supplier" in names(select.select(n, e, "@party_union customer_rank"))
    with pytest.raises(ValueError):
        select.select(n, e, "state:modified").count()
    assert names(select.candidates(n, "shop", files=["models/staging"])) == names(select.candidates(n, "shop", fqn="staging")) and names(select.by_full_fqn(n, "shop.marts")) == names(select.by_fqn_text(n, ".marts."))
    assert names(select.candidates(n, "shop", selected=["model.shop.stg_orders"], fqn="nothing")) == ["stg_orders"] and select.candidates(n, "other").count() == 0
    assert select.without_columns(f.project.columns, ("^n_",)).where("column LIKE 'n\\\\_%'").count() == 0


def test_routing_and_writing(spark, tmp_path):
    f = Q.facts(spark)
    n = f.project.nodes.where("resource_type = 'model'")
    paths = routing.target_paths(n, n.select("unique_id", F.lit("_{model}").alias("template")))
    docs = routing.schema_docs(paths.select("unique_id", "target"), n, f.project.columns)
    assert docs["models/staging/_stg_orders.yml"]["models"][0]["name"] == "stg_orders"
    old = tmp_path / "models" / "staging" / "schema.yml"
    old.parent.mkdir(parents=True)
    old.write_text("version: 2\nmodels:\n- name: stg_orders\n- name: kept\n")
    plan = routing.restructure_plan(paths).where("target = 'models/staging/_stg_orders.yml'")
    done = routing.apply_plan(docs, plan, n, str(tmp_path))
    assert done == {"written": ["models/staging/_stg_orders.yml"], "cleaned": ["models/staging/schema.yml"], "deleted": []}
    assert [m["name"] for m in yaml.safe_load(old.read_text())["models"]] == ["kept"]
    path = "models/staging/_stg_orders.yml"
    assert not routing.write_schema_file(path, docs[path], str(tmp_path))
    with open(tmp_path / path, "a") as x:
        x.write("extra: {a: 1}\n")
    assert not routing.write_schema_file(path, {"version": 2, "models": []}, str(tmp_path))
    assert routing.write_schema_file(path, {"version": 2, "models": []}, str(tmp_path), dry_run=True, replace=True) and "stg_orders" in (tmp_path / path).read_text()
    assert routing.write_schema_file(path, {"version": 2, "models": []}, str(tmp_path), replace=True) and yaml.safe_load((tmp_path / path).read_text()) == {"version": 2, "models": [], "extra": {"a": 1}}
    with pytest.raises(ValueError):
        routing.write_schema_file("../x.yml", {}, str(tmp_path))
    changed, errors = routing.write_all({"a.yml": {"version": 2}, "../b.yml": {}}, str(tmp_path))
    assert changed == ["a.yml"] and list(errors) == ["../b.yml"]
    assert routing.run_formatter(["true"], []) and not routing.run_formatter(["/no/such"], [])
    with pytest.raises(Exception, match="leaves the project"):
        routing.target_paths(n, n.select("unique_id", F.lit("../../../x").alias("template"))).collect()
    s = [{"name": "a", "schema": "x", "tables": [{"name": "t"}]}, {"name": "b", "schema": "y", "tables": [{"name": "t"}]}]
    assert routing.match_source(s, "a", "t")["name"] == "a" and routing.match_source(s, "c", "t") is None and routing.match_source(s, "c", "t", "y")["name"] == "b"


FULL = """version: 2
models:
- name: stg_orders
  access: public
  description: Written by hand
  config: {materialized: view}
  tests: [{unique_rows: {}}]
  columns:
  - {name: ORDER_ID, quote: true, tests: [unique], meta: {mine: 1, desc-owner: upstream}, constraints: [{type: not_null}]}
  - {name: gone, tests: [unique]}
- name: other_model
  columns: [{name: x}]
- name: versioned
  latest_version: 2
  versions:
  - {v: 1, config: {alias: old}}
  - {v: 2, columns: [{name: id, tests: [not_null]}]}
unit_tests: [{name: t}]
macros: [{name: m}]
"""


def test_schema_files_lose_nothing(tmp_path):
    path = tmp_path / "models" / "schema.yml"
    path.parent.mkdir()
    path.write_text(FULL)
    new = {"version": 2, "models": [{"name": "stg_orders", "description": "Generated", "columns": [{"name": "status", "data_type": "string"}, {"name": "order_id", "description": "Key", "tags": ["k"], "meta": {"a": "b"}}]}, {"name": "versioned", "versions": [{"v": 2, "columns": [{"name": "id", "data_type": "int"}]}, {"v": 3, "columns": [{"name": "id"}]}]}]}
    assert routing.write_schema_file("models/schema.yml", new, str(tmp_path))
    doc, old = yaml.safe_load(path.read_text()), yaml.safe_load(FULL)
    one, had = doc["models"][0], old["models"][0]
    assert {k: v for k, v in one.items() if k != "columns"} == {k: v for k, v in had.items() if k != "columns"}
    assert one["columns"] == [{"name": "status", "data_type": "string"}, {"name": "order_id", "quote": True, "tests": ["unique"], "meta": {"mine": 1, "a": "b"}, "constraints": [{"type": "not_null"}], "description": "Key", "tags": ["k"]}]
    assert doc["models"][1] == old["models"][1] and doc["unit_tests"] == old["unit_tests"] and doc["macros"] == old["macros"]
    assert doc["models"][2] == {"name": "versioned", "latest_version": 2, "versions": [{"v": 1, "config": {"alias": "old"}}, {"v": 2, "columns": [{"name": "id", "tests": ["not_null"], "data_type": "int"}]}, {"v": 3, "columns": [{"name": "id"}]}]}
    assert not routing.write_schema_file("models/schema.yml", new, str(tmp_path))


def test_columns_tags_and_meta_stand_in_one_place():
    sync = routing.sync_column
    assert sync({"name": "a", "tags": ["x"], "meta": {"m": 1}}, {"name": "a", "config": {"tags": ["y"], "meta": {"n": 2}}}) == {"name": "a", "config": {"tags": ["x", "y"], "meta": {"m": 1, "n": 2}}}
    assert sync({"name": "a", "config": {"tags": ["x"], "quote": 1}}, {"name": "a", "tags": ["y"]}) == {"name": "a", "config": {"quote": 1}, "tags": ["x", "y"]}
    assert sync({"name": "a", "config": {"tags": ["x"]}}, {"name": "a"}) == {"name": "a", "config": {"tags": ["x"]}}
    assert sync({"name": "a", "description": "{{ doc('a') }}"}, {"name": "a", "description": "Text"}, True)["description"] == "{{ doc('a') }}"
    assert routing.version_of("model.p.m.v2", "m") == "2" and routing.version_of("model.p.v2", "v2") is None and routing.version_of("source.p.m.v2", "m") is None
    twice = routing.sync_doc({"models": [{"name": "a", "x": 1}, {"name": "a", "x": 2, "y": 3}]}, {"models": [{"name": "a", "columns": []}]})
    assert twice == {"models": [{"name": "a", "x": 1, "y": 3}]}


def test_plans_move_whole_entries(spark, tmp_path):
    nodes = spark.createDataFrame([(u, n, n, k, "p", "d", "s", "sql", None, f"models/{n}.sql", "p://models/all.yml", ["p", n], "", [], {}, {}, None, None, [], "raw" if k == "source" else None, i) for i, (u, n, k) in enumerate([("model.p.a", "a", "model"), ("seed.p.b", "b", "seed"), ("source.p.raw.t", "t", "source"), ("model.p.stays", "stays", "model")])], schemas.NODES)
    columns = spark.createDataFrame([("model.p.a", "a", "id", 0, "int", "Key", [], {}, {})], schemas.COLUMNS)
    (tmp_path / "models").mkdir()
    everything = {"version": 2, "models": [{"name": "a", "config": {"x": 1}, "columns": [{"name": "id", "tests": ["unique"]}]}, {"name": "stays"}], "seeds": [{"name": "b", "tests": ["odd"]}], "sources": [{"name": "raw", "loader": "l", "tables": [{"name": "t", "tests": ["fresh"]}, {"name": "u"}]}]}
    (tmp_path / "models" / "all.yml").write_text(yaml.safe_dump(everything))
    moved = nodes.where("name <> 'stays'")
    paths = routing.target_paths(moved, moved.select("unique_id", F.lit("{node.fqn.1}_{node.resource_type}").alias("template")))
    docs = routing.schema_docs(paths.select("unique_id", "target"), moved, columns)
    plan = routing.restructure_plan(paths)
    trial = routing.apply_plan(docs, plan, nodes, str(tmp_path), dry_run=True)
    done = routing.apply_plan(docs, plan, nodes, str(tmp_path))
    assert trial == done == {"written": ["models/a_model.yml", "models/b_seed.yml", "models/t_source.yml"], "cleaned": ["models/all.yml"], "deleted": []}
    read = lambda n: yaml.safe_load((tmp_path / "models" / n).read_text())
    assert read("a_model.yml")["models"] == [{"name": "a", "config": {"x": 1}, "columns": [{"name": "id", "tests": ["unique"], "description": "Key", "data_type": "int"}]}]
    assert read("b_seed.yml")["seeds"] == [{"name": "b", "tests": ["odd"]}]
    assert read("t_source.yml")["sources"] == [{"name": "raw", "loader": "l", "tables": [{"name": "t", "tests": ["fresh"]}], "schema": "s"}]
    assert read("all.yml") == {"version": 2, "models": [{"name": "stays"}], "seeds": [], "sources": [{"name": "raw", "loader": "l", "tables": [{"name": "u"}]}]}


def test_display(spark):
    f = Q.facts(spark)
    v, e = graph.display_graph(f.edges, f.project.exposures, f.project.nodes)
    text = display.dot(v, e)
    assert text.startswith("digraph") and '"stg_orders.order_id" -> "order_flags.order_id"' in text and text.count("subgraph") == len({r.model for r in v.where("kind = 'column'").collect()})
    doc = json.loads(display.graph_json(v, e, "customer_mart").head().json)
    assert doc["main_node"] == "customer_mart" and len(doc["edges"]) == e.count()
    assert display.text_lines(graph.closure(f.edges)).count() == graph.closure(f.edges).count()
    assert display.as_markdown(spark.sql("select 1 as a")).splitlines() == ["| a |", "|---|", "| 1 |"] and display.as_json_lines(spark.sql("select 1 as a")).head().json == '{"a":1}'
    refs = graph.references(graph.closure(f.edges, False), f.edges, f.project.nodes, f.project.exposures)
    assert refs.where("kind = 'exposure' AND root_model = 'orders'").count() > 0
    assert graph.folder_tree(f.project.nodes).where("kind = 'model'").count() == 12
    assert graph.column_info(f.edges, f.lineage, "stg_orders", "order_id").groupBy("direction").count().count() == 2


def test_explorer(spark):
    import threading
    import urllib.error
    import urllib.request

    from tracewell.operators import explorer

    f = Q.facts(spark)
    http = explorer.server(explorer.Explorer(f.edges, f.project.exposures, f.project.nodes))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}").read())
    try:
        assert "customer_mart" in get("/models") and len(get("/graph")["edges"]) == graph.display_graph(f.edges, f.project.exposures, f.project.nodes)[1].count()
        assert get("/search?q=N_NAME") == ["nation.n_name", "stg_nation.n_name"]
        assert get("/lineage/%2Bcustomer_mart.first_order") == [{"direction": "upstream", "root_column": "first_order", "model": "stg_orders", "column": "order_date", "depth": 1}, {"direction": "upstream", "root_column": "first_order", "model": "orders", "column": "o_orderdate", "depth": 2}]
        for path, status in (("/lineage/a.b.c.+.", 400), ("/nothing", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
    finally:
        http.shutdown()


def test_streaming(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    row = {"unique_id": "m.a", "name": "a", "lookup_name": "a", "resource_type": "model", "language": "sql", "compiled_sql": "select x as y from t", "depends_on": [], "ord": 1}
    (src / "1.json").write_text(json.dumps(row) + "\n" + json.dumps({**row, "ord": 2, "compiled_sql": "select x as z from t"}) + "\n")
    changes.start(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.column for r in spark.read.parquet(out).collect()] == ["z"]
    (src / "2.json").write_text(json.dumps({**row, "unique_id": "m.b", "name": "b"}) + "\n")
    changes.start(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.batch, r.model) for r in spark.read.parquet(out).collect()} == {(0, "a"), (1, "b")}


def test_stale(spark):
    from tracewell.operators.assembly import stale_models

    n = spark.createDataFrame([(x, x, f"{x}.sql") for x in "abc"], "unique_id string, name string, path string")
    f = spark.createDataFrame([("a.sql", "source", 2), ("a.sql", "compiled", 1), ("b.sql", "source", 1), ("b.sql", "compiled", 2), ("c.sql", "source", 1)], "path string, kind string, modified int")
    assert sorted(r.name for r in stale_models(n, f).collect()) == ["a", "c"]


