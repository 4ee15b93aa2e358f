"""Loading a project from disk, the standard workflows, and the command line."""

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from tests.test_operators import MANIFEST
from tracewell import queries as Q
from tracewell.__main__ import main
from tracewell.operators import graph, reconcile, settings, workflows
from tracewell.sources import catalog, project
from tracewell.sources.manifest import Manifest


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "project.yml").write_text("name: p\n")
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "manifest.json").write_text(json.dumps(MANIFEST))
    (tmp_path / ".tracewell").write_text("[tracewell]\nglossary = g.yml\n")
    (tmp_path / "g.yml").write_text("id: Key\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    return tmp_path


def test_load(spark, root):
    assert project.discover(str(root / "a" / "b")) == str(root)
    with pytest.raises(FileNotFoundError):
        project.discover("/")
    p = project.load(spark, str(root))
    assert p.nodes.count() == 4 and p.glossary.count() == 1 and p.tests.count() == 2 and p.exposures.count() == 1
    bare = json.loads(json.dumps(MANIFEST))
    bare["nodes"]["model.p.orders"] |= {"compiled_code": None, "raw_code": "select id from {{ source('shop', 'raw') }}"}
    bare["nodes"]["model.p.Orders2"]["raw_code"] = "{% macro x %}"
    m = Manifest(bare)
    with pytest.raises(ValueError, match="compiled SQL"):
        project.compiled_nodes(spark, m)
    got = {r.unique_id: r.compiled_sql for r in project.compiled_nodes(spark, m, "auto_compile").collect()}
    assert got["model.p.orders"] == "select id from RAW_ORDERS" and got["model.p.Orders2"] is None
    with pytest.raises(ValueError):
        project.compiled_nodes(spark, m, "guess")


def test_stale_models_are_rendered_anew_and_projects_kept(spark, root):
    bare = json.loads(json.dumps(MANIFEST))
    bare["nodes"]["model.p.orders"] |= {"original_file_path": "orders.sql"}
    (root / "target" / "manifest.json").write_text(json.dumps(bare))
    compiled, source = root / "target" / "compiled" / "p" / "orders.sql", root / "orders.sql"
    compiled.parent.mkdir(parents=True)
    source.write_text("select 5 as five from {{ source('shop', 'raw') }}")
    compiled.write_text("select 4 as four")
    sql_of = lambda: {r.unique_id: r.compiled_sql for r in project.load(spark, str(root), "auto_compile").nodes.collect()}["model.p.orders"]
    os.utime(source, (1, 1))
    assert sql_of() == MANIFEST["nodes"]["model.p.orders"]["compiled_code"]
    os.utime(source, (4e9, 4e9))
    assert sql_of() == "select 5 as five from RAW_ORDERS"
    one = project.load_once(spark, str(root))
    assert project.load_once(spark, str(root)) is one
    project.clear_loaded()
    assert project.load_once(spark, str(root)) is not one


def test_refactor(spark):
    f = Q.facts(spark)
    p = f.project
    actual = catalog.introspect(spark, {"stg_nation": spark.sql("select 1 as n_nationkey, 'x' as n_name, 2 as fresh")})
    modes = settings.flag(f.settings, "annotate-origins").select("unique_id", F.col("v").alias("mode")).distinct()
    given = dict(nodes=p.nodes, rows=f.rows, actual=actual, settings=f.settings, modes=modes, glossary=p.glossary)
    out = workflows.refactor(**given)(p.columns)
    got = [(r.column, r.data_type) for r in out.where("model = 'stg_nation'").orderBy("ordinal").collect()]
    assert got == [("n_nationkey", "int"), ("n_name", "string"), ("fresh", "int")]
    assert out.where("model <> 'stg_nation'").count() == p.columns.where("model <> 'stg_nation'").count()
    assert "n_regionkey" in {r.column for r in workflows.document(**given)(p.columns).where("model = 'stg_nation'").collect()}
    assert reconcile.mutations(p.columns, workflows.organize(**given)(p.columns)).isEmpty()
    assert graph.waves(f.depth).count() == 5


@pytest.fixture()
def shop(spark, tmp_path):
    """A project on disk with schema files, a source table in the session's catalog, and a model that reads it."""
    manifest = {
        "metadata": {"project_name": "p"},
        "nodes": {
            "model.p.people": {"name": "people", "resource_type": "model", "package_name": "p", "schema": "s", "original_file_path": "models/stage/people.sql", "patch_path": "p://models/all.yml", "fqn": ["p", "stage", "people"], "compiled_code": "select id, label as title, upper(label) as loud from crew", "depends_on": {"nodes": ["source.p.ship.crew"]}, "columns": {"id": {"name": "id"}, "gone": {"name": "gone"}}},
            "model.p.loud": {"name": "loud", "resource_type": "model", "package_name": "p", "schema": "s", "original_file_path": "models/mart/loud.sql", "fqn": ["p", "mart", "loud"], "compiled_code": "select id, loud from people", "depends_on": {"nodes": ["model.p.people"]}, "columns": {}, "meta": {"tracewell-annotate-origins": "always"}},
        },
        "sources": {"source.p.ship.crew": {"name": "crew", "source_name": "ship", "package_name": "p", "schema": "nowhere", "resource_type": "source", "patch_path": "p://models/all.yml", "original_file_path": "models/all.yml", "fqn": ["p", "ship", "crew"], "columns": {"id": {"name": "id", "description": "Number of the sailor", "tags": ["key"], "meta": {"owner": "mate"}}, "label": {"name": "label", "description": "Name of the sailor"}}}},
    }
    for folder in ("target", "models/stage", "models/mart"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "project.yml").write_text("name: p\n")
    (tmp_path / "target" / "manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "models" / "all.yml").write_text(
        "version: 2\nmodels:\n- name: people\n  access: public\n  columns:\n  - {name: id, tests: [unique], quote: true}\n  - {name: gone}\n- name: by_hand\n  tests: [odd]\n"
        "sources:\n- name: ship\n  loader: rowboat\n  tables:\n  - {name: crew, columns: [{name: id, description: Number of the sailor}]}\nmacros: [{name: m}]\n"
    )
    spark.sql("select 1 as id, 'x' as label, 2.5 as depth").createOrReplaceTempView("crew")
    yield tmp_path
    spark.catalog.dropTempView("crew")


def files_of(root):
    return {str(f.relative_to(root)): yaml.safe_load(f.read_text()) for f in sorted((root / "models").rglob("*.yml"))}


def test_refactor_writes_files_once(spark, shop, capsys):
    run = ["--project", str(shop), "yaml", "refactor", "--template", "_{model}"]
    assert main(run) == 0 and "written: models/stage/_people.yml" in capsys.readouterr().out
    got = files_of(shop)
    people = got["models/stage/_people.yml"]["models"][0]
    assert people["access"] == "public" and [c["name"] for c in people["columns"]] == ["id", "title", "loud"]
    assert people["columns"][0] == {"name": "id", "tests": ["unique"], "quote": True, "description": "Number of the sailor", "tags": ["key"], "meta": {"owner": "mate", "desc-owner": "upstream"}}
    assert "Renamed from: CREW.LABEL" in people["columns"][1]["description"]
    loud = got["models/mart/_loud.yml"]["models"][0]["columns"]
    assert [c["name"] for c in loud] == ["id", "loud"] and loud[0]["description"].startswith("Number of the sailor") and "Derived from: CREW.ID" in loud[0]["description"]
    assert got["models/all.yml"] == {"version": 2, "models": [{"name": "by_hand", "tests": ["odd"]}], "sources": [], "macros": [{"name": "m"}]}
    crew = got["models/_crew.yml"]["sources"][0]
    assert crew["loader"] == "rowboat" and [(c["name"], c["data_type"]) for c in crew["tables"][0]["columns"]] == [("id", "int"), ("label", "string"), ("depth", "decimal(2,1)")]
    assert main([*run, "--check"]) == 0 and files_of(shop) == got


def test_document_and_organize(spark, shop):
    assert main(["--project", str(shop), "yaml", "organize", "--template", "_{model}", "--fqn", "stage.people"]) == 0
    got = files_of(shop)
    assert got["models/stage/_people.yml"] == {"models": [{"name": "people", "access": "public", "columns": [{"name": "id", "tests": ["unique"], "quote": True}, {"name": "gone"}]}]}
    assert [m["name"] for m in got["models/all.yml"]["models"]] == ["by_hand"]
    assert main(["--project", str(shop), "yaml", "document", "--select", "loud", "--check"]) == 1 and "models/mart/schema.yml" not in files_of(shop)
    assert main(["--project", str(shop), "yaml", "document", "--select", "loud"]) == 0
    doc = files_of(shop)["models/mart/schema.yml"]["models"][0]
    assert [c["name"] for c in doc["columns"]] == ["id", "loud"]
    with pytest.raises(Exception, match="no path template"):
        main(["--project", str(shop), "yaml", "organize"])


def test_bootstrap_sources(spark, shop):
    nodes = project.load(spark, str(shop)).nodes
    spark.sql("CREATE DATABASE IF NOT EXISTS hold")
    spark.range(2).write.mode("overwrite").saveAsTable("hold.barrels")
    try:
        assert workflows.bootstrap_sources(spark, nodes, str(shop), {"ship": "hold"}) == ["models/sources/ship.yml"]
        doc = files_of(shop)["models/sources/ship.yml"]["sources"][0]
        assert doc["schema"] == "hold" and {"name": "barrels", "columns": [{"name": "id", "data_type": "bigint"}]} in doc["tables"]
        assert workflows.bootstrap_sources(spark, nodes, str(shop), {"ship": "hold"}) == []
    finally:
        spark.sql("DROP DATABASE hold CASCADE")


def test_settings_from_every_place(spark, tmp_path):
    node = dict(unique_id="model.p.a", name="a", meta={"tracewell-skip-add-tags": "node", "other": "x", "tracewell-options": '{"sort-by": "opt"}'}, config={"tracewell_output_to_lower": "extra", "output-to-upper": "ignored", "meta": '{"skip_merge_meta": "cm"}', "unrendered": '{"tracewell-annotate-origins": "un"}'})
    nodes = spark.createDataFrame([(node["unique_id"], node["name"], node["meta"], node["config"])], "unique_id string, name string, meta map<string,string>, config map<string,string>")
    columns = spark.createDataFrame([("model.p.a", "c", {"skip-add-tags": "col", "tracewell-options": '{"desc-owner": "opt"}'}, {"sort_by": "ccm"})], "unique_id string, column string, meta map<string,string>, config_meta map<string,string>")
    (tmp_path / "s.yml").write_text("tracewell-prefer-yaml-values: true\nskip-add-columns: false\n")
    extra = settings.read_supplementary(str(tmp_path / "s.yml"))
    assert settings.read_supplementary(str(tmp_path / "none.yml")) == {}
    found = settings.collect(nodes, columns, {"skip_add_columns": True}, extra, {"annotate-origins": "fall"})
    got = {r.key: (r.value, r.source_rank) for r in settings.resolve(found, columns, extras=True).collect()}
    assert got == {"skip-add-tags": ("col", 1), "desc-owner": ("opt", 2), "sort-by": ("ccm", 3), "output-to-lower": ("extra", 5), "skip-merge-meta": ("cm", 6), "annotate-origins": ("un", 7), "skip-add-columns": ("true", 9), "prefer-yaml-values": ("true", 10)}
    assert "prefer-yaml-values" not in {r.key for r in settings.resolve(found, columns).collect()}


def test_more_commands(spark, shop, capsys):
    at = ["--project", str(shop)]
    assert main([*at, "sql", "compile", "select * from {{ source('ship', 'crew') }}"]) == 0 and "select * from crew" in capsys.readouterr().out
    assert main([*at, "sql", "run", "select label from {{ source('ship', 'crew') }}"]) == 0 and "label" in capsys.readouterr().out
    assert main([*at, "--format", "markdown", "diff", "schema"]) in (0, 1) and "| crew | added | depth |" in capsys.readouterr().out
    main([*at, "diff", "schema", "--migration", "duckdb"])
    assert 'ALTER TABLE "crew" ADD COLUMN "depth"' in capsys.readouterr().out
    assert main([*at, "--format", "json", "test", "suggest"]) == 0
    capsys.readouterr()
    assert main(["generate", "sources", "ship", "--include", "cre*"]) == 0 and "- name: crew" in capsys.readouterr().out
    assert main(["generate", "staging", "ship", "--include", "crew"]) == 0
    out = capsys.readouterr().out
    assert "{{ source('ship', 'crew') }}" in out and "name: stg_ship__crew" in out
    assert main([*at, "lint", "model", "people", "--rules", "select-star"]) == 0 and main([*at, "lint", "model", "nobody"]) == 1
    (shop / "q.sql").write_text("select * from t")
    assert main(["--format", "yaml", "lint", "file", str(shop / "q.sql"), "--rules", "select-star"]) == 1 and "rule_id: select-star" in capsys.readouterr().out


def test_command_line(spark, root, capsys):
    assert main(["--project", str(root), "lineage", "orders.id"]) == 0 and main(["--project", str(root), "impact"]) == 0
    assert main(["--project", str(root), "dot"]) == 0 and "digraph" in capsys.readouterr().out
    assert main(["--project", str(root), "health"]) == 0 and main(["--project", str(root), "health", "--min-coverage", "99"]) == 1
    assert main(["--project", str(root), "lint", "--rules", "select-star"]) in (0, 1)
    assert main(["run", "select 7 as seven"]) == 0 and "seven" in capsys.readouterr().out
    assert main(["validate", str(root / "project.yml")]) == 1
