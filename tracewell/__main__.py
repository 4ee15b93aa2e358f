"""python -m tracewell: schema files, lineage, impact, health, lint, tests, diffs and SQL of a project from the command line."""

from __future__ import annotations

import argparse
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    p.add_argument("--project", help="the project's directory")
    p.add_argument("--sql-from", default="manifest", choices=("manifest", "target_dir", "auto_compile"))
    p.add_argument("--format", default="table", choices=("table", "text", "json", "markdown", "yaml"), help="of reports")
    sub = p.add_subparsers(dest="command", required=True)

    yaml_ = sub.add_parser("yaml", help="schema files").add_subparsers(dest="action", required=True)
    for action in ("refactor", "document", "organize"):
        y = yaml_.add_parser(action)
        y.add_argument("--fqn")
        y.add_argument("--select", help="selector, as in stg_orders+,tag:marts")
        y.add_argument("--files", nargs="*", default=[])
        y.add_argument("--template", help="path template of nodes that name none")
        y.add_argument("--var", action="append", default=[], metavar="NAME=VALUE")
        y.add_argument("--annotate", choices=("if_altered", "always", "never"))
        y.add_argument("--sort-by", default="database", choices=("database", "alphabetical"))
        y.add_argument("--case", default="keep", choices=("keep", "upper", "lower"))
        y.add_argument("--formatter", nargs="*", default=[])
        for flag in ("include-external", "dry-run", "check", "nested", "keep-templates", "skip-add-columns", "skip-add-source-columns", "skip-add-tags", "skip-merge-meta", "skip-add-types"):
            y.add_argument(f"--{flag}", action="store_true")
    sub.add_parser("lineage").add_argument("selector", help="[+]model[.column][+]")
    sub.add_parser("dot")
    sub.add_parser("serve", help="lineage as JSON over HTTP").add_argument("--port", type=int, default=8580)
    sub.add_parser("impact")
    h = sub.add_parser("health")
    h.add_argument("--min-coverage", type=float, default=0.0)
    lint_ = sub.add_parser("lint")
    lint_.add_argument("what", nargs="?", default="project", choices=("project", "model", "file"))
    lint_.add_argument("name", nargs="?", help="a model, or a file pattern")
    lint_.add_argument("--rules", nargs="*")
    lint_.add_argument("--disable-rules", nargs="*")
    sub.add_parser("validate").add_argument("files")
    run_ = sub.add_parser("run")
    run_.add_argument("sql")
    sql_ = sub.add_parser("sql").add_subparsers(dest="action", required=True)
    for action in ("compile", "run"):
        sql_.add_parser(action).add_argument("sql")
    gen = sub.add_parser("generate").add_subparsers(dest="action", required=True)
    for action in ("sources", "staging"):
        g = gen.add_parser(action)
        g.add_argument("name", help="the source's name")
        g.add_argument("--database", default="default")
        g.add_argument("--include", nargs="*", default=["*"])
        g.add_argument("--exclude", nargs="*", default=[])
    d = sub.add_parser("diff").add_subparsers(dest="action", required=True).add_parser("schema")
    d.add_argument("--severity", choices=("safe", "moderate", "breaking"))
    d.add_argument("--migration", metavar="DIALECT", help="print DDL instead")
    sub.add_parser("test").add_subparsers(dest="action", required=True).add_parser("suggest")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tracewell.operators import assembly, diff, display, explorer, generate, graph, health, lint, sql, validate, workflows
    from tracewell.sources import catalog, files, manifest, project

    spark = SparkSession.builder.appName("tracewell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    show = lambda df: print(display.rendered(df, a.format))
    if a.command == "run" or a.command == "sql" and a.action == "run" and not sql.is_templated(a.sql):
        print(sql.preview(sql.run(spark, a.sql)))
        return 0
    if a.command == "validate":
        issues = validate.validate_files(files.read_schema_files(spark, a.files))
        show(issues)
        return int(not issues.where("severity = 'error'").isEmpty())
    if a.command == "lint" and a.what == "file":
        found = lint.Linter(spark, a.rules, a.disable_rules).lint(spark.read.text(a.name, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("sql")))
        show(found.orderBy("id", "line"))
        return int(not lint.passed(found))
    if a.command == "generate":
        there = {t.name: f"{a.database}.{t.name}" for t in spark.catalog.listTables(a.database)}
        there |= {t.name: t.name for t in spark.catalog.listTables() if t.isTemporary}
        found = catalog.introspect(spark, {k: v for k, v in there.items() if generate.matches(k, a.include, a.exclude)})
        if a.action == "sources":
            print(generate.as_yaml(generate.source_definition(a.name, found)))
        else:
            entries = generate.staging_yaml(a.name, found)
            for relation, text in sorted(generate.models_of(spark, generate.staging_sql(a.name, found)).items()):
                print(f"-- stg_{a.name}__{relation}.sql\n{text}\n\n# stg_{a.name}__{relation}.yml\n{entries[relation]}")
        return 0
    loaded = project.load(spark, a.project, a.sql_from)
    if a.command == "yaml":
        how = workflows.RefactorSettings(
            fqn=a.fqn, select=a.select, files=a.files, include_external=a.include_external, dry_run=a.dry_run or a.check, template=a.template, variables=dict(v.split("=", 1) for v in a.var), sort_by=a.sort_by, annotate=a.annotate, add_columns=not a.skip_add_columns,
            add_source_columns=not a.skip_add_source_columns, add_tags=not a.skip_add_tags, merge_meta=not a.skip_merge_meta, add_types=not a.skip_add_types, keep_templates=a.keep_templates, case=a.case, nested=a.nested or loaded.nested, formatter=a.formatter,
        )
        out = workflows.run_on_files(spark, loaded, how, a.action)
        for kind in ("written", "cleaned", "deleted"):
            for path in getattr(out, kind):
                print(f"{kind}: {path}")
        for path, error in out.errors.items():
            print(f"error: {path}: {error}", file=sys.stderr)
        return int(bool(out.errors) or a.check and bool(out.changed))
    if a.command == "sql":
        text = sql.Renderer(project.relation_names(loaded.manifest)).render(a.sql)
        print(text if a.action == "compile" else sql.preview(sql.run(spark, text)))
        return 0
    if a.command == "health":
        nodes = health.node_health(loaded.columns, loaded.nodes, loaded.glossary)
        for r in health.health_lines(nodes, loaded.nodes).collect():
            print(r.line)
        return int(not health.passes(nodes, a.min_coverage))
    if a.command == "lint":
        linter = lint.Linter(spark, a.rules, a.disable_rules)
        renderer = sql.Renderer(project.relation_names(loaded.manifest))
        found = linter.lint_model(loaded.nodes, a.name, renderer) if a.what == "model" else linter.lint_project(loaded.nodes, renderer=renderer)
        show(found.orderBy("id", "line"))
        return int(not lint.passed(found))
    if a.command == "test":
        show(health.suggestions(loaded.columns, manifest.tests_of(loaded.nodes, loaded.tests)).orderBy("unique_id", "column", "test_name"))
        return 0
    parsed = assembly.parse_models(spark, loaded.nodes, loaded.columns, loaded.config.placeholders)
    lineage = assembly.with_stars(parsed, loaded.nodes, loaded.columns)
    if a.command == "diff":
        actual = workflows.actual_columns(spark, loaded, parsed, lineage)
        declared = loaded.columns.select(F.col("model").alias("relation"), "column", "data_type")
        found = diff.schema_changes(declared, actual.join(declared.select("relation").distinct(), "relation", "left_semi"), loaded.config.rename_threshold)
        found = diff.by_severity(found, a.severity) if a.severity else found
        if a.migration:
            for r in diff.migration_script(diff.migration_steps(found, a.migration)).orderBy("relation").collect():
                print(r.script)
        else:
            show(found.orderBy("relation", "category", "column"))
        return int(not found.where("severity = 'breaking'").isEmpty())
    edges = assembly.lineage_edges(lineage, loaded.nodes)
    if a.command == "lineage":
        show(graph.select_lineage(edges, a.selector).orderBy("direction", "depth", "model", "column"))
    elif a.command == "impact":
        show(graph.impact(edges, lineage, loaded.nodes, loaded.exposures).orderBy("root_model", "root_column"))
    elif a.command == "serve":
        http = explorer.server(explorer.Explorer(edges, loaded.exposures, loaded.nodes), port=a.port)
        print(f"http://127.0.0.1:{http.server_port}/graph", flush=True)
        try:
            http.serve_forever()
        except KeyboardInterrupt:
            http.server_close()
    else:
        print(display.dot(*graph.display_graph(edges, loaded.exposures, loaded.nodes)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
