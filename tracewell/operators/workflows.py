"""The three standard sequences of steps over a project's columns, and over its schema files."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import annotate, assembly, generate, inherit, reconcile, routing, select, settings
from tracewell.operators.graph import depths, node_edges, origins
from tracewell.operators.reconcile import Pipeline, Step
from tracewell.sources import catalog
from tracewell.sources.project import LoadedProject


def steps(nodes: DataFrame, rows: DataFrame, actual: DataFrame, settings: DataFrame, modes: DataFrame, glossary: DataFrame | None = None, sort_by: str = "database", case: str = "keep") -> dict[str, Step]:
    """Each step by name; inputs as the operators take them."""
    depth, found = depths(nodes, node_edges(nodes)), origins(rows, nodes)
    return {
        "inject": Step("inject", lambda c: reconcile.inject_missing(c, actual, nodes, case=case)),
        "remove": Step("remove", lambda c: reconcile.remove_extra(c, actual, nodes)),
        "inherit": Step("inherit", lambda c: inherit.inherited(c, rows, nodes, depth, settings)),
        "annotate": Step("annotate", lambda c: annotate.annotated(c, rows, found, nodes, modes, glossary)),
        "sort": Step("sort", lambda c: reconcile.sort_columns(c, actual, nodes, sort_by)),
        "types": Step("types", lambda c: reconcile.sync_types(c, actual, nodes, case)),
    }


def refactor(**given) -> Pipeline:
    s = steps(**given)
    return s["inject"] >> s["remove"] >> s["inherit"] >> s["annotate"] >> s["sort"] >> s["types"]


def document(**given) -> Pipeline:
    s = steps(**given)
    return s["inject"] >> s["inherit"] >> s["annotate"] >> s["sort"]


def organize(**given) -> Pipeline:
    """Columns stay; only files move (operators.routing)."""
    return Pipeline([])


@dataclass
class RefactorSettings:
    """What a run over schema files covers and how it writes; every default leaves the files' own content alone."""

    fqn: str | None = None
    select: str | None = None
    files: list[str] = field(default_factory=list)
    include_external: bool = False
    dry_run: bool = False
    template: str | None = None
    variables: dict[str, Any] = field(default_factory=dict)
    supplementary: str = "tracewell.yml"
    sort_by: str = "database"
    annotate: str | None = None
    add_columns: bool = True
    add_source_columns: bool = True
    add_tags: bool = True
    merge_meta: bool = True
    add_types: bool = True
    precise_types: bool = True
    through_renames: bool | None = None
    keep_templates: bool = False
    case: str = "keep"
    nested: bool = False
    formatter: list[str] = field(default_factory=list)

    def fallback(self, annotate_mode: str) -> dict[str, Any]:
        """The settings that hold where neither a column nor a node says otherwise."""
        return {"annotate-origins": self.annotate or annotate_mode, "skip-add-tags": not self.add_tags, "skip-merge-meta": not self.merge_meta}


@dataclass
class Outcome:
    written: list[str]
    cleaned: list[str]
    deleted: list[str]
    errors: dict[str, str]
    columns: DataFrame | None

    @property
    def changed(self) -> list[str]:
        return sorted({*self.written, *self.cleaned, *self.deleted})


def actual_columns(spark: SparkSession, loaded: LoadedProject, parsed: assembly.Parsed, lineage: DataFrame, precise: bool = True) -> DataFrame:
    """(relation, column, data_type, index, comment): sources as the session's catalog has them, else as declared; models by the order of their SELECT."""
    tables: dict[str, str] = {}
    for r in loaded.nodes.where("resource_type = 'source'").select("name", "lookup_name", "schema_name").collect():
        for name in (f"{r.schema_name}.{r.lookup_name}", r.lookup_name):
            if spark.catalog.tableExists(name):
                tables.setdefault(r.name, name)
    live = catalog.introspect(spark, tables, precise=precise)
    declared = loaded.columns.join(loaded.nodes.where("resource_type = 'source'").select("unique_id"), "unique_id", "left_semi")
    live = catalog.with_declared_fallback(live, declared)
    named = parsed.lineage.where("entry = 0").withColumn("at", F.monotonically_increasing_id()).select("unique_id", "column", "at")
    order = lineage.where("entry = 0").join(named, ["unique_id", "column"], "left").select("unique_id", "model", "column", F.coalesce("at", F.lit(1 << 62)).alias("at"))
    declared_type = loaded.columns.select("unique_id", F.lower("column").alias("column"), "data_type")
    index = F.row_number().over(reconcile.Window.partitionBy("unique_id").orderBy("at", "column")) - 1
    models = order.withColumn("index", index).join(declared_type, ["unique_id", "column"], "left")
    return live.unionByName(models.select(F.col("model").alias("relation"), "column", "data_type", F.col("index").cast("int").alias("index"), F.lit(None).cast("string").alias("comment")))


def covered(loaded: LoadedProject, how: RefactorSettings) -> DataFrame:
    """The nodes that a run covers."""
    package = (loaded.manifest.data.get("metadata") or {}).get("project_name")
    if package is None:
        first = loaded.nodes.where("resource_type = 'model'").orderBy("ord").select("package_name").head()
        package = first.package_name if first else ""
    nodes = select.candidates(loaded.nodes, package, how.include_external, files=how.files or None, fqn=how.fqn)
    if how.select:
        nodes = nodes.join(select.select(loaded.nodes, node_edges(loaded.nodes), how.select).select("unique_id"), "unique_id", "left_semi")
    return nodes


def run_on_files(spark: SparkSession, loaded: LoadedProject, how: RefactorSettings, command: str = "refactor") -> Outcome:
    """Bring a project's schema files up to date: "refactor" moves entries where they belong and rewrites columns, "document" only rewrites
    columns where the entries are, "organize" only moves. A second run over the same manifest changes nothing."""
    if command not in ("refactor", "document", "organize"):
        raise ValueError(f"refactor, document or organize, not {command!r}")
    nodes = covered(loaded, how)
    columns = loaded.columns
    if command != "organize":
        parsed = assembly.parse_models(spark, loaded.nodes, columns, loaded.config.placeholders)
        lineage = assembly.with_stars(parsed, loaded.nodes, columns)
        rows = assembly.public_rows(lineage, loaded.nodes)
        actual = actual_columns(spark, loaded, parsed, lineage, how.precise_types)
        places = columns.select("unique_id", "column").union(actual.join(loaded.nodes.select("unique_id", F.col("name").alias("relation")), "relation").select("unique_id", "column")).distinct()
        extra = settings.read_supplementary(f"{loaded.root}/{how.supplementary}")
        found = settings.collect(loaded.nodes, columns, how.variables, extra, how.fallback(loaded.config.annotate))
        resolved = settings.resolve(found, places, extras=True)
        modes = settings.flag(resolved, "annotate-origins").select("unique_id", F.col("v").alias("mode")).distinct()
        s = steps(loaded.nodes, rows, actual, resolved, modes, loaded.glossary, how.sort_by, how.case)
        injected = s["inject"]
        if not how.add_source_columns:
            sources = loaded.nodes.where("resource_type = 'source'").select(F.col("name").alias("relation"))
            injected = Step("inject", lambda c: reconcile.inject_missing(c, actual.join(sources, "relation", "left_anti"), loaded.nodes, case=how.case))
        chosen = [injected] if how.add_columns else []
        chosen += [s["remove"]] if command == "refactor" else []
        chosen += [s["inherit"], s["annotate"], s["sort"]]
        chosen += [s["types"]] if command == "refactor" and how.add_types else []
        columns = Pipeline(chosen)(columns)
        if not how.add_types:
            columns = columns.withColumn("data_type", F.lit(None).cast("string"))
    models = nodes.where("path IS NOT NULL OR patch_path IS NOT NULL")
    if command == "document":
        folder = F.regexp_replace("path", r"/?[^/]*$", "")
        here = F.coalesce(F.regexp_replace("patch_path", r"^[a-z_]+://", ""), F.concat_ws("/", folder, F.lit("schema.yml")))
        paths = models.select("unique_id", here.alias("current"), here.alias("target"))
    else:
        paths = routing.target_paths(models, settings.path_template(models, how.variables, how.template))
    docs = routing.schema_docs(paths.select("unique_id", "target"), models, columns.join(models.select("unique_id"), "unique_id", "left_semi"), how.nested, how.case) if command != "organize" else {}
    moved = routing.apply_plan(docs, routing.restructure_plan(paths), loaded.nodes, loaded.root, how.dry_run, how.keep_templates)
    done = {*moved["written"], *moved["cleaned"], *moved["deleted"]}
    written, errors = routing.write_all({p: d for p, d in docs.items() if p not in done}, loaded.root, how.dry_run, how.keep_templates)
    if how.formatter and not how.dry_run and (files := [*moved["written"], *written]):
        routing.run_formatter(how.formatter, [f"{loaded.root}/{f}" for f in files])
    return Outcome([*moved["written"], *written], moved["cleaned"], moved["deleted"], errors, columns)


def bootstrap_sources(spark: SparkSession, nodes: DataFrame, root: str, databases: dict[str, str], folder: str = "models/sources", dry_run: bool = False) -> list[str]:
    """Add the tables of each source's database that the project lacks to the source's file, with their columns; the files written."""
    docs: dict[str, dict] = {}
    for source, database in sorted(databases.items()):
        known = nodes.where((F.col("resource_type") == "source") & (F.col("source_name") == source)).select(F.col("lookup_name").alias("name"))
        names = [r.name for r in catalog.missing_tables(spark, database, known).collect()]
        if names:
            found = catalog.introspect(spark, {n: f"{database}.{n}" for n in names})
            doc = generate.source_definition(source, found)
            doc["sources"][0]["schema"] = database
            docs[f"{folder}/{source}.yml"] = doc
    return routing.write_all(docs, root, dry_run)[0]
