"""Finding and loading a project, and getting compiled SQL for its models."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.assembly import stale_models
from tracewell.operators.sql import Renderer, is_templated
from tracewell.sources.files import EngineConfig, read_glossary
from tracewell.sources.manifest import Manifest, is_newer_engine

MARKERS = ("project.yml", "dbt_project.yml")
MODES = ("manifest", "target_dir", "auto_compile")


def discover(start: str = ".") -> str:
    """The nearest directory, from ``start`` upwards, that holds a project file."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in MARKERS):
            return at
        if (up := os.path.dirname(at)) == at:
            raise FileNotFoundError(f"no project at or above {os.path.abspath(start)}")
        at = up


@dataclass
class LoadedProject:
    root: str
    config: EngineConfig
    manifest: Manifest
    nodes: DataFrame
    columns: DataFrame
    exposures: DataFrame
    tests: DataFrame
    glossary: DataFrame
    nested: bool = False


def relation_names(manifest: Manifest) -> dict[str, str]:
    """What a template's references stand for: nodes by name, sources by source and table name."""
    names = {n.get("name"): n.get("alias") or n.get("name") for n in manifest.data.get("nodes", {}).values()}
    return names | {f"{s.get('source_name')}.{s.get('name')}": s.get("identifier") or s.get("name") for s in manifest.data.get("sources", {}).values()}


def compiled_nodes(spark: SparkSession, manifest: Manifest, mode: str = "manifest", variables: dict | None = None, root: str | None = None) -> DataFrame:
    """Nodes with their SQL: from the manifest (an error if no model has any there), from the compiled files beside it, or
    rendered from the raw SQL where nothing is compiled or, with the project's ``root``, where the source file is newer than the compiled one."""
    if mode not in MODES:
        raise ValueError(f"compiled SQL comes from one of {MODES}, not {mode!r}")
    if mode == "manifest" and not manifest.has_inline_sql():
        raise ValueError("no model in the manifest has compiled SQL; compile the project, or use target_dir or auto_compile")
    nodes = manifest.nodes(spark, from_disk=mode == "target_dir")
    if mode != "auto_compile":
        return nodes
    renderer = Renderer(relation_names(manifest), variables)
    rows, stale = [], _stale(spark, nodes, manifest, root) if root else set()
    for r in nodes.collect():
        sql, raw = r.compiled_sql, r.raw_sql
        if r.unique_id in stale:
            with open(os.path.join(root, r.path), encoding="utf-8") as f:
                sql, raw = None, f.read()
        if sql is None and raw:
            try:
                sql = renderer.render(raw) if is_templated(raw) else raw
            except ValueError:
                sql = None
        rows.append({**r.asDict(), "compiled_sql": sql})
    return spark.createDataFrame([tuple(r[c] for c in nodes.columns) for r in rows], nodes.schema)


def _stale(spark: SparkSession, nodes: DataFrame, manifest: Manifest, root: str) -> set[str]:
    """Ids of the nodes whose source file is newer than their compiled one."""
    files = []
    for r in nodes.where("path LIKE '%.sql'").select("path", "package_name").collect():
        for kind, path in (("source", os.path.join(root, r.path)), ("compiled", os.path.join(manifest.root or ".", "compiled", r.package_name or "", r.path))):
            if os.path.isfile(path):
                files.append((r.path, kind, os.path.getmtime(path)))
    both = {p for p, k, _ in files if k == "source"} & {p for p, k, _ in files if k == "compiled"}
    if not both:
        return set()
    found = stale_models(nodes, spark.createDataFrame([f for f in files if f[0] in both], "path string, kind string, modified double"))
    return {r.unique_id for r in found.collect() if r.path in both}


_loaded: dict[tuple, "LoadedProject"] = {}


def load_once(spark: SparkSession, root: str | None = None, mode: str = "manifest", target: str = "target") -> LoadedProject:
    """load(), kept for the session until the manifest changes or clear_loaded() is called."""
    root = os.path.abspath(root or discover())
    manifest = os.path.join(root, target, "manifest.json")
    key = (spark.sparkContext.applicationId, root, mode, target, os.path.getmtime(manifest))
    if key not in _loaded:
        for old in [k for k in _loaded if k[1:4] == key[1:4]]:
            del _loaded[old]
        _loaded[key] = load(spark, root, mode, target)
    return _loaded[key]


def clear_loaded() -> None:
    _loaded.clear()


def load(spark: SparkSession, root: str | None = None, mode: str = "manifest", target: str = "target") -> LoadedProject:
    root = root or discover()
    config = EngineConfig.load(os.path.join(root, ".tracewell"))
    m = Manifest.load(os.path.join(root, target, "manifest.json"))
    glossary = os.path.join(root, config.glossary) if config.glossary else ""
    words = read_glossary(spark, glossary) if glossary and os.path.exists(glossary) else spark.createDataFrame([], "column string, description string")
    return LoadedProject(root, config, m, compiled_nodes(spark, m, mode, root=root), m.columns(spark), m.exposures(spark), m.tests(spark), words, is_newer_engine(os.path.join(root, target, "manifest.json")))
