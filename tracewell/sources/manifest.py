"""Project artifacts (manifest and catalog JSON) as metadata tables."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import schemas

MODEL_KINDS = ("model", "seed", "snapshot", "source")


def schema_version(path: str, header: int = 4096) -> int | None:
    """The artifact's schema version, from its first bytes only."""
    with open(path, encoding="utf-8", errors="replace") as f:
        found = re.search(r"manifest/v(\d+)", f.read(header))
    return int(found[1]) if found else None


def is_newer_engine(path: str, known: int = 12) -> bool:
    """Whether a newer engine than ``known`` wrote the manifest; its columns then keep tags and meta under config."""
    version = schema_version(path)
    return version is not None and version > known


def nested_config(path: str | None, version: str = "0") -> bool:
    parts = [int(x) for x in re.findall(r"\d+", version)[:3]]
    return bool(path and is_newer_engine(path)) or parts >= [1, 9, 6]


@dataclass
class Manifest:
    """A parsed manifest; ``root`` is where compiled SQL lies on disk (<root>/compiled/<package>/<path>)."""

    data: dict[str, Any]
    root: str | None = None
    _by_name: dict[str, dict] | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> "Manifest":
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), os.path.dirname(os.path.abspath(path)))

    def find_node(self, name: str) -> dict | None:
        """The first node of that name (any case), as a copy."""
        if self._by_name is None:
            self._by_name = {}
            for node in [*self.data.get("nodes", {}).values(), *self.data.get("sources", {}).values()]:
                self._by_name.setdefault(str(node.get("name", "")).lower(), node)
        found = self._by_name.get(name.lower())
        return copy.deepcopy(found) if found is not None else None

    def has_inline_sql(self) -> bool:
        return any(_inline(n) for n in self.data.get("nodes", {}).values() if n.get("resource_type") == "model")

    def compiled_sql(self, name: str, unique_id: str | None = None) -> str | None:
        node = self.data.get("nodes", {}).get(unique_id) if unique_id else self.find_node(name)
        return _inline(node or {})

    def compiled_sql_from_disk(self, node: dict) -> str | None:
        path = os.path.join(self.root or ".", "compiled", str(node.get("package_name", "")), str(node.get("original_file_path") or node.get("path") or ""))
        if not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or None

    def nodes(self, spark: SparkSession, from_disk: bool = False, prefer_type: str = "data_type") -> DataFrame:
        return spark.createDataFrame([self._node(i, u, n, from_disk) for i, (u, n) in enumerate(self._all())], schemas.NODES)

    def columns(self, spark: SparkSession, prefer_type: str = "data_type") -> DataFrame:
        """Declared columns, names in lower case; the type is ``data_type`` or, failing it, ``type`` (a catalog prefers ``type``)."""
        other = "type" if prefer_type == "data_type" else "data_type"
        rows = []
        for uid, node in self._all():
            for i, (name, c) in enumerate((node.get("columns") or {}).items()):
                config = c.get("config") or {}
                rows.append((uid, str(node.get("name")), name.lower(), i, c.get(prefer_type) or c.get(other), c.get("description") or "", list(c.get("tags") or []), _text_map(c.get("meta")), _text_map(config.get("meta"))))
        return spark.createDataFrame(rows, schemas.COLUMNS)

    def exposures(self, spark: SparkSession) -> DataFrame:
        rows = [(e.get("name"), e.get("type"), e.get("url"), e.get("description"), _text_map(e.get("owner")), list((e.get("depends_on") or {}).get("nodes") or [])) for e in (self.data.get("exposures") or {}).values()]
        return spark.createDataFrame(rows, schemas.EXPOSURES)

    def tests(self, spark: SparkSession) -> DataFrame:
        rows = []
        for n in self.data.get("nodes", {}).values():
            meta = n.get("test_metadata") or {}
            if n.get("resource_type") == "test" and meta.get("name"):
                rows.append((n.get("attached_node"), n.get("column_name"), meta["name"], _text_map(meta.get("kwargs")), list((n.get("depends_on") or {}).get("nodes") or [])))
        return spark.createDataFrame(rows, schemas.TESTS)

    def _all(self):
        nodes = [(u, n) for u, n in (self.data.get("nodes") or {}).items() if n.get("resource_type") in MODEL_KINDS]
        return nodes + [(u, {**n, "resource_type": "source"}) for u, n in (self.data.get("sources") or {}).items()]

    def _node(self, i, uid, n, from_disk):
        sql = _inline(n) or (self.compiled_sql_from_disk(n) if from_disk else None)
        config = n.get("config") or {}
        return (uid, n.get("name"), (n.get("identifier") or n.get("name") or "").lower(), n.get("resource_type"), n.get("package_name"), n.get("database") or "main", n.get("schema") or "main", n.get("language") or "sql", config.get("materialized"), n.get("original_file_path") or n.get("path"), n.get("patch_path"), list(n.get("fqn") or []), n.get("description") or "", list(n.get("tags") or []), _text_map(n.get("meta")), _text_map(config), n.get("raw_code") or n.get("raw_sql"), sql, list((n.get("depends_on") or {}).get("nodes") or []), n.get("source_name"), i)


def _inline(node: dict) -> str | None:
    return node.get("compiled_sql") or node.get("compiled_code") or None


def _text_map(value) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (value or {}).items()}


def catalog_types(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, column, data_type, index, comment) of a catalog artifact; the type is ``type``, else ``data_type``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rows = [(uid, name.lower(), c.get("type") or c.get("data_type"), c.get("index"), c.get("comment")) for part in ("nodes", "sources") for uid, n in (data.get(part) or {}).items() for name, c in (n.get("columns") or {}).items()]
    return spark.createDataFrame(rows, "unique_id string, column string, data_type string, index int, comment string")


def first_by_name(nodes: DataFrame) -> DataFrame:
    """One node for each name in lower case: the first."""
    w = Window.partitionBy(F.lower("name")).orderBy("ord")
    return nodes.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def last_by_lookup_name(nodes: DataFrame) -> DataFrame:
    """(lookup_name, unique_id): how SQL names resolve; of colliding names the last wins, sources after nodes."""
    w = Window.partitionBy("lookup_name").orderBy((F.col("resource_type") == "source").desc(), F.col("ord").desc())
    return nodes.withColumn("n", F.row_number().over(w)).where("n = 1").select("lookup_name", "unique_id")


def upstream(nodes: DataFrame, seeds: bool = False) -> DataFrame:
    """(child_uid, child, parent_uid, parent): models and snapshots with their model, source and snapshot parents; seeds only on request."""
    kinds = ["model", "source", "snapshot"] + (["seed"] if seeds else [])
    parents = nodes.where(F.col("resource_type").isin(kinds)).select(F.col("unique_id").alias("parent_uid"), F.col("lookup_name").alias("parent"))
    children = nodes.where("resource_type IN ('model', 'snapshot')").select(F.col("unique_id").alias("child_uid"), F.col("lookup_name").alias("child"), F.explode("depends_on").alias("parent_uid"))
    return children.join(parents, "parent_uid").select("child_uid", "child", "parent_uid", "parent").distinct()


def downstream(nodes: DataFrame, seeds: bool = False) -> DataFrame:
    return upstream(nodes, seeds).groupBy("parent_uid", "parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def exposure_models(exposures: DataFrame) -> DataFrame:
    """(unique_id, exposure): exposures of each node they depend on."""
    return exposures.select(F.explode("depends_on").alias("unique_id"), F.col("name").alias("exposure")).distinct()


def tests_of(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, column, test_name, config): by the attached node, else by any node the test depends on; column and name needed."""
    known = tests.where("column IS NOT NULL AND test_name IS NOT NULL")
    attached = known.where("attached_uid IS NOT NULL").withColumn("unique_id", F.col("attached_uid"))
    loose = known.where("attached_uid IS NULL").withColumn("unique_id", F.explode("depends_on"))
    both = attached.unionByName(loose).select("unique_id", F.lower("column").alias("column"), "test_name", "config")
    return both.join(nodes.select("unique_id"), "unique_id", "left_semi")


def with_foreign_nodes(nodes: DataFrame, foreign: DataFrame) -> DataFrame:
    """Add another project's public models that aren't protected and that this project lacks."""
    public = foreign.where("resource_type = 'model'").where(F.coalesce(F.col("config")["access"], F.lit("protected")) == "public")
    return nodes.unionByName(public.join(nodes.select("unique_id"), "unique_id", "left_anti"))
