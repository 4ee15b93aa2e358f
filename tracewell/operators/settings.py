"""Settings by precedence, and access to properties."""

from __future__ import annotations

import os
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import has_unrendered

#: From the strongest to the weakest place a setting can stand in.
RANKS = {"column_meta": 1, "column_options": 2, "column_config_meta": 3, "node_meta": 4, "node_config_extra": 5, "node_config_meta": 6, "node_unrendered_config": 7, "fallback": 8, "project_variable": 9, "supplementary_file": 10}
PREFIX = "tracewell"
#: Keys that are settings; all others in meta are the project's own.
KNOWN = ("add-inheritance-for", "annotate-origins", "desc-owner", "force-inherit", "inherit-through-renames", "output-to-lower", "output-to-upper", "prefer-yaml-values", "skip-add-columns", "skip-add-data-types", "skip-add-tags", "skip-merge-meta", "sort-by", "use-unrendered-descriptions")
OPTIONS = PREFIX + "-options"


def read_supplementary(path: str) -> dict[str, Any]:
    """Settings of a flat YAML file; none where there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def collect(nodes: DataFrame, columns: DataFrame, variables: dict[str, Any] | None = None, supplementary: dict[str, Any] | None = None, fallback: dict[str, Any] | None = None) -> DataFrame:
    """(scope, unique_id, column, source_rank, key, value): every setting of a project from every place in RANKS that it can stand in.

    Columns: meta, the options map in it, config meta. Nodes: meta and its options, config keys, config meta, unrendered config. Then, for
    every node, the fallback, the project's variables (under any spelling of the key) and a supplementary file.
    """
    text_map = lambda c: F.from_json(c, "map<string,string>")
    none = F.lit(None).cast("string")
    parts = []

    def add(scope: str, df: DataFrame, where: str, values: Column) -> None:
        named = F.col("column") if scope == "column" else none
        parts.append(df.select(F.lit(scope).alias("scope"), "unique_id", named.alias("column"), F.lit(RANKS[where]).alias("source_rank"), F.explode(values).alias("key", "value")))

    add("column", columns, "column_meta", F.col("meta"))
    add("column", columns, "column_options", text_map(F.col("meta")[OPTIONS]))
    add("column", columns, "column_config_meta", F.col("config_meta"))
    add("node", nodes, "node_meta", F.col("meta"))
    add("node", nodes, "node_meta", text_map(F.col("meta")[OPTIONS]))
    add("node", nodes, "node_config_extra", F.col("config"))
    add("node", nodes, "node_config_meta", text_map(F.col("config")["meta"]))
    add("node", nodes, "node_unrendered_config", text_map(F.col("config")["unrendered"]))
    for where, given in (("fallback", fallback), ("project_variable", variables), ("supplementary_file", supplementary)):
        flat = {k: str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else yaml.safe_dump(v, default_flow_style=True).strip() for k, v in (given or {}).items()}
        if flat:
            add("node", nodes, where, F.create_map(*[F.lit(x) for pair in flat.items() for x in pair]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    low = F.regexp_replace(F.lower("key"), "_", "-")
    # Among a node's config keys only those with the prefix are the engine's.
    return out.where(plain_key(F.col("key")).isin(*KNOWN)).where((F.col("source_rank") != RANKS["node_config_extra"]) | low.startswith(PREFIX + "-"))


def plain_key(key: Column) -> Column:
    """kebab-case without the engine's prefix."""
    k = F.regexp_replace(F.lower(key), "_", "-")
    return F.regexp_replace(k, f"^{PREFIX}-", "")


def resolve(settings: DataFrame, places: DataFrame, extras: bool = False) -> DataFrame:
    """(unique_id, column, key, value, source_rank): for each place (unique_id, column) the strongest value of each key.

    Column settings beat node settings; within a rank a prefixed key beats a bare one. In the config extras (rank 5) only prefixed keys count.
    Project variables and supplementary files (ranks 9, 10) count with ``extras`` only.
    """
    s = settings.withColumn("prefixed", F.regexp_replace(F.lower("key"), "_", "-").startswith(PREFIX + "-")).withColumn("k", plain_key(F.col("key")))
    if not extras:
        s = s.where(F.col("source_rank") <= 8)
    per_column = s.where("scope = 'column'").select("unique_id", F.lower("column").alias("column"), "k", "value", "source_rank", "prefixed")
    per_node = s.where("scope = 'node'").drop("column").join(places.select("unique_id", "column"), "unique_id").select("unique_id", "column", "k", "value", "source_rank", "prefixed")
    w = Window.partitionBy("unique_id", "column", "k").orderBy("source_rank", F.desc("prefixed"), "value")
    return per_column.unionByName(per_node).withColumn("n", F.row_number().over(w)).where("n = 1").select("unique_id", "column", F.col("k").alias("key"), "value", "source_rank")


def chain(settings: DataFrame) -> DataFrame:
    """(unique_id, column, key, chain): every value in order of precedence, as rank=value."""
    ordered = F.array_sort(F.collect_list(F.struct("source_rank", "value")))
    return settings.groupBy("unique_id", "column", plain_key(F.col("key")).alias("key")).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["source_rank"].cast("string"), F.lit("="), x["value"])), " > ").alias("chain"))


def flag(resolved: DataFrame, key: str) -> DataFrame:
    return resolved.where(F.col("key") == key).select("unique_id", "column", F.col("value").alias("v"))


def property_value(mode: str, manifest: Column, yaml: Column) -> Column:
    """A property from the manifest, the YAML file, or ("auto") the YAML text where it still holds a template; "database" falls back to the manifest."""
    if mode == "yaml":
        return F.coalesce(yaml, manifest)
    if mode == "auto":
        return F.when(has_unrendered(yaml), yaml).otherwise(manifest)
    return manifest


def path_template(nodes: DataFrame, variables: dict[str, str] | None = None, default: str | None = None) -> DataFrame:
    """(unique_id, template): from config, config meta, meta, the unrendered config, then the project variable of the layer, then ``default``; a missing one is an error."""
    named = F.lit(None).cast("string")
    for layer, value in (variables or {}).items():
        named = F.when(F.array_contains("fqn", layer), F.lit(value)).otherwise(named)
    found = F.coalesce(F.col("config")[PREFIX], F.get_json_object(F.col("config")["meta"], f"$.{PREFIX}"), F.col("meta")[PREFIX], F.get_json_object(F.col("config")["unrendered"], f"$.{PREFIX}"), named)
    if default is not None:
        found = F.coalesce(found, F.lit(default))
    return nodes.select("unique_id", F.coalesce(found, F.raise_error(F.concat(F.lit("no path template for "), F.col("unique_id")))).alias("template"))
