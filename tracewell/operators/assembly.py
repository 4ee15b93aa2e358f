"""From models' SQL to lineage tables: parse on the driver, everything after that as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.plans.lineage import EPHEMERAL_PREFIX, LineageParser, apply_placeholders
from tracewell.plans.reader import PlanReader
from tracewell.sources.manifest import last_by_lookup_name, upstream

#: Template names that can look like tables; never a column's source.
RESERVED = ("builtins", "config", "env_var", "flags", "model", "target", "this", "var")
DIALECTS = {"sqlserver": "tsql"}
CACHE_VERSION = 2


def dialect_of(adapter: str) -> str:
    return DIALECTS.get(adapter.lower(), adapter.lower())


@dataclass
class Parsed:
    lineage: DataFrame
    stars: DataFrame
    failures: DataFrame


def parse_models(spark: SparkSession, nodes: DataFrame, columns: DataFrame, placeholders: tuple[str, ...] = (), stop_at_ephemeral: bool = False, cache_dir: str | None = None, handlers: dict | None = None, dialect: str | None = None) -> Parsed:
    """Lineage of every SQL model: one row for each output column, star sources apart, failures per model.

    Texts go through the session's own parser on the driver, so only (id, SQL) is collected; a model that doesn't parse is a row of
    ``failures`` and doesn't stop the others. ``dialect`` says whose SQL it is (see dialect_of). With ``cache_dir`` results are kept by the
    SHA-256 of all they depend on: SQL, model, placeholders, known columns of tables named in it, handlers, dialect; empty ones never.
    """
    hints: dict[str, set[str]] = {}
    for r in columns.join(nodes.select("unique_id", "lookup_name"), "unique_id").groupBy("lookup_name").agg(F.collect_set("column").alias("c")).collect():
        hints[r.lookup_name] = set(r.c)
    parser = LineageParser(PlanReader(spark, dialect), hints, stop_at_ephemeral, handlers)
    how = [list(placeholders), stop_at_ephemeral, dialect, sorted((k, getattr(f, "__module__", ""), getattr(f, "__qualname__", repr(f))) for k, f in (handlers or {}).items())]
    lineage, stars, failures = [], [], []
    for r in nodes.where("language = 'sql' AND compiled_sql IS NOT NULL AND resource_type IN ('model', 'snapshot', 'seed')").orderBy("ord").select("unique_id", "name", "compiled_sql").collect():
        words = set(re.findall(r"\w+", r.compiled_sql.lower())) if cache_dir else set()
        key = json.dumps([r.compiled_sql, r.name, how, [(t, sorted(c)) for t, c in sorted(hints.items()) if t in words or not re.fullmatch(r"\w+", t)]])
        found = _cached(cache_dir, key)
        if found is None:
            try:
                sql = apply_placeholders(r.compiled_sql, placeholders)
                own = r.name if re.search(r"\bunion\b", sql, re.I) and r.name.lower() in sql.lower() else None
                got = parser.parse(sql, own)
            except Exception as e:
                failures.append((r.unique_id, r.name, str(e).split("\n")[0][:500]))
                continue
            found = {
                "columns": [(None, c, sorted(x.sources), x.kind, x.text, list(x.branches)) for c, x in got.columns.items()] + [(name, c, sorted(x.sources), x.kind, x.text, list(x.branches)) for name, cols in got.ephemeral.items() for c, x in cols.items()],
                "stars": [(t, sorted(e)) for t, e in got.star_sources],
            }
            _keep(cache_dir, key, found)
        for of, c, sources, kind, text, branches in found["columns"]:
            lineage.append((r.unique_id, of or r.name, c, 0, sources, kind, text, branches))
        stars += [(r.unique_id, r.name, t, e) for t, e in found["stars"]]
    return Parsed(spark.createDataFrame(lineage, schemas.LINEAGE), spark.createDataFrame(stars, schemas.STARS), spark.createDataFrame(failures, schemas.FAILURES))


def _cache_file(cache_dir: str, key: str) -> str:
    return os.path.join(cache_dir, f"v{CACHE_VERSION}-{hashlib.sha256(key.encode()).hexdigest()}.json")


_memory: dict[tuple[str, str], dict] = {}


def clear_cache(cache_dir: str) -> int:
    """Forget what is kept of a cache in memory and remove its files, of any version; how many there were."""
    for at in [k for k in _memory if k[0] == cache_dir]:
        del _memory[at]
    names = [n for n in os.listdir(cache_dir) if re.fullmatch(r"v\d+-[0-9a-f]{64}\.json", n)] if os.path.isdir(cache_dir) else []
    for n in names:
        os.remove(os.path.join(cache_dir, n))
    return len(names)


def _cached(cache_dir: str | None, key: str) -> dict | None:
    """From memory, else from the folder."""
    if not cache_dir:
        return None
    if (cache_dir, key) not in _memory:
        if not os.path.exists(path := _cache_file(cache_dir, key)):
            return None
        with open(path, encoding="utf-8") as f:
            _memory[cache_dir, key] = json.load(f)
    return _memory[cache_dir, key]


def _keep(cache_dir: str | None, key: str, found: dict) -> None:
    if not cache_dir or not (found["columns"] or found["stars"]):
        return
    _memory[cache_dir, key] = found
    os.makedirs(cache_dir, exist_ok=True)
    path = _cache_file(cache_dir, key)
    with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
        json.dump(found, f)
    os.replace(f"{path}.{os.getpid()}", path)


def stale_models(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes whose compiled file is missing or older than its source: files(path, kind 'source' or 'compiled', modified)."""
    by = files.groupBy("path").agg(F.max(F.when(F.col("kind") == "source", F.col("modified"))).alias("source"), F.max(F.when(F.col("kind") == "compiled", F.col("modified"))).alias("compiled"))
    return nodes.join(by, "path", "left").where("compiled IS NULL OR compiled < source").select("unique_id", "name", "path")


def with_stars(parsed: Parsed, nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """Lineage with star sources resolved: a column declared on the model and on the star's table gets direct lineage,
    after what the SQL names; equal source sets once."""
    alias = last_by_lookup_name(nodes)
    source_columns = columns.join(alias, "unique_id").select(F.col("lookup_name").alias("source_model"), "column").distinct()
    own = columns.select("unique_id", "column")
    found = parsed.stars.join(source_columns, "source_model").where(~F.array_contains("excepts", F.col("column"))).join(own, ["unique_id", "column"])
    rows = found.select("unique_id", "model", "column", F.lit(1).alias("entry"), F.array(F.concat("source_model", F.lit("."), "column")).alias("source_columns"), F.lit("direct").alias("transformation_type"), F.col("column").alias("sql_expression"), F.array().cast("array<string>").alias("union_branches"))
    both = parsed.lineage.unionByName(rows)
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("unique_id", "model", "column", "source_columns").orderBy("entry"))).where("n = 1").drop("n")
    order = Window.partitionBy("unique_id", "model", "column").orderBy("entry", F.array_join("source_columns", ","))
    return first.withColumn("entry", (F.row_number().over(order) - 1).cast("int"))


def with_stub_columns(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """Declared columns, and undeclared ones that lineage found."""
    found = lineage.select("unique_id", "model", "column").distinct().join(columns.select("unique_id", "column"), ["unique_id", "column"], "left_anti")
    none = F.lit(None).cast("string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    stub = found.select("unique_id", "model", "column", F.lit(None).cast("int").alias("ordinal"), none.alias("data_type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("tags"), empty.alias("meta"), empty.alias("config_meta"))
    return columns.unionByName(stub)


def _pair(c):
    return F.struct(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), "^" + EPHEMERAL_PREFIX, "").alias("model"), F.substring_index(c, ".", -1).alias("column"))


def public_rows(lineage: DataFrame, nodes: DataFrame, include_ephemeral: bool = False) -> DataFrame:
    """One row for each model column, by its first entry: flags by type, the single source (null when there are several), all sources or a union's branches in order, and
    whether the chain begins here (no source, or a passthrough of a source or seed).

    Rows of ephemeral models (``include_ephemeral``) have the model's own name and say only whether a column is derived or renamed.
    """
    first = lineage.where("entry = 0")
    if not include_ephemeral:
        first = first.where(~F.col("model").startswith(EPHEMERAL_PREFIX))
    kinds = last_by_lookup_name(nodes).join(nodes.select("unique_id", "resource_type"), "unique_id").select(F.col("lookup_name").alias("progenitor_model"), F.col("resource_type").alias("kind"))
    t = F.col("transformation_type")
    sources = F.filter("source_columns", lambda s: ~F.regexp_replace(s, r"\.[^.]*$", "").isin(*RESERVED) & s.contains("."))
    rows = first.withColumn("s", F.array_sort(sources))
    one = F.size("s") == 1
    progenitor = F.when(one, _pair(F.col("s")[0]))
    rows = rows.select(
        "unique_id", "model", "column", t.alias("transformation_type"),
        progenitor["model"].alias("progenitor_model"), progenitor["column"].alias("progenitor_column"),
        (t == "renamed").alias("is_rename"), t.isin("derived", "aggregate", "window", "literal", "generated").alias("is_computed"),
        (t == "aggregate").alias("is_aggregate"), (t == "window").alias("is_window"), (t == "literal").alias("is_literal"), (t == "union").alias("is_union"), (t == "generated").alias("is_generated"),
        F.when(t == "literal", F.col("sql_expression")).alias("literal_value"), F.when(t == "generated", F.col("sql_expression")).alias("generated_value"),
        F.transform(F.when(t == "union", F.col("union_branches")).otherwise(F.col("s")), _pair).alias("progenitors"),
        F.transform("union_branches", _pair).alias("union_branches"),
    )
    rows = rows.join(F.broadcast(kinds), "progenitor_model", "left")
    passthrough = F.col("transformation_type").isin("direct", "renamed")
    begins = F.col("progenitor_model").isNull() | F.coalesce(F.col("kind").isin("source", "seed"), F.lit(False))
    rows = rows.withColumn("is_first_in_chain", passthrough & begins)
    if include_ephemeral:
        eph, derived = F.col("model").startswith(EPHEMERAL_PREFIX), F.col("transformation_type") == "derived"
        plain = {c: F.when(eph, F.lit(False)).otherwise(F.col(c)) for c in ("is_aggregate", "is_window", "is_literal", "is_union", "is_generated")}
        plain |= {c: F.when(~eph, F.col(c)) for c in ("literal_value", "generated_value", "progenitors", "union_branches")}
        rows = rows.withColumns({**plain, "is_first_in_chain": F.when(eph, begins & ~derived).otherwise(F.col("is_first_in_chain")), "is_computed": F.when(eph, derived).otherwise(F.col("is_computed"))})
        rows = rows.withColumn("model", F.regexp_replace("model", "^" + EPHEMERAL_PREFIX, ""))
    return rows.drop("kind")


def lineage_edges(lineage: DataFrame, nodes: DataFrame, follow_unions: bool = False, seeds: bool = False, declared_only: bool = True) -> DataFrame:
    """(child_model, child_column, parent_model, parent_column, transformation_type, ordinal): an edge for each source of each column.

    A union's columns have no sources, so closures end there unless ``follow_unions``. With ``declared_only`` an edge counts when its table is
    a declared parent of the model, or none of the project's.
    """
    t = F.col("transformation_type")
    sources = F.when(t == "union", F.col("union_branches") if follow_unions else F.array().cast("array<string>")).otherwise(F.col("source_columns"))
    rows = lineage.select("unique_id", "model", "column", t, F.posexplode(sources).alias("ordinal", "source")).where(F.col("source").contains("."))
    p = _pair(F.col("source"))
    edges = rows.select("unique_id", F.lower("model").alias("child_model"), F.col("column").alias("child_column"), p["model"].alias("parent_model"), p["column"].alias("parent_column"), t, "ordinal").where(~F.col("parent_model").isin(*RESERVED))
    if declared_only:
        allowed = upstream(nodes, seeds).select(F.col("child_uid").alias("unique_id"), F.col("parent").alias("parent_model")).distinct()
        edges = edges.join(allowed, ["unique_id", "parent_model"], "left_semi")
    return edges.groupBy("child_model", "child_column", "parent_model", "parent_column").agg(F.min("transformation_type").alias("transformation_type"), F.min("ordinal").alias("ordinal"))


def parent_map(rows: DataFrame) -> DataFrame:
    """(model, column, parent): the single source's model, or ``__computed__``."""
    return rows.select("model", "column", F.coalesce("progenitor_model", F.lit("__computed__")).alias("parent"))


def columns_of_models(rows: DataFrame, lineage_order: DataFrame | None = None) -> DataFrame:
    """(model, column, index): the order of the SELECT where given as (model, column, ordinal), else by name."""
    if lineage_order is not None:
        return lineage_order.select("model", "column", F.col("ordinal").alias("index"))
    return rows.select("model", "column", (F.row_number().over(Window.partitionBy("model").orderBy("column")) - 1).alias("index"))


def sources_by_address(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources by (database, schema, identifier), in any case: wanted(database, schema_name, identifier)."""
    s = nodes.where("resource_type = 'source'").select("unique_id", F.upper("database").alias("d"), F.upper("schema_name").alias("s"), F.upper("lookup_name").alias("i"))
    return wanted.join(s, (F.upper("database") == F.col("d")) & (F.upper("schema_name") == F.col("s")) & (F.upper("identifier") == F.col("i"))).select("database", "schema_name", "identifier", "unique_id")
