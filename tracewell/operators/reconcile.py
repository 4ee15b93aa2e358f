"""Declared columns against actual ones: inject, remove, sort, and types; pipelines of such steps."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import equivalent

UNKNOWN_INDEX = 99999


def cased(name: Column, case: str) -> Column:
    return {"upper": F.upper, "lower": F.lower}.get(case, lambda c: c)(name)


def inject_missing(columns: DataFrame, actual: DataFrame, nodes: DataFrame, from_database: bool = True, case: str = "keep") -> DataFrame:
    """Add columns that the relation has and the declaration lacks: actual(relation, column, data_type, index, comment).

    Sources always take the database's columns; models only with ``from_database`` (else give lineage's columns as ``actual``).
    """
    n = nodes.select("unique_id", F.lower("name").alias("n_low"), "name", "resource_type")
    a = actual.select(F.lower("relation").alias("n_low"), F.col("column").alias("a_column"), F.col("data_type").alias("a_type"), "index", "comment").join(n, "n_low")
    if not from_database:
        a = a.where("resource_type = 'source' OR comment IS NULL")
    missing = a.join(columns.select(F.col("unique_id").alias("c_id"), F.lower("column").alias("c_low")), (F.col("unique_id") == F.col("c_id")) & (F.lower("a_column") == F.col("c_low")), "left_anti")
    none = F.array().cast("array<string>")
    empty = F.map_from_arrays(none, none)
    new = missing.select("unique_id", F.col("name").alias("model"), cased(F.col("a_column"), case).alias("column"), F.col("index").cast("int").alias("ordinal"), F.col("a_type").alias("data_type"), F.coalesce("comment", F.lit("")).alias("description"), none.alias("tags"), empty.alias("meta"), empty.alias("config_meta"))
    return columns.unionByName(new)


def refresh_source_texts(columns: DataFrame, actual: DataFrame, nodes: DataFrame, prefer_declared: bool = False) -> DataFrame:
    """Sources' descriptions follow the database's comments unless these say the same or declarations are preferred."""
    a = actual.where("comment IS NOT NULL AND comment <> ''").select(F.lower("relation").alias("a_rel"), F.lower("column").alias("a_col"), "comment")
    x = columns.join(nodes.select("unique_id", "resource_type", F.lower("name").alias("n_low")), "unique_id").join(a, (F.col("n_low") == F.col("a_rel")) & (F.lower("column") == F.col("a_col")), "left")
    take = (F.col("resource_type") == "source") & F.col("comment").isNotNull() & ~equivalent(F.col("comment"), F.col("description"))
    if prefer_declared:
        take = take & (F.trim("description") == "")
    return x.withColumn("description", F.when(take, F.col("comment")).otherwise(F.col("description"))).select(*columns.columns)


def remove_extra(columns: DataFrame, actual: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop declared columns that the relation lacks; relations with no discovered column keep theirs."""
    a = actual.select(F.lower("relation").alias("n_low"), F.lower("column").alias("a_low")).join(nodes.select(F.col("unique_id").alias("a_id"), F.lower("name").alias("n_low")), "n_low").select("a_id", "a_low")
    kept = columns.join(a, (F.col("unique_id") == F.col("a_id")) & (F.lower("column") == F.col("a_low")), "left_semi")
    unknown = columns.join(a.select("a_id").distinct(), F.col("unique_id") == F.col("a_id"), "left_anti")
    return kept.unionByName(unknown)


def sort_by_index(columns: DataFrame, actual: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ordinals by the relation's own order; unknown columns last, in their old order."""
    a = actual.select(F.lower("relation").alias("n_low"), F.lower("column").alias("a_low"), "index").join(nodes.select(F.col("unique_id").alias("a_id"), F.lower("name").alias("n_low")), "n_low").select("a_id", "a_low", "index")
    x = columns.join(a, (F.col("unique_id") == F.col("a_id")) & (F.lower("column") == F.col("a_low")), "left")
    w = Window.partitionBy("unique_id").orderBy(F.coalesce("index", F.lit(UNKNOWN_INDEX)), F.col("ordinal").asc_nulls_last(), "column")
    return x.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int")).select(*columns.columns)


def sort_by_name(columns: DataFrame, case: str = "keep") -> DataFrame:
    w = Window.partitionBy("unique_id").orderBy(cased(F.col("column"), case), "column")
    return columns.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))


def sort_columns(columns: DataFrame, actual: DataFrame, nodes: DataFrame, by: str = "database") -> DataFrame:
    if by == "database":
        return sort_by_index(columns, actual, nodes)
    if by == "alphabetical":
        return sort_by_name(columns)
    raise ValueError(f"sort by database or alphabetical, not {by!r}")


def sync_types(columns: DataFrame, actual: DataFrame, nodes: DataFrame, case: str = "keep") -> DataFrame:
    """Declared types follow the relation's; in upper or lower case, or, kept, in lower case where the declared one was."""
    a = actual.select(F.lower("relation").alias("n_low"), F.lower("column").alias("a_low"), F.col("data_type").alias("a_type")).join(nodes.select(F.col("unique_id").alias("a_id"), F.lower("name").alias("n_low")), "n_low").select("a_id", "a_low", "a_type")
    x = columns.join(a, (F.col("unique_id") == F.col("a_id")) & (F.lower("column") == F.col("a_low")), "left")
    was_lower = F.coalesce(F.col("data_type") == F.lower("data_type"), F.lit(False))
    new = cased(F.col("a_type"), case) if case in ("upper", "lower") else F.when(was_lower, F.lower("a_type")).otherwise(F.col("a_type"))
    return x.withColumn("data_type", F.coalesce(new, "data_type")).select(*columns.columns)


@dataclass
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]

    def __rshift__(self, other: "Step | Pipeline") -> "Pipeline":
        return Pipeline([self]) >> other


@dataclass
class Pipeline:
    """Steps over a column table, chained by ``>>``. ``commit``: "none" leaves the result to the caller, "defer" gives it to the sink once at
    the end, "atomic" likewise but only if every step could be planned, "batch" after each step."""

    steps: list[Step]
    commit: str = "none"
    seconds: dict[str, float] = field(default_factory=dict)

    def __rshift__(self, other: "Step | Pipeline") -> "Pipeline":
        return Pipeline(self.steps + (other.steps if isinstance(other, Pipeline) else [other]), self.commit)

    def __call__(self, columns: DataFrame, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
        if self.commit not in ("none", "batch", "atomic", "defer"):
            raise ValueError(f"unknown commit mode {self.commit!r}")
        for step in self.steps:
            began = time.time()
            columns = columns.transform(step.run)
            self.seconds[step.name] = time.time() - began
            if sink and self.commit == "batch":
                sink(columns)
        if sink and self.commit in ("atomic", "defer"):
            sink(columns)
        return columns


def mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unique_id, column, change): added, removed or changed columns; what a check run counts."""
    from tracewell.functions.text import map_text

    view = lambda d: d.select("unique_id", "column", F.to_json(F.struct("ordinal", "data_type", "description", "tags", map_text(F.col("meta")).alias("meta"))).alias("v"))
    x = view(before).join(view(after).withColumnRenamed("v", "w"), ["unique_id", "column"], "full")
    return x.where("NOT v <=> w").select("unique_id", "column", F.when(F.col("v").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("changed").alias("change"))
