"""Lineage as text, DOT and JSON."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(closed: DataFrame) -> DataFrame:
    """(line) of a closure: indented by depth."""
    ordered = closed.orderBy("root_model", "root_column", "depth", "model", "column")
    return ordered.select(F.concat(F.col("root_model"), F.lit("."), F.col("root_column"), F.lit(": "), F.expr("repeat('  ', depth)"), F.col("model"), F.lit("."), F.col("column")).alias("line"))


def dot(vertices: DataFrame, links: DataFrame) -> str:
    """A DOT graph with a cluster for each model."""
    lines = ["digraph lineage {", "  rankdir=LR;"]
    clusters = vertices.where("kind = 'column'").groupBy("model").agg(F.array_sort(F.collect_list("column")).alias("c")).orderBy("model").collect()
    for i, r in enumerate(clusters):
        lines += [f'  subgraph cluster_{i} {{ label="{r.model}";', *(f'    "{r.model}.{c}" [label="{c}"];' for c in r.c), "  }"]
    lines += [f'  "{r.id}" [shape=box];' for r in vertices.where("kind = 'exposure'").orderBy("id").collect()]
    lines += [f'  "{r.source}" -> "{r.target}" [label="{r.type}"];' for r in links.orderBy("source", "target").collect()]
    return "\n".join([*lines, "}"])


def graph_json(vertices: DataFrame, links: DataFrame, main: str | None = None) -> DataFrame:
    """(json): one document with nodes, edges and the main node, for a viewer."""
    n = vertices.agg(F.array_sort(F.collect_list(F.struct("id", "kind", "model", "column"))).alias("nodes"))
    e = links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "type"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges", F.lit(main).alias("main_node"))).alias("json"))


def as_markdown(df: DataFrame) -> str:
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)])


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


FORMS = ("table", "text", "json", "markdown", "yaml")


def rendered(df: DataFrame, form: str = "table") -> str:
    """Every row of a report: a table, tab-separated text, a line of JSON for each row, Markdown, or YAML."""
    if form == "markdown":
        return as_markdown(df)
    if form == "json":
        return "\n".join(r.json for r in as_json_lines(df).collect())
    rows = df.collect()
    if form == "yaml":
        return yaml.safe_dump([r.asDict(recursive=True) for r in rows], sort_keys=False, allow_unicode=True).rstrip("\n") if rows else "[]"
    cells = [df.columns, *([("" if v is None else str(v)) for v in r] for r in rows)]
    if form == "text":
        return "\n".join("\t".join(x) for x in cells)
    if form != "table":
        raise ValueError(f"a report is one of {FORMS}, not {form!r}")
    sizes = [max(len(x[i]) for x in cells) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(n) for v, n in zip(x, sizes)).rstrip() for x in cells]
    return "\n".join([lines[0], "-+-".join("-" * n for n in sizes), *lines[1:]])
