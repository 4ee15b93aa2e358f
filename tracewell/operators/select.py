"""Which nodes and columns an operation covers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.storage import cut, grown

KINDS = ("model", "source", "seed")


def by_fqn(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes whose name path after the package begins with ``prefix`` (dotted)."""
    parts = prefix.split(".")
    return nodes.where(F.slice("fqn", F.lit(2), F.lit(len(parts))) == F.array(*map(F.lit, parts)))


def by_full_fqn(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes whose whole name path, package included, begins with ``prefix``."""
    parts = prefix.split(".")
    return nodes.where(F.slice("fqn", F.lit(1), F.lit(len(parts))) == F.array(*map(F.lit, parts)))


def by_fqn_text(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.array_join("fqn", ".").contains(part))


def by_file(nodes: DataFrame, paths: list[str]) -> DataFrame:
    """Nodes named by a file's stem, by the same file, or by a directory above it."""
    keep = F.lit(False)
    for p in paths:
        p = p.rstrip("/")
        keep = keep | (F.col("path") == p) | F.col("path").startswith(p + "/") | (F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1) == p)
    return nodes.where(F.coalesce(keep, F.lit(False)))


def candidates(nodes: DataFrame, package: str, include_external: bool = False, selected: list[str] | None = None, files: list[str] | None = None, fqn: str | None = None) -> DataFrame:
    """Models, sources and seeds of the own package; no ephemeral models; ``selected`` ids pass by the other filters."""
    base = nodes.where(F.col("resource_type").isin(*KINDS)).where(~((F.col("resource_type") == "model") & (F.coalesce("materialized", F.lit("")) == "ephemeral")))
    if not include_external:
        base = base.where(F.col("package_name") == package)
    if selected:
        return base.where(F.col("unique_id").isin(*selected))
    if files:
        base = by_file(base, files)
    return by_fqn(base, fqn) if fqn else base


def by_models(rows: DataFrame, names: list[str] | None) -> DataFrame:
    """Lineage rows of the named models, in any case, by (model, id, column)."""
    kept = rows.where(F.lower("model").isin(*[n.lower() for n in names])) if names else rows
    return kept.orderBy("model", "unique_id", "column")


def without_columns(columns: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    for p in patterns:
        columns = columns.where(~F.col("column").rlike(p))
    return columns


def select(nodes: DataFrame, edges: DataFrame, expression: str) -> DataFrame:
    """Nodes of a selector: methods name, ``tag:``, ``path:``, ``source:``, ``fqn:``, with ``+`` and ``@`` for closures, blanks for
    union and commas for intersection."""
    parts = []
    for group in expression.split():
        now = None
        for atom in group.split(","):
            one = _atom(nodes, edges, atom).select("unique_id").distinct()
            now = one if now is None else now.intersect(one)
        parts.append(now)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return nodes.join(out.distinct(), "unique_id", "left_semi")


def _atom(nodes: DataFrame, edges: DataFrame, atom: str) -> DataFrame:
    m = re.fullmatch(r"(@|\d*\+)?(.+?)(\+\d*)?", atom)
    before, what, after = m[1], m[2], m[3]
    method, _, value = what.rpartition(":")
    if method == "tag":
        base = nodes.where(F.array_contains("tags", value))
    elif method == "path":
        base = nodes.where(F.col("path").startswith(value))
    elif method == "source":
        name, _, table = value.partition(".")
        base = nodes.where(F.col("source_name") == name).where(F.lit(not table) | (F.col("name") == table))
    elif method == "fqn":
        base = by_full_fqn(nodes, value)
    elif method:
        raise ValueError(f"selector method {method!r} isn't supported")
    else:
        base = nodes.where(F.col("name") == value) if "*" not in value else nodes.where(F.col("name").like(value.replace("*", "%")))
    ids = base.select("unique_id")
    out = ids
    if before == "@" or after:
        down = _reach(ids, edges, "parent_uid", "child_uid", None if before == "@" or after == "+" else int(after[1:]))
        out = out.union(down)
        if before == "@":
            out = out.union(_reach(down, edges, "child_uid", "parent_uid", None))
    if before and before != "@":
        out = out.union(_reach(ids, edges, "child_uid", "parent_uid", None if before == "+" else int(before[:-1])))
    return out.distinct()


def _reach(ids: DataFrame, edges: DataFrame, at: str, to: str, steps: int | None) -> DataFrame:
    """``ids`` and what they reach within ``steps``, or at all: level by level until a level reaches nothing new."""
    step = edges.select(F.col(at).alias("unique_id"), F.col(to).alias("next"))
    seen = frontier = cut(ids.distinct())
    done = 0
    while steps is None or done < steps:
        nxt = frontier.join(step, "unique_id").select(F.col("next").alias("unique_id")).distinct()
        frontier = cut(nxt.join(seen, "unique_id", "left_anti"))
        if frontier.isEmpty():
            break
        done += 1
        seen = grown(seen, frontier, done)
    return seen
