"""Questions about the lineage graph: closures, impact, origins, depths, display graphs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import cut, grown

MAX_DEPTH = 60
#: Nodes that are sent to all tasks to tell which pairs of a closure can be found again.
MOST_KEPT = 100_000


@dataclass(frozen=True)
class Selector:
    """``[+]model[.column][+]``; no plus means both directions."""

    model: str
    column: str | None
    upstream: bool
    downstream: bool

    @classmethod
    def parse(cls, text: str) -> "Selector":
        m = re.fullmatch(r"(\+?)([^.+]+)(?:\.([^+]+))?(\+?)", text.strip())
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        up, down = bool(m[1]), bool(m[4])
        return cls(m[2].lower(), m[3].lower() if m[3] else None, up or not down, down or not up)


def closure(edges: DataFrame, up: bool = True, max_depth: int | None = None, only: Column | None = None) -> DataFrame:
    """(root_model, root_column, model, column, depth) of everything that each column comes from (``up``) or feeds; depth is the shortest way.

    All columns at once, or those whose root_model and root_column pass ``only``, to any depth unless ``max_depth`` is given; see closure_by_joins().
    """
    return closure_by_joins(edges, up, max_depth, only)


def closure_by_joins(edges: DataFrame, up: bool = True, max_depth: int | None = None, only: Column | None = None) -> DataFrame:
    """closure() level by level until a level reaches nothing new, each pair reached once: large, cyclic and diamond-rich graphs, too. Each level is checkpointed.

    Pairs grow at the end of the descendant, where a node's rows are its direct children: at the other end a few common ancestors would
    gather the pairs of all their descendants in as many tasks. Only with ``only`` they grow away from the roots. Of the pairs, those whose
    end leads on are joined, and of all found before, those that a new pair can repeat are compared, where few nodes tell them.
    """
    to = "parent" if up and only is not None else "child"
    origin = "child" if to == "parent" else "parent"
    near, far, pair = ["near_model", "near_column"], ["far_model", "far_column"], ["near_model", "near_column", "far_model", "far_column"]
    root, target = (near, far) if up and only is None else (far, near)
    step = edges.select(*[F.col(f"{e}_{k}").alias(f"{end}_{k}") for e, end in ((to, "near"), (origin, "far")) for k in ("model", "column")]).repartition(*near).distinct()
    leads = edges.select(*[F.col(f"{origin}_{k}").alias(f"near_{k}") for k in ("model", "column")]).distinct().withColumn("on", F.lit(True))
    step = cut(step.join(leads, near, "left").select(*pair, F.coalesce("on", F.lit(False)).alias("on")))
    seen, depth = step.withColumn("depth", F.lit(1)), 1
    if only is not None:
        seen = cut(seen.withColumnsRenamed(dict(zip(root, ("root_model", "root_column")))).where(only).withColumnsRenamed(dict(zip(("root_model", "root_column"), root))))
    last = seen
    while max_depth is None or depth < max_depth:
        frontier = last.where("on").select(F.col("near_model").alias("m"), F.col("near_column").alias("c"), *[F.col(k).alias(f"kept_{k}") for k in far])
        kept = frontier.select(*[f"kept_{k}" for k in far]).distinct()
        n = kept.count()
        if not n:
            break
        depth += 1
        nxt = step.withColumnsRenamed(dict(zip(far, "mc"))).join(frontier, ["m", "c"]).select(*near, *[F.col(f"kept_{k}").alias(k) for k in far], "on", F.lit(depth).alias("depth"))
        before = seen if n > MOST_KEPT else seen.join(F.broadcast(kept), [F.col(k).eqNullSafe(F.col(f"kept_{k}")) for k in far], "left_semi")
        found = nxt.unionByName(before).groupBy(*pair).agg(F.max("on").alias("on"), F.min("depth").alias("depth"))
        last = cut(found.where(F.col("depth") == depth))
        seen = grown(seen, last, depth)
    return seen.select(*[F.col(k).alias(v) for k, v in zip((*root, *target), ("root_model", "root_column", "model", "column"))], "depth")


def immediate_downstream(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent_model").alias("root_model"), F.col("parent_column").alias("root_column"), F.col("child_model").alias("model"), F.col("child_column").alias("column"), "transformation_type").distinct()


def references(closed: DataFrame, edges: DataFrame, nodes: DataFrame, exposures: DataFrame | None = None) -> DataFrame:
    """The closure as (root_model, root_column, kind, model, column, depth): kind is model, source, or exposure (of any model reached)."""
    names = nodes.select(F.col("lookup_name").alias("model"), F.when(F.col("resource_type") == "source", "source").otherwise("model").alias("kind")).distinct()
    out = closed.join(names, "model", "left").select("root_model", "root_column", F.coalesce("kind", F.lit("source")).alias("kind"), "model", "column", "depth")
    if exposures is not None:
        by = exposures.select(F.explode("depends_on").alias("unique_id"), F.col("name").alias("exposure")).join(nodes.select("unique_id", F.col("lookup_name").alias("model")), "unique_id").select("model", "exposure")
        shown = closed.select("root_model", "root_column", "model", "depth").join(by, "model").groupBy("root_model", "root_column", "exposure").agg(F.min("depth").alias("depth"))
        out = out.unionByName(shown.select("root_model", "root_column", F.lit("exposure").alias("kind"), F.col("exposure").alias("model"), F.lit(None).cast("string").alias("column"), "depth"))
    return out


def impact(edges: DataFrame, lineage: DataFrame, nodes: DataFrame, exposures: DataFrame) -> DataFrame:
    """For each column that feeds others: how many models, columns and exposures a change touches; ``critical`` are derived columns, all others low impact."""
    down = closure(edges, up=False)
    kinds = lineage.where("entry = 0").select(F.lower("model").alias("model"), "column", "transformation_type")
    counted = down.join(kinds, ["model", "column"], "left").groupBy("root_model", "root_column").agg(
        F.countDistinct("model").alias("affected_models"), F.count("*").alias("affected_columns"),
        F.count_if(F.col("transformation_type") == "derived").alias("critical_count"), F.count_if(~(F.coalesce("transformation_type", F.lit("")) == "derived")).alias("low_impact_count"),
    )
    uid = nodes.select("unique_id", F.col("lookup_name").alias("model"))
    by = exposures.select(F.explode("depends_on").alias("unique_id"), F.col("name").alias("exposure")).join(uid, "unique_id").select("model", "exposure")
    touched = down.select("root_model", "root_column", "model").union(down.select("root_model", "root_column", F.col("root_model").alias("model"))).distinct().join(by, "model").groupBy("root_model", "root_column").agg(F.countDistinct("exposure").alias("affected_exposures"))
    return counted.join(touched, ["root_model", "root_column"], "left").withColumn("affected_exposures", F.coalesce("affected_exposures", F.lit(0).cast("long")))


def is_wall():
    """Where a value is born: union, aggregate, window, literal, generated, or computed from no single column."""
    return F.col("is_union") | F.col("is_aggregate") | F.col("is_window") | F.col("is_literal") | F.col("is_generated") | (F.col("is_computed") & F.col("progenitor_column").isNull())


_ORIGIN = """
WITH RECURSIVE hop (model, column, at_model, at_column, depth) AS (
  SELECT lower(model), column, lower(model), column, 0 FROM {rows}
  UNION ALL
  SELECT h.model, h.column, r.progenitor_model, r.progenitor_column, h.depth + 1
  FROM hop h JOIN {rows} r ON lower(r.model) = h.at_model AND r.column = h.at_column
  WHERE NOT r.wall AND r.progenitor_model IS NOT NULL AND h.depth < MAXDEPTH AND NOT (r.progenitor_model = lower(r.model) AND r.progenitor_column = r.column)
)
SELECT h.model, h.column, h.at_model, h.at_column, CAST(h.depth AS INT) AS depth FROM hop h
"""


def origins(rows: DataFrame, nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(model, column, origin_schema, origin_model, origin_column, entry_column, depth): where each column's values come from.

    The walk follows the single source to a source table, or to the model where the value is born; there origin_column is empty and
    entry_column names the column to look for. Names are in upper case. A column whose walk ends nowhere known, or is longer than
    ``max_depth``, has no row.
    """
    spark = rows.sparkSession
    flagged = cut(rows.withColumn("wall", is_wall()))
    hops = spark.sql(_ORIGIN.replace("MAXDEPTH", str(max_depth)), rows=flagged)
    last = hops.withColumn("n", F.row_number().over(Window.partitionBy("model", "column").orderBy(F.desc("depth")))).where("n = 1").drop("n")
    end = flagged.select(F.lower("model").alias("at_model"), F.col("column").alias("at_column"), "wall", F.col("is_first_in_chain").alias("begins"), "progenitor_model")
    where = nodes.select(F.col("lookup_name").alias("at_model"), F.upper("schema_name").alias("origin_schema"), (F.col("resource_type") == "source").alias("is_source")).dropDuplicates(["at_model"])
    known = last.join(end, ["at_model", "at_column"], "left").join(where, "at_model", "left").where(f"depth < {max_depth}")
    ok = F.coalesce("wall", F.lit(False)) | F.coalesce("is_source", F.lit(False)) | (F.coalesce("begins", F.lit(False)) & F.col("progenitor_model").isNull())
    return known.where(ok).select("model", "column", F.coalesce("origin_schema", F.lit("")).alias("origin_schema"), F.upper("at_model").alias("origin_model"), F.when(F.coalesce("wall", F.lit(False)), "").otherwise(F.upper("at_column")).alias("origin_column"), F.upper("at_column").alias("entry_column"), "depth")


def soft_failures(rows: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(model, column, reason): walks that meet a cycle of several models or the depth limit."""
    hops = rows.sparkSession.sql(_ORIGIN.replace("MAXDEPTH", str(max_depth)), rows=rows.withColumn("wall", is_wall()))
    again = hops.groupBy("model", "column", "at_model", "at_column").count().where("count > 1").select("model", "column").distinct().withColumn("reason", F.lit("cycle"))
    deep = hops.groupBy("model", "column").agg(F.max("depth").alias("d")).where(f"d >= {max_depth}").select("model", "column", F.lit("max-depth").alias("reason")).join(again, ["model", "column"], "left_anti")
    return again.unionByName(deep)


def node_edges(nodes: DataFrame) -> DataFrame:
    """(parent_uid, child_uid) between nodes of the project, self references left out."""
    e = nodes.select(F.col("unique_id").alias("child_uid"), F.explode("depends_on").alias("parent_uid")).where("child_uid <> parent_uid")
    return e.join(nodes.select(F.col("unique_id").alias("parent_uid")), "parent_uid", "left_semi").distinct().select("parent_uid", "child_uid")


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unique_id, depth): the longest way to each node; null on or behind a cycle.

    Only nodes that have children go level by level, each checkpointed: those none of whose parents is left have the level as their longest
    way. One pass over all edges then gives every node the longest way of its parents and one more.
    """
    known, step = nodes.select("unique_id").distinct(), edges.select("parent_uid", "child_uid")
    left = cut(known.join(step.select(F.col("parent_uid").alias("unique_id")).distinct(), "unique_id", "left_semi"))
    inner = cut(step.join(left.withColumnRenamed("unique_id", "child_uid"), "child_uid", "left_semi").select(F.col("parent_uid").alias("unique_id"), "child_uid").distinct())
    found, depth = left.where("false").withColumn("depth", F.lit(0)), 0
    while True:
        blocked = inner.join(left, "unique_id", "left_semi").select(F.col("child_uid").alias("unique_id"))
        ready = cut(left.join(blocked, "unique_id", "left_anti"))
        if ready.isEmpty():
            break
        left, depth = cut(left.join(ready, "unique_id", "left_anti")), depth + 1
        found = grown(found, ready.withColumn("depth", F.lit(depth - 1)), depth)
    parents = found.union(left.withColumn("depth", F.lit(None).cast("int")))
    below = step.join(parents.withColumnRenamed("unique_id", "parent_uid"), "parent_uid").groupBy(F.col("child_uid").alias("unique_id")).agg(F.max("depth").alias("d"), F.min(F.col("depth").isNotNull()).alias("ended"))
    return known.join(below, "unique_id", "left").select("unique_id", F.when(F.col("ended").isNull(), 0).when(F.col("ended"), F.col("d") + 1).alias("depth"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unique_id, depth): the longest way from a node without parents. Nodes on or behind a cycle get 0."""
    return _peeled(nodes, edges).select("unique_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their depth in an order where parents come first; a cycle is an error."""
    d = cut(_peeled(nodes, edges))
    if not d.where("depth IS NULL").isEmpty():
        raise ValueError("the graph has a cycle")
    return nodes.join(d, "unique_id").orderBy("depth", "ord")


def waves(depth: DataFrame) -> DataFrame:
    """(depth, members): nodes that can be handled at the same time, in order."""
    return depth.groupBy("depth").agg(F.array_sort(F.collect_list("unique_id")).alias("members")).orderBy("depth")


def ancestors(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(unique_id, ancestor, generation): every ancestor once, by the shortest way; the node itself is generation 0.

    A closure with a visited set, so diamonds and cycles cost no more than their nodes, and there is no limit unless ``max_depth`` is one.
    """
    none = F.lit("")
    as_columns = edges.select(F.col("child_uid").alias("child_model"), none.alias("child_column"), F.col("parent_uid").alias("parent_model"), none.alias("parent_column"))
    above = closure(as_columns, True, max_depth).select(F.col("root_model").alias("unique_id"), F.col("model").alias("ancestor"), F.col("depth").alias("generation")).where("unique_id <> ancestor")
    return nodes.select("unique_id", F.col("unique_id").alias("ancestor"), F.lit(0).alias("generation")).union(above.join(nodes.select("unique_id"), "unique_id", "left_semi"))


def ancestors_depth_first(parents: dict[str, list[str]], node: str, max_depth: int = 100) -> dict[int, list[str]]:
    """Generations as a depth-first walk first reaches each ancestor; on the driver, for one node."""
    seen, out = set(), {}

    def visit(uid, generation):
        if uid in seen or generation > max_depth:
            return
        seen.add(uid)
        out.setdefault(generation, []).append(uid)
        for p in parents.get(uid, ()):
            visit(p, generation + 1)

    visit(node, 0)
    return {g: sorted(v) for g, v in out.items()}


def model_info(nodes: DataFrame, columns: DataFrame, edges: DataFrame, exposures: DataFrame) -> DataFrame:
    """(unique_id, name, resource_type, columns, upstream, downstream, exposures) of every node."""
    cols = columns.groupBy("unique_id").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    names = nodes.select("unique_id", "name")
    up = edges.join(names.withColumnRenamed("unique_id", "parent_uid"), "parent_uid").groupBy(F.col("child_uid").alias("unique_id")).agg(F.array_sort(F.collect_set("name")).alias("upstream"))
    down = edges.join(names.withColumnRenamed("unique_id", "child_uid"), "child_uid").groupBy(F.col("parent_uid").alias("unique_id")).agg(F.array_sort(F.collect_set("name")).alias("downstream"))
    shown = exposures.select(F.explode("depends_on").alias("unique_id"), "name").groupBy("unique_id").agg(F.array_sort(F.collect_set("name")).alias("exposures"))
    out = nodes.select("unique_id", "name", "resource_type")
    none = F.array().cast("array<string>")
    for part in (cols, up, down, shown):
        out = out.join(part, "unique_id", "left")
    return out.select("unique_id", "name", "resource_type", *[F.coalesce(c, none).alias(c) for c in ("columns", "upstream", "downstream", "exposures")])


def column_info(edges: DataFrame, lineage: DataFrame, model: str, column: str) -> DataFrame:
    """Both closures of one column: (direction, model, column, depth)."""
    own = (F.col("root_model") == model.lower()) & (F.col("root_column") == column.lower())
    up, down = closure(edges, True, only=own), closure(edges, False, only=own)
    return up.select(F.lit("upstream").alias("direction"), "model", "column", "depth").union(down.select(F.lit("downstream").alias("direction"), "model", "column", "depth"))


def select_lineage(edges: DataFrame, selector: str) -> DataFrame:
    s = Selector.parse(selector)
    parts = []
    for wanted, up, name in ((s.upstream, True, "upstream"), (s.downstream, False, "downstream")):
        if wanted:
            own = F.col("root_model") == s.model
            parts.append(closure(edges, up, only=own & (F.col("root_column") == s.column) if s.column else own).select(F.lit(name).alias("direction"), "root_column", "model", "column", "depth"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def display_graph(edges: DataFrame, exposures: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph nodes, graph edges): columns and exposures as vertices, each edge once."""
    cols = edges.select(F.col("child_model").alias("model"), F.col("child_column").alias("column")).union(edges.select("parent_model", "parent_column")).distinct()
    vertices = cols.select(F.concat("model", F.lit("."), "column").alias("id"), F.lit("column").alias("kind"), "model", "column")
    links = edges.select(F.concat("parent_model", F.lit("."), "parent_column").alias("source"), F.concat("child_model", F.lit("."), "child_column").alias("target"), F.col("transformation_type").alias("type")).distinct()
    shown = exposures.select(F.col("name").alias("exposure"), F.explode("depends_on").alias("unique_id")).join(nodes.select("unique_id", F.col("lookup_name").alias("model")), "unique_id")
    vertices = vertices.union(shown.select(F.concat(F.lit("exposure."), "exposure").alias("id"), F.lit("exposure").alias("kind"), F.col("exposure").alias("model"), F.lit(None).cast("string").alias("column")).distinct())
    ends = shown.join(cols, "model").select(F.concat("model", F.lit("."), "column").alias("source"), F.concat(F.lit("exposure."), "exposure").alias("target"), F.lit("exposure").alias("type")).distinct()
    return vertices, links.union(ends)


def folder_tree(nodes: DataFrame) -> DataFrame:
    """(parent, name, kind, unique_id): models by the folders of their path, sources by source name."""
    models = nodes.where("resource_type = 'model' AND path IS NOT NULL").select("unique_id", F.split("path", "/").alias("p"))
    parts = models.select("unique_id", "p", F.posexplode("p").alias("i", "name"))
    leaf = F.col("i") == F.size("p") - 1
    tree = parts.select(F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("parent"), "name", F.when(leaf, "model").otherwise("folder").alias("kind"), F.when(leaf, F.col("unique_id")).alias("unique_id")).distinct()
    sources = nodes.where("resource_type = 'source'").select(F.concat(F.lit("sources/"), F.coalesce("source_name", F.lit(""))).alias("parent"), "name", F.lit("source").alias("kind"), "unique_id")
    return tree.union(sources)
