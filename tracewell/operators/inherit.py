"""Descriptions, tags and meta carried along the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import is_placeholder, name_variants, normal, overlay, without_keys
from tracewell.operators.annotate import STYLE, Style, stripped
from tracewell.operators.graph import is_wall
from tracewell.storage import cut, grown


def _texts(columns: DataFrame, nodes: DataFrame, style: Style) -> DataFrame:
    own = F.trim(stripped(F.col("description"), style))
    return columns.join(nodes.select("unique_id", "lookup_name", "resource_type"), "unique_id").select("unique_id", "resource_type", F.col("lookup_name").alias("model"), F.lower("column").alias("column"), F.when(~is_placeholder(own), own).alias("own"), "tags", "meta")


def _setting(resolved: DataFrame, key: str, to: str) -> DataFrame:
    return resolved.where(F.col("key") == key).select("unique_id", F.lower("column").alias("column"), F.lower("value").alias(to))


def resolved_texts(columns: DataFrame, rows: DataFrame, nodes: DataFrame, depth: DataFrame, settings: DataFrame, through_renames: bool = False, style: Style = STYLE) -> DataFrame:
    """(unique_id, model, column, text, origin, tags, meta): the authoritative description of every column and the MODEL.COLUMN where it was
    first written, with its tags and meta after those of its single source, as that has them by then, were added.

    Waves by depth, one join each, since a column's text depends on texts of models before it: sources end the walk; so do columns without
    lineage and those born here, with their own text. A union takes its branches' text when all that have one agree (origin unknown), else its own. A
    rename or derivation under another name keeps its own text unless ``inherit-through-renames`` is set. Elsewhere a column that owns its text
    (``desc-owner`` isn't "upstream") and differs from upstream defines it anew; otherwise upstream's passes through; a copy without
    anything upstream has none.
    """
    texts = _texts(columns, nodes, style)
    known = texts.join(depth, "unique_id")
    r = rows.withColumn("wall", is_wall()).select("unique_id", F.lower("column").alias("column"), "wall", "is_union", "progenitor_model", F.lower("progenitor_column").alias("progenitor_column"), "union_branches", F.lit(True).alias("traced"))
    facts = known.join(r, ["unique_id", "column"], "left").join(_setting(settings, "inherit-through-renames", "through"), ["unique_id", "column"], "left").join(_setting(settings, "desc-owner", "owner"), ["unique_id", "column"], "left")
    facts = facts.join(_setting(settings, "skip-add-tags", "no_tags"), ["unique_id", "column"], "left").join(_setting(settings, "skip-merge-meta", "no_meta"), ["unique_id", "column"], "left")
    facts = cut(facts.withColumn("here", F.concat(F.upper("model"), F.lit("."), F.upper("column"))))
    levels = [x.depth for x in facts.select("depth").distinct().orderBy("depth").collect()]
    done = None
    for level in levels:
        now = facts.where(F.col("depth") == level)
        if done is None:
            up = now.select(F.col("model").alias("progenitor_model"), F.col("column").alias("progenitor_column"), F.lit(None).cast("string").alias("p_text"), F.lit(None).cast("string").alias("p_origin"), F.col("tags").alias("p_tags"), F.col("meta").alias("p_meta")).limit(0)
            agreed = now.select("unique_id", "column", F.lit(None).cast("string").alias("u_text"), F.lit(None).cast("boolean").alias("agree")).limit(0)
        else:
            up = done.select(F.col("model").alias("progenitor_model"), F.col("column").alias("progenitor_column"), F.col("text").alias("p_text"), F.col("origin").alias("p_origin"), F.col("tags").alias("p_tags"), F.col("meta").alias("p_meta")).dropDuplicates(["progenitor_model", "progenitor_column"])
            agreed = union_agreement(now, done)
        x = now.join(up, ["progenitor_model", "progenitor_column"], "left").join(agreed, ["unique_id", "column"], "left")
        owns = F.coalesce("owner", F.lit("this")) != "upstream"
        traced, union = F.coalesce("traced", F.lit(False)), F.coalesce("is_union", F.lit(False))
        gated = (F.col("progenitor_column") != F.col("column")) & ~(F.coalesce("through", F.lit(str(through_renames).lower())) == "true")
        selfish = (F.col("progenitor_model") == F.col("model")) & (F.col("progenitor_column") == F.col("column"))
        upper = F.when(~selfish, F.col("p_text"))
        differs = F.col("own").isNotNull() & (upper.isNull() | (normal(F.col("own")) != normal(upper)))
        keep = (F.col("resource_type") == "source") | ~traced | (F.coalesce("wall", F.lit(False)) & ~union) | (F.col("progenitor_model").isNull() & ~union)
        u_differs = F.col("own").isNotNull() & (normal(F.col("own")) != normal(F.col("u_text")))
        u_ok = F.coalesce("agree", F.lit(False))
        text = F.when(keep, F.col("own")).when(union, F.when(u_ok, F.when(u_differs & owns, F.col("own")).otherwise(F.col("u_text"))).otherwise(F.col("own"))).when(gated, F.col("own")).when(owns & differs, F.col("own")).otherwise(upper)
        origin = F.when(keep, F.col("here")).when(union, F.when(u_ok & ~(u_differs & owns), F.lit(None)).otherwise(F.col("here"))).when(gated, F.col("here")).when(owns & differs, F.col("here")).otherwise(F.col("p_origin"))
        takes = traced & (F.col("resource_type") != "source") & ~F.coalesce("wall", F.lit(False)) & F.col("p_tags").isNotNull()
        tags = F.when(takes & ~(F.coalesce("no_tags", F.lit("false")) == "true") & (F.size("p_tags") > 0), F.array_sort(F.array_union("tags", "p_tags"))).otherwise(F.col("tags"))
        meta = F.when(takes & ~(F.coalesce("no_meta", F.lit("false")) == "true"), overlay(without_keys(F.col("p_meta"), style.managed), F.col("meta"))).otherwise(F.col("meta"))
        wave = x.withColumn("text", text).select("unique_id", "model", "column", "text", F.when(F.col("text").isNotNull(), origin).alias("origin"), tags.alias("tags"), meta.alias("meta"))
        # Only the wave is written; on every 16th level its predecessors again, so the parts stay few.
        wave = cut(wave)
        done = wave if done is None else grown(done, wave, level)
    return done


def union_agreement(facts: DataFrame, done: DataFrame) -> DataFrame:
    """(unique_id, column, u_text, agree): the first branch text of each union column, and whether all branches that have one say the same."""
    b = facts.where("is_union").select("unique_id", "column", F.posexplode("union_branches").alias("at", "b"))
    texts = b.select("unique_id", "column", "at", F.lower(F.col("b.model")).alias("model"), F.lower(F.col("b.column")).alias("b_column")).join(done.select("model", F.col("column").alias("b_column"), "text").dropDuplicates(["model", "b_column"]), ["model", "b_column"]).where("text IS NOT NULL")
    return texts.groupBy("unique_id", "column").agg(F.min_by("text", "at").alias("u_text"), (F.countDistinct(normal(F.col("text"))) == 1).alias("agree"))


def inherited(columns: DataFrame, rows: DataFrame, nodes: DataFrame, depth: DataFrame, settings: DataFrame, through_renames: bool = False, style: Style = STYLE) -> DataFrame:
    """``columns`` after inheritance: gaps and upstream-owned texts filled, tags united and meta overlaid from the single source.

    ``settings`` are resolved ones (unique_id, column, key, value): desc-owner, inherit-through-renames, skip-add-tags, skip-merge-meta.
    Aggregates, windows, literals, generated and multi-source columns inherit nothing; unions take texts only. A text that is filled in,
    or equals upstream's, gets ``desc-owner: upstream`` in its meta, so later runs keep it in step; it is never removed here.
    """
    truth = resolved_texts(columns, rows, nodes, depth, settings, through_renames, style)
    r = rows.withColumn("wall", is_wall()).where("NOT wall OR is_union").select(F.col("unique_id").alias("r_id"), F.lower("column").alias("r_column"), "is_union", "is_rename", "progenitor_model", F.lower("progenitor_column").alias("progenitor_column"), "union_branches")
    up = truth.select(F.col("model").alias("progenitor_model"), F.col("column").alias("progenitor_column"), F.col("text").alias("p_text"), F.col("origin").alias("p_origin")).dropDuplicates(["progenitor_model", "progenitor_column"])
    agreed = union_agreement(r.withColumnsRenamed({"r_column": "column", "r_id": "unique_id"}), truth).select(F.col("unique_id").alias("u_id"), F.col("column").alias("u_column"), "u_text", "agree")
    x = columns.join(nodes.select("unique_id", F.upper("name").alias("n_name"), F.col("resource_type").alias("n_type")), "unique_id").withColumn("c_low", F.lower("column"))
    x = x.join(r, (F.col("unique_id") == F.col("r_id")) & (F.col("c_low") == F.col("r_column")), "left").join(up, ["progenitor_model", "progenitor_column"], "left")
    x = x.join(agreed, (F.col("unique_id") == F.col("u_id")) & (F.col("c_low") == F.col("u_column")), "left")
    x = x.join(truth.select(F.col("unique_id").alias("t_id"), F.col("column").alias("t_column"), F.col("tags").alias("t_tags"), F.col("meta").alias("t_meta")), (F.col("unique_id") == F.col("t_id")) & (F.col("c_low") == F.col("t_column")), "left")
    for key, to in (("inherit-through-renames", "through"), ("desc-owner", "owner")):
        s = _setting(settings, key, to)
        x = x.join(s.select(F.col("unique_id").alias(f"{to}_id"), F.col("column").alias(f"{to}_c"), to), (F.col("unique_id") == F.col(f"{to}_id")) & (F.col("c_low") == F.col(f"{to}_c")), "left")
    model = F.col("n_type") != "source"
    union = F.coalesce("is_union", F.lit(False))
    one = F.col("progenitor_model").isNotNull()
    renamed = F.coalesce("is_rename", F.lit(False)) | (F.col("progenitor_column") != F.lower("column"))
    gated = renamed & ~(F.coalesce("through", F.lit(str(through_renames).lower())) == "true")
    offer = F.when(union, F.when(F.coalesce("agree", F.lit(False)), F.col("u_text"))).when(one & ~gated, F.col("p_text"))
    origin = F.when(one & ~gated & ~union, F.col("p_origin"))
    existing = F.trim(F.coalesce("description", F.lit("")))
    own_text = F.trim(stripped(existing, style))
    owner = F.coalesce(F.col("meta")["desc-owner"], F.col("owner"), F.lit("this"))
    force = (F.lower(owner) == "upstream") | ((existing != "") & (own_text == ""))
    empty = existing == ""
    fill = model & offer.isNotNull() & (force | empty)
    text = F.when(fill, offer).otherwise(F.col("description"))
    final = F.when(fill, offer).otherwise(own_text)
    tags, meta = F.coalesce("t_tags", "tags"), F.coalesce("t_meta", "meta")
    here = F.concat(F.col("n_name"), F.lit("."), F.upper("column"))
    inject = model & ~force & (F.lower(owner) == "this") & origin.isNotNull() & (origin != here) & (final != "") & (empty & fill | (final == offer))
    meta = F.when(F.coalesce(inject, F.lit(False)), overlay(meta, F.create_map(F.lit("desc-owner"), F.lit("upstream")))).otherwise(meta)
    kept = [c for c in columns.columns if c not in ("description", "tags", "meta")]
    return x.select(*kept, text.alias("description"), tags.alias("tags"), meta.alias("meta")).select(*columns.columns)


def by_name(columns: DataFrame, nodes: DataFrame, ancestors: DataFrame, prefixes: DataFrame | None = None, plugins: tuple = (), style: Style = STYLE) -> DataFrame:
    """(unique_id, column, description, tags, meta) by name alone, from ancestors far to near; used where there is no lineage.

    A column matches an ancestor's column under one of its name variants (``plugins`` add functions column → array of candidates), best variant first; of
    a generation the first ancestor wins. Placeholders and empty texts don't count. Nearer texts overwrite farther ones, tags unite, meta overlays.
    """
    variants = name_variants(F.col("column"), F.col("prefix")) if prefixes is not None else name_variants(F.col("column"))
    base = columns.join(prefixes, "unique_id", "left").fillna("", ["prefix"]) if prefixes is not None else columns
    for plugin in plugins:
        variants = F.array_distinct(F.concat(variants, plugin(F.col("column"))))
    want = base.select("unique_id", "column", F.posexplode(variants).alias("rank", "candidate"))
    have = columns.select(F.col("unique_id").alias("ancestor"), F.col("column").alias("candidate"), F.trim(stripped(F.col("description"), style)).alias("text"), F.col("tags").alias("a_tags"), without_keys(F.col("meta"), style.managed).alias("a_meta"))
    hits = want.join(ancestors.where("generation > 0"), "unique_id").join(have, ["ancestor", "candidate"])
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("unique_id", "column", "generation").orderBy("ancestor", "rank"))).where("n = 1")
    text = F.when(~is_placeholder(F.col("text")), F.col("text"))
    return first.groupBy("unique_id", "column").agg(F.min_by(text, F.when(text.isNotNull(), F.col("generation"))).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("a_tags")))).alias("tags"), F.reverse(F.array_sort(F.collect_list(F.struct("generation", F.map_entries("a_meta").alias("m"))))).alias("l")).select(
        "unique_id", "column", "description", "tags", F.map_from_entries(F.aggregate("l", F.array().cast("array<struct<key:string,value:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda e: ~F.exists(x["m"], lambda y: y["key"] == e["key"])), x["m"]))).alias("meta")
    )


def clean_edges(columns: DataFrame) -> DataFrame:
    """Placeholders and blanks become null, as do empty tags and meta."""
    return columns.withColumns({"description": F.when(~is_placeholder(F.col("description")), F.trim("description")), "tags": F.when(F.size("tags") > 0, F.col("tags")), "meta": F.when(F.size(F.map_keys("meta")) > 0, F.col("meta"))})


def merge_edges(far: DataFrame, near: DataFrame) -> DataFrame:
    """Two generations of (unique_id, column, description, tags, meta): near texts win, tags unite, near meta overlays."""
    n = near.select("unique_id", "column", F.col("description").alias("d2"), F.col("tags").alias("t2"), F.col("meta").alias("m2"))
    x = far.join(n, ["unique_id", "column"], "full")
    none, empty = F.array().cast("array<string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return x.select("unique_id", "column", F.coalesce("d2", "description").alias("description"), F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("t2", none))).alias("tags"), overlay(F.coalesce("meta", empty), F.coalesce("m2", empty)).alias("meta"))


def with_unrendered(columns: DataFrame, raw: DataFrame) -> DataFrame:
    """Descriptions as the files have them, where these still hold a template: raw(unique_id, column, description)."""
    r = raw.select("unique_id", "column", F.col("description").alias("raw_text"))
    templated = F.coalesce(F.col("raw_text").contains("{{") | F.col("raw_text").contains("{%"), F.lit(False))
    return columns.join(r, ["unique_id", "column"], "left").withColumn("description", F.when(templated, F.col("raw_text")).otherwise(F.col("description"))).select(*columns.columns)
