"""Origin annotations on column descriptions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import equivalent, is_placeholder, without_keys


@dataclass(frozen=True)
class Style:
    namespace: str = "TRACEWELL"
    separator: str = "__________"
    renamed: str = "Renamed from:"
    derived: str = "Derived from:"
    computed: str = "Computed in:"
    aggregate_from: str = "Aggregated from"
    aggregate_in: str = "Aggregated in:"
    window_from: str = "Windowed from:"
    window_in: str = "Windowed in:"
    union: str = "UNION in:"
    literal: str = "Literal"
    generated: str = "Generated"
    renamed_key: str = "renamed_from"
    derived_key: str = "derived_from"
    computed_key: str = "computed_in"
    legacy: tuple[str, ...] = ()

    @property
    def verbs(self) -> tuple[str, ...]:
        return (self.renamed, self.derived, self.computed, self.aggregate_from, self.aggregate_in, self.window_from, self.window_in, self.union, self.literal, self.generated)

    @property
    def managed(self) -> tuple[str, ...]:
        return ("desc-owner", self.renamed_key, self.derived_key, self.computed_key)


STYLE = Style()


def block(tag: Column, style: Style = STYLE) -> Column:
    return F.concat(F.lit(f"{style.separator}\n{style.namespace} -> "), tag)


def here(verb: str) -> str:
    return verb.removesuffix("in:").rstrip() + " here"


def _cut_pattern(markers) -> str:
    """White space and one of the markers, and all that follows: cutting at each marker in turn ends at the earliest one."""
    quoted = "|".join(re.escape(m).replace("/", r"\/") for m in markers)
    return rf"(?s)\s*(?:{quoted}).*$"


def stripped(text: Column, style: Style = STYLE) -> Column:
    """A description without its annotation: cut at the separator, else at any verb, with the namespace or bare, or legacy marker."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, _cut_pattern([*(f"{style.namespace} -> {v}" for v in style.verbs), *style.verbs, *style.legacy]), "")
    return F.when(F.instr(t, style.separator) > 0, F.regexp_replace(t, _cut_pattern([style.separator]), "")).otherwise(bare)


def annotated(columns: DataFrame, rows: DataFrame, origins: DataFrame, nodes: DataFrame, modes: DataFrame, glossary: DataFrame | None = None, described: DataFrame | None = None, include_source_text: bool = True, write_meta: bool = False, style: Style = STYLE) -> DataFrame:
    """``columns`` with descriptions and meta rewritten: old annotations stripped, and new ones added where the model's mode asks for them.

    modes(unique_id, mode): "if_altered" annotates what is renamed, derived or born here, "always" passthroughs as well, anything else nothing.
    Sources stay as they are. Glossary columns take the glossary's text every time and lose the managed keys; columns without lineage
    are only cleaned, and filled from the glossary when empty. A description is never taken from upstream here. One select over joins.
    """
    spark = columns.sparkSession
    if glossary is None:
        glossary = spark.createDataFrame([], "column string, description string")
    gloss = F.broadcast(glossary.groupBy(F.lower("column").alias("g_column")).agg(F.min("description").alias("g_text")))
    r = rows.select(F.col("unique_id").alias("r_id"), F.lower("column").alias("r_column"), *[c for c in rows.columns if c.startswith(("is_", "progenitor"))], F.lit(True).alias("traced"))
    o = origins.select(F.col("model").alias("o_model"), F.col("column").alias("o_column"), "origin_schema", "origin_model", "origin_column", "entry_column")
    n = nodes.select("unique_id", F.upper("name").alias("n_name"), F.lower("name").alias("n_lower"), "resource_type")
    joined = columns.join(n, "unique_id").join(r, (F.col("unique_id") == F.col("r_id")) & (F.lower("column") == F.col("r_column")), "left")
    joined = joined.join(o, (F.col("n_lower") == F.col("o_model")) & (F.lower("column") == F.col("o_column")), "left")
    joined = joined.join(gloss, F.lower("column") == F.col("g_column"), "left").join(modes.select(F.col("unique_id").alias("m_uid"), "mode"), F.col("unique_id") == F.col("m_uid"), "left")
    if described is None:
        described = columns.join(nodes.select("unique_id", F.upper("name").alias("d_model")), "unique_id").select("d_model", F.upper("column").alias("d_column"), F.col("description").alias("d_text"))
    d = described.dropDuplicates(["d_model", "d_column"])

    on = F.coalesce("mode", F.lit("")).isin("if_altered", "always")
    own = F.trim(F.coalesce("description", F.lit("")))
    base_raw = stripped(own, style)
    base = F.when(is_placeholder(base_raw), F.lit("")).otherwise(base_raw)
    flag = lambda c: F.coalesce(c, F.lit(False))
    born = flag("is_union") | flag("is_literal") | flag("is_generated") | flag("is_aggregate") | flag("is_window")
    multi = flag("is_computed") & F.col("progenitor_column").isNull()
    single = F.col("progenitor_model").isNotNull() & F.col("progenitor_column").isNotNull()
    from_ = F.concat(F.upper("progenitor_model"), F.lit("."), F.upper("progenitor_column"))
    o_model = F.coalesce("origin_model", F.upper("progenitor_model"))
    o_column = F.coalesce("origin_column", F.upper("progenitor_column"), F.lit(""))
    joined = joined.withColumn("src_model", o_model).withColumn("src_column", o_column).join(d, (F.col("src_model") == F.col("d_model")) & (F.col("src_column") == F.col("d_column")), "left")
    o_model, o_column = F.col("src_model"), F.col("src_column")
    unknown, selfish = o_model.isNull(), o_model == F.col("n_name")

    inputs = F.array_join(F.transform(F.col("progenitors"), lambda p: F.concat(F.upper(p["model"]), F.lit("."), F.upper(p["column"]))), ", ")
    born_tag = (
        F.when(flag("is_union"), here(style.union)).when(flag("is_literal"), f"{style.literal} set here").when(flag("is_generated"), f"{style.generated} here")
        .when(flag("is_aggregate"), F.when(single, F.concat(F.lit(style.aggregate_from + " "), from_)).otherwise(here(style.aggregate_in)))
        .otherwise(F.when(single, F.concat(F.lit(style.window_from + " "), from_)).otherwise(here(style.window_in)))
    )
    multi_tag = F.when(F.size("progenitors") > 0, F.concat(F.lit(here(style.computed) + " from "), inputs)).otherwise(here(style.computed))
    computed_in = F.concat(F.lit(style.computed + " "), o_model, F.when(F.col("entry_column") != F.upper("column"), F.concat(F.lit(" (as "), F.col("entry_column"), F.lit(")"))).otherwise(""))
    changed = F.upper("column") != o_column
    source_text = F.nullif(F.trim(stripped(F.col("d_text"), style)), F.lit(""))
    dash = F.when(source_text.isNotNull() & ~equivalent(source_text, base) & F.lit(include_source_text), F.concat(F.lit(" — "), source_text)).otherwise("")
    verb = F.when(changed & flag("is_rename"), style.renamed).otherwise(style.derived)
    passed = F.when(changed | (F.col("mode") == "always"), F.concat(verb, F.lit(" "), o_model, F.lit("."), o_column, dash))
    tag = F.when(born, born_tag).when(multi, multi_tag).when(unknown | selfish, F.lit(None)).when(o_column == "", computed_in).otherwise(passed)

    glossed = F.col("g_text").isNotNull()
    with_tag = F.when(tag.isNull() | ~on, base).when(base == "", block(tag, style)).otherwise(F.concat(base, F.lit("\n\n"), block(tag, style)))
    traced = flag("traced")
    text = F.when(F.col("resource_type") == "source", F.col("description")).when(glossed, F.col("g_text")).when(~traced, base).otherwise(with_tag)
    marks = F.when(born, F.lit(None)).when(multi, F.struct(F.lit(style.computed_key).alias("k"), F.col("n_name").alias("v"))).when(unknown | selfish, F.lit(None)).when(o_column == "", F.struct(F.lit(style.computed_key).alias("k"), o_model.alias("v"))).otherwise(F.struct(F.when(flag("is_rename"), style.renamed_key).otherwise(style.derived_key).alias("k"), F.concat(o_model, F.lit("."), o_column).alias("v")))
    clean_all, clean_tags = without_keys(F.col("meta"), style.managed), without_keys(F.col("meta"), style.managed[1:])
    fresh = F.when(F.lit(write_meta) & marks.isNotNull(), F.map_concat(clean_tags, F.map_from_arrays(F.array(marks["k"]), F.array(marks["v"])))).otherwise(clean_tags)
    meta = F.when(F.col("resource_type") == "source", F.col("meta")).when(glossed | ~traced, clean_all).otherwise(fresh)
    kept = [c for c in columns.columns if c not in ("description", "meta", "config_meta")]
    return joined.select(*kept, text.alias("description"), meta.alias("meta"), F.when(F.col("resource_type") == "source", F.col("config_meta")).otherwise(without_keys(F.col("config_meta"), style.managed)).alias("config_meta")).select(*columns.columns)
