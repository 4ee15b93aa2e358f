"""Generated sources and staging models, and descriptions from outside."""

from __future__ import annotations

import fnmatch
from typing import Callable, Iterable, Protocol

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import collapse


def matches(name: str, include: Iterable[str] = ("*",), exclude: Iterable[str] = ()) -> bool:
    return any(fnmatch.fnmatch(name, p) for p in include) and not any(fnmatch.fnmatch(name, p) for p in exclude)


def as_yaml(doc: dict) -> str:
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def source_definition(name: str, introspected: DataFrame, include: Iterable[str] = ("*",), exclude: Iterable[str] = ()) -> dict:
    """A source of a schema file from introspected columns, tables by glob."""
    tables: dict[str, list] = {}
    for r in introspected.orderBy("relation", "index").collect():
        if matches(r.relation, include, exclude):
            tables.setdefault(r.relation, []).append({"name": r.column.lower(), "data_type": r.data_type, **({"description": r.comment} if r.comment else {})})
    return {"version": 2, "sources": [{"name": name, "tables": [{"name": t, "columns": c} for t, c in tables.items()]}]}


def staging_sql(source: str, introspected: DataFrame) -> DataFrame:
    """(relation, sql): for each relation a model that lists its columns in snake case under their own names."""
    snake = F.lower(F.regexp_replace(F.regexp_replace("column", r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    line = F.when(snake == F.col("column"), F.col("column")).otherwise(F.concat("column", F.lit(" as "), snake))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))), lambda x: F.concat(F.lit("    "), x["l"])), ",\n")
    return introspected.groupBy("relation").agg(F.concat(F.lit("select\n"), lines, F.lit(f"\nfrom {{{{ source('{source}', '"), F.first("relation"), F.lit("') }}")).alias("sql"))


def staging_yaml(source: str, introspected: DataFrame, prefix: str = "stg") -> dict[str, str]:
    """Schema entries beside staging_sql(): by relation, a model named prefix_source__relation with its columns in snake case and their types."""
    snake = F.lower(F.regexp_replace(F.regexp_replace("column", r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    found: dict[str, list[dict]] = {}
    for r in introspected.orderBy("relation", "index").select("relation", snake.alias("name"), "data_type", "comment").collect():
        found.setdefault(r.relation, []).append({"name": r.name, "description": r.comment, "data_type": r.data_type})
    return {relation: render_model_yaml(f"{prefix}_{source}__{relation}", columns, f"Staged {relation} of {source}") for relation, columns in found.items()}


class DescriptionFetcher(Protocol):
    """Anything that gives texts for many names in one call."""

    def fetch(self, names: list[str]) -> dict[str, str]: ...


def merged(old: Column, new: Column, replaceable: tuple[str, ...] = (), force: bool = False) -> Column:
    """The text to write, or null for none: an empty or wholly replaceable old text gives way; one that begins with the new text stays; force overwrites."""
    o, n = collapse(old), collapse(new)
    whole = F.lit(False)
    for p in replaceable:
        whole = whole | o.rlike(f"^(?:{p})$")
    return F.when(n == "", F.lit(None)).when(o == "", n).when(whole, n).when(o.startswith(n), F.lit(None)).when(F.lit(force), n)


def enriched(columns: DataFrame, fetch: Callable[[list[str]], dict[str, str]], anchors: tuple[str, ...] = (), frozen: tuple[str, ...] = (), skip: tuple[str, ...] = (), replaceable: tuple[str, ...] = (), force: bool = False, owner: str | None = None) -> DataFrame:
    """``columns`` of models that match an anchor glob, with outside texts merged in; all others as they were.

    ``fetch`` gets every distinct name once. Columns in ``skip``, and those whose desc-owner is in ``frozen``, aren't touched; written ones get ``owner``.
    """
    wanted = F.lit(not anchors)
    for a in anchors:
        wanted = wanted | F.col("model").rlike(fnmatch.translate(a).replace("\\z", "$").replace("\\Z", "$"))
    free = wanted & ~F.lower("column").isin(*([s.lower() for s in skip] or [""])) & ~F.coalesce(F.col("meta")["desc-owner"], F.lit("")).isin(*(frozen or ("\0",)))
    names = [r[0] for r in columns.where(free).select(F.lower("column")).distinct().collect()]
    texts = columns.sparkSession.createDataFrame(sorted(fetch(names).items()), "t_name string, t_text string")
    x = columns.join(F.broadcast(texts), F.lower("column") == F.col("t_name"), "left").withColumn("new", F.when(free & F.col("t_text").isNotNull(), merged(F.col("description"), F.col("t_text"), replaceable, force)))
    meta = F.when(F.col("new").isNotNull() & F.lit(bool(owner)), F.map_concat(F.map_filter("meta", lambda k, v: k != "desc-owner"), F.create_map(F.lit("desc-owner"), F.lit(owner or "")))).otherwise(F.col("meta"))
    return x.withColumns({"description": F.coalesce("new", "description"), "meta": meta}).select(*columns.columns)


def render_model_yaml(name: str, columns: list[dict], description: str = "", width: int = 100) -> str:
    """A model's entry as YAML; long texts are folded."""

    class Folded(str):
        pass

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(Folded, lambda d, v: d.represent_scalar("tag:yaml.org,2002:str", v, style=">"))
    fold = lambda t: Folded(" ".join(t.split())) if len(t) > width else t
    doc = {"version": 2, "models": [{"name": name, **({"description": fold(description)} if description else {}), "columns": [{k: fold(v) if k == "description" else v for k, v in c.items() if v not in (None, "", [], {})} for c in columns]}]}
    return yaml.dump(doc, Dumper=Dumper, sort_keys=False, width=width, allow_unicode=True)


def models_of(spark: SparkSession, sql_by_relation: DataFrame) -> dict[str, str]:
    return {r.relation: r.sql for r in sql_by_relation.collect()}
