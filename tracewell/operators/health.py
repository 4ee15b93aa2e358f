"""Documentation coverage, gaps and priorities; suggestions of tests; running tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import PLACEHOLDERS, is_placeholder, lower, word_count
from tracewell.operators.annotate import STYLE, Style, stripped

GENERIC_MODEL = ("contains data", "model of", "table for", "this is a")
GENERIC_COLUMN = ("the value", "the name", "the id")


def node_health(columns: DataFrame, nodes: DataFrame, glossary: DataFrame, style: Style = STYLE) -> DataFrame:
    """(unique_id, total, undocumented, annotation_only, glossary, inherited, authored, coverage): each column in one class; no columns is 100 %."""
    g = F.broadcast(glossary.select(F.lower("column").alias("g_column")).distinct())
    raw = F.trim(F.coalesce("description", F.lit("")))
    bare = F.trim(stripped(raw, style))
    x = columns.join(g, F.lower("column") == F.col("g_column"), "left").select("unique_id", F.when(is_placeholder(raw), "undocumented").when(is_placeholder(bare), "annotation_only").when(F.col("g_column").isNotNull(), "glossary").when(F.lower(F.coalesce(F.col("meta")["desc-owner"], F.lit(""))) == "upstream", "inherited").otherwise("authored").alias("k"))
    kinds = ("undocumented", "annotation_only", "glossary", "inherited", "authored")
    got = x.groupBy("unique_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("k") == k).alias(k) for k in kinds])
    zero = F.lit(0).cast("long")
    out = nodes.select("unique_id").join(got, "unique_id", "left").select("unique_id", *[F.coalesce(c, zero).alias(c) for c in ("total", *kinds)])
    return out.withColumn("coverage", percent(F.col("glossary") + F.col("inherited") + F.col("authored"), F.col("total")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 100.0).otherwise(F.round(100.0 * part / whole, 2))


def project_health(health: DataFrame) -> DataFrame:
    sums = health.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "undocumented", "annotation_only", "glossary", "inherited", "authored")])
    return sums.withColumn("coverage", percent(F.col("glossary") + F.col("inherited") + F.col("authored"), F.col("total")))


def health_lines(health: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line): the text report, worst first."""
    x = health.join(nodes.select("unique_id", "name"), "unique_id").orderBy("coverage", "name")
    return x.select(F.format_string("%6.2f%%  %s (%d columns, %d undocumented)", "coverage", "name", "total", "undocumented").alias("line"))


def passes(health: DataFrame, least: float) -> bool:
    return project_health(health).head().coverage >= least


def model_gap(description: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """missing, poor, or null: no text or a placeholder; under three words or a generic phrase."""
    low = lower(description)
    generic = F.lit(False)
    for phrase in GENERIC_MODEL:
        generic = generic | low.contains(phrase)
    return F.when(is_placeholder(description, placeholders), "missing").when((word_count(description) < 3) | generic, "poor")


def is_documented(description: Column, placeholders: tuple[str, ...] = PLACEHOLDERS, generic: tuple[str, ...] = GENERIC_COLUMN) -> Column:
    return ~is_placeholder(description, placeholders) & (word_count(description) >= 2) & ~F.lower(F.coalesce(description, F.lit(""))).isin(*generic)


def priorities(nodes: DataFrame, columns: DataFrame, edges: DataFrame, gap: DataFrame) -> DataFrame:
    """(unique_id, gap, score): gap(unique_id, gap) weighed by fan-out, kind, place in the graph and size, 0 to 100."""
    n_cols = columns.groupBy("unique_id").agg(F.count("*").alias("n_columns"))
    fan = edges.groupBy(F.col("parent_uid").alias("unique_id")).agg(F.countDistinct("child_uid").alias("fan_out"))
    parents = nodes.select("unique_id", "resource_type", "patch_path", F.size("depends_on").alias("n_parents"))
    x = gap.join(parents, "unique_id").join(n_cols, "unique_id", "left").join(fan, "unique_id", "left").fillna(0, ["n_columns", "fan_out"])
    base = F.when(F.col("gap") == "missing", 50.0).when(F.col("gap") == "outdated", 40.0).when(F.col("gap") == "inconsistent", 20.0).otherwise(30.0)
    score = base + F.least(F.lit(30.0), F.col("fan_out") * 3.0) + F.when(F.col("resource_type") == "source", 15.0).otherwise(0.0) + 5.0 + F.when((F.col("n_parents") < 5) & (F.col("fan_out") > 2), 10.0).otherwise(0.0) + F.when(F.col("n_columns") > 10, 5.0).otherwise(0.0)
    return x.select("unique_id", "gap", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"))


def undocumented_models(nodes: DataFrame, columns: DataFrame, edges: DataFrame, min_columns: int = 3) -> DataFrame:
    """(unique_id, gap, score, band) of models (no sources) with a gap and enough columns, most urgent first."""
    enough = columns.groupBy("unique_id").count().where(F.col("count") >= min_columns).select("unique_id")
    gap = nodes.where("resource_type <> 'source'").select("unique_id", model_gap(F.col("description")).alias("gap")).where("gap IS NOT NULL").join(enough, "unique_id", "left_semi")
    return priorities(nodes, columns, edges, gap).withColumn("band", band(F.col("score"))).orderBy(F.desc("score"), "unique_id")


def undocumented_columns(nodes: DataFrame, columns: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """(unique_id, column, score): half the score of a missing text on their node."""
    scores = priorities(nodes, columns, edges, nodes.select("unique_id", F.lit("missing").alias("gap")))
    return columns.where(~is_documented(F.col("description"))).select("unique_id", "column").join(scores, "unique_id").select("unique_id", "column", (F.col("score") / 2).alias("score")).where(F.col("score") >= least)


def band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def coverage(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """(models, documented_models, columns, documented_columns, model_coverage, column_coverage, overall)."""
    m = nodes.where("resource_type = 'model'").agg(F.count("*").alias("models"), F.count_if(model_gap(F.col("description")).isNull()).alias("documented_models"))
    c = columns.join(nodes.where("resource_type = 'model'").select("unique_id"), "unique_id", "left_semi").agg(F.count("*").alias("columns"), F.count_if(is_documented(F.col("description"))).alias("documented_columns"))
    x = m.crossJoin(c).withColumns({"model_coverage": percent(F.col("documented_models"), F.col("models")), "column_coverage": percent(F.col("documented_columns"), F.col("columns"))})
    return x.withColumn("overall", F.round((F.col("model_coverage") + F.col("column_coverage")) / 2, 2))


def check_lengths(nodes: DataFrame, columns: DataFrame, model_length: int = 10, column_length: int = 5) -> DataFrame:
    """(unique_id, column, ok): texts of at least so many characters; column is null for the node itself."""
    n = nodes.select("unique_id", F.lit(None).cast("string").alias("column"), (F.length(F.trim("description")) >= model_length).alias("ok"))
    return n.union(columns.select("unique_id", "column", F.length(F.trim("description")) >= column_length))


SUFFIXES = ("_amount", "_at", "_bool", "_count", "_date", "_flag", "_id", "_time", "_ts")
PREFIXES = ("can_", "has_", "is_", "should_")
SUGGESTED = ("is_*", "status", "*_amount", "*_date", "*_id")


def pattern_of(column: Column) -> Column:
    out = F.lower(column)
    for p in reversed(PREFIXES):
        out = F.when(F.lower(column).startswith(p), p + "*").otherwise(out)
    for s in reversed(SUFFIXES):
        out = F.when(F.lower(column).endswith(s), "*" + s).otherwise(out)
    return out


def learned(tests: DataFrame, columns: DataFrame) -> DataFrame:
    """(scope, key, test_name, n, rank): the most used tests by name pattern (top 5), by data type (top 3) and overall (top 10).

    tests(unique_id, column, test_name); ties go by test name.
    """
    x = tests.join(columns.select("unique_id", "column", F.lower("data_type").alias("t")), ["unique_id", "column"], "left").select(pattern_of(F.col("column")).alias("p"), "t", "test_name")
    parts = [x.select(F.lit("pattern").alias("scope"), F.col("p").alias("key"), "test_name"), x.where("t IS NOT NULL").select(F.lit("type").alias("scope"), F.col("t").alias("key"), "test_name"), x.select(F.lit("all").alias("scope"), F.lit("").alias("key"), "test_name")]
    counts = parts[0].union(parts[1]).union(parts[2]).groupBy("scope", "key", "test_name").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "key").orderBy(F.desc("n"), "test_name")))
    return ranked.where("rank <= CASE scope WHEN 'pattern' THEN 5 WHEN 'type' THEN 3 ELSE 10 END")


def suggestions(columns: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, column, test_name, reason, confidence): tests that columns of the same pattern or type have and this one lacks."""
    known = learned(tests, columns)
    c = columns.select("unique_id", "column", pattern_of(F.col("column")).alias("p"), F.lower("data_type").alias("t"))
    by_pattern = c.where(F.col("p").isin(*SUGGESTED)).join(known.where("scope = 'pattern'"), F.col("p") == F.col("key")).select("unique_id", "column", "test_name", F.lit("pattern").alias("reason"))
    by_type = c.join(known.where("scope = 'type'"), F.col("t") == F.col("key")).select("unique_id", "column", "test_name", F.lit("type").alias("reason"))
    both = by_pattern.union(by_type).groupBy("unique_id", "column", "test_name").agg(F.min("reason").alias("reason"))
    return both.join(tests.select("unique_id", "column", "test_name"), ["unique_id", "column", "test_name"], "left_anti").withColumn("confidence", F.lit(0.7))


def suggestion_summary(nodes: DataFrame, columns: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, columns, tested_columns, tests, suggested) of each node."""
    c = columns.groupBy("unique_id").agg(F.count("*").alias("columns"))
    t = tests.groupBy("unique_id").agg(F.countDistinct("column").alias("tested_columns"), F.count("*").alias("tests"))
    s = suggestions(columns, tests).groupBy("unique_id").agg(F.count("*").alias("suggested"))
    x = nodes.select("unique_id").join(c, "unique_id", "left").join(t, "unique_id", "left").join(s, "unique_id", "left")
    return x.fillna(0)


# Extension: the tests that the suggestions name, run on data.


def failing_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Values of the key that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def failing_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def failing_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def failing_relationship(child: DataFrame, column: str, parent: DataFrame, to: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(to).alias(column)).distinct(), column, "left_anti")
