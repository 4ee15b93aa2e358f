"""Schema drift between declared and actual columns, and migration steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import ratio

THRESHOLD = 85.0
#: Type families, tried in order, by words their names contain.
FAMILIES = (("integer", ("int",)), ("float", ("real", "double", "float")), ("text", ("char", "clob", "string", "text")), ("boolean", ("bit", "bool")), ("timestamp", ("datetime", "timestamp")), ("date", ("date",)), ("numeric", ("dec", "number", "numeric")))
INTEGERS = ("tinyint", "smallint", "integer", "int", "bigint")


def _plain(t: Column) -> Column:
    return F.replace(F.lower(t), F.lit(" "), F.lit(""))


def in_family(t: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(t).contains(w)
    return out


def is_narrowing(old: Column, new: Column) -> Column:
    """Same base with a smaller precision or scale, or a smaller integer (int to integer counts as smaller)."""
    pattern = r"^(\w+)\((\d+)(?:,(\d+))?\)$"
    a, b = _plain(old), _plain(new)
    num = lambda t, g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).cast("int")
    sized = (F.regexp_extract(a, pattern, 1) != "") & (F.regexp_extract(a, pattern, 1) == F.regexp_extract(b, pattern, 1))
    smaller = (num(b, 2) < num(a, 2)) | F.coalesce(num(b, 3) < num(a, 3), F.lit(False))
    order = F.array(*[F.lit(x) for x in INTEGERS])
    at_a, at_b = F.array_position(order, a), F.array_position(order, b)
    ranked = (at_a > 0) & (at_b > 0) & ((at_b < at_a))
    return F.coalesce(sized & smaller, F.lit(False)) | F.coalesce(ranked, F.lit(False))


def type_severity(old: Column, new: Column) -> Column:
    """safe when equal but for case and blanks, or of one family without narrowing; moderate when narrowing; else breaking."""
    same = F.lit(False)
    for _, words in FAMILIES:
        same = same | (in_family(old, words) & in_family(new, words))
    return F.when(_plain(old) == _plain(new), "safe").when(same, F.when(is_narrowing(old, new), "moderate").otherwise("safe")).otherwise("breaking")


def schema_changes(declared: DataFrame, actual: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(relation, category, column, new_column, old_type, new_type, severity, score) of declared(relation, column, data_type) against actual ones.

    A removed column whose name resembles an added one of the same relation (ratio from ``threshold`` on; the best, then the first by name)
    is a rename, and neither side is reported again; one added column may explain several removed ones.
    """
    d = declared.select("relation", F.lower("column").alias("column"), F.col("data_type").alias("old_type"), F.lit(1).alias("in_d"))
    a = actual.select("relation", F.lower("column").alias("column"), F.col("data_type").alias("new_type"), F.lit(1).alias("in_a"))
    x = d.join(a, ["relation", "column"], "full")
    added = x.where("in_d IS NULL").select("relation", "column", "new_type")
    removed = x.where("in_a IS NULL").select("relation", "column", "old_type")
    pairs = removed.join(added.withColumnRenamed("column", "new_column"), "relation").withColumn("score", F.round(ratio(F.col("column"), F.col("new_column")), 1)).where(F.col("score") >= threshold)
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("relation", "column").orderBy(F.desc("score"), "new_column"))).where("n = 1").drop("n")
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    shape = lambda df, category, severity, **c: df.select("relation", F.lit(category).alias("category"), "column", c.get("new_column", none).alias("new_column"), c.get("old_type", none).alias("old_type"), c.get("new_type", none).alias("new_type"), severity.alias("severity"), c.get("score", nothing).alias("score"))
    renames = shape(best, "renamed", F.lit("safe"), new_column=F.col("new_column"), old_type=F.col("old_type"), new_type=F.col("new_type"), score=F.col("score"))
    adds = shape(added.join(best.select("relation", F.col("new_column").alias("column")), ["relation", "column"], "left_anti"), "added", F.lit("safe"), new_type=F.col("new_type"))
    drops = shape(removed.join(best.select("relation", "column"), ["relation", "column"], "left_anti"), "removed", F.lit("moderate"), old_type=F.col("old_type"))
    old = F.coalesce("old_type", F.lit("unknown"))
    types = shape(x.where("in_a = 1 AND in_d = 1").where(old != F.col("new_type")), "type_changed", type_severity(old, F.col("new_type")), old_type=old, new_type=F.col("new_type"))
    return adds.unionByName(drops).unionByName(renames).unionByName(types)


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("category", "severity").agg(F.count("*").alias("n"))


def by_severity(changes: DataFrame, severity: str) -> DataFrame:
    return changes.where(F.col("severity") == severity)


RANK = {"renamed": 1, "added": 2, "type_changed": 3, "removed": 4, "metadata": 5}
ALIASES = {"postgresql": "postgres", "redshift": "postgres", "mssql": "sqlserver"}
QUOTES = {"bigquery": ("`", "`"), "databricks": ("`", "`"), "spark": ("`", "`"), "sqlserver": ("[", "]")}


def quoted(name: Column, dialect: str) -> Column:
    """A dotted name, each part quoted as the dialect does unless it is already."""
    a, b = QUOTES.get(dialect, ('"', '"'))
    return F.array_join(F.transform(F.split(name, r"\."), lambda p: F.when(p.startswith(a), p).otherwise(F.concat(F.lit(a), p, F.lit(b)))), ".")


def migration_steps(changes: DataFrame, adapter: str = "duckdb") -> DataFrame:
    """(relation, step, category, description, sql, rollback_sql, is_breaking): DDL for the changes, in the order rename, add, type, remove."""
    dialect = ALIASES.get(adapter.lower(), adapter.lower())
    q = lambda c: quoted(c, dialect)
    t, c, n = q(F.col("relation")), q(F.col("column")), q(F.col("new_column"))
    category = F.col("category")
    S = F.lit
    if dialect == "sqlserver":
        ren = lambda a, b: F.concat(S("EXEC sp_rename '"), F.col("relation"), S("."), a, S("', '"), b, S("', 'COLUMN';"))
        rename, rename_back = ren(F.col("column"), F.col("new_column")), ren(F.col("new_column"), F.col("column"))
    elif dialect == "databricks":
        rename = F.concat(S("-- rename "), F.col("column"), S(" to "), F.col("new_column"), S(" needs a rewrite of "), F.col("relation"))
        rename_back = F.concat(S("-- rename "), F.col("new_column"), S(" back to "), F.col("column"))
    else:
        rename = F.concat(S("ALTER TABLE "), t, S(" RENAME COLUMN "), c, S(" TO "), n, S(";"))
        rename_back = F.concat(S("ALTER TABLE "), t, S(" RENAME COLUMN "), n, S(" TO "), c, S(";"))
    verb = {"snowflake": " SET DATA TYPE ", "bigquery": " SET DATA TYPE ", "sqlserver": " "}.get(dialect, " TYPE ")
    alter = F.concat(S(" CHANGE COLUMN "), c, S(" "), c, S(" ")) if dialect == "spark" else F.concat(S(" ALTER COLUMN "), c, S(verb))
    retype = lambda ty: F.concat(S("ALTER TABLE "), t, alter, ty, S(";"))
    add = "ADD" if dialect == "sqlserver" else "ADD COLUMN"
    sql = F.when(category == "renamed", rename).when(category == "added", F.concat(S("ALTER TABLE "), t, S(f" {add} "), c, F.coalesce(F.concat(S(" "), F.col("new_type")), S("")), S(";"))).when(category == "type_changed", retype(F.col("new_type"))).otherwise(F.concat(S("ALTER TABLE "), t, S(" DROP COLUMN "), c, S(";")))
    back = F.when(category == "renamed", rename_back).when(category == "added", F.concat(S("ALTER TABLE "), t, S(" DROP COLUMN "), c, S(";"))).when(category == "type_changed", retype(F.col("old_type"))).otherwise(F.concat(S("-- "), F.col("column"), S(" can't be restored; add it again as "), F.coalesce("old_type", S("unknown"))))
    text = F.when(category == "renamed", F.concat(S("Rename "), F.col("column"), S(" to "), F.col("new_column"))).when(category == "added", F.concat(S("Add "), F.col("column"))).when(category == "type_changed", F.concat(S("Change type of "), F.col("column"), S(" from "), F.col("old_type"), S(" to "), F.col("new_type"))).otherwise(F.concat(S("Remove "), F.col("column")))
    breaking = (category == "removed") | ((category == "type_changed") & (F.col("severity") == "breaking")) | ((category == "renamed") & F.lit(dialect == "databricks"))
    rank = F.lit(9)
    for k, v in RANK.items():
        rank = F.when(category == k, v).otherwise(rank)
    order = F.row_number().over(Window.partitionBy("relation").orderBy(rank, "column"))
    return changes.select("relation", order.alias("step"), "category", text.alias("description"), sql.alias("sql"), back.alias("rollback_sql"), breaking.alias("is_breaking"))


def migration_script(steps: DataFrame, style: str = "sql") -> DataFrame:
    """(relation, script): one transaction for each relation, with the rollback in reverse order as comments; or a Markdown list."""
    rows = F.array_sort(F.collect_list(F.struct("step", "description", "sql", "rollback_sql", "is_breaking")))
    g = steps.groupBy("relation").agg(rows.alias("s"))
    if style == "markdown":
        line = lambda x: F.concat(F.lit("- "), F.when(x["is_breaking"], "**breaking** ").otherwise(""), x["description"], F.lit(": `"), x["sql"], F.lit("`"))
        return g.select("relation", F.concat(F.lit("# "), F.col("relation"), F.lit("\n\n"), F.array_join(F.transform("s", line), "\n")).alias("script"))
    if style == "json":
        return g.select("relation", F.to_json("s").alias("script"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("-- "), x["description"], F.lit("\n"), x["sql"])), "\n")
    undo = F.array_join(F.transform(F.reverse("s"), lambda x: F.concat(F.lit("-- "), x["rollback_sql"])), "\n")
    return g.select("relation", F.concat(F.lit("BEGIN;\n"), body, F.lit("\nCOMMIT;\n-- rollback\n"), undo).alias("script"))
