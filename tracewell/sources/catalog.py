"""Column introspection of live relations, from Spark's own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schemas

#: How names are normalised by warehouse kind: Snowflake upper-cases what isn't quoted, others strip quotes.
UPPER_CASE = ("snowflake",)


def normalized(name, adapter: str = "spark"):
    bare = F.regexp_replace(name, r'^["`\[]|["`\]]$', "")
    return F.when(name.startswith('"'), bare).otherwise(F.upper(bare)) if adapter in UPPER_CASE else bare


def _flat(prefix: str, kind: T.DataType, comment: str | None):
    """A column, then a struct's fields by dotted name."""
    yield prefix, kind, comment
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(inner, T.StructType):
        for f in inner.fields:
            yield from _flat(f"{prefix}.{f.name}", f.dataType, (f.metadata or {}).get("comment"))


def type_name(kind: T.DataType, precise: bool = True, precise_numbers: bool = True) -> str:
    """Spark's name of a type; without precision a decimal or a char is only its base name."""
    text = kind.simpleString()
    if isinstance(kind, T.DecimalType):
        return text if precise and precise_numbers else "decimal"
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return text if precise else text.split("(")[0]
    return text


def introspect(spark: SparkSession, relations: dict[str, DataFrame | str], ignore: tuple[str, ...] = (), flatten: bool = True, precise: bool = True) -> DataFrame:
    """Columns of many relations at once: (relation, column, data_type, index, comment).

    A relation is a DataFrame or a table name; only schemas are read. One that can't be read has no rows. Columns
    that match one of the ``ignore`` patterns are left out.
    """
    rows = []
    for name, rel in relations.items():
        try:
            schema = (spark.table(rel) if isinstance(rel, str) else rel).schema
        except Exception:
            continue
        flat = [x for f in schema.fields for x in (_flat(f.name, f.dataType, (f.metadata or {}).get("comment")) if flatten else [(f.name, f.dataType, (f.metadata or {}).get("comment"))])]
        rows += [(name, c, type_name(t, precise), i, comment) for i, (c, t, comment) in enumerate(flat)]
    df = spark.createDataFrame(rows, schemas.INTROSPECTED)
    for pattern in ignore:
        df = df.where(~F.col("column").rlike(pattern))
    return df


def with_declared_fallback(introspected: DataFrame, columns: DataFrame) -> DataFrame:
    """Add declared columns of relations that introspection found nothing for."""
    found = introspected.select("relation").distinct()
    declared = columns.select(F.col("model").alias("relation"), "column", "data_type", F.col("ordinal").alias("index"), F.lit(None).cast("string").alias("comment"))
    return introspected.unionByName(declared.join(found, "relation", "left_anti"))


def missing_tables(spark: SparkSession, database: str, known: DataFrame) -> DataFrame:
    """Tables of a database that ``known(name)`` lacks, sorted: what a source definition could add."""
    there = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(database)], "name string")
    return there.join(known.select("name"), "name", "left_anti").orderBy("name")


def enclosing_schema(mapping: dict, depth: int | None = None) -> list[tuple]:
    """Rows (path..., column, type) of a nested mapping schema → table → column → type, two to four levels deep."""
    out = []

    def walk(at, path):
        for k, v in at.items():
            if isinstance(v, dict):
                walk(v, path + [k])
            else:
                out.append(tuple([None] * (3 - len(path)) + path + [k, v]))

    walk(mapping, [])
    return out
