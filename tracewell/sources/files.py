"""Schema files, glossaries, settings and seed files."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import DataFrame, SparkSession

from tracewell import schemas

MANAGED = ("data_tests", "models", "seeds", "sources", "unit_tests", "version")


def split_sections(doc: dict | None) -> tuple[dict, dict]:
    """(managed, preserved) top-level sections of a schema file."""
    doc = doc or {}
    return {k: v for k, v in doc.items() if k in MANAGED}, {k: v for k, v in doc.items() if k not in MANAGED}


def read_schema_file(path: str) -> tuple[dict, dict]:
    with open(path, encoding="utf-8") as f:
        return split_sections(yaml.safe_load(f))


def read_schema_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of all files under a pattern, one row a file."""
    from pyspark.sql import functions as F

    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A flat name: description file; names in lower case, blank texts left out."""
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    return spark.createDataFrame([(str(k).lower(), str(v).strip()) for k, v in doc.items() if v is not None and str(v).strip()], schemas.GLOSSARY)


def read_seed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


@dataclass
class EngineConfig:
    """Typed settings of an INI file's [tracewell] section; keys it doesn't know are in ``unknown``."""

    max_origin_depth: int = 60
    max_ancestor_depth: int = 100
    max_line_length: int = 100
    rename_threshold: float = 85.0
    compiled_sql: str = "manifest"
    glossary: str = ""
    namespace: str = "lineage"
    separator: str = "---"
    placeholders: tuple[str, ...] = ()
    annotate: str = "if_altered"
    inherit_through_renames: bool = False
    unknown: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, section: str = "tracewell") -> "EngineConfig":
        out = cls()
        if not os.path.exists(path):
            return out
        parser = configparser.ConfigParser()
        parser.read(path, encoding="utf-8")
        if not parser.has_section(section):
            return out
        kinds = {f.name: type(getattr(out, f.name)) for f in fields(out)}
        for key, value in parser.items(section):
            name = key.replace("-", "_")
            if name not in kinds or name == "unknown":
                out.unknown[key] = value
            elif kinds[name] is bool:
                setattr(out, name, parser.getboolean(section, key))
            elif kinds[name] is tuple:
                setattr(out, name, tuple(v.strip() for v in value.splitlines() if v.strip()))
            else:
                setattr(out, name, kinds[name](value))
        return out
