"""Templated SQL: rendering, running, and validating models by running them."""

from __future__ import annotations

import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.reader import as_spark, with_qualify

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_SAFE = re.compile(r"\s*(?:'[^']*'|\"[^\"]*\"|[\w.]+|-?\d+|\[[^\]]*\])\s*$")


def is_templated(sql: str) -> bool:
    return any(t in sql for t in ("{{", "{%", "{#"))


class Renderer:
    """A small template language: {{ ref('m') }}, {{ source('s', 't') }}, {{ var('k', default) }}, {{ name }}, {% set x = ... %},
    {% for x in list %}, {% if name %}, comments, and white space control by dashes."""

    def __init__(self, relations: dict[str, str] | None = None, variables: dict[str, Any] | None = None):
        self.relations, self.variables = relations or {}, variables or {}

    def render(self, sql: str) -> str:
        parts = _PARTS.split(sql)
        for i, p in enumerate(parts):
            if p.startswith(("{%-", "{{-", "{#-")) and i:
                parts[i - 1] = parts[i - 1].rstrip()
            if p.endswith(("-%}", "-}}", "-#}")) and i + 1 < len(parts):
                parts[i + 1] = parts[i + 1].lstrip()
        out, _ = self._block(parts, 0, dict(self.variables), ())
        return out

    def _block(self, parts, i, names, ends) -> tuple[str, int]:
        out = []
        while i < len(parts):
            p = parts[i]
            if p.startswith("{#"):
                i += 1
                continue
            if p.startswith("{{"):
                out.append(str(self._value(p[2:-2].strip().strip("-").strip(), names)))
            elif p.startswith("{%"):
                body = p[2:-2].strip().strip("-").strip()
                word = body.split(None, 1)[0]
                if word in ends:
                    return "".join(out), i
                if word == "set":
                    name, _, value = body[3:].partition("=")
                    names[name.strip()] = self._value(value.strip(), names)
                elif word == "for":
                    m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", body, re.S)
                    items, start = list(self._value(m[2].strip(), names)), i + 1
                    end = start
                    for k, item in enumerate(items):
                        text, end = self._block(parts, start, {**names, m[1]: item, "loop.last": k == len(items) - 1, "loop.first": k == 0, "loop.index": k + 1}, ("endfor",))
                        out.append(text)
                    if not items:
                        _, end = self._block(parts, start, dict(names, **{m[1]: ""}), ("endfor",))
                    i = end
                elif word == "if":
                    text, end = self._block(parts, i + 1, names, ("else", "endif"))
                    other = ""
                    if parts[end].strip("{}%- ").startswith("else"):
                        other, end = self._block(parts, end + 1, names, ("endif",))
                    cond = body[2:].strip()
                    value = not self._value(cond[4:].strip(), names) if cond.startswith("not ") else self._value(cond, names)
                    out.append(text if value else other)
                    i = end
                else:
                    raise ValueError(f"template statement {word!r} isn't supported")
            else:
                out.append(p)
            i += 1
        if ends:
            raise ValueError(f"missing {' or '.join(ends)}")
        return "".join(out), i

    def _value(self, text: str, names: dict) -> Any:
        if m := re.fullmatch(r"(\w+)\((.*)\)", text, re.S):
            args = [self._value(a.strip(), names) for a in _split(m[2])]
            if m[1] == "ref":
                return self.relations.get(args[-1], args[-1])
            if m[1] == "source":
                return self.relations.get(".".join(args), args[-1])
            if m[1] == "var":
                return names.get(args[0], args[1] if len(args) > 1 else "")
            if m[1] == "config":
                return ""
            raise ValueError(f"template function {m[1]!r} isn't supported")
        if text.startswith("[") and text.endswith("]"):
            return [self._value(a.strip(), names) for a in _split(text[1:-1])]
        if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
            return text[1:-1]
        if re.fullmatch(r"-?\d+", text):
            return int(text)
        if text in ("true", "True", "false", "False"):
            return text.lower() == "true"
        if text in names:
            return names[text]
        raise ValueError(f"unknown template name {text!r}")


def _split(text: str) -> list[str]:
    out, depth, now, quote = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        depth += (ch in "([") - (ch in ")]") if not quote else 0
        if ch == "," and not depth and not quote:
            out.append(now)
            now = ""
        else:
            now += ch
    return out + [now] if now.strip() else out


def run(spark: SparkSession, sql: str, renderer: Renderer | None = None, dialect: str | None = None) -> DataFrame:
    """Render a template, put forms of other dialects (QUALIFY, EXCLUDE, bracketed names, ...) in Spark's words, and run it."""
    return spark.sql(with_qualify(as_spark((renderer or Renderer()).render(sql) if is_templated(sql) else sql, dialect)))


def preview(df: DataFrame, rows: int = 50, columns: int = 6, width: int = 20) -> str:
    """The first rows and columns as a text table."""
    part = df.select(*df.columns[:columns]).limit(rows)
    cut = lambda v: (s := "" if v is None else str(v))[: width - 3] + "..." if len("" if v is None else str(v)) > width else ("" if v is None else str(v))
    lines = [part.columns] + [[cut(v) for v in r] for r in part.collect()]
    sizes = [max(len(x[i]) for x in lines) for i in range(len(part.columns))]
    return "\n".join(" | ".join(v.ljust(n) for v, n in zip(x, sizes)) for x in lines)


def validate_models(spark: SparkSession, models: dict[str, str], renderer: Renderer | None = None, timeout: float | None = None) -> DataFrame:
    """(model, status, rows, seconds, error) of each model, run in full: success, compile_error, execution_error or timeout.

    With a timeout (seconds) the model's jobs are cancelled when it is over.
    """
    import threading

    out = []
    for name, sql in models.items():
        began = time.time()
        try:
            df = run(spark, sql, renderer)
        except Exception as e:
            out.append((name, "compile_error", None, time.time() - began, str(e).split("\n")[0][:300]))
            continue
        tag, timer, late = f"tracewell-validate-{name}", None, threading.Event()
        spark.sparkContext.setJobGroup(tag, name, interruptOnCancel=True)
        if timeout:
            timer = threading.Timer(timeout, lambda: (late.set(), spark.sparkContext.cancelJobGroup(tag)))
            timer.start()
        try:
            # The hash keeps every column in the plan; a bare count would leave them out.
            named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
            hashed = [c for c, t in named.dtypes if "map<" not in t and t != "variant"]
            n = named.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*hashed) if hashed else F.lit(0)).alias("h")).head()[0]
            out.append((name, "success", n, time.time() - began, None))
        except Exception as e:
            out.append((name, "timeout" if late.is_set() else "execution_error", None, time.time() - began, str(e).split("\n")[0][:300]))
        finally:
            if timer:
                timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return spark.createDataFrame(out, "model string, status string, rows long, seconds double, error string")


def success_rate(results: DataFrame) -> float:
    r = results.agg(F.avg((F.col("status") == "success").cast("double"))).head()[0]
    return 100.0 if r is None else round(100.0 * r, 2)


_COMMENT = re.compile(r"^\s*alter\s+table\s+([\w.`\"]+)\s+(?:(?:modify|alter|change)\s+(?:column\s+)?([\w`\"]+)\s+)?(?:.*?\s)?comment\s*=?\s*'((?:[^']|'')*)'\s*;?\s*$", re.I | re.S)


def comment_change(sql: str) -> tuple[str, str | None, str] | None:
    """(table, column or None, text) of an ALTER TABLE that sets a comment; None for other statements."""
    m = _COMMENT.match(sql)
    return (m[1].strip('`"'), m[2].strip('`"') if m[2] else None, m[3].replace("''", "'")) if m else None


def apply_comment(columns: DataFrame, nodes: DataFrame, sql: str) -> tuple[DataFrame, DataFrame]:
    """(columns, nodes) with the comment as description; unchanged for other statements."""
    found = comment_change(sql)
    if found is None:
        return columns, nodes
    table, column, text = found
    name = table.split(".")[-1].lower()
    if column is None:
        return columns, nodes.withColumn("description", F.when(F.lower("name") == name, F.lit(text)).otherwise(F.col("description")))
    hit = (F.lower("model") == name) & (F.lower("column") == column.lower())
    return columns.withColumn("description", F.when(hit, F.lit(text)).otherwise(F.col("description"))), nodes
