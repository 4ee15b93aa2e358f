"""Catalyst's parser as the only SQL front-end: one parsed plan becomes one Python tree."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

#: Aggregates of other dialects that Spark's registry lacks or names otherwise.
FOREIGN_AGGREGATES = frozenset({"array_agg", "any_value", "string_agg", "group_concat", "arg_max", "arg_min", "median", "quantile", "countif", "approx_distinct"})


@dataclass
class Node:
    kind: str
    fields: dict[str, Any]
    children: list["Node"] = field(default_factory=list)

    def plans(self):
        """Plans held by expression fields: subqueries."""
        for e in self.expressions():
            for x in e.walk():
                if isinstance(p := x.fields.get("plan"), Node):
                    yield p

    def expressions(self):
        for v in self.fields.values():
            yield from _expressions(v)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def _expressions(v):
    if isinstance(v, Node):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from _expressions(x)


def _decode(value: Any) -> Any:
    """JSON of a tree is a list of nodes in pre-order; lists of such lists are several trees."""
    if isinstance(value, list):
        if value and all(isinstance(x, dict) and "class" in x and "num-children" in x for x in value):
            return _tree(iter(value))
        return [_decode(x) for x in value]
    if isinstance(value, dict):
        return {k: _decode(x) for k, x in value.items()}
    return value


def _tree(nodes) -> Node:
    raw = next(nodes)
    node = Node(raw["class"].rpartition(".")[2], {k: _decode(v) for k, v in raw.items() if k not in ("class", "num-children", "origin")})
    node.children = [_tree(nodes) for _ in range(raw["num-children"])]
    return node


def name_parts(text: str) -> list[str]:
    return [p.strip() for p in text.strip("[]").split(", ")]


class PlanReader:
    """Parses SQL without a catalog; needs a classic (not Connect) session. SQL of another ``dialect`` is rewritten first."""

    def __init__(self, spark: SparkSession, dialect: str | None = None):
        self.dialect = dialect
        session = getattr(spark, "_jsparkSession", None)
        if session is None:
            raise RuntimeError("the lineage front-end needs a classic Spark session with a JVM, not Spark Connect")
        self._parser = session.sessionState().sqlParser()
        registry = session.sessionState().functionRegistry()
        names = registry.listFunction()
        self.aggregates = set(FOREIGN_AGGREGATES)
        for i in range(names.size()):
            info = registry.lookupFunction(names.apply(i))
            if info.isDefined() and info.get().getGroup() == "agg_funcs":
                self.aggregates.add(names.apply(i).funcName().lower())

    def parse(self, sql: str) -> Node:
        return _tree(iter(json.loads(self._parser.parsePlan(without_qualify(as_spark(sql, self.dialect))).toJSON())))


_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.S)
_ENDS = {"union", "intersect", "except", "order", "limit", "window", "minus"}


def without_qualify(sql: str) -> str:
    """Drop QUALIFY clauses, which Spark can't parse and which filter only: columns come from the same sources without them."""
    if "qualify" not in sql.lower():
        return sql
    out, depth, skip = [], 0, None
    for token in _TOKEN.findall(sql):
        low = token.lower()
        if skip is None and low == "qualify":
            skip = depth
            continue
        depth += (token == "(") - (token == ")")
        if skip is not None and (depth < skip or depth == skip and (low in _ENDS or token == ";")):
            skip = None
        if skip is None:
            out.append(token)
    return "".join(out)


#: Dialects whose double quotes hold names.
QUOTED_NAMES = ("ansi", "athena", "duckdb", "oracle", "postgres", "redshift", "snowflake", "sqlite", "sqlserver", "trino", "tsql")
#: Words after which a bracket opens a name, not an index.
_BEFORE_NAME = {"all", "and", "as", "between", "by", "case", "distinct", "else", "from", "having", "in", "into", "is", "join", "like", "not", "on", "or", "over", "select", "set", "table", "then", "update", "using", "when", "where", "with"}


def as_spark(sql: str, dialect: str | None = None) -> str:
    """Forms of other dialects in Spark's words: ``* EXCLUDE (x)`` becomes EXCEPT, ``SELECT TOP n`` loses its TOP (which only
    limits rows), bracketed names are quoted by backticks, as are names in double quotes where the dialect has them."""
    low = sql.lower()
    quotes = dialect in QUOTED_NAMES and '"' in sql
    if not quotes and "[" not in sql and "exclude" not in low and not re.search(r"\btop\b", low):
        return sql
    tokens, out, last, i = _TOKEN.findall(sql), [], "", 0

    def solid(k: int) -> int:
        """The next token from k on that is neither white space nor a comment."""
        while k < len(tokens) and (tokens[k].isspace() or tokens[k].startswith(("--", "/*"))):
            k += 1
        return k

    while i < len(tokens):
        t = tokens[i]
        word = t.lower()
        if word == "top" and last in ("select", "distinct", "all"):
            k = solid(i + 1)
            if k < len(tokens) and (tokens[k].isdigit() or tokens[k] == "("):
                depth = 0
                while k < len(tokens):
                    depth += (tokens[k] == "(") - (tokens[k] == ")")
                    k += 1
                    if depth == 0:
                        break
                nxt = solid(k)
                if nxt < len(tokens) and tokens[nxt].lower() == "percent":
                    k = nxt + 1
                i = k
                continue
        elif word == "exclude" and last == "*":
            k = solid(i + 1)
            if k < len(tokens) and tokens[k] == "(":
                t = "except"
            elif k < len(tokens):
                out.append(f"except ({tokens[k]})")
                last, i = ")", k + 1
                continue
        elif t == "[" and (not last or last in _BEFORE_NAME or not re.match(r"[\w\])`\"]", last[-1])):
            close = next((k for k in range(i + 1, len(tokens)) if tokens[k] == "]"), None)
            name = "".join(tokens[i + 1 : close]) if close is not None else ""
            if re.fullmatch(r"[^\W\d][\w $#@.-]*", name):
                out.append(f"`{name}`")
                last, i = "`", close + 1
                continue
        elif quotes and len(t) > 2 and t[0] == '"':
            t = "`" + t[1:-1].replace('""', '"').replace("`", "``") + "`"
        out.append(t)
        if not t.isspace() and not t.startswith(("--", "/*")):
            last = word if t == tokens[i] else t
        i += 1
    return "".join(out)


def with_qualify(sql: str) -> str:
    """QUALIFY as a filter over a column of its own, so that the query runs: the innermost block first, until none is left."""
    while True:
        tokens = _TOKEN.findall(sql)
        words = [t.lower() for t in tokens]
        depth, at, where = 0, [], {}
        for k, t in enumerate(tokens):
            depth += (t == "(") - (t == ")")
            at.append(depth + (t == ")"))
            if words[k] == "qualify":
                where[k] = depth
        if not where:
            return sql
        q = max(where, key=lambda k: where[k])
        d = where[q]
        begin = max(k for k in range(q) if words[k] == "select" and at[k] == d)
        from_ = next(k for k in range(begin, q) if words[k] == "from" and at[k] == d)
        end = next((k for k in range(q, len(tokens)) if at[k] < d or at[k] == d and (tokens[k] == ";" or words[k] in _ENDS or tokens[k] == ")" and d > 0)), len(tokens))
        head, body, cond = "".join(tokens[begin:from_]), "".join(tokens[from_:q]), "".join(tokens[q + 1 : end])
        block = f"select * except (__qualified) from ({head.rstrip()}, ({cond.strip()}) as __qualified {body.rstrip()}) as __q where __qualified "
        sql = "".join(tokens[:begin]) + block + "".join(tokens[end:])


def strip_comments(sql: str) -> str:
    """Without block and line comments (string literals stay as they are), white space collapsed."""
    kept = ["" if t.startswith(("--", "/*")) else t for t in _TOKEN.findall(sql)]
    return re.sub(r"\s+", " ", "".join(k or " " for k in kept)).strip()
