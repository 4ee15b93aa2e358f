"""SQL lint: text rules as DataFrame expressions over any number of texts, plan rules through Catalyst's parser."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.sql import Renderer
from tracewell.plans.lineage import deep_walk
from tracewell.plans.reader import Node, PlanReader

KEYWORDS = tuple("all alter and as between by case create delete distinct drop else end except exists false from full group having in index inner insert intersect into is join left like limit not null offset on or order outer over partition recursive right select set table then true union update values when where with".split())
RESERVED = ("from", "group", "order", "select", "where")
LEVELS = {"keyword-case": "convention", "line-length": "info", "select-star": "warning", "table-alias": "convention", "quoted-identifier": "info", "parse-error": "error", "no-sql": "warning", "not-found": "error"}
VIOLATION = "id string, rule_id string, level string, line int, col int, message string, snippet string, fix string"


def _row(df: DataFrame, rule: str, line, col, message, snippet, fix) -> DataFrame:
    return df.select("id", F.lit(rule).alias("rule_id"), F.lit(LEVELS[rule]).alias("level"), line.cast("int").alias("line"), col.cast("int").alias("col"), message.alias("message"), snippet.alias("snippet"), fix.cast("string").alias("fix"))


def line_length(texts: DataFrame, most: int = 100) -> DataFrame:
    """Lines of more than ``most`` characters: texts(id, sql)."""
    lines = texts.select("id", F.posexplode(F.split("sql", "\n")).alias("at", "line_text")).where(F.length("line_text") > most)
    message = F.concat(F.lit("Line has "), F.length("line_text").cast("string"), F.lit(f" characters, more than {most}"))
    return _row(lines, "line-length", F.col("at") + 1, F.lit(most + 1), message, F.concat(F.substring("line_text", 1, most + 20), F.lit("...")), F.lit(None))


def keyword_case(texts: DataFrame, case: str = "consistent") -> DataFrame:
    """Keywords in the rarer case (upper wins ties), or not in ``case``; mixed case always. The line is where the same spelling first stands."""
    words = texts.select("id", "sql", F.posexplode(F.filter(F.regexp_extract_all("sql", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.lower(w).isin(*KEYWORDS))).alias("at", "word"))
    upper, lower = F.col("word") == F.upper("word"), F.col("word") == F.lower("word")
    w = Window.partitionBy("id")
    wanted = F.lit(case) if case in ("upper", "lower") else F.when(F.count_if(upper).over(w) >= F.count_if(lower).over(w), "upper").otherwise("lower")
    bad = words.withColumn("wanted", wanted).where(F.when(F.col("wanted") == "upper", ~upper).otherwise(~lower))
    before = F.substring(F.col("sql"), F.lit(1), F.expr("instr(sql, word)"))
    fix = F.when(F.col("wanted") == "upper", F.upper("word")).otherwise(F.lower("word"))
    return _row(bad, "keyword-case", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.lit(None), F.concat(F.lit("Keyword "), F.col("word"), F.lit(" is not in "), F.col("wanted"), F.lit(" case")), F.col("word"), fix)


def quoted_identifier(texts: DataFrame) -> DataFrame:
    """Quotes around names that need none: letters, digits and underscores only, and none of five reserved words."""
    names = texts.select("id", "sql", F.explode(F.regexp_extract_all(F.regexp_replace("sql", r"'(?:[^']|'')*'", "''"), F.lit(r'(?:"|`)([A-Za-z0-9_]+)(?:"|`)'), F.lit(1))).alias("name")).where(~F.lower("name").isin(*RESERVED))
    before = F.substring(F.col("sql"), F.lit(1), F.greatest(F.expr("instr(sql, concat('\"', name))"), F.expr("instr(sql, concat('`', name))")))
    return _row(names, "quoted-identifier", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.lit(None), F.concat(F.lit("Quotes around "), F.col("name"), F.lit(" aren't needed")), F.col("name"), F.col("name"))


def _first_line(sql: str, snippet: str) -> int | None:
    at = sql.find(snippet)
    return sql.count("\n", 0, at) + 1 if at >= 0 else None


def _blocks(plan: Node):
    """Every node of the plan, of CTEs and of subqueries."""
    for n in plan.walk():
        yield n
        for cte in n.fields.get("cteRelations") or []:
            yield from _blocks(cte["_2"])
        for e in n.expressions():
            for x in e.walk():
                if isinstance(p := x.fields.get("plan"), Node):
                    yield from _blocks(p)


def select_star(plan: Node, sql: str):
    """One for each SELECT with a bare star; ``t.*`` is fine."""
    for n in _blocks(plan):
        items = n.fields.get("projectList") or n.fields.get("aggregateExpressions") or []
        items = items if isinstance(items, list) else [items]
        if n.kind in ("Project", "Aggregate") and any(isinstance(e, Node) and e.kind in ("UnresolvedStar", "UnresolvedStarExceptOrReplace") and not e.fields.get("target") for e in items):
            yield "select-star", _first_line(sql, "*"), None, "SELECT * names no columns", "SELECT *", None


def table_alias(plan: Node, sql: str, least: int = 3):
    """Aliases of joined tables and of subqueries with fewer than ``least`` characters."""
    for n in _blocks(plan):
        sides = n.children[1:] if n.kind == "Join" else []
        for s in [*sides, *([c for c in n.children if c.kind == "SubqueryAlias" and c.children[0].kind != "UnresolvedRelation"] if n.kind != "Join" else [])]:
            if s.kind == "SubqueryAlias" and len(alias := s.fields["identifier"]["name"]) < least and not alias.startswith("__"):
                yield "table-alias", _first_line(sql, alias), None, f"Alias {alias} has fewer than {least} characters", alias, None


TEXT_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"keyword-case": keyword_case, "line-length": line_length, "quoted-identifier": quoted_identifier}
PLAN_RULES: dict[str, Callable] = {"select-star": select_star, "table-alias": table_alias}


class Linter:
    """Runs the enabled rules but the disabled ones. ``add`` takes a text rule (DataFrame → DataFrame) or a plan rule (plan, sql → tuples)."""

    def __init__(self, spark: SparkSession, enabled: list[str] | None = None, disabled: list[str] | None = None):
        self.spark, self.reader = spark, PlanReader(spark)
        self.text, self.plan = dict(TEXT_RULES), dict(PLAN_RULES)
        self.enabled, self.disabled = enabled, set(disabled or ())
        self.failed: list[tuple[str, str, str]] = []

    def add(self, name: str, rule: Callable, level: str = "warning", on: str = "plan") -> None:
        LEVELS[name] = level
        (self.plan if on == "plan" else self.text)[name] = rule

    def _on(self, name: str) -> bool:
        return name not in self.disabled and (self.enabled is None or name in self.enabled)

    def lint(self, texts: DataFrame) -> DataFrame:
        """Violations of texts(id, sql). Of several statements the plan rules see the first; a text that doesn't parse is a violation itself."""
        out = self.spark.createDataFrame([], VIOLATION)
        for name, rule in self.text.items():
            if self._on(name):
                out = out.unionByName(rule(texts))
        rows = []
        if any(self._on(n) for n in self.plan):
            for r in texts.select("id", "sql").collect():
                if r.sql is None or not r.sql.strip():
                    rows.append((r.id, "no-sql", LEVELS["no-sql"], None, None, "No SQL", None, None))
                    continue
                try:
                    plan = self.reader.parse(first_statement(r.sql))
                except Exception as e:
                    rows.append((r.id, "parse-error", LEVELS["parse-error"], None, None, str(e).split("\n")[0][:300], None, None))
                    continue
                for name, rule in self.plan.items():
                    if not self._on(name):
                        continue
                    try:
                        rows += [(r.id, v[0], LEVELS.get(v[0], "warning"), *v[1:]) for v in rule(plan, r.sql)]
                    except Exception as e:
                        self.failed.append((r.id, name, str(e)))
        return out.unionByName(self.spark.createDataFrame(rows, VIOLATION))

    def compiled(self, nodes: DataFrame, renderer: Renderer | None = None) -> DataFrame:
        """(id, sql): the compiled SQL; where there is none, the raw text if it needs no rendering, else what the renderer makes of it. A template
        that can't be rendered has no SQL, so it is reported as such instead of its markers as parse errors."""
        templated = F.col("raw_sql").contains("{{") | F.col("raw_sql").contains("{%") | F.col("raw_sql").contains("{#")
        ready = nodes.where(F.col("compiled_sql").isNotNull() | ~F.coalesce(templated, F.lit(False))).select(F.col("name").alias("id"), F.coalesce("compiled_sql", "raw_sql").alias("sql"))
        rest = []
        for r in nodes.where("compiled_sql IS NULL").where(templated).select("name", "raw_sql").collect():
            try:
                rest.append((r.name, (renderer or Renderer()).render(r.raw_sql)))
            except ValueError:
                rest.append((r.name, None))
        return ready.unionByName(self.spark.createDataFrame(rest, "id string, sql string")) if rest else ready

    def lint_model(self, nodes: DataFrame, name: str, renderer: Renderer | None = None) -> DataFrame:
        found = nodes.where(F.lower("name") == name.lower())
        if found.isEmpty():
            return self.spark.createDataFrame([(name, "not-found", LEVELS["not-found"], None, None, f"No model {name}", None, None)], VIOLATION)
        return self.lint(self.compiled(found, renderer))

    def lint_project(self, nodes: DataFrame, fqn: str | None = None, renderer: Renderer | None = None) -> DataFrame:
        models = nodes.where("resource_type = 'model'")
        if fqn:
            models = models.where(F.array_join("fqn", ".").contains(fqn))
        return self.lint(self.compiled(models, renderer))


def first_statement(sql: str) -> str:
    from tracewell.plans.reader import _TOKEN

    out = []
    for t in _TOKEN.findall(sql):
        if t == ";" and "".join(out).strip():
            break
        out.append(t)
    return "".join(out)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("level", "rule_id").agg(F.count("*").alias("n"))


def passed(violations: DataFrame) -> bool:
    return violations.where("level IN ('error', 'warning')").isEmpty()


__all__ = ["Linter", "deep_walk", "first_statement", "keyword_case", "line_length", "passed", "quoted_identifier", "select_star", "summary", "table_alias"]
