"""Text, name, array and map functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDERS = ("Undefined", "Not documented", "No description for this column", "Pending further documentation", "")
_FOLDS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: All of Unicode's space separators; SQL's trim takes them off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n\f]+", " "), F.lit(SPACES))


def lower(c: Column) -> Column:
    """Lower case letter by letter, as SQL has it: the dotted capital I is one letter then, and a sigma the same at the end of a word."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def normal(c: Column) -> Column:
    """White space collapsed, lower case, umlauts folded: what texts are compared by."""
    out = lower(collapse(c))
    for a, b in _FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def equivalent(a: Column, b: Column) -> Column:
    return normal(a) == normal(b)


def is_placeholder(c: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin(*placeholders)


def without_comments(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?m)--[^\n]*", ""), r"\s+", " "))


def after_last_dot(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def before_last_dot(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(F.lit(""))


def camel(c: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(F.lower(c), "_")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1000), F.initcap), ""))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(c), "_"), F.initcap), "")


def name_variants(c: Column, prefix: Column | None = None) -> Column:
    """Candidate spellings of a column name, best first; with a prefix, those of the rest come first."""
    own = F.array(c, F.lower(c), F.upper(c), camel(c), pascal(c))
    if prefix is None:
        return F.array_distinct(own)
    rest = F.substring(c, F.length(prefix) + 1, F.length(c))
    bare = F.array(rest, F.lower(rest), F.upper(rest), camel(rest), pascal(rest))
    return F.array_distinct(F.when((prefix != "") & c.startswith(prefix), F.concat(bare, own)).otherwise(own))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r'^["`\[]+|["`\]]+$', "")


def word_count(c: Column) -> Column:
    t = collapse(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two names, 0 to 100: from the edit distance of the lower-case names, with or without underscores, the better one."""

    def one(x, y):
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))

    x, y = F.lower(a), F.lower(b)
    return F.greatest(one(x, y), one(F.replace(x, F.lit("_"), F.lit("")), F.replace(y, F.lit("_"), F.lit(""))))


def glob_to_regex(pattern: str) -> str:
    import fnmatch

    return fnmatch.translate(pattern).replace("\\Z", "$").replace("(?s:", "(?s:")


def overlay(base: Column, top: Column) -> Column:
    """Map union where ``top`` wins, without relying on the session's policy for repeated keys."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(top), k))
    return F.map_concat(kept, top)


def without_keys(m: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def map_text(m: Column) -> Column:
    """A map as text, by key: k=v;k=v."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def has_template(c: Column) -> Column:
    """Whether a text holds an unrendered template expression or statement."""
    return F.coalesce(c.contains("{{") | c.contains("{%") | c.contains("{#"), F.lit(False))


def has_unrendered(c: Column) -> Column:
    """Whether a rendered property still shows template text, as property accessors test it."""
    return F.coalesce(c.contains("{{ ") | c.contains("{% "), F.lit(False))


def without_blank_end(c: Column) -> Column:
    """Blank lines at a file's end removed, one line end kept in the file's own style."""
    crlf = c.contains("\r\n")
    return F.when(F.trim(c) == "", F.lit("")).otherwise(F.concat(F.regexp_replace(c, r"[ \t\r\n]+$", ""), F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n"))))
