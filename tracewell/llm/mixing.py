"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import need, packed, table, unpacked, written

#: A document's place in its source is a 60-bit hash of its doc_id, read in five steps of 12 bits.
BITS, STEP = 60, 12
#: Nested budgets, in percent of the largest one.
SHARES = (25, 50, 100)


def place(doc_id="doc_id"):
    """60 bits of the MD5 of the id's decimal form; a null id counts as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Pieces between blanks, tabs and line ends, as SQL can count them; a null or empty text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def n_tokens(text: Column, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> Column:
    """Tokens of the whole text in the vocabulary that operators 9 and 10 use; a null or empty text has none."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        coder = bpe.load(vocabulary)
        return pa.array([len(coder.ids(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def budgets(narrow: DataFrame, weights: DataFrame | None, percent: int) -> DataFrame:
    """(source, level, budget): each level's tokens for each source, in whole tokens.

    The largest level has ``percent`` of all tokens, split over the sources by weight (a whole number; equal weights
    where none are given; a source that isn't listed gets nothing).
    """
    total = narrow.groupBy("source").agg(F.sum("tokens").alias("have"))
    if weights is None:
        total = total.withColumn("weight", F.lit(1).cast("long"))
    else:
        given = weights.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")).alias("weight"))
        given = given.withColumnRenamed("source", "named")
        total = total.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "have", F.coalesce("weight", F.lit(0)).alias("weight"))
    all_ = total.agg(F.sum("have").alias("all_have"), F.sum("weight").alias("all_weight"))
    level = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(s).alias("share")) for i, s in enumerate(SHARES)]))
    # A decimal holds the product of tokens and weights exactly.
    amount = F.expr(f"cast(cast(all_have as decimal(38,0)) * weight * {percent} * share div (cast(10000 as decimal(38,0)) * all_weight) as bigint)")
    return total.crossJoin(F.broadcast(all_)).where("all_weight > 0").withColumn("l", level).select("source", "have", "weight", "all_have", "all_weight", F.col("l.level").alias("level"), F.col("l.share").alias("share")).select("source", "level", amount.alias("budget"), "have")


def thresholds(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, level, below): documents whose place is under ``below`` are the longest run, in order of place, within the budget.

    Histograms of tokens by source and bucket find the bucket where a budget ends; only that bucket is read again, by
    the next 12 bits, until every bit is used or no boundary bucket holds two places. Documents are never sorted.
    """
    done = None
    # prefix: the boundary bucket so far; left: what the budget has left at its beginning.
    open_ = wanted.select("source", "level", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"), "have")
    whole = open_.where("left >= have").select("source", "level", F.lit(1 << BITS).cast("long").alias("below"))
    done = whole
    open_ = written(open_.where("left < have").select("source", "level", "prefix", "left"), "open")
    for used in range(STEP, BITS + 1, STEP):
        shift = BITS - used
        bucket = F.shiftright("place", shift).alias("bucket")
        parts = open_.select(F.col("source").alias("of"), "level", "prefix", "left")
        # Levels of one source often share the boundary bucket; rows are summed once for each bucket.
        regions = open_.select(F.col("source").alias("of"), "prefix").distinct()
        if used == STEP:
            rows = narrow.groupBy(F.col("source").alias("of"), bucket).agg(F.sum("tokens").alias("tokens"), F.min("place").alias("lo"), F.max("place").alias("hi")).withColumn("prefix", F.lit(0).cast("long"))
        else:
            rows = narrow.join(regions, narrow.source.eqNullSafe(regions.of) & (F.shiftright(narrow.place, shift + STEP) == regions.prefix)).groupBy("of", "prefix", bucket).agg(F.sum("tokens").alias("tokens"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        run = written(rows.withColumn("upto", F.sum("tokens").over(Window.partitionBy("of", "prefix").orderBy("bucket"))), "histogram")
        named = run.select(F.col("of").alias("o"), F.col("prefix").alias("p"), "bucket", "tokens", "lo", "hi", "upto")
        hits = parts.join(named, parts.of.eqNullSafe(named.o) & (parts.prefix == named.p)).where("upto > left")
        first = hits.withColumn("n", F.row_number().over(Window.partitionBy("of", "level").orderBy("bucket"))).where("n = 1")
        first = written(first.select(F.col("of").alias("source"), "level", "bucket", (F.col("left") - F.col("upto") + F.col("tokens")).alias("left"), "lo", "hi"), "boundary")
        # One place only: it doesn't fit, so the run ends before it.
        done = done.union(first.where("lo = hi").select("source", "level", F.col("lo").alias("below")))
        open_ = first.where("lo < hi").select("source", "level", F.col("bucket").alias("prefix"), "left")
        if open_.isEmpty():
            break
    return done


def mixed(docs: DataFrame, weights: DataFrame | None = None, percent: int = 100, tokens: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """(doc_id, source, tokens, level) of the documents chosen: ``level`` is the smallest of the nested budgets that holds it.

    Within a source, documents are taken in the order of a hash of their doc_id while their tokens fit the source's budget, so
    a smaller budget's choice lies within a larger one's, and a document's fate depends on its source alone. Rows of
    one doc_id share a place and are taken or left together (all null ids count as one id). A null source is a source of its
    own; a null or empty text has no tokens. A source with less than its budget is taken whole, without repeats. Extra columns are ignored;
    an empty table gives no rows. ``tokens`` counts a text's tokens, by default those of the vocabulary; each text is counted once, whole.
    """
    return _chosen(docs, weights, percent, tokens).select("doc_id", "source", "tokens", "level")


def _narrow(docs: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    need(docs, "doc_id", "source", "text")
    return written(docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), place().alias("place")), "narrow")


def _levels(narrow: DataFrame, weights: DataFrame | None, percent: int) -> DataFrame:
    """(of, t1, t2, ...): the thresholds of each source."""
    found = thresholds(narrow, written(budgets(narrow, weights, percent), "budgets"))
    one = found.groupBy(F.col("source").alias("of")).agg(*[F.max(F.when(F.col("level") == i + 1, F.col("below"))).alias(f"t{i + 1}") for i in range(len(SHARES))])
    return written(one, "thresholds")


def _level(at) -> F.Column:
    return F.coalesce(*[F.when(at < F.col(f"t{i + 1}"), F.lit(i + 1)) for i in range(len(SHARES))])


def _chosen(docs: DataFrame, weights: DataFrame | None, percent: int, tokens: Callable[[Column], Column]) -> DataFrame:
    narrow = _narrow(docs, tokens)
    levels = _levels(narrow, weights, percent)
    return narrow.join(levels, narrow.source.eqNullSafe(levels.of)).withColumn("level", _level(F.col("place"))).where("level IS NOT NULL")


def keep_mixed(docs: DataFrame, weights: DataFrame | None = None, percent: int = 100, tokens: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """The rows of ``docs`` that mixed() chooses; all columns as they were. The filter compares hashes with the source's
    threshold; the thresholds are one row for each source, sent to all when small, which Spark checks."""
    levels = _levels(_narrow(docs, tokens), weights, percent)
    rows = packed(docs).withColumn("at", place("row.doc_id"))
    return unpacked(rows.join(levels, F.col("row.source").eqNullSafe(F.col("of"))).where(_level(F.col("at")).isNotNull()))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources of documents, budgets of 25, 50 and 100 % of all tokens; words count as tokens here, which SQL can count, too."""
    return mixed(table(spark, sf_dir, "documents"), tokens=n_words)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS BIGINT) AS tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
t AS (SELECT source, sum(tokens) AS have FROM d GROUP BY source),
b AS (SELECT source, CAST((SELECT sum(have) FROM t) AS HUGEINT) AS all_have, (SELECT count(*) FROM t) AS n FROM t),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM d)
SELECT r.doc_id, r.source, r.tokens, CAST(CASE WHEN upto <= all_have * 2500 // (10000 * n) THEN 1 WHEN upto <= all_have * 5000 // (10000 * n) THEN 2 ELSE 3 END AS INTEGER) AS level
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source WHERE upto <= all_have * 10000 // (10000 * n)
"""
