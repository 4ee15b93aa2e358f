"""Exact deduplication in two passes with Bloom filters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import bloom
from tracewell.llm.common import need, packed, table, unpacked, written

#: Bits a key and probes of both filters: 12 bits and 3 probes let about 1 in 90 new keys pass as seen.
BITS_PER_KEY, PROBES = 12, 3
#: Keys in a shard of the first pass; its filter (4 MB) lies in one task's memory.
SHARD_KEYS = 1_000_000


def possibly_repeated(hashes: DataFrame, shards: int) -> DataFrame:
    """First pass: hashes that their shard's Bloom filter had already let in when they came, so every one that occurs
    twice, and a few others. Eight bytes a row are shuffled, none of its text, and of a hash that fills a batch only two."""

    def thin(batches):
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.record_batch([pa.array(np.repeat(h, np.minimum(n, 2)))], names=["h"])

    def find(batches):
        seen = bloom.Bloom(bloom.bits_for(2 * SHARD_KEYS, BITS_PER_KEY), PROBES)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            hit = np.unique(h[seen.seen(h)])
            if len(hit):
                yield pa.record_batch([pa.array(hit.view(np.int64))], names=["h"])

    return hashes.mapInArrow(thin, "h long").repartition(shards, "h").mapInArrow(find, "h long").distinct()


def distinct_texts(docs: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row for each text: the one with the smallest ``by``; all columns as they were.

    Pass one finds the hashes of texts that may occur twice. Pass two reads the table once more: a row whose hash isn't
    in their filter goes straight through; only the others are shuffled, by hash and compared as whole texts, so a
    collision of hashes or a false positive never drops a row. Each task first drops all but one copy of a text among its own
    rows, so of a text with any number of copies no more rows are shuffled than there are tasks.

    Rows with a null text stay, all of them. The empty text is a text. Of rows alike in text and ``by`` (repeated rows)
    one stays; a null ``by`` comes after all others. An empty table stays empty.
    """
    need(docs, text, by)
    spark = docs.sparkSession
    hashes = written(docs.where(F.col(f"`{text}`").isNotNull()).select(F.xxhash64(F.col(f"`{text}`")).alias("h")), "hashes")
    n = hashes.count()
    repeated = written(possibly_repeated(hashes, max(1, math.ceil(n / SHARD_KEYS))), "repeated")
    filter_ = bloom.write(repeated, repeated.count(), BITS_PER_KEY, PROBES)

    rows = packed(docs)
    value, order = F.col(f"row.`{text}`"), F.col(f"row.`{by}`")
    h = F.xxhash64(value)
    marked = rows.withColumn("hit", F.when(value.isNull(), F.lit(False)).otherwise(filter_.probe(h)))
    straight = marked.where(~F.col("hit")).select("row")
    again = marked.where("hit").withColumn("h", h)
    # A window that keeps first rows only has a limit of its own before the shuffle.
    first = F.row_number().over(Window.partitionBy("h", value).orderBy(order.asc_nulls_last()))
    return unpacked(straight.union(again.withColumn("n", first).where("n = 1").select("row")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the exact copies of a document with a smaller doc_id."""
    return distinct_texts(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR text IS NULL
"""
