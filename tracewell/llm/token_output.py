"""Token ids as Parquet list columns, laid out for selective reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import need, new_path, table
from tracewell.llm.textvec import slices


def token_ids(df: DataFrame, text: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, to: str = "tokens") -> DataFrame:
    """Add the array column ``to`` with the BPE ids of the whole text; a null text gives null, an empty one an empty list."""
    need(df, text)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        coder, parts = bpe.load(vocabulary), []
        for _, part in slices(texts):
            ids, off = coder.encode(part)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            if part.null_count:
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=part.is_null())
            parts.append(lists)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(to, encode(F.col(f"`{text}`")))


def write_tokens(df: DataFrame, path: str, tokens: str = "tokens", encoding: str = "dictionary", row_group_mb: int = 64, page_kb: int = 256, page_rows: int = 2000, mode: str = "errorifexists") -> str:
    """Write rows with a token list column as Parquet through Spark's own committer.

    ``encoding`` of the ids: "dictionary" (ids as packed indexes into a dictionary page of each row group) or
    "delta" (format version 2, DELTA_BINARY_PACKED). Other columns keep dictionaries. Row groups end at
    ``row_group_mb``, pages at ``page_kb`` or ``page_rows`` rows; the writer adds a column index and an offset
    index for each column chunk, so a filter on doc_id, source or n_tokens skips row groups by their statistics
    and pages by the index, and a projection of metadata reads no token page. A lost executor's task is run
    again; its uncommitted file is never part of the table.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    leaf = f"{tokens}.list.element"
    (
        df.write.mode(mode)
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option(f"parquet.enable.dictionary#{leaf}", str(encoding == "dictionary").lower())
        .option("parquet.column.statistics.enabled", "true")
        .parquet(path)
    )
    return path


def tokenized_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, encoding: str = "dictionary", **layout) -> DataFrame:
    """Encode ``docs`` whole, write the token table and return it as read back: doc_id, source, lang, n_tokens, tokens.

    One row for each input row, repeated rows and null ids included. A null text has null tokens and 0 in n_tokens;
    other columns of the input aren't carried. Ids fit the vocabulary of 50,256.
    """
    need(docs, "doc_id", "text", "source", "lang")
    path = path or new_path(spark, "tokens")
    narrow = docs.select("doc_id", "source", "lang", "text")
    rows = token_ids(narrow).select("doc_id", "source", "lang", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"), "tokens")
    write_tokens(rows, path, encoding=encoding, **layout)
    return spark.read.schema(rows.schema).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the ids: the scan touches no token page."""
    return spark.read.parquet(path).drop("tokens")


def read_tokens(spark: SparkSession, path: str, where=None) -> DataFrame:
    """Token lists of the rows that pass ``where``; the filter reaches the scan's row groups and pages."""
    df = spark.read.parquet(path)
    return df if where is None else df.where(where)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token table, written with dictionary-encoded ids and read again."""
    return tokenized_documents(spark, table(spark, sf_dir, "documents"))
