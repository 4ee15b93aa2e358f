"""From raw documents to token ids: five stages, each written as Parquet and read again.

Every stage decides each row by its own values and keeps all columns of its input, extra ones with any names included
(only the token table has columns of its own). An empty table stays empty through all stages. Null, empty, wordless, very long,
tied and repeated inputs are defined for each stage below and tested in tests/llm/test_pipeline.py; texts are always read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import new_path, table
from tracewell.llm.decontam import drop_contaminated_rows
from tracewell.llm.minhash import drop_near_rows
from tracewell.llm.mixing import keep_mixed
from tracewell.llm.quality import keep_good
from tracewell.llm.token_output import tokenized_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier, fitted on the labels of ``docs``, rejects go.

    Rows with a null text or one without a word go, too. Repeated rows fare alike; a null doc_id is scored but has no label.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies the row with the smallest doc_id stays; null and repeated ids are compared, too.

    Ties, and repeated rows, are broken by signature, then by all columns, so one row stays. Null texts and texts without a word stay.
    """
    return drop_near_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text holds a benchmark item go, whatever their doc_id; null and empty texts stay."""
    return drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources get equal weights; one with more than its share of all tokens is cut to it, the others stay whole.

    Tokens are those of the next stage's vocabulary. A null source is a source; rows of one doc_id (all null ids are one) stay or
    go together; null and empty texts have no tokens.
    """
    return keep_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the token table: doc_id, source, lang, n_tokens, tokens, one row for each input row; a null text has null tokens."""
    return tokenized_documents(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the classifier, signatures, tiling and BPE; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written to the shared folder, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
