"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tracewell.llm import chat, decontam, exact_dedup, minhash, mixing, quality, token_counts, token_output, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc_revisits,
        exact_dedup.op2_exact_dedup,
        mixing.op3_mixing,
        minhash.op4_minhash_near_duplicates,
        url_filter.op5_url_filter,
        quality.op6_quality_classifier,
        chat.op7_chat_examples,
        decontam.op8_benchmark_decontamination,
        token_counts.op9_token_counts,
        token_output.op10_token_output,
    )
}

SQL = {
    "op1_warc_revisits": warc.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_chat_examples": chat.SQL,
}
