"""Token counts of sections, from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import bpe
from tracewell.llm.common import need, table
from tracewell.llm.textvec import raw, slices

RULES = ("majority", "start", "end")


def sections_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte where each section begins, first section of each text and the end). A section is a line with its
    line feed; a text that isn't empty has one at least."""
    begin = np.zeros(len(data), bool)
    begin[1:] = data[:-1] == 10
    cuts = off[:-1][np.diff(off) > 0]
    begin[cuts] = True
    start = np.flatnonzero(begin)
    return start, np.searchsorted(start, off)


def allocate(token_start: np.ndarray, token_end: np.ndarray, section_start: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token: an interval join of ascending, gapless spans by binary search.

    A token within one section belongs to it. One that crosses boundaries goes by ``rule`` to the section of its
    first byte ("start"), of its last byte ("end"), or to the one that holds most of its bytes, the earlier of
    equals ("majority").
    """
    first = np.searchsorted(section_start, token_start, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(section_start, token_end - 1, "right") - 1
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        bounds = np.clip(np.append(section_start[first[i] : last[i] + 1], token_end[i]), token_start[i], token_end[i])
        out[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return out


def section_counts(docs: DataFrame, rule: str = "majority", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_shared: one row for each section (line) of each document.

    The document is encoded once, whole; a token's span follows from the byte lengths of the ids before it.
    n_tokens adds up to the document's token count under every rule; n_shared counts those of them that cross
    into or out of the section. A document with a null or empty text has no sections, so no rows; repeated rows
    are counted each; a null doc_id is kept. Extra columns are ignored.
    """
    need(docs, "doc_id", "text")
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("section", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_shared", T.IntegerType())])

    def count(batches):
        coder = bpe.load(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, part in slices(texts):
                data, off = raw(part)
                if not len(data):
                    continue
                tokens, first_token = coder.encode(part)
                size = coder.token_bytes[tokens]
                end = np.cumsum(size)
                start, first = sections_of(data, off)
                if end[-1] != len(data):
                    raise ValueError("token spans don't tile the text")
                where = allocate(end - size, end, start, rule)
                n = np.bincount(where, minlength=len(start))
                crossing = np.searchsorted(start, end - size, "right") != np.searchsorted(start, end - 1, "right")
                shared = np.bincount(where[crossing], minlength=len(start))
                lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                stop = np.append(start[1:], len(data))
                origin = lead[off[:-1]][doc]
                yield pa.record_batch(
                    [
                        ids.take(pa.array(doc + at)),
                        pa.array((np.arange(len(start)) - first[:-1][doc]).astype(np.int32)),
                        pa.array(lead[start] - origin),
                        pa.array(lead[stop] - origin),
                        pa.array(n.astype(np.int32)),
                        pa.array(shared.astype(np.int32)),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(count, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document, crossing tokens to the line with most of their bytes."""
    return section_counts(table(spark, sf_dir, "documents"), rule="majority")
