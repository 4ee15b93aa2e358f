"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import need, packed, table, unpacked, written
from tracewell.llm.textvec import mix, raw, slices, words

FEATURES = ("log_words", "log_chars_per_word", "upper_share", "digit_share", "symbol_share", "stop_mark_share", "odd_word_share", "log_line_words", "repeated_word_share", "repeated_pair_share", "repeated_line_share", "top_word_share", "long_word_share", "symbol_run_share")
#: Weight of the pooled covariance in each class's, and of the mean variance on the diagonal of both.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
#: A document goes when its log odds of low quality exceed this.
THRESHOLD = 2.0

#: The model is fitted on at most so many label rows, those with the smallest hash of their doc_id: enough for 240 sums, and few
#: enough to send to all workers, so only labelled documents are read for it.
MOST_LABELS = 200_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:?'\"-()"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = ~(_ALPHA | _DIGIT | _MARK | _SPACE)


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(values), off))


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many values of each owner occurred before, the most frequent value's count)."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    # One sort of numbers: the owner in the upper bits, the hash's best bits below.
    low = np.uint64(64 - max(1, int(n - 1).bit_length()))
    key = np.sort((owner.astype(np.uint64) << low) | (h >> (np.uint64(64) - low)))
    new = np.append(True, key[1:] != key[:-1])
    o = (key >> low).astype(np.int64)
    run = np.diff(np.append(np.flatnonzero(new), len(o)))
    most = np.zeros(n)
    at = np.flatnonzero(np.append(True, np.diff(o[new]) > 0))
    most[o[new][at]] = np.maximum.reduceat(run, at)
    return np.bincount(o[~new], minlength=n).astype(float), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text, counts as logarithms and shares as their logit-like square roots."""
    n = len(off) - 1
    h, first, start, end = words(data, off)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    size = np.maximum(np.diff(off), 1).astype(float)
    some = np.maximum(count, 1).astype(float)
    letters = np.maximum(np.diff(off) - _per_text(~_ALPHA[data], off), 1)
    symbol = _SYMBOL[data]
    run = symbol.copy()
    if len(run) > 1:
        run[1:] &= symbol[:-1]
    run[off[:-1][off[:-1] < len(run)]] = False
    length = end - start
    after = np.zeros(len(end), bool)
    inner = end < off[1:][owner]  # the byte after a text's last word is another text's
    after[inner] = symbol[end[inner]]
    line = np.zeros(len(data), bool)
    line[:] = data == 10
    lines = _per_text(line, off) + 1.0
    again, most = _repeats(owner, h, n)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[owner[:-1] == owner[1:]] if len(h) > 1 else np.zeros(0, np.uint64)
    pair_again, _ = _repeats(owner[:-1][owner[:-1] == owner[1:]] if len(h) > 1 else np.zeros(0, np.int64), pairs, n)
    # A line is known by the sum of its words, each by its place.
    line_no = np.cumsum(line) if len(line) else np.zeros(0, np.int64)
    if len(h):
        at = line_no[start] + owner
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
        place = np.arange(len(h)) - np.repeat(cut, np.diff(np.append(cut, len(h))))
        line_hash = mix(np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), cut))
        line_again, _ = _repeats(owner[cut], line_hash, n)
        in_lines = np.maximum(np.bincount(owner[cut], minlength=n), 1)
    else:
        line_again, in_lines = np.zeros(n), np.ones(n)
    root = np.sqrt
    return np.stack(
        [
            np.log1p(count),
            np.log1p(np.bincount(owner, length, minlength=n) / some),
            root(_per_text(_UPPER[data], off) / letters),
            root(_per_text(_DIGIT[data], off) / size),
            root(_per_text(symbol, off) / size),
            root(_per_text(_MARK[data], off) / size),
            root(np.bincount(owner, after, minlength=n) / some),
            np.log1p(count / lines),
            root(again / some),
            root(pair_again / some),
            root(line_again / in_lines),
            root(most / some),
            root(np.bincount(owner, length > 20, minlength=n) / some),
            root(_per_text(run, off) / size),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """Per class: log prior plus normalising terms, mean, and the inverse of the covariance's Cholesky factor, computed once."""

    constant: tuple[float, float]
    mean: np.ndarray
    factor: np.ndarray

    def low_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of low against high quality: the difference of two Gaussian log densities, plus that of the priors."""
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            density.append(self.constant[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return density[0] - density[1]


def model_of(n: np.ndarray, total: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model from each class's count, sums and sums of products. A class without rows takes the other's figures
    and a count of 1, so scores are then the difference of priors; with no rows at all every score is 0."""
    d = total.shape[1]
    if not n.sum():
        return Model((0.0, 0.0), np.zeros((2, d)), np.stack([np.eye(d)] * 2))
    seen = [k if n[k] else 1 - k for k in (0, 1)]
    mean = np.stack([total[k] / n[k] for k in seen])
    spread = np.stack([products[k] / n[k] - np.outer(total[k] / n[k], total[k] / n[k]) for k in seen])
    weight = np.maximum(n, 1.0)
    pooled = np.tensordot(weight / weight.sum(), spread, 1)
    scale = np.maximum(np.diag(pooled), 1e-6)
    constant, factor = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * spread[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(scale)
        low = np.linalg.cholesky(cov)
        factor.append(np.linalg.solve(low, np.eye(d)))
        constant.append(float(np.log(weight[k] / weight.sum()) - np.log(np.diag(low)).sum()))
    return Model(tuple(constant), mean, np.stack(factor))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    parts = [statistics(*raw(part)) for _, part in slices(texts)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)).astype(np.int32)), pa.array(x.ravel()))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row whose text isn't null, written once."""
    return written(docs.select("doc_id", "text").where("text IS NOT NULL").select("doc_id", _features("text").alias("x")), "features")


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the label rows that count, MOST_LABELS at most. Null doc_ids and a quality other than 0 and 1 don't."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return known if known.count() <= MOST_LABELS else known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MOST_LABELS)


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """Fit on (doc_id, x) of the labelled rows: classes need only their sums and sums of products, added up where the rows are.

    All labels count, up to MOST_LABELS (see known_labels); a repeated label row counts again.
    """
    d = len(FEATURES)

    def add(batches):
        n, total, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k] += own.sum(axis=0)
                products[k] += own.T @ own
        values = np.concatenate([n, total.ravel(), products.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(values)).astype(np.int32)), pa.array(values)], names=["i", "v"])

    known = F.broadcast(known_labels(labels))
    sums = features.join(known, "doc_id").select("x", "y").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(2 + 2 * d + 2 * d * d)
    for r in sums:
        values[r.i] = r.v
    return model_of(values[:2], values[2 : 2 + 2 * d].reshape(2, d), values[2 + 2 * d :].reshape(2, d, d))


def scores(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, low_odds, keep) from a feature table."""

    @F.arrow_udf("double")
    def odds(x: pa.Array) -> pa.Array:
        return pa.array(model.low_odds(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    # log_words is 0 just where the text has no word.
    scored = features.select("doc_id", (F.col("x")[0] > 0).alias("worded"), odds("x").alias("low_odds"))
    return scored.select("doc_id", "low_odds", (F.col("worded") & (F.col("low_odds") <= threshold)).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, low_odds, keep) for every row of ``docs``: fitted on the labelled ones, then applied to all.

    A null text has a null score and isn't kept, nor is a text without a word. Repeated rows are scored each; a null
    doc_id is scored, too, but can't be labelled. Extra columns are ignored. Without labels every worded text is kept.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    features = feature_table(docs)
    missing = docs.where("text IS NULL").select("doc_id", F.lit(None).cast("double").alias("low_odds"), F.lit(False).alias("keep"))
    return scores(features, fit(features, labels), threshold).union(missing)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that classify() keeps; all columns as they were.

    Statistics are computed once for each row, and once more for those with a label that counts. Texts stay where they are: the labels
    are sent to them, nothing is shuffled. Texts of any length are read whole.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    # The labels' ids first, so statistics are those of labelled rows only; then each such row once.
    ids = F.broadcast(known_labels(labels).select("doc_id").distinct())
    labelled = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id", "left_semi").select("doc_id", "text")
    model = fit(written(labelled.select("doc_id", _features("text").alias("x")), "features"), labels)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [statistics(*raw(part)) for _, part in slices(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.array((x[:, 0] > 0) & (model.low_odds(x) <= threshold))

    return unpacked(packed(docs).where("row.text IS NOT NULL").where(good("row.text")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document, by a model fitted on all labels."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
