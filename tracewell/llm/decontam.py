"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import bloom
from tracewell.llm.common import SMALL_IDS, need, table, without_ids, written
from tracewell.llm.textvec import grams, raw, slices, words

#: Shortest tile in words, and the share of an item's words that tiles must cover.
TILE, COVERAGE = 4, 0.5
#: Beyond so many characters, the benchmark isn't sent to every worker; seeds are joined by a shuffle instead.
SMALL_CHARS = 10_000_000
#: Tasks that the documents sharing one seed are spread over in that shuffle.
SALT = 32


def _pairs(a_seed, a_class, a_at, b_seed, b_class, b_at) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of a, of b) of all pairs with the same seed but another class, found without the pairs of the same class."""
    step = int(max(a_class.max(), b_class.max())) + 1
    key = b_seed * step + b_class
    order = np.argsort(key, kind="stable")
    key, b_at = key[order], b_at[order]
    ends = [np.searchsorted(key, x) for x in (a_seed * step, a_seed * step + a_class, a_seed * step + a_class + 1, (a_seed + 1) * step)]
    start, n = np.concatenate([ends[0], ends[2]]), np.concatenate([ends[1] - ends[0], ends[3] - ends[2]])
    b = b_at[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)]
    return np.repeat(np.concatenate([a_at, a_at]), n), b


def matches(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item position, document position, length) of every maximal match of at least ``least`` words.

    A match begins where seeds (``least`` words by their running Karp-Rabin hash) agree but the words before them don't,
    and ends where the words after them don't. Both are looked up without going through the agreeing seeds in between, so
    the work grows with the maximal matches: a word repeated a million times costs two passes, not a million times as many pairs.
    """
    none = np.zeros(0, np.int64)
    if min(len(item), len(doc)) < least:
        return none, none, none
    seed_i, seed_d = (grams(x, np.array([0, len(x)]), least)[0] for x in (item, doc))
    known, own = np.unique(seed_i, return_inverse=True)
    at = np.minimum(np.searchsorted(known, seed_d), len(known) - 1)
    j = np.flatnonzero(known[at] == seed_d)
    if not len(j):
        return none, none, none
    i, other = np.arange(len(seed_i)), at[j]
    # Words of the item by number; 0 is the item's border, 1 the document's border or a word that the item lacks.
    number, item_word = np.unique(item, return_inverse=True)
    at = np.minimum(np.searchsorted(number, doc), len(number) - 1)
    item_word, doc_word = np.concatenate(([0], item_word + 2, [0])), np.concatenate(([1], np.where(number[at] == doc, at + 2, 1), [1]))
    sides = []
    for shift in (0, least + 1):
        x, y = _pairs(own, item_word[i + shift], i, other, doc_word[j + shift], j)
        order = np.lexsort((x, y - x))
        sides.append((x[order], y[order]))
    # Along a diagonal beginnings and ends alternate.
    (x, y), (last, _) = sides
    return x, y, last - x + least


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash sequences: (item position, document position, length) of each tile.

    The longest match of words that no tile has yet is marked, again and again, until none of ``least`` words is
    left; equals go by item, then document position. A match that a tile cuts into goes on as the parts that are left.
    """
    i, j, n = matches(item, doc, least)
    found = []
    while len(n):
        best = np.flatnonzero(n == n.max())
        best = best[i[best] == i[best].min()]
        k = best[np.argmin(j[best])]
        a, b, size = int(i[k]), int(j[k]), int(n[k])
        found.append((a, b, size))
        for at, begin in ((0, a), (1, b)):
            s = (i, j)[at]
            before = np.minimum(s + n, begin) - s
            skip = np.maximum(s, begin + size) - s
            left, right = np.minimum(before, n) >= least, n - skip >= least
            i, j, n = np.concatenate([i[left], (i + skip)[right]]), np.concatenate([j[left], (j + skip)[right]]), np.concatenate([before[left], (n - skip)[right]])
    return found


class Benchmark:
    """Word hashes of all items in a row, and each seed's items with how often they have it."""

    def __init__(self, ids: list, texts: list[str], least: int, coverage: float):
        self.ids, self.least, self.coverage = ids, least, coverage
        self.hash, self.first, _, _ = words(*raw(pa.array(texts, pa.string())))
        self.size = np.diff(self.first)
        seed, whole = grams(self.hash, self.first, least)
        at = np.flatnonzero(whole)
        item = np.repeat(np.arange(len(ids)), self.size)[at]
        order = np.lexsort((item, seed[at]))
        seed, item = seed[at][order], item[order]
        new = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (item[1:] != item[:-1]))) if len(seed) else at
        self.item, self.times = item[new], np.diff(np.append(new, len(seed)))
        self.seed, begin = np.unique(seed[new], return_index=True)
        self.begin = np.append(begin, len(new))
        bits = max(16, int(len(self.seed) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.may = np.zeros(1 << bits, bool)
        self.may[(self.seed >> self.shift).astype(np.int64)] = True

    def scan(self, h: np.ndarray, first: np.ndarray):
        """(text, item, tiles, words covered, words of the item) of every pair whose tiles cover enough of the item.

        Only pairs are tiled where the item's seeds that the text has could cover it: each covers ``least`` words.
        """
        seed, whole = grams(h, first, self.least)
        at = np.flatnonzero(self.may[(seed >> self.shift).astype(np.int64)] & whole) if len(seed) else np.zeros(0, np.int64)
        if not len(at):
            return
        k = np.minimum(np.searchsorted(self.seed, seed[at]), len(self.seed) - 1)
        hit = self.seed[k] == seed[at]
        text, k = np.searchsorted(first, at[hit], "right") - 1, k[hit]
        once = np.unique(text * len(self.seed) + k)
        text, k = once // len(self.seed), once % len(self.seed)
        n = self.begin[k + 1] - self.begin[k]
        post = np.arange(int(n.sum())) + np.repeat(self.begin[k] - (np.cumsum(n) - n), n)
        pair, which = np.unique(np.repeat(text, n) * len(self.ids) + self.item[post], return_inverse=True)
        times = np.bincount(which, self.times[post], minlength=len(pair))
        for p in pair[times * self.least >= self.coverage * self.size[pair % len(self.ids)]].tolist():
            t, m = divmod(p, len(self.ids))
            own = self.hash[self.first[m] : self.first[m + 1]]
            found = tiles(own, h[first[t] : first[t + 1]], self.least)
            covered = sum(x[2] for x in found)
            if covered >= self.coverage * len(own):
                yield t, m, len(found), covered, len(own)


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = TILE, coverage: float = COVERAGE, small_chars: int = SMALL_CHARS) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, n_words, coverage) of each document and benchmark item where tiles cover enough of the item.

    Words (of any script, see textvec) are compared without case, punctuation or white space. Tiles may lie anywhere in the document, so an item
    whose passages were put in another order, or spread, is found as well. An item shorter than ``least`` words is a
    tile as a whole. Documents whose doc_id or text is null, and items whose item_id or text is null or without a word,
    match nothing. Repeated rows are each reported once: equal rows of the result fall together. Texts of any length are
    compared whole, also ones that repeat a few words without end. Extra columns are ignored; empty tables give no rows.

    Seeds of a benchmark of up to ``small_chars`` characters go to every worker and the documents are read once, without a
    shuffle. A larger one is joined to the documents' seeds by a shuffle; both ways give the same rows.
    """
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("n_tiles", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    if size > small_chars:
        return _by_shuffle(texts, items, least, coverage, schema)
    rows = sorted(items.collect(), key=lambda r: (str(r.item_id), r.text))
    by_least = defaultdict(list)
    for r in rows:
        n = len(words(*raw(pa.array([r.text])))[0])
        if n:
            by_least[min(n, least)].append(r)
    sent = docs.sparkSession.sparkContext.broadcast([(n, [r.item_id for r in rs], [r.text for r in rs]) for n, rs in sorted(by_least.items())])

    def scan(batches):
        marks = [Benchmark(ids, own, n, coverage) for n, ids, own in sent.value]
        for batch in batches:
            out = []
            for at, part in slices(batch.column(1)):
                h, first, _, _ = words(*raw(part))
                for mark in marks:
                    out.extend((t + at, mark.ids[m], k, c, n, c / n) for t, m, k, c, n in mark.scan(h, first))
            if out:
                where, *rest = zip(*out)
                yield pa.record_batch([batch.column(0).take(pa.array(where)), *(pa.array(v) for v in rest)], names=schema.names).cast(_arrow(schema))

    return texts.mapInArrow(scan, schema).distinct()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _by_shuffle(texts: DataFrame, items: DataFrame, least: int, coverage: float, schema: T.StructType) -> DataFrame:
    """Seeds of both sides meet by their hash; then the pairs left are tiled with both texts beside each other.

    Documents emit seeds only of the lengths that items have, and only those that a Bloom filter of all items' seeds,
    mapped from the shared folder, lets pass. The pairs are those whose shared seeds could cover enough of the item, and only
    the texts of their documents (by a second filter) are shuffled.
    """

    def numbers(h, first, n):
        """(owner, seed) of each n words in a row; seeds of different lengths are different."""
        g, whole = grams(h, first, n)
        at = np.flatnonzero(whole)
        return (np.searchsorted(first, at, "right") - 1)[: len(at)], g[at] + np.uint64(n)

    def of_items(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                h, first, _, _ = words(*raw(part))
                size = np.diff(first)
                for n in range(1, least + 1):
                    who, seed = numbers(h, first, n)
                    own = np.minimum(size[who], least) == n
                    both, times = np.unique(np.stack([who[own].astype(np.uint64), seed[own]]), axis=1, return_counts=True)
                    if both.size:
                        who = both[0].astype(np.int64)
                        yield pa.record_batch([batch.column(0).take(pa.array(who + at)), pa.array(both[1].view(np.int64)), pa.array(times), pa.array(size[who]), pa.array(np.full(len(who), n))], names=["item_id", "h", "times", "size", "n"])

    id_type = T.StructField("item_id", items.schema["item_id"].dataType)
    posts = written(items.mapInArrow(of_items, T.StructType([id_type, *(T.StructField(c, T.LongType()) for c in ("h", "times", "size", "n"))])), "item-seeds")
    lengths = sorted(r.n for r in posts.select("n").distinct().collect())  # at most ``least`` numbers
    filter_ = bloom.write(posts.select("h"), posts.count(), 16, 5)

    def of_docs(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                h, first, _, _ = words(*raw(part))
                for n in lengths:
                    who, seed = numbers(h, first, n)
                    hit = filter_.may(seed)
                    both = np.unique(np.stack([who[hit].astype(np.uint64), seed[hit]]), axis=1)
                    if both.size:
                        yield pa.record_batch([batch.column(0).take(pa.array(both[0].astype(np.int64) + at)), pa.array(both[1].view(np.int64))], names=["doc_id", "h"])

    doc_type = T.StructField("doc_id", texts.schema["doc_id"].dataType)
    have = texts.mapInArrow(of_docs, T.StructType([doc_type, T.StructField("h", T.LongType())]))
    # A seed that many documents share meets its items in SALT tasks.
    salted = posts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = have.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"])
    # Several texts of one id, or a repeated row, can only raise the count.
    could = met.groupBy("doc_id", "item_id").agg(F.sum(F.col("times") * F.col("n")).alias("most"), F.max("size").alias("size")).where(F.col("most") >= coverage * F.col("size"))
    pairs = written(could.select("doc_id", "item_id"), "candidates")
    ids = pairs.select("doc_id").distinct()
    n_ids = ids.count()
    some = texts.join(F.broadcast(ids), "doc_id", "left_semi") if n_ids <= SMALL_IDS else texts.where(bloom.write(ids.select(F.xxhash64("doc_id").alias("h")), n_ids).probe(F.xxhash64("doc_id")))
    both = some.join(pairs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "text", "item_text")

    def tile(batches):
        for batch in batches:
            doc, item, text, own = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for d, i, t, o in zip(doc, item, text, own):
                a, b = words(*raw(pa.array([o])))[0], words(*raw(pa.array([t])))[0]
                if len(a):
                    found = tiles(a, b, min(least, len(a)))
                    c = sum(x[2] for x in found)
                    if found and c >= coverage * len(a):
                        out.append((d, i, len(found), c, len(a), c / len(a)))
            if out:
                yield pa.record_batch([pa.array(v) for v in zip(*out)], names=schema.names).cast(_arrow(schema))

    return both.mapInArrow(tile, schema).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns as they were. Rows with a null doc_id or text stay."""
    return without_ids(docs, contamination(docs, benchmark, **how).select(F.col("doc_id").alias("gone")))


def drop_contaminated_rows(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """drop_contaminated() by row: each row is decided by its own text, whatever its doc_id, a null one included. Rows with a null text stay."""

    def key(text: str) -> F.Column:
        return F.unhex(F.sha2(text, 256))

    found = contamination(docs.select(key("text").alias("doc_id"), "text"), benchmark, **how)
    return without_ids(docs, found.select(F.col("doc_id").alias("gone")), key("row.text"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how much of it the tiles cover."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
