"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import bloom
from tracewell.llm.common import beside, need, packed, table, unpacked, without, without_ids, written
from tracewell.llm.graph import components
from tracewell.llm.textvec import grams, mix, raw, slices, words

#: A signature is 32 min-hashes of 16 bits over word pairs.
HASHES, SHINGLE = 32, 2
#: Two documents are near copies when at most so many of the 32 hashes differ. Word pairs shared by 75 % of both
#: (about 4 % of the words edited on one side, both sides edited included) are found with probability 0.98.
DISTANCE = 13
#: Pigeonhole: 7 chunks and at most 13 = 2 * 7 - 1 differing hashes leave a chunk with one error at most.
CHUNKS, ERRORS = 7, 1
#: Members of one bucket that a task compares at once; a larger bucket is compared block by block in many tasks.
BLOCK = 4096

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_X = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_R = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_TAG = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_CHUNK = np.array_split(np.arange(HASHES), CHUNKS)
assert (ERRORS + 1) * CHUNKS > DISTANCE


def signatures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have words, their signatures as rows of uint16). A text of one word is hashed as that word."""
    h, first, _, _ = words(data, off)
    count = np.diff(first)
    g, whole = grams(h, first, SHINGLE)
    owner = np.repeat(np.arange(len(count)), count)
    lone = first[:-1][count == 1]
    if len(lone):
        at = np.append(np.flatnonzero(whole), lone)
        values = np.append(g[whole], mix(h[lone]))
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
    else:
        at, values = np.flatnonzero(whole), g[whole]
    have = np.flatnonzero(count)
    sig = np.empty((len(have), HASHES), np.uint16)
    if len(have):
        starts = np.searchsorted(owner[at], have)
        for k in range(HASHES):
            sig[:, k] = (mix(np.minimum.reduceat((values ^ _X[k]) * _A[k], starts)) >> np.uint64(48)).astype(np.uint16)
    return have, sig


def index_keys(sig: np.ndarray) -> np.ndarray:
    """32 keys of each signature: for each chunk, a hash of the chunk with each one of its positions left out.

    Leaving a position out enumerates all errors at it at once, on both sides, so signatures that differ in one
    position of a chunk at most share a key.
    """
    terms = (sig.astype(np.uint64) + np.uint64(1)) * _R
    keys = np.empty(sig.shape, np.uint64)
    for positions in _CHUNK:
        keys[:, positions] = mix(terms[:, positions].sum(axis=1, keepdims=True) - terms[:, positions] + _TAG[positions])
    return keys.view(np.int64)


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(raw(v)[0], np.uint16).reshape(-1, HASHES) for v in (a, b))
    return (x != y).sum(axis=1)


def signature_table(docs: DataFrame, null_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, sig, and the columns ``carry``) of all rows with an id of any type (or, if ``null_ids``, without one, too) and at least one word."""

    def sign(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                have, sig = signatures(*raw(part))
                if len(have):
                    rows = pa.array(have + at)
                    yield pa.record_batch([batch.column(0).take(rows), pa.array([r.tobytes() for r in sig], pa.binary()), *(batch.column(2 + k).take(rows) for k in range(len(carry)))], names=["id", "sig", *carry])

    rows = docs.select(F.col("doc_id").alias("id"), "text", *carry).where("text IS NOT NULL")
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("sig", T.BinaryType()), *(docs.schema[c] for c in carry)])
    return (rows if null_ids else rows.where("id IS NOT NULL")).mapInArrow(sign, schema)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, and every other column of nodes but sig) for each of the 32 keys of each node."""
    names = [c for c in nodes.columns if c != "sig"]

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = index_keys(np.frombuffer(raw(part.column(part.schema.get_field_index("sig")))[0], np.uint16).reshape(-1, HASHES))
                row = pa.array(np.repeat(np.arange(part.num_rows), HASHES))
                yield pa.record_batch([pa.array(keys.ravel()), *(part.column(part.schema.get_field_index(n)).take(row) for n in names)], names=["key", *names])

    return nodes.mapInArrow(index, "key long, " + ", ".join(f"{n} long" for n in names))


def _centers(nodes: DataFrame) -> DataFrame:
    """(key, id): of nodes(id, sig), each batch's smallest member of each of its buckets. The rest of a bucket stays behind, however
    large it is, so a bucket has no more rows here than there are batches."""

    def index(batches):
        for batch in batches:
            ids, keys = _bucketed(batch)
            first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
            yield pa.record_batch([pa.array(keys[first]), pa.array(ids[first])], names=["key", "id"])

    return nodes.select("id", "sig").mapInArrow(index, "key long, id long")


def _bucketed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(id, key) of all members of all buckets of a batch(id, sig), by key, then id."""
    keys = index_keys(np.frombuffer(raw(batch.column(1))[0], np.uint16).reshape(-1, HASHES)).ravel()
    ids = np.repeat(batch.column(0).to_numpy(), HASHES)
    order = np.lexsort((ids, keys))
    return ids[order], keys[order]


def _local(nodes: DataFrame) -> DataFrame:
    """Near pairs (a, b) of the members of each batch's buckets with the smallest member there."""

    def link(batches):
        for batch in batches:
            ids, keys = _bucketed(batch)
            if not len(ids):
                continue
            first = np.append(True, keys[1:] != keys[:-1])
            center = ids[first][np.cumsum(first) - 1]
            pair = np.unique(np.stack([ids[~first], center[~first]]), axis=1)
            own = batch.column(0).to_numpy()
            order = np.argsort(own)
            sig = np.frombuffer(raw(batch.column(1))[0], np.uint16).reshape(-1, HASHES)
            a, b = (order[np.searchsorted(own[order], x)] for x in pair)
            near = np.concatenate([(sig[a[k : k + 8192]] != sig[b[k : k + 8192]]).sum(axis=1) for k in range(0, len(a), 8192)]) <= DISTANCE if len(a) else np.zeros(0, bool)
            yield pa.record_batch([pa.array(pair[0][near]), pa.array(pair[1][near])], names=["a", "b"])

    return nodes.select("id", "sig").mapInArrow(link, "a long, b long")


def _near(pairs: DataFrame) -> DataFrame:
    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(differing(a, b).astype(np.int32))

    return pairs.withColumn("distance", distance("sig_a", "sig_b")).where(F.col("distance") <= DISTANCE)


def _crossing(rows: DataFrame) -> DataFrame:
    """Edges between differently labelled members of one bucket that are near: rows(key, id, label, sig) sorted by key.

    A member compares itself with all members not yet reached, and what it reaches leaves these, so a bucket of
    copies costs one pass, and the edges span every component that comparing all pairs would give.
    """

    def link(batches):
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now
            key = now["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = now.slice(cut)
            if cut:
                yield from buckets(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from buckets(rest)

    def buckets(now):
        key, node, label = (now[c].to_numpy() for c in ("key", "id", "label"))
        sig = np.frombuffer(raw(now["sig"])[0], np.uint16).reshape(-1, HASHES)
        starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            left = np.arange(lo, hi)
            while len(left):
                group, left = left[:1], left[1:]
                while len(group) and len(left):
                    me, group = group[0], group[1:]
                    hit = (label[left] == label[me]) | ((sig[left] != sig[me]).sum(axis=1) <= DISTANCE)
                    found = left[hit]
                    new = found[label[found] != label[me]]
                    a.extend([node[me]] * len(new))
                    b.extend(node[new].tolist())
                    group, left = np.append(group, found), left[~hit]
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the group's smallest doc_id.

    Groups are the connected components of *all* pairs of documents whose signatures differ in DISTANCE hashes at
    most; no such pair is missed (pigeonhole), and none beyond it links. First equal signatures fall together.
    Then each bucket of the index links its members to a smallest one, first within a batch, then among batches, where the
    distance allows, and the components are labelled: time and shuffle grow with documents, not with pairs, however many
    copies there are. Only buckets that still hold differing labels compare their members further.

    doc_id may have any type that can be ordered. Rows with a null doc_id or text, or without a word, have no near copies. Rows of one
    doc_id count as one document that has the words of each; they never make a group by themselves. Texts of any length are
    signed whole. Other columns are ignored. An empty table gives none.
    """
    need(docs, "doc_id", "text")
    signed = written(signature_table(docs).distinct(), "signatures")
    nodes = _nodes(signed)
    several = signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    equal = nodes.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
    if not several.isEmpty():
        owned = written(beside(signed, several, "id", F.col("n")).select(F.col("id").alias("doc"), "n", "sig").join(nodes, "sig").select("doc", "n", F.col("id").alias("a")), "owned")
        equal = beside(owned.select("doc", "a"), owned.groupBy("doc").agg(F.min("a").alias("b"), F.max("n").alias("n")), "doc", F.col("n")).select("a", "b").where("a <> b")
    member = written(_labelled(signed, nodes, equal).select("id", "label").distinct(), "members")
    groups = member.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("size")).where("size > 1")
    return beside(member, groups, "label", F.col("size")).select(F.col("id").alias("doc_id"), "group_id")


def _nodes(signed: DataFrame) -> DataFrame:
    """(sig, rows, id): each signature of signed(id, sig) once, with a number, written so that it stays."""
    return written(signed.groupBy("sig").agg(F.count("*").alias("rows")).withColumn("id", F.monotonically_increasing_id()), "nodes")


def _labelled(signed: DataFrame, nodes: DataFrame, equal: DataFrame) -> DataFrame:
    """``signed`` with the label of each row's component."""
    found = nodes.join(_linked(nodes.select("id", "sig"), equal), F.col("id") == F.col("node"), "left").select("sig", "rows", F.coalesce("label", "id").alias("label"))
    return beside(signed, found, "sig", F.col("rows"))


def _blocks(members: DataFrame) -> DataFrame:
    """(id, key): members(key, id, label) of large buckets in units of two blocks of at most about BLOCK members each.

    Members of a bucket's most frequent label need no comparison among themselves, so only their blocks with those of the rest
    are units, and the pairs of blocks of the rest: a bucket of one huge group and a few others costs as many rows as it has members.
    """
    counts = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"))
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("long")
    top = written(top.select("key", "n", F.col("top.label").alias("most"), blocks(F.col("top.c")).alias("its"), blocks(F.col("n") - F.col("top.c")).alias("rest")), "large-buckets")
    own, upto = F.col("label") == F.col("most"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    rows = beside(members, top, "key", F.col("n")).withColumn("mine", F.pmod(F.xxhash64("id"), F.when(own, F.col("its")).otherwise(F.col("rest"))))
    across = F.transform(upto("rest"), lambda k: F.xxhash64("key", F.lit("most"), "mine", k))
    back = F.transform(upto("its"), lambda k: F.xxhash64("key", F.lit("most"), k, "mine"))
    among = F.transform(upto("rest"), lambda k: F.xxhash64("key", F.lit("rest"), F.least("mine", k), F.greatest("mine", k)))
    return rows.select("id", F.explode(F.when(own, across).otherwise(F.concat(back, among))).alias("key"))


def _linked(nodes: DataFrame, equal: DataFrame) -> DataFrame:
    """(node, label) of the components of nodes(id, sig), each signature once, by near pairs and the edges equal(a, b)."""
    star = written(_centers(nodes).select("id", F.min("id").over(Window.partitionBy("key")).alias("center")).where("id <> center").distinct(), "centers")
    lookup = nodes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    # A center has a row for each batch that knows its bucket.
    other = star.groupBy(F.col("center").alias("b")).agg(F.count("*").alias("n")).join(nodes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = beside(star.select(F.col("id").alias("a"), F.col("center").alias("b")), written(other, "others"), "b", F.col("n")).join(lookup, "a")
    edges = written(_near(pairs).select("a", "b").union(_local(nodes)).union(equal), "star")
    labels = written(components(edges), "labels")

    labelled = written(nodes.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "sig"), "labelled")
    mixed = _keyed(labelled).groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = written(mixed.select("key", "n"), "mixed")
    members = beside(_keyed(labelled), mixed, "key", F.col("n"))
    units = members.where(F.col("n") <= BLOCK).select("id", "key")
    if not mixed.where(F.col("n") > BLOCK).isEmpty():
        units = units.union(_blocks(members.where(F.col("n") > BLOCK).drop("n")))
    rows = units.join(labelled, "id").select("key", "id", "label", "sig")
    crossing = _crossing(rows.repartition("key").sortWithinPartitions("key", "id"))
    more = written(crossing.distinct(), "crossing")
    if not more.isEmpty():
        labels = written(components(edges.union(more)), "labels")
    return labels


def near_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): every document but the smallest of its group, with that one."""
    return near_groups(docs).where("doc_id <> group_id").select("doc_id", F.col("group_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies of a smaller doc_id; all columns, extra ones too, as they were.

    One document of each group stays. Rows with a null doc_id, a null text or no word stay. Rows with one doc_id stay or go together.
    """
    return without_ids(docs, near_pairs(docs).select(F.col("doc_id").alias("gone")))


def drop_near_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies, by row: of each group of near rows one stays; all columns as they were.

    Every row with a word is compared by its own text, also rows with a null doc_id, repeated rows and further texts of
    one doc_id. Groups are those of near_groups(), of signatures instead of ids. The row with the smallest doc_id stays,
    null ids last; of several such rows, the first by signature, then by a hash of the text, then by all columns. Rows with a null text
    or no word stay. A row is found again by its id and the hash of its text, so texts are signed once.
    An empty table stays empty.
    """
    need(docs, "doc_id", "text")

    def row_key(doc_id: Column, of: Column) -> Column:
        return F.xxhash64(doc_id.isNull(), doc_id, of)

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))
    signed = written(signature_table(texts, null_ids=True, carry=("of",)).groupBy("id", "sig", "of").agg(F.count("*").alias("copies")), "signatures")
    nodes = _nodes(signed)
    member = written(_labelled(signed, nodes, nodes.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))).select("id", "sig", "of", "copies", "label"), "members")
    order = F.struct(F.col("id").isNull(), "id", "sig", "of")
    best = member.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    ranked = beside(member, best, "label", F.col("size")).select(row_key(F.col("id"), F.col("of")).alias("key"), (F.col("best") == order).alias("stays"), "copies")
    ranked = written(ranked, "ranked")

    rows = packed(docs).withColumn("mark", F.when(F.col("row.text").isNotNull(), row_key(F.col("row.doc_id"), F.xxhash64("row.text"))))
    decided = ranked.where("NOT stays OR copies > 1").select(F.col("key").alias("gone")).distinct()
    kept = without(rows, F.col("mark"), written(decided, "decided")).select("row")
    repeated = written(ranked.where("stays AND copies > 1").select("key"), "repeated")
    if n := repeated.count():
        # Of rows that repeat a whole group's first one, all columns decide; a limit before the shuffle leaves one for each task.
        again = rows.where(F.col("mark").isNotNull()).where(bloom.write(repeated.select(F.xxhash64("key").alias("h")), n).probe(F.xxhash64("mark")))
        nth = F.row_number().over(Window.partitionBy("mark").orderBy(F.to_json("row")))
        kept = kept.union(again.withColumn("nth", nth).where("nth = 1").join(repeated, F.col("mark") == F.col("key"), "left_semi").select("row"))
    return unpacked(kept)


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy in documents, with the document of its group that stays."""
    return near_pairs(table(spark, sf_dir, "documents"))
