"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import local_path, need, new_path, open_fs, table, written
from tracewell.llm.textvec import raw

#: Words whose pages' addresses go on the list, and the share of a host's pages that puts the host there.
WORDS = ("idiot", "moron", "worthless", "clown")
HOST_PERCENT, HOST_PAGES = 6, 3


def host(url: Column) -> Column:
    """Lower-case host without user, port, and a leading www. or m."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"#.*$", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(name, r"^(www|m)[.]", "")


def canonical(url: Column) -> Column:
    """host() and the path and query, without fragment, tracking parameters (utm_*, ref) and slashes at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"#.*$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?]&+", "?"), r"[?&/]+$", "")
    return F.concat(host(url), rest)


#: Entries of one shard of a digest array.
SHARD_ENTRIES = 4_000_000
_FILES = (("keys", np.uint64), ("starts", np.int64), ("strings", np.uint8))


def build_list(entries: DataFrame, path: str) -> str:
    """Write the distinct strings of the column ``entry`` as a digest array under ``path``, sorted by XXH64 digest (Spark's xxhash64: seed 42).

    The array lies in shards by the digests' leading bits, so shards in a row are sorted, too, and each is filled by one
    task that streams its strings: NNNNN.keys, digests; NNNNN.starts, where each string begins in NNNNN.strings, and the end. Neither
    the driver nor an executor holds the list. Null and empty entries are left out; without any the array is empty.
    """
    need(entries, "entry")
    rows = written(entries.select("entry").where("entry <> ''").distinct().withColumn("key", F.xxhash64("entry")), "entries")
    bits = max(0, (rows.count() - 1) // SHARD_ENTRIES).bit_length()
    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")

    def save(batches):
        fs, folder = open_fs(path)
        attempt, now, outs, at = TaskContext.get().taskAttemptId(), -1, [], 0

        def close():
            outs[1].write(np.array([at], np.int64).tobytes())
            for (name, _), out in zip(_FILES, outs):
                out.close()
                fs.move(f"{folder}/.{now:05d}.{name}.{attempt}", f"{folder}/{now:05d}.{name}")

        for batch in batches:
            own = batch.column(2).to_numpy()
            for k in np.unique(own).tolist():
                if k != now:
                    if outs:
                        close()
                    now, at = k, 0
                    outs = [fs.open_output_stream(f"{folder}/.{k:05d}.{name}.{attempt}") for name, _ in _FILES]
                part = batch.filter(pa.array(own == k))
                data, off = raw(part.column(0))
                outs[0].write(part.column(1).to_numpy().astype(np.int64).tobytes())
                outs[1].write((at + off[:-1]).tobytes())
                outs[2].write(data.tobytes())
                at += len(data)
        if outs:
            close()
        yield pa.record_batch([pa.array([now])], names=["shard"])

    fs, folder = open_fs(path)
    fs.create_dir(folder, recursive=True)
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    rows.select("entry", "key", shard.alias("shard")).repartition(1 << bits, "shard").sortWithinPartitions("shard", unsigned, "entry").mapInArrow(save, "shard long").count()
    with fs.open_output_stream(f"{folder}/bits") as out:
        out.write(str(bits).encode())
    return path


class DigestList:
    """The array's shards, each mapped into memory when first probed where the folder is mounted, so processes share one copy of
    the pages they touch; read whole from an object store."""

    def __init__(self, path: str):
        self.path, self.shards = path, {}
        fs, folder = open_fs(path)
        with fs.open_input_stream(f"{folder}/bits") as f:
            self.bits = int(f.read())

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(keys, starts, strings) of a shard; None for one without entries."""
        if k not in self.shards:
            from pyarrow.fs import FileType

            fs, folder = open_fs(self.path)
            if fs.get_file_info(f"{folder}/{k:05d}.keys").type == FileType.NotFound:
                self.shards[k] = None
            elif local_path(self.path) is not None:
                self.shards[k] = tuple(np.memmap(f"{folder}/{k:05d}.{name}", kind, "r") for name, kind in _FILES)
            else:
                self.shards[k] = tuple(np.frombuffer(fs.open_input_stream(f"{folder}/{k:05d}.{name}").read(), kind) for name, kind in _FILES)
        return self.shards[k]

    def has(self, keys: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts are on the list: digests by binary search, then the strings stored at an equal digest, against collisions."""
        out = np.zeros(len(keys), bool)
        where = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(where).tolist():
            if (found := self.shard(s)) is None:
                continue
            own, starts, strings = found
            mine = np.flatnonzero(where == s)
            at = np.searchsorted(own, keys[mine])
            near = at < len(own)
            equal = np.zeros(len(mine), bool)
            equal[near] = own[at[near]] == keys[mine[near]]
            for i in np.flatnonzero(equal).tolist():
                text, k = texts[int(mine[i])].as_py().encode(), int(at[i])
                while k < len(own) and own[k] == keys[mine[i]]:
                    if strings[starts[k] : starts[k + 1]].tobytes() == text:
                        out[mine[i]] = True
                        break
                    k += 1
        return out


_open: dict[str, DigestList] = {}


def listed(candidates: Column, path: str) -> Column:
    """The first of an array of strings that is on the list at ``path``; null where none is."""

    @F.arrow_udf("string")
    def probe(texts: pa.Array, keys: pa.Array) -> pa.Array:
        if path not in _open:
            _open.clear()
            _open[path] = DigestList(path)
        flat = texts.flatten()
        hit = np.flatnonzero(_open[path].has(keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64), flat))
        row = np.repeat(np.arange(len(texts)), np.nan_to_num(texts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))[hit]
        first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        take = np.full(len(texts), -1)
        take[row[first]] = hit[first]
        return flat.take(pa.array(take, mask=take < 0))

    return probe(candidates, F.transform(candidates, lambda c: F.xxhash64(c)))


def filter_urls(pages: DataFrame, path: str, url: str = "url") -> DataFrame:
    """Add ``canonical_url`` and ``blocked_by``: the entry that blocks the row, its canonical URL, else its host, else the host's
    nearest parent domain of two labels at least; null where none is listed.

    A null or empty URL is never blocked. All rows and other columns stay, repeated ones too; ``pages`` mustn't have columns of these two names.
    """
    need(pages, url)
    if {"canonical_url", "blocked_by"} & set(pages.columns):
        raise ValueError("pages has a column canonical_url or blocked_by")
    u = F.col(f"`{url}`")
    labels = F.split(host(u), "[.]")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    candidates = F.filter(F.concat(F.array(canonical(u), host(u)), parents), lambda c: c.isNotNull() & (c != ""))
    return pages.withColumns({"canonical_url": canonical(u), "blocked_by": listed(F.coalesce(candidates, F.array().cast("array<string>")), path)})


def flagged_addresses(pages: DataFrame) -> DataFrame:
    """``entry``: canonical URLs of pages with one of WORDS in their html, and hosts with at least HOST_PAGES such pages that make up HOST_PERCENT of theirs."""
    bad = F.lower("html").rlike("|".join(WORDS))
    marked = pages.where("url IS NOT NULL AND html IS NOT NULL").select(canonical(F.col("url")).alias("c"), host(F.col("url")).alias("h"), bad.cast("int").alias("bad"))
    hosts = marked.groupBy("h").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).where((F.col("bad") >= HOST_PAGES) & (F.col("bad") * 100 >= F.col("n") * HOST_PERCENT))
    return marked.where("bad = 1").select(F.col("c").alias("entry")).union(hosts.select(F.col("h").alias("entry")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the list entry that blocks it; the list has the flagged pages' addresses and hosts."""
    pages = table(spark, sf_dir, "pages")
    path = build_list(flagged_addresses(pages), new_path(spark, "url-list"))
    return filter_urls(pages.select("page_id", "url"), path)


_HOST = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', ''), '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^(www|m)[.]', '')"""
_REST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', ''), '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?]&+', '?', 'g'), '[?&/]+$', '')"""
SQL = f"""
WITH p AS (SELECT page_id, url, html, {_HOST} AS h, {_HOST} || {_REST} AS c FROM pages),
m AS (SELECT *, regexp_matches(lower(html), '{"|".join(WORDS)}') AS bad FROM p),
e AS (SELECT c AS entry FROM m WHERE bad UNION SELECT h FROM m WHERE html IS NOT NULL GROUP BY h HAVING count(*) FILTER (bad) >= {HOST_PAGES} AND count(*) FILTER (bad) * 100 >= count(*) * {HOST_PERCENT}),
s AS (SELECT p.*, string_split(h, '.') AS l FROM p),
k AS (SELECT s.*, unnest(list_concat([c, h], [array_to_string(l[i:], '.') FOR i IN range(2, len(l))])) AS probe, generate_subscripts(list_concat([c, h], [array_to_string(l[i:], '.') FOR i IN range(2, len(l))]), 1) AS rank FROM s),
hit AS (SELECT page_id, url, arg_min(probe, rank) AS blocked_by FROM k WHERE probe IN (SELECT entry FROM e WHERE entry <> '') GROUP BY page_id, url)
SELECT p.page_id, p.url, p.c AS canonical_url, hit.blocked_by FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url
"""
