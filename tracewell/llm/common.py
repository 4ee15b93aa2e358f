"""Shared folder, written intermediate tables and row packing used by every operator here."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``, else the one given to setCheckpointDir().

    Only a local session (tests, a laptop) that names none gets a folder of our own; on a cluster that's an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return path


def _clean() -> None:
    for path in _written:
        local = local_path(path)
        if local:
            shutil.rmtree(local, ignore_errors=True)


def local_path(uri: str) -> str | None:
    """The mounted path behind a ``file:`` URI or a plain path; None for an object store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI, on the driver or on an executor."""
    from pyarrow import fs

    local = local_path(uri)
    if local is not None:
        return fs.LocalFileSystem(), os.path.abspath(local)
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct ``row``: operators add their own columns beside it without name clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


#: A key with more rows than this is hot. There are at most rows / HOT_ROWS such keys, few enough to send to all workers.
HOT_ROWS = 200_000


def beside(rows: DataFrame, side: DataFrame, key: str, rows_of_key: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has each value of ``key`` once, without gathering the rows of a hot key in one task.

    ``rows_of_key`` says, in terms of ``side``, how many rows a key has. Hot keys are joined where their rows lie; the
    others by a shuffle. ``how`` is inner or left; rows with a null key match nothing and aren't shuffled.
    """
    hot = side.where(rows_of_key > HOT_ROWS)
    known = rows.where(F.col(key).isNotNull())
    if hot.isEmpty():
        out = known.join(side, key, how)
    else:
        cold = known.join(F.broadcast(hot.select(key)), key, "left_anti")
        out = known.join(F.broadcast(hot), key).unionByName(cold.join(side.where(~(rows_of_key > HOT_ROWS)), key, how))
    if how == "inner":
        return out
    none = rows.where(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in side.schema if f.name != key})
    return out.unionByName(none)


#: Ids up to this many are sent to all workers; more are told apart by a filter.
SMALL_IDS = 500_000


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``gone(gone)``, each key of it once; a null key stays. No row is shuffled.

    Up to SMALL_IDS keys are sent to all. More make a Bloom filter that workers map; the keys that it takes for gone but
    aren't are found beforehand among all keys of ``rows``, by a shuffle of the keys that hit, and sent to all. With too many of these the filter is made anew with more bits.
    """
    from tracewell.llm import bloom

    n = gone.count()
    if n <= SMALL_IDS:
        return rows.join(F.broadcast(gone), key == F.col("gone"), "left_anti")
    keys = rows.select(key.alias("key")).where("key IS NOT NULL")
    bits = 24
    while True:
        filter_ = bloom.write(gone.select(F.xxhash64("gone").alias("h")), n, bits, 8)
        hits = keys.where(filter_.probe(F.xxhash64("key")))
        mistaken = written(hits.join(gone, F.col("key") == F.col("gone"), "left_anti").distinct(), "mistaken")
        if mistaken.count() <= max(SMALL_IDS, 1000):
            break
        bits += 8
    marked = rows.withColumn("gone_key", key).withColumn("hit", F.when(F.col("gone_key").isNotNull(), filter_.probe(F.xxhash64("gone_key"))).otherwise(False))
    stays = marked.join(F.broadcast(mistaken.withColumnRenamed("key", "mistaken_key")), F.col("hit") & (F.col("gone_key") == F.col("mistaken_key")), "left")
    return stays.where(~F.col("hit") | F.col("mistaken_key").isNotNull()).select(*rows.columns)


def without_ids(docs: DataFrame, gone: DataFrame, by: str | Column = "row.doc_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id (or ``by``, of the struct ``row``) isn't in ``gone(gone)``; nulls stay, all columns as they were."""
    by = F.col(by) if isinstance(by, str) else by
    return unpacked(without(packed(docs), by, written(gone.distinct(), "gone")))
