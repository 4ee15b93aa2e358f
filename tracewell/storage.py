"""Cutting lineage with reliable checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def grown(seen: DataFrame, more: DataFrame, level: int) -> DataFrame:
    """``seen`` and ``more``; written anew on every 16th level, so the parts of a long walk stay few."""
    both = seen.unionByName(more)
    return cut(both.coalesce(both.sparkSession.sparkContext.defaultParallelism)) if level % 16 == 0 else both


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder of ``spark.checkpoint.dir``; a folder of our own only where a local session names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint()
