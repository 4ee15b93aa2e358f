"""Bloom filters of 64-bit hashes in the shared folder, mapped into memory by the workers that probe them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import local_path, new_path, open_fs
from tracewell.llm.textvec import mix

#: Bits of one part of a written filter: a file of 32 MB, filled by one task.
PART_BITS = 1 << 28


def positions(h: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit positions of each hash, one row for each probe; ``bits`` is a power of two."""
    a, b = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) >> np.uint64(64 - int(bits).bit_length() + 1) for i in range(probes)]).astype(np.int64)


def bits_for(keys: int, bits_per_key: int) -> int:
    return 1 << max(10, math.ceil(math.log2(max(1, keys) * bits_per_key)))


class Bloom:
    """A filter in one task's memory."""

    def __init__(self, bits: int, probes: int):
        self.bits, self.probes, self.words = bits, probes, np.zeros(bits >> 6, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = positions(h, self.bits, self.probes)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)

    def add(self, h: np.ndarray) -> None:
        at = positions(h, self.bits, self.probes).ravel()
        np.bitwise_or.at(self.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def seen(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes the filter may have had, or an earlier place of ``h`` has; then all are added."""
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        out = self.has(h) | again
        self.add(h[~out])
        return out


_open: dict[tuple[str, int], np.ndarray | None] = {}


@dataclass(frozen=True)
class Written:
    """A filter under ``path``: files of equal parts by the hash's leading bits; a part without hashes has no file."""

    path: str
    bits: int
    parts: int
    probes: int

    def _words(self, part: int) -> np.ndarray | None:
        """A part's words: mapped where the folder is mounted, so all processes of a machine share them; read from an object store."""
        if (self.path, part) not in _open:
            from pyarrow import fs as afs

            fs, folder = open_fs(self.path)
            name = f"{folder}/{part:05d}.bits"
            if fs.get_file_info(name).type == afs.FileType.NotFound:
                _open[self.path, part] = None
            elif local_path(self.path) is not None:
                _open[self.path, part] = np.memmap(name, np.uint64, "r")
            else:
                with fs.open_input_stream(name) as f:
                    _open[self.path, part] = np.frombuffer(f.read(), np.uint64)
        return _open[self.path, part]

    def may(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be in it; never False for one that is."""
        for other in [k for k in _open if k[0] != self.path and len(_open) > 4096]:
            del _open[other]
        part = part_of(h, self.parts)
        out = np.zeros(len(h), bool)
        for p in np.unique(part).tolist():
            if (words := self._words(p)) is not None:
                own = part == p
                at = positions(h[own], self.bits // self.parts, self.probes)
                out[own] = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
        return out

    def probe(self, h: Column) -> Column:
        """may() of a column without nulls."""

        @F.arrow_udf("boolean")
        def may(values: pa.Array) -> pa.Array:
            return pa.array(self.may(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

        return may(h)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    if parts == 1:
        return np.zeros(len(h), np.int64)
    return (h >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int64)


def write(hashes: DataFrame, keys: int, bits_per_key: int = 12, probes: int = 3) -> Written:
    """Write the filter of hashes(h), about ``keys`` of them, to the shared folder. Each part is filled by one task, from hashes
    sorted by part, so a task holds one part at a time and nothing is gathered on the driver. No hashes make an empty filter."""
    bits = bits_for(keys, bits_per_key)
    parts = max(1, bits // PART_BITS)
    made = Written(new_path(hashes.sparkSession, "bloom"), bits, parts, probes)
    part = F.shiftrightunsigned("h", 64 - (parts - 1).bit_length()) if parts > 1 else F.lit(0).cast("long")

    def fill(batches):
        fs, folder = open_fs(made.path)
        now, words = -1, None

        def save():
            fs.create_dir(folder, recursive=True)
            draft = f"{folder}/.{now:05d}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                out.write(words)
            fs.move(draft, f"{folder}/{now:05d}.bits")

        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            own = part_of(h, parts)
            for p in np.unique(own).tolist():
                if p != now:
                    if words is not None:
                        save()
                        yield pa.record_batch([pa.array([now])], names=["part"])
                    now, words = p, np.zeros((bits // parts) >> 6, np.uint64)
                at = positions(h[own == p], bits // parts, probes).ravel()
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        if words is not None:
            save()
            yield pa.record_batch([pa.array([now])], names=["part"])

    rows = hashes.select(F.col("h"), part.alias("part")).repartition(parts, "part").sortWithinPartitions("part").select("h")
    rows.mapInArrow(fill, "part long").count()
    return made
