"""Files that driver and executors share: where they lie, how they are written and mapped.

Everything an operator has to hand from one job to the next goes below the folder named by `spark.checkpoint.dir`.  A file
is written under a name of its own attempt and then renamed, so a task that is repeated on another executor replaces
a file by an equal one and readers never see half of it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import io
import re
import struct
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI.  Only a session on this one machine that names none (tests) gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found:
        if held.isDefined():
            found = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="tokenlake-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    # A path without a scheme lies in the cluster's default file system, for Spark and so for the workers' files too.
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Bytes of rows that Spark hands to a Python worker at once, so that long texts don't add up to batches of hundreds of megabytes.
BATCH = 4 << 20


#: What a worker remembers from row to row and can do without.
CACHES: list[dict] = []


def forget() -> None:
    """Lets go of what the worker remembers from another operator's tasks; Spark uses one worker for many."""
    for cache in CACHES:
        cache.clear()


def release() -> None:
    """Hands memory that the worker has freed back to the system, as workers wait for their next task with all they ever took; not every C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function of a task's batches that releases memory when the task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in a batch to BATCH; a lower one that the caller has set stays.  Results are computed later, so it isn't put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH:
        spark.conf.set(name, str(BATCH))


#: Folders of results that are still read when an operator has returned: they go when the driver ends, or with `clean`.
HELD: list[str] = []


@atexit.register
def clean() -> None:
    """Removes what operators have kept in the shared folder for results that were read lazily; bundles, which are results themselves, stay."""
    while HELD:
        with contextlib.suppress(OSError):
            remove(HELD.pop())


def workspace(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new folder of this name below the shared folder, as a URI.  kept: it isn't removed by `clean`."""
    root = shared_dir(spark)
    small_batches(spark)
    made = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    filesystem, path = resolve(made)
    filesystem.create_dir(path, recursive=True)
    if not kept:
        HELD.append(made)
    return made


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column, counted."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def pack(array: np.ndarray) -> bytes:
    """Bytes of an integer array, place by place (all lowest bytes first), so that a block codec finds the runs of zeros."""
    array = np.ascontiguousarray(array)
    return array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes() if len(array) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def remove(folder: str) -> None:
    filesystem, path = resolve(folder)
    if filesystem.get_file_info(path).type != pafs.FileType.NotFound:
        filesystem.delete_dir(path)


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_bytes(uri: str, data) -> None:
    filesystem, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    filesystem, path = resolve(uri)
    with filesystem.open_input_file(path) as f:
        if length is None:
            return f.read()
        f.seek(start)
        return f.read(length)


def write_array(uri: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    write_bytes(uri, out.getbuffer())


def map_array(uri: str) -> np.ndarray:
    """Maps a stored array; from a store that cannot be mapped it is read once into the worker's temporary folder."""
    filesystem, path = resolve(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.load(path, mmap_mode="r", allow_pickle=False)
    with tempfile.NamedTemporaryFile(suffix=".npy") as local:
        local.write(read_bytes(uri))
        local.flush()
        return np.load(local.name, mmap_mode="r", allow_pickle=False)  # the mapping outlives the name


def sections(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one run of bytes: their number, a type and a length each, and their contents, all at multiples of 8."""
    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<8sq", a.dtype.str.encode(), len(a)) for a in arrays)
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def map_sections(uri: str, at: int, size: int) -> list[np.ndarray]:
    """The arrays of a run of bytes in a file, mapped where that can be done, else read."""
    filesystem, path = resolve(uri)
    return _arrays(np.memmap(path, np.uint8, "r", at, (size,)) if isinstance(filesystem, pafs.LocalFileSystem) else np.frombuffer(read_bytes(uri, at, size), np.uint8))


def map_file(uri: str) -> list[np.ndarray]:
    """The arrays of a file that is one such run of bytes, in one mapping that keeps no descriptor, as NumPy's and Python's own mappings do: a worker
    may hold more of them than it may have files open.  From a store that cannot be mapped the file is read once into the worker's temporary folder."""
    filesystem, path = resolve(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return _arrays(np.frombuffer(f.read_buffer(), np.uint8))  # the mapping lives as long as the buffer
    with tempfile.NamedTemporaryFile(suffix=".bin") as local:
        local.write(read_bytes(uri))
        local.flush()
        return map_file(local.name)


def _arrays(raw: np.ndarray) -> list[np.ndarray]:
    (n,) = struct.unpack("<q", raw[:8].tobytes())
    out, at = [], 8 + 16 * n
    for i in range(n):
        kind, length = struct.unpack("<8sq", raw[8 + 16 * i : 24 + 16 * i].tobytes())
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        out.append(raw[at : at + length * dtype.itemsize].view(dtype))
        at += length * dtype.itemsize + -length * dtype.itemsize % 8
    return out


def exists(uri: str) -> bool:
    filesystem, path = resolve(uri)
    return filesystem.get_file_info(path).type != pafs.FileType.NotFound


#: Shards of a store that a worker keeps mapped at once: the five stores of one operator stay below the 65530 mappings that Linux allows a process.
MAPPED = 8192


class HashStore:
    """Sorted hash arrays, split by the hash's leading bits into shards, mapped on first use.

    Each shard is one file `<folder>/<name>-<shard>.bin` and one mapping; the column `key` holds sorted uint64, unique or, where a column `other` holds 64 bits more, unique with these.
    """

    def __init__(self, folder: str, name: str, bits: int, columns: tuple[str, ...]):
        self.folder, self.name, self.bits, self.columns = folder, name, bits, columns
        self._held: dict[int, dict[str, np.ndarray] | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "_held": {}}

    def _uri(self, shard: int) -> str:
        return f"{self.folder}/{self.name}-{shard:05d}.bin"

    def write(self, shard: int, **arrays: np.ndarray) -> None:
        write_bytes(self._uri(shard), sections([arrays[c] for c in ("key", *self.columns)]))

    def _shard(self, shard: int) -> dict[str, np.ndarray] | None:
        if shard not in self._held:
            if len(self._held) >= MAPPED:
                self._held.clear()
            uri = self._uri(shard)
            self._held[shard] = dict(zip(("key", *self.columns), map_file(uri))) if exists(uri) else None
        return self._held[shard]

    def lookup(self, keys: np.ndarray, shards: np.ndarray | None = None, other: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """keys: uint64, sorted (inside each of the ascending `shards`, if they don't follow from the keys).  other: what the column `other` must hold, too.

        Which keys are there; each column at those keys (0 elsewhere), and as "at" their place in their shard.
        """
        found = np.zeros(len(keys), bool)
        out: dict[str, np.ndarray] = {"at": np.zeros(len(keys), np.int64)}
        shards = shard_of(keys, self.bits) if shards is None else shards
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(keys)])) if len(keys) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held = self._shard(int(shards[lo]))
            if held is None or not len(held["key"]):
                continue
            at = np.searchsorted(held["key"], keys[lo:hi])
            at[at == len(held["key"])] = 0
            hit = held["key"][at] == keys[lo:hi]
            if other is not None:
                # Keys that are equal in 64 bits stand side by side; nearly always there is one.
                at[hit], hit = _beside(held["key"], held["other"], at[hit], other[lo:hi][hit]), hit
                hit &= held["other"][at] == other[lo:hi]
            found[lo:hi] = hit
            out["at"][lo:hi] = at
            for c in self.columns:
                got = held[c][at[hit]]
                if c not in out:
                    out[c] = np.zeros(len(keys), got.dtype)
                elif got.dtype.itemsize > out[c].dtype.itemsize:
                    out[c] = out[c].astype(got.dtype)
                out[c][lo:hi][hit] = got
        return found, out | {c: np.zeros(len(keys), np.int64) for c in self.columns if c not in out}


def _beside(key: np.ndarray, other: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each place in key, the one of those of equal keys from there on whose other is the wanted one, or the last of these."""
    at = at.copy()
    while True:
        after = np.minimum(at + 1, len(key) - 1)
        wrong = np.flatnonzero((other[at] != wanted) & (after > at) & (key[after] == key[at]))
        if not len(wrong):
            return at
        at[wrong] += 1


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def shard_bits(units: float, per_shard: float, most: int = 24) -> int:
    """Bits for so many shards that each gets about per_shard units, whatever the input's size; an input that asks for over 2 ** most is refused, not squeezed."""
    bits = int(max(0, np.ceil(np.log2(max(units, 1) / per_shard))))
    if bits > most:
        raise ValueError(f"{units:.0f} units are over 2 ** {most} shards of {per_shard:.0f}: give larger shards")
    return bits
