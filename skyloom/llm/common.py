"""What several operators share: tables, written intermediates, byte words and 64-bit hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The byte words of a text: runs of anything but \x20 and \x09-\x0D, with A-Z lower-cased; bytes.split() cuts at these six.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75


#: Arrow batches to and from Python workers hold about so many bytes (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. From here on the session's Arrow batches are bounded by bytes, so that long texts fill no worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Unset, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut, and it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_so_far() -> list[str]:
    """The tables that `written` has made in this process, in order."""
    return list(_WRITTEN)


def remove_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that `written` has made in this process (all, if None); results that still read them are lost with them."""
    gone = written_so_far() if paths is None else paths
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN[:] = [p for p in _WRITTEN if p not in set(gone)]


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """df with its columns named c0, c1, ... in order, and where a column of the old name is now (its exact name, or else in
    any case): names of the input, even those alike but for their case, clash with none of an operator's own."""
    names = df.columns

    def place(name: str) -> str:
        at = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {name!r}")
        return f"c{at[0]}"

    return df.toDF(*[f"c{i}" for i in range(len(names))]), place


def others(columns: list[str], added: tuple[str, ...]) -> dict[str, str]:
    """Numbered name -> name of the columns that are not named, in any case, like one that an operator adds."""
    taken = {c.lower() for c in added}
    return {f"c{i}": c for i, c in enumerate(columns) if c.lower() not in taken}


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, where it is one that can be told about its memory."""
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") and hasattr(found, "mallopt") else None


#: mallopt's parameters for the size from which a block is given back when it is freed, and for the free memory at the heap's end
#: from which that is given back. Fixed values of the C library.
_M_MMAP_THRESHOLD, _M_TRIM_THRESHOLD = -3, -1


def lean() -> None:
    """From here on this worker gives freed blocks of 4 MB or more back at once, Arrow's included, and smaller ones when 32 MB are
    free: to get pages anew for every array of a batch takes a twentieth of a task's time."""
    pa.set_memory_pool(pa.system_memory_pool())
    if _libc():
        _libc().mallopt(_M_MMAP_THRESHOLD, 4 << 20)
        _libc().mallopt(_M_TRIM_THRESHOLD, 32 << 20)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives free memory back at its end: a worker that waits for its next task holds little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if _libc():
            _libc().malloc_trim(0)

    return run


class WordHash(dict):
    """Byte word -> 64-bit hash, computed once for each word. clear_if_full bounds its memory."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles; fewer than k words are one shingle, none give an empty set."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out *= _STEP
        out += words[i : n - width + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain columns and arrays of them; it needs no session, so tasks can call it."""
    fields = []
    for column in ddl.split(", "):
        name, kind = column.rsplit(" ", 1)
        fields.append((name.strip("`"), pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal values in the first `keys` columns (integers without nulls)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_batches(held)
