"""Helpers that the training-data operators share: tables, checkpoints and vectorised word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Byte classes: `[^\x20\x09-\x0D]+` is a plain word, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` a lower-cased one.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[32, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own, in local mode alone."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="relgraph-checkpoint-"))
    return sc.getCheckpointDir()


def open_folder(folder: str):
    """The file system of a folder, and its path there, for Arrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one buffer, and the n + 1 offsets into it; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, alnum: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of every text: a flat binary array, the number of words per text, and each word's byte offset.

    Plain words are runs of anything but ASCII white space; with `alnum`, of digits, lower-case letters
    and non-ASCII characters. Words never span two texts.
    """
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(n, np.int64), np.zeros(0, np.int64)
    if lower or alnum:
        data = _LOWER[data]
    inside = (_ALNUM if alnum else _PLAIN)[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, False
    np.logical_not(inside[:-1], out=first[1:-1])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first[:-1] & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, counts, starts


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary form of a word array: the code of each word, and the distinct words."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks() if d.num_chunks else pa.array([], words.type).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, run i being counts[i] long."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, … (lengths[i] of them) for every i, concatenated."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def tidy(step):
    """An Arrow step that returns freed memory to the system when its task ends, as Python workers wait for the next one."""

    @wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def crc32_text(value) -> int:
    return zlib.crc32(str(value).encode())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """The batch in slices whose `column` holds at most `most_bytes` each (a longer single row stands alone)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if i > first and held + size > most_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)
