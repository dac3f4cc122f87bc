"""Token-id files (operator 6): concatenated ids and Elias–Fano encoded document boundaries.

Documents are range-sorted by doc_id and each task writes one shard, ids first as they are made, then the
ends of its documents and their doc_ids, both Elias–Fano encoded, then a footer. A shard's name carries a
random part, and only the shards that the manifest names count, so a task that is run again harms nothing.
Files are written and read through pyarrow's file systems, in the shared folder or one that the caller names.

Layout: magic `RGT1`; ids, 2 or 4 bytes each, little-endian; boundary section; key section; footer: five
64-bit numbers (documents, of which without doc_id, ids, bytes of the boundary section, first doc_id), the
width of an id, and `RGT1` again.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import eliasfano
from .common import checkpointed, coded, open_folder, ragged, shared_dir, slices, table
from .pretokens import split_pretokens

MAGIC = b"RGT1"
_FOOT = "<QQQQqB4s"
CHUNK_BYTES = 24 << 20
#: Documents whose boundaries are selected together, and ids that are read together.
READ_DOCS, READ_IDS = 1 << 16, 4 << 20
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000


class Encoder:
    """Ids of whole texts by the tokenizers library, each different word of a byte-level tokenizer encoded once a chunk; null texts count as empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        pre = about.get("pre_tokenizer") or {}
        self.by_word = (
            about.get("normalizer") is None and about.get("post_processor") is None and about["model"].get("type") == "BPE" and not about["model"].get("dropout")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        self.whole = [x["content"].encode() for x in about.get("added_tokens") or ()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = {b: b if b in shown else next(hidden) for b in range(256)}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        if (ids := self.new.get(word)) is None:
            if (ids := self.old.get(word)) is None:
                ids = np.array([t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))], self.dtype).tobytes()
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if not self.by_word:
            each = [np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, self.dtype) for x in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)
        words, counts = split_pretokens(texts)
        codes, distinct = coded(words)
        encoded = list(map(self.word, distinct.to_pylist()))
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.width
        flat = np.frombuffer(b"".join(encoded), self.dtype)
        start = np.cumsum(size) - size
        ids, lengths = flat[ragged(start[codes], size[codes])], np.add.reduceat(np.append(size[codes], 0), np.minimum(np.cumsum(counts) - counts, len(codes))) if len(counts) else counts
        lengths = np.where(counts > 0, lengths, 0).astype(np.int64)
        # texts with a token that stands for itself are encoded whole
        rows = [i for i, x in enumerate(texts.to_pylist()) if x and any(w in x.encode() for w in self.whole)] if any(self._holds(words, w) for w in self.whole) else []
        if rows:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in rows:
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, lengths

    @staticmethod
    def _holds(words: pa.Array, token: bytes) -> bool:
        data = words.buffers()[2]
        return data is not None and token in data.to_pybytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _writer(path: str, end_id: int, folder: str):
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        sizes, keys, n_ids, out = [], [], 0, None
        tokens = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                if out is None:
                    store, where = open_folder(folder)
                    store.create_dir(where, recursive=True)
                    out = store.open_output_stream(f"{where}/{name}")
                    out.write(MAGIC)
                ids, lengths = tokens.ids(part.column("text"))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                out.write(np.ascontiguousarray(ids, tokens.dtype).tobytes())
                sizes.append(lengths + 1)
                keys.append(part.column("doc_id"))
                n_ids += len(ids)
        if out is None:
            return
        keys = pa.chunked_array(keys).combine_chunks()
        missing, known = keys.null_count, keys.drop_null().to_numpy(zero_copy_only=False)
        bounds = eliasfano.encode(np.cumsum(np.concatenate(sizes)))
        first = int(known[0]) if len(known) else 0
        out.write(bounds + eliasfano.encode(known.astype(np.uint64) - np.uint64(first % (1 << 64))))
        out.write(struct.pack(_FOOT, len(keys), missing, n_ids, len(bounds), first, tokens.width, MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(keys)], "n_ids": [n_ids]}, schema=_MANIFEST)

    return run


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write every text's ids, `end_id` after each, in ascending doc_id order; the manifest, a row for each shard.

    Documents without doc_id come first, those that share one in order of their texts' hashes.
    A null text counts as empty: it has its end id alone.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    shards = checkpointed(ordered.mapInArrow(_writer(tokenizer, end_id, folder), "shard int, file string, n_docs bigint, n_ids bigint"))
    return shards.withColumn("first", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna({"first": 0})


class Shard:
    """One file: `starts` and `doc_ids` of a stretch of documents, `ids(i)` of one by select, or blocks of them."""

    def __init__(self, folder: str, name: str):
        store, where = open_folder(folder)
        self.file = store.open_input_file(f"{where}/{name}")
        size, foot = self.file.size(), struct.calcsize(_FOOT)
        n, self.missing, self.n_ids, bounds, self.first, width, magic = struct.unpack(_FOOT, self.file.read_at(foot, size - foot))
        if magic != MAGIC:
            raise ValueError(f"{name} isn't a token file")
        self.n, self.dtype = n, np.dtype(f"<u{width}")
        at = len(MAGIC) + self.n_ids * width
        rest = self.file.read_at(size - at - foot, at)
        self.bounds, self.keys = eliasfano.Ascending(rest), eliasfano.Ascending(rest[bounds:])

    def starts(self, first: int, last: int) -> np.ndarray:
        """Where documents first … last - 1 begin, and where the last of them ends."""
        ends = self.bounds.between(max(0, first - 1), last)
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, last: int) -> pa.Array:
        known = self.keys.between(max(0, first - self.missing), max(0, last - self.missing))
        missing = max(0, min(last, self.missing) - first)
        return pa.concat_arrays([pa.nulls(missing, pa.int64()), pa.array((known.astype(np.uint64) + np.uint64(self.first % (1 << 64))).view(np.int64), pa.int64())])

    def read(self, first: int, last: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((last - first) * width, len(MAGIC) + first * width), self.dtype)

    def ids(self, i: int) -> np.ndarray:
        return self.read(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                shard = Shard(folder, name)
                for begin in range(0, shard.n, READ_DOCS):
                    end = min(shard.n, begin + READ_DOCS)
                    offsets, keys, first = shard.starts(begin, end), shard.doc_ids(begin, end), 0
                    while first < len(keys):
                        last = min(len(keys), max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, "right")) - 1))
                        ids = memoryview(shard.read(int(offsets[first]), int(offsets[last])).astype("<u4")).cast("B")
                        at = ((offsets[first : last + 1] - offsets[first]) * 4).tolist()
                        sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array(offsets[first:last] + before), pa.array(np.diff(offsets[first : last + 1])), pa.array(sums, pa.int64())], schema=_DIGEST)
                        first = last

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of a manifest."""
    n = max(1, manifest.count())
    return manifest.select("file", "first").repartition(n, "file").mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return read_tokens(manifest, folder)
