"""Byte-level BPE encoding and decoding (operator 9).

Words are split by the public pattern, vectorised over the bytes of many documents at once (pretokens.py).
All words of the corpus are counted, and the most frequent ones, KNOWN at most, are encoded once and sent to
all tasks. Each chunk of documents is reduced to its distinct words that aren't among them, and Spark higher-order functions fold the ranked merges over the bytes of each
distinct word, looking pieces up in a literal rank map; decoding concatenates the binary pieces of the ids. A second Arrow step puts documents together again
from the codes of their words. Occurrences are never shuffled, and what is sent doesn't grow with the corpus.

The rank map is an array of `BUCKETS` small maps, picked by the hash of the piece, since Spark searches one map
from its start to its end. It is the literal row of a local relation that a scalar subquery hands to the fold: as a
literal in the expression, its megabytes would stand in the plan text that Spark keeps of every finished query.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, coded, slices, sums_by_row, table, tidy
from .pretokens import split_pretokens

BUCKETS = 65_536
#: Words of more bytes are merged with a heap in Python: a fold over them takes time quadratic in their length.
LONG_WORD = 192
#: The rank of no piece, as the fold holds ranks: times 256, so that a place in a word can be added.
NONE = 1 << 30
#: Text bytes of the documents whose distinct words are encoded together.
CHUNK_BYTES = 4 << 20
#: Most words that are encoded once for all tasks, each of LONG_WORD bytes at most, and the least count of one.
KNOWN, LEAST_COUNT = 400_000, 4
#: Text bytes that are split, and words that are put together again, at once.
SPLIT_BYTES, JOIN_WORDS = 2 << 20, 1 << 19


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def pieces_of(path: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in ranks_of(path).items()}


def _rank_map(spark: SparkSession, path: str) -> DataFrame:
    """One row: m, the rank map in BUCKETS small maps (ranks times 256, for the fold), and d, the pieces in order of ids."""
    ranks = ranks_of(path)
    buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(BUCKETS)]
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        buckets[_murmur(piece) % BUCKETS].append((piece, rank << 8))
        pieces[rank] = piece
    return spark.createDataFrame(pa.table({"m": pa.array([buckets], pa.list_(pa.map_(pa.binary(), pa.int32()))), "d": pa.array([pieces], pa.list_(pa.binary()))}))


def _murmur(data: bytes, seed: int = 42) -> int:
    """Spark's hash() of a binary value, as an unsigned number."""
    full = len(data) & ~3
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, full, 4)] + [(x - 256 if x > 127 else x) & _M for x in data[full:]]
    h = seed
    for k in blocks:
        k = k * 0xCC9E2D51 & _M
        k = ((k << 15 | k >> 17) & _M) * 0x1B873593 & _M
        h ^= k
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & _M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


_M = 0xFFFFFFFF


def encoded_words(rows: DataFrame, path: str) -> DataFrame:
    """`rows` with encoded, an array<struct<ids, piece>> for its column `words` of binary words: ids by folded merges, piece decoded from the ids.

    The state of the fold is s, a number rank * 256 + place for each token: where it begins, and the rank of the
    piece that it would make with the next one (NONE, if no such piece is known), between a null and the end of the
    word. The least of s is the pair of lowest rank, leftmost of equals; merging drops the second of the two and
    renews the ranks of the first and of the token before. Ids are null for words of over LONG_WORD bytes.
    """

    def rank(begin: str, end: str) -> str:
        piece = f"substring(w, {begin} + 1, {end} - {begin})"
        return f"try_element_at(get(m, hash({piece}) & {BUCKETS - 1}), {piece})"

    place = {i: f"(get(s, k + {i}) & 255)" for i in (-2, -1, 1, 2)}  # of the token before the pair, the pair's first, the next one, and the one after it
    renewed = [f"coalesce({rank(place[a], place[b])}, {NONE}) + {place[a]}" for a, b in ((-2, 1), (-1, 2))]
    merged = f"""
      element_at(transform(array(cast(array_position(s, array_min(s)) as int)), k ->
        concat(slice(s, 1, k - 2), array({renewed[0]}, {renewed[1]}), slice(s, k + 2, length(w)))), 1)"""
    begun = f"""
      concat(array(cast(null as int)),
        if(length(w) < 2, cast(array() as array<int>), transform(sequence(0, length(w) - 2), i -> coalesce({rank("i", "(i + 2)")}, {NONE}) + i)),
        if(length(w) < 1, cast(array() as array<int>), array({NONE} + length(w) - 1)), array({NONE} + length(w)))"""
    ids = f"""
      aggregate(if(length(w) < 2, cast(array() as array<int>), sequence(2, length(w))), {begun},
        (s, j) -> if(array_min(s) >= {NONE}, s, {merged}),
        s -> transform(slice(s, 2, size(s) - 2), (x, i) -> shiftright({rank("(x & 255)", "(get(s, i + 2) & 255)")}, 8)))"""
    encoded = f"""
      element_at(transform(array(own_m), m -> element_at(transform(array(own_d), d ->
        transform(words, w -> if(length(w) > {LONG_WORD}, null,
          element_at(transform(array({ids}), t ->
            named_struct('ids', t, 'piece', aggregate(t, cast('' as binary), (a, i) -> concat(a, get(d, i))))), 1)))), 1)), 1)"""
    held = "select *, (select m from {ranks}) as own_m, (select d from {ranks}) as own_d from {rows}"
    names = ", ".join(f"`{c}`" for c in rows.columns)
    return rows.sparkSession.sql(f"select {names}, {encoded} as encoded from ({held})", ranks=_rank_map(rows.sparkSession, path), rows=rows)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word with a heap and a linked list."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _list_parts(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row lengths and flat values of a list array; a null row has none."""
    if not len(column):
        return np.zeros(0, np.int64), column.values.slice(0, 0)
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.diff(offsets), column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _distinct_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the code of each word, and the distinct words, for a batch with a column text."""
    split = [split_pretokens(x.column("text")) for x in slices(part, "text", SPLIT_BYTES)]
    return np.concatenate([c for _, c in split]), *coded(pa.chunked_array([w for w, _ in split]))


def _counted(batches):
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            _, codes, distinct = _distinct_words(part)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], names=["word", "n"])


def _written(encoded: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many ids each encoded word has, and the ids in text, a space after each."""
    sizes, flat = _list_parts(encoded.field("ids"))
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return sizes, pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(ends, flat.cast(pa.string())), " "), "", " ").cast(pa.large_binary())


def _flat(batches):
    """A row for each word of rows of words and their encoded forms."""
    for batch in batches:
        encoded = batch.column("encoded").flatten()
        sizes, numbers = _written(encoded)
        yield pa.RecordBatch.from_arrays([batch.column("words").flatten(), numbers.cast(pa.binary()), encoded.field("piece"), pa.array(sizes, pa.int32())], names=["word", "numbers", "piece", "size"])


def frequent_words(texts: DataFrame, path: str) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """The most frequent words of all texts, their ids in text, what the ids decode to, and how many they are."""
    counts = texts.mapInArrow(tidy(_counted), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = checkpointed(counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") <= LONG_WORD)).withColumn("step", F.floor(8 * F.log2("n")).cast("int")))
    least, total = 1 << 30, 0
    for r in often.groupBy("step").count().orderBy(F.desc("step")).collect():  # 8 steps for each doubling of the count
        total += r["count"]
        if total > KNOWN:
            break
        least = r["step"]
    grouped = often.where(F.col("step") >= least).groupBy(F.pmod(F.hash("word"), F.lit(64)).alias("part")).agg(F.collect_list("word").alias("words"))
    found = encoded_words(grouped, path).mapInArrow(tidy(_flat), "word binary, numbers binary, piece binary, size int").toArrow()
    column = lambda name: found.column(name).cast(pa.large_binary()).combine_chunks()
    return column("word"), column("numbers"), column("piece"), found.column("size").to_numpy(zero_copy_only=False).astype(np.int64)


#: Codes go through the JVM as compressed bytes: it would copy them one by one, and hold several chunks' at once.
_CHUNK = pa.schema([("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.binary()))])


def _distinct(known):
    """Chunks of documents: codes of their words, first those of the known ones, and the distinct others."""

    def run(batches):
        words = known.value
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                counts, codes, distinct = _distinct_words(part)
                place = pc.index_in(distinct, value_set=words)
                new = place.is_null().to_numpy(zero_copy_only=False)
                number = np.where(new, len(words) - 1 + np.cumsum(new), place.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int32)
                others = distinct.filter(pa.array(new))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.array(counts, pa.int32())),
                    pa.array([pa.compress(number[codes].tobytes(), "zstd", asbytes=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others.cast(pa.binary())),
                ], schema=_CHUNK)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(parts: pa.Array, codes: np.ndarray, counts: np.ndarray, drop: int) -> list[str]:
    """SHA-256 of each document's parts, its last `drop` bytes left out; parts are put together JOIN_WORDS at a time."""
    ends = np.cumsum(counts)
    out, own, doc = [], hashlib.sha256(), 0
    for first in range(0, max(1, len(codes)), JOIN_WORDS):
        _, at, data = (x := parts.take(pa.array(codes[first : first + JOIN_WORDS]))).buffers()
        at = np.frombuffer(at, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
        data, begin = memoryview(data or b""), 0
        while doc < len(ends) and ends[doc] <= first + len(x):
            end = int(ends[doc]) - first
            if counts[doc]:
                own.update(data[int(at[begin]) : int(at[end]) - drop])
            out.append(own.hexdigest())
            own, begin, doc = hashlib.sha256(), end, doc + 1
        own.update(data[int(at[begin]) : int(at[len(x)])])
    return out


def _assembled(path: str, known):
    def run(batches):
        known_numbers, known_decoded, known_sizes = known.value
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name: batch.column(name).slice(row, 1)  # noqa: B023, E731
                keys = at("keys").flatten()
                counts = at("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                codes = np.frombuffer(pa.decompress(at("codes")[0].as_buffer(), int(counts.sum()) * 4, "zstd"), np.int32)
                encoded = at("encoded").flatten()
                sizes, numbers = _written(encoded)
                decoded = encoded.field("piece").cast(pa.large_binary())
                if encoded.null_count:
                    ranks = ranks_of(path)
                    pieces = pieces_of(path)
                    own = [merge_long(w, ranks) for w in at("words").flatten().filter(encoded.is_null()).to_pylist()]
                    sizes[np.flatnonzero(encoded.is_null().to_numpy(zero_copy_only=False))] = [len(x) for x in own]
                    numbers = pc.replace_with_mask(numbers, encoded.is_null(), pa.array(["".join(f"{i} " for i in x).encode() for x in own], pa.large_binary()))
                    decoded = pc.replace_with_mask(decoded, encoded.is_null(), pa.array([b"".join(pieces[i] for i in x) for x in own], pa.large_binary()))
                tokens = sums_by_row(np.concatenate([known_sizes, sizes])[codes], counts)
                a = _digests(pa.concat_arrays([known_numbers, numbers]), codes, counts, 1)
                b = _digests(pa.concat_arrays([known_decoded, decoded]), codes, counts, 0)
                yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(a), pa.array(b)], schema=_OUT)

    return run


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text by the ranks in `path`, decode the ids, and return a digest of both per document.

    Null and empty texts have no tokens and the digests of the empty string; repeated rows give repeated
    results; columns other than doc_id and text are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words, *answers = frequent_words(texts, path)
    send = docs.sparkSession.sparkContext.broadcast
    chunks = texts.mapInArrow(tidy(_distinct(send(words))), "keys array<bigint>, counts array<int>, codes binary, words array<binary>")
    return encoded_words(chunks, path).mapInArrow(tidy(_assembled(path, send(answers))), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


__all__ = ["bpe_round_trip", "encoded_words", "merge_long", "op9_bpe", "ranks_of"]
