"""SimHash near-duplicates (operator 10) by the generalised pigeonhole principle.

Bits that go together over all fingerprints are put into the same partition, and each partition gets a
threshold of its own: if thresholds T_i (−1: not probed) have sum(T_i + 1) = 4, two fingerprints with 3 or
fewer differing bits differ by at most T_i in some partition i. A dynamic programme picks thresholds of
least estimated cost, from exact counts of pairs that agree on each partition; the number of partitions is
picked likewise, so that larger corpora get longer keys. Fingerprints are probed by the partition's bits
(T = 0) or by them with each choice of T bits masked, and what meets under a key is verified.

A key's fingerprints are searched breadth-first, which gives a spanning forest and never all pairs; a key
of more than BLOCK of them is dealt out by pairs of blocks, so that no task holds more than two blocks and
no link between different fingerprints is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices, split_words, table, tidy
from .components import connected_components

BITS, MOST_DIFFERING = 64, 3
#: Fingerprints of one key that a task holds at a time.
BLOCK = 4096
#: Text bytes that are hashed together.
CHUNK_BYTES = 1 << 20


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


@tidy
def _fingerprints(batches):
    """doc_id, the fingerprint, as a signed number, of the 3-word shingles of each text, and text_hash."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            words, counts, _ = split_words(part.column("text"), lower=True)
            sizes = np.diff(np.frombuffer(words.buffers()[1], np.int64)) if len(words) else np.zeros(0, np.int64)
            joined = b" ".join(words.to_pylist())
            start = np.concatenate([[0], np.cumsum(sizes + 1)])
            out = np.zeros(part.num_rows, np.uint64)
            first = 0
            for row, n in enumerate(counts.tolist()):
                if n:
                    a = start[first : first + max(1, n - 2)].tolist()
                    b = (start[first + min(n, 3) : first + n + 1] - 1).tolist()
                    out[row] = fingerprint(np.fromiter((digest(joined[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, len(a)))
                first += n
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64)), part.column("text_hash")], names=["doc_id", "fp", "text_hash"])


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


@tidy
def _gram(batches):
    """For each bit of this task's fingerprints: how many have it, together with each bit."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 1 << 15):
            x = _bits(fp[i : i + (1 << 15)]).astype(np.float32)
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["bit", "with"])


def correlated_groups(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of equal size (to one bit), each grown from a bit by its mean correlation with the group."""
    p = np.diag(gram) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(gram / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        want = BITS // parts + (i < BITS % parts)
        seed = max(left, key=lambda b: (round(corr[b, left].sum(), 9), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < want:
            best = max(left, key=lambda b: (round(corr[b, group].mean(), 9), -b))  # noqa: B023
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds T_i from −1 with sum(T_i + 1) = total of least cost; costs[i][T + 1] is that of threshold T in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(own):
                if used + t <= total and (used + t not in step or cost + c < step[used + t][0]):
                    step[used + t] = (cost + c, [*chosen, t - 1])
        best = step
    return best[total]


def _plan(distinct: DataFrame, n: int) -> list[list[int]]:
    """The masks to probe by: one list of bits for every key of a fingerprint."""
    rows = distinct.select("fp").mapInArrow(_gram, "bit int, with array<bigint>").groupBy("bit").agg(F.array(*[F.sum(F.col("with")[j]) for j in range(BITS)]).alias("with")).collect()
    gram = np.zeros((BITS, BITS))
    for r in rows:
        gram[r["bit"]] = r["with"]
    p = np.diag(gram) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)  # chance that two fingerprints agree on a bit
    plans = {parts: correlated_groups(gram, n, parts) for parts in (2, 3, 4)}
    masks = [_mask(g) for parts in plans for g in plans[parts]]
    keys = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    pairs = keys.groupBy("part", "key").count().groupBy("part").agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("double")).alias("pairs"))
    same = {r["part"]: r["pairs"] for r in pairs.collect()}
    best, part = None, 0
    for groups in plans.values():
        costs = []
        for g in groups:
            own, at = [0.0], same.get(part, 0.0)
            # a key is moved and sorted, which costs about as much as comparing 200 pairs
            for t in range(min(MOST_DIFFERING, 2) + 1):
                found = sum(at / np.prod(agree[list(c)]) for c in combinations(g, t)) if t < 2 else own[-1] * len(g)
                n_keys = [1, len(g), len(g) * (len(g) - 1) // 2][t]
                own.append(found + 200.0 * n_keys * n)
            costs.append(own)
            part += 1
        cost, chosen = allocate(costs, MOST_DIFFERING + 1)
        if best is None or cost < best[0]:
            best = cost, [[b for b in g if b not in c] for g, t in zip(groups, chosen, strict=True) if t >= 0 for c in combinations(g, t)]
    return best[1]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join exactly the fingerprints joined by chains of 3 or fewer differing bits; one less than they are at most."""
    out, left = [], fp.view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= MOST_DIFFERING
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                out.extend((int(np.int64(x)), int(y)) for y in found.view(np.int64))
    return out


@tidy
def _links(batches):
    """Links among the fingerprints of each group of rows; the rows come sorted by group."""
    group, held = None, []

    def found(keys: np.ndarray, fps: np.ndarray):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([first, [len(keys)]]))
        out = []
        for gap in range(1, 16):  # small groups: all of their pairs, at once
            at = first[(size > gap) & (size <= 16)]
            room = size[(size > gap) & (size <= 16)] - gap
            i = np.repeat(at - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum()) if len(at) else np.zeros(0, np.int64)
            near = np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + gap].view(np.uint64)) <= MOST_DIFFERING if len(i) else np.zeros(0, bool)
            out += list(zip(fps[i[near]].tolist(), fps[i[near] + gap].tolist(), strict=True))
        for i, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            out += forest(np.ascontiguousarray(fps[i : i + n]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("grp").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0  # the last group may go on
        if last:
            yield found(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield found(keys, fps)


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join what chains of 3 or fewer differing bits join, for a table of distinct `fp` without nulls; none for an empty one."""
    n = distinct.count()
    masks = _plan(distinct, n)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(m))) for m in masks])).alias("part", "key"))
    sizes = keys.groupBy("part", "key").count().where("count > 1")
    met = keys.join(sizes, ["part", "key"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = met.withColumn("mine", mine).select(
        "fp", "part", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grp = F.xxhash64("part", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = dealt.select("fp", grp.alias("grp"))
    return rows.repartition(F.col("grp")).sortWithinPartitions("grp").mapInArrow(_links, "a bigint, b bigint")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _groups(docs: DataFrame) -> DataFrame:
    """The rows of simhash_groups, with the hash of each row's text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    fps = checkpointed(texts.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, text_hash bigint"))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(near_links(distinct))
    own = checkpointed(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    least = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = own.join(least, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed), component_id (the smallest doc_id reachable) and root (the component's least fp), a row for each row of `docs`.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay; a null doc_id is
    never the smallest of a component unless all are null; other columns are ignored.
    """
    return _groups(docs).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their near-duplicate group (smallest doc_id; of repeated rows, one).

    Each group keeps one row, also if its doc_id is null or stands in other groups, too. Of different texts of a group
    that share its smallest doc_id, the one of least hash is kept.
    """
    firsts = _groups(docs).where("doc_id <=> component_id")
    first = firsts.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("root", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    names = [docs[c] for c in docs.columns]
    met = docs.join(first, docs["doc_id"].cast("bigint").eqNullSafe(first["first_id"]) & (_text_hash() == first["first_hash"]))
    return met.select(*names, F.col("root").alias("_root")).dropDuplicates(["_root"]).drop("_root")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
