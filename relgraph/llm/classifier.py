"""Quality classifier (operator 4): a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover it to its last byte. Learned filters, WIDTH bytes wide,
slide over each chunk; each filter's largest response in a chunk is kept, the chunks of a document are
averaged, and a logistic unit makes one probability of them. The network is fitted on all chunks of a bounded
sample of labelled documents, the first TRAIN_DOCS in order of a hash, as far as TRAIN_BYTES of text go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices, table, text_buffers, tidy

CHUNK, OVERLAP = 256, 32
WIDTH, STEP, FILTERS = 8, 2, 24
#: The bounded sample of labelled rows that the network is fitted on, on their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, RATE, DECAY = 12, 0.01, 1e-5
THRESHOLD = 0.7
SLICE_BYTES = 4 << 20
HOLD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts, zero-filled, and how many each text has (an empty one has one, of zeros)."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP))).astype(np.int64)
    ends = np.cumsum(n)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(CHUNK, np.uint8)]), CHUNK)
    block = windows[np.repeat(offsets[:-1], n) + step * (CHUNK - OVERLAP)]
    last = ends - 1  # the only chunk of a text that goes past its end
    block[last] = np.where(np.arange(CHUNK) < (sizes - step[last] * (CHUNK - OVERLAP))[:, None], block[last], 0)
    return block, n


def responses(model: dict, block: np.ndarray) -> np.ndarray:
    """The filters' responses at every position of every chunk: (chunks, positions, filters)."""
    last = CHUNK - WIDTH + 1
    out = model["filters"][0][block[:, 0:last:STEP]]
    for w in range(1, WIDTH):
        out += model["filters"][w][block[:, w : last + w : STEP]]
    return out


def pooled(model: dict, block: np.ndarray, at_once: int = 256) -> np.ndarray:
    out = [np.maximum(responses(model, block[i : i + at_once]).max(axis=1) + model["bias"], 0) for i in range(0, len(block), at_once)]
    return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)


def peaks(model: dict, block: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter's largest response in each chunk is, and the response."""
    at, top = [], []
    for i in range(0, len(block), at_once):
        r = responses(model, block[i : i + at_once])
        at.append(r.argmax(axis=1))
        top.append(np.take_along_axis(r, at[-1][:, None, :], 1)[:, 0])
    return np.concatenate(at), np.concatenate(top)


def averages(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]) / np.maximum(n, 1)[:, None]


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    block, n = chunks(data, offsets)
    x = averages(pooled(model, block), n) @ model["out"].astype(np.float64) + model["prior"]
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(block: np.ndarray, n: np.ndarray, labels: np.ndarray) -> dict:
    """Gradient descent (Adam) on the logistic loss; a maximum passes its gradient to the position that it came from."""
    rng = np.random.default_rng(7)
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    model = {
        "filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, FILTERS).astype(np.float32), "prior": np.float32(np.log(share / (1 - share))),
    }
    if not len(labels) or labels.min() == labels.max():
        return model | {"out": np.zeros(FILTERS, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    first = np.cumsum(n) - n
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(n))
        for i in range(0, len(order), 64):
            docs = order[i : i + 64]
            own = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in docs])
            doc = np.repeat(np.arange(len(docs)), n[docs])
            at, top = peaks(model, block[own])
            top = top + model["bias"]
            live = top > 0
            act = np.where(live, top, 0)
            mean = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(mean, doc, act)
            mean /= n[docs][:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ model["out"] + model["prior"], -30, 30)))
            g = ((p - labels[docs]) / len(docs)).astype(np.float32)
            g_act = np.where(live, (g / n[docs])[doc][:, None] * model["out"], 0).astype(np.float32)
            filters = np.zeros_like(model["filters"])
            columns = np.broadcast_to(np.arange(FILTERS), at.shape)
            for w in range(WIDTH):
                byte = np.take_along_axis(block[own], at * STEP + w, 1).astype(np.int64)
                filters[w] = np.bincount((byte * FILTERS + columns).ravel(), g_act.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = {"filters": filters, "bias": g_act.sum(0), "out": mean.T @ g, "prior": np.float32(g.sum())}
            t += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, grad in grads.items():
                a, b = moments[k]
                a = 0.9 * a + 0.1 * grad
                b = 0.999 * b + 0.001 * grad * grad
                moments[k] = a, b
                model[k] = (model[k] - rate * a / (np.sqrt(b) + 1e-8) - DECAY * model[k]).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on labelled rows outside the held-out quarter.

    Labels that are null are no labels; of several for a doc_id the largest holds, and of several texts the least.
    """
    chosen = labels.where(f"quality is not null and doc_id is not null and not {HOLD_OUT}").selectExpr("cast(doc_id as bigint) as doc_id", "cast(quality as int) as quality")
    sample = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").join(F.broadcast(sample), "doc_id")  # at most TRAIN_DOCS rows
    rows = checkpointed(texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.coalesce(F.min("text"), F.lit("")).alias("text")).withColumn("order", F.xxhash64("doc_id")))
    sizes = rows.select("order", "doc_id", F.octet_length("text").alias("size")).orderBy("order", "doc_id").toPandas()
    if not len(sizes):
        return fit(np.zeros((0, CHUNK), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.float32))
    n = max(1, int((sizes["size"].cumsum() <= TRAIN_BYTES).sum()))
    end = sizes.iloc[n - 1]
    found = rows.where((F.col("order") < int(end["order"])) | ((F.col("order") == int(end["order"])) & (F.col("doc_id") <= int(end["doc_id"])))).toArrow().sort_by("doc_id")
    return fit(*chunks(*text_buffers(found.column("text"))), found.column("quality").to_numpy().astype(np.float32))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row; null and empty texts are scored as an empty chunk."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, *text_buffers(part.column("text"))))], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of THRESHOLD) for every row of `docs`.

    A null doc_id isn't held out; repeated rows get equal scores; columns other than doc_id and text are not
    read; without usable labels every score is the prior; an empty table gives an empty result.
    """
    return scored(docs, train(docs, labels)).selectExpr("doc_id", f"{HOLD_OUT} as held_out", "score", f"cast(score >= {THRESHOLD} as int) as predicted")


def keep_predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with all their columns; nulls and repeats as in `classify`."""
    model = train(docs, labels)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(scores(model, *text_buffers(part.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
