"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features are hashed word unigrams and bigrams, of the words and of their shapes (runs of letters,
capitals, digits and each other sign collapsed), so that unseen words still tell.  A document's value
for a feature is its share of the document's n-grams of that kind, scaled; its score is a sparse dot
product.  Training sees about `max_train` labelled documents at most, picked by hash, whole texts; where
their features take more than `MAX_TRAIN_BYTES`, a part of them picked by hash again.  The weights
(2^BUCKET_BITS floats) have a fixed size and are broadcast.

Defined cases: null or empty text has no features and scores the bias alone; labels that are null are
not used; a document labelled twice is used once for each different label; with no usable label every score is
0.5; documents without a doc_id are scored but never trained on.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Scratch, crc_mod, id_in, mix, slices, word_hashes

BUCKET_BITS = 18
#: Expected labelled documents in the training sample, and passes over them.
MAX_TRAIN, EPOCHS = 8192, 3
#: Expected bytes of the sample's features on the driver; one document has 2^(BUCKET_BITS + 3) at most.
MAX_TRAIN_BYTES = 192 << 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
SCALE = 8.0

_CLASS = np.array([0x41 if 65 <= c <= 90 else 0x61 if 97 <= c <= 122 or c >= 128 else 0x30 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def features(column):
    """Flat feature indices, the text of each, and what one n-gram of a text counts, for an Arrow string column."""
    one, n, two = word_hashes(column, True, _CLASS)
    doc = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    b, shift = np.uint64(BASE), np.uint64(64 - BUCKET_BITS)
    idx = np.concatenate([mix(h * b + np.uint64(k)) >> shift for k, h in enumerate((one, two, one[:-1][pair] * b + one[1:][pair], two[:-1][pair] * b + two[1:][pair]))])
    own = np.concatenate([doc, doc, doc[pair], doc[pair]])
    return idx.astype(np.int32), own, SCALE / np.maximum(n, 1)


class Ftrl:
    """FTRL-proximal logistic regression on sparse rows."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        g = (1 / (1 + np.exp(-np.clip(w @ val, -35, 35))) - y) * val
        s = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / ALPHA
        self.z[idx] += g - s * w
        self.n[idx] += g * g


def _rows(batches):
    """Training documents -> label and distinct (feature, value), packed."""
    import pyarrow as pa

    for batch in batches:
        idx, own, unit = features(batch.column("text"))
        key = own.astype(np.int64) << 32 | idx
        key, count = np.unique(key, return_counts=True)
        own, idx = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        val = (count * unit[own]).astype(np.float32)
        ends = np.searchsorted(own, np.arange(batch.num_rows + 1))
        blobs = [struct.pack("<i", b - a) + idx[a:b].tobytes() + val[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(blobs, pa.binary())], names=["doc_id", "quality", "blob"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights and, last, the bias.  `labels`: doc_id, quality (0 or 1), training rows only."""
    labels = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    total = labels.count()
    share = min(1.0, max_train / max(total, 1))
    sample = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    docs = docs.select(id_in().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample's expected size is max_train rows of 12 bytes
    got = docs.join(F.broadcast(sample), "doc_id").mapInArrow(_rows, "doc_id long, quality int, blob binary")
    got = Scratch(docs.sparkSession).write(got, "sample")
    size = got.agg(F.sum(F.length("blob"))).first()[0] or 0
    kept = min(1.0, MAX_TRAIN_BYTES / max(size, 1))
    got = got.where(F.pmod(F.xxhash64("doc_id", "blob"), F.lit(1 << 20)) < int(kept * (1 << 20))).toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("quality").to_pylist(), got.column("blob").to_pylist(), strict=True))
    order = np.random.default_rng(7)
    model = Ftrl(1 << BUCKET_BITS)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            _, y, blob = rows[k]
            (m,) = struct.unpack_from("<i", blob)
            idx = np.append(np.frombuffer(blob, np.int32, m, 4), 1 << BUCKET_BITS)
            model.learn(idx, np.append(np.frombuffer(blob, np.float32, m, 4 + 4 * m), 1.0), y)
    return model.weights()


def score_all(column, w: np.ndarray) -> np.ndarray:
    """Scores of an Arrow string column, about a megabyte of text at a time."""
    out = [np.zeros(0)]
    for part in slices(column):
        idx, own, unit = features(part)
        total = np.bincount(own, w[idx], len(part)) * unit + w[-1]
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) per row; doc_id as id_in gives it."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = held.value.astype(np.float64)
        for batch in batches:
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score_all(batch.column("text"), w))], names=[*[n for n in batch.schema.names if n != "text"], "score"])

    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).select(*rest, "text").mapInArrow(run, f"{kinds}, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 4, held: int = 2) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    w = train(docs, labels.where(crc_mod(mod) != held))
    out = scores(docs.select("doc_id", "text", (crc_mod(mod) == held).alias("held_out")), w)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`docs`, all columns, without what the classifier rejects."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels).astype(np.float32))
    at = docs.columns.index("text")
    body = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches):
        w = held.value.astype(np.float64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                keep = pa.array(score_all(part.column("row").flatten()[at], w) >= threshold)
                yield part.filter(keep)

    return body.mapInArrow(run, body.schema).select("row.*")
