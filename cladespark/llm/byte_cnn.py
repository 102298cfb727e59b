"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of CHUNK bytes that overlap by OVERLAP and cover
all of it. Bytes are embedded, FILTERS learned filters of WIDTH bytes slide by
STEP over them, and each filter is max-pooled over each chunk. A document is
the mean and the maximum of its chunks' pooled values; a logistic unit makes
them one probability.

The network is trained on the driver on a bounded sample of labelled rows
(SAMPLE_ROWS, half of them for each label as far as there are, and
SAMPLE_BYTES); every document is scored whole. Training and scoring are
seeded. A null or empty text is one chunk of zero bytes. Without labels of
both kinds every score is the share of label 1 among those there are, 0.5
without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm import staging, words

CHUNK, OVERLAP, WIDTH, STEP = 512, 64, 8, 4
DIM, FILTERS = 8, 16
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
_HOP = CHUNK - OVERLAP
_PER_CHUNK = (CHUNK - WIDTH) // STEP + 1


def layout(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded bytes, first byte of each chunk, first chunk of each document."""
    sizes = np.diff(bounds)
    chunks = np.maximum(1, -(-np.maximum(sizes - OVERLAP, 0) // _HOP))
    room = chunks * _HOP + OVERLAP
    at = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(int(at[-1]), np.uint8)
    if len(buf):
        out[np.arange(len(buf)) + np.repeat(at[:-1] - bounds[:-1], sizes)] = buf
    first = np.concatenate([[0], np.cumsum(chunks)])
    start = np.repeat(at[:-1] - first[:-1] * _HOP, chunks) + np.arange(first[-1]) * _HOP
    return out, start, first


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: np.ndarray

    @classmethod
    def random(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return cls(draw(256, DIM, scale=0.5), draw(WIDTH * DIM, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def maps(self, data: np.ndarray) -> np.ndarray:
        """Filter values at every STEP-th byte; two halves of a filter, as it is two steps wide."""
        rows = self.embed[data].reshape(-1, STEP * DIM)
        half = STEP * DIM
        return rows[:-1] @ self.filters[:half] + rows[1:] @ self.filters[half:] + self.bias

    def documents(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        sizes = np.diff(first)[:, None]
        return np.concatenate([np.add.reduceat(pooled, first[:-1]) / sizes, np.maximum.reduceat(pooled, first[:-1])], 1)

    def scores(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        data, start, first = layout(buf, bounds)
        pairs = np.stack([start // STEP, start // STEP + _PER_CHUNK], 1).ravel()
        maps = self.maps(data)
        pooled = np.maximum.reduceat(np.vstack([maps, maps[-1:]]), pairs)[::2]
        logits = self.documents(np.maximum(pooled, 0), first) @ self.head + self.offset
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Logistic loss, Adam; gradients pass through the argmax of each filter and chunk."""
    net, rng = Network.random(seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "head", "offset")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step, coded = 0, [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    reach = np.arange(_PER_CHUNK)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            bounds = np.concatenate([[0], np.cumsum([len(coded[i]) for i in rows])])
            data, start, first = layout(np.concatenate([coded[i] for i in rows]), bounds)
            maps = net.maps(data)
            pooled, best = np.empty((len(start), FILTERS), np.float32), np.empty((len(start), FILTERS), np.int64)
            for k in range(0, len(start), 512):
                window = maps[(start[k : k + 512] // STEP)[:, None] + reach]
                best[k : k + 512] = window.argmax(1)
                pooled[k : k + 512] = window.max(1)
            active = np.maximum(pooled, 0)
            feats = net.documents(active, first)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.head + net.offset, -30, 30)))
            error = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = {"head": feats.T @ error + DECAY * net.head, "offset": np.array([error.sum()], np.float32)}
            back = error[:, None] * net.head
            owner = np.repeat(np.arange(len(rows)), np.diff(first))
            d_pool = back[owner, :FILTERS] / np.diff(first)[owner][:, None]
            top = active == np.maximum.reduceat(active, first[:-1])[owner]
            ties = np.add.reduceat(top.astype(np.float32), first[:-1])[owner]
            d_pool = (d_pool + top * back[owner, FILTERS:] / ties) * (pooled > 0)
            place = start[:, None] + best * STEP
            g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for k in range(WIDTH):
                byte = data[place + k]  # chunks x filters
                part = slice(k * DIM, (k + 1) * DIM)
                g_filters[part] = np.einsum("cfd,cf->df", net.embed[byte], d_pool)
                np.add.at(g_embed, byte.ravel(), (d_pool[:, :, None] * net.filters[part].T[None]).reshape(-1, DIM))
            grads |= {"filters": g_filters + DECAY * net.filters, "embed": g_embed, "bias": d_pool.sum(0)}
            step += 1
            for name in names:
                m, v = moments[name]
                m += 0.1 * (grads[name] - m)
                v += 0.001 * (grads[name] ** 2 - v)
                getattr(net, name)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from: ids by hash, half for each label, until `rows` rows or `limit` bytes are reached.

    A text with more than a 16th of `limit` is left out, so that a long one does not end the sample.
    Of rows with one id the text that sorts first counts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    halves = [usable.filter(F.col("y") == y).orderBy("h", "doc_id").limit(rows // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    found = found.filter(F.octet_length("text") * 16 <= limit)
    # Rows with one id are one; the rows of the window are as many as ids were chosen.
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h"))
    # What reaches the driver is bounded too: rows are added in order of their hash while their bytes fit.
    size = F.sum(F.octet_length("text")).over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("size", size).filter(F.col("size") <= limit).orderBy("h", "doc_id").select("text", "y").toPandas()
    return got.text.tolist(), got.y.to_numpy(np.float32)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if isinstance(model, Network):
                for row, end, buf, bounds in words.slices(batch.column(1)):
                    out[row:end] = model.scores(buf, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    staging.small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"doc_id {dict(source.dtypes)['doc_id']}, score double")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network | float:
    texts, y = sample(spark, docs, labels)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train(texts, y)


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.documents(spark, sf_dir)
    scored = score(docs, fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
