"""Document quality rules: counts of whole texts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted, one over trusted
documents and one over the whole corpus. A document scores the mean, over its
n-grams, of log(trusted / corpus); the mean makes long and short texts
comparable, and every document is kept or not by one fixed threshold.

The trusted multinomial is smoothed towards the corpus by `prior` n-grams, so
an n-gram that is rare in both counts for nothing and none is worth less than
log(prior / (trusted + prior)). The prior has a fixed part: where little is
trusted, ratios stay near 0 and documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import ngram_join, staging, words

#: Buckets of the multinomials: what is broadcast is this many floats, whatever the input.
BUCKETS = 1 << 16
#: Bytes of an n-gram.
ORDER = 3
#: Documents below this mean log ratio are rejected. With labels of even ids trusted, the lowest good document
#: of odd ids was at -0.49, -0.36 and -0.22, the highest junk at -0.10, -0.28 and -0.73 on 57 to 5000 labels.
THRESHOLD = -0.5
#: The corpus counts as this many n-grams of the trusted multinomial, and as so many for each 1000 of its own.
PRIOR, PRIOR_PER_1000 = 100_000, 1
#: Up to this many trusted ids are broadcast (8 bytes each) and marked in one pass; more are joined by a shuffle. The counts are the same.
BROADCAST_TRUSTED = 500_000
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def bucket_ids(buf: np.ndarray, bounds: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram that lies in one document, and the bounds of the documents among them."""
    lengths = np.maximum(np.diff(bounds) - order + 1, 0)
    outer = np.concatenate([[0], np.cumsum(lengths)])
    if not outer[-1]:
        return np.zeros(0, np.uint32), outer
    value = np.zeros(len(buf) - order + 1, np.uint32)
    for k in range(order):
        value = (value << np.uint32(8)) | buf[k : len(buf) - order + 1 + k]
    value = (value * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)
    good = np.ones(len(value), bool)
    for k in range(order - 1):
        cut = bounds[1:-1] - 1 - k
        good[cut[(cut >= 0) & (cut < len(value))]] = False
    for d in np.flatnonzero(np.diff(bounds) < order):
        good[bounds[d] : min(bounds[d + 1], len(value))] = False
    return value[good], outer


def counts(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(bounds) - 1
    start, end, doc = words.word_spans(buf, bounds)
    out = {"n_words": np.bincount(doc, minlength=n)}
    if not len(start):
        return {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    heads = ((buf & 0xC0) != 0x80) & ~words.SPACE[buf]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[bounds])
    out["word_chars"], out["n_symbols"] = total(heads), total(SYMBOLS[buf])
    hashed = words.span_hashes(buf, start, end)
    tri, at = words.grams(hashed, doc, 3)
    again = np.zeros(len(start), bool)
    if len(tri):
        key = words.mix(tri + words.mix(doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(tri), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(3):
            again[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(doc, weights=again, minlength=n).astype(np.int64)
    breaks = np.union1d(np.flatnonzero(buf == 10) + 1, bounds[:-1])
    breaks = breaks[breaks < len(buf)]
    ends = np.append(breaks[1:], len(buf))
    ends = ends - (buf[ends - 1] == 10)
    solid = np.searchsorted(start, breaks) < np.searchsorted(start, ends)
    breaks, ends = breaks[solid], ends[solid]
    owner = np.searchsorted(bounds, breaks, "right") - 1
    line = words.mix(words.span_hashes(buf, breaks, ends) + words.mix(owner.astype(np.uint64)))
    _, firsts = np.unique(line, return_index=True)
    repeat = np.ones(len(line), bool)
    repeat[firsts] = False
    out["n_dup_lines"] = np.bincount(owner, weights=repeat, minlength=n).astype(np.int64)
    return out


def multinomials(marked: DataFrame, text: str, trusted: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all rows and over the rows that `trusted` marks; two arrays of BUCKETS."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for row, end, buf, bounds in words.slices(batch.column(0)):
                ids, outer = bucket_ids(buf, bounds)
                every += np.bincount(ids, minlength=BUCKETS)
                mask = np.repeat(flags[row:end], np.diff(outer))
                if mask.any():
                    good += np.bincount(ids[mask], minlength=BUCKETS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(good[at])], ["bucket", "every", "good"])

    parts = marked.select(F.col(text).cast("string").alias("t"), F.col(trusted).cast("boolean").alias("g")).mapInArrow(each, "bucket long, every long, good long")
    table = parts.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).toPandas()  # BUCKETS rows at most
    every, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    every[table.bucket.to_numpy(int)], good[table.bucket.to_numpy(int)] = table.every, table.good
    return every, good


def log_ratios(every: np.ndarray, good: np.ndarray, per_1000: float = PRIOR_PER_1000) -> np.ndarray:
    """log(trusted / corpus) by bucket; zeros if there is nothing trusted."""
    if not good.sum() or not every.sum():
        return np.zeros(len(every), np.float32)
    raw = every / every.sum()
    prior = PRIOR + good.sum() * per_1000 / 1000
    smooth = (good + prior * raw) / (good.sum() + prior)
    return np.where(every > 0, np.log(np.maximum(smooth, 1e-300) / np.maximum(raw, 1e-300)), 0).astype(np.float32)


def judge(docs: DataFrame, id_column: str, text_column: str, weights: np.ndarray, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Counts, ratio and verdict of every document; `carry` names columns to keep as they are."""
    weights = np.asarray(weights, np.float32)
    carry = carry or []
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            got, ratio = {k: np.zeros(n, np.int64) for k in fields}, np.zeros(n)
            for row, end, buf, bounds in words.slices(batch.column(1)):
                for k, v in counts(buf, bounds).items():
                    got[k][row:end] = v
                ids, outer = bucket_ids(buf, bounds)
                sums = np.concatenate([[0], np.cumsum(weights[ids], dtype=np.float64)])[outer]
                ratio[row:end] = np.diff(sums) / np.maximum(np.diff(outer), 1)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED_PERCENT * got["n_words"])
            kept = ~failed & (ratio >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(got[k]) for k in fields), pa.array(ratio), pa.array(failed), pa.array(kept)], names)

    source = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    names = ["doc_id", *[f"__c{i}" for i in range(len(carry))], *fields, "ratio", "base_failed", "kept"]
    kinds = dict(source.dtypes)
    schema = ", ".join([f"doc_id {kinds['__id']}", *[f"__c{i} {kinds[f'__c{i}']}" for i in range(len(carry))], *[f"{k} long" for k in fields], "ratio double, base_failed boolean, kept boolean"])
    return source.mapInArrow(each, schema)


def _id_key() -> Column:
    """Of ids of any type; equal for equal ids of different types."""
    return F.xxhash64(F.col("doc_id").cast("string"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that the labels call good and not toxic, once each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("x")).filter("q = 1 and x = 0").select("doc_id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict of every row of docs(doc_id, text).

    A null or empty text has no words and fails the base rules. Repeated rows
    and equal texts get equal verdicts. Without rows or trusted labels the
    ratios are 0 and the base rules decide alone.
    """
    staging.small_batches(spark)
    known = staging.stage(trusted_ids(spark, sf_dir).select(_id_key().alias("key")), "trusted")
    texts = docs.filter("doc_id is not null").select(_id_key().alias("key"), F.col("text").cast("string").alias("text"))
    if known.count() <= BROADCAST_TRUSTED:
        marked = docs.select(_id_key().alias("key"), F.col("doc_id").isNotNull().alias("__id"), F.col("text").cast("string").alias("text"))
        marked = marked.join(F.broadcast(known.withColumn("__known", F.lit(True))), "key", "left")
        every, good = multinomials(marked.select("text", (F.col("__id") & F.col("__known")).alias("__good")), "text", "__good")
    else:
        # Ids of any number are shuffled with the texts that a bounded bit table lets through, not with all texts.
        trusted = ngram_join._sifted(texts, known).join(known, "key", "left_semi")
        every, _ = multinomials(docs.select("text", F.lit(False).alias("__good")), "text", "__good")
        _, good = multinomials(trusted.select("text", F.lit(True).alias("__good")), "text", "__good")
    return judge(docs, "doc_id", "text", log_ratios(every, good), threshold, carry)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark, staging.documents(spark, sf_dir), sf_dir)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))
