"""Language-model scores by stupid backoff (Brants et al., 2007), computed with joins.

A document's score is the mean, over its words, of log S:

    S(b | a) = c(a b) / c(a)            if the bigram's count is MIN_COUNT or more
             = BACKOFF * c(b) / N       else; for a document's first word c(b) / N

Counts are over all documents and all words. Words with at least one in
HELD_WORDS of all occurrences, HELD_WORDS at most however large the corpus is,
are held by every task: they become numbers, so a bigram of two of them is one
long. All other words stay 63-bit hashes; they and their bigrams are counted
and looked up in shuffled tables only. No word is folded into another unless
`max_words` asks for it.

Bigram rows (document, bigram, times) are dealt out by the bigram's hash, once:
the count table is grouped from them and joined to them where they lie. Words
with at least one in SHARE of all occurrences are SHARE at most, so the counts of
bigrams of two of them are bounded: tasks add them up and hold them, and none of
their rows is dealt. Any other bigram has fewer rows than one in SHARE of all words. Every
occurrence of another word is one row that names its neighbours; such a word has
fewer rows than one in HELD_WORDS of all words.

Rows with one doc_id are scored as one document, a null among the ids. Texts
that are null or without words have n_words 0 and score 0. Equal texts have
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import ngram_join, staging, words

BACKOFF, MIN_COUNT = 0.4, 2
HELD_WORDS = 1_000_000
SHARE = 1000
_BITS = 20
#: Set in every hash of a word: as longs they are negative, numbers of held words are not.
_SIGN = np.uint64(1 << 63)
#: Different words that a task holds before it passes their counts on.
_HELD = 1 << 20


@dataclass
class Vocabulary:
    """Hashes in order, their numbers from 1, the count of each number (0: all other words) and of all words.

    `folded`: all other words are one unknown word.
    """

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    folded: bool

    @cached_property
    def _starts(self) -> tuple[np.uint64, np.ndarray]:
        """How far a hash is shifted to its bucket, of which there are about as many as hashes, and where each bucket starts."""
        bits = max(1, len(self.hashes).bit_length())
        shift = np.uint64(63 - bits)
        edges = (np.arange(1 << bits, dtype=np.uint64) << shift) | _SIGN
        return shift, np.append(np.searchsorted(self.hashes, edges), len(self.hashes))

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashed), np.int64)
        shift, starts = self._starts
        bucket = ((hashed ^ _SIGN) >> shift).astype(np.int64)
        out, live, at, end = np.zeros(len(hashed), np.int64), np.arange(len(hashed)), starts[bucket], starts[bucket + 1]
        while True:
            inside = at < end
            live, at, end = live[inside], at[inside], end[inside]
            if not len(live):
                return out
            same = self.hashes[at] == hashed[live]
            out[live[same]] = at[same] + 1
            live, at, end = live[~same], at[~same] + 1, end[~same]

    def frequent(self) -> np.ndarray:
        """Which numbers are of words with one in SHARE of all occurrences or more."""
        out = self.counts * SHARE >= max(self.total, 1)
        out[0] &= self.folded
        return out


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return words.span_hashes(buf, start, end) | _SIGN


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word's hash in docs(text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        batch_of = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["word", "n"])
        for batch in batches:
            for _, _, buf, bounds in words.slices(batch.column(0)):
                start, end, _ = words.word_spans(buf, bounds)
                parts.append(np.unique(_hashes(buf, start, end), return_counts=True))
                held += len(parts[-1][0])
                if held > 2 * _HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > _HELD:
                        yield batch_of(*parts[0])
                        parts, held = [], 0
        if parts:
            yield batch_of(*merged(parts))

    return docs.select(F.col("text").cast("string")).mapInArrow(each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, limit: int, folded: bool) -> Vocabulary:
    """Of counted(word, n)."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter(F.col("n") * limit >= F.lit(total)).toPandas()  # `limit` rows at most
    hashes = frequent.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counts = frequent.n.to_numpy(np.int64)[order]
    return Vocabulary(hashes[order], np.concatenate([[total - int(counts.sum())], counts]), int(total), folded)


def _numbered(column: pa.Array, vocab: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    for row, end, buf, bounds in words.slices(column):
        start, stop, doc = words.word_spans(buf, bounds)
        hashed = _hashes(buf, start, stop)
        yield row, vocab.numbers(hashed), hashed.view(np.int64), doc, end - row


def frequent_bigrams(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of two frequent words, in order, and their counts: SHARE * SHARE at most."""
    frequent = vocab.frequent()
    if not frequent.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.flatnonzero(frequent)
    # Numbers follow the order of the hashes, so those of a smaller vocabulary do as well.
    few = Vocabulary(vocab.hashes[chosen[chosen > 0] - 1], np.zeros(1 + int((chosen > 0).sum()), np.int64), vocab.total, False)
    number_of = np.concatenate([[0], chosen[chosen > 0]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(number_of) ** 2, np.int64)
        for batch in batches:
            for _, number, _, doc, _ in _numbered(batch.column(0), few if frequent[0] == 0 else vocab):
                if frequent[0]:
                    number = np.where(frequent[number], np.searchsorted(number_of, number), -1)
                else:
                    number = np.where(number > 0, number, -1)
                same = (doc[1:] == doc[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
                at, times = np.unique(number[:-1][same] * len(number_of) + number[1:][same], return_counts=True)
                cells[at] += times
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(number_of[at // len(number_of)] << _BITS | number_of[at % len(number_of)]), pa.array(cells[at])], ["gram", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    order = np.argsort(counted.gram.to_numpy(np.int64))
    return counted.gram.to_numpy(np.int64)[order], counted.n.to_numpy(np.int64)[order]


def bigrams(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, gram, times): each document's bigrams of numbered words, not both frequent, once each."""
    frequent = vocab.frequent()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, _, doc, n in _numbered(batch.column(1), vocab):
                held, often = vocab.folded | (number > 0), frequent[number]
                same = np.flatnonzero((doc[1:] == doc[:-1]) & held[1:] & held[:-1] & ~(often[1:] & often[:-1]))
                gram = number[same] << _BITS | number[same + 1]
                # Documents of a slice are few enough for one key of document and bigram.
                for low in range(0, n, 1 << 22):
                    part = (doc[same] >= low) & (doc[same] < low + (1 << 22))
                    keys, times = np.unique((doc[same][part] - low) << 2 * _BITS | gram[part], return_counts=True)
                    owner = row + low + (keys >> 2 * _BITS)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys & ((1 << 2 * _BITS) - 1)), pa.array(times.astype(np.int32))], ["doc_id", "gram", "times"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"doc_id {dict(source.dtypes)['doc_id']}, gram long, times int")


def rare_rows(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, doc_id, held, other) of each occurrence of a word that is not held.

    `held` has the number of the word before it and of the one after it, 0 where
    there is none or it is not held; `other` is the word before it if that is not held.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, hashed, doc, _ in _numbered(batch.column(1), vocab):
                at = np.flatnonzero(number == 0)
                if not len(at):
                    continue
                before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(number) - 1)
                follows, leads = (at > 0) & (doc[before] == doc[at]), (after > at) & (doc[after] == doc[at])
                held = np.where(follows, number[before], 0) << _BITS | np.where(leads, number[after], 0)
                other = pa.array(hashed[before], mask=~(follows & (number[before] == 0)))
                yield pa.RecordBatch.from_arrays([pa.array(hashed[at]), batch.column(0).take(pa.array(row + doc[at])), pa.array(held), other], ["word", "doc_id", "held", "other"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"word long, doc_id {dict(source.dtypes)['doc_id']}, held long, other long")


def _times(*keys: np.ndarray) -> np.ndarray:
    """Of each row, how many rows have its keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(at)[at]
    return out


def rare_gains(docs: DataFrame, vocab: Vocabulary, counted: DataFrame, backoff: float, min_count: int) -> DataFrame:
    """(doc_id, n, x): of the words that are not held, log c(b) / N; of bigrams with such a word, their number and gains over backing off.

    All rows of a word lie together, so its count and those of its bigrams are
    known there. Only the count of a word before it that is not held either is
    joined, to the bigrams in the table.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rare_rows(docs, vocab).repartition(parts, "word").sortWithinPartitions("word")
    log_counts, log_total = np.log(np.maximum(vocab.counts, 1)), float(np.log(max(vocab.total, 1)))
    gain_of_pair = log_total - float(np.log(backoff))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ngram_join._groups(batches, 1):
            word, held = table.column(0).to_numpy(), table.column(2).to_numpy()
            other = table.column(3).fill_null(0).to_numpy()
            log_word = np.log(_times(word))
            x, n, ahead = log_word - log_total, np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            for number in (held >> _BITS, held & ((1 << _BITS) - 1)):
                sides = np.flatnonzero(number > 0)
                times = _times(number[sides], word[sides])
                sides, times = sides[times >= min_count], times[times >= min_count]
                x[sides] += np.log(times) - log_counts[number[sides]] - log_word[sides] + gain_of_pair
                n[sides] += 1
            sides = np.flatnonzero(other)
            times = _times(other[sides], word[sides])
            sides, times = sides[times >= min_count], times[times >= min_count]
            x[sides] += np.log(times) - log_word[sides] + gain_of_pair
            n[sides] += 1
            ahead[sides] = other[sides]
            yield pa.RecordBatch.from_arrays([table.column(1).combine_chunks(), pa.array(n), pa.array(x), pa.array(ahead, mask=ahead == 0)], ["doc_id", "n", "x", "ahead"])

    source = dealt.mapInArrow(gains, f"doc_id {dict(dealt.dtypes)['doc_id']}, n long, x double, ahead long")
    parted = staging.stage(source.groupBy("doc_id", "ahead").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("times")), "lm-rare")
    logs = counted.select(F.col("word").alias("ahead"), F.log("n").alias("log_n"))
    return parted.select("doc_id", "n", "x").unionByName(parted.filter("ahead is not null").join(logs, "ahead").select("doc_id", F.lit(0).cast("long").alias("n"), (-F.col("times") * F.col("log_n")).alias("x")))


def backed_off(docs: DataFrame, vocab: Vocabulary, held: tuple[np.ndarray, np.ndarray], backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, n_seen, base): the log score of each document if every word backed off but those after a frequent word in a bigram that tasks hold.

    `held`: those bigrams in order, and their gains over backing off. Words without a number add nothing yet.
    """
    unigram = np.log(np.maximum(vocab.counts, 1)) - np.log(max(vocab.total, 1))
    if not vocab.folded:
        unigram[0] = 0
    frequent, (grams, gain) = vocab.frequent(), held

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_seen, base = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, number, _, doc, n in _numbered(batch.column(1), vocab):
                n_words[row : row + n] = size = np.bincount(doc, minlength=n)
                base[row : row + n] = np.bincount(doc, weights=unigram[number], minlength=n) + np.log(backoff) * np.maximum(size - 1, 0)
                if len(grams):
                    often = frequent[number]
                    same = np.flatnonzero((doc[1:] == doc[:-1]) & often[1:] & often[:-1])
                    gram = number[same] << _BITS | number[same + 1]
                    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    same, at = same[grams[at] == gram], at[grams[at] == gram]
                    n_seen[row : row + n] = np.bincount(doc[same], minlength=n)
                    base[row : row + n] += np.bincount(doc[same], weights=gain[at], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_seen), pa.array(base)], ["doc_id", "n_words", "n_seen", "base"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, n_seen long, base double")


def stupid_backoff(docs: DataFrame, backoff: float = BACKOFF, min_count: int = MIN_COUNT, max_words: int | None = None, held: int = HELD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score): n_seen of the words follow a bigram in the table; log_score is the sum of log S.

    Without max_words every word counts for itself, and `held` only says how many
    of them the tasks hold; with it, words below one in max_words are one unknown word.
    """
    limit = held if max_words is None else max_words
    if limit >= 1 << _BITS:
        raise ValueError(f"at most {(1 << _BITS) - 1} words")
    spark = docs.sparkSession
    staging.small_batches(spark)
    words_counted = staging.stage(word_counts(docs), "lm-words")
    vocab = vocabulary(words_counted, limit, max_words is not None)
    log_counts = np.log(np.maximum(vocab.counts, 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The filter that the join implies, and a count that needs doc_id, make both uses of these rows equal: they are dealt out once.
    dealt = bigrams(docs, vocab).filter("gram is not null").repartition(parts, "gram")
    counted = dealt.groupBy("gram").agg(F.sum("times").alias("n"), F.count("doc_id").alias("n_docs")).filter(F.col("n") >= min_count)
    gain_of_pair = float(np.log(max(vocab.total, 1)) - np.log(backoff))

    def gain(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log(n) - log_counts[gram >> _BITS] - log_counts[gram & ((1 << _BITS) - 1)] + gain_of_pair

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["g", "gain"])

    often, times = frequent_bigrams(docs, vocab)
    often, times = often[times >= min_count], times[times >= min_count]

    table = counted.mapInArrow(gains, "g long, gain double").repartition(parts, "g")
    seen = dealt.join(table, F.col("gram") == F.col("g")).groupBy("doc_id").agg(F.sum(F.col("times") * F.col("gain")).alias("x"), F.sum("times").alias("n"))
    zero = F.lit(0)
    if not vocab.folded and vocab.counts[0]:
        seen = seen.select("doc_id", "n", "x").unionByName(rare_gains(docs, vocab, words_counted, backoff, min_count))
    both = seen.select("doc_id", zero.cast("long").alias("n_words"), F.col("n").cast("long").alias("n_seen"), "x").unionByName(backed_off(docs, vocab, (often, gain(often, times)), backoff).withColumnRenamed("base", "x"))
    return both.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.sum("x").alias("log_score"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stupid_backoff(staging.documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", "n_seen", F.round(mean, 4).alias("score"))
