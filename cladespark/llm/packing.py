"""Packing by concatenate and cut.

All documents form one stream of tokens, cut every `window` tokens. Two passes
of prefix sums give each document its place: tokenising counts what lies before
a row in its partition, and running totals over the partitions give what lies
before the partition. Token ids are computed once, in a staged table; each piece of
a document inside a window is one boundary record.

A null or empty text is its closing id alone. The order of the stream is that
of the input's partitions and rows. Repeated rows are packed as often as they
come. Only the last sequence is not full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm import staging

WINDOW, CLOSING = 2048, 1
#: Words in each of the two generations of a Python worker's store: when the young one is full it becomes the old
#: one, and words that are met again move over, so frequent words stay.
KEPT_WORDS = 90_000
#: Up to this many partitions, their first offsets are broadcast.
BROADCAST_PARTITIONS = 500_000
#: Texts of these characters alone are cut into words here: for them lower case, NFC and the classes of
#: characters are the same in Python and in the tokenizer. Other texts go through the tokenizer whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿŒœ‘’“”–—…]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordEncoder:
    """Ids of texts under a byte-level BPE tokenizer with word ends, little-endian 32-bit, with a store of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = [x["content"] for x in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.coded = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else "" for b in range(256)]
        self.letters = [x or chr(next(shifted)) for x in self.letters]

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        coded = self.coded
        return b"".join([coded[t.id] for t in self.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        """Ids of a word that the young generation lacks; a run of letters is one piece."""
        found = self.old.get(word)
        if found is None:
            if word.isalpha() or len(parts := _PIECE.findall(word)) == 1:
                found = self._piece(word)
            else:
                get, other = self.young.get, self._word
                found = b"".join([get(x) or other(x) for x in parts])
        self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            if len(self.young) > KEPT_WORDS:
                self.old, self.young = self.young, {}
            get, word = self.young.get, self._word
            return b"".join([get(w) or word(w) for w in text.lower().split()])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process; a worker that runs many tasks loads it once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """(doc_id, ids, n, part, before) of docs(doc_id, text): ids in 4 bytes each, tokens before the row in its partition."""
    last = int(closing).to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encode(x or "") + last for x in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)], ["doc_id", "ids", "n", "part", "before"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"doc_id {dict(source.dtypes)['doc_id']}, ids binary, n long, part int, before long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """Boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids."""
    staging.small_batches(docs.sparkSession)
    rows = staging.stage(tokenized(docs, path, closing), "tokens")
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    if first.count() <= BROADCAST_PARTITIONS:
        first = F.broadcast(first)
    size = F.lit(window).cast("long")
    placed = rows.join(first, "part").withColumn("s", F.col("base") + F.col("before")).withColumn("e", F.col("s") + F.col("n"))

    def piece(w):
        begin, end = F.greatest(F.col("s"), w * size), F.least(F.col("e"), (w + 1) * size)
        ids = F.substring(F.col("ids"), ((begin - F.col("s")) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        return F.struct((begin - F.col("s")).alias("start"), (end - begin).alias("length"), F.crc32(ids).alias("ids_crc32"), w.alias("sequence_id"), (begin - w * size).alias("offset"), ids.alias("ids"))

    windows = F.sequence(F.floor(F.col("s") / size).cast("long"), F.floor((F.col("e") - 1) / size).cast("long"))
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.transform(windows, piece)))
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the pieces of each sequence joined; at most `window` tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(staging.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
