"""Personal data: base expressions, and identifiers found by bootstrapped contexts.

Base kinds are e-mail addresses, IP addresses, payment cards and phone numbers.
They are the seeds of a bootstrap (as of Riloff and Jones, 1999):

1. the one or two words before a token in which a seed begins induce a pattern;
2. patterns seen before MIN_SEEDS different seeds are counted over the whole
   corpus: how often they occur at all, and before which identifier-like tokens;
3. Spark scores the graph of patterns and instances: seeds count 1; a pattern
   is worth the share of its occurrences that lead to an instance, weighed by
   the instance's worth; an instance is worth 1 - product of (1 - pattern)
   over its patterns; this is repeated ROUNDS times;
4. patterns worth CONFIDENT or more extract the identifier-like tokens that
   follow them, of kind "found".

A pattern that precedes ordinary words is worth little, so common words never
extract anything. An identifier-like token has 6 to 40 letters, digits or
./_- and 4 digits or more, is no base span, and is taken without the
punctuation around it.

Tasks hold about BLOCK patterns at once; of more, each block is one more pass
over the texts. Scores stay in staged tables. A null text is empty; equal texts have equal spans; without seeds
only base spans are returned. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import staging, words

KINDS = ("email", "ip", "card", "phone", "found")
BASE = KINDS[:4]
MIN_SEEDS, ROUNDS, CONFIDENT = 5, 4, 0.8
BLOCK = 2_000_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the first digit of a run only, as no other one of it can do better: a long run is looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LIKE = re.compile(r"[A-Za-z0-9][A-Za-z0-9./_-]{4,38}[A-Za-z0-9]")
_EDGE = "\"'()[]{}<>,;:.!?|*#$%&"
_LUHN = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]]
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    return sum(_LUHN[i & 1][int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left over the local part, to the right over the domain: the leftmost matches, without a scan of every word."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def like_identifier(token: str) -> tuple[int, int] | None:
    """Where the identifier-like part of a token lies."""
    core = token.strip(_EDGE)
    if not _LIKE.fullmatch(core) or len(_digits(core)) < 4:
        return None
    start = token.index(core)
    return start, start + len(core)


class Tokens:
    """Words of a slice of a column with their pattern hashes: one for the word before, one for the two before."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds = buf, bounds
        self.start, self.end, self.doc = words.word_spans(buf, bounds)
        lower = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
        hashed = words.span_hashes(lower, self.start, self.end)
        none = np.zeros(min(1, len(hashed)), np.uint64)
        one = np.concatenate([none, hashed[:-1]])
        two = np.concatenate([none, one[:-1]])
        n = len(hashed)
        same1 = np.concatenate([[False] * min(1, n), self.doc[1:] == self.doc[:-1]])
        same2 = np.concatenate([[False] * min(2, n), self.doc[2:] == self.doc[:-2]])
        self.patterns = (np.where(same1, words.mix(one + np.uint64(1)), 0).astype(np.uint64), np.where(same2, words.mix(one + words.BASE * two + np.uint64(2)), 0).astype(np.uint64))
        self.digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])

    def token(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode(errors="replace")

    @cached_property
    def points(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])

    def place(self, i: int) -> int:
        """Code points in the document before word i."""
        return int(self.points[self.start[i]] - self.points[self.bounds[self.doc[i]]])

    def seeds(self, texts: list[str], row: int) -> dict[int, int]:
        """Word in which a base span begins -> hash of the span."""
        found = {}
        for d in range(len(self.bounds) - 1):
            spans = base_spans(texts[row + d])
            if not spans:
                continue
            text, first = texts[row + d], self.points[self.bounds[d]]
            for kind, s, e in spans:
                at = int(np.searchsorted(self.points, first + s, "right")) - 1
                i = int(np.searchsorted(self.start, at, "right")) - 1
                value = np.frombuffer(f"{kind}:{text[s:e]}".encode(), np.uint8)
                found.setdefault(i, int(words.span_hashes(value, np.array([0]), np.array([len(value)]))[0].astype(np.int64)))
        return found

    def candidates(self, at: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
        """Words among `at` that are like identifiers: word, start, end inside it, text."""
        enough = at[(self.digits[self.end[at]] - self.digits[self.start[at]] >= 4) & (self.end[at] - self.start[at] <= 400)]
        for i in enough.tolist():
            token = self.token(i)
            if part := like_identifier(token):
                yield i, *part, token[part[0] : part[1]]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[str], Tokens]]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        texts = [x or "" for x in column.to_pylist()]
        for row, end, buf, bounds in words.slices(column):
            yield batch, row, end, texts, (buf, bounds)


def seed_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, seeds): the different seeds before which each pattern stands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, _, texts, (buf, bounds) in _batches(batches):
            if not _DIGIT[buf].any() and not (buf == 64).any():
                continue
            tokens = Tokens(buf, bounds)
            edges = {(int(p[i].astype(np.int64)), seed) for i, seed in tokens.seeds(texts, row).items() for p in tokens.patterns if p[i]}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in edges], pa.int64()), pa.array([s for _, s in edges], pa.int64())], ["pattern", "seed"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "pattern long, seed long").distinct().groupBy("pattern").agg(F.count("*").alias("seeds"))


def occurrences(docs: DataFrame, patterns: np.ndarray) -> DataFrame:
    """(pattern, instance, known, n) of every occurrence of the patterns; a null instance stands for ordinary words."""
    wanted = np.sort(patterns.astype(np.int64).astype(np.uint64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, row, _, texts, (buf, bounds) in _batches(batches):
            tokens = Tokens(buf, bounds)
            hits = [_hits(p, wanted) for p in tokens.patterns]
            at = np.unique(np.concatenate(hits))
            instance = {i: (int(words.span_hashes(v := np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(v)]))[0].astype(np.int64)), False) for i, _, _, t in tokens.candidates(at)}
            instance |= {i: (h, True) for i, h in tokens.seeds(texts, row).items()}
            for p, found in zip(tokens.patterns, hits, strict=True):
                special = np.isin(found, np.fromiter(instance, np.int64, len(instance)))
                kinds, n = np.unique(p[found[~special]].astype(np.int64), return_counts=True)
                for k, c in zip(kinds.tolist(), n.tolist(), strict=True):
                    total[(k, None, False)] += c
                for i in found[special].tolist():
                    total[(int(p[i].astype(np.int64)), *instance[i])] += 1
            if len(total) > 200_000:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "pattern long, instance long, known boolean, n long").groupBy("pattern", "instance", "known").agg(F.sum("n").alias("n"))


def _hits(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return np.flatnonzero(wanted[at] == values)


def _counted(total: Counter) -> pa.RecordBatch:
    keys = list(total)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.int64())], ["pattern", "instance", "known", "n"])


def confident_patterns(docs: DataFrame) -> np.ndarray:
    """Hashes of the patterns whose worth ends at CONFIDENT or more."""
    spark = docs.sparkSession
    staging.small_batches(spark)
    seeded = staging.stage(seed_patterns(docs).filter(F.col("seeds") >= MIN_SEEDS), "pii-patterns")
    blocks = -(-seeded.count() // BLOCK)
    graph = None
    for k in range(blocks):
        block = seeded.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).select("pattern").toPandas().pattern.to_numpy(np.int64)
        if len(block):
            part = staging.stage(occurrences(docs, block), "pii-graph")
            graph = part if graph is None else graph.unionByName(part)
    if graph is None:
        return np.zeros(0, np.uint64)
    total = staging.stage(graph.groupBy("pattern").agg(F.sum("n").alias("total"), F.count("instance").alias("links")), "pii-total")
    links = graph.filter("instance is not null")
    n_links = links.count()
    worth = staging.stage(links.groupBy("instance").agg(F.max(F.when(F.col("known"), 1.0).otherwise(0.0)).alias("w"), F.count("*").alias("links")), "pii-worth")
    for last in [False] * (ROUNDS - 1) + [True]:
        sums = staging.lookup(links, worth, "instance", "links", n_links).groupBy("pattern").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
        scored = staging.stage(total.join(sums, "pattern").select("pattern", "links", (F.col("s") / F.col("total")).alias("c")), "pii-scored")
        if last:
            break
        miss = F.product(1 - F.col("c"))
        worth = staging.stage(staging.lookup(links, scored, "pattern", "links", n_links).groupBy("instance").agg(F.when(F.max("known"), 1.0).otherwise(1 - miss).alias("w"), F.count("*").alias("links")), "pii-worth")
    return np.sort(scored.filter(F.col("c") >= CONFIDENT).select("pattern").toPandas().pattern.to_numpy(np.int64).astype(np.uint64))


def spans_of(docs: DataFrame, patterns: np.ndarray, carry: list[str] | None = None, name: str = "spans", clean: bool = False) -> DataFrame:
    """The carried columns, the text and, under `name`, its spans: array of (kind, start, end), by kind, then start.

    With `clean` the text is the redacted one; the spans are still places in the text as it was.
    """
    staging.small_batches(docs.sparkSession)
    carry = carry or []
    source = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col("text").cast("string").alias("text"))
    starts = range(0, max(len(patterns), 1), BLOCK)
    for k in starts:
        last = k == starts[-1]
        source = _with_spans(source, patterns[k : k + BLOCK], clean and last)
        source = source if last else staging.stage(source, "pii-spans")
    return source.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "text", F.col("spans").alias(name))


def _with_spans(source: DataFrame, patterns: np.ndarray, clean: bool) -> DataFrame:
    """source(.., text) with its spans, or source(.., text, spans) with those of more patterns."""
    carry, more = [c for c in source.columns if c not in ("text", "spans")], "spans" in source.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(carry))
            texts = [x or "" for x in column.to_pylist()]
            spans = [[(y["kind"], y["start"], y["end"]) for y in x] for x in batch.column(len(carry) + 1).to_pylist()] if more else [base_spans(x) for x in texts]
            if len(patterns):
                for row, _, buf, bounds in words.slices(column):
                    tokens = Tokens(buf, bounds)
                    at = np.unique(np.concatenate([_hits(p, patterns) for p in tokens.patterns]))
                    owner, starts, ends = -1, [], []
                    for i, s, e, _ in tokens.candidates(at):
                        if owner != row + int(tokens.doc[i]):
                            owner = row + int(tokens.doc[i])
                            starts, ends = _covered(spans[owner])
                        base = tokens.place(i)
                        before = bisect_left(starts, base + e) - 1
                        if before < 0 or ends[before] <= base + s:
                            spans[owner].append(("found", base + s, base + e))
            if more:
                spans = [sorted(x, key=lambda y: (KINDS.index(y[0]), y[1])) for x in spans]
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            if clean and any(found):
                column = pa.array([redacted(t, x) for t, x in zip(column.to_pylist(), found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], column, pa.array(found, kind)], [*carry, "text", "spans"])

    kinds = dict(source.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in carry], "text string, spans array<struct<kind:string,start:long,end:long>>"])
    return source.mapInArrow(each, schema)


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that the spans cover, in order."""
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def redacted(text: str | None, spans: list) -> str | None:
    """text with each run of overlapping spans replaced by the kind of its first one."""
    if text is None or not len(spans):
        return text
    out, done, merged = [], 0, []
    for kind, s, e in sorted(((x["kind"], x["start"], x["end"]) for x in spans), key=lambda x: (x[1], KINDS.index(x[0]))):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[done:s], f"<{kind}>"]
        done = e
    return "".join([*out, text[done:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.documents(spark, sf_dir).select("doc_id", "text")
    found = spans_of(docs, confident_patterns(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
