"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

An Aho-Corasick automaton finds the keywords in one pass; expressions are tried
only where a keyword begins. Runs of hexadecimal digits have no keyword: there
the prefilter is the length of runs of such bytes. Kinds, in this order:

* assign: a keyword, a separator and a value of 8 or more characters
* access: AKIA and capitals or digits, 16 or more characters in all
* hex: 32 or more lower-case hexadecimal digits
* github, npm: prefixed tokens whose last 6 characters are the base-62 CRC-32
  of what lies between; others are dropped
* jwt: three base64url parts, the first a JSON object with "alg"
* pem: the first line of a private key

Matches of a kind are the leftmost ones that do not overlap. A null text is
empty. Equal texts have equal spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladespark.llm import staging

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Keyword (found in either case), kind, expression tried where it begins.
_ASSIGN = re.compile(rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]++")
_PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}
_EXPRESSIONS = {"assign": _ASSIGN, "access": _ACCESS, "github": _TOKEN, "npm": _TOKEN, "jwt": _JWT, "pem": _PEM}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(value: int, width: int) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = _DIGITS62[digit] + out
    return out.rjust(width, "0")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= MIN_VALUE
    if kind == "access":
        return m.end() - m.start() >= MIN_ACCESS
    if kind in ("github", "npm"):
        return base62(zlib.crc32(m[1]), 6).encode() == m[2]
    if kind == "jwt":
        try:
            header = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
        except (ValueError, RecursionError):
            return False
        return isinstance(header, dict) and "alg" in header
    return True


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    flags = _HEX[np.frombuffer(data, np.uint8)]
    # A run of 32 covers one of every 32 positions at least.
    if not flags[MIN_HEX - 1 :: MIN_HEX].any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    long = end - start >= MIN_HEX
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def scan(text: str | None, machine) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then in the order of KINDS."""
    data = (text or "").encode()
    found = [(s, e, "hex") for s, e in hex_runs(data)]
    done = dict.fromkeys(KINDS, 0)
    hits = sorted((at - n + 1, kind) for at, (n, kind) in machine.iter(data.lower().decode("latin-1")))
    for at, kind in hits:
        if at < done[kind]:
            continue
        if not (m := _EXPRESSIONS[kind].match(data, at)):
            if kind == "jwt":  # nor does any other start in this run match, so it is not walked again
                done[kind] = _JWT_RUN.match(data, at).end()
            continue
        done[kind] = m.end()
        if _valid(kind, m):
            found.append((at, m.end(), kind))
    if found and len(data) != len(text):
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        found = [(int(heads[s]), int(heads[e]), kind) for s, e, kind in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(SPANS)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    machine = automaton()
    for texts in batches:
        yield pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in scan(x, machine)] for x in texts], dtype=object)


def secret_spans(text: Column) -> Column:
    """Array of (start, end, kind) of the secrets in a text column."""
    return _spans(text.cast("string"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging.small_batches(spark)
    docs = staging.documents(spark, sf_dir).select("doc_id", secret_spans(F.col("text")).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return docs.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
