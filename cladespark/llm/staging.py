"""Written tables in the folder that all executors share, and joins that stand hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this process, removed at its end.

    Executors elsewhere do not share such a folder, so only a local session may leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="stage-"))
        atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
    return _OWN[0]


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_ROWS rows and BATCH_BYTES, so that long texts fit beside others.

    A session that has smaller batches set keeps them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(key))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it again: it is computed once, and losing an executor does not lose it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 2000) -> DataFrame:
    """left joined to right on `key`, of which right has each value once and `weight` says in how many rows of left.

    Values with at least total / share of the rows are at most `share` many and
    are broadcast; the others go through a shuffled join, in which no value has
    more rows than that. Both sides are read twice, so both are staged tables.
    """
    hot = right.filter(F.col(weight) * share >= F.lit(total))
    one = left.join(F.broadcast(hot), key)
    other = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(weight) * share < F.lit(total)), key)
    return one.unionByName(other)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
