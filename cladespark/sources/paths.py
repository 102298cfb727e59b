"""Path resolution and texts of files. Spark lists and reads, so any file system that it knows will do."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladespark.errors import InputError

#: Script inputs are read on the driver; a file beyond this size is an error.
LARGEST_FILE = 512 << 20


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def resolve(spark: SparkSession, path: str) -> list[str]:
    """The path itself if it exists, else what it matches as a glob; nothing is an error."""
    system, where = _system(spark, path)
    if system.exists(where):
        return [path]
    found = system.globStatus(where) or []
    names = sorted(s.getPath().toString() for s in found)
    if not names:
        raise InputError(f"{path}: not found")
    return names


def resolve_one(spark: SparkSession, path: str) -> str:
    found = resolve(spark, path)
    if len(found) > 1:
        raise InputError(f"{path}: ambiguous, it matches {len(found)} files")
    return found[0]


def read_text(spark: SparkSession, path: str) -> str:
    """Text of one file; an empty or unreadable one is an error."""
    system, where = _system(spark, path)
    try:
        if system.getFileStatus(where).getLen() > LARGEST_FILE:
            raise InputError(f"{path}: larger than {LARGEST_FILE >> 20} MB; read it as a table")
        rows = spark.read.text(path, wholetext=True).select(F.col("value")).collect()
    except InputError:
        raise
    except Exception as e:
        raise InputError(f"{path}: cannot be read: {str(e).splitlines()[0]}") from None
    text = rows[0].value if rows else ""
    if not text.strip():
        raise InputError(f"{path}: empty")
    return text
