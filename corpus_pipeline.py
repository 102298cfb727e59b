"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and is written as Parquet before the next one reads it. All but the last
return the columns of documents:

1. quality_rules: rows that the base rules or the n-gram ratio reject go;
2. ngram_jaccard_join: of each class of near copies the row with the smallest doc_id stays;
3. personal_data: spans are replaced by their kind, n_chars follows;
4. mix_sources: each row comes as often as the mix takes it;
5. packing: boundary records of the packed sequences.

Null ids are kept apart by their texts; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm import ngram_join, packing, personal_data, quality_rules, source_mixing, staging


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(spark, docs, sf_dir, carry=docs.columns)
    return judged.filter("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the key of their class stay; of repeated rows with that key, one.

    A key stands for an id and a text, so unlike texts with one id stay apart.
    Keys of the classes are at most as many as rows, so the join is a shuffled
    one on the key, which is unique but for repeated rows.
    """
    classes = ngram_join.jaccard_classes(docs)
    first = classes.filter(F.col("key").eqNullSafe(F.col("class_key"))).select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", ngram_join.row_key(docs))
    kept = keyed.join(first, "__key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]))
    return kept.withColumn("__rank", rank).filter("__rank = 1").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    patterns = personal_data.confident_patterns(docs)
    others = [c for c in docs.columns if c != "text"]
    clean = personal_data.spans_of(docs, patterns, others, "__spans", clean=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: The learned ratio, the hashed labels and the tokenizer have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = staging.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staging.stage(stage(spark, docs, sf_dir), name)
    return docs
