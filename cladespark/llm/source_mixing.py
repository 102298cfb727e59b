"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997).

Each source gets a target in words. Target over size, r, is split into whole
copies, floor(r), which every document gets, and a rest f, which is sampled:
document i has inclusion probability

    p_i = f + tilt * min(f, 1 - f) * (u_i - mean of u),   u_i = size_i / (size_i + mean size)

where the mean of u is weighted by size. So probabilities are unequal (longer
documents are likelier), all lie strictly between 0 and 1, and the expected
words are exactly f times the source. Documents are ranked by

    (U / (1 - U)) / (p / (1 - p)),   U uniform, from a hash of the document,

and taken from the smallest rank up until the words of the rest are reached:
the last document is taken if that comes nearer. No document is taken in
part, and none more than MOST times.

Everything is a DataFrame operation. Ranks are cut into bins, words are summed
by source and bin, and only the bin in which a source's target falls is
sorted; no task holds a whole source. Reruns agree, as U is a hash.

Null texts have size 0; a null source is a source, the last one. Rows that are
equal share U and are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm import staging

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
TILT = 0.5
BINS = 4096
#: Up to this many sources, their figures are broadcast; more are joined by source and salt.
BROADCAST_SOURCES = 10_000
SALTS = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) with `target`: weight shares of the total, none over `most` sizes.

    Filling in order of most * size / weight: a source is at its limit if the
    level, what is left over the weights that are left, reaches that ratio.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    limited = weighed.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = limited.withColumn("level", level).withColumn("level", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    # The first source that is not at its limit sets the level of all that follow.
    final = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("w") * final, F.col("limit")))).select("source", "source_size", "target")


def uniform(*columns: str) -> Column:
    """Uniform in (0, 1) from an MD5 of the columns, so that other engines can compute it."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def attach(rows: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to one row of figures for each key: broadcast if there are few, else by key and salt."""
    found = figures.take(BROADCAST_SOURCES + 1)
    same = lambda right: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    renamed = lambda f: f.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in f.columns if c not in keys])
    if len(found) <= BROADCAST_SOURCES:
        local = rows.sparkSession.createDataFrame(found, figures.schema)
        return rows.join(F.broadcast(renamed(local)), same(local)).drop(*[f"__{k}" for k in keys])
    salted = renamed(figures).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*same(figures), F.col("__s") == F.col("__salt")]).drop("__s", "__salt", *[f"__{k}" for k in keys])


def measured(docs: DataFrame) -> DataFrame:
    """docs with `size` and `u`."""
    text = staging.text_column()
    return docs.withColumn("source", F.col("source").cast("string")).withColumn("size", n_words(text)).withColumn("m", F.md5(text.cast("binary"))).withColumn("u", uniform("doc_id", "m")).drop("m")


def plan(slim: DataFrame, tilt: float) -> DataFrame:
    """Figures of each source: size, target, whole copies, rest, and the centre of u that balances the probabilities."""
    sizes = staging.stage(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    figures = targets(sizes.select("source", "source_size")).withColumnRenamed("source", "s2")
    figures = sizes.drop("source_size").join(figures, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    figures = figures.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    figures = figures.select("source", "source_size", "target", F.floor("r").cast("long").alias("whole"), (F.col("r") - F.floor("r")).alias("f"), (F.col("source_size") / F.col("n")).alias("mean"))
    figures = staging.stage(figures.withColumn("tilt", F.lit(tilt) * F.least(F.col("f"), 1 - F.col("f"))), "mix-figures")
    # A sum of decimals does not depend on the order of the rows, so reruns agree.
    centre = attach(slim, figures, ["source"]).groupBy("source").agg((F.sum((F.col("size") * _longer()).cast("decimal(30,9)")).cast("double") / F.greatest(F.sum("size"), F.lit(1))).alias("centre")).withColumnRenamed("source", "s2")
    return staging.stage(figures.join(centre, F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-plan")


def _longer() -> Column:
    return F.when(F.col("size") + F.col("mean") > 0, F.col("size") / (F.col("size") + F.col("mean"))).otherwise(0.0)


def ranked(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """rows with the figures of their source and `q`, between 0 and 1 in the order of the ranks."""
    p = F.col("f") + F.col("tilt") * (_longer() - F.col("centre"))
    rank = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    rows = attach(rows, figures, ["source"]).withColumn("p", p)
    return rows.withColumn("q", F.when(F.col("p") > 0, rank / (1 + rank)).otherwise(F.col("u"))).drop("p", "f", "tilt", "mean", "centre", "u")


def mix(docs: DataFrame, bins: int = BINS, tilt: float = TILT) -> tuple[DataFrame, DataFrame]:
    """What is taken of every row of docs(doc_id, text, source), and the plan.

    Columns: doc_id, source, size, source_size, target, q, copies, taken.
    """
    slim = staging.stage(measured(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "u"), "mix")
    figures = plan(slim, tilt)
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    rows = ranked(slim, figures).withColumn("wanted", wanted).withColumn("bin", F.least(F.floor(F.col("q") * bins), F.lit(bins - 1)).cast("int"))
    rows = staging.stage(rows, "mix-ranked")
    by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("wanted").alias("w"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    edge = by_bin.filter((F.col("before") < F.col("w")) & (F.col("before") + F.col("bin_size") >= F.col("w"))).select(F.col("source").alias("s2"), F.col("bin").alias("edge"), "before")
    # A source without a rest has no edge, and nothing is taken beyond its whole copies.
    edges = figures.select("source").join(edge, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    rows = attach(rows, staging.stage(edges, "mix-edges"), ["source"])
    inside = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.filter(F.col("bin") == F.col("edge"))
    at_edge = at_edge.withColumn("extra", F.when(F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0))
    others = rows.filter(F.col("bin") != F.col("edge")).withColumn("extra", F.when(F.col("bin") < F.col("edge"), 1).otherwise(0))
    out = at_edge.unionByName(others).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    out = out.select("doc_id", "source", "size", "source_size", "target", "q", "whole", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    return out, figures


def repeated(docs: DataFrame, bins: int = BINS, tilt: float = TILT) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with the columns of docs.

    The last rank that a source takes is found first, so texts are not shuffled.
    Rows with equal doc_id and text are taken alike.
    """
    out, figures = mix(docs, bins, tilt)
    key = F.struct("q", "doc_id", "size")
    cuts = out.filter(F.col("copies") > F.col("whole")).groupBy("source").agg(F.max(key).alias("cut")).withColumnRenamed("source", "s2")
    figures = staging.stage(figures.join(cuts, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-cuts")
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    rows = ranked(measured(held).drop("text"), figures)
    copies = (F.col("whole") + F.when(key <= F.col("cut"), 1).otherwise(0)).cast("int")
    return rows.withColumn("n", copies).filter("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(staging.documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
