"""Stratified split and class weights."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def _with_digest(df, key, seed):
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))


def in_digest_order(df, label, key, seed: int = 123):
    """The rows dealt out by class and digest range, and in the order of the digest inside a part: a
    learner that draws rows by their place then draws the same ones however ``df`` lay."""
    marked = _with_digest(df, key, seed).repartition(label, "_range")
    return marked.sortWithinPartitions(label, "_range", "_digest", *key).select(*df.columns)


def stratified_split(df, label, key, test_share: float = 0.2, seed: int = 123):
    """Mark ``E_TESTE`` on an exact share of every class, the same on every run.

    Rows are ordered inside their class by a seeded digest of the key.  The order is cut
    into 4096 digest ranges; a class may be most of the table, but only the ranges are
    counted.  All rows of a range are on one side but those of the range where the share
    ends, so only these, one range of each class, are moved and ranked.
    """
    marked = _with_digest(df, key, seed)
    counts = marked.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    # A struct as the key, so that a null label is a class as well.
    offsets = counts.select(
        F.struct(F.col(label).alias("label")).alias("k"), F.col("_range").alias("edge"), "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.round(F.sum("_n").over(whole) * F.lit(test_share)).cast("long").alias("_quota"))
    # One entry per class; a class that is all test has none.
    ends = offsets.filter("_before <= _quota AND _quota < _before + _n").agg(F.map_from_entries(F.collect_list(
        F.struct("k", F.struct("edge", (F.col("_quota") - F.col("_before")).alias("left")))))).scalar()
    own = F.element_at(ends, F.struct(F.col(label).alias("label")))
    placed = marked.withColumn("_own", own)

    sure = placed.filter(F.col("_own").isNull() | (F.col("_range") != F.col("_own.edge"))).select(
        *df.columns, F.coalesce(F.col("_range") < F.col("_own.edge"), F.lit(True)).alias("E_TESTE"))
    inside = Window.partitionBy(label, "_range").orderBy("_digest", *key)
    ranked = placed.filter(F.col("_range") == F.col("_own.edge")).withColumn("_rank", F.row_number().over(inside))
    return sure.union(ranked.select(*df.columns, (F.col("_rank") <= F.col("_own.left")).alias("E_TESTE")))


def class_weights(df, label):
    """Balanced weight of each class: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("N"))
    # One entry per class, so the list is as short as the label set.
    listed = counts.agg(F.collect_list(F.struct(label, "N")).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["N"])
    return listed.select(total.alias("t"), F.size("c").alias("k"), F.explode("c").alias("x")) \
        .select(f"x.{label}", "x.N", (F.col("t") / (F.col("k") * F.col("x.N"))).alias("PESO"))


def with_class_weight(df, label):
    """Rows with the balanced weight of their class, looked up without a shuffle."""
    pairs = F.collect_list(F.struct(label, "PESO"))
    table = class_weights(df, label).agg(F.map_from_entries(pairs).alias("m")).scalar()
    return df.withColumn("PESO", F.element_at(table, F.col(label)))
