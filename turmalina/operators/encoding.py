"""Categories as numbers: the shares of the labels among the rows of a category.

A tree that splits on such a share splits the categories in the order of how often they have a
label, so its statistics grow with the bins of a share and not with the number of categories.
Shares live in a table with one row per category; nothing is held on the driver.
"""

from functools import reduce
from operator import add

from pyspark.sql import Window
from pyspark.sql import functions as F

from turmalina.sources.tables import written

FOLDS = 5


def category_places(df, column):
    """One row per category that is not null: ``VALOR`` as text and ``POSICAO``, its place in the
    alphabet from 0.

    The categories are dealt out in ranges of the alphabet; a range is ranked by itself, and only
    the ranges' sizes are added up, so no task and not the driver holds all of them.
    """
    values = df.select(F.col(column).cast("string").alias("VALOR")).dropna().distinct()
    dealt = written(values.repartitionByRange("VALOR").withColumn("_parte", F.spark_partition_id()), f"places-{column}")
    before = Window.orderBy("_de").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_parte").agg(F.min("VALOR").alias("_de"), F.count("*").alias("_n")).select(
        "_parte", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_antes"))
    own = Window.partitionBy("_parte").orderBy("VALOR")
    ranked = dealt.withColumn("_rank", F.row_number().over(own)).join(ranges, "_parte")
    return ranked.select("VALOR", (F.col("_antes") + F.col("_rank") - 1).alias("POSICAO"))


def with_fold(df, keys, folds: int = FOLDS, seed: int = 0):
    """``df`` with ``_dobra``, the fold of a row by a digest of its key."""
    return df.withColumn("_dobra", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int"))


def category_table(df, column, label, classes, smoothing: float = 10.0):
    """One row per category: ``VALOR``, its label counts by fold, and ``PARTES``, the label shares.

    ``smoothing`` rows with the shares of all rows are added to each category, so that a rare one
    says little.  ``df`` has the column ``_dobra``; rows are combined on the map side.
    """
    def counts(source):
        return [F.sum((F.col(label) == c).cast("long")).alias(f"_{k}") if source is None
                else F.sum(f"_{k}").alias(f"_{k}") for k, c in enumerate(classes)]

    listed = F.array(*[F.col(f"_{k}") for k in range(len(classes))])
    by_fold = df.groupBy(F.col(column).alias("VALOR"), "_dobra").agg(*counts(None))
    whole = by_fold.agg(*counts("_")).select(listed).scalar()
    table = by_fold.groupBy("VALOR").agg(
        F.map_from_entries(F.collect_list(F.struct("_dobra", listed))).alias("DOBRAS"), *counts("_"))
    table = table.select("VALOR", "DOBRAS", listed.alias("N"), whole.alias("TODOS"))
    return table.withColumn("PARTES", _shares(F.col("N"), F.col("TODOS"), smoothing))


def _total(counts):
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _shares(counts, whole, smoothing):
    prior = F.transform(whole, lambda n: n / _total(whole))
    return F.zip_with(counts, prior, lambda n, p: (n + p * smoothing) / (_total(counts) + smoothing))


def encode(df, table, column, prefix, size, absent):
    """``df`` with one column per label, ``<prefix><k>``: the shares of the row's category, and
    ``absent`` for a category that the table doesn't hold."""
    rows = df.alias("l").join(table.select("VALOR", "PARTES").alias("r"),
                              F.col(f"l.`{column}`").eqNullSafe(F.col("r.VALOR")), "left")
    told = F.coalesce(F.col("r.PARTES"), absent)
    return rows.select("l.*", *[told[k].alias(f"{prefix}{k}") for k in range(size)])


def encode_out_of_fold(df, table, column, prefix, size, smoothing: float = 10.0):
    """As ``encode`` for the rows the table was counted on: a row's own fold is left out, so a
    row's label says nothing about its own shares."""
    rows = df.alias("l").join(table.select("VALOR", "N", "TODOS", "DOBRAS").alias("r"),
                              F.col(f"l.`{column}`").eqNullSafe(F.col("r.VALOR")))
    rows = rows.withColumn("_propria", F.element_at(F.col("r.DOBRAS"), F.col("l._dobra")))
    # Plain arithmetic per label: functions over lists aren't compiled, and this runs on every row.
    others = [F.col("r.N")[k] - F.col("_propria")[k] for k in range(size)]
    whole = [F.col("r.TODOS")[k] for k in range(size)]
    total, all_rows = reduce(add, others), reduce(add, whole)
    return rows.select("l.*", *[((others[k] + whole[k] / all_rows * smoothing) / (total + smoothing)).alias(f"{prefix}{k}")
                                for k in range(size)])
