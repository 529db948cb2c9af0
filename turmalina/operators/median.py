"""Exact median by counting."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def exact_median(df, keys, value, name, width: int = 1024):
    """The median of each group's non-null numbers, the mean of the middle two of an even count.

    Equal values are counted first, then ranges of ``width``; running sums over the ranges tell
    which one or two hold the middle, and only their values are put in order.  So a group that
    holds a large part of all rows is nowhere held whole.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")) \
        .withColumn("_faixa", F.floor(F.col("_v") / width))
    before = Window.partitionBy(*keys).orderBy("_faixa").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, "_faixa").agg(F.sum("_n").alias("_m")).select(
        *keys, "_faixa", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_antes"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias("_todos"))
    ranges = ranges.withColumns({"_a": F.expr("(_todos + 1) DIV 2"), "_b": F.expr("(_todos + 2) DIV 2")})

    def holds(rank, low, high):
        return (F.col(low) < F.col(rank)) & (F.col(rank) <= high)

    upper = F.col("_antes") + F.col("_m")
    middle = ranges.filter(holds("_a", "_antes", upper) | holds("_b", "_antes", upper)).drop("_m", "_todos")
    same = F.col("l._faixa") == F.col("r._faixa")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    inside = counts.alias("l").join(middle.alias("r"), same).select(
        *[f"l.{k}" for k in keys], "l._v", "l._n", "l._faixa", "r._antes", "r._a", "r._b")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_faixa").orderBy("_v")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("_ate", F.col("_antes") + upto).withColumn("_de", F.col("_ate") - F.col("_n"))
    value_at = [F.max(F.when(holds(r, "_de", F.col("_ate")), F.col("_v").cast("double"))) for r in ("_a", "_b")]
    return inside.groupBy(*keys).agg(((value_at[0] + value_at[1]) / 2).alias(name))
