"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits by their own quantiles (strings by the order of
their distinct whole values) and joined to one
curve index; neighbours on the curve are alike in all dimensions at once.  The rows in curve
order are cut into runs of equal count (law ``rows``: counts are at most one apart), so each
shard covers a small box of the metadata and can be skipped by a filter on any dimension.

Equal texts are one group: the group's smallest values stand for all its members, which thus
lie next to each other.  The order within a cell is by text hash, then by id hash.  Rows are
numbered by counts of cells, of hash buckets in a cell, and ranks within a bucket, so neither a
cell nor a group that holds a third of all rows meets in one task.

Per row: ``doc_id``, ``size`` (UTF-8 bytes of the text, null none, plus 1), ``text_crc32``,
``law``, ``shard``, ``slot`` (from 0, gapless), ``grown_shard`` (null under this law), ``curve``
and the quantised dimensions.

Defined results: a null text counts as an empty one; null metadata sorts before all else;
repeated rows are placed one by one; fewer rows than shards leave shards empty; an empty table
gives no rows; other columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

TEXT_BUCKETS, ID_BUCKETS = 1024, 64  # parts of a cell, and of one text's rows, ranked apart
COARSE = 12  # bits of the curve index by which cells are first counted


def hilbert_index(dims: list, bits: int):
    """Hilbert curve index of integer columns below ``2 ** bits``, as Skilling's transform:
    undo the rotations from the highest bit down, Gray-encode, interleave the bits."""
    n = len(dims)
    zero = F.lit(0).cast("long")

    def turn(x, q):
        """One level: for each dimension, invert or exchange the low bits with the first."""
        low = q - 1

        def step(acc, i):
            first, own = F.element_at(acc, 1), F.element_at(acc, i)
            swapped = first.bitwiseXOR(own).bitwiseAND(low)
            is_set = own.bitwiseAND(q) != 0
            new_first = F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swapped))
            new_own = F.when(is_set | (i == 1), own).otherwise(own.bitwiseXOR(swapped))
            return F.transform(acc, lambda v, k: F.when(k == 0, new_first).when(k == i - 1, new_own).otherwise(v))

        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, step)

    levels = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)))
    x = F.aggregate(levels, F.array(*(d.cast("long") for d in dims)), turn)
    # Gray encoding: each dimension takes on the ones before it.
    gray = F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(
        acc, F.array(F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.element_at(acc, -1))))))
    flip = F.aggregate(levels, zero, lambda t, q: F.when(
        F.element_at(F.col("_gray"), n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    spots = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    index = F.aggregate(spots, zero, lambda h, b: F.aggregate(
        F.col("_gray"), h, lambda g, v: g * 2 + F.call_function("shiftright", v.bitwiseXOR(F.col("_flip")), b).bitwiseAND(F.lit(1).cast("long"))))
    return gray, flip, index


def with_curve(df, dims: list, bits: int, name: str = "curve"):
    """``df`` with the curve index of its columns ``dims``."""
    gray, flip, index = hilbert_index([F.col(d) for d in dims], bits)
    return df.withColumn("_gray", gray).withColumn("_flip", flip).withColumn(name, index).drop("_gray", "_flip")


def _quantised(df, numbers: list, strings: list, bits: int):
    """Each dimension's place among its quantiles: ``2 ** bits`` steps, null in the first.

    Numbers are held against approximate quantiles; of strings the distinct values are put in
    order, whole, and a value's place is the share of rows before it."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = df.agg(*(F.percentile_approx(d, F.array(*map(F.lit, steps)), 10000).alias(d) for d in numbers)).first()
    for d in numbers:
        cuts = sorted(set(edges[d] or []))
        own = F.col(d)
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda edge: edge <= own)) if cuts else F.lit(0)
        df = df.withColumn(d, F.coalesce(F.when(F.col(d).isNotNull(), place), F.lit(0)).cast("long"))
    for d in strings:
        places = written(_string_places(df, d, bits), "places")
        df = (df.alias("l").join(places.alias("r"), F.col(f"l.{d}").eqNullSafe(F.col("r.value")))
              .select(*(F.col("r.place").alias(d) if c == d else F.col(f"l.{c}") for c in df.columns)))
    return df


def _string_places(df, column: str, bits: int):
    """``value`` and ``place`` of each distinct value; ranges of values are counted first, so no
    task orders them all."""
    ranged = written(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
                     .repartitionByRange(F.col("value").asc_nulls_first())
                     .withColumn("part", F.spark_partition_id()), "values")
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range
    parts = parts.select("part", ahead(upto(F.lit(0)).orderBy("part")).alias("b1"),
                         F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    inner = ranged.withColumn("b2", ahead(upto("part").orderBy(F.col("value").asc_nulls_first())))
    return inner.join(parts, "part").select("value", F.expr(f"(b1 + b2) * {1 << bits} DIV all").cast("long").alias("place"))


def shard(docs, shards: int = 16, dims=("source", "lang"), bits: int = 6):
    """Every document's shard and slot; the text's size is a dimension besides ``dims``."""
    kinds = dict(docs.dtypes)
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("th"),
        *(F.col(d).cast("string" if kinds[d] == "string" else "double").alias(f"q_{d}") for d in dims)), "rows")
    strings = [f"q_{d}" for d in dims if kinds[d] == "string"]
    names = ["q_size", *(f"q_{d}" for d in dims)]
    groups = rows.groupBy("th", "size").agg(F.min(F.col("size").cast("double")).alias("q_size"),
                                            *(F.min(f"q_{d}").alias(f"q_{d}") for d in dims))
    groups = with_curve(_quantised(written(groups, "groups"), [n for n in names if n not in strings], strings, bits),
                        names, bits)
    placed = (rows.drop(*names).join(groups, ["th", "size"])
              .withColumn("cell", F.col("curve"))
              .withColumn("tb", F.pmod("th", F.lit(TEXT_BUCKETS)).cast("int"))
              .withColumn("ib", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int")))
    placed = written(placed, "placed")

    fine = max(0, bits * len(names) - COARSE)
    counts = written(placed.groupBy("cell", "tb", "ib").agg(F.count("*").alias("n"))
                     .withColumn("coarse", F.call_function("shiftright", "cell", F.lit(fine))), "counts")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    by_coarse = counts.groupBy("coarse").agg(F.sum("n").alias("n"))  # at most 2 ** COARSE rows
    by_coarse = by_coarse.select("coarse", ahead(before(F.lit(0)).orderBy("coarse")).alias("b1"))
    by_cell = counts.groupBy("coarse", "cell").agg(F.sum("n").alias("n"))
    by_cell = by_cell.select("coarse", "cell", ahead(before("coarse").orderBy("cell")).alias("b2"))
    by_bucket = counts.select("coarse", "cell", "tb", "ib", ahead(before("cell").orderBy("tb", "ib")).alias("b3"))
    bases = (by_bucket.join(by_cell, ["coarse", "cell"]).join(by_coarse, "coarse")
             .select("cell", "tb", "ib", (F.col("b1") + F.col("b2") + F.col("b3")).alias("base")))
    total = F.lit(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own = Window.partitionBy("cell", "tb", "ib").orderBy("th", "doc_id", "text_crc32")
    ranked = (placed.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["cell", "tb", "ib"])
              .withColumn("rank", F.col("rank") + F.col("base")))
    out = ranked.withColumn("_total", total).withColumn("shard", F.expr(f"rank * {shards} DIV _total").cast("int"))
    first = F.expr(f"(shard * _total + {shards} - 1) DIV {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                      "curve", *names)
