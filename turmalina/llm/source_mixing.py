"""Mixing sources to target weights by capped water-filling, in DataFrame functions.

Sources share all words by weight.  A source whose share is above ``epochs`` times its own words
is clamped there, and the excess is reshared by weight among the others, round by round, until no
target is above its cap.  A source then takes each document a whole number of times, and a seeded
sample of its documents once more, the last of which it takes in part.

- The water level (words per unit of weight) is all that a round needs: a source is clamped when
  its cap is below its weight times the level.  So a round is one aggregation over the sources'
  table, and the driver holds a few numbers.
- Sources are numbered over ranges of their names, so their number isn't bounded by one task.
- The sample: documents in the order of the md5 of seed and ``doc_id`` until the source's rest is
  full.  The one document where it ends is found in two steps of 4096 digest ranges each, on sums
  per range, and then among the few digests of one range.  Documents with one digest (one id, or
  null ids) share what is left for it in proportion to their size.  No source is sorted whole or
  met in one task.

Defined results: a null text has size 0; a null source is a source of its own and the last; a
source without words has target 0; repeated rows are taken each; an empty table gives no rows;
other columns are kept as a struct by ``mix`` and can't clash.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
#: Fixed value: a word is a stretch of characters other than ASCII white space.
WORD = r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"
STEP = 3  # hexadecimal digits of a digest range


def n_words(text):
    """The number of words: the first characters of all words are what stays.  Null has none."""
    return F.coalesce(F.length(F.regexp_replace(text, WORD, "$1")), F.lit(0)).cast("long")


def sized(docs, seed: int = 0, keep=("doc_id",)):
    """``doc`` (the columns ``keep``), ``source``, ``size`` and the digest ``draw`` of each row."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.struct(*keep).alias("doc"), F.col("source").cast("string").alias("source"),
                       n_words(F.col("text")).alias("size"), draw.alias("draw"))


def numbered_sources(rows, weights):
    """One row per source with its words and its weight: the weights in turn, by code point, null
    last."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(sums.repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("part", F.spark_partition_id()), "sources")
    before = (ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return (ranged.withColumn("rank", rank).join(before, "part")
            .select("source", "source_size", F.element_at(
                F.array(*map(F.lit, weights)), ((F.col("rank") + F.col("before")) % len(weights) + 1).cast("int"))
                .cast("long").alias("weight")))


def targets(sources, epochs: int):
    """``sources`` with the column ``target``, the words that the mix takes from each."""
    cap = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight = total, sources.agg(F.sum("weight")).first()[0] or 0
    while weight:
        level = left / weight
        clamped = cap.cast("double") <= F.col("weight") * F.lit(level)
        caps, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if (free or 0) == weight:  # no other source is clamped at this level
            break
        left, weight = total - (caps or 0), free or 0
    if not weight:
        return sources.withColumn("target", cap.cast("double"))
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(cap.cast("double") <= share, cap.cast("double")).otherwise(share))


def _same(column):
    """Sources meet null with null."""
    return F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))


def _narrowed(rows, ends, digits: int):
    """``ends`` (source, prefix, rest) moved on to the range of ``digits`` digits in which the
    rest of the source is full: the words before that range are taken off."""
    inside = (rows.alias("l").join(ends.alias("r"), _same("source") & F.col("l.draw").startswith(F.col("r.prefix")))
              .groupBy(F.col("l.source").alias("source"), F.substring("l.draw", 1, digits).alias("range"), "rest")
              .agg(F.sum("l.size").alias("words")))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(upto), F.lit(0))
    return (inside.withColumn("before", before)
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
            .select("source", F.col("range").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest")))


def plan(rows, weights=WEIGHTS, epochs: int = 3):
    """One row per source: words, weight, target, the whole repetitions, and where the one more
    ends: the digest ``last``, whose documents share ``rest`` of their ``held`` words."""
    goals = targets(numbered_sources(rows, weights), epochs)
    goal = F.floor("target")
    some = F.col("source_size") > 0
    goals = written(goals.withColumn("goal", goal)
                    .withColumn("whole", F.when(some, F.expr("goal DIV source_size")).otherwise(0))
                    .withColumn("rest", F.when(some, F.col("goal") % F.col("source_size")).otherwise(0)).drop("goal"), "goals")
    ends = goals.filter("rest > 0").select("source", F.lit("").alias("prefix"), "rest")
    for digits in (STEP, 2 * STEP, 32):
        ends = written(_narrowed(rows, ends, digits), "ends")
    held = (rows.alias("l").join(ends.alias("r"), _same("source") & (F.col("l.draw") == F.col("r.prefix")))
            .groupBy(F.col("l.source").alias("source"), F.col("l.draw").alias("last"), "rest")
            .agg(F.sum("l.size").alias("held")))
    return written(goals.drop("rest").alias("l").join(held.alias("r"), _same("source"), "left")
                   .select("l.*", "r.last", "r.rest", "r.held"), "plan")


def mix(docs, weights=WEIGHTS, epochs: int = 3, seed: int = 0, keep=("doc_id",)):
    """Per row: ``doc``, ``size``, ``source``, ``source_size``, ``target`` and ``taken``, the
    words the mix takes: ``whole`` repetitions and ``part`` words of one more."""
    rows = written(sized(docs, seed, keep), "sized")
    cuts = plan(rows, weights, epochs)
    # The part of a digest's documents: their size's share of the rest, rounded down.
    share = F.expr("CAST(CAST(size AS DECIMAL(19, 0)) * CAST(rest AS DECIMAL(19, 0)) DIV held AS BIGINT)")
    part = (F.when(F.col("r.last").isNull(), F.lit(0)).when(F.col("l.draw") < F.col("r.last"), F.col("l.size"))
            .when(F.col("l.draw") == F.col("r.last"), share).otherwise(F.lit(0)).cast("long"))
    return (rows.alias("l").join(cuts.alias("r"), _same("source"))
            .select("l.doc", "l.size", "l.source", "r.source_size", "r.target", F.col("r.whole").cast("long").alias("whole"),
                    part.alias("part"))
            .withColumn("taken", F.col("whole") * F.col("size") + F.col("part")))


def repeated(docs, **settings):
    """The mix itself: the rows of ``docs``, each as often as it is taken (``mix_epoch`` from 0);
    a repetition taken in part has only its first words, with the blanks before each."""
    mixed = mix(docs, keep=docs.columns, **settings).filter("taken > 0")
    times = F.expr("sequence(0L, whole + IF(part > 0, 0L, -1L))")
    words = F.split("doc.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", F.col("part").cast("int") + 1)
    cut = (F.when(F.col("mix_epoch") < F.col("whole"), F.col("doc.text"))
           .otherwise(F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")))
    return mixed.withColumn("mix_epoch", F.explode(times)).select(*(
        cut.alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in docs.columns), "mix_epoch")


def report(docs, **settings):
    """``doc_id, size, source_size, target, taken`` of every row, with ``whole`` and ``part``."""
    return mix(docs, **settings).select("doc.doc_id", "size", "source_size", "target", "taken", "whole", "part")
