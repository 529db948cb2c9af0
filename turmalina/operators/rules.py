"""Ordered pattern rules over a dictionary of names, by an index of what the patterns require.

A rule can match only a name that holds the plain text of its pattern.  Each rule is filed under
one piece of that text, the one that the fewest rules share; a name meets the rules whose piece it
holds, in rule order, and no others.  Rules without such text meet every name.
"""

import re
from collections import Counter

from pyspark.sql import functions as F

PIECE = 5  # characters of an index piece

_SPECIAL = set("\\.^$*+?{}[]|()")


def required_texts(pattern: str):
    """Plain texts that every match of the pattern holds; none if the pattern has alternatives.

    A character before a sign that may leave it out doesn't count, nor does what stands in
    brackets, braces, or a group."""
    if "|" in pattern or "(?" in pattern:
        return []
    texts, now, depth, i = [], "", 0, 0
    closing = {"[": "]", "{": "}"}
    while i < len(pattern):
        c = pattern[i]
        if c in closing:
            i = pattern.index(closing[c], i + 1) + 1
            if c == "{":
                now = now[:-1]
            texts, now = texts + [now], ""
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if c == "\\":
            i += 1
        elif c in "*?":
            now = now[:-1]
        if c in _SPECIAL or depth:
            texts, now = texts + [now], ""
        else:
            now += c
        i += 1
    return [t for t in texts + [now] if t]


def rule_pieces(rules):
    """For each rule the piece it is filed under, or None."""
    grams = []
    for pattern, _ in rules:
        grams.append({t[i:i + PIECE] for t in required_texts(pattern) for i in range(len(t) - PIECE + 1)})
    often = Counter(g for own in grams for g in own)
    return [min(own, key=lambda g: (often[g], g)) if own else None for own in grams]


def canonical_names(df, column: str, rules, out: str):
    """``df`` with ``out``, the column after the rules: in their order, each only where it matches
    the original value, and on what the rules before it left.

    Each distinct name is worked on once; hot names therefore cost no more than others.
    """
    spark = df.sparkSession
    pieces = rule_pieces(rules)
    filed = [(p, i) for i, p in enumerate(pieces) if p is not None]
    always = F.array(*[F.lit(i) for i, p in enumerate(pieces) if p is None]).cast("array<int>")
    index = spark.createDataFrame(filed or [("", -1)], "_piece string, _rule int")
    names = df.select(F.col(column).alias("_name")).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("_name") - PIECE + 1, F.lit(1)))
    held = names.select("_name", F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.substr(F.col("_name"), i, F.lit(PIECE))))).alias("_piece"))
    met = held.join(index, "_piece").groupBy("_name").agg(F.collect_set("_rule").alias("_met"))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r.replace("\\", "\\\\").replace("$", "\\$")).alias("r"))
                      for p, r in rules])
    own = F.array_sort(F.concat(F.coalesce("_met", F.array().cast("array<int>")), always))

    def apply(text, i):
        rule = F.element_at(table, i + 1)
        return F.when(F.rlike(F.col("_name"), rule["p"]), F.regexp_replace(text, rule["p"], rule["r"])).otherwise(text)

    done = names.join(met, "_name", "left").select("_name", F.aggregate(own, F.col("_name"), apply).alias(out))
    return df.join(done, F.col(column).eqNullSafe(F.col("_name")), "left").drop("_name")
