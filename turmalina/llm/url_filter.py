"""URL filtering by fixed host and path rules, and by association rules for what they leave open.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
what follows up to ``?``, ``#`` or the end.  A fixed rule fits its host and all subdomains where
the path starts with the rule's; the longest (host and path together) wins.

Where no fixed rule fits, the method decides.  Labelled pages are transactions of their URL's
tokens (host labels and endings, path parts, query keys) plus the label; Spark's FP-growth mines
the combinations (of long URLs: joins, level by level, with the same result), and rules ``tokens -> block`` that reach ``min_confidence``, ``min_support``
(but at least ``min_count`` bad pages) and a lift over 1 are kept, but for those that a rule of
fewer tokens already covers.  They are applied by an inverted index that has each rule under its
rarest token: a rule fits where a page holds all its tokens, and a page with any fitting rule is
blocked.  A page's labels are those of the document it shows, whose number its path ends in.

Defined results: a url that is null or has no ``://`` has an empty host and path, no tokens and
the verdict allow; repeated rows get a row each; without labels nothing is learnt and the method
allows; of rules of one confidence the first by its items is named; an empty table gives no
rows; other columns are ignored.
"""

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from .common import written

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MOST = 12  # frequent tokens of a page up to which FP-growth takes it on
BAD = "=block"  # the label's item; no token begins like this


def parts(pages):
    """``pages`` with ``host`` and ``path``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (pages.withColumn("host", F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), upper, lower))
            .withColumn("path", F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)))


def fixed_rule(rules=RULES):
    """The fitting rule with the longest host and path as a struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))).otherwise(out)
    return out


def tokens():
    """Distinct tokens of a URL; digits in path parts read as one kind of part."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    path = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(
        F.array(F.concat(F.lit("site:"), "host")), F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(path, lambda x: F.concat(F.lit("path:"), x)), F.transform(keys, lambda x: F.concat(F.lit("key:"), x)))))


def _merged(held, least: int):
    """Rows (page, token) of frequent tokens, one of those that the same pages hold (the first by
    name), with ``pages``, how many hold it."""
    counts = (held.groupBy("token").agg(F.count("*").alias("pages"), F.sum(F.xxhash64("page").cast("decimal(38,0)")).alias("h1"),
                                        F.bit_xor(F.xxhash64(F.lit(1), "page")).alias("h2"))
              .filter(F.col("pages") >= least))
    kept = counts.groupBy("pages", "h1", "h2").agg(F.min("token").alias("token")).select("token", "pages")
    return held.join(kept, "token")


def _levels(held, seen, least: int, min_confidence: float, base: float):
    """Rules (items, confidence, lift) of two and more tokens, found level by level and exactly.

    ``held`` has the rows (page, bad, token), ``seen`` the counts of each token.  A combination
    goes on where it has ``least`` bad pages, is no rule yet (larger ones are covered by it) and is
    on fewer pages than each combination of one token less (else one without that token is on the
    same pages).  A level joins two combinations that differ in their last token, page by page, so
    a task holds no page's combinations together."""
    spark = held.sparkSession
    found = spark.createDataFrame([], "items array<string>, confidence double, lift double")
    counts = seen.select(F.array("token").alias("items"), "pages")
    on = held.select("page", "bad", F.array("token").alias("items"))
    size = 1
    while True:
        size += 1
        # Known first: pairs whose every part of one token less goes on.
        head = F.slice("items", 1, size - 2)
        ends = counts.select("items", head.alias("head"), F.element_at("items", -1).alias("last"))
        x, y = ends.alias("x"), ends.alias("y")
        pairs = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.last") < F.col("y.last"))).select(
            F.col("x.items").alias("left"), F.col("y.items").alias("right"),
            F.concat("x.items", F.array("y.last")).alias("items"))
        if size > 2:
            parts = pairs.select("items", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter(
                F.col("items"), lambda t, k: k != i))).alias("part"))
            whole = parts.join(counts.select(F.col("items").alias("part")), "part").groupBy("items").count().filter(F.col("count") == size)
            pairs = pairs.join(whole.select("items"), "items")
        both = on.select("page", "bad", F.col("items").alias("left")).join(pairs, "left").join(
            on.select("page", F.col("items").alias("right")), ["page", "right"]).select("page", "bad", "items")
        on = written(both, "level")
        stats = on.groupBy("items").agg(F.count("*").alias("pages"), F.sum(F.col("bad").cast("long")).alias("bads")) \
            .filter(F.col("bads") >= least).withColumn("confidence", F.col("bads") / F.col("pages"))
        is_rule = (F.col("confidence") >= min_confidence) & (F.col("confidence") / base > 1)
        stats = written(stats.withColumn("rule", is_rule), "counts")
        found = found.union(stats.filter("rule").select("items", "confidence", (F.col("confidence") / base).alias("lift")))
        parts = stats.filter("NOT rule").select("items", "pages", F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter(F.col("items"), lambda t, k: k != i))).alias("part"))
        less = parts.join(counts.select(F.col("items").alias("part"), F.col("pages").alias("above")), "part")
        counts = written(less.groupBy("items", "pages").agg(F.min("above").alias("above")).filter("pages < above")
                         .select("items", "pages"), "going")
        if counts.isEmpty():
            return found
        on = on.join(counts.select("items"), "items", "left_semi")


def mine(labelled, min_support: float = 0.001, min_confidence: float = 0.5, min_count: int = 5, most: int = MOST):
    """Rules (rule_id, items, key, confidence, lift) that block, from columns ``tokens`` and ``bad``.

    ``key`` is the rarest of the items.  Tokens that the same pages hold count as one.  FP-growth
    gets every page whole where none has more than ``most`` tokens that matter; the combinations of
    longer pages would be too many, so there ``_levels`` looks for the rules that none of fewer
    tokens covers.  Both count all pages and give the same rules.  Every token makes a rule of its
    own by a plain count.  A token that is a rule, or that all pages hold, is in no larger rule
    that is kept, so the combinations go without it."""
    spark = labelled.sparkSession
    empty = "rule_id bigint, items array<string>, key string, confidence double, lift double"
    pages = written(labelled.filter(F.size("tokens") > 0).select("tokens", "bad")
                    .withColumn("page", F.monotonically_increasing_id()), "labelled")
    count, bads = pages.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    least = max(min_count, math.ceil(min_support * count))
    if not bads or count < least:
        return spark.createDataFrame([], empty)
    base = bads / count
    held = written(_merged(pages.select("page", "bad", F.explode("tokens").alias("token")), least), "held")
    seen = written(held.groupBy("token").agg(F.first("pages").alias("pages"), F.sum(F.col("bad").cast("long")).alias("bads")), "seen")
    single = (seen.withColumn("confidence", F.col("bads") / F.col("pages"))
              .filter((F.col("bads") >= least) & (F.col("confidence") >= min_confidence) & (F.col("confidence") > base))
              .select(F.array("token").alias("items"), "confidence", (F.col("confidence") / base).alias("lift")))
    # Support is counted among the pages that hold a frequent token.
    fewest = max(1, math.ceil(least / count * held.select("page").distinct().count()))
    open_tokens = seen.join(single.select(F.element_at("items", 1).alias("token")), "token", "left_anti").filter(
        (F.col("pages") < count) & (F.col("bads") >= fewest))
    held = written(held.select("page", "bad", "token").join(open_tokens.select("token"), "token"), "open")
    # A page has as many tokens as its URL has parts.
    items = held.groupBy("page").agg(F.first("bad").alias("bad"), F.array_sort(F.collect_list("token")).alias("own"))
    transactions = written(items.select(F.when(F.col("bad"), F.concat("own", F.array(F.lit(BAD)))).otherwise(F.col("own")).alias("items"),
                                        F.size("own").alias("n")), "urls")
    longest, n = transactions.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if longest <= most:
        share = min(1.0, (fewest - 0.5) / max(n, 1))  # rounded up to ``fewest`` pages
        model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(transactions)
        several = (model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") > 1))
                   .select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("confidence") / base).alias("lift"))
                   .filter("lift > 1"))
    else:
        several = _levels(held, open_tokens.select("token", "pages"), fewest, min_confidence, base)
    rules = written(single.union(several).withColumn("rule_id", F.monotonically_increasing_id()), "found")
    parts = rules.select("rule_id", F.explode("items").alias("token")).join(seen.select("token", "pages"), "token")
    rules = written(rules.join(parts.groupBy("rule_id").agg(F.min(F.struct("pages", "token")).alias("rare")), "rule_id")
                    .select("rule_id", "items", F.col("rare.token").alias("key"), "confidence", "lift"), "rules")
    # A rule falls where a rule with some of its items exists: those are met by more pages.
    wide = rules.select(F.col("items").alias("fewer"), "key")
    long = rules.select("rule_id", "items", F.explode("items").alias("key"))
    covered = (long.join(wide, "key").filter((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0))
               .select("rule_id").distinct())
    return rules.join(covered, "rule_id", "left_anti")


def blocked(pages, rules):
    """The key and best rule (by confidence, then items) of pages that hold all tokens of some
    rule.  The index has each rule once, under its rarest token."""
    held = pages.select(F.col("key").alias("page"), "tokens", F.explode("tokens").alias("key"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "items", "rule_id")).alias("best")
    return (held.join(rules.select("rule_id", "items", "confidence", "key"), "key")
            .filter(F.size(F.array_except("items", "tokens")) == 0).groupBy("page").agg(best)
            .select(F.col("page").alias("key"), F.col("best.rule_id").alias("method_rule"), F.col("best.items").alias("method_items")))


def document_of(path):
    """The document that a page shows: the number that begins the last part of its path."""
    return F.regexp_extract(path, r"(?s)/([0-9]{1,18})[^/]*/?$", 1).try_cast("bigint")


def judge(pages, labels, rules=RULES, min_support: float = 0.001, min_confidence: float = 0.5,
          min_count: int = 5):
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the method's rule with its items.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``.  A page is labelled where it shows a
    labelled document, and bad where any of its labels is toxic or of no quality.
    """
    urls = parts(pages.select("page_id", "url")).withColumn("tokens", tokens())
    bad = labels.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)), F.lit(False)).alias("bad"))
    labelled = urls.withColumn("doc_id", document_of(F.col("path"))).join(bad, "doc_id").select("tokens", "bad")
    mined = written(mine(labelled, min_support, min_confidence, min_count), "mined")
    judged = urls.withColumn("fixed", fixed_rule())
    # Equal urls are judged once.
    open_urls = judged.filter("fixed IS NULL").groupBy("url").agg(F.first("tokens").alias("tokens"))
    hits = blocked(open_urls.withColumn("key", F.col("url")), mined).withColumnRenamed("key", "url")
    return judged.join(hits, "url", "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("method_rule").isNotNull() & F.col("fixed").isNull(), "block"),
                   F.lit("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("method_rule")).alias("method_rule"),
        F.when(F.col("fixed").isNull(), F.col("method_items")).alias("method_items"))
