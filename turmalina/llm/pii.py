"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers; their spans
are always kept.  They also seed the method: the words around identifier-like tokens, as they are
or by their class with the token's own form, are patterns, and Spark scores the graph of patterns
and instances in turns.  A pattern is worth the share of its distinct instances that are of a
kind; an instance is worth what its patterns say together (noisy or), seeds staying at 1.
Patterns of high confidence then mark the tokens that the fixed patterns missed.

A kept pattern needs ``min_support`` seed instances, at any size of the input.  Up to ``MOST``
kept patterns go to the tasks; more are joined with the documents' patterns in Spark.

Spans are ``kind:start:end`` in code points, end exclusive, by kind as listed, then start.
Defined results: null and empty texts have no spans; repeated rows get a row each, but equal
instances count once; a text is read whole in linear time, and neighbours of more than 40
characters are of one class; an empty table gives no rows; other columns are kept by ``mask`` and
ignored otherwise.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common
from .common import written

KINDS = ("email", "ip", "card", "phone")
MOST = 200_000
SALTS = 16  # parts of a pattern in the join
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The stated patterns; possessive where giving back could never help, so long runs stay linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
NUMBERS = re.compile(r"[+(]?[0-9][0-9().-]*+(?:\x20[().-]*+[0-9][0-9().-]*+)+")
WORD = re.compile(r"\S++")
LONG = 40  # a neighbour of more characters is of the class of long words
RUN = re.compile(r"[0-9]+|[^\W\d_]+")
EDGE = ".,;:!?\"'<>[]{}*#&$%|/\\"


def _emails(text):
    """Leftmost matches of local@domain, found from each @."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """The fixed patterns' spans (kind number, start, end), in order."""
    if not text or not SIGN.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def _identifiers(text):
    """Spans of the words with a digit or @, and of numbers in several parts; each is found from
    its first such sign, so runs without one cost nothing."""
    at = 0
    sign = SIGN.search(text)
    while sign:
        start = sign.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        found = NUMBERS.match(text, start) or WORD.match(text, start)
        yield found.span()
        at = found.end()
        sign = SIGN.search(text, at)


def _class(word):
    """The class of a neighbour."""
    if not word:
        return "none"
    if any(c.isdigit() for c in word):
        return "number"
    if not any(c.isalpha() for c in word):
        return "sign"
    return "small" if word == word.lower() else "big" if word == word.upper() else "title"


def _neighbours(text, starts, ends, a, b):
    """The two words before a span and the one after it; a part of a word counts as one."""
    out = []
    i = bisect_left(starts, a) - 1
    if i >= 0 and ends[i] >= a:
        out.append((starts[i], a))
        i -= 1
    while len(out) < 2 and i >= 0:
        out.append((starts[i], ends[i]))
        i -= 1
    j = bisect_right(ends, b)
    after = (max(starts[j], b), ends[j]) if j < len(ends) else (b, b)
    words = ["*long*" if y - x > LONG else text[x:y] for x, y in (*out, after)]
    return [""] * (2 - len(out)) + words[-2::-1] + words[-1:]


def _shape(value):
    return "mail" if "@" in value else "number" if not any(c.isalpha() for c in value) else "mixed"


def _form(value):
    """The runs of digits and letters with their lengths, and the signs between them."""
    if len(value) > LONG:
        return "*long*"
    return RUN.sub(lambda m: f"{'9' if m.group()[0].isdigit() else 'a'}{len(m.group())}", value)


def mentions(text, base):
    """Identifier-like spans with their patterns: (kind number or -1, start, end, patterns).

    Patterns are lexical (the two words before; the word before and after), by classes of the
    neighbours, and by the class of the word before alone, the last two with the span's form."""
    if not text or not SIGN.search(text):
        return
    spans, covered = list(base), sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in covered], np.int64)
    most = np.maximum.accumulate([b for _, b in covered]) if covered else None
    for a, b in _identifiers(text):
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        before = int(np.searchsorted(starts, b))  # base spans that begin before the end
        if b - a >= 5 and not (before and most[before - 1] > a):
            spans.append((-1, a, b))
    if not spans:
        return
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for kind, a, b in spans:
        two, one, after = _neighbours(text, starts, ends, a, b)
        value = text[a:b]
        shape, form = _shape(value), _form(value)
        yield kind, a, b, (f"{two.lower()} {one.lower()} _{shape}", f"{one.lower()} _{shape} {after.lower()}",
                           f"<{_class(one)}> _{form} <{_class(after)}>", f"<{_class(one)}> _{form}")


def _edges(docs):
    """Rows (pattern, instance, kind or null), distinct."""
    def find(batches):
        for batch in common.text_slices(batches):
            patterns, instances, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                for kind, a, b, own in mentions(text, base_spans(text)):
                    value = re.sub(r"[\s().-]", "", text[a:b].lower())
                    key = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)
                    for p in own:
                        patterns.append(p)
                        instances.append(key)
                        kinds.append(KINDS[kind] if kind >= 0 else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns, pa.string()), pa.array(instances, pa.int64()), pa.array(kinds, pa.string())],
                ["pattern", "instance", "kind"])

    found = common.map_batches(docs.select("text"), find, "pattern string, instance bigint, kind string")
    return found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def learn(docs, rounds: int = 3, confidence: float = 0.9, min_support: int = 10, most: int = MOST):
    """The patterns of high confidence: a dict from pattern to kind, or a table of both if there
    are more than ``most``."""
    edges = written(_edges(docs), "edges")
    seeds = edges.filter("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = written(seeds, "seeds")
    links = edges.select("pattern", "instance")
    sizes = written(links.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support), "sizes")
    links = written(links.join(sizes, "pattern"), "links")  # smaller patterns can't have the support
    scores, patterns = seeds, None
    for _ in range(rounds):
        patterns = (links.join(scores, "instance").groupBy("pattern", "kind", "n")
                    .agg(F.sum("score").alias("sum"), F.sum((F.col("score") == 1.0).cast("long")).alias("seeds"))
                    .filter(F.col("seeds") >= min_support).withColumn("confidence", F.col("sum") / (F.col("n") + 1)))
        patterns = written(patterns, "patterns")
        said = (links.select("pattern", "instance").join(patterns.select("pattern", "kind", "confidence"), "pattern")
                .join(seeds.select("instance"), "instance", "left_anti").groupBy("instance", "kind")
                .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")))
        scores = written(seeds.select("instance", "kind", "score").unionByName(said), "scores")
    kept = patterns.filter(F.col("confidence") >= confidence).groupBy("pattern").agg(
        F.max(F.struct("confidence", "kind")).alias("best")).select("pattern", "best.kind")
    kept = written(kept, "kept")
    first = kept.limit(most + 1).collect()
    return {r["pattern"]: r["kind"] for r in first} if len(first) <= most else kept


def _with_own(docs, patterns):
    """The documents with their kept patterns in a column, or those to broadcast.

    Of the documents' patterns only the kept ones come back, so nothing is held whole in a task."""
    if isinstance(patterns, dict):
        return docs, docs.sparkSession.sparkContext.broadcast(patterns)
    docs = written(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"), F.col("text"),
                               F.monotonically_increasing_id().alias("_row")), "rows")

    def find(batches):
        for batch in common.text_slices(batches):
            ids, own = [], []
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist()):
                found = {p for kind, _, _, two in mentions(text, base_spans(text)) if kind < 0 for p in two}
                own += found
                ids += [row] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.string())], ["_row", "pattern"])

    held = common.map_batches(docs.select("_row", "text"), find, "_row bigint, pattern string")
    held = held.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    table = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = held.join(table, ["pattern", "salt"]).groupBy("_row").agg(F.collect_list(F.struct("pattern", "kind")).alias("_own"))
    return docs.join(own, "_row", "left").select("_doc", "text", "_own"), None


def _own_patterns(batch, shared):
    """The patterns to look up for each text of the batch."""
    if shared is not None:
        return [shared.value] * batch.num_rows
    return [{r["pattern"]: r["kind"] for r in own or ()} for own in batch.column("_own").to_pylist()]


def _column(batch, name):
    """A document's own column, which the joined form holds in a struct."""
    return batch.column("_doc").field(name) if batch.schema.names == ["_doc", "text", "_own"] else batch.column(name)


def all_spans(text, patterns):
    """(base spans, base and learnt spans), each in order."""
    base = base_spans(text)
    if not patterns:
        return base, base
    more = set(base)
    for kind, a, b, own in mentions(text, base):
        if kind < 0:
            said = [patterns[p] for p in own if p in patterns]
            if said:
                more.add((KINDS.index(said[0]), a, b))
    return base, sorted(more)


def _line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(docs, patterns):
    """Per document: counts of the base spans, their digest, and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, shared = _with_own(docs.select("doc_id", "text"), patterns)

    def rows(batches):
        for batch in common.text_slices(batches):
            counts, digests, lines = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), _own_patterns(batch, shared)):
                base, spans = all_spans(text, own)
                counts.append([sum(k == i for k, _, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(spans))
            counts = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), *(pa.array(counts[:, i]) for i in range(4)),
                 pa.array(digests, pa.string()), pa.array(lines, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return common.map_batches(docs, rows, schema)


def mask(docs, patterns):
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans
    the earlier one's kind stands for their union."""
    schema, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), docs.columns
    docs, shared = _with_own(docs, patterns)

    def rows(batches):
        for batch in common.text_slices(batches):
            texts, owns = batch.column("text").to_pylist(), _own_patterns(batch, shared)
            for i, text in enumerate(texts):
                spans = sorted((a, b, k) for k, a, b in all_spans(text, owns[i])[1])
                if not spans:
                    continue
                out, at = [], 0
                for a, b, k in spans:
                    if a >= at:
                        out += [text[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                texts[i] = "".join([*out, text[at:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, batch.column("text").type) if n == "text" else _column(batch, n) for n in names], names)

    return common.map_batches(docs, rows, schema)
