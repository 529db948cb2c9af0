"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts (orders 0 to ``order``) is counted over
the learning documents.  A byte costs what PPM with escape method C and exclusions takes: the
longest context that has seen it codes it, each longer one an escape, and bytes that a longer
context has seen don't count in the shorter ones; what no context has seen is coded evenly.
With the statistics frozen, the cost is a fixed function of a byte and the ``order`` bytes
before it, and a text's exact code length is a sum of look-ups.  The language with the shortest
code wins, and the score is its share of ``2 ** -length`` over the languages (their prior being
equal).

A-Z are lower-cased, and every other byte value is a symbol of its own.  Only contexts that occur
are counted and kept, in sorted arrays per language.  Costs of the ``cached`` most frequent grams
are laid out once; those of all others are computed from the arrays as they come, to the same
values.  A text starts in the context of blanks.

Defined results: ``und`` with score 0 for a text that is null or has no letter; equal code
lengths go to the language that sorts first; with no learning documents every text is ``und``;
repeated rows get a row each; an empty table gives no rows; other columns are ignored by
``identify`` and kept by ``known``.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common
from .wordhash import LOWER

SYMBOLS = 256
ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
LIST = 1 << 15  # entries of a row that carries counts
HELD = 2_000_000  # grams a task holds before it adds them up, or passes them on
CACHED = 1 << 19  # grams whose costs are laid out


def _grams(data, offsets, order):
    """The code of each byte with the ``order`` bytes before it; a row starts after blanks."""
    lowered = LOWER[data]
    code = lowered.astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for back in range(1, order + 1):
        before = np.empty(len(data), np.uint8)
        before[back:] = lowered[:-back] if back < len(data) else lowered[:0]
        before[:back] = 32
        for k in range(back):
            at = starts + k
            before[at[at < len(data)]] = 32  # a short row's marks reach the next row's start, also blank
        code |= before.astype(np.uint32) << np.uint32(8 * back)
    return code


def _added(parts):
    """Distinct grams and their counts, of several such pairs of arrays."""
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    sums = np.zeros(len(grams), np.int64)
    np.add.at(sums, inverse, np.concatenate([n for _, n in parts]))
    return grams, sums


def gram_counts(docs, order: int = ORDER):
    """Rows (lang, gram, n) over all documents, of the grams that occur."""

    def rows(lang, grams, counts):
        for at in range(0, len(grams), LIST):
            part = grams[at:at + LIST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(counts[at:at + LIST])],
                ["lang", "gram", "n"])

    def count(batches):
        parts, held = {}, 0
        for batch in common.text_slices(batches):
            data, offsets = common.column_bytes(batch.column("text"))
            if not len(data):
                continue
            code = _grams(data, offsets, order)
            langs = batch.column("lang").dictionary_encode()
            of_row = np.asarray(langs.indices)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.unique(code[np.repeat(of_row == i, np.diff(offsets))], return_counts=True)
                parts.setdefault(lang, []).append(own)
                held += len(own[0])
            if held > HELD:
                parts = {lang: [_added(own)] for lang, own in parts.items()}
                held = sum(len(own[0][0]) for own in parts.values())
            if held > HELD // 2:
                for lang, own in parts.items():
                    yield from rows(lang, *_added(own))
                parts, held = {}, 0
        for lang, own in parts.items():
            yield from rows(lang, *_added(own))

    found = common.map_batches(docs.select("text", "lang"), count, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _place(keys, wanted):
    """Where each wanted key is in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Costs:
    """Bits of a byte after a context in one language, from the grams that occur.

    The nearest byte is the lowest digit of a context.  A context has seen all that the longer
    ones around it have, so what is excluded in it depends on the next longer context alone: each
    context keeps what coding and escaping cost in it, and what they cost in the next shorter
    one without its own symbols.
    """

    def __init__(self, grams, counts, symbols: int, order: int):
        self.symbols, self.order, self.levels = symbols, order, []
        above = None
        for depth in range(order + 1):
            keys, inverse = np.unique(grams.astype(np.int64) % symbols ** (depth + 1), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, inverse, counts)
            contexts, first = np.unique(keys // symbols, return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(keys)))
            whole, escape = self._bits(total, kinds, kinds == symbols)
            shorter = None
            if above is not None:
                a_keys, a_n, a_contexts, a_total, a_kinds = above
                own = np.add.reduceat(a_n[np.searchsorted(a_keys, keys % symbols ** depth)], first) if len(first) else n
                up = np.searchsorted(a_contexts, contexts % symbols ** (depth - 1))
                shorter = self._bits(a_total[up] - own, a_kinds[up] - kinds, a_kinds[up] == symbols)
            above = keys, n, contexts, total, kinds
            self.levels.append((keys.astype(np.uint32), np.log2(n), contexts.astype(np.uint32), whole, escape, shorter))
        self.left = np.log2(max(symbols - len(self.levels[0][0]), 1))

    def _bits(self, total, kinds, last):
        """Bits of the whole, and of an escape; none where nothing is left to escape to."""
        whole = np.log2(np.maximum(np.where(last, total, total + kinds), 1))
        return whole, np.where((kinds > 0) & ~last, whole - np.log2(np.maximum(kinds, 1)), 0.0)

    def of(self, grams):
        """Bits of each gram's last byte after the bytes before it."""
        bits = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        longer = np.full(len(grams), -1)  # place of the context one longer, if it has been seen
        for depth in range(self.order, -1, -1):
            keys, logs, contexts, whole, escape, _ = self.levels[depth]
            own = (grams[open_].astype(np.int64) % self.symbols ** (depth + 1))
            place, seen = _place(contexts, (own // self.symbols).astype(np.uint32))
            at, hit = _place(keys, own.astype(np.uint32))
            outer = longer[open_]
            within = outer >= 0
            code, leave = np.zeros(len(open_)), np.zeros(len(open_))
            bare = seen & ~within
            code[bare], leave[bare] = whole[place[bare]], escape[place[bare]]
            if within.any():
                shorter = self.levels[depth + 1][5]
                code[within], leave[within] = shorter[0][outer[within]], shorter[1][outer[within]]
            bits[open_[hit]] += code[hit] - logs[at[hit]]
            longer[open_] = np.where(seen, place, -1)
            bits[open_[~hit]] += leave[~hit]
            open_ = open_[~hit]
        bits[open_] += self.left
        return bits.astype(np.float32)


def code_lengths(counts, symbols: int, order: int):
    """Bits of each symbol after each full context, from the counts of one language."""
    grams = np.flatnonzero(counts)
    return Costs(grams, counts[grams], symbols, order).of(np.arange(symbols ** (order + 1)))


class Model:
    """Languages, their costs, and the laid-out costs (gram x language) of frequent grams."""

    ODD = np.uint32(0x9E3779B1)  # times an odd number: a bijection that spreads the grams
    BITS = 20

    def __init__(self, langs, costs, frequent, order):
        self.langs, self.costs, self.order = langs, costs, order
        spread = frequent.astype(np.uint32) * self.ODD
        by = np.argsort(spread)
        self.keys, frequent = spread[by], frequent[by]
        lead = (self.keys >> np.uint32(32 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.table = self._computed(frequent)

    def _computed(self, grams):
        return np.stack([c.of(grams) for c in self.costs], 1) if self.costs else np.zeros((len(grams), 0), np.float32)

    def bits(self, grams):
        """The costs (gram x language)."""
        spread = grams * self.ODD
        lead = (spread >> np.uint32(32 - self.BITS)).astype(np.int64)
        place, at, stop = np.full(len(grams), -1), self.first[lead], self.first[lead + 1]
        open_ = np.flatnonzero(at < stop)
        at, stop = at[open_], stop[open_]
        while len(open_):
            hit = self.keys[at] == spread[open_]
            place[open_[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < stop)
            open_, at, stop = open_[more], at[more], stop[more]
        others = np.flatnonzero(place < 0)
        if len(others) == len(grams):
            out = np.empty((len(grams), len(self.langs)), np.float32)
        else:
            out = self.table[place]
        if len(others):
            unique, inverse = np.unique(grams[others], return_inverse=True)
            out[others] = self._computed(unique)[inverse]
        return out


def learn(docs, order: int = ORDER, cached: int = CACHED) -> Model:
    """The model of ``text`` and a ``lang`` that isn't null.  The driver holds the grams that
    occur, whose number the languages bound, not the documents."""
    docs = docs.filter(F.col("lang").isNotNull()).select("text", "lang")
    rows = common.written(gram_counts(docs, order), "grams")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    costs = []
    for lang in langs:
        own = rows.filter(F.col("lang") == lang).select("gram", "n").toPandas()
        costs.append(Costs(own["gram"].to_numpy(), own["n"].to_numpy(), SYMBOLS, order))
    frequent = (rows.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(cached)
                .select("gram").toPandas()["gram"].to_numpy().astype(np.uint32))  # bounded by ``cached``
    return Model(langs, costs, frequent, order)


def _has_letter(text) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def identify(docs, model: Model, keep=("doc_id",), added=("lang_pred", "score")):
    """The columns ``keep`` with the prediction and its score under the names ``added``."""
    keep = [n for n in keep if n not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema),
                        f"`{added[0]}` string, `{added[1]}` double"])

    def rows(batches):
        model = shared.value
        langs = np.array([*model.langs, "und"], object)
        for batch in common.text_slices(batches):
            data, offsets = common.column_bytes(batch.column("text"))
            lettered = np.array([_has_letter(t.as_py()) for t in batch.column("text")], bool)
            best, score = np.full(batch.num_rows, len(langs) - 1), np.zeros(batch.num_rows)
            if model.langs and lettered.any():
                code = _grams(data, offsets, model.order)
                some = np.flatnonzero(np.diff(offsets) > 0)
                bits = np.zeros((batch.num_rows, len(model.langs)))
                bits[some] = np.add.reduceat(model.bits(code), offsets[:-1][some], axis=0, dtype=np.float64)
                best = np.where(lettered, bits.argmin(1), best)
                score = np.where(lettered, 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs[best], pa.string()), pa.array(score, pa.float64())],
                [*keep, *added])

    return common.map_batches(docs.select(*dict.fromkeys([*keep, "text"])), rows, schema)


def known(docs, learning):
    """The documents whose language can be told, unchanged."""
    added = []
    for name in ("lang_pred", "score"):
        while name in docs.columns:
            name += "_"
        added.append(name)
    found = identify(docs, learn(learning), tuple(docs.columns), added)
    return found.filter(F.col(added[0]) != "und").select(*(f"`{c}`" for c in docs.columns))
