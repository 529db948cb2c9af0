"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  A window is
``window`` consecutive words of one item; an item of fewer words, but not none, is one window
as a whole.  The automaton holds all items' word sequences; a document's words are streamed
through it, tracking the longest suffix (up to a window) that occurs in some item, and every word
inside an occurrence of a window is hit.  The walk is linear in the words, also where one repeats.

Only stretches of words whose neighbours follow each other in some item can hold a window of two
or more words, so the automaton walks those stretches alone.  The items are taken in blocks of
at most ``block_words`` words, so the automaton a task holds has a fixed bound; each block is
one pass over the documents, and the passes' hits are united per document.  A worker builds a
block's automaton once.

Defined results: null or empty texts and items have no words; documents without words get a row
with no hits; repeated rows get a row each (equal rows are alike); empty tables give no rows, or
no hits; a null ``item_id`` takes part in hits but not in the list of items; other columns of
either table are carried by ``clean`` and ignored otherwise.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common
from .common import written
from .wordhash import NOT_ALNUM, word_hashes


class Automaton:
    """Suffix automaton of several word sequences (word numbers from 0)."""

    def __init__(self, items, window: int):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._own_items(items)

    def _state(self, length, moves, link):
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p, w, q):
        """State for the shorter strings of ``q`` that ``p`` leads to."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last, w):
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def _own_items(self, items):
        """Items that hold a window ending in a state, and short items that are a state."""
        self.holders, self.short = [[] for _ in self.next], [[] for _ in self.next]
        for number, words in enumerate(items):
            state = length = 0
            for w in words:
                state, length = self._follow(state, length, w)
                if length == self.window and (not self.holders[state] or self.holders[state][-1] != number):
                    self.holders[state].append(number)
            if 0 < len(words) < self.window:
                self.short[state].append((len(words), number))
        # The next state on the suffix path that is a short item, -1 if none.
        self.shorter = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.shorter[state] = up if self.short[up] else self.shorter[up]

    def _follow(self, state, length, w):
        """The state of the longest suffix, of ``window`` words at most, after one more word.  The
        suffix is cut as it grows, so steps back are never taken twice."""
        moves, link, lengths = self.next, self.link, self.length
        while state and w not in moves[state]:
            state = link[state]
            length = lengths[state]
        if w not in moves[state]:
            return 0, 0
        state, length = moves[state][w], min(length + 1, self.window)
        while lengths[link[state]] >= length:
            state = link[state]
        return state, length

    def scan(self, words):
        """Hit marks of the words, and the items whose windows occur."""
        hit, found, full = np.zeros(len(words) + 1, np.int64), set(), set()
        state = length = 0
        window, short, shorter = self.window, self.short, self.shorter
        for i, w in enumerate(words):
            state, length = self._follow(state, length, w)
            if length >= window:
                full.add(state)
                hit[i + 1 - window] += 1
                hit[i + 1] -= 1
            at = state if short[state] else shorter[state]
            while at > 0:
                for m, number in short[at]:
                    if m <= length:
                        found.add(number)
                        hit[i + 1 - m] += 1
                        hit[i + 1] -= 1
                at = shorter[at]
        for at in full:
            found.update(self.holders[at])
        return np.cumsum(hit[:-1]) > 0, found


class Matcher:
    """The automaton of a block of items, with the filters that find where to walk it."""

    def __init__(self, texts, window: int):
        column = pa.array([t or "" for t in texts], pa.string())
        words, bounds, _, _ = word_hashes(*common.column_bytes(column), NOT_ALNUM)
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        items = [numbers[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        self.least = min((min(len(x), window) for x in items if x), default=0)
        self.automaton = Automaton(items, window)
        follows = numbers[:-1].astype(np.int64) * len(self.vocabulary) + numbers[1:]
        inner = np.ones(len(words), bool)
        inner[bounds[1:-1][bounds[1:-1] < len(words)] - 1] = False  # an item's last word has no successor
        self.follows = np.unique(follows[inner[:-1]]) if len(words) > 1 else np.zeros(0, np.int64)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def rows(self, words, bounds):
        """Per row: hit marks and items, for rows that have any."""
        if not self.least or not len(words):
            return
        known = self.low[(words & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(known)
        number = np.full(len(words), -1, np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        right = self.vocabulary[place] == words[at]
        number[at[right]] = place[right]
        known = number >= 0
        joined = known[:-1] & known[1:]
        joined[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))] - 1] = False
        pair = np.flatnonzero(joined)
        code = number[pair] * len(self.vocabulary) + number[pair + 1]
        if len(self.follows):
            place = np.minimum(np.searchsorted(self.follows, code), len(self.follows) - 1)
            joined[pair] = self.follows[place] == code
        else:
            joined[pair] = False
        # Maximal stretches of joined words, as word positions [start, end).
        start = np.flatnonzero(known & np.concatenate(([True], ~joined)))
        end = np.flatnonzero(known & np.concatenate((~joined, [True]))) + 1
        long = end - start >= self.least
        start, end = start[long], end[long]
        row = np.searchsorted(bounds, start, side="right") - 1
        for r in np.unique(row):
            marks, found = np.zeros(bounds[r + 1] - bounds[r], bool), set()
            for a, b in zip(start[row == r].tolist(), end[row == r].tolist()):
                own, items = self.automaton.scan(number[a:b].tolist())
                marks[a - bounds[r]:b - bounds[r]] |= own
                found |= items
            if found:
                yield r, marks, found


def _blocks(benchmark, block_words: int):
    """The items in blocks of about ``block_words`` words, one block on the driver at a time."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    count = max(1, -(-total // block_words))
    items = benchmark.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for block in range(count):
        rows = items.filter(F.col("block") == block).select(F.col("item_id").cast("string").alias("item_id"), "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


FOUND = {"n_words": "bigint", "hit_words": "array<bigint>", "hit_items": "array<string>"}


def hits(docs, benchmark, window: int = 10, block_words: int = 1_000_000):
    """All columns of ``docs`` (one of a clashing name gives way) plus ``n_words``, ``hit_words``
    (word numbers) and ``hit_items``.  Passes follow each other, each over one block of items."""
    kept = [n for n in docs.columns if n not in FOUND]
    return _hits(docs.select(*(f"`{n}`" for n in kept)), benchmark, window, block_words, tuple(FOUND))[0]


def _hits(docs, benchmark, window, block_words, names):
    """``hits`` with the new columns under ``names``, and the broadcast blocks of items."""
    kinds = list(FOUND.values())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema),
                        *(f"`{n}` {k}" for n, k in zip(names, kinds))])
    marked = docs.select("*", F.lit(0).cast(kinds[0]).alias(names[0]), F.array().cast(kinds[1]).alias(names[1]),
                         F.array().cast(kinds[2]).alias(names[2]))
    blocks = []
    for k, block in enumerate(_blocks(benchmark, block_words)):
        marked = written(marked, "marked") if k else marked
        blocks.append((f"{uuid.uuid4().hex}", docs.sparkSession.sparkContext.broadcast(block)))
        marked = common.map_batches(marked, _marker(blocks[-1], window, names), schema, "matchers")
    return marked, blocks


_matchers = common.caches.setdefault("matchers", {})


def _matcher(block, window):
    """A block's ids and matcher; a worker builds it once and keeps the last."""
    key, shared = block
    if (key, window) not in _matchers:
        _matchers.clear()
        ids, texts = shared.value
        _matchers[key, window] = ids, Matcher(texts, window)
    return _matchers[key, window]


def _marker(block, window: int, added):
    def mark(batches):
        ids, matcher = _matcher(block, window)
        for batch in common.text_slices(batches):
            words, bounds, _, _ = word_hashes(*common.column_bytes(batch.column("text")), NOT_ALNUM)
            hit_words, items = batch.column(added[1]).to_pylist(), batch.column(added[2]).to_pylist()
            for r, marks, found in matcher.rows(words, bounds):
                hit_words[r] = sorted({*hit_words[r], *np.flatnonzero(marks).tolist()})
                items[r] = sorted({*items[r], *(ids[i] for i in found if ids[i] is not None)})
            names = batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.diff(bounds), pa.int64()),
                 pa.array(hit_words, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                [*names, *added])
    return mark


def report(docs, benchmark, window: int = 10, block_words: int = 1_000_000):
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = hits(docs.select("doc_id", "text"), benchmark, window, block_words)
    return marked.select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def _without(text, own):
    """The bytes of a text without the spans of the words ``own`` (numbers, ascending)."""
    _, _, starts, ends = word_hashes(text, np.array([0, len(text)]), NOT_ALNUM)
    keep = np.ones(len(text), bool)
    breaks = np.flatnonzero(np.diff(own) > 1)
    for a, b in zip([own[0], *own[breaks + 1]], [*own[breaks], own[-1]]):
        keep[starts[a]:ends[b]] = False
    return text[keep]


def clean(docs, benchmark, window: int = 10, max_coverage: float = 0.5, block_words: int = 1_000_000):
    """The documents without their hit spans, in the columns of ``docs``; those with more than
    ``max_coverage`` of their words hit are dropped whole.

    Where a span goes, the words on its two sides come together, so a text that was cut is
    matched again, against every block, until nothing is hit."""
    added = []
    for name in FOUND:
        while name in docs.columns:
            name += "_"
        added.append(name)
    marked, blocks = _hits(docs, benchmark, window, block_words, added)
    names = docs.columns

    def again(text):
        """The bytes of a text after all cuts."""
        cut = True
        while cut:
            cut = False
            for block in blocks:
                words, bounds, _, _ = word_hashes(text, np.array([0, len(text)]), NOT_ALNUM)
                for _, marks, _ in _matcher(block, window)[1].rows(words, bounds):
                    text, cut = _without(text, np.flatnonzero(marks)), True
        return text

    def cut(batches):
        for batch in common.text_slices(batches):
            data, offsets = common.column_bytes(batch.column("text"))
            hit = batch.column(added[1])
            some = np.flatnonzero(np.asarray(hit.value_lengths()) > 0)
            if len(some):
                texts = batch.column("text").to_pylist()
                for r in some:
                    own = np.asarray(hit[int(r)].as_py())
                    texts[r] = again(_without(data[offsets[r]:offsets[r + 1]], own)).tobytes().decode("utf-8")
                column = pa.array(texts, batch.schema.field("text").type)
            else:
                column = batch.column("text")
            yield pa.RecordBatch.from_arrays([column if n == "text" else batch.column(n) for n in names], names)

    kept = marked.filter(F.size(added[1]) <= max_coverage * F.col(added[0]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_batches(kept, cut, schema, "matchers")
