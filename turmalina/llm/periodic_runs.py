"""Runs of words that repeat with a period, found by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a
length of at least ``max(least, power * q)`` that no neighbouring word extends keeping period q.

Method: a word that equals the word q before it lengthens the match on lag (diagonal) q by one;
a word that does not, ends it, and a match that is long enough is a run and is emitted there.
What keeps the table of active lags sparse is which earlier occurrences a word may use.  Lags are
taken in octaves, ``2 ** t <= q < 2 ** (t + 1)``, and on an octave a word stands for the block of
``2 ** (t + 1)`` words that begins at it.  A run is at least three periods long, so it holds
such a block and the block one period before.  No two blocks of one run that are less than q
apart are equal, because the block is no shorter than its smallest period; so the latest earlier
occurrence of the block is the only one that counts, each word has one active lag per octave,
and equal lags at consecutive words are one match.  Blocks of one octave are pairs of blocks of
the octave before, and only blocks that occur twice in their document go on to the next octave.
Time is ``n log n`` and memory ``n`` for n words, however often one word occurs.

Words are compared by 64-bit hashes of their bytes, blocks by hashes of their halves; two that
differ and share a hash would count as equal.

Defined results: a null or empty text, or one of blanks only, has no words, no runs, null
figures of the longest run, and digests of nothing.  Repeated rows and shared ids get a row each;
a very long text is worked on alone.  An empty table gives no rows; other columns are ignored.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common
from .wordhash import SPACE, mix, span_hashes, word_spans

LEAST, POWER = 6, 4


def _latest(names):
    """Where the latest earlier equal name is (-1: nowhere), and which names occur twice."""
    order = np.argsort(names, kind="stable")  # equal names stay in word order
    again = np.zeros(len(names), bool)
    again[1:] = names[order[1:]] == names[order[:-1]]
    before = np.full(len(names), -1, np.int64)
    before[order[again]] = order[np.flatnonzero(again) - 1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    kept = np.zeros(len(names), bool)
    kept[order[twice]] = True
    return before, kept


def periodic_runs(words, bounds, least: int = LEAST, power: int = POWER):
    """Rows, starts (word numbers of the row), lengths and periods of all runs, ordered by row,
    start, period.  ``words`` are the hashes of all rows' words, ``bounds`` the rows' bounds."""
    if power < 3:
        raise ValueError("a run must hold three periods at least")
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # The name of the block that begins at each word; words of two rows have different names.
    names = mix(words ^ mix(row.astype(np.uint64) + np.uint64(1)))
    alive = np.ones(len(words), bool)
    found = []
    block, low = 1, 1
    room = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    while power * low <= room and alive.any():
        # Blocks of twice the size: both halves occur twice, and lie in one row.
        at = np.flatnonzero(alive)
        half = at + block
        good = half < len(words)
        at, half = at[good], half[good]
        good = alive[half] & (row[half] == row[at]) & (half + block <= bounds[row[at] + 1])
        at, half = at[good], half[good]
        block *= 2
        joined = mix(names[at] * np.uint64(0x9FB21C651E98DF25) + mix(names[half] + np.uint64(block)))
        before, twice = _latest(joined)
        lag = np.where(before >= 0, at - at[before], 0)
        # The DP: consecutive words with one lag of this octave lengthen one match.
        on = (lag >= low) & (lag < 2 * low)
        p, q = at[on], lag[on]
        if len(p):
            fresh = np.ones(len(p), bool)
            fresh[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1]) | (row[p[1:]] != row[p[:-1]])
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(p)) - 1
            q, start = q[head], p[head] - q[head]
            length = p[tail] + block - start
            enough = (length >= least) & (length >= power * q)
            found.append((row[p[head]][enough], start[enough], length[enough], q[enough]))
        names = np.zeros(len(words), np.uint64)
        names[at] = joined
        alive = np.zeros(len(words), bool)
        alive[at[twice]] = True
        low *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    r, start, length, period = (np.concatenate(c) for c in zip(*found))
    start = start - bounds[r]
    order = np.lexsort((period, start, r))
    return r[order], start[order], length[order], period[order]


def redundant(n_words, starts, lengths, periods):
    """Which words of one row some run holds after its first period."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, starts + periods, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0


def planted(doc_id, n: int):
    """The word that stands at each place of a document, or None where its words stay: every
    tenth id (by crc32 of its decimal text; a null id is empty text) repeats a part of itself."""
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def _rows(batches, places):
    """Per row of the batches: its id, the bytes and spans of its words, and its runs."""
    for batch in common.text_slices(batches):
        data, offsets = common.column_bytes(batch.column("text"))
        starts, ends = word_spans(data, offsets, SPACE)
        bounds = np.searchsorted(starts, offsets)
        ids = batch.column("doc_id").to_pylist()
        order = np.arange(len(starts))
        if places is not None:
            for i, doc_id in enumerate(ids):
                own = places(doc_id, int(bounds[i + 1] - bounds[i]))
                if own is not None:
                    order[bounds[i]:bounds[i + 1]] = bounds[i] + own
        hashes = span_hashes(data, starts, ends)[order]
        row, start, length, period = periodic_runs(hashes, bounds)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        yield batch, data, starts[order], ends[order], bounds, [
            tuple(c[at[i]:at[i + 1]] for c in (start, length, period)) for i in range(len(ids))]


def runs(docs, places=None):
    """One row per run: ``doc_id``, ``start``, ``length``, ``period``."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches):
        for batch, _, _, _, _, per_row in _rows(batches, places):
            take = np.repeat(np.arange(len(per_row)), [len(r[0]) for r in per_row])
            columns = [np.concatenate([r[k] for r in per_row]) if per_row else [] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "start", "length", "period"])

    return common.map_batches(docs, found, f"doc_id {kind}, start bigint, length bigint, period bigint")


def collapse(docs, places=None):
    """``doc_id`` and ``text`` with one period of each run: the kept words, one space apart."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kept(batches):
        for batch, data, starts, ends, bounds, per_row in _rows(batches, places):
            raw = data.tobytes()
            texts = [_collapsed(raw, starts[a:b], ends[a:b], own)
                     for a, b, own in zip(bounds[:-1], bounds[1:], per_row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(
                    pa.string(), allow_invalid_utf8=True))], ["doc_id", "text"])

    return common.map_batches(docs, kept, f"doc_id {kind}, text string")


def _collapsed(raw, starts, ends, own):
    start, length, period = own
    keep = ~redundant(len(starts), start, length, period) if len(start) else slice(None)
    return b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])


def report(docs, places=planted):
    """Per row: the number of runs, the longest (ties: smallest start, then period) and its
    exponent, digests of all runs and of the words that stay."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    longest = ["start", "length", "period", "exponent_milli"]
    schema = (f"doc_id {kind}, n_runs bigint, " + ", ".join(f"{n} bigint" for n in longest)
              + ", runs_sha256 string, collapsed_sha256 string")

    def rows(batches):
        for batch, data, starts, ends, bounds, per_row in _rows(batches, places):
            raw, best, listed, kept = data.tobytes(), [], [], []
            for a, b, own in zip(bounds[:-1], bounds[1:], per_row):
                start, length, period = own
                if len(start):
                    k = int(np.argmax(length))  # the first of the greatest
                    best.append((start[k], length[k], period[k], 1000 * length[k] // period[k]))
                else:
                    best.append((None,) * 4)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
                listed.append(hashlib.sha256(lines.encode()).hexdigest())
                kept.append(hashlib.sha256(_collapsed(raw, starts[a:b], ends[a:b], own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r[0]) for r in per_row], pa.int64()),
                 *(pa.array([row[k] for row in best], pa.int64()) for k in range(4)),
                 pa.array(listed, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_runs", *longest, "runs_sha256", "collapsed_sha256"])

    return common.map_batches(docs, rows, schema)
