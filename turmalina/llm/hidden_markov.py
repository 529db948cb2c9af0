"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Tokens are words (A-Z lower-cased) and one end a document.  Counts of all training words are
taken exactly.  The ``own`` most frequent words emit as themselves; all other words, known or
not, emit as one of ``CLASSES`` classes by their last two bytes, and within a class a word has
probability ``(c + 1) / (N_class + V_class + 1)``.  So the model gives every word a probability,
and its tables have a fixed size.

Each training round runs scaled forward and backward recursions in the tasks over stretches of
at most ``STRETCH`` tokens of all training documents, and Spark adds up the expected counts.  Texts
follow each other in a task, each starting anew, so all stretches are of one length.
Scoring is exact: the scaled forward recursion goes through each whole text.

Counts of the ``cached`` most frequent words go to the tasks; those of all others are joined.

Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
(add-one unigrams) and ``score`` (the model), in log10.  Defined results: a null or empty text
is the end alone; without training rows all counts are 0 and every word is unknown; equal counts
are ordered by hash; repeated rows are each counted and scored; an empty table gives no rows;
other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import common
from .common import written
from .wordhash import LOWER, SPACE, word_hashes

STATES = 8
CLASSES = 256
STRETCH = 256
END = np.uint64(0x454E44)  # stands for the end of a text
TOGETHER = 8 << 20  # symbol bytes whose recursions run side by side
FLUSH = 2_000_000  # distinct words a task holds before it passes its counts on


def _tokens(batch):
    """Hashes and rare-word classes of all rows' tokens, ends included, and the row bounds."""
    data, offsets = common.column_bytes(batch.column("text"))
    words, bounds, starts, ends = word_hashes(data, offsets, SPACE)
    n = np.diff(bounds)
    out_bounds = np.concatenate(([0], np.cumsum(n + 1)))
    hashes = np.full(out_bounds[-1], END, np.uint64)
    classes = np.zeros(out_bounds[-1], np.int32)
    if len(words):
        at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
        low = LOWER[data]
        hashes[at] = words
        last, before = low[ends - 1].astype(np.int32), low[np.maximum(ends - 2, starts)].astype(np.int32)
        classes[at] = (last * 37 + before * 101) % CLASSES
    return hashes, classes, out_bounds


def word_counts(docs):
    """Rows (h, r, c): each training word's hash, rare-word class and count."""
    def count(batches):
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))

        def rows(h, r, c):
            for at in range(0, len(h), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(h[at:to].view(np.int64)), pa.array(r[at:to]), pa.array(c[at:to])], ["h", "r", "c"])

        for batch in common.text_slices(batches):
            hashes, classes, _ = _tokens(batch)
            u, first, c = np.unique(hashes, return_index=True, return_counts=True)
            h, r, c = np.concatenate([held[0], u]), np.concatenate([held[1], classes[first]]), np.concatenate([held[2], c])
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            held = (u, r[first], np.bincount(inverse, weights=c).astype(np.int64))
            if len(u) > FLUSH:
                yield from rows(*held)
                held = tuple(a[:0] for a in held)
        yield from rows(*held)

    return (common.map_batches(docs.select("text"), count, "h bigint, r int, c bigint")
            .groupBy("h").agg(F.first("r").alias("r"), F.sum("c").alias("c")))


class Words:
    """What tasks know of words: the cached counts, own classes and rare-class totals."""

    BITS = 18

    def __init__(self, top, own, totals, n, v, ends):
        h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
        order = np.argsort(h)
        self.own, self.hashes, self.counts = own, h[order], c[order]
        self.symbols = np.zeros(len(h), np.int32)
        self.symbols[np.argsort(order)[:own]] = np.arange(1, own + 1)  # 0: through a class
        # Cached hashes by their leading bits, so a look-up tries few of them.
        lead = (self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.BITS) + 1))
        self.totals, self.n, self.v, self.ends = totals, n, v, ends
        self.size = 1 + own + CLASSES  # the end, own words, rare classes

    def look_up(self, hashes, classes):
        """Symbol, count (-1 where not cached) and whether the word emits through a class."""
        symbol, count = classes + np.int32(1 + self.own), np.full(len(hashes), -1, np.int64)
        lead = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, stop = self.first[lead], self.first[lead + 1]
        open_ = np.flatnonzero(at < stop)
        at, stop = at[open_], stop[open_]
        while len(open_):
            hit = self.hashes[at] == hashes[open_]
            found, place = open_[hit], at[hit]
            count[found] = self.counts[place]
            own = self.symbols[place]
            symbol[found[own > 0]] = own[own > 0]
            at = at + 1
            more = ~hit & (at < stop)
            open_, at, stop = open_[more], at[more], stop[more]
        end = hashes == END
        symbol[end], count[end] = 0, self.ends
        return symbol.astype("<u2"), count, symbol > self.own


def expected_counts(symbols, begins, model):
    """Expected counts of starts, moves and emissions over stretches.

    ``symbols`` is an array time x stretch and ``begins`` marks where a text begins: there the
    recursions start anew.  A stretch that begins inside a text starts from the start states.
    """
    start, move, emit = model
    T, S = symbols.shape
    K = len(start)
    ones = np.ones(K, np.float32)
    alpha, scale = np.empty((T, S, K), np.float32), np.empty((T, S, 1), np.float32)
    for t in range(T):
        if t:
            a = alpha[t - 1] @ move
            a[begins[t]] = start
            a *= emit[symbols[t]]
        else:
            a = start * emit[symbols[t]]
        scale[t, :, 0] = 1 / (a @ ones)
        np.multiply(a, scale[t], out=alpha[t])
    beta, moves, starts = np.ones((S, K), np.float32), np.zeros((K, K)), np.zeros(K)
    for t in range(T - 1, -1, -1):
        if t:
            ahead = emit[symbols[t]]
            ahead *= beta
            ahead *= scale[t]
            ahead[begins[t]] = 0
            moves += alpha[t - 1].T @ ahead
            alpha[t] *= beta  # now the states' probabilities given the whole stretch
            beta = ahead @ move.T
            beta[begins[t]] = 1
        else:
            alpha[t] *= beta
        starts += alpha[t][begins[t]].sum(0)
    flat, words = alpha.reshape(-1, K), symbols.reshape(-1)
    emits = np.stack([np.bincount(words, weights=flat[:, k], minlength=len(emit)) for k in range(K)], 1)
    return starts, moves * move, emits


def _round(sequences, model, size, K):
    """Spark's sums of the expected counts of all training documents."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    length = K + K * K + size * K

    def add(total, stream, T):
        cut = stream.reshape(-1, T).T
        begins = np.zeros(len(stream), bool)
        begins[0] = True
        begins[1:] = stream[:-1] == 0  # after an end
        total += np.concatenate([f.ravel() for f in expected_counts(cut, begins.reshape(-1, T).T, shared.value)])

    def count(batches):
        total, rest = np.zeros(length), np.zeros(0, np.int64)
        for batch in batches:
            data, _ = common.column_bytes(batch.column("symbols").cast(pa.large_binary()))
            stream = np.concatenate([rest, data.view("<u2")])
            for at in range(0, len(stream) - STRETCH + 1, STRETCH << 12):  # a text may go on in the next stretch
                part = stream[at:at + (STRETCH << 12)]
                part = part[:len(part) // STRETCH * STRETCH]
                add(total, part.astype(np.int64), STRETCH)
            rest = stream[len(stream) // STRETCH * STRETCH:].astype(np.int64)
        if len(rest):
            add(total, rest, len(rest))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], ["i", "x"])

    rows = common.map_batches(sequences, count, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(length)
    out[rows["i"]] = rows["x"]
    return out[:K], out[K:K + K * K].reshape(K, K), out[K + K * K:].reshape(size, K)


def train(sequences, words: Words, rounds: int = 3, states: int = STATES, seed: int = 11):
    """Start, move and emission probabilities (symbol x state)."""
    rng = np.random.default_rng(seed)
    start, move = np.full(states, 1 / states), rng.random((states, states)) + states * np.eye(states)
    emit = rng.lognormal(0, 1, (words.size, states))
    for turn in range(rounds + 1):
        emit, move = emit / emit.sum(0), move / move.sum(1, keepdims=True)
        if turn == rounds:
            break
        model = tuple(x.astype(np.float32) for x in (start, move, emit))
        s, m, e = _round(sequences, model, words.size, states)
        if not s.sum():
            break
        prior = (e.sum(1, keepdims=True) + 0.01) / (e.sum() + 0.01 * words.size)
        start, move, emit = (s + 0.1) / (s + 0.1).sum(), m + 0.1, e + 10 * prior
    return start, move, emit


def forward(symbols, bounds, model):
    """log10 likelihood of each row's symbols, by the scaled forward recursion over all of it."""
    start, move, emit = model
    ones = np.ones(len(start))
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    n, first = n[order], bounds[:-1][order]
    live = np.searchsorted(-n, -np.arange(n.max(initial=0)), side="left")  # rows longer than t
    total, alpha = np.zeros(len(n)), None
    for t, k in enumerate(live.tolist()):
        a = (np.broadcast_to(start, (k, len(start))) if t == 0 else alpha[:k] @ move) * emit[symbols[first[:k] + t]]
        scale = a @ ones
        total[:k] += np.log10(scale)
        alpha = a * (1 / scale)[:, None]
    out = np.empty(len(n))
    out[order] = total
    return out


def score(docs, held_out, own: int = 4096, cached: int = 1 << 17, rounds: int = 3):
    """Scores of all documents by a model of those for which ``held_out`` is false."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out)
    counts = written(word_counts(docs.filter("NOT held_out")), "counts")
    ends = int(END)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.filter(F.col("h") != ends).orderBy(F.desc("c"), "h").limit(cached).select("h", "c").toPandas()  # bounded by ``cached``
    end_count = counts.filter(F.col("h") == ends).select("c").first()
    # Totals of the rare classes: all words but the end and those that emit as themselves.
    per_class = counts.filter(F.col("h") != ends).groupBy("r").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    totals = np.zeros((CLASSES, 2))
    totals[per_class["r"]] = per_class[["c", "v"]]
    own = min(own, len(top))
    if own:
        mine = counts.join(spark.createDataFrame(top[["h"]].head(own)), "h").select("r", "c").toPandas()
        np.subtract.at(totals, mine["r"].to_numpy(), np.stack([mine["c"], np.ones(len(mine))], 1))
    words = Words(top, own, totals.sum(1), sums["n"], sums["v"], end_count["c"] if end_count else 0)
    shared = spark.sparkContext.broadcast(words)

    def encode(batches):
        """Symbols, all that needs no model, and the words whose counts are to be joined."""
        words, task, serial = shared.value, TaskContext.get().partitionId(), 0
        even, classed = np.log10(words.n + words.v + 1.0), np.log10(words.totals + 1.0)
        for batch in common.text_slices(batches):
            hashes, classes, bounds = _tokens(batch)
            symbols, count, rare = words.look_up(hashes, classes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            add = lambda x: np.bincount(row, weights=x, minlength=batch.num_rows)
            have = np.log10(np.maximum(count, 0) + 1.0)
            tails = [np.unique(hashes[a:b][count[a:b] < 0], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
            ids = (task << 40) + serial + np.arange(batch.num_rows)
            serial += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(ids), pa.array(np.diff(bounds)),
                 pa.array(add(count > 0).astype(np.int64)), pa.array(add(have) - np.diff(bounds) * even),
                 pa.array(add(np.where(rare, have - classed[classes], 0.0))),
                 pa.array([symbols[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                 pa.array([u.view(np.int64) for u, _ in tails], pa.list_(pa.int64())),
                 pa.array([n.astype(np.int32) for _, n in tails], pa.list_(pa.int32()))],
                ["doc_id", "held_out", "row", "n_tokens", "known", "base", "inner", "symbols", "tail_h", "tail_n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = written(common.map_batches(docs, encode, (
        f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, inner double, "
        "symbols binary, tail_h array<bigint>, tail_n array<int>")), "encoded")
    model = spark.sparkContext.broadcast(train(encoded.filter("NOT held_out").select("symbols"), words, rounds))

    def run(batches):
        for batch in common.text_slices(batches, "symbols", TOGETHER):
            data, offsets = common.column_bytes(batch.column("symbols"))
            own = forward(data.view("<u2"), offsets // 2, model.value) + np.asarray(batch.column("inner"))
            names = [n for n in batch.schema.names if n not in ("symbols", "inner")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(own)], [*names, "own"])

    scored = common.map_batches(encoded.drop("tail_h", "tail_n"), run, (
        f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, own double"))
    tails = encoded.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select(
        "row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"))
    # A word that training has not seen has count 0 and adds log10(1) = 0: an inner join is enough.
    more = (tails.join(counts.select("h", "c"), "h").groupBy("row")
            .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain")))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(sums["n"])).cast("bigint").alias("train_tokens"), (F.col("base") + gain).alias("base_score"),
        (F.col("own") + gain).alias("score"))
