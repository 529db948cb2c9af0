"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE file of the ``tokenizers`` library on space+text, side B a
``sentencepiece`` model on text, which adds that space itself.  Special tokens' strings are
plain text.  Both sides' tokens tile the bytes of space+text.

Method, per batch: ``pandas.merge_asof`` keyed by document finds, for each A token, the B token
that covers its start, and for each B token the A token that covers its start.  The union of the
two directions is the set of overlaps.  Overlaps whose ends are equal are links; the bytes where
they end cut both sides into groups.  Counts of linked id pairs are added up over all documents
by Spark, and joined back to the documents' distinct pairs.

Texts are cut where neither tokenizer can join bytes, and each distinct piece is encoded once per
worker.  A text of more than ``SEGMENT`` bytes is aligned in segments that end at such places.

Defined results: a text that is null, empty, or whose joined A or B bytes differ from space+text
(as with U+2581) has no tokens, zeros and an empty digest.  Repeated rows, and rows that share a
``doc_id``, get a row each and all count.  An empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from . import common
from .common import written
from .tokens import Encoder, byte_letters
from .wordhash import span_hashes

SEGMENT = 2 << 20  # bytes of one text that are aligned at once
SPACE_MARK = "▁"
_sides = common.caches.setdefault("sides", {})


def _laid_out(items):
    """Byte strings end to end, and the bounds of each."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def _gathered(flat, bounds, ids):
    """The laid-out items of ``ids`` end to end."""
    begin, lengths = bounds[ids], bounds[ids + 1] - bounds[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - lengths), lengths) + np.arange(total)]


class ByteSide(Encoder):
    """Ids of a byte-level file; the strings of added tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added = []
        letters = {c: b for b, c in byte_letters().items()}
        size = self.plain.get_vocab_size()
        names = [self.plain.id_to_token(i) or "" for i in range(size)]
        self.token_bytes = _laid_out([bytes(letters[c] for c in name if c in letters) for name in names])


class PieceSide(Encoder):
    """Ids of a sentencepiece BPE model of space+text, by distinct pieces.

    No entry of such a vocabulary holds its space mark behind another character, and some
    characters, such as the line feed, are in no entry of more than one: no merge crosses the place
    before a space that follows another character, or before such a character.  Where a
    vocabulary has entries of the first kind, only the second places are used.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        plain = [n for i, n in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i))]
        self.words = not any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in plain)
        inside = {c for n in plain for c in n}
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in range(128) if chr(b) not in inside and b != 32]] = True
        self.space = self.model.piece_to_id(SPACE_MARK)
        self.token_bytes = _laid_out([
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else
            b"" if self.model.is_control(i) or self.model.is_unknown(i) else n.replace(SPACE_MARK, " ").encode()
            for i, n in enumerate(names)])
        self.added, self.merges = [], self
        self.reset()

    def encode_ordinary(self, piece):
        """A piece as it stands in a text: the model's own leading space is the piece's first
        character, or is taken off again."""
        if piece == " ":
            return [self.space]
        if piece[0] == " ":
            return self.model.encode(piece[1:])
        return self.model.encode(piece)[1:]

    def rows(self, data, offsets):
        cut = self.alone[data]
        if self.words:
            cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        slots = self._slots(data, starts, ends, span_hashes(data, starts, ends))
        to = self.ends[slots]
        begin = np.where(slots > 0, self.ends[np.maximum(slots - 1, 0)], 0)
        lengths = to - begin
        filled = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(begin - filled[:-1], lengths) + np.arange(filled[-1])]
        bounds = filled[np.searchsorted(starts, offsets)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b]


def side(kind, path: str):
    if (kind, path) not in _sides:
        _sides[kind, path] = kind(path)
    return _sides[kind, path]


def _tokens(encoder, data, offsets):
    """Ids, ends (among all rows' bytes), row numbers, and the rows whose bytes are not theirs."""
    rows = list(encoder.rows(data, offsets))
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), counts)
    flat, bounds = encoder.token_bytes
    lengths = bounds[ids + 1] - bounds[ids]
    per_row = np.bincount(row, lengths, len(rows)).astype(np.int64)
    wrong = per_row != np.diff(offsets)
    if wrong.any():
        keep = ~wrong[row]
        ids, row, lengths = ids[keep], row[keep], lengths[keep]
    spans = np.repeat(offsets[:-1][~wrong], per_row[~wrong]) if wrong.any() else None
    joined = _gathered(flat, bounds, ids)
    if spans is None:
        expected = data
    else:
        sizes = per_row[~wrong]
        expected = data[spans + np.arange(len(spans)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    if len(joined) and not np.array_equal(joined, expected):
        at = np.flatnonzero(joined != expected)
        ends = np.cumsum(lengths)
        wrong[np.unique(row[np.searchsorted(ends, at, side="right")])] = True
    return ids, lengths, row, wrong


def aligned(a, b, data, offsets):
    """Tokens and overlaps of rows of bytes, each not empty: for each side a frame with the
    columns doc, start, end, id, at; the overlaps (positions in the two frames); the rows that
    have no tokens."""
    sides, wrong = [], np.zeros(len(offsets) - 1, bool)
    for encoder in (a, b):
        ids, lengths, row, bad = _tokens(encoder, data, offsets)
        sides.append((ids, lengths, row))
        wrong |= bad
    frames = []
    for ids, lengths, row in sides:
        if wrong.any():
            keep = ~wrong[row]
            ids, lengths, row = ids[keep], lengths[keep], row[keep]
        within = np.cumsum(lengths)
        first = np.searchsorted(row, np.arange(len(offsets) - 1))
        before = np.concatenate(([0], within))[first]
        end = within - before[row] + offsets[:-1][row]
        frames.append(pd.DataFrame({"start": end - lengths, "end": end, "doc": row, "id": ids, "at": np.arange(len(ids))}))
    columns = ["start", "doc", "at"]
    pairs = []
    for left, right in ((0, 1), (1, 0)):
        found = pd.merge_asof(frames[left][columns], frames[right][columns], on="start", by="doc")
        own, other = found["at_x"].to_numpy(np.int64), found["at_y"].to_numpy(np.int64)
        pairs.append(own << 32 | other if left == 0 else other << 32 | own)
    both = np.unique(np.concatenate(pairs))
    return frames, both >> 32, both & 0xFFFFFFFF, wrong


def _with_space(data, offsets):
    """Each row's bytes behind one space."""
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


def _segments(data, offsets):
    """One long row cut before lone spaces; other slices stay as they are."""
    if len(offsets) != 2 or len(data) <= SEGMENT:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SEGMENT:
            step = at + SEGMENT
            while step < end:  # the first lone space between two other ASCII characters
                part = data[step - 1:step + SEGMENT]
                lone = (part[1:-1] == 32) & (part[:-2] > 32) & (part[:-2] < 127) & (part[2:] > 32) & (part[2:] < 127)
                if lone.any():
                    end = step + int(np.argmax(lone))
                    break
                step += max(len(part) - 2, 1)
        yield data[at:end], np.array([0, end - at])
        at = end


def _slices(batches, path_a, path_b):
    """(slice, rows with text, their parts): a part is the tokens and overlaps of one segment."""
    a, b = side(ByteSide, path_a), side(PieceSide, path_b)
    for batch in common.text_slices(batches):
        data, offsets = common.column_bytes(batch.column("text"))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            yield batch, full, []
            continue
        data, offsets = _with_space(data, np.append(offsets[full], offsets[-1]))
        yield batch, full, (aligned(a, b, *segment) for segment in _segments(data, offsets))


def _digits():
    return _laid_out([str(i).encode() for i in range(1 << 16)])


def _group_texts(frames, last_a, last_b, n_rows):
    """``a1,a2|b1;a3|b2`` of all rows end to end, and the rows' bounds.  ``last_*`` mark the
    tokens that end a group."""
    flat, bounds = _sides.setdefault("digits", _digits())
    n_a, n_b = len(last_a), len(last_b)
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    # Behind each side's own tokens come those of the other side's earlier groups.
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    place_a = np.arange(n_a) + np.concatenate(([0], ends_b))[group_a]
    place_b = np.arange(n_b) + ends_a[group_b]
    ids, marks, row = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8), np.empty(n_a + n_b, np.int64)
    for frame, place, last, mark in ((frames[0], place_a, last_a, b"|"), (frames[1], place_b, last_b, b";")):
        ids[place] = frame["id"].to_numpy()
        row[place] = frame["doc"].to_numpy()
        marks[place] = np.where(last, ord(mark), ord(","))
    lengths = bounds[ids + 1] - bounds[ids]
    ends = np.cumsum(lengths + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    digits = np.ones(len(out), bool)
    digits[ends - 1] = False
    out[digits] = _gathered(flat, bounds, ids)
    out[ends - 1] = marks
    return out, np.concatenate(([0], ends))[np.searchsorted(row, np.arange(n_rows + 1))]


class _Sums:
    """What the segments of a row add up to."""

    def __init__(self):
        self.n_a = self.n_b = self.n_links = 0
        self.wrong = False
        self.text, self.pairs = hashlib.sha256(), []
        self.open = b""

    def add(self, n_a, n_b, text, pairs):
        self.n_a, self.n_b, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_links + len(pairs)
        self.text.update(self.open + text[:-1])  # the mark behind the last group waits
        self.open = text[-1:]
        self.pairs.append(pairs)

    def result(self):
        if self.wrong or not self.n_a:
            return 0, 0, 0, "", [], []
        pairs, counts = np.unique(np.concatenate(self.pairs), return_counts=True)
        return self.n_a, self.n_b, self.n_links, self.text.hexdigest(), pairs, counts


def digests(docs, path_a: str, path_b: str):
    """Per row: token, group and link counts, the digest of the groups, and its distinct linked id
    pairs (``a << 32 | b``) with how often each is linked."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "pairs array<bigint>, counts array<int>")

    def rows(batches):
        for batch, full, parts in _slices(batches, path_a, path_b):
            sums = [_Sums() for _ in full]
            for frames, at_a, at_b, wrong in parts:
                end_a, end_b = frames[0]["end"].to_numpy(), frames[1]["end"].to_numpy()
                same = end_a[at_a] == end_b[at_b]
                at_a, at_b = at_a[same], at_b[same]
                last_a, last_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
                last_a[at_a], last_b[at_b] = True, True
                text, bounds = _group_texts(frames, last_a, last_b, len(full))
                linked = frames[0]["id"].to_numpy()[at_a] << 32 | frames[1]["id"].to_numpy()[at_b]
                steps = np.arange(len(full) + 1)
                row_a, row_b = frames[0]["doc"].to_numpy(), frames[1]["doc"].to_numpy()
                first = [np.searchsorted(r, steps) for r in (row_a, row_b, row_a[at_a])]
                for i, own in enumerate(sums):
                    if wrong[i]:
                        own.wrong = True
                    else:
                        own.add(int(first[0][i + 1] - first[0][i]), int(first[1][i + 1] - first[1][i]),
                                text[bounds[i]:bounds[i + 1]].tobytes(), linked[first[2][i]:first[2][i + 1]])
            found = [(0, 0, 0, "", [], [])] * batch.num_rows
            for i, own in zip(full, sums):
                found[i] = own.result()
            n_a, n_b, n_links, digest, pairs, counts = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_links, pa.int64()),
                 pa.array(n_links, pa.int64()), pa.array(digest, pa.string()), pa.array(pairs, pa.list_(pa.int64())),
                 pa.array(counts, pa.list_(pa.int32()))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])

    return common.map_batches(docs, rows, schema, "sides")


def alignments(docs, path_a: str, path_b: str):
    """Per row the alignment itself: both sides' ids and ends (bytes of space+text), the
    overlaps as pairs of token positions, and the ends of the groups."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["ids_a", "ends_a", "ids_b", "ends_b", "overlap_a", "overlap_b", "group_ends"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} array<bigint>" for n in names)

    def rows(batches):
        for batch, full, parts in _slices(batches, path_a, path_b):
            found = [[[] for _ in names] for _ in range(batch.num_rows)]
            base = np.zeros(batch.num_rows, np.int64)  # bytes of the segments before
            wrong_rows = set()
            for frames, at_a, at_b, wrong in parts:
                (ids_a, end_a, doc_a), (ids_b, end_b, doc_b) = (
                    [f[c].to_numpy() for c in ("id", "end", "doc")] for f in frames)
                wrong_rows.update(full[wrong].tolist())
                for i in np.flatnonzero(~wrong):
                    own = found[full[i]]
                    (a0, a1), (b0, b1) = (np.searchsorted(d, [i, i + 1]) for d in (doc_a, doc_b))
                    mine = slice(*np.searchsorted(at_a, [a0, a1]))
                    begin = end_a[a0] - len_of(frames[0], a0)
                    pa_, pb_ = at_a[mine], at_b[mine]
                    done_a, done_b = len(own[0]), len(own[2])
                    shift = base[full[i]] - begin
                    parts_of = (ids_a[a0:a1], end_a[a0:a1] + shift, ids_b[b0:b1], end_b[b0:b1] + shift,
                                pa_ - a0 + done_a, pb_ - b0 + done_b, end_a[pa_][end_a[pa_] == end_b[pb_]] + shift)
                    for column, values in zip(own, parts_of):
                        column.extend(values.tolist())
                    base[full[i]] += end_a[a1 - 1] - begin
            for r in wrong_rows:
                found[r] = [[] for _ in names]
            columns = [pa.array([own[k] for own in found], pa.list_(pa.int64())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return common.map_batches(docs, rows, schema, "sides")


def len_of(frame, at):
    """Bytes of one token."""
    return int(frame["end"].iloc[at] - frame["start"].iloc[at])


def link_counts(links):
    """Of ``pairs`` and ``counts``: how many links of the corpus hold each id pair linked, and
    whether that is the most of its B id."""
    counted = written(links.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    keyed = counted.withColumn("b", b_id).join(most, "b")
    return keyed.select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def report(docs, path_a: str, path_b: str):
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    rows = written(digests(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "digests")
    links = (rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("l"))
             .select("row", F.col("l.pairs").alias("pair"), F.col("l.counts").cast("long").alias("n")))
    known = written(link_counts(links), "counts")
    sums = (links.join(known, "pair").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return (rows.drop("pairs", "counts").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
