"""Best-fit packing of documents into sequences of fixed capacity, by large-item matching.

Only lengths matter for a packing, and there are at most ``capacity`` of them.  So Spark
counts the pieces of each length, the matching runs on that table of counts (bounded by the
capacity, whatever the corpus), and each piece finds its place by its rank within its length.

* A piece longer than a third of the capacity shares a sequence with at most one other such
  piece: from the longest down, each takes the longest partner that still fits.
* Shorter pieces, from the longest down, go to the smallest remaining gap that holds them, and
  open new sequences where none does.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each;
an empty table gives no rows; input columns other than ``doc_id`` and ``text`` are not carried.
"""

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, tokens

BUCKETS = 64  # at least; parts of one length that are ranked apart
SLICE_BYTES = 1 << 17  # text bytes encoded at once: the encoder's arrays take some fifty times that
ROWS = 500  # documents of an Arrow batch


def squeezed(ids):
    """Ids as compressed bytes, two or four bytes each."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())


def unsqueezed(data, length):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")


def pieces(docs, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False):
    """The documents' token ids cut into pieces: the first takes what is over, all others are full."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + ", ids binary" * with_ids)

    def cut(batches):
        encoder = tokens.encoder(tokenizer)
        for batch in common.text_slices(batches, limit=SLICE_BYTES):
            data, offsets = common.column_bytes(batch.column("text"))
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, own in enumerate(encoder.rows(data, offsets)):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                head = (len(own) - 1) % capacity + 1
                edges = [0, *range(head, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    if with_ids:
                        ids.append(squeezed(own[a:b]))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.map_batches(docs, cut, schema, "encoders")


def matching(counts: dict, capacity: int):
    """Runs of equal sequences ``(how many, [(length, copies), ...])`` for a table of lengths."""
    left = dict(counts)
    large = sorted(length for length in left if 3 * length > capacity and left[length] > 0)
    runs = []
    for a in reversed(list(large)):
        while left[a] > 0:
            at = bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] - (large[at] == a) <= 0:
                large.pop(at)
                at -= 1
            if at < 0:
                runs.append((left[a], [(a, 1)]))
                left[a] = 0
                continue
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            runs.append((n, [(a, 2)] if a == b else [(a, 1), (b, 1)]))
            left[a] -= n
            left[b] -= n
    gaps, by_gap = [], {}

    def put(n, contents):
        gap = capacity - sum(length * copies for length, copies in contents)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((n, contents))

    for n, contents in runs:
        put(n, contents)
    for length in sorted((x for x in left if 3 * x <= capacity and left[x] > 0), reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                n, contents = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            else:
                gap, contents = capacity, []
                n = -(-todo // (capacity // length))
            copies = min(gap // length, todo)
            used = min(n, todo // copies)
            put(used, [*contents, (length, copies)])
            if n > used:
                put(n - used, contents)
            todo -= used * copies
    return [run for gap in gaps for run in by_gap[gap] if run[1]]


def places(runs):
    """Where the pieces of each length go: arrays (length, first rank, copies, sequence, offset)."""
    seen, sequence, out = {}, 0, []
    for n, contents in runs:
        offset = 0
        for length, copies in contents:
            rank = seen.get(length, 0)
            out.append((length, rank, copies, sequence, offset))
            seen[length] = rank + n * copies
            offset += length * copies
        sequence += n
    out.sort()
    return [np.array(column, np.int64) for column in (zip(*out) if out else ((),) * 5)]


def within_length(cut):
    """Each piece's rank among those of its length.  Each length is ranked in many buckets, so a
    length that a third of the pieces have does not meet in one task."""
    buckets = max(BUCKETS, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = (cut.withColumn("rank", F.row_number().over(own) - 1)
              .join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")))
    return ranked.drop("bucket", "base"), counts


def place(cut, capacity: int, plan=matching):
    """Pieces (doc_id, piece, start, length, ids_crc32, ...) with ``sequence_id`` and ``offset``.

    ``plan`` turns the table of lengths into runs of equal sequences, as ``matching`` does.
    """
    ranked, counts = within_length(cut)
    lengths, ranks, copies, sequences, offsets = places(plan(counts, capacity))

    def find(batches):
        keys = lengths << 44 | ranks
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            turn = rank - ranks[at]
            sequence, offset = sequences[at] + turn // copies[at], offsets[at] + turn % copies[at] * length
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return common.map_batches(ranked, find, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs, tokenizer: str, capacity: int = 1024, end_id: int = 2):
    """Every piece of every document with its sequence and place there."""
    with common.small_batches(docs.sparkSession, ROWS):
        cut = common.written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return place(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
