"""Token ids as packed matrices: best-fit-decreasing packing with a segment tree.

Documents become ids plus an end id; longer ones are split without loss.  The pieces' lengths
are counted (at most ``capacity`` counts, whatever the corpus), and the packing runs on the
counts: from the longest length down, a segment tree over the capacities finds the smallest
remaining capacity that holds a piece.  Spark then gathers each sequence's pieces, which the
capacity bounds, and lays them out as one row of the matrix.

Per sequence: ``sequence_id``, ``n_tokens``, ``ids`` (``capacity`` little-endian unsigned 32-bit
ids, filled up with ``pad_id``), ``cu_seqlens`` (cumulative segment lengths, from 0),
``position_resets`` (where the position ids start again from 0), and the ``doc_ids``,
``pieces`` and ``starts`` of the segments, from which every document can be put together again.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each;
an empty table gives no rows; other input columns are not carried.
"""

import numpy as np
import pyarrow as pa

from . import common
from .best_fit_packing import ROWS, pieces, place, unsqueezed


class CapacityTree:
    """Segment tree over the capacities 0 to ``capacity``: which of them some sequence has left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.has = [0] * (2 * self.size)

    def add(self, gap: int, by: int):
        node = gap + self.size
        while node:
            self.has[node] += by
            node >>= 1

    def smallest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that is there, or -1."""
        node = least + self.size
        if not self.has[node]:
            while node > 1 and (node & 1 or not self.has[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.size:
                node = 2 * node if self.has[2 * node] else 2 * node + 1
        return node - self.size


def decreasing(counts: dict, capacity: int):
    """Best-fit-decreasing runs of equal sequences ``(how many, [(length, copies), ...])``."""
    tree, runs = CapacityTree(capacity), {}

    def put(n, contents):
        gap = capacity - sum(length * copies for length, copies in contents)
        runs.setdefault(gap, []).append((n, contents))
        tree.add(gap, 1)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        todo = counts[length]
        while todo:
            gap = tree.smallest(length)
            if gap < 0:
                gap, contents = capacity, []
                n = -(-todo // (capacity // length))
            else:
                n, contents = runs[gap].pop()
                tree.add(gap, -1)
            copies = min(gap // length, todo)
            used = min(n, todo // copies)
            put(used, [*contents, (length, copies)])
            if n > used and contents:
                put(n - used, contents)
            todo -= used * copies
    return [run for gap in sorted(runs) for run in runs[gap]]


def matrices(docs, tokenizer: str, capacity: int = 1024, end_id: int = 2, pad_id: int = 0):
    """One row per sequence."""
    with common.small_batches(docs.sparkSession, ROWS):
        cut = common.written(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "ids")
    placed = place(cut, capacity, decreasing).select("sequence_id", "offset", "length", "doc_id", "piece", "start", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = (f"sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
              f"doc_ids array<{kind}>, pieces array<int>, starts array<bigint>")

    def lay_out(batches):
        rows = []

        def flush(whole):
            """Sequences that are complete; the last one may go on in the next batch."""
            nonlocal rows
            out, at = {n: [] for n in names}, 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to]["sequence_id"] == rows[at]["sequence_id"]:
                    to += 1
                if to == len(rows) and not whole:
                    break
                own = rows[at:to]
                line = np.full(capacity, pad_id, "<u4")
                for r in own:
                    line[r["offset"]:r["offset"] + r["length"]] = unsqueezed(r["ids"], r["length"])
                edges = [0, *np.cumsum([r["length"] for r in own]).tolist()]
                for name, value in zip(names, (
                        own[0]["sequence_id"], edges[-1], line.tobytes(), edges, edges[:-1],
                        [r["doc_id"] for r in own], [r["piece"] for r in own], [r["start"] for r in own])):
                    out[name].append(value)
                at = to
            rows = rows[at:]
            return out

        names = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"]
        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                         pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for at in range(0, batch.num_rows, 500):
                rows += batch.slice(at, 500).to_pylist()
                out = flush(False)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)
        if rows:
            out = flush(True)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    grouped = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return common.map_batches(grouped, lay_out, schema)


def write_matrices(packed, path: str, rows_per_file: int = 1 << 16):
    """Write the matrix as files of at most ``rows_per_file`` rows in sequence order."""
    (packed.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id")
     .write.option("maxRecordsPerFile", rows_per_file).parquet(path))
