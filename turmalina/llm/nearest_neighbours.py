"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best
bin first.

* Vectors are lengthened by one dimension so that the nearest point is the one of largest inner
  product: ``sqrt(M^2 - |x|^2)`` for rows (M the largest norm), 0 for queries.
* A tree of cluster centres (``branching`` children a node) is fitted on at most ``sample``
  vectors, spread over the table by hash; every row is then led to its leaf, so all rows are
  indexed.
* A query keeps the tree's nodes in a priority queue by their centre's distance and opens the
  nearest first until it has visited enough leaves.  How many is calibrated: ``probes`` queries
  are held against all rows, and visits grow until the mean recall reaches ``target`` (or all
  leaves are visited).
* Leaves are cut into blocks of bounded size, so a hot leaf spreads over tasks.  Equal vectors
  are one entry with its ``k + 1`` smallest ids, which is all that a result can show.

Per query and rank: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (inner product of the
original vectors in double precision), ties to the smaller ``vec_id``.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor do null ids; fewer candidates than ``k`` give fewer rows;
repeated rows (equal id and vector) count once; an empty table gives no rows.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common
from .common import written

BLOCK = 1024  # vectors of a leaf that are searched together, about
KEPT = 100_000  # queries whose best scores a task remembers
CHUNK = 256  # queries that are searched together, about


def valid(vectors, key: str, value: str):
    """Rows (id, vector as doubles) that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    common_size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.filter(F.size("v") == common_size["d"]) if common_size else rows).distinct()


class Tree:
    """Cluster centres in levels; children of node i of a level are i * branching + 0, 1, ..."""

    def __init__(self, points, branching: int, leaf: int, rng):
        self.branching, self.levels = branching, []
        depth = 1
        while branching ** depth * leaf < len(points):
            depth += 1
        group = np.zeros(len(points), np.int64)
        for level in range(depth):
            centres = np.full((branching ** (level + 1), points.shape[1]), np.nan)
            fresh = np.zeros(len(points), np.int64)
            for node in np.unique(group):
                own = np.flatnonzero(group == node)
                found, label = _kmeans(points[own], branching, rng)
                centres[node * branching:node * branching + len(found)] = found
                fresh[own] = node * branching + label
            self.levels.append(centres)
            group = fresh

    def leaf_of(self, points):
        """The leaf each point is led to."""
        node = np.zeros(len(points), np.int64)
        for centres in self.levels:
            own = centres.reshape(-1, self.branching, centres.shape[1])
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                node[at] = n * self.branching + _distances(points[at], own[n]).argmin(1)
        return node

    def visit(self, point, leaves: int):
        """The first ``leaves`` leaves, best bin first."""
        queue, out, last = [(0.0, 0, 0)], [], len(self.levels)
        while queue and len(out) < leaves:
            _, level, node = heapq.heappop(queue)
            if level == last:
                out.append(node)
                continue
            children = np.arange(node * self.branching, (node + 1) * self.branching)
            far = _distances(point[None], self.levels[level][children])[0]
            for d, child in zip(far.tolist(), children.tolist()):
                if d < np.inf:
                    heapq.heappush(queue, (d, level + 1, child))
        return out


def _distances(points, centres):
    d = (points ** 2).sum(1)[:, None] - 2 * points @ np.nan_to_num(centres).T + (centres ** 2).sum(1)
    return np.where(np.isnan(d), np.inf, d)


def _kmeans(points, k, rng, rounds: int = 8):
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        label = _distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, points)
        n = np.bincount(label, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _distances(points, centres).argmin(1)


def _matrix(column):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _lengthened(x, top):
    return np.hstack([x, np.sqrt(np.maximum(top ** 2 - (x ** 2).sum(1, keepdims=True), 0))])


def _scores(q, x):
    """Inner products, each summed in one fixed way."""
    return (q * x).sum(axis=1)


def _search(batches, k):
    """Entries that may be among the best ``k`` of a query, from rows of queries and a block.  A
    task remembers each query's best scores so far and passes on what reaches the ``k``-th."""
    place, best = {}, np.zeros((0, k))
    for batch in batches:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(batch.num_rows):
            x, q = (_matrix(batch.column(n).slice(i, 1).flatten()) for n in ("vs", "qs"))
            entries, queries = (np.asarray(batch.column(n).slice(i, 1).flatten()) for n in ("entries", "queries"))
            if len(place) > KEPT:
                place, best = {}, np.zeros((0, k))
            at = np.array([place.setdefault(n, len(place)) for n in queries.tolist()])
            if len(place) > len(best):
                best = np.vstack([best, np.full((len(place) - len(best), k), -np.inf)])
            floors = np.asarray(batch.column("floors").slice(i, 1).flatten())
            best[at] = np.maximum(best[at], floors[:, None])  # k scores of at least this are known
            dots = q @ x.T
            top = -np.partition(-np.hstack([best[at], dots]), k - 1, axis=1)[:, :k]
            best[at] = top
            floor = top.min(1, keepdims=True)
            r, c = np.nonzero(dots >= floor - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isinf(floor), 1, floor))))
            out.append((queries[r], entries[c], _scores(q[r], x[c])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out)], ["q", "e", "score"])


def _pairs(wanted, blocks, k, count):
    """Rows (q, e, score) of the queries against the blocks they visit: ``wanted`` has q, v,
    the block's leaf and a score that ``k`` known entries reach (``floor``); the ``count`` queries are taken in chunks of bounded size."""
    chunks = (wanted.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-count // CHUNK)))))
              .groupBy("leaf", "chunk").agg(F.collect_list(F.struct("q", "v", "floor")).alias("z"))
              .select("leaf", F.col("z.q").alias("queries"), F.col("z.v").alias("qs"), F.col("z.floor").alias("floors")))
    joined = chunks.join(blocks, "leaf").select("queries", "qs", "floors", "entries", "vs")
    return common.map_batches(joined, lambda batches: _search(batches, k), "q bigint, e bigint, score double")


def nearest(vectors, queries, k: int = 20, key: str = "vec_id", value: str = "embedding", sample: int = 20_000,
            branching: int = 8, leaf: int = 64, probes: int = 200, target: float = 0.97, seed: int = 7):
    """The ``k`` nearest of each query row among all rows but its own."""
    rows = written(valid(vectors, key, value), "rows")
    asked = valid(queries, key, value).select(F.col("id").alias("query_id"), "v")
    # Equal vectors are one entry; of its ids the k + 1 smallest are kept, first per part.
    part = rows.withColumn("h", F.xxhash64("v")).withColumn("part", F.pmod("id", F.lit(64)))
    first = Window.partitionBy("h", "v", "part").orderBy("id")
    least = part.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    second = Window.partitionBy("h", "v").orderBy("id")
    ids = written(least.withColumn("r", F.row_number().over(second)).filter(F.col("r") <= k + 1)
                  .groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                  .withColumn("e", F.monotonically_increasing_id()), "entries")
    entries = ids.select("e", "v")
    top = ids.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = ids.orderBy(F.xxhash64("h")).limit(sample).select("v").toArrow()  # at most ``sample`` vectors
    tree = Tree(_lengthened(_matrix(fitted.column("v")), top), branching, leaf, np.random.default_rng(seed))
    shared = vectors.sparkSession.sparkContext.broadcast(tree)
    total = branching ** len(tree.levels)

    def lead(batches):
        for batch in batches:
            leaves = shared.value.leaf_of(_lengthened(_matrix(batch.column("v")), top)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], [*batch.schema.names, "leaf"])

    sizes = f"greatest(1, ceil(n / {BLOCK}))"
    led = written(common.map_batches(entries, lead, "e bigint, v array<double>, leaf bigint"), "led")
    per_leaf = led.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.expr(sizes).cast("long").alias("cuts"))
    blocks = written(led.join(per_leaf, "leaf").withColumn("cut", F.expr("pmod(xxhash64(e), cuts)"))
                     .groupBy("leaf", "cut").agg(F.collect_list(F.struct("e", "v")).alias("z"))
                     .select("leaf", F.col("z.e").alias("entries"), F.col("z.v").alias("vs")), "blocks")

    def visits(count):
        def walk(batches):
            for batch in batches:
                points = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
                found = [shared.value.visit(np.append(p, 0.0), count) for p in points]
                at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                order = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q").take(pa.array(at)), batch.column("v").take(pa.array(at)),
                     pa.array(np.array([x for f in found for x in f], np.int64)), pa.array(order, pa.int64())],
                    ["q", "v", "leaf", "turn"])
        return lambda df: common.map_batches(df, walk, "q bigint, v array<double>, leaf bigint, turn bigint")

    # Queries with equal vectors are searched once.
    asked = written(asked.withColumn("h", F.xxhash64("v")), "asked")
    points = written(asked.select("h", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "points")
    probe = points.orderBy(F.xxhash64("h")).limit(probes).select("q", "v")
    count = _calibrated(visits(total)(probe), blocks, k, total, target, probes)
    # The best k + 1 entries hold the best k other rows; an entry with many ids may fill it alone.
    cut = Window.partitionBy("q").orderBy(F.desc("score"))
    best = lambda df: df.withColumn("r", F.rank().over(cut)).filter(F.col("r") <= k + 1)
    asks, walked = points.count(), written(visits(count)(points.select("q", "v")), "visits")
    early = -(-count // 10)  # the nearest leaves show what the others must reach
    wanted = walked.filter(F.col("turn") < early).drop("turn").withColumn("floor", F.lit(float("-inf")))
    found = written(best(_pairs(wanted, blocks, k + 1, asks)).drop("r"), "near")
    floors = found.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).select(
        "q", F.when(F.col("n") > k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
    wanted = walked.filter(F.col("turn") >= early).drop("turn").join(floors, "q", "left").fillna(float("-inf"), "floor")
    found = written(best(found.union(_pairs(wanted, blocks, k + 1, asks))).select("q", "e", "score"), "found")
    hits = found.join(ids.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    named = asked.join(points, ["h", "v"]).select("q", "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (named.join(hits, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _calibrated(walked, blocks, k, total, target, probes):
    """The leaf visits at which the probes' mean recall against all rows reaches the target."""
    walked = written(walked, "walked")
    seen = _pairs(walked.drop("turn").withColumn("floor", F.lit(float("-inf"))), blocks, k, probes)  # all leaves: the exact answer
    best = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    exact = seen.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "e")
    leaf_of = blocks.select("leaf", F.explode("entries").alias("e"))
    turns = exact.join(leaf_of, "e").join(walked.select("q", "leaf", "turn"), ["q", "leaf"])
    turns = turns.select("turn").toPandas()["turn"].to_numpy()  # probes x k numbers
    if not len(turns):
        return total
    return int(np.sort(turns)[min(len(turns) - 1, int(np.ceil(target * len(turns))) - 1)]) + 1
