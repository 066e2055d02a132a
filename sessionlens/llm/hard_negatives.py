"""Hard-negative mining: best-first search for windows of inner products in STR-packed R-trees.

Rows become integer vectors. They are sorted by label and first component over the cluster and cut into shards of at most
SHARD_ROWS rows of one label; each is packed as an R-tree by sort-tile-recursive (the widest coordinates first), and stored as
one row of bytes. Anchors are packed into blocks likewise. A block meets every shard that it has to search once: the blocks go
to the shard's task, one after another, behind the shard's tree.

A minimum bounding box gives, for each coordinate of an anchor, an interval of products; their sums bound the scores inside. The
queue takes boxes with the highest upper bound first (ties: the smallest id inside first) and leaves out boxes outside the score
windows and boxes whose bound is strictly below the k-th hit in (score descending, id ascending). First the trees of an anchor's
own label give its positives, then the trees of the other labels the negatives in the window of each positive; all windows of an
anchor share one descent.

Scores are exact: products are taken in double precision where all of them stay below 2 ** 53, in 64-bit integers otherwise.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with one of more than 2 ** 18 in
magnitude (whose products may not fit a long) take no part. Vectors of different lengths never meet. Repeated rows are rows of
their own: a copy of an anchor may be its positive, and every copy of an anchor has rows of its own. Anchors without a positive
and positives without a negative give no rows. Extra columns are left out of the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

SHARD_ROWS, BLOCK_ROWS = 8_192, 512
LEAF, FANOUT = 256, 16
LARGEST = float(2**18)
#: Numbers of so many shards are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_SHARDS = 100_000
FAR = 2**62


def str_order(v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of rows and starts of leaves by sort-tile-recursive, on the coordinates of the largest spread first."""
    spread = np.argsort(-(v.max(axis=0).astype(np.int64) - v.min(axis=0)), kind="stable").tolist() if v.shape[1] else []
    order, starts = [], [0]

    def cut(rows: np.ndarray, axes: list[int]) -> None:
        if len(rows) <= LEAF or not axes:
            for k in range(0, len(rows), LEAF):
                order.append(rows[k : k + LEAF])
                starts.append(starts[-1] + len(order[-1]))
            return
        leaves = -(-len(rows) // LEAF)
        slabs = leaves if len(axes) == 1 else int(np.ceil(leaves ** (1 / len(axes)) - 1e-9))
        size = -(-leaves // slabs) * LEAF
        rows = rows[np.lexsort((ids[rows], v[rows, axes[0]]))]
        for k in range(0, len(rows), size):
            cut(rows[k : k + size], axes[1:])

    cut(np.argsort(ids, kind="stable"), spread)
    return np.concatenate(order), starts[:-1]


class Tree:
    """The boxes over a shard's rows, level by level from the root; nodes of a level are numbered in packing order."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, starts: np.ndarray):
        self.ids, self.v, self.starts, self.ends = ids, v, starts, np.append(starts[1:], len(ids))
        low, high, first = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts), np.minimum.reduceat(ids, starts)
        levels = [(low, high, first)]
        while len(levels[0][0]) > 1:
            low, high, first = levels[0]
            at = np.arange(0, len(low), FANOUT)
            levels.insert(0, (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at)))
        self.sizes = [len(x[0]) for x in levels]
        self.base = np.cumsum([0, *self.sizes]).tolist()
        self.low, self.high = (np.concatenate([x[k] for x in levels]) for k in (0, 1))
        self.first = np.concatenate([x[2] for x in levels]).tolist()
        self.largest = int(np.abs(v).max(initial=0))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest product that each box allows each anchor."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, anchor: np.ndarray, least: list, most: list, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int, int]]]:
        """For each window (both ends inside) the first k rows by (score descending, id ascending), as (-score, id, place)."""
        hits: list[list] = [[] for _ in windows]
        low, high = np.array([[w[0]] for w in windows]), np.array([[w[1]] for w in windows])
        floor = low.copy()  # of the scores that still count
        queue = [(-most[0], self.first[0], 0, 0)]
        while queue:
            bound, first, level, node = heapq.heappop(queue)
            if not self.needed(-bound, least[self.base[level] + node], first, windows, hits, k):
                continue
            if level == len(self.sizes) - 1:
                start = self.starts[node]
                scores = self.v[start : self.ends[node]] @ anchor
                for w, places in self.inside(scores, floor, high):
                    found = [(-int(scores[p]), int(self.ids[start + p]), int(start + p)) for p in places.tolist()]
                    hits[w] = heapq.nsmallest(k, [*hits[w], *found])
                    if len(hits[w]) == k:
                        floor[w] = max(windows[w][0], -hits[w][-1][0])
                continue
            for child in range(node * FANOUT, min((node + 1) * FANOUT, self.sizes[level + 1])):
                at = self.base[level + 1] + child
                if self.needed(most[at], least[at], self.first[at], windows, hits, k):
                    heapq.heappush(queue, (-most[at], self.first[at], level + 1, child))
        return hits

    @staticmethod
    def inside(scores: np.ndarray, floor: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        fits = (scores >= floor) & (scores <= high)
        for w in np.flatnonzero(fits.any(axis=1)).tolist():
            yield w, np.flatnonzero(fits[w])

    @staticmethod
    def needed(most: float, least: float, first: int, windows: list, hits: list, k: int) -> bool:
        """Whether a box may hold a hit of some window: it meets the window and isn't strictly below the k-th hit."""
        for (low, high), own in zip(windows, hits, strict=True):
            if most >= low and least <= high and (len(own) < k or (-min(most, high), first) <= own[-1][:2]):
                return True
        return False


def packed(rows: DataFrame, most: int, parts: int, tree: bool) -> DataFrame:
    """Rows of one label and length in shards of at most so many: shard, label, length, ids, v, starts (bytes).

    rows: id, label, v. Sorted by label, length, first component and id over the cluster, so shards are slabs of the first
    component and a label of any size is spread over many.
    """
    order = ["label", "length", "lead", "id"]
    source = rows.select("id", "label", F.size("v").alias("length"), F.get("v", F.lit(0)).alias("lead"), "v")

    def shard(number: int, label: int, length: int, ids: list, vectors: list) -> pa.RecordBatch:
        ids, v = np.concatenate(ids), np.concatenate(vectors)
        places, starts = str_order(v, ids) if tree else (np.arange(len(ids)), [0])
        out = [[number], [label], [length], [ids[places].tobytes()], [v[places].tobytes()], [np.array(starts, dtype=np.int64).tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["shard", "label", "length", "ids", "v", "starts"])

    def run(batches):
        number, held, ids, vectors, n = TaskContext.get().partitionId() << 32, None, [], [], 0
        for batch in batches:
            labels, lengths = batch.column("label").to_numpy(), batch.column("length").to_numpy()
            changes = np.flatnonzero((np.diff(labels) != 0) | (np.diff(lengths) != 0)) + 1
            for start, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
                while start < end:
                    own = (int(labels[start]), int(lengths[start]))
                    if n and (own != held or n == most):
                        yield shard(number, *held, ids, vectors)
                        number, ids, vectors, n = number + 1, [], [], 0
                    held, stop = own, min(end, start + most - n)
                    some = batch.slice(start, stop - start)
                    ids.append(some.column("id").to_numpy())
                    vectors.append(some.column("v").flatten().to_numpy().astype(np.int32).reshape(stop - start, own[1]))
                    n, start = n + stop - start, stop
        if n:
            yield shard(number, *held, ids, vectors)

    ranged = source.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("id", "label", "length", "v").mapInArrow(run, "shard long, label long, length int, ids binary, v binary, starts binary")


def met(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, search, schema: str, tasks: int) -> DataFrame:
    """search(tree, block row) for each of the pairs (block, shard): a shard's task reads its tree, then the blocks one by one."""
    none = F.lit(None).cast
    trees = shards.select("shard", F.lit(None).cast("long").alias("block"), "length", "ids", "v", "starts", none("array<struct<place:int,positive:long,score:long>>").alias("wanted"))
    asked = blocks.join(pairs, "block").select("shard", "block", "length", "ids", "v", none("binary").alias("starts"), "wanted")
    rows = trees.unionByName(asked).repartition(tasks, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())

    def run(batches):
        tree, own = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["v"], dtype=np.int32).reshape(len(row["ids"]) // 8, row["length"]).astype(np.int64)
                if row["block"] is None:
                    tree, own = Tree(ids, v, np.frombuffer(row["starts"], dtype=np.int64)), row["shard"]
                elif row["shard"] == own:
                    exact = tree.largest * int(np.abs(v).max(initial=0)) * max(row["length"], 1) < 2**53
                    if exact and tree.v.dtype != np.float64:
                        tree.v, tree.low, tree.high = (x.astype(np.float64) for x in (tree.v, tree.low, tree.high))
                    elif not exact and tree.v.dtype == np.float64:
                        tree.v, tree.low, tree.high = (x.astype(np.int64) for x in (tree.v, tree.low, tree.high))
                    yield search(tree, row, ids, v.astype(tree.v.dtype))

    return rows.mapInArrow(run, schema)


def few_rows_a_batch(spark: SparkSession, df: DataFrame, what: str, rows: int = 32) -> DataFrame:
    """stored() with Arrow batches of few rows, as each holds a block or a tree; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        return stored(df, what)
    finally:
        spark.conf.set(name, before)


def positives_in(k: int):
    """The first k + 1 rows of each anchor in a tree of its own label; own: whether a row is the anchor itself or a copy."""

    def search(tree: Tree, row: dict, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        least, most = (x.tolist() for x in tree.bounds(v))
        out = []
        for i in range(len(ids)):
            for score, other, place in tree.search(v[i], least[i], most[i], [(-FAR, FAR)], k + 1)[0]:
                out.append((row["block"], i, int(ids[i]), other, -score, other == ids[i] and bool((tree.v[place] == v[i]).all())))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "place", "anchor", "positive", "score", "own"])

    return search


def negatives_in(k: int, low: int, high: int):
    """The first k rows of a tree in the window of each positive."""

    def search(tree: Tree, row: dict, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        least, most = (x.tolist() for x in tree.bounds(v))
        of: dict[int, list] = {}
        for w in row["wanted"]:
            of.setdefault(w["place"], []).append(w)
        out = []
        for i, wanted in of.items():
            windows = [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in wanted]
            open_ = [j for j, (a, b) in enumerate(windows) if a <= b]
            found = tree.search(v[i], least[i], most[i], [windows[j] for j in open_], k) if open_ else []
            for j, hits in zip(open_, found, strict=True):
                out += [(row["block"], i, j, int(ids[i]), wanted[j]["positive"], wanted[j]["score"], other, -score) for score, other, _ in hits]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "place", "k", "anchor", "positive", "positive_score", "negative", "negative_score"])

    return search


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """rows whose id, label and vector take part, with v: floor(scale * component)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    some = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(F.forall(vector, fine))
    return some.withColumn("v", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def hard_negatives(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors. A negative has low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    vectors = stored(integer_vectors(rows, "vector", scale).select("id", "label", "v", "anchor"), "integer-vectors")
    n, asked = vectors.count(), vectors.where("anchor").count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return spark.createDataFrame([], result)
    shards = stored(packed(vectors.select("id", "label", "v"), SHARD_ROWS, -(-n // SHARD_ROWS), True), "trees")
    blocks = stored(packed(vectors.where("anchor").select("id", "label", "v"), BLOCK_ROWS, -(-asked // BLOCK_ROWS), False), "anchors").withColumnRenamed("shard", "block")
    places = shards.select("shard", F.col("label").alias("shard_label"), F.col("length").alias("shard_length"))
    count = places.count()
    places = F.broadcast(places) if count <= BROADCAST_SHARDS else places
    meeting = blocks.select("block", "label", "length")
    tasks = max(spark.sparkContext.defaultParallelism, min(count, 2_000))
    none = F.lit(None).cast("array<struct<place:int,positive:long,score:long>>").alias("wanted")

    near = meeting.join(places, (F.col("label") == F.col("shard_label")) & (F.col("length") == F.col("shard_length"))).select("block", "shard")
    found = few_rows_a_batch(spark, met(shards, blocks.withColumn("wanted", none), near, positives_in(positives), "block long, place int, anchor long, positive long, score long, own boolean", tasks), "same-label")
    best = [F.col("score").desc(), "positive"]
    one = Window.partitionBy("block", "place")
    first = found.withColumn("r", F.row_number().over(one.orderBy(*best))).where(F.col("r") <= positives + 1)
    # of the rows equal to the anchor one is the anchor itself
    others = first.withColumn("self", F.col("own") & (F.row_number().over(Window.partitionBy("block", "place", "own").orderBy(*best)) == 1)).where("NOT self")
    chosen = others.withColumn("r", F.row_number().over(one.orderBy(*best))).where(F.col("r") <= positives)
    wanted = chosen.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "r", "positive", "score"))).alias("w")).select("block", F.transform("w", lambda x: F.struct(x["place"].alias("place"), x["positive"].alias("positive"), x["score"].alias("score"))).alias("wanted"))

    far = meeting.join(places, (F.col("label") != F.col("shard_label")) & (F.col("length") == F.col("shard_length"))).select("block", "shard")
    asking = stored(blocks.join(wanted, "block"), "positives")
    hits = few_rows_a_batch(spark, met(shards, asking, far, negatives_in(negatives, low, high), "block long, place int, k int, anchor long, positive long, positive_score long, negative long, negative_score long", tasks), "other-labels")
    rank = F.row_number().over(Window.partitionBy("block", "place", "k").orderBy(F.col("negative_score").desc(), "negative"))
    out = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    for old in (vectors, shards, blocks, found, asking):
        dropped(spark, old)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors: every fiftieth id; every seventh id has its label moved by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s USING (r) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
