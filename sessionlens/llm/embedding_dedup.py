"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector kept of each group.

Equal vectors of a label are one class that stands for its copies. Centroids are fitted on a bounded sample of the classes
(SAMPLE rows, the smallest hashes); every class gets its home cell, that of the nearest centroid, and visits each cell whose
border is at most half the link distance away. Two unit vectors with cosine t are sqrt(2 - 2t) apart, and the segment between
them crosses the plane midway between the centroids of their cells, so one of the two is within half of that of the plane: each
linked pair meets in the home cell of one of them, and no link is lost whatever the centroids are. A pair that meets in both is
counted in the smaller cell.

The rows of a (label, length, cell) are dealt into parts; each two parts meet in a task, which multiplies them in blocks and gives
a count for each row and the links of a forest, never a row for a pair. Groups are the connected components of the forests.

Defined results: rows whose label or vector is null, or whose vector is empty, zero or holds a null or non-finite component link
with nothing and are kept. Vectors of different lengths never link. Repeated rows are vectors of their own; a null vec_id is
larger than any other, and is the component_id only of groups that have no other. Extra columns are left out of the result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .near_duplicates import connected, joined

#: Rows that centroids are fitted on, at most; cells at most; rows of one cell, about.
SAMPLE, CELLS, CELL_ROWS = 16_384, 256, 2_048
#: Rows of a part; of a block of a product.
PART_ROWS, BLOCK = 4_096, 512
#: Borders are widened by this, against rounding.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector is there, not zero and wholly finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as unit vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow in the norm
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k different unit centroids of unit vectors, from the first k of them on."""
    centres = np.unique(x[:k], axis=0)
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return np.unique(centres, axis=0)


def fit_cells(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length of the sample. classes: key, vector."""
    rows = classes.select("key", "vector").orderBy("key").limit(SAMPLE).toArrow()
    by_length: dict[int, list] = {}
    for v in rows.column("vector").to_pylist():
        by_length.setdefault(len(v), []).append(v)
    k = max(1, min(CELLS, n // CELL_ROWS))
    return {d: spherical_kmeans(matrix(pa.array(v, pa.list_(pa.float64()))), k) for d, v in by_length.items()}


def in_cells(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """A row for each cell that a class lives in or visits: key, label, copies, vector, length, home, visits (bits), cell."""
    half = np.sqrt(2 - 2 * threshold) / 2
    apart = {d: np.linalg.norm(c[:, None] - c[None], axis=2) for d, c in centres.items()}
    names = ["key", "label", "copies", "vector"]
    kind = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in names) + ", length int, home int, visits binary, cell int"

    def run(batches):
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                if d in centres:
                    near = matrix(own.column("vector")) @ centres[d].T
                    home = near.argmax(axis=1)
                    visits = near.max(axis=1)[:, None] - near <= half * apart[d][home] + SLACK
                else:  # a length that the sample lacks is one cell
                    home, visits = np.zeros(own.num_rows, dtype=np.int64), np.ones((own.num_rows, 1), dtype=bool)
                row, cell = np.nonzero(visits)
                bits = [b.tobytes() for b in np.packbits(visits, axis=1)]
                out = own.select(names).take(pa.array(row))
                more = [pa.array(np.full(len(row), d), pa.int32()), pa.array(home[row], pa.int32()), pa.array(bits, pa.binary()).take(pa.array(row)), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*names, "length", "home", "visits", "cell"])

    return classes.select(*names).mapInArrow(run, schema)


def in_tiles(rows: DataFrame) -> DataFrame:
    """rows dealt into parts of their cells, each part once for each part of the cell: low, high, part. Cells where none is at home go."""
    cell = ["label", "length", "cell"]
    at_home = F.col("home") == F.col("cell")
    sizes = rows.groupBy(*cell).agg(F.count_if(at_home).alias("homes"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).where("homes > 0").drop("homes")
    dealt = rows.join(F.broadcast(sizes) if sizes.limit(CELLS * 64).count() < CELLS * 64 else sizes, cell)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", "parts")


def compare(a: dict, b: dict, cell: int, threshold: float, same: bool):
    """Counts of a's and b's links (weighted by copies) and the links of a forest; a and b are parts of the cell, or one part twice."""
    n_a, n_b = np.zeros(len(a["copies"]), dtype=np.int64), np.zeros(len(b["copies"]), dtype=np.int64)
    tree = np.arange(len(n_a) + (0 if same else len(n_b)))  # which tree of the forest a row is in
    shift, edges = 0 if same else len(n_a), []
    guest_b = b["home"] != cell
    for start in range(0, len(n_a), BLOCK):
        rows = slice(start, min(start + BLOCK, len(n_a)))
        linked = a["unit"][rows] @ b["unit"].T >= threshold
        guest_a = (a["home"] != cell)[rows]
        linked &= ~(guest_a[:, None] & guest_b[None, :])
        # a pair that the home cell of the guest, a smaller one, also sees is counted there
        linked &= ~((guest_a & (a["home"][rows] < cell))[:, None] & b["visits"][:, a["home"][rows]].T)
        linked &= ~((guest_b & (b["home"] < cell))[None, :] & a["visits"][rows][:, b["home"]])
        if same:
            linked[np.arange(linked.shape[0]), np.arange(rows.start, rows.stop)] = False
        n_a[rows] = linked @ b["copies"]
        if not same:
            n_b += a["copies"][rows] @ linked
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            others = np.flatnonzero(linked[i])
            trees, first = np.unique(tree[shift + others], return_index=True)
            for t, j in zip(trees.tolist(), others[first].tolist(), strict=True):
                if t != (own := tree[start + i]):
                    edges.append((start + i, j))
                    tree[tree == t] = own
    return n_a, n_b, edges


def products(tiles: DataFrame, threshold: float) -> DataFrame:
    """key, other, links: a row with its count for each row of a tile (other: null), and a row for each link of the tile's forest (links: 0)."""

    def run(group: pa.Table) -> pa.Table:
        at = {c: group.column(c)[0].as_py() for c in ("cell", "low", "high")}
        vectors = group.column("vector").combine_chunks()
        bits = np.frombuffer(b"".join(group.column("visits").to_pylist()), dtype=np.uint8).reshape(group.num_rows, -1)
        of = {"unit": matrix(vectors), "home": group.column("home").to_numpy(), "copies": group.column("copies").to_numpy(), "visits": np.unpackbits(bits, axis=1).astype(bool)}
        part, keys = group.column("part").to_numpy(), np.array(group.column("key").to_pylist(), dtype=object)
        same = at["low"] == at["high"]
        left = np.flatnonzero(part == at["low"])
        right = left if same else np.flatnonzero(part == at["high"])
        n_a, n_b, edges = compare({k: v[left] for k, v in of.items()}, {k: v[right] for k, v in of.items()}, at["cell"], threshold, same)
        counted = np.concatenate([keys[left], [] if same else keys[right]])
        counts = np.concatenate([n_a, [] if same else n_b]).astype(np.int64)
        some = np.flatnonzero(counts)
        ends = [(keys[left[i]], keys[right[j]]) for i, j in edges]
        return pa.table({
            "key": pa.array([*counted[some], *[e[0] for e in ends]], pa.string()),
            "other": pa.array([None] * len(some) + [e[1] for e in ends], pa.string()),
            "links": pa.array(np.concatenate([counts[some], np.zeros(len(ends), dtype=np.int64)]), pa.int64()),
        })

    return tiles.groupBy("label", "length", "cell", "low", "high").applyInArrow(run, "key string, other string, links long")


def near_groups(embeddings: DataFrame, threshold: float = 0.98, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, copies (rows with this very vector and label)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies over 0 and is 1 at most")
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    takes_part = F.col("label").isNotNull() & usable("vector")
    key = F.concat_ws("-", F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64(F.lit(7), "vector", "label")))
    keyed = rows.withColumn("key", F.when(takes_part, key))
    classes = stored(keyed.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("low")), "vector-classes")
    n, total = classes.count(), classes.agg(F.sum("copies")).first()[0] or 0
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies"))
    placed = stored(in_cells(classes, fit_cells(classes, n), threshold), "cells")
    found = stored(products(in_tiles(placed), threshold), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.select("key", "copies", "low").join(counts, "key", "left")
    edges = found.where("other is not null")
    if edges.isEmpty():
        linked = linked.withColumn("root", F.col("key"))
    else:
        linked = linked.join(connected(edges, "key", "other").withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"))
    per_class = stored(joined(linked, groups, "root", "classes", n).select("key", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-groups")
    for old in (classes, placed, found):
        dropped(spark, old)
    some = joined(keyed.where("key is not null").select("vec_id", "key"), per_class, "key", "copies", total)
    out = some.select("vec_id", "n_links", "component_id", "copies").unionByName(keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("copies")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "copies")


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings, linked at cosine 0.98 and more within a label."""
    return near_groups(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE e AS (
    SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
        label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
    FROM embeddings),
pair AS (SELECT a.r AS r, b.r AS s, b.vec_id AS sid FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r AND a.ok AND b.ok AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT r, r AS s FROM e UNION SELECT reach.r, pair.s FROM reach JOIN pair ON reach.s = pair.r),
low AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.s GROUP BY reach.r),
n AS (SELECT r, count(*) AS n FROM pair GROUP BY r),
same AS (SELECT a.r, count(*) AS k FROM e a JOIN e b ON a.label = b.label AND a.v = b.v AND a.ok AND b.ok GROUP BY a.r)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept, coalesce(k, 1) AS copies
FROM e LEFT JOIN low USING (r) LEFT JOIN n USING (r) LEFT JOIN same USING (r)
"""
