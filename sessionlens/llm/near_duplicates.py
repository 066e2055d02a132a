"""N-gram Jaccard join by MinHash banding.

Rows and bands are chosen for a recall at the threshold. Texts of equal shingle sets are copies and count once from there on.
Copies need no pairs; different texts meet in the buckets of their band hashes, in two steps. First every text is verified, on
full shingle sets, against the first text of each of its buckets. Then the buckets whose members aren't all similar to the first one are dealt
into parts; each two parts of a bucket meet in a task, which verifies all their pairs from postings of shingles and gives only
links that join what wasn't joined there. So a bucket of any size is resolved without a
row for a pair. Classes are the connected components of the links. Links are counted afterwards in the same way: a class is dealt
into parts, each two parts meet in one task, and the similar pairs between them are counted, so every pair of a class is verified.

Defined results: null counts as empty; a text without words has no shingles, no links and its own class; repeated rows are
copies of each other; doc_id ties get the same class when their texts do; extra columns are left out of the result.
Texts are told apart by 64-bit hashes of their shingle sets.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, dropped, giving_back, slices, stored, table, text_or_empty
from .shingles import distinct_by_row, mix, shingle_hashes

#: Ids of at most so many texts are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts and characters that a part of a class has about, where its links are counted.
PART_TEXTS, PART_CHARS = 256, 1_000_000


#: A key is hot from this share of all rows on; so there are at most 1 / HOT_SHARE hot ones.
HOT_SHARE = 1e-3


def joined(rows: DataFrame, sums: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the columns of sums (a row per key; n is how many of the total rows have it). Rows of hot keys stay in the tasks they are in."""
    most = max(1.0, HOT_SHARE * total)
    hot = sums.where(F.col(n) > most)  # at most 1 / HOT_SHARE rows
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(sums.where(F.col(n) <= most), key)
    return many.unionByName(few)


def bands_for(threshold: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the largest rows for which bands * rows <= most hashes find a pair at the threshold with that recall."""
    for rows in range(8, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall")


def body_key(text: str = "text") -> Column:
    """Tells texts apart where doc_id doesn't: repeated and null ids."""
    return F.xxhash64(text_or_empty(text))


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body_key (hash of the text), text_key (hash of the shingle set; null without words), n_shingles, buckets (a hash for each band)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_).alias("doc_id"), body_key(text).alias("body_key"), text_or_empty(text).alias("__body"))
    schema = T.StructType([source.schema["doc_id"], source.schema["body_key"], T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    seeds = np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in chain.from_iterable(slices(b, ["__body"]) for b in batches):
            values, starts = distinct_by_row(*shingle_hashes(batch.column("__body"), n))
            sizes = np.diff(starts)
            some = np.flatnonzero(sizes)
            keys = np.zeros(len(sizes), dtype=np.uint64)
            hashed = np.zeros((len(some), bands), dtype=np.uint64)
            if len(some):
                at = starts[:-1][some]
                keys[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at) + sizes[some].astype(np.uint64))
                for b in range(bands):
                    band = np.full(len(some), b + 1, dtype=np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        x = values * seeds[k]
                        x ^= x >> np.uint64(32)
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at))
                    hashed[:, b] = band
            rank = np.cumsum(sizes > 0)
            offsets = np.concatenate([[0], rank]) * bands
            buckets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashed.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body_key"), pa.array(keys.view(np.int64), mask=sizes == 0), pa.array(sizes, pa.int32()), buckets], names=schema.names)

    return source.mapInArrow(giving_back(run), schema)


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (leader, member) with the jaccard of their full shingle sets; texts: text_key, body."""
    both = pairs.join(texts.select(F.col("text_key").alias("leader"), F.col("body").alias("a")), "leader").join(texts.select(F.col("text_key").alias("member"), F.col("body").alias("b")), "member")

    def run(batches):
        for batch in chain.from_iterable(slices(b, ["a", "b"]) for b in batches):
            a_all, a_at = distinct_by_row(*shingle_hashes(batch.column("a"), n))
            b_all, b_at = distinct_by_row(*shingle_hashes(batch.column("b"), n))
            found = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                a, b = a_all[a_at[i] : a_at[i + 1]], b_all[b_at[i] : b_at[i + 1]]
                shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                found[i] = shared / (len(a) + len(b) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("member"), pa.array(found)], names=["leader", "member", "jaccard"])

    return both.select("leader", "member", "a", "b").mapInArrow(giving_back(run), "leader long, member long, jaccard double")


def connected(links: DataFrame, a: str = "leader", b: str = "member") -> DataFrame:
    """node, root: the smallest node of each connected component. Smallest labels of neighbours, then pointer jumping."""
    spark = links.sparkSession
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("low"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("root", F.coalesce("low", "root")).alias("next"), "root")
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        fresh = stored(hooked.join(jump, "next", "left").select("node", F.coalesce("far", "next").alias("root"), (F.coalesce("far", "next") != F.col("root")).alias("moved")), "labels")
        done = fresh.where("moved").isEmpty()
        dropped(spark, labels)
        labels = fresh.drop("moved")
        if done:
            dropped(spark, edges)
            return labels


def distinct_texts(signed: DataFrame) -> DataFrame:
    """A row per text_key: its buckets, copies, smallest doc_id (low) and the smallest row (place) that has it."""
    place = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "body_key"))
    known = signed.where("text_key is not null").groupBy("text_key")
    return stored(known.agg(F.first("buckets").alias("buckets"), F.count("*").alias("n_copies"), F.min("doc_id").alias("low"), place.alias("place")), "distinct")


def bodies_of(unique: DataFrame, wanted: DataFrame, docs: DataFrame, id_: str, text: str) -> DataFrame:
    """text_key, body of the wanted texts, each from its smallest row."""
    ids = stored(unique.join(wanted, "text_key").select("text_key", F.col("place.doc_id").alias("own"), F.col("place.body_key").alias("own_key")), "wanted")
    small = ids.count() <= BROADCAST_IDS
    bodies = docs.select(F.col(id_).alias("doc_id"), body_key(text).alias("body_key"), text_or_empty(text).alias("body"))
    bodies = bodies.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("body_key") == F.col("own_key")))
    return stored(bodies.select("text_key", "body").dropDuplicates(["text_key"]), "texts")


def find_classes(unique: DataFrame, docs: DataFrame, n: int, threshold: float, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """The texts that share a bucket with others (text_key, body), and the classes of those with links (node, root)."""
    spark = unique.sparkSession
    rows = unique.select("text_key", F.explode("buckets").alias("bucket"))
    shared = stored(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("text_key").alias("leader")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    members = stored(joined(rows, shared, "bucket", "n", total).select("bucket", "leader", F.col("text_key").alias("member")), "buckets")
    if members.isEmpty():
        return unique.limit(0).select("text_key", F.lit("").alias("body")), None
    texts = bodies_of(unique, members.select(F.col("member").alias("text_key")).distinct(), docs, id_, text)
    # everything meets the first text of its buckets; buckets where not all are similar to that one are looked at as a whole
    pairs = stored(verified(members.where("leader != member").select("leader", "member").distinct(), texts, n), "pairs")
    good = pairs.where(F.col("jaccard") >= threshold).select("leader", "member")
    placed = members.join(good.withColumn("linked", F.lit(True)), ["leader", "member"], "left").select("bucket", "member", F.when(F.col("linked"), F.col("leader")).otherwise(F.col("member")).alias("root"))
    alike = [F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("member", "root").cast("decimal(38,0)")).alias("sum")]
    # buckets of the same members (by number and hashes) are worked on once
    apart = placed.groupBy("bucket").agg(*alike).where("low < high").groupBy("n", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    more = links_apart(joined(placed, apart, "bucket", "n", total).drop("n"), texts, n, threshold, total)
    labels = connected(good.unionByName(more))
    for old in (shared, members, pairs):
        dropped(spark, old)
    return texts, labels


def in_parts(rows: DataFrame, group: str, total: int) -> DataFrame:
    """rows (group, text_key, body, ...) dealt into parts of their groups, each part once for each part of the group: low, high, part.

    So every two parts of a group meet in the rows of one (group, low, high), and a part meets itself.
    """
    parts = F.ceil(F.greatest(F.count("*") / PART_TEXTS, F.sum(F.length("body")) / PART_CHARS)).cast("int")
    sizes = rows.groupBy(group).agg(parts.alias("parts"), F.count("*").alias("members"))
    dealt = joined(rows, sizes, group, "members", total).withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)))
    met = met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", "parts", "members")
    return met.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def meetings(batches, n: int, columns: list[str]):
    """The rows of each (group, low, high) after one another: (columns, part) as arrays and the shingle sets."""
    held, rows, sets = None, [], []
    for batch in chain.from_iterable(slices(b, ["body"]) for b in batches):
        values, starts = distinct_by_row(*shingle_hashes(batch.column("body"), n))
        for i, (*group, part, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in (columns[0], "low", "high", "part", *columns[1:])], strict=True)):
            if group != held:
                if _both_there(held, rows):
                    yield rows, sets
                held, rows, sets = group, [], []
            rows.append((part, a, b))
            sets.append(values[starts[i] : starts[i + 1]])
    if _both_there(held, rows):
        yield rows, sets


def _both_there(group, rows) -> bool:
    """Two parts of which one is empty are left out: what the other has meets itself elsewhere."""
    return bool(rows) and (group[1] == group[2] or len({r[0] for r in rows}) == 2)


def links_apart(still: DataFrame, texts: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """Links (leader, member) inside buckets. still: bucket, member, root (what it is linked to). Of a meeting only the links of a forest over its roots come out."""
    rows = stored(still.select("bucket", F.col("member").alias("text_key"), "root"), "apart").join(texts, "text_key")

    def run(batches):
        for met, sets in meetings(batches, n, ["bucket", "text_key", "root"]):
            parts, keys, up = np.array([r[0] for r in met]), [r[1] for r in met], {r[2]: r[2] for r in met}

            def top(x: int, up=up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            roots, found = [r[2] for r in met], []
            for j, near in similar_pairs(sets, parts, threshold):
                for i in near.tolist():
                    x, y = top(roots[i]), top(roots[j])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        found.append((keys[i], keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["leader", "member"])

    return in_parts(rows, "bucket", total).select("bucket", "low", "high", "part", "text_key", "root", "body").mapInArrow(giving_back(run), "leader long, member long").distinct()


def similar_pairs(sets: list[np.ndarray], parts: np.ndarray, threshold: float):
    """(j, the similar ones of the first part) for each set of the other part, or of the only one (itself left out). Sets are sorted and distinct."""
    sizes, own = np.array([len(x) for x in sets]), parts == parts.min()
    left, right = np.flatnonzero(own), np.arange(len(sets)) if own.all() else np.flatnonzero(~own)
    values, owner = np.concatenate([sets[i] for i in left]), np.repeat(np.arange(len(left)), sizes[left])
    order = np.argsort(values, kind="stable")
    owner = owner[order]
    values, begins, counts = np.unique(values[order], return_index=True, return_counts=True)
    for j in right:
        at = np.minimum(np.searchsorted(values, sets[j]), len(values) - 1)
        at = at[values[at] == sets[j]]
        k = counts[at]
        postings = np.repeat(begins[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
        shared = np.bincount(owner[postings], minlength=len(left))
        near = left[shared / (sizes[left] + sizes[j] - shared) >= threshold]
        yield j, near[near != j]


def degrees(texts: DataFrame, labels: DataFrame, n: int, threshold: float) -> DataFrame:
    """text_key, degree: the other texts of its class that a text is similar to, of all pairs of the class."""
    own = texts.join(labels.withColumnRenamed("node", "text_key"), "text_key").select("text_key", "root", "body")

    def run(batches):
        for met, sets in meetings(batches, n, ["root", "text_key", "text_key"]):
            parts, found = np.array([r[0] for r in met]), np.zeros(len(met), dtype=np.int64)
            alone = len(set(parts.tolist())) == 1
            for j, near in similar_pairs(sets, parts, threshold):
                found[j] += len(near)
                if not alone:
                    found[near] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in met], pa.int64()), pa.array(found)], names=["text_key", "k"])

    counted = in_parts(own, "root", own.count()).select("root", "low", "high", "part", "text_key", "body").mapInArrow(giving_back(run), "text_key long, k long")
    return counted.groupBy("text_key").agg(F.sum("k").alias("degree"))


def with_texts(signed: DataFrame, per_text: DataFrame) -> DataFrame:
    """signed rows (doc_id, text_key) with the columns of per_text. Null keys get nulls."""
    rows = signed.select("doc_id", "text_key")
    found = joined(rows.where("text_key is not null"), per_text, "text_key", "n_copies", rows.count())
    return found.unionByName(rows.where("text_key is null"), allowMissingColumns=True)


def similarity_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links, n_copies, class_texts.

    n_links counts the other copies of the text and the different texts of its class that it is similar to.
    """
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, n, bands, rows, id_, text), "signatures")
    unique = distinct_texts(signed)
    bodies, roots = find_classes(unique, docs, n, threshold, id_, text)
    texts = unique.select("text_key", "n_copies", "low")
    if roots is None:  # no bucket has two texts
        texts = texts.withColumns({"root": F.col("text_key"), "degree": F.lit(0)})
    else:
        known = roots.withColumnRenamed("node", "text_key").join(degrees(bodies, roots, n, threshold), "text_key", "left")
        texts = texts.join(known, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    classes = texts.groupBy("root").agg(F.min("low").alias("class_id"), F.count("*").alias("class_texts"))
    per_text = stored(texts.join(classes, "root").select("text_key", "class_id", "n_copies", "class_texts", (F.coalesce("degree", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")), "classes")
    out = with_texts(signed, per_text)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each class: that of the smallest doc_id (null comes last), of its texts the one with the smallest hash.

    Rows without words stay, as they are classes of their own; only repeated rows of one doc_id and text count once there.
    """
    bands, rows = bands_for(threshold, recall=0.9995)
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    unique = distinct_texts(signed)
    _, roots = find_classes(unique, docs, n, threshold)
    first = unique.select("text_key", "place")
    if roots is not None:
        rooted = first.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
        first = rooted.groupBy(F.coalesce("root", "text_key").alias("root")).agg(F.min("place").alias("place"))
    chosen = first.select(F.col("place.doc_id").alias("__doc_id"), F.col("place.body_key").alias("__text"), F.lit(False).alias("__alone"))
    wordless = signed.where("text_key is null").select("doc_id", "body_key", F.isnull("doc_id")).distinct()
    chosen = chosen.union(wordless)
    kept = docs.withColumn("__body_key", body_key()).join(chosen, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__body_key") == F.col("__text")))
    kept = kept.withColumn("__row", F.when(F.col("__alone"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", "__body_key", "__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its class and links at five words and 0.8."""
    return similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
