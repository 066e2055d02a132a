"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Sections are separated by blank lines, paragraphs by line breaks. A paragraph is cut into pieces at punctuation, so an edit only
changes the pieces that it touches. A paragraph's hash covers its text with its line break, a section's the hashes of its
paragraphs, the root those of the sections. Equal roots mean equal texts; where roots differ, only branches with other hashes
are compared, down to the pieces, which locates the edits.

A fingerprint is text: "root;section/section/...", a section "hash:paragraph,paragraph,...", a paragraph "hash.pieces", hashes
in hexadecimal digits, 6 for each piece. The likeness of two is the share of pieces they have in common (Dice, with repeats),
which only needs the pieces of differing branches.

Defined results: null counts as empty; the fingerprint of an empty text is its root alone; two empty texts have likeness 1, an
empty and another one 0; rows without doc_id come first; rows that share a doc_id follow each other by a hash of their texts; the one row of a table of one is
its own next document; extra columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty

SECTION = re.compile(r"(?<=\n)(?:[^\S\n]*\n)+")
PIECE = re.compile(r".{12,200}?[.,;:!?|]+(?:\s+|$)|.{1,200}")
WORD = re.compile(r"\S+\s*")
DIGITS = 6
#: Paragraphs of at most so many characters are cut into words.
SHORT = 64


def _hash(data: bytes, size: int) -> str:
    return blake2b(data, digest_size=size).hexdigest()


def _pieces(paragraph: str) -> str:
    digest = xxhash.xxh3_64_hexdigest
    return "".join([digest(p)[:DIGITS] for p in (PIECE if len(paragraph) > SHORT else WORD).findall(paragraph)])


def fingerprint(text: str) -> str:
    sections, at = [], 0
    cuts = [m.end() for m in SECTION.finditer(text)] if "\n" in text else []
    for end in [*cuts, len(text)]:
        if end > at:
            paragraphs = []
            for p in text[at:end].splitlines(keepends=True) if "\n" in text[at:end] else [text[at:end]]:
                paragraphs.append((blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest(), _pieces(p)))
            whole = blake2b(b"".join([h for h, _ in paragraphs]), digest_size=16).digest()
            sections.append((whole, ",".join([f"{h.hex()[:8]}.{pieces}" for h, pieces in paragraphs])))
        at = end
    root = _hash(b"".join([h for h, _ in sections]), 16)
    return ";".join([root, "/".join([f"{h.hex()[:8]}:{body}" for h, body in sections])]) if sections else root


def parse(print_: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, [(section hash, [(paragraph hash, [piece, ...]), ...]), ...])"""
    root, _, body = print_.partition(";")
    out = []
    for section in body.split("/") if body else []:
        h, _, inner = section.partition(":")
        paragraphs = [p.partition(".") for p in inner.split(",")]
        out.append((h, [(p, [x[i : i + DIGITS] for i in range(0, len(x), DIGITS)]) for p, _, x in paragraphs]))
    return root, out


def branches(print_: str) -> list[str]:
    """The sections' branches: equal strings are equal branches."""
    body = print_.partition(";")[2]
    return body.split("/") if body else []


def _paragraphs(section: str) -> list[str]:
    return section.partition(":")[2].split(",")


def _pieces_of(paragraph: str) -> list[str]:
    x = paragraph.partition(".")[2]
    return [x[i : i + DIGITS] for i in range(0, len(x), DIGITS)]


def size(print_: str) -> int:
    """The number of pieces, from the print's length: a section has 8 digits and a colon, a paragraph 8 digits, a dot and all but the first of a section a comma."""
    body = print_.partition(";")[2]
    if not body:
        return 0
    sections, paragraphs = body.count("/") + 1, body.count(".")
    return (len(body) - (sections - 1) - 9 * sections - 9 * paragraphs - (paragraphs - sections)) // DIGITS


@lru_cache(maxsize=4)
def pieces(print_: str) -> Counter:
    """All pieces; kept for the next comparison of the same print."""
    return Counter(x for section in branches(print_) for p in _paragraphs(section) for x in _pieces_of(p))


def _unlike(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What each list has that the other hasn't, counting repeats."""
    if set(a).isdisjoint(b):
        return a, b
    own, other = Counter(a), Counter(b)
    return list((own - other).elements()), list((other - own).elements())


def _common(a: Counter, b: Counter) -> int:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(n, b[x]) for x, n in a.items() if x in b)


def likeness(a: str, b: str) -> float:
    """The share of pieces in common (Dice, with repeats), found from the root down: equal branches aren't entered."""
    if a == b:
        return 1.0
    total = size(a) + size(b)
    if not total:
        return 0.0
    own, other = _unlike(mine := branches(a), theirs := branches(b))
    whole = own is mine and other is theirs
    own, other = _unlike(mine := list(chain.from_iterable(map(_paragraphs, own))), theirs := list(chain.from_iterable(map(_paragraphs, other))))
    if whole and own is mine and other is theirs:  # no branch in common
        return 2 * _common(pieces(a), pieces(b)) / total
    own, other = Counter(chain.from_iterable(map(_pieces_of, own))), Counter(chain.from_iterable(map(_pieces_of, other)))
    return (total - own.total() - other.total() + 2 * _common(own, other)) / total


def _apart(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places of either list outside of what both have in the same order."""
    ops = [op for op in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]
    return [i for _, x, y, _, _ in ops for i in range(x, y)], [j for *_, x, y in ops for j in range(x, y)]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of a that b doesn't have in that order, repeats counted: branches of equal hashes aren't entered."""
    return list(dict.fromkeys((i, j) for i, j, _ in located(a, b)))


def located(a: str, b: str) -> list[tuple[int, int, int | None]]:
    """The same down to pieces; None where a paragraph differs in nothing but spacing outside of its pieces."""
    (root_a, own), (root_b, other) = parse(a), parse(b)
    if root_a == root_b:
        return []
    left, right = _apart([h for h, _ in own], [h for h, _ in other])
    mine = [(i, j, p, x) for i in left for j, (p, x) in enumerate(own[i][1])]
    theirs = [(p, x) for i in right for p, x in other[i][1]]
    left, right = _apart([p for _, _, p, _ in mine], [p for p, _ in theirs])
    pieces = [(*mine[k][:2], n, x) for k in left for n, x in enumerate(mine[k][3])]
    changed, _ = _apart([x for *_, x in pieces], [x for k in right for x in theirs[k][1]])
    found = [pieces[k][:3] for k in changed]
    some = {(i, j) for i, j, _ in found}
    return sorted(found + [(*mine[k][:2], None) for k in left if mine[k][:2] not in some], key=lambda x: (x[0], x[1], x[2] or 0))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and fingerprint (an input column of that name is replaced)."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "fingerprint"]
    source = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text).alias("__body"))
    schema = source.drop("__body").schema.add("fingerprint", "string")

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column("__body")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], prints], names=[*names, "fingerprint"])

    return source.mapInArrow(run, schema)


def _at_most(bounds: list[float], value: Column) -> Column:
    """How many of the sorted bounds are at most value, in two steps of short arrays."""
    if not bounds:
        return F.lit(0)
    step = 64
    whole, coarse = F.lit([float(b) for b in bounds]), F.lit([float(b) for b in bounds[step - 1 :: step]] or [float("inf")])
    skipped = F.size(F.filter(coarse, lambda b: b <= value)) * step
    return skipped + F.size(F.filter(F.slice(whole, skipped + 1, F.lit(step)), lambda b: b <= value))


def in_order(docs: DataFrame, rows_a_bucket: int = 2000) -> DataFrame:
    """doc_id, body, bucket, follower, tie: rows dealt by ranges of doc_id, sorted inside partitions.

    Each bucket of neighbouring ids ends with a copy of the row that begins the next one (follower 1), the last one with the
    first row of all. Bounds come from all ids; there are as many buckets as the rows need, and rows of one doc_id stay together.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("body"))
    n = rows.count()
    buckets = max(1, -(-n // rows_a_bucket))
    if buckets == 1:
        bounds: list[int] = []
    else:
        coarse = min(buckets, 8192)  # ranges found on the driver; larger tables get larger buckets
        bounds = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [k / coarse for k in range(1, coarse)], 0.2 / coarse)))
    tied = rows.select("doc_id", "body", _at_most(bounds, F.col("doc_id")).alias("bucket"))
    tie = F.xxhash64("body")
    heads = tied.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low")).select("bucket", F.col("low.doc_id").alias("doc_id"))  # null comes first
    first = heads.select("doc_id", F.col("bucket").alias("own"), F.lag("bucket").over(Window.orderBy("bucket")).alias("to"))  # a row for each range
    last = heads.agg(F.max("bucket").alias("end"))
    first = first.crossJoin(F.broadcast(last)).select("doc_id", F.coalesce("to", "end").alias("to"))
    # of several rows with a bucket's first id, the one of the smallest tie leads
    first = first.withColumnRenamed("doc_id", "head")
    leads = tied.drop("bucket").join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("head"))).drop("head").withColumn("tie", tie)
    leads = leads.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("tie"))).where("place = 1")
    own = tied.select("doc_id", "body", "bucket", F.lit(0).alias("follower"), tie.alias("tie"))
    return own.unionByName(leads.select("doc_id", "body", F.col("to").alias("bucket"), F.lit(1).alias("follower"), "tie"))


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses; neighbours meet in sorted partitions."""
    bounded_batches(spark)
    rows = in_order(table(spark, sf_dir, "documents"))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "follower", "doc_id", "tie")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # the row before: bucket, doc_id, text, fingerprint
        for batch in batches:
            out = []
            for doc, text, bucket, follower in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "body", "bucket", "follower")], strict=True):
                print_ = fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, before, old, old_print = held
                    n = len(old)
                    k = n // 4
                    edited = old[: n - k] + text[:k]
                    edited_print = fingerprint(edited) if edited != old else old_print
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, n, digest, old_print, edited_print, likeness(old_print, edited_print), likeness(old_print, print_)))
                held = None if follower else (bucket, doc, text, print_)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)

    return dealt.select("doc_id", "body", "bucket", "follower").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
