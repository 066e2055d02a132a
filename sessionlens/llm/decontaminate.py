"""Benchmark decontamination with an FM-index per training shard.

Phrases are windows of consecutive benchmark words (items shorter than a window are one window). Documents are gathered into
shards of a bounded number of words. A shard's text is all words of its documents as integers, with a separator after each document. Over
that text a suffix array is built, its Burrows-Wheeler transform goes into a wavelet matrix, and all phrases whose words the shard
has are searched backwards at once through its ranks, one block of the benchmark after another in the same index. Occurrences are
located by walking to sampled suffix positions, and their spans are merged. Words are told apart by 64-bit hashes.

Defined results: null and word-less texts have no words and are clean; an empty benchmark leaves all documents clean; benchmark
rows with the same id (null too) count as one item with the windows of all of them; repeated documents are treated each by itself; other
columns of the input are carried on unless a result column has their name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, giving_back, slices, table, text_or_empty
from .shingles import word_hashes

#: Lower-cases A-Z and turns every byte that isn't part of a word into a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class WaveletMatrix:
    """Ranks of any symbol in a sequence: for each bit of the symbols a bit vector in words of 64, with the ones before each word."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            words, packed = np.zeros(len(bit) // 64 + 1, dtype="<u8"), np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words))
            self.zeros.append(len(bit) - int(np.count_nonzero(bit)))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many ones level k has before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low_ones, at_ones = self.ones(k, low), self.ones(k, at)
            low = np.where(bit == 1, self.zeros[k] + low_ones, low - low_ones)
            at = np.where(bit == 1, self.zeros[k] + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            low_ones, at_ones = self.ones(k, low), self.ones(k, at)
            symbol = symbol * 2 + bit
            low = np.where(bit == 1, self.zeros[k] + low_ones, low - low_ones)
            at = np.where(bit == 1, self.zeros[k] + at_ones, at - at_ones)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text must have no equal suffixes within len(text), which unlike separators ensure.

    A suffix's rank is the first place of its group of equal prefixes; only groups of more than one are sorted on.
    """
    n = len(text)
    place = np.int32 if n < 2**31 else np.int64
    order = np.argsort(text, kind="stable").astype(place)
    begins = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])
    first = np.maximum.accumulate(np.where(begins, np.arange(n, dtype=place), place(0)))
    rank = np.empty(n, dtype=place)
    rank[order] = first
    open_ = np.flatnonzero(~begins | np.append(~begins[1:], False)).astype(place)
    step = 1
    while len(open_):
        at = order[open_]
        key = first[open_].astype(np.int64)
        key *= n + 1
        inside = at < n - step
        key[inside] += rank[at[inside] + place(step)]
        key[inside] += 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        del by, key, inside
        own = np.maximum.accumulate(np.where(begins, open_, place(0)))
        order[open_], first[open_] = at, own
        rank[at] = own
        open_ = open_[~begins | np.append(~begins[1:], False)]
        step *= 2
    return order


class FMIndex:
    """text: word ids from 1 on, 0 a separator; it must end with 0. Every separator sorts by its place, so that suffixes differ."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        n, gaps = len(text), np.flatnonzero(text == 0)
        unlike = text + len(gaps)
        unlike[gaps] = np.arange(len(gaps))
        order = suffix_array(unlike)
        del unlike
        self.tree = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))  # of the first suffix: the last symbol, a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        starts = np.zeros(n, dtype=bool)
        starts[:: self.SAMPLE] = True
        starts[0] = True
        starts[gaps[:-1] + 1] = True  # no walk leaves its run
        self.sampled = starts[order]
        self.sample_rank = np.cumsum(self.sampled, dtype=order.dtype) - self.sampled
        self.samples = order[self.sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of phrases (of one length): the intervals of suffixes that begin with each."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        dead = np.ones(len(phrases), dtype=bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one and add the steps."""
        found, steps = np.empty(len(rows), dtype=np.int64), 0
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            done = self.sampled[at]
            found[left[done]] = self.samples[self.sample_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol, rank = self.tree.access(at)
                at = self.first[symbol] + rank
                steps += 1
        return found


@dataclass
class Phrases:
    """Windows of a block of the benchmark; by length, the hashes of their words (a row each) and the items that have them."""

    windows: dict[int, tuple[np.ndarray, list[tuple]]]


def phrases_of(items: list[tuple[int, str]], size: int) -> Phrases:
    hashes, starts = word_hashes(pa.array([text or "" for _, text in items], pa.string()))
    owners: dict[bytes, set] = defaultdict(set)
    for (item, _), a, b in zip(items, starts, starts[1:]):
        n = min(size, int(b - a))
        for k in range(a, b - n + 1) if n else ():
            owners[hashes[k : k + n].tobytes()].add(item)
    by_length: dict[int, list[bytes]] = defaultdict(list)
    for window in owners:
        by_length[len(window) // 8].append(window)
    return Phrases({n: (np.frombuffer(b"".join(ws), dtype=np.uint64).reshape(-1, n), [tuple(owners[w]) for w in ws]) for n, ws in by_length.items()})


def search_shard(hashes: np.ndarray, starts: np.ndarray, blocks: list[Phrases]) -> tuple[list[set], np.ndarray]:
    """hashes: all words of the shard's documents; starts: where each one's begin (one more than documents). Each document's items, and which words are hit."""
    items: list[set] = [set() for _ in starts[1:]]
    marks = np.zeros(len(hashes) + 1, dtype=np.int32)
    if len(hashes) and any(b.windows for b in blocks):
        known, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int32 if len(ids) + len(starts) < 2**31 else np.int64)
        index = FMIndex(np.insert(ids + 1, starts[1:], 0), len(known))
        for block in blocks:
            for size, (windows, owners) in block.windows.items():
                ids = np.minimum(np.searchsorted(known, windows), len(known) - 1)
                there = np.flatnonzero((known[ids] == windows).all(axis=1))
                low, high = index.search(ids[there] + 1)
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                counts = (high - low)[hit]
                which = there[np.repeat(hit, counts)]
                rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
                at = index.locate(rows)
                docs = np.searchsorted(starts[1:] + np.arange(len(starts) - 1), at)  # the separators' places
                at = at - docs
                np.add.at(marks, at, 1)
                np.add.at(marks, at + size, -1)
                for d, w in np.unique(np.stack([docs, which], axis=1), axis=0):
                    items[d].update(owners[w])
    return items, np.cumsum(marks[:-1]) > 0


def char_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans of code points from the first to the last word of each run of hit words."""
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(data.translate(FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [(places[a][0], places[b - 1][1]) for a, b in edges.reshape(-1, 2)]
    out, at, chars = [], 0, 0
    for a, b in spans:
        chars += len(data[at:a].decode())
        size = len(data[a:b].decode())
        out.append((chars, chars + size))
        chars, at = chars + size, b
    return out


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def benchmark_blocks(benchmark: DataFrame, max_items: int, item: str = "item_id", text: str = "text"):
    """The benchmark in blocks of at most max_items rows, one at a time on the driver; usually one."""
    rows, block = benchmark.select(F.col(item).cast("long").alias("i"), text_or_empty(text).alias("t")).orderBy("i", "t").toLocalIterator(), []
    for r in rows:
        block.append((r.i, r.t))
        if len(block) == max_items:
            yield block
            block = []
    if block:
        yield block


def find_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1_000_000, max_items: int = 20_000, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted) and spans (code points to remove, merged) to keep (all columns).

    A larger benchmark is searched in blocks of max_items rows, one shared with the executors after another.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in RESULT.names]
    own = text in names and docs.schema[text].dataType == T.StringType()  # then the text goes to Python once
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if own else [text_or_empty(text).alias("__body")]))
    schema = T.StructType([source.schema[c] for c in names] + RESULT.fields)
    column = text if own else "__body"
    shared = [spark.sparkContext.broadcast(phrases_of(b, window)) for b in benchmark_blocks(benchmark, max_items)]

    def run(batches):
        blocks = [b.value for b in shared]
        held, texts, hashes, sizes, n = [], [], [], [], 0

        def finish():
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            items, hit = search_shard(np.concatenate(hashes), starts, blocks)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[starts[1:]] - total[starts[:-1]]
            at = 0
            for batch, bodies in zip(held, texts, strict=True):
                here = range(at, at + batch.num_rows)
                at += batch.num_rows
                spans = [[{"start": a, "end": b} for a, b in char_spans(bodies[d - here.start].as_py(), hit[starts[d] : starts[d + 1]])] if n_hit[d] else [] for d in here]
                ids = [sorted(items[d], key=lambda i: (i is not None, i or 0)) for d in here]
                more = [pa.array(np.diff(starts)[here.start : at]), pa.array(n_hit[here.start : at].astype(np.int64)), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, SPANS)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], names=[*names, *RESULT.names])

        for batch in chain.from_iterable(slices(b, [column]) for b in batches):
            body = pc.fill_null(batch.column(column), "")
            own, starts = word_hashes(body)
            held.append(batch)
            texts.append(body)
            hashes.append(own)
            sizes += np.diff(starts).tolist()
            n += len(own)
            if n >= shard_words:
                yield from finish()
                held, texts, hashes, sizes, n = [], [], [], [], 0
        if held:
            yield from finish()

    return source.mapInArrow(giving_back(run), schema)


def remove_spans(text, spans):
    """The text without the spans of code points, as a column expression."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda k: F.substring(
            text,
            F.when(k == 0, 1).otherwise(F.get(spans, k - 1)["end"] + 1),
            F.when(k == F.size(spans), F.length(text)).otherwise(F.get(spans, k)["start"]) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"]),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that occur in it and how many words they hit."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = find_occurrences(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").alias("n_spans"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM bk),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT doc_id, k, dk.n, item_id FROM dk JOIN bw ON bw.n = dk.n AND bw.win = array_to_string(w[k:k + dk.n - 1], ' ')),
place AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hit),
runs AS (SELECT doc_id, count(*) AS n_hit, count(*) FILTER (first) AS n_spans FROM (SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS first FROM place) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN items USING (doc_id)
"""
