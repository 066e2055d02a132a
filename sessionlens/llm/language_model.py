"""Language-model scoring by a weighted backoff automaton of word trigrams.

States are contexts: pairs of words, words and the empty context. A context that occurs twice or more in training is a state. It
has an arc for every word that followed it and one failure arc to the state of the shorter context. An arc's weight is the
interpolated probability of its word, a failure arc's weight the mass that is left for words without an arc; both come from the
context's share of mass for what it has seen (Jelinek-Mercer smoothing, the shares by classes of contexts of like counts from
Good-Turing: of a class, the share of occurrences whose n-gram is there once is the mass of the unseen). In the empty context
words have their relative frequency, less the mass of the unseen, which goes to all spellings by an automaton over bytes that is
trained on the words that occur once. So the words after any state have probabilities that sum to one. A text is read once from
left to right: the state is carried from token to token and the logarithms of the weights of the arcs taken are added.

Counting covers all training texts and keeps every n-gram whose context is a state, at any size of the corpus. Nothing that
grows with the corpus is broadcast or collected. Documents are read into blocks of a bounded number of tokens. A block's distinct
n-grams, as 64-bit hashes with their counts, are dealt into ranges of hashes (as many as the tokens need); all blocks' parts of a range are
summed in one task, and the sums go back to their blocks. Orders follow each other, since contexts of one occurrence need no longer n-grams. Blocks are a bucketed table, so only hashes and counts are shuffled.

Defined results: null counts as empty, a text without words has the end token alone; rows with a null doc_id are training rows;
repeated rows are scored (and in training counted) each; without training texts c, N and V are 0 and spelling is uniform; extra
columns are left out of the result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, shared_dir, slices, stored, table, text_or_empty
from .shingles import mix, span_hashes, word_spans

BLOCK_TOKENS = 1_200_000
#: About so many n-grams of all blocks meet in one range.
RANGE_ENTRIES = 2_000_000
DISCOUNT = 0.75
ORDERS = 3
WHITE = np.array([c not in (0x20, *range(0x09, 0x0E)) for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
END = span_hashes(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))[0]
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# ---- spelling ------------------------------------------------------------------------------------------------------

START_BYTE, END_BYTE = 0x20, 0x0A  # no word has them


def letters(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes as codes, 3 bytes each: two before and the predicted one, the word's end included; and where each word's begin."""
    at = np.concatenate([[0], np.cumsum(lengths + 3)])
    text = np.full(at[-1], START_BYTE, dtype=np.int64)
    text[np.arange(len(data)) + 2 + 3 * np.repeat(np.arange(len(lengths)), lengths)] = data
    text[at[1:] - 1] = END_BYTE
    predicted = np.ones(len(text), dtype=bool)
    predicted[at[:-1]] = predicted[at[:-1] + 1] = False
    code = text[:-2] << 16 | text[1:-1] << 8 | text[2:] if len(text) else text
    return code[predicted[2:]], np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]


@dataclass
class Spelling:
    """log10 of the probability of a byte after two others, failure arcs resolved; bytes that training didn't have share a symbol."""

    symbols: np.ndarray
    logs: np.ndarray

    def of(self, code: np.ndarray) -> np.ndarray:
        return self.logs[self.symbols[code >> 16], self.symbols[code >> 8 & 255], self.symbols[code & 255]]

    def score(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        code, starts = letters(data, lengths)
        return np.add.reduceat(self.of(code), starts) if len(starts) else np.empty(0)


def build_spelling(codes: np.ndarray, counts: np.ndarray) -> Spelling:
    """Absolute discounting over contexts of two, one and no byte. At most 256 ** 3 codes, whatever the corpus."""
    seen = np.unique(np.concatenate([codes >> 16, codes >> 8 & 255, codes & 255]).astype(np.int64))
    size = len(seen) + 1  # the last symbol stands for each other byte
    symbols = np.full(256, len(seen), dtype=np.int64)
    symbols[seen] = np.arange(len(seen))
    n = np.zeros((size, size, size))
    np.add.at(n, (symbols[codes >> 16], symbols[codes >> 8 & 255], symbols[codes & 255]), counts)
    lower = np.full(size, 1 / 256)
    for own in (n.sum((0, 1)), n.sum(0), n):
        whole = own.sum(-1, keepdims=True)
        left = np.where(whole > 0, DISCOUNT * (own > 0).sum(-1, keepdims=True) / np.maximum(whole, 1), 1.0)
        lower = np.maximum(own - DISCOUNT, 0) / np.maximum(whole, 1) + left * lower
    return Spelling(symbols, np.log10(lower))


# ---- packed arrays -------------------------------------------------------------------------------------------------


def packed(array: np.ndarray) -> bytes:
    """Bytes of like place together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def packed_sorted(array: np.ndarray) -> bytes:
    return packed(np.diff(array, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


# ---- blocks --------------------------------------------------------------------------------------------------------

BLOCKS = "block long, n_tokens long, n_trained long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, trained binary, letters binary, lengths binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held, body. Blocks of documents: tokens as places in the block's distinct words, which are sorted by hash; how often each is there in training, and its letters."""

    def spelt(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - begins
        at = np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)
        return LOWER[data[at]], lengths

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, hashes, known = [], [], [], [], []

        def finish():
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            out = np.repeat(np.array(held, dtype=bool), np.array(sizes))
            trained = np.bincount(tokens[~out], minlength=len(words))
            # letters: of the slices' distinct words the first of each
            all_, blobs, lengths = (np.concatenate(x) for x in zip(*known, strict=True))
            at = np.concatenate([[0], np.cumsum(lengths)])
            _, first = np.unique(np.append(all_, END), return_index=True)
            at, lengths = np.append(at, at[-1]), np.append(lengths, 0)
            blob, lengths = spelt(blobs, at[first], at[first] + lengths[first])
            row = [task << 20 | made, len(tokens), len(tokens) - int(out.sum()), ids, held, packed(np.array(sizes)), packed(tokens.astype(np.int32)), packed_sorted(words), packed(trained), zstandard.ZstdCompressor(level=1).compress(blob.tobytes()), packed(lengths.astype(np.int32))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in chain.from_iterable(slices(b, ["body"]) for b in batches):
            data, begins, ends, starts = word_spans(batch.column("body"), WHITE)
            own = span_hashes(data, begins, ends)
            distinct, first = np.unique(own, return_index=True)
            known.append((distinct, *spelt(data, begins[first], ends[first])))
            hashes.append(np.insert(own, starts[1:], END))
            sizes += (np.diff(starts) + 1).tolist()
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            if sum(map(len, hashes)) >= BLOCK_TOKENS:
                yield finish()
                made += 1
                ids, held, sizes, hashes, known = [], [], [], [], []
        if ids:
            yield finish()

    return docs.mapInArrow(run, BLOCKS)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df as a table in the shared folder whose files are bucketed, so that joins by that column don't shuffle it."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
    return spark.table(name)


# ---- n-grams of a block ----------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """n-grams of one order in a block whose contexts are states: the tokens that end them, their sorted distinct hashes, which of them each token ends, and how often the context before each token occurs."""

    at: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    context: np.ndarray


class Block:
    """A block's row with the corpus counts of its n-grams, as far as they are known; orders are built one upon another."""

    def __init__(self, row: dict, counts: pa.Table | None):
        self.sizes = unpacked(row["sizes"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.tokens = unpacked(row["tokens"], np.int32)
        self.trained = ~np.repeat(np.array(row["held"], dtype=bool), self.sizes)
        self.words = unpacked_sorted(row["words"])
        self.counts: dict[int, np.ndarray] = {}
        if counts is not None:
            order, range_ = counts.column("order").to_numpy(), counts.column("range").to_numpy()
            data = counts.column("counts")
            for k in np.unique(order).tolist():
                own = np.flatnonzero(order == k)
                self.counts[k] = np.concatenate([unpacked(data[int(i)].as_py(), np.int64) for i in own[np.argsort(range_[own])]])

    def grams(self, most: int) -> list[Grams]:
        """Of orders 2 to most; the counts of those below most must be known."""
        hashes = self.words[self.tokens]
        before, times = hashes, self.counts[1][self.tokens]  # the context that ends with each token, and how often it occurs
        place, out = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes), []
        for order in range(2, most + 1):
            good = place >= order - 1
            good[1:] &= times[:-1] >= 2
            at = np.flatnonzero(good)
            whole = mix(before[at - 1] * _LEFT + hashes[at] * _RIGHT)
            distinct, which = np.unique(whole, return_inverse=True)
            out.append(Grams(at, distinct, which, times[at - 1]))
            if order < most:
                before, times = np.zeros_like(hashes), np.zeros_like(times)
                before[at] = whole
                if len(distinct):
                    times[at] = self.counts[order][which]
        return out


REQUESTS = "range int, block long, hashes binary, times binary, classes binary"


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Contexts of like counts: by the whole part of the binary logarithm."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


def requested(block: int, hashes: np.ndarray, times: np.ndarray, classes: np.ndarray, ranges: int) -> pa.Table:
    """A row for each range of hashes."""
    place = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    own = np.unique(place)
    cuts = [*np.searchsorted(place, own).tolist(), len(hashes)]
    parts = [(packed_sorted(hashes[a:b]), packed(times[a:b].astype(np.int32)), packed(classes[a:b].astype(np.int8))) for a, b in zip(cuts, cuts[1:])]
    columns = [pa.array(own.astype(np.int32)), pa.array([block] * len(own), pa.int64()), *[pa.array([p[k] for p in parts], pa.binary()) for k in range(3)]]
    return pa.table(columns, names=["range", "block", "hashes", "times", "classes"])


COUNTS = "block long, range int, counts binary, class int, once long, times long, kinds long"


def summed(requests: DataFrame) -> DataFrame:
    """Corpus counts of the requested n-grams: a row for each request with them in its order; and with block -1 for each class of a range the n-grams, their occurrences, and those that occur once."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpacked_sorted(x.as_py()) for x in rows.column("hashes")]
        times = np.concatenate([unpacked(x.as_py(), np.int32) for x in rows.column("times")])
        classes = np.concatenate([unpacked(x.as_py(), np.int8) for x in rows.column("classes")])
        ends = np.cumsum([len(p) for p in parts])
        distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(which, times, len(distinct)).astype(np.int64)
        own = np.zeros(len(distinct), dtype=np.int64)
        own[which] = classes
        back = counts[which]
        data = [packed(back[end - len(p) : end]) for p, end in zip(parts, ends, strict=True)]
        n = np.bincount(own, counts)
        some = np.flatnonzero(np.bincount(own))
        once, kinds = np.bincount(own[counts == 1], minlength=len(n)), np.bincount(own[counts > 0], minlength=len(n))
        range_, none = rows.column("range")[0].as_py(), [None] * len(data)
        columns = [rows.column("block").to_pylist() + [-1] * len(some), [range_] * (len(data) + len(some)), data + [None] * len(some), none + some.tolist(), none + once[some].tolist(), none + n[some].astype(np.int64).tolist(), none + kinds[some].tolist()]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])

    return requests.groupBy("range").applyInArrow(run, COUNTS)


def shares(counts: DataFrame) -> np.ndarray:
    """By class of contexts, the mass of what they have seen; a row for each class comes to the driver, 64 at most."""
    out = np.full(64, 0.5)
    for r in counts.where("block = -1").groupBy("class").agg(F.sum("once").alias("once"), F.sum("times").alias("times")).collect():
        out[r["class"]] = 1 - (r.once + 1) / (r.times + 2)
    return out


def with_counts(blocks: DataFrame, columns: list[str], counts: list[DataFrame], run, schema: str) -> DataFrame:
    """run(row of a block, its counts) for each block, with counts of orders 1 and up."""
    known = [c.where("block >= 0").select("block", F.lit(k).alias("order"), "range", "counts") for k, c in enumerate(counts, 1)]
    whole = known[0]
    for more in known[1:]:
        whole = whole.unionByName(more)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist()[0], right)

    return blocks.select("block", *columns).groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(both, schema)


# ---- the automaton ---------------------------------------------------------------------------------------------------


def carried(block: Block, empty: np.ndarray, seen: dict[int, np.ndarray]) -> np.ndarray:
    """The logarithm that each token adds. empty: probabilities of the block's words in the empty context; seen[order]: the mass of an order's states by class.

    The state before a token is its longest context that is a state. Where that has an arc for the token, the arc's weight counts;
    else the failure arc's weight and what the shorter context says.
    """
    p = empty[block.tokens]
    for order, g in enumerate(block.grams(ORDERS), 2):
        if len(g.at):
            mass = seen[order][classes_of(g.context)]
            arc = mass * block.counts[order][g.which] / g.context
            p[g.at] = arc + (1 - mass) * p[g.at]
    return np.log10(np.maximum(p, 1e-300))


TEXT = ["n_tokens", "held", "sizes", "tokens", "words", "trained"]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held: str = "held") -> DataFrame:
    """docs: doc_id, held (not trained on), body. doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = bucketed(blocks_of(docs.select(F.col("doc_id").cast("long"), F.col(held).alias("held"), "body")), "block")
    whole = blocks.agg(F.coalesce(F.sum("n_trained"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    n, ranges = whole.n, max(1, math.ceil(whole.tokens / RANGE_ENTRIES))

    def of_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = unpacked_sorted(row["words"])
                yield from requested(row["block"], words, unpacked(row["trained"], np.int64), np.zeros(len(words)), ranges).to_batches()

    counts = [stored(summed(blocks.select("block", "words", "trained").mapInArrow(of_words, REQUESTS)), "counts-1")]
    first = counts[0].where("block = -1").agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"), F.coalesce(F.sum("once"), F.lit(0)).alias("once")).first()
    v, new = first.v, (first.once + 1) / (n + 2) if n else 1.0  # the mass of unseen words
    spelling = spark.sparkContext.broadcast(spelling_of(blocks, counts))
    for order in range(2, ORDERS + 1):

        def of_order(row: dict, known: pa.Table, order=order) -> pa.Table:
            block = Block(row, known)
            g = block.grams(order)[-1]
            classes = np.zeros(len(g.hashes), dtype=np.int8)
            classes[g.which] = classes_of(g.context)
            return requested(row["block"], g.hashes, np.bincount(g.which, block.trained[g.at], len(g.hashes)), classes, ranges)

        counts.append(stored(summed(with_counts(blocks, TEXT, counts, of_order, REQUESTS)), f"counts-{order}"))
    seen = {k: shares(c) for k, c in enumerate(counts, 1) if k > 1}

    def score(row: dict, known: pa.Table) -> pa.Table:
        block = Block(row, known)
        c, tokens = block.counts[1], block.tokens
        blob = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["letters"]), dtype=np.uint8)
        spelt = spelling.value.score(blob, unpacked(row["lengths"], np.int32).astype(np.int64))
        empty = (1 - new) * c / max(n, 1) + new * 10.0**spelt
        base = np.log10((c + 1) / (n + v + 1))
        total = lambda x: np.add.reduceat(x, block.starts)
        columns = [row["doc_ids"], row["held"], block.sizes, total((c > 0).astype(np.int64)[tokens]), np.full(len(block.sizes), n), total(base[tokens]), total(carried(block, empty, seen))]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return with_counts(blocks, ["doc_ids", *TEXT, "letters", "lengths"], counts, score, SCORES)


def spelling_of(blocks: DataFrame, counts: list[DataFrame]) -> Spelling:
    """From the words that occur once in training: how new words are spelt. At most 256 ** 3 sums come to the driver."""

    def run(row: dict, known: pa.Table) -> pa.Table:
        own = (np.concatenate([unpacked(x.as_py(), np.int64) for x in known.sort_by("range").column("counts")]) == 1) & (unpacked(row["trained"], np.int64) == 1)
        lengths = unpacked(row["lengths"], np.int32).astype(np.int64)
        blob = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["letters"]), dtype=np.uint8)
        code, times = np.unique(letters(blob[np.repeat(own, lengths)], lengths[own])[0], return_counts=True)
        return pa.table([pa.array(code), pa.array(times)], names=["code", "n"])

    summed_ = with_counts(blocks, ["trained", "letters", "lengths"], counts, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return build_spelling(summed_.column("code").to_numpy(), summed_.column("n").to_numpy())


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text scored by the model and by the base; held-out rows are not learnt from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held"), text_or_empty().alias("body"))
    return score_documents(docs)
