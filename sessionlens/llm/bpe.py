"""Byte-level BPE by merge replay over a vocabulary instead of text by text.

A block of documents is cut into words by the tokenizer's pattern; each distinct word enters the block's corpus once. All of them
lie in one array of symbols with links to left and right neighbours. An inverted index leads from a token (what a pair of
neighbours merges to) to the positions of such pairs. Tokens are taken by rank, and one step applies a merge at all its
positions; only the two touched neighbours of each get new entries in the index. Then documents are put together from the ids
of their words. Blocks bound the memory; ids of words don't depend on the block, so a bounded cache carries them to later blocks.

Ids, decoded bytes and counts equal those of the tiktoken library's encode_ordinary.

Defined results: null text is encoded as empty (no ids); unpaired surrogates can't occur in Spark's strings; repeated rows are
encoded each by itself; extra columns stay unless a result column has their name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, giving_back, table, text_or_empty

BLOCK_CHARS = 4_000_000
CACHE_WORDS = 120_000
#: New words whose merges are replayed at once.
REPLAY_WORDS = 40_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a tokenizer's file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: dict[int, bytes] | None = None) -> list[tuple[int, ...]]:
    """The ids of each word after all merges, in rank order, over all words at once. tokens: ranks the other way round."""
    get = ranks.get
    out: list[tuple[int, ...] | None] = [None if (r := get(w)) is None else (r,) for w in words]  # a word may be a token
    left_over = [i for i, x in enumerate(out) if x is None]
    if not left_over:
        return out  # type: ignore[return-value]
    tokens = tokens or {r: t for t, r in ranks.items()}
    corpus = np.frombuffer(b"".join([words[i] for i in left_over]), dtype=np.uint8)
    ends = np.cumsum([len(words[i]) for i in left_over])
    total = len(corpus)
    token: list[bytes] = list(map(_BYTES.__getitem__, corpus.tolist()))  # by position; an emptied position holds b""
    links = np.arange(-1, total + 1)
    left, right = links[:-2].copy(), links[2:].copy()
    left[np.concatenate([[0], ends[:-1]])] = -1
    right[ends - 1] = -1
    # the index: token -> positions of pairs that merge to it, in ascending order
    pair_rank = np.full(1 << 16, -1, dtype=np.int64)
    for t, r in ranks.items():
        if len(t) == 2:
            pair_rank[t[0] << 8 | t[1]] = r
    first = np.flatnonzero(right >= 0)
    rank_of = pair_rank[corpus[first].astype(np.int64) << 8 | corpus[first + 1]]
    first, rank_of = first[rank_of >= 0], rank_of[rank_of >= 0]
    order = np.argsort(rank_of, kind="stable")
    first, rank_of = first[order], rank_of[order]
    cuts = np.flatnonzero(np.diff(rank_of)) + 1
    index: dict[int, list[int]] = {int(rank_of[a]): first[a:b].tolist() for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(first)]]), strict=True)} if len(first) else {}
    left, right = array("i", left.astype(np.int32).tobytes()), array("i", right.astype(np.int32).tobytes())
    queue = list(index)
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        rank = pop(queue)
        whole = tokens[rank]
        positions = index.pop(rank)
        positions.sort()
        for at in positions:
            nxt = right[at]
            if nxt < 0 or token[at] + token[nxt] != whole or not token[at]:
                continue
            token[at] = whole
            token[nxt] = b""
            after = right[at] = right[nxt]
            right[nxt] = -1
            if after >= 0:
                left[after] = at
                r = get(whole + token[after])
                if r is not None:
                    if r in index:
                        index[r].append(at)
                    else:
                        index[r] = [at]
                        push(queue, r)
            before = left[at]
            if before >= 0:
                r = get(token[before] + whole)
                if r is not None:
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        push(queue, r)
    base = 0
    for i, end in zip(left_over, ends.tolist(), strict=True):
        out[i] = tuple([ranks[t] for t in token[base:end] if t])
        base = end
    return out  # type: ignore[return-value]


_BYTES = [bytes([b]) for b in range(256)]


class Numbers(dict):
    """Numbers words in the order they are first asked for, so that a text needs a small number for each of its words, not a string."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes blocks of texts; holds the ranks and a bounded cache of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocabulary = {r: t for t, r in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        words = Numbers()
        number = words.__getitem__
        cut = [array("i", map(number, self.find(t))) for t in texts]
        young = self.cache
        if len(young) > CACHE_WORDS:  # what the last blocks didn't use is forgotten
            self.old, self.cache = young, {}
            young = self.cache
        old, fresh = self.old, []
        for w in words:
            if w not in young:
                found = old.get(w)
                if found is None:
                    fresh.append(w)
                else:
                    young[w] = found
        for k in range(0, len(fresh), REPLAY_WORDS):
            part = fresh[k : k + REPLAY_WORDS]
            young.update(zip(part, replay([w.encode() for w in part], self.ranks, self.vocabulary), strict=True))
        get = list(map(young.__getitem__, words)).__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, and with ids: token_ids; with digests: ids_sha256 and, after decoding, decoded_sha256. ranks_path is read on the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    new += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests
    made = {f.name for f in new}
    names = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text).alias("__body"))
    schema = T.StructType([source.schema[c] for c in names] + new)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))  # one tokenizer's vocabulary

    def run(batches):
        gc.disable()  # the many small tuples hold no cycles
        encoder = Encoder(shared.value, pattern)
        decimal = {r: str(r) for r in encoder.vocabulary}.__getitem__
        held, size = [], 0

        def finish():
            bodies = [b.column("__body").to_pylist() for b in held]
            coded = iter(encoder.encode_block([t for ts in bodies for t in ts]))
            for batch, texts in zip(held, bodies, strict=True):
                own = [next(coded) for _ in texts]
                columns = [batch.column(c) for c in names] + [pa.array([len(x) for x in own], pa.int64())]
                if ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                if digests:
                    columns.append(pa.array([hashlib.sha256(" ".join(map(decimal, x)).encode()).hexdigest() for x in own]))
                    columns.append(pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in own]))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in new]])

        for batch in batches:
            held.append(batch)
            size += batch.column("__body").nbytes
            if size >= BLOCK_CHARS:
                yield from finish()
                held, size = [], 0
        if held:
            yield from finish()
        gc.enable()

    return source.mapInArrow(giving_back(run), schema)


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "token_ids", into: str = "text") -> DataFrame:
    """Replaces ids (an array column; null: empty) by the text they stand for; bytes that aren't UTF-8 become U+FFFD."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast({r: t for t, r in load_ranks(ranks_path).items()})
    names = [c for c in docs.columns if c not in (ids, into)]
    source = docs.select(*names, F.col(ids).cast("array<int>").alias("__ids"))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(into, T.StringType())])

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            texts = [b"".join([vocabulary[i] for i in x or () if i is not None]).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, into])

    return source.mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text encoded and decoded again; null counts as empty."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True, keep=["doc_id"])
