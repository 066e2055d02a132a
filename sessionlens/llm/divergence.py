"""Source divergence audit: how the words of each source differ from those of the other sources and of its language.

The terms that enough documents of a language hold are sorted over the cluster and cut into shards; each shard becomes a minimal
acyclic transducer, built from its sorted terms, whose path outputs add up to a term's lexicographic ordinal. Shards are numbered
in term order, so (shard, ordinal) orders all terms of a language. The texts are then streamed through the transducers for
recounting: the different words of a slice walk byte by byte, side by side, and count as often as they are there. Up to AUTOMATA_BYTES every task has all transducers (their
size is known before); beyond that the words of a slice are counted, sent to the shard that their first terms' order names, and
walk there. Counts are kept by ordinal, ties are broken by ordinal, and only the terms that are returned are spelt out again, by
descending the transducer.

Probabilities are whole parts in a thousand million, p = 1 + floor(10**9 * (count + 1) / (N + V)), and the divergence of a term is
f = floor((p - q)**2 / q); all of it is integer arithmetic. A pair of sources needs f of every kept term; for terms that a source lacks
p is a constant of the source, so tasks add up only differences to that at the terms a source has: work goes with the counts that
aren't zero times the sources, in tiles of TILE sources and BLOCK_TERMS terms.

Defined results: null text, lang and source are empty strings; every (lang, source) that occurs has its rows, without terms too. A
language without kept terms has pairs of value 0 and no terms; one with one source has no pairs. Repeated rows count as documents of
their own; extra columns are left out of the result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, slices, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a term isn't made of: ASCII other than letters.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_TERMS = 65_536
#: Bytes of transducers that every task may hold.
AUTOMATA_BYTES = 64_000_000
TILE, BLOCK_TERMS = 128, 4_096
#: (group, term) counts that a task holds before it gives them away.
HELD_COUNTS = 2_000_000
UNIT = 1_000_000_000
#: Bytes of texts whose words are looked at together.
SLICE_BYTES = 6_000_000


# the transducer


class Transducer:
    """A minimal acyclic transducer of sorted byte strings, as a packed table.

    Cell base[state] + byte belongs to the state named in owner there, leads to target and adds out to the ordinal; a state
    where a term ends is marked in final, and that term precedes those that go on.
    """

    def __init__(self, base: np.ndarray, final: np.ndarray, owner: np.ndarray, target: np.ndarray, out: np.ndarray):
        self.base, self.final, self.owner, self.target, self.out = base, final, owner, target, out

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """Of different terms in ascending order: the path of the last term stays open, what leaves it is frozen and shared."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, bytes, targets)
        path: list[list] = [[False, [], []]]

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                key = (final, bytes(labels), tuple(targets))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(states)
                    states.append(key)
                path[-1][2].append(state)

        last = b""
        for term in terms:
            shared = 0
            while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
                shared += 1
            freeze(shared)
            for b in term[shared:]:
                path[-1][1].append(b)
                path.append([False, [], []])
            path[-1][0] = True
            last = term
        freeze(0)
        states.append((path[0][0], bytes(path[0][1]), tuple(path[0][2])))  # the root comes last
        return cls.pack(states)

    @classmethod
    def pack(cls, states: list[tuple]) -> Transducer:
        """Rows of arcs laid into one table where they leave gaps for each other, the longest rows first."""
        counts, outs = np.zeros(len(states), dtype=np.int64), []
        for s, (final, _, targets) in enumerate(states):  # targets come before their sources
            ends = np.cumsum([int(final), *counts[list(targets)]])
            counts[s] = ends[-1]
            outs.append(ends[:-1])
        arcs = sum(len(x[1]) for x in states)
        free, base = np.ones(2 * arcs + 2048, dtype=bool), np.zeros(len(states), dtype=np.int32)
        length, start = 0, 0
        order = sorted(range(len(states)), key=lambda s: -len(states[s][1]))
        for s in order:
            labels = np.frombuffer(states[s][1], dtype=np.uint8).astype(np.int64)
            if len(labels) < 2:
                break
            if len(labels) != length:  # shorter rows look for the gaps that longer ones left, each length once through the table
                length, start = len(labels), 0
            while True:
                if start + 1024 >= len(free):
                    free = np.append(free, np.ones(len(free), dtype=bool))
                bases = start + np.flatnonzero(free[start : start + 512]) - labels[0]
                bases = bases[bases >= 0]
                for b in labels[1:]:
                    bases = bases[free[bases + b]]
                if len(bases):
                    break
                start += 512
            base[s] = bases[0]
            free[bases[0] + labels] = False
        single = [s for s in order if len(states[s][1]) == 1]  # fit anywhere
        gaps = 256 + np.flatnonzero(free[256:])[: len(single)]
        gaps = np.append(gaps, len(free) + np.arange(len(single) - len(gaps)))
        free = np.append(free, np.ones(len(single), dtype=bool))
        free[gaps] = False
        base[single] = gaps - np.array([states[s][1][0] for s in single], dtype=np.int64)
        size = int(np.flatnonzero(~free)[-1]) + 257 if arcs else 257
        size = max(size, int(base.max()) + 256)
        owner, target, out = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for s, (_, labels, targets) in enumerate(states):
            cells = base[s] + np.frombuffer(labels, dtype=np.uint8)
            owner[cells], target[cells], out[cells] = s, targets, outs[s]
        return cls(base, np.array([x[0] for x in states], dtype=bool), owner, target, out)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.base), len(self.owner)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.base, self.owner, self.target, self.out, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        states, cells = np.frombuffer(data, dtype=np.int64, count=2).tolist()
        at, parts = 16, []
        for n in (states, cells, cells, cells):
            parts.append(np.frombuffer(data, dtype=np.int32, count=n, offset=at))
            at += 4 * n
        return cls(parts[0], np.frombuffer(data, dtype=bool, count=states, offset=at), *parts[1:])

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ordinal of each word text[start:start + length], -1 for those that are no terms. All words step together."""
        found = np.full(len(starts), -1, dtype=np.int64)
        at, word = starts.copy(), np.arange(len(starts))
        state, total = np.full(len(starts), len(self.base) - 1, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        ends = starts + lengths
        while len(word):
            over = at == ends[word]
            if over.any():
                done = over & self.final[state]
                found[word[done]] = total[done]
                at, word, state, total = at[~over], word[~over], state[~over], total[~over]
            cell = self.base[state] + text[at]
            go = self.owner[cell] == state
            cell = cell[go]
            at, word, state, total = at[go] + 1, word[go], self.target[cell], total[go] + self.out[cell]
        return found

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal: at each state the last arc whose output isn't larger."""
        state, out = len(self.base) - 1, bytearray()
        while ordinal or not self.final[state]:
            cells = self.base[state] + np.arange(256)
            own = np.flatnonzero(self.owner[cells] == state)
            step = own[np.searchsorted(self.out[cells[own]], ordinal, side="right") - 1]
            cell = cells[step]
            out.append(int(step))
            state, ordinal = int(self.target[cell]), ordinal - int(self.out[cell])
        return bytes(out)


# words


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[97:123] = _IN_WORD[65:91] = _IN_WORD[128:] = True


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a text column, and start, length and row of each word in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data if data is not None else b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    cuts = np.zeros(len(raw) + 1, dtype=bool)  # a row's first byte begins a word of its own
    cuts[offsets - offsets[0]] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cuts[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cuts[1:])) + 1
    return _LOWERED[raw], starts, ends - starts, np.searchsorted(offsets - offsets[0], starts, side="right") - 1


def encoded_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a text column, and number (among them) and row of each word."""
    text, _, lengths, row = spans_of(column)
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text[_IN_WORD[text]])))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), row


def walked(made: Transducer, words: pa.Array) -> np.ndarray:
    """The ordinal of each word of a (large) string column, -1 for those that are no terms."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return made.ordinals(np.frombuffer(data if data is not None else b"", dtype=np.uint8), ends[:-1], np.diff(ends))


def counted_once(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return values[first], np.diff(np.append(first, len(values)))


# vocabulary


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term of the terms in at least so many documents of the language; a slice of texts counts its own before the shuffle."""

    def run(batches):
        for batch in chain.from_iterable(slices(b, ["text"], SLICE_BYTES) for b in batches):
            words, number, row = encoded_words(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            once, _ = counted_once(row * max(len(words), 1) + number)
            row, number = np.divmod(once, max(len(words), 1))
            keys, counts = counted_once(langs.indices.to_numpy().astype(np.int64)[row] * max(len(words), 1) + number)
            lang, number = np.divmod(keys, max(len(words), 1))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), words.take(pa.array(number)).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "term", "n"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def transducers(kept: DataFrame, n: int) -> DataFrame:
    """shard, lang, first (term), n, automaton: shards of one language in ascending order of terms, of n terms in all."""

    def row(number: int, lang: str, terms: list[bytes]) -> pa.RecordBatch:
        made = Transducer.build(terms)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.array([terms[0].decode()]), pa.array([len(terms)], pa.int64()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "lang", "first", "n", "automaton"])

    def run(batches):
        number, held, terms = TaskContext.get().partitionId() << 20, None, []
        for batch in batches:
            for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if terms and (lang != held or len(terms) == SHARD_TERMS):
                    yield row(number, held, terms)
                    number, terms = number + 1, []
                held = lang
                terms.append(term.encode())
        if terms:
            yield row(number, held, terms)

    parts = max(1, -(-n // (SHARD_TERMS // 2)))
    return kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, "shard long, lang string, first string, n long, automaton binary")


class Counter:
    """Counts of (group, term number) pairs of a task, given away when there are many."""

    def __init__(self, terms: int):
        self.terms, self.groups, self.keys, self.counts, self.n = terms, {}, [], [], 0

    def codes(self, langs: list, sources: list) -> np.ndarray:
        return np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources, strict=True)], dtype=np.int64)

    def add(self, groups: np.ndarray, numbers: np.ndarray) -> None:
        keys, counts = counted_once(groups * self.terms + numbers)
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > 2 * HELD_COUNTS:
            self.merge()

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), dtype=np.int64)
        np.add.at(counts, at, np.concatenate(self.counts))
        self.keys, self.counts, self.n = [keys], [counts], len(keys)

    def full(self) -> bool:
        return self.n > HELD_COUNTS and len(self.keys) == 1

    def give(self):
        """(lang, source, number, count) as arrays; empties the counter."""
        if self.keys:
            self.merge()
            names, keys = list(self.groups), self.keys[0]
            code = keys // self.terms
            for k in np.unique(code).tolist():
                own = code == k
                yield *names[k], keys[own] - k * self.terms, self.counts[0][own]
        self.groups, self.keys, self.counts, self.n = {}, [], [], 0


COUNTED = "lang string, source string, ordinal long, n long"


def counted_rows(lang: str, source: str, ordinals: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([source] * len(counts)), pa.array(ordinals, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "source", "ordinal", "n"])


def recount_everywhere(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Counts by (lang, source, ordinal) and task; each task walks the texts through all transducers."""
    rows = shards.orderBy("shard").collect()  # AUTOMATA_BYTES at most
    shared = docs.sparkSession.sparkContext.broadcast([(r.lang, r.shard, r.n, bytes(r.automaton)) for r in rows])

    def run(batches):
        of: dict[str, list] = {}
        firsts, total = [], 0
        for lang, shard, n, data in shared.value:
            of.setdefault(lang, []).append((total, Transducer.from_bytes(data)))
            firsts.append((total, shard))
            total += n
        begins, numbers = (np.array([x[k] for x in firsts], dtype=np.int64) for k in (0, 1))
        counter = Counter(max(total, 1))

        def given():
            for lang, source, terms, counts in counter.give():
                shard = np.searchsorted(begins, terms, side="right") - 1
                yield counted_rows(lang, source, numbers[shard] * SHARD_TERMS + terms - begins[shard], counts)

        for batch in chain.from_iterable(slices(b, ["text"], SLICE_BYTES) for b in batches):
            langs = batch.column("lang").to_pylist()
            groups = counter.codes(langs, batch.column("source").to_pylist())
            words, number, row = encoded_words(batch.column("text"))
            names = pd.Series(langs, dtype=object).to_numpy()
            for lang in set(langs) & set(of):
                found = np.full(len(words), -1, dtype=np.int64)
                for begin, made in of[lang]:  # a slice's different words walk, each once
                    own = walked(made, words)
                    found = np.where(own >= 0, begin + own, found)
                terms, hit = found[number], (names == lang)[row]
                hit &= terms >= 0
                counter.add(groups[row[hit]], terms[hit])
            if counter.full():
                yield from given()
        yield from given()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def at_shards(shards: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """work(transducer, shard number, batch) for rows with a shard: the task of a shard reads its transducer, then the rows."""
    names = [c for c in rows.columns if c != "shard"]
    both = shards.select("shard", "automaton").unionByName(rows, allowMissingColumns=True)

    def run(batches):
        made = None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                own = batch.slice(start, end - start)
                if own.column("automaton")[0].is_valid:  # sorted first
                    made, own = Transducer.from_bytes(own.column("automaton")[0].as_py()), own.slice(1)
                if own.num_rows:
                    yield work(made, int(numbers[start]), own)

    return both.repartition("shard").sortWithinPartitions("shard", F.col("automaton").isNull()).select("shard", "automaton", *names).mapInArrow(run, schema)


def recount_by_shard(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """The same where the transducers are too many for a task: words of a slice are counted, sent to their shard and walk there."""
    spark = docs.sparkSession
    firsts = shards.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("shard", "first"))).alias("shards"))  # a row for SHARD_TERMS terms
    shared = spark.sparkContext.broadcast({r.lang: ([x["shard"] for x in r.shards], np.array([x["first"].encode() for x in r.shards], dtype=object)) for r in firsts.collect()})

    def run(batches):
        for batch in chain.from_iterable(slices(b, ["text"], SLICE_BYTES) for b in batches):
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            groups = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
            words, number, row = encoded_words(batch.column("text"))
            keys, counts = counted_once(np.array([groups[p] for p in pairs], dtype=np.int64)[row] * max(len(words), 1) + number)
            group, number = np.divmod(keys, max(len(words), 1))
            texts = words.cast(pa.large_binary())
            for k, (lang, source) in enumerate(groups):
                if lang in shared.value:
                    shards_, firsts_ = shared.value[lang]
                    own = np.flatnonzero(group == k)
                    some = texts.take(pa.array(number[own]))
                    place = np.searchsorted(firsts_, np.array(some.to_pylist(), dtype=object), side="right") - 1
                    in_ = np.flatnonzero(place >= 0)
                    columns = [pa.array(np.array(shards_)[place[in_]], pa.int64()), pa.array([lang] * len(in_), pa.string()), pa.array([source] * len(in_), pa.string()), some.take(pa.array(in_)).cast(pa.binary()), pa.array(counts[own][in_], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "source", "word", "n"])

    words = docs.select("lang", "source", "text").mapInArrow(run, "shard long, lang string, source string, word binary, n long")
    words = words.groupBy("shard", "lang", "source", "word").agg(F.sum("n").alias("n"))

    def walk(made: Transducer, shard: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("word").to_pylist()
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        found = made.ordinals(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
        hit = pa.array(np.flatnonzero(found >= 0))
        return pa.RecordBatch.from_arrays([batch.column("lang").take(hit), batch.column("source").take(hit), pa.array(shard * SHARD_TERMS + found[hit.to_numpy()], pa.int64()), batch.column("n").take(hit)], names=["lang", "source", "ordinal", "n"])

    return at_shards(shards, words, walk, COUNTED)


def spelt(shards: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of rows with an ordinal."""

    def work(made: Transducer, shard: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [made.term(x - shard * SHARD_TERMS).decode() for x in batch.column("ordinal").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(terms, pa.string()), batch.column("value"), batch.column("rank")], names=["lang", "source", "item", "value", "rank"])

    placed = rows.withColumn("shard", F.expr(f"ordinal div {SHARD_TERMS}"))
    return at_shards(shards, placed.select("shard", "lang", "source", "ordinal", "value", "rank"), work, "lang string, source string, item string, value long, rank int")


# divergence


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} + {terms} as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, extra: for two sources (by code) the sum over the terms that either has of what f differs from f(base a, base b).

    counted: lang, code, ordinal, p, tiles; groups: lang, code, base. Terms that b has add f(base a, p b), those that a has add
    f(p a, p b) - f(base a, p b), with b's base where b lacks the term.
    """
    tile = F.floor(F.col("code") / TILE).cast("int")
    lists = groups.groupBy("lang", tile.alias("tile")).agg(F.array_sort(F.collect_list(F.struct("code", "base"))).alias("list"))
    pairs = lists.select("lang", F.col("tile").alias("ta"), F.col("list").alias("la")).join(lists.select("lang", F.col("tile").alias("tb"), F.col("list").alias("lb")), "lang")
    entries = counted.withColumns({"tile": tile, "block": F.expr(f"ordinal div {BLOCK_TERMS}")})
    blocks = entries.select(F.col("lang").alias("of"), F.col("block").alias("b")).distinct()  # columns of their own, for the cogroup
    frames = blocks.join(pairs, F.col("of") == F.col("lang")).select(F.col("of").alias("lang"), "ta", "tb", F.col("b").alias("block"), "la", "lb")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    both = F.array_distinct(F.concat(F.transform(others, lambda y: F.struct(F.col("tile").alias("ta"), y.alias("tb"))), F.transform(others, lambda y: F.struct(y.alias("ta"), F.col("tile").alias("tb")))))
    dealt = entries.withColumn("to", F.explode(both)).select("lang", "to.ta", "to.tb", "block", "code", "ordinal", "p")

    def run(rows: pa.Table, frame: pa.Table) -> pa.Table:
        columns = ["lang", "a", "b", "extra"]
        if not frame.num_rows:
            return pa.table({c: pa.array([], pa.string() if c == "lang" else pa.int64()) for c in columns})
        (code_a, base_a), (code_b, base_b) = ([np.array([x[k] for x in frame.column(c)[0].as_py()], dtype=np.int64) for k in ("code", "base")] for c in ("la", "lb"))
        code, p = rows.column("code").to_numpy().astype(np.int64), rows.column("p").to_numpy().astype(np.int64)
        terms, term = np.unique(rows.column("ordinal").to_numpy(), return_inverse=True)
        grid = np.tile(base_b, (len(terms), 1))
        of_b, of_a = np.flatnonzero(np.isin(code, code_b)), np.flatnonzero(np.isin(code, code_a))
        at_b, at_a = np.searchsorted(code_b, code[of_b]), np.searchsorted(code_a, code[of_a])
        grid[term[of_b], at_b] = p[of_b]
        extra = np.zeros((len(code_a), len(code_b)), dtype=np.int64)
        for k in range(0, len(of_b), 8192):
            some = slice(k, k + 8192)
            np.add.at(extra.T, at_b[some], differences(base_a[None, :], p[of_b[some], None]))
        for k in range(0, len(of_a), 8192):
            some = slice(k, k + 8192)
            q = grid[term[of_a[some]]]
            np.add.at(extra, at_a[some], differences(p[of_a[some], None], q) - differences(base_a[at_a[some], None], q))
        a, b = (x.ravel() for x in np.meshgrid(code_a, code_b, indexing="ij"))
        return pa.table({"lang": pa.array([frame.column("lang")[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "extra": extra.ravel()})

    keys = ["lang", "ta", "tb", "block"]
    parts = dealt.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInArrow(run, "lang string, a long, b long, extra long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def divergence_audit(docs: DataFrame, least_docs: int = 3, top: int = 200, automata_bytes: int = AUTOMATA_BYTES, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. Terms are ranked up to top for each source, pairs all."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = stored(kept_terms(docs, least_docs), "kept-terms")
    shards = stored(transducers(kept, kept.count()), "transducers")
    size = shards.agg(F.sum(F.length("automaton"))).first()[0] or 0
    recount = recount_everywhere if size <= automata_bytes else recount_by_shard
    counted = stored(recount(docs, shards).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")

    terms = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "held", "terms"])
    code = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumns({"code": F.row_number().over(code) - 1, "tiles": F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int")})
    base = F.when(F.col("terms") > 0, share("0", "total", "greatest(terms, 1)"))
    groups = stored(groups.withColumns({"base": base, "lang_total": F.sum("total").over(Window.partitionBy("lang"))}), "groups")

    shares = counted.join(groups.drop("held", "base"), ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    everywhere = F.sum("n").over(Window.partitionBy("lang", "ordinal"))
    shares = stored(shares.withColumn("lang_n", everywhere).select("lang", "source", "code", "tiles", "ordinal", "p", share("lang_n", "lang_total", "terms").alias("q")), "shares")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    above = shares.where("p > q").withColumn("value", apart("p", "q"))
    ranked = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    term_rows = spelt(shards, ranked).withColumn("part", F.lit("term"))

    extra = pair_sums(shares.select("lang", "code", "ordinal", "p", "tiles"), groups.where("terms > 0").select("lang", "code", "base"))
    one = groups.select("lang", "source", F.col("code").alias("a"), F.col("base").alias("base_a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("code").alias("b"), F.col("base").alias("base_b"), "terms", "held")
    pairs = one.join(two, "lang").where("a <> b").join(extra, ["lang", "a", "b"], "left")
    value = F.when(F.col("terms") > 0, F.coalesce("extra", F.lit(0)) + apart("base_a", "base_b") * (F.col("terms") - F.col("held"))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = pairs.withColumn("value", value).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = stored(pair_rows.unionByName(term_rows.select(*pair_rows.columns)), "divergence")
    for old in (kept, shards, counted, groups, shares):
        dropped(spark, old)
    return out


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents; terms of three documents and more, 200 terms a source."""
    return divergence_audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN kept USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (
    SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n,
        CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v.v) AS BIGINT) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
q AS (SELECT lang, t, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS BIGINT) AS q FROM (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT p.lang, p.source, p.t AS item, ((p - q) * (p - q)) // q AS value, row_number() OVER (PARTITION BY p.lang, p.source ORDER BY ((p - q) * (p - q)) // q DESC, p.t) AS rank
    FROM p JOIN q USING (lang, t) WHERE p.n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INTEGER) FROM terms WHERE rank <= 200
"""
