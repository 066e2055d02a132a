import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import language_model
from sessionlens.llm.language_model import build_spelling, letters, op7_language_model, packed, packed_sorted, score_documents, unpacked, unpacked_sorted


def spelling_by_hand(words, discount=0.75):
    """P(byte | two before) as a function, failure arcs walked."""
    grams = [collections.Counter() for _ in range(3)]
    for w in words:
        text = b"  " + w + b"\n"
        for i in range(2, len(text)):
            for k in range(3):
                grams[k][text[i - k : i + 1]] += 1

    def p(context, byte):
        lower = 1 / 256 if not context else p(context[1:], byte)
        if len(context) == 0:
            own = {g[0]: n for g, n in grams[0].items()}
        else:
            own = {g[-1]: n for g, n in grams[len(context)].items() if g[:-1] == context}
        whole = sum(own.values())
        if not whole:
            return lower
        return max(own.get(byte, 0) - discount, 0) / whole + discount * len(own) / whole * lower

    return p


def flat(words):
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int64)


def test_spelling_equals_a_walk_and_sums_to_one():
    words = [b"abc", b"abd", b"bca", b"a", b"", b"zzzzzzz", "é".encode()]
    codes, counts = np.unique(letters(*flat(words))[0], return_counts=True)
    model, p = build_spelling(codes, counts), spelling_by_hand(words)
    asked = [b"abc", b"", b"qqq", b"zzb", "éa".encode()]
    for w, got in zip(asked, model.score(*flat(asked))):
        text = b"  " + w + b"\n"
        assert got == pytest.approx(sum(math.log10(p(text[i - 2 : i], text[i])) for i in range(2, len(text))))
    every = np.arange(256)
    for a, b in [(0x20, 0x20), (0x61, 0x62), (0x01, 0x02), (0x7A, 0x7A)]:
        assert (10 ** model.of(a << 16 | b << 8 | every)).sum() == pytest.approx(1)


def test_packed_arrays():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpacked_sorted(packed_sorted(x)) == x).all() and (unpacked(packed(x.astype(np.int64)), np.int64) == x.astype(np.int64)).all()
    assert len(unpacked_sorted(packed_sorted(x[:0]))) == 0


class Walk:
    """The automaton by hand: dictionaries of all n-grams, one walk over each text."""

    def __init__(self, texts):
        self.n = [collections.Counter() for _ in range(4)]
        for t in texts:
            for k in (1, 2, 3):
                self.n[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
        self.total = sum(self.n[1].values())
        self.new = (sum(c == 1 for c in self.n[1].values()) + 1) / (self.total + 2) if self.total else 1.0
        self.spell = spelling_by_hand([w[0] for w, c in self.n[1].items() if c == 1])
        self.mass = {}
        for k in (2, 3):
            once, times = collections.Counter(), collections.Counter()
            for g, c in self.n[k].items():
                if self.n[k - 1][g[:-1]] >= 2:
                    x = int(math.log2(self.n[k - 1][g[:-1]]))
                    once[x] += c == 1
                    times[x] += c
            self.mass[k] = {x: 1 - (once[x] + 1) / (times[x] + 2) for x in times}

    def spelt(self, w):
        text = b"  " + w + b"\n"
        return math.prod(self.spell(text[i - 2 : i], text[i]) for i in range(2, len(text)))

    def weight(self, state, w):
        """Of the arc for w, or of the failure arcs down to where there is one."""
        if not state:
            return (1 - self.new) * self.n[1][(w,)] / max(self.total, 1) + self.new * self.spelt(w)
        lower, times = self.weight(state[1:], w), self.n[len(state)][state]
        if times < 2:
            return lower
        mass = self.mass[len(state) + 1][int(math.log2(times))]
        return mass * self.n[len(state) + 1][(*state, w)] / times + (1 - mass) * lower

    def score(self, text):
        state, out = (), 0.0
        for w in text:
            out += math.log10(self.weight(state, w))
            state = (*state, w)[-2:]
        return out


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def expected(rows, held):
    c, texts = collections.Counter(), {}
    for i, text in rows:
        texts[i] = tokens(text)
        if not held(i):
            c.update(texts[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in texts.items()}


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "Was", "to"]) if r.random() < 0.5 else "".join(r.choice("abcdé") for _ in range(r.randrange(1, 5)))
    rows = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(60)]
    rows += [rows[0], rows[3], rows[3] + " tail", "", None, "\t a\x0bb "]
    return [(i, t) for i, t in enumerate(rows)]


def test_scores_equal_a_walk(spark, monkeypatch):
    rows = corpus()
    held = lambda i: i % 7 == 2
    walk = Walk([tokens(t) for i, t in rows if not held(i)])
    docs = spark.createDataFrame(rows, "doc_id long, body string").select("doc_id", F.coalesce("body", F.lit("")).alias("body"), (F.col("doc_id") % 7 == 2).alias("held"))
    for block, range_ in ((2_000_000, 3_000_000), (100, 150)):  # one block and range, or many
        monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
        monkeypatch.setattr(language_model, "RANGE_ENTRIES", range_)
        got = {r.doc_id: r for r in score_documents(docs.repartition(3)).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            assert got[i].score == pytest.approx(walk.score(tokens(t)))


def test_words_after_a_state_sum_to_one():
    rows = corpus()
    walk = Walk([tokens(t) for _, t in rows])
    known = [w for (w,) in walk.n[1]]
    for state in [(), (b"the",), (b"the", b"of"), (b"nowhere",)]:
        # known words have all but what the spelling gives to other strings
        rest = 1 - sum(walk.spelt(w) for w in known)
        lost, s = walk.new, state
        while s:
            times = walk.n[len(s)][s]
            lost *= 1 - walk.mass[len(s) + 1][int(math.log2(times))] if times >= 2 else 1
            s = s[1:]
        assert sum(walk.weight(state, w) for w in known) == pytest.approx(1 - lost * rest)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want, got = expected(rows, held), op7_language_model(spark, small).collect()
    walk = Walk([tokens(t) for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3]) and r.held_out == held(r.doc_id)
    for r in got[::40]:
        text = next(t for i, t in rows if i == r.doc_id)
        if len(text) < 3000:
            assert r.score == pytest.approx(walk.score(tokens(text)))


def test_held_out_texts_are_likelier_than_by_the_base(spark, small):
    """The base doesn't spell unknown words, so with very few training texts, where a quarter of the words is new, it isn't comparable."""
    folder = small.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    total = op7_language_model(spark, folder).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert total.score > 0.95 * total.base


def test_edges(spark):
    rows = [(1, None, False), (2, "", False), (3, "A a\tb\u00a0c", False), (3, "A a\tb\u00a0c", False), (None, "z", False), (4, "w " * 60000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, held boolean").withColumn("body", F.coalesce("body", F.lit("")))
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    assert (got[1].n_tokens, got[3].n_tokens, got[4].n_tokens, got[4].n_known) == (1, 4, 60001, 1) and got[None].n_tokens == 2 and got[1].train_tokens == 12
    untrained = score_documents(docs.withColumn("held", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score <= 0 for r in untrained)
    assert score_documents(docs.limit(0)).count() == 0
