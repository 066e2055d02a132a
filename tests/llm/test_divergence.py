"""Source divergence against brute force and SQL; the transducer by itself."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionlens.llm import divergence as op
from sessionlens.llm.divergence import OP11_SQL, Transducer, divergence_audit, op11_source_divergence, spans_of

from ..helpers import duck_rows, spark_rows

SCHEMA = "doc_id long, text string, lang string, source string, shard long, term string, n long"


def words(text):
    low = (text or "").translate(str.maketrans(op.UPPER, op.LOWER))
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, least=3, top=200):
    docs = [(words(t), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(w for d in own for w in set(d[0]))
        kept = sorted((w for w, n in df.items() if n >= least), key=str.encode)
        v, counts = len(kept), {s: Counter(w for d in own if d[2] == s for w in d[0] if df[w] >= least) for s in {d[2] for d in own}}

        def p(c, v=v, kept=kept):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (n + v) for w in kept}

        shares, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in shares:
            pairs = sorted(((-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode(), o) for o in shares if o != s))
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(pairs)]
            terms = sorted((-f(shares[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and shares[s][w] > q[w])
            out += [(lang, s, "term", w, -x, k + 1) for k, (x, _, w) in enumerate(terms[:top])]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(k, t, lang, s, 1, "x", 2) for k, (t, lang, s) in enumerate(docs)], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n=160, seed=4):
    rnd = random.Random(seed)
    stems = ["Straße", "éa", "a", "ab", "abc", "b", "Zed", "ÀB", "日本", "𝒳y", "É", "é", "ſ", "K"] + ["".join(rnd.choices("abcxyz", k=rnd.randint(1, 5))) for _ in range(120)]
    docs = [(" ".join(rnd.choices(stems, weights=[1 / (k + 1) for k in range(len(stems))], k=rnd.randint(0, 40))) + rnd.choice(["", "!", "_a0b", "\x00x"]), rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s2", "S3", "é", None])) for _ in range(n)]
    return docs + [(None, "en", "silent"), ("", "fr", "x"), ("once only", "fr", "y"), ("lone lone lone", "it", "z")] + [docs[3]] * 4


def test_query_equals_sql(spark, small):
    assert spark_rows(op11_source_divergence(spark, small)) == duck_rows(OP11_SQL, small)


@pytest.mark.parametrize("automata_bytes", [op.AUTOMATA_BYTES, 0])
def test_equals_brute_force(spark, monkeypatch, automata_bytes):
    """Small shards, tiles and blocks, both ways of recounting; ties, nulls, repeated rows, groups without terms."""
    for name, n in (("SHARD_TERMS", 16), ("TILE", 2), ("BLOCK_TERMS", 5), ("HELD_COUNTS", 20)):
        monkeypatch.setattr(op, name, n)
    docs = corpus()
    assert found(divergence_audit(frame(spark, docs), automata_bytes=automata_bytes)) == brute(docs)
    assert found(divergence_audit(frame(spark, docs), top=3, automata_bytes=automata_bytes)) == brute(docs, top=3)


def test_empty_table(spark):
    assert found(divergence_audit(frame(spark, []))) == []
    assert found(divergence_audit(frame(spark, [("a", "en", "x"), (None, None, None)]))) == []


def test_long_text(spark):
    docs = [("word " * 200_000 + "x" * 300_000, "en", "a"), ("word other " * 3, "en", "b"), ("word other", "en", "b"), ("Other", "en", "c")]
    assert found(divergence_audit(frame(spark, docs))) == brute(docs)


def test_transducer_counts_and_spells():
    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choices("abé日x", k=rnd.randint(1, 7))).encode() for _ in range(3000)})
    made = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    text = np.frombuffer(b"".join(terms), dtype=np.uint8)
    lengths = np.array([len(t) for t in terms])
    assert made.ordinals(text, np.cumsum(lengths) - lengths, lengths).tolist() == list(range(len(terms)))
    assert [made.term(k) for k in range(len(terms))] == terms
    known, others = set(terms), [t[:k] for t in terms[:200] for k in range(len(t))] + [t + b"q" for t in terms[:50]]
    lengths = np.array([len(t) for t in others])
    got = made.ordinals(np.frombuffer(b"".join(others) + b"\0", dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert [g >= 0 for g in got] == [t in known for t in others]


def test_transducer_is_minimal():
    """As many states as there are different sets of endings."""
    terms = sorted(a + b for a in (b"ab", b"b", b"cab", b"d") for b in (b"", b"s", b"ing", b"er", b"ers"))
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in (t[:k] for k in range(len(t) + 1))}
    assert len(Transducer.build(terms).base) == len(endings)


def test_spans_of_words():
    texts = ["Ab1c", "d", "", "é x", "Q"]
    text, starts, lengths, row = spans_of(pa.array(["skip", *texts]).slice(1))
    got = [(int(r), bytes(text[s : s + n]).decode()) for s, n, r in zip(starts, lengths, row, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in words(t)]
