import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from sessionlens.llm.decontaminate import FMIndex, WaveletMatrix, find_occurrences, op10_decontaminate, phrases_of, remove_spans, search_shard, suffix_array, words
from sessionlens.llm.shingles import mix, word_hashes

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    windows = {}
    for i, t in items:
        w = PATTERN.findall(low(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in docs:
        w = PATTERN.findall(low(t))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    found |= owners
                    hit[k : k + n] = [1] * n
        out.append((len(w), hit, sorted(found)))
    return out


def test_words():
    for t in ("Ab1-é_中!x", "", "`{A}", "tab\tnew\nline\x7f"):
        assert words(t) == PATTERN.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))


def test_index_finds_every_place():
    r = random.Random(5)
    text = np.array([r.randrange(1, 4) if r.random() < 0.93 else 0 for _ in range(700)] + [0])
    index = FMIndex(text, 3)
    for n in (1, 2, 3, 5):
        phrases = np.array([[r.randrange(1, 4) for _ in range(n)] for _ in range(40)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            places = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == places


def test_shards_equal_brute_force():
    r = random.Random(1)
    for size in (1, 2, 4):
        docs = [" ".join(r.choice("abcde") for _ in range(r.randrange(40))) for _ in range(60)]
        items = [(i, " ".join(r.choice("abcde") for _ in range(r.randrange(7)))) for i in range(12)]
        p = phrases_of(items, size)
        want = brute(docs, items, size)
        for blocks in ([p], [phrases_of(items[:5], size), phrases_of([], size), phrases_of(items[5:], size)]):
            found, hit = search_shard(*word_hashes(pa.array(docs)), blocks)
            assert [sorted(x) for x in found] == [w[2] for w in want]
            assert hit.astype(int).tolist() == [h for w in want for h in w[1]]


def test_suffix_array_equals_sorting():
    r = random.Random(3)
    for n in (1, 2, 50, 400):
        text = np.array([r.randrange(3) for _ in range(n)])
        text[r.randrange(n)] = 1
        unlike = np.append(text + 1, 0)
        assert suffix_array(unlike).tolist() == sorted(range(n + 1), key=lambda k: unlike[k:].tolist())


def test_items_without_ids(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (None, "other words")], "item_id long, text string")
    assert find_occurrences(docs, benchmark).first().item_ids == [None, 3]


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def test_edges_spans_and_removal(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "é " + PASSAGE.upper() + "! tail", "k"), (4, "word " * 30000, "k"), (5, PASSAGE, "k"), (5, PASSAGE, "k"), (6, "one two three", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame([(7, PASSAGE), (8, "one two three four five six seven eight nine ten"), (9, None), (10, "short item")], "item_id long, text string")
    found = find_occurrences(docs, benchmark, shard_words=10)
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "item_ids", "spans"]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
    assert got == {1: (0, 0, []), 2: (0, 0, []), 3: (14, 12, [7, 8]), 4: (30000, 0, []), 5: (12, 12, [7, 8]), 6: (3, 0, [])}
    cut = {r.doc_id: r.x for r in found.select("doc_id", remove_spans(found["text"], found["spans"]).alias("x")).collect()}
    assert cut[3] == "é ! tail" and cut[5] == "" and cut[6] == "one two three" and cut[1] is None
    assert find_occurrences(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0 and find_occurrences(docs.limit(0), benchmark).count() == 0
    blocks = find_occurrences(docs, benchmark, max_items=1)
    assert {r.doc_id: r.item_ids for r in blocks.collect()} == {k: v[2] for k, v in got.items()}


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute([d.text for d in docs], items)
    for r, (n, hit, found) in zip(op10_decontaminate(spark, small).orderBy("doc_id").collect(), want, strict=True):
        names = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), sum(hit) > 0)


def test_a_shard_takes_less_than_100_bytes_a_word():
    """Two Python workers and a full heap share an executor's memory; bits and places of 64 bits took 139 bytes a word here."""
    n = 200_000
    hashes = mix((np.random.default_rng(1).zipf(1.2, n) % 50_000).astype(np.uint64))
    block = phrases_of([(1, "a passage of some words")], 10)
    tracemalloc.start()
    search_shard(hashes, np.arange(0, n + 1, 200), [block])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n


def test_ranks_across_words_of_bits():
    r = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 128, 1000):
        text = r.integers(0, 6, n)
        tree = WaveletMatrix(text, 3)
        for c in range(6):
            at = np.arange(n + 1)
            assert tree.rank(np.full(n + 1, c), at).tolist() == np.concatenate([[0], np.cumsum(text == c)]).tolist()
        symbol, rank = tree.access(np.arange(n))
        assert symbol.tolist() == text.tolist() and rank.tolist() == [int((text[:k] == text[k]).sum()) for k in range(n)]
