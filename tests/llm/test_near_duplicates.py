import collections
import random
import re

from sessionlens.llm import near_duplicates
from sessionlens.llm.near_duplicates import bands_for, keep_one_of_each, op6_ngram_jaccard_join, similarity_join


def shingles(text, n=5):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, threshold=0.8):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed=2):
    """Groups of copies with a few words changed, texts of their own, copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for size, edits in ((40, 3), (25, 8), (3, 1), (2, 1)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(edits + 1)):
                copy[r.randrange(120)] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(r.randrange(1, 90))) for _ in range(60)] + [rows[0], rows[50], "a b", "A  b!"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = similarity_join(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999)
    assert {r.doc_id: r.class_id for r in got.collect()} == classes(rows)


def links(rows, threshold=0.8):
    """For each document the other copies of its text and the different similar texts."""
    sets = {d: frozenset(shingles(t)) for d, t in rows}
    copies = collections.Counter(sets.values())
    similar = {x: sum(1 for y in copies if y != x and x and len(x & y) / len(x | y) >= threshold) for x in copies}
    return {d: copies[x] - 1 + similar[x] if x else 0 for d, x in sets.items()}


def test_links_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = links(rows)
    assert max(want.values()) > 20
    assert {r.doc_id: r.n_links for r in similarity_join(docs, recall=0.99999).collect()} == want
    monkeypatch.setattr(near_duplicates, "PART_TEXTS", 3)  # classes in many parts, some of them empty
    assert {r.doc_id: r.n_links for r in similarity_join(docs, recall=0.99999).collect()} == want


def test_repeated_and_null_ids(spark, monkeypatch):
    w = [f"w{k}" for k in range(200)]
    near = " ".join(w), " ".join(w[:-1]), " ".join(w[:-2])
    other = " ".join(f"o{k}" for k in range(50))
    rows = [(1, near[0]), (1, near[0]), (1, other), (2, near[1]), (None, near[2]), (3, other + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 1, 3, 2)] * 2 + [(1, 1, 1, 1), (2, 1, 2, 1), (-1, 1, 2, 1), (3, 1, 1, 1)])
    for most in (1_000_000, 0):
        monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", most)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.n_links, r.n_copies) for r in similarity_join(docs).collect()) == want


def test_clean_rows_stay(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("c")), (1, text("d")), (1, text("d")), (2, text("c") + " more"), (None, text("c")), (None, ""), (None, None), (3, ""), (3, "")]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (None, ""), (None, None), (3, "")]
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in want)


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "!!", 0), (4, "one", 0), (5, "ONE", 0), (6, "x y z " * 30000, 0), (7, "one", 0), (7, "one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in similarity_join(docs).collect()}
    assert got == {1: (1, 0, 1), 2: (2, 0, 1), 3: (3, 0, 1), 4: (4, 3, 4), 5: (4, 3, 4), 6: (6, 0, 1), 7: (4, 3, 4)}
    assert sorted(r.doc_id for r in keep_one_of_each(docs).collect()) == [1, 2, 3, 4, 6]
    assert similarity_join(docs.limit(0)).count() == 0
    assert bands_for(0.8, 0.9995)[0] * bands_for(0.8, 0.9995)[1] <= 64


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op6_ngram_jaccard_join(spark, small).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    assert {r.doc_id: r.n_links for r in got} == links(rows)  # at the query's own recall no link is lost here


def test_a_bucket_of_unlike_texts(spark, monkeypatch):
    """Texts that share most words, but not enough, meet in common buckets; only true links come out, in one part or in many."""
    r = random.Random(5)
    common = [f"c{k}" for k in range(150)]
    rows = []
    for k in range(30):
        own = [f"o{k}_{i}" for i in range(24)]
        text = " ".join(common + own)
        rows += [(3 * k, text), (3 * k + 1, text + f" x{k} y{r.randrange(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (256, 7):
        monkeypatch.setattr(near_duplicates, "PART_TEXTS", most)
        got = similarity_join(docs, threshold=0.8, recall=0.99999).collect()
        assert {x.doc_id: x.class_id for x in got} == classes(rows)
        assert {x.doc_id: x.n_links for x in got} == links(rows)


def test_hot_copies_stay_where_they_are(spark, monkeypatch):
    rows = [(k, "one two three four five six") for k in range(50)] + [(99, "seven eight"), (100, None)]
    monkeypatch.setattr(near_duplicates, "HOT_SHARE", 0.1)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 49, 50) for k in range(50)} | {99: (99, 0, 1), 100: (100, 0, 1)}
