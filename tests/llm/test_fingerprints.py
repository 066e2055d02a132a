import collections
import hashlib
import random

from sessionlens.llm.fingerprints import edits, fingerprint, fingerprint_documents, in_order, likeness, located, op1_document_fingerprints, parse, size

TEXT = "A first line, of some words here. And more of it.\nSecond line of the section, with words.\n\nAnother section; it has one line of text only."


def test_roots_test_equality():
    seen = {}
    for t in ("", " ", "\n", "\n\n", "a", "a\n", "a\n\nb", "a\nb", "ab", TEXT, TEXT + " ", TEXT.replace("\n\n", "\n")):
        root = fingerprint(t).partition(";")[0]
        assert seen.setdefault(root, t) == t
    assert fingerprint(TEXT) == fingerprint(str(TEXT))


def test_differing_branches_locate_edits():
    changed = TEXT.replace("Second line", "Other line")
    assert edits(fingerprint(TEXT), fingerprint(changed)) == [(0, 1)] and edits(fingerprint(TEXT), fingerprint(TEXT)) == []
    near = likeness(fingerprint(TEXT), fingerprint(changed))
    assert 0.5 < near < 1 and likeness(fingerprint(TEXT), fingerprint("Nothing in common with it at all, no.")) < 0.2
    assert likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint(""), fingerprint("a b")) == 0


def test_likeness_equals_counting_all_pieces():
    r = random.Random(6)
    line = lambda: " ".join(r.choice(["aa", "bb, ", "cc. ", "dddd ddd dd"]) for _ in range(r.randrange(1, 9)))
    texts = ["\n".join(line() if r.random() < 0.8 else "" for _ in range(r.randrange(0, 12))) for _ in range(60)]
    texts += [t + "\n" + texts[0] for t in texts[:20]] + ["", "\n", "x"]
    for a in map(fingerprint, texts):
        flat = lambda p: collections.Counter(x for _, inner in parse(p)[1] for _, pieces in inner for x in pieces)
        assert size(a) == flat(a).total()
        for b in map(fingerprint, r.sample(texts, 12)):
            x, y = flat(a), flat(b)
            want = 1.0 if a == b else 2 * (x & y).total() / (x.total() + y.total()) if x or y else 0.0
            assert abs(likeness(a, b) - want) < 1e-12


def test_every_difference_is_located():
    base = "One line here, with words.\nTwo lines.\nTwo lines.\n\nThree, of another section.\nFour it is, four it was."
    a = fingerprint(base)
    assert edits(a, fingerprint(base.replace("Two lines.\n", "", 1))) == [(0, 2)] or edits(a, fingerprint(base.replace("Two lines.\n", "", 1))) == [(0, 1)]
    assert edits(fingerprint(base.replace("Two lines.\n", "Two lines.\n" * 2, 1)), a)
    lines = base.split("\n")
    assert edits(a, fingerprint("\n".join([lines[1], lines[0], *lines[2:]])))
    assert located(a, fingerprint(base.replace("four it was", "five it was"))) == [(1, 1, 1)] or located(a, fingerprint(base.replace("four it was", "five it was")))[0][:2] == (1, 1)
    long = "words without a stop " * 5
    assert located(fingerprint(long), fingerprint(long + "\n")) == [(0, 0, None)]


def test_rows_without_ids(spark, tmp_path):
    spark.createDataFrame([(None, "abcdefgh"), (None, "abcdefgh")], "doc_id long, text string").write.parquet(f"{tmp_path}/all/documents.parquet")
    assert [r.near_next for r in op1_document_fingerprints(spark, f"{tmp_path}/all").collect()] == [1, 1]
    spark.createDataFrame([(3, "three of it"), (None, "abcdefgh"), (1, "one, one")], "doc_id long, text string").write.parquet(f"{tmp_path}/some/documents.parquet")
    got = {r.doc_id: r.edited_sha256 for r in op1_document_fingerprints(spark, f"{tmp_path}/some").collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((None, "abcdefon"), (1, "one, oth"), (3, "three of ab"))}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "word, " * 40000, None)], "doc_id long, text string, fingerprint string")
    rows = fingerprint_documents(docs).orderBy("doc_id").collect()
    assert rows[0].fingerprint == fingerprint("") and fingerprint_documents(docs).columns == ["doc_id", "text", "fingerprint"]
    assert fingerprint_documents(docs.limit(0)).count() == 0


def test_neighbours_of_many_buckets(spark):
    rows = [(i * i, f"text {i}") for i in range(500)] + [(49, "text 7 again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = in_order(docs, rows_a_bucket=20).collect()
    by = {}
    for r in found:
        by.setdefault(r.bucket, []).append(r)
    assert len(by) > 10
    order = []
    for b in sorted(by):
        own = sorted(by[b], key=lambda r: (r.follower, r.doc_id, r.tie))
        assert sum(r.follower for r in own) == 1
        order.append(([r.doc_id for r in own if not r.follower], own[-1].doc_id))
    for (_, follower), (following, _) in zip(order, order[1:] + order[:1]):
        assert follower == following[0]
    assert [i for ids, _ in order for i in ids] == sorted(i for i, _ in rows)


def test_query(spark, small):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in op1_document_fingerprints(spark, small).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(t), fingerprint(edited)) and r.near_next == likeness(fingerprint(t), fingerprint(after))
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)


def test_single_and_empty_tables(spark, tmp_path):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    for name, df in (("one", one), ("none", one.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    (r,) = op1_document_fingerprints(spark, f"{tmp_path}/one").collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
    assert op1_document_fingerprints(spark, f"{tmp_path}/none").count() == 0
