import random

from sessionlens.llm.toxicity import Model, fit, op5_toxicity, score_documents, train


def corpus(n=400, seed=4):
    """One sentence of a toxic document has a bad word or a compound of a bad stem."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        sentences = [" ".join(r.choices(words, k=r.randrange(3, 12))) + "." for _ in range(r.randrange(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[r.randrange(len(sentences))] = " ".join([*r.choices(words, k=4), r.choice(["zgrobby", "xwepp" + r.choice(words)]), "no."])
        rows.append((i, " ".join(sentences), int(toxic)))
    return rows


def test_held_out_accuracy_and_place():
    rows = corpus()
    model = fit([t for i, t, _ in rows if i % 5], [y for i, _, y in rows if i % 5])
    cache, right = model.word_scorer(), 0
    for i, text, y in rows:
        if i % 5 == 0:
            found = model.sentence_scores(text, cache)
            score = model.document_score(found)
            right += (score >= 0.5) == y
            if y and score >= 0.5:
                a, b, _ = max(found, key=lambda x: x[2])
                assert "zgrobby" in text[a:b] or "xwepp" in text[a:b]
    assert right >= 78


def test_noisy_or():
    m = Model(0.0)
    assert m.document_score([]) == 0
    assert abs(m.document_score([(0, 1, 0.5), (1, 2, 0.5)]) - 0.75) < 1e-12


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "?!", "x"), (4, "zgrobby. " * 20000, "x"), (5, "fine", "x"), (5, "fine", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    texts = corpus()
    model = fit([t for _, t, _ in texts], [y for _, _, y in texts])
    out = score_documents(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted", "n_sentences", "offending"]
    got = {r.doc_id: (r.score, r.predicted) for r in out.collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4][1] == 1 and 0 <= got[5][0] < 0.5 and out.count() == 6
    assert score_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(5, None), (4, 1), (4, 0), (9, 0)], "doc_id long, toxic int")
    one = train(docs, labels)  # only one class has documents
    assert 0 <= one.document_score(one.sentence_scores("any word", one.word_scorer())) <= 1
    none = train(docs, labels.limit(0))
    assert none.document_score(none.sentence_scores("any word", none.word_scorer())) == 0


def test_query(spark, small):
    out = op5_toxicity(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    held = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.8 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.collect())
