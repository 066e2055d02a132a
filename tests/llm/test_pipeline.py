"""Each stage against a plain reading of its rule; the stages one after another."""

import tiktoken

import corpus_pipeline
import public_tokenizers
from sessionlens.llm.bpe import load_ranks

from .test_decontaminate import PASSAGE
from .test_near_duplicates import classes


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, small)
    assert kept.columns == names
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    stayed = {r.doc_id for r in kept.collect()}
    assert sum(labels.get(i) == 1 for i in stayed) <= 0.5 * sum(labels.values()) and sum(labels.get(i) == 0 for i in rows if i not in stayed) <= 1
    kept.write.parquet(f"{tmp_path}/1")
    docs = spark.read.parquet(f"{tmp_path}/1")
    one = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    want = classes([(r.doc_id, r.text) for r in docs.collect()])
    assert one.columns == names and {r.doc_id for r in one.collect()} == set(want.values())
    one.write.parquet(f"{tmp_path}/2")
    docs = spark.read.parquet(f"{tmp_path}/2")
    cut = corpus_pipeline.cut_benchmark(spark, docs, small)
    assert cut.columns == names and cut.count() == docs.count()
    ids = corpus_pipeline.encode(spark, cut, small).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(list(r.token_ids) == encoding.encode_ordinary(texts[r.doc_id]) for r in ids) and len(ids) == len(texts)


def test_cut_takes_the_passage_only(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"before. {PASSAGE.title()}. after", None, "s", 5), (2, "clean", "en", None, 5), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_benchmark(spark, docs, str(tmp_path)).collect()}
    assert got[1].text == "before. . after" and got[1].n_chars == 15 and got[2].text == "clean" and got[3].text is None and got[3].n_chars is None


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "token_ids"] and 0 < out.count() <= spark.read.parquet(f"{small}/documents.parquet").count()
