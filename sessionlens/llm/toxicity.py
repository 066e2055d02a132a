"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences. A sentence's score is a logistic function of its words' weights; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Training maximises the likelihood of the document labels through that noisy-or, so
the weight of a label settles on the sentences that explain it; these are then reported as offending.

Features of a word are the lower-case word and its prefixes and suffixes of 4 to 6 characters (compounds share them).

Defined results: null text counts as empty; a text without words has score 0; repeated rows are scored alike each time; extra
columns of the input pass through score_documents() untouched; labels other than 0 and 1 are none; of several texts of a doc_id the first
in order is learned from; rows with a null doc_id are not held out; with no usable label (or of one class only) every score is the
share of label 1 (0 if there is no label) for texts that have words.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, giving_back, table, text_or_empty

SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")
WORD = re.compile(r"\w+")
CACHE_WORDS = 150_000
#: Features are hashed into so many numbers.
MASK = (1 << 23) - 1


def features(word: str) -> list[int]:
    """The word, its prefixes and its suffixes as hashed numbers; the marks keep the three apart."""
    n = len(word)
    texts = [word] + [f"{word[:k]}^" for k in (4, 5, 6) if n > k] + [f"${word[-k:]}" for k in (4, 5, 6) if n > k]
    return [crc32(t.encode("utf-8", "surrogatepass")) & MASK for t in texts]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words) of each sentence that has words; offsets are code points of the text."""
    found = ((m.start(), m.end(), list(dict.fromkeys(WORD.findall(m[0].lower())))) for m in SENTENCE.finditer(text))
    return [x for x in found if x[2]]


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    constant: float | None = None  #: the score of every text with words if nothing could be learned

    def word_scorer(self) -> dict:
        weights = self.weights

        class Cache(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > CACHE_WORDS:
                    self.clear()
                value = self[word] = sum(weights.get(f, 0.0) for f in features(word))
                return value

        return Cache()

    def sentence_scores(self, text: str, cache: dict) -> list[tuple[int, int, float]]:
        out = []
        for start, end, words in sentences(text):
            z = self.bias + sum([cache[w] for w in words])
            out.append((start, end, 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return out

    def document_score(self, scored: list[tuple[int, int, float]]) -> float:
        if not scored:
            return 0.0
        if self.constant is not None:
            return self.constant
        log_clean = sum(math.log1p(-min(p, 1 - 1e-15)) for _, _, p in scored)
        return -math.expm1(log_clean)


def fit(texts: list[str], labels: list[int], prior: float | None = None, steps: int = 300, min_df: int = 4, l1: float = 1e-4) -> Model:
    """Fit on labelled texts. prior: the share of label 1 where the texts come from, if the sample has another one.

    Proximal Adam on the mean negative log-likelihood; min_df documents must have a feature, and only features whose document
    frequencies differ between the labels (|z| of the log-odds over 2.5) enter.
    """
    y = np.asarray(labels, dtype=np.float64)
    positives = y.sum()
    if not len(y) or positives in (0, len(y)):
        return Model(0.0, {}, float(prior if prior is not None else y.mean() if len(y) else 0.0))
    known: dict[str, list[int]] = {}

    def ids(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            if len(known) > CACHE_WORDS // 3:
                known.clear()
            found = known[word] = features(word)
        return found

    df, df_pos = np.zeros(MASK + 1, dtype=np.int32), np.zeros(MASK + 1, dtype=np.int32)
    for text, label in zip(texts, labels, strict=True):
        seen = np.unique(np.fromiter(chain.from_iterable(map(ids, {w for _, _, ws in sentences(text) for w in ws})), dtype=np.int64))
        df[seen] += 1
        if label:
            df_pos[seen] += 1
    n_pos, n_neg = positives, len(y) - positives
    frequent = np.flatnonzero(df >= min_df)
    a, b = df_pos[frequent] + 0.5, df[frequent] - df_pos[frequent] + 0.5
    c, d = n_pos - df_pos[frequent] + 0.5, n_neg - (df[frequent] - df_pos[frequent]) + 0.5
    telling = frequent[np.abs(np.log(a * d / (b * c))) > 2.5 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)]
    position = np.full(MASK + 1, -1, dtype=np.int32)
    position[telling] = np.arange(len(telling))
    rows, cols, sent_doc = array("i"), array("i"), array("i")
    for doc, text in enumerate(texts):
        for _, _, words in sentences(text):
            own = position[np.fromiter(chain.from_iterable(map(ids, words)), dtype=np.int64)]
            own = own[own >= 0].tolist()
            cols.extend(own)
            rows.extend([len(sent_doc)] * len(own))
            sent_doc.append(doc)
    rows_, cols_, docs_ = (np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, dtype=np.int32) for x in (rows, cols, sent_doc))
    n_sent, n_feat = len(docs_), len(telling)
    mean_sentences = max(1.0, n_sent / max(1, len(y)))
    theta = np.zeros(n_feat + 1)
    theta[-1] = math.log(0.05 / mean_sentences)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    if prior is not None and 0 < prior < 1:  # train as if the classes had their shares in the corpus
        weight = np.where(y == 1, prior / (n_pos / len(y)), (1 - prior) / (n_neg / len(y)))
    else:
        weight = np.ones_like(y)
    for step in range(1, steps + 1):
        z = np.bincount(rows_, theta[cols_], n_sent) + theta[-1]
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(docs_, np.log1p(-p), len(y))
        clean = np.exp(log_clean)
        toxic = np.maximum(1 - clean, 1e-12)
        up = np.where(y == 1, -clean / toxic, 1.0) * weight / len(y)
        g_sent = up[docs_] * p
        grad = np.concatenate([np.bincount(cols_, g_sent[rows_], n_feat), [g_sent.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.98 * v + 0.02 * grad * grad
        rate = 0.2 * (1 - step / (steps + 1))
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate * l1, 0)
    return Model(float(theta[-1]), {int(f): float(theta[i]) for i, f in enumerate(telling) if abs(theta[i]) > 1e-4})


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> tuple[list[str], list[int], float]:
    """A bounded sample: up to max_rows of each class in the order of a hash of doc_id, as long as max_chars lasts.

    Also the share of label 1 among all usable rows. A doc_id with several labels counts by its largest one.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    shares = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if not total:
        return [], [], 0.0
    picked = [r for y in shares for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in picked], "doc_id long, y int"))  # at most 2 * max_rows
    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(ids, "doc_id")
    sizes = chosen.select("doc_id", "y", F.length("text").alias("n")).groupBy("doc_id").agg(F.first("y").alias("y"), F.max("n").alias("n")).collect()
    spent, keep = {0: 0, 1: 0}, []
    for r in sorted(sizes, key=lambda r: (r.n > max_chars // 64, hash((r.doc_id * 2654435761) & 0xFFFFFFFF), r.doc_id)):
        spent[r.y] += r.n
        if spent[r.y] <= max_chars // 2:
            keep.append((r.doc_id,))
    if not keep:
        return [], [], shares.get(1, 0) / total
    kept = F.broadcast(spark.createDataFrame(keep, "doc_id long"))
    rows = chosen.join(kept, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.y for r in rows], shares.get(1, 0) / total


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 3000, max_chars: int = 16_000_000) -> Model:
    """Fit on a bounded sample of labelled documents (max_rows of each class, max_chars in all)."""
    texts, ys, prior = training_rows(docs, labels, label, max_rows, max_chars)
    return fit(texts, ys, prior if texts else None)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, predicted, n_sentences and offending (sentences of a score >= threshold: start, end, score) to keep (all columns).

    Columns of those names in the input are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = {"score", "predicted", "n_sentences", "offending"}
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    own = text in names and docs.schema[text].dataType == T.StringType()  # then the text goes to Python once
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if own else [text_or_empty(text).alias("__body")]))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("offending", SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_rows and max_chars bound it

    def run(batches):
        fitted = shared.value
        cache = fitted.word_scorer()
        for batch in batches:
            scores, sizes, spans = [], [], []
            for body in batch.column(text if own else "__body"):
                found = fitted.sentence_scores(body.as_py() or "", cache)
                scores.append(fitted.document_score(found))
                sizes.append(len(found))
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= threshold])
            columns = [batch.column(c) for c in names]
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            columns += [pa.array(scores, pa.float64()), predicted, pa.array(sizes, pa.int32()), pa.array(spans, SPAN_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted", "n_sentences", "offending"])

    return source.mapInArrow(giving_back(run), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Labels of fold 0 (crc32 of doc_id mod 5) are held out; every document is scored."""

    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold != 0))
    scored = score_documents(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))
