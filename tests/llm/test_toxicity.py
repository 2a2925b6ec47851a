import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import toxicity as T


def test_word_hashes_tell_words_apart():
    words = sorted({f"w{i}" for i in range(5000)} | {"a" * i for i in range(1, 300)})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    h = T.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(words)
    again = T.word_hashes(np.concatenate([np.zeros(77, np.uint8), data]), starts + 77, ends + 77)
    assert (h == again).all()  # a word's hash doesn't depend on its place


def test_features_of_grams_and_skips():
    doc, coordinate = T.features(pa.array(["One two, three", None, "", "one"]))
    assert np.bincount(doc, minlength=4).tolist() == [3 + 2 + 1, 0, 0, 1]
    assert coordinate[0] == coordinate[doc == 3][0]


def test_learns_words_and_skips():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 200, 30)]
        kind = i % 4
        at = int(rng.integers(0, 27))
        if kind == 0:
            words[at] = "vile"
        elif kind == 1:
            words[at], words[at + 2] = "you", "fool"
        elif kind == 2:
            words[at], words[(at + 9) % 30] = "you", "fool"
        texts.append(" ".join(words))
        labels.append(int(kind < 2))
    doc, coordinate = T.features(pa.array(texts))
    rows = [np.unique(coordinate[doc == i]) for i in range(len(texts))]
    model = T.fit(rows[:400], np.array(labels[:400]))
    score = model.score(pa.array(texts[400:]), model.dense())
    assert ((score >= 0.3) == np.array(labels[400:])).mean() > 0.93
    assert len(model.coordinates) < 4000


def test_odd_rows(odd, no_documents, some_labels):
    model = T.learn(odd, some_labels)
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(no_documents, T.learn(no_documents, some_labels)).count() == 0
    empty = T.learn(odd, some_labels.limit(0))
    assert {round(r.score, 6) for r in T.score(odd, empty).collect()} == {round(1 / (1 + np.exp(6)), 6)}


def test_held_out_rows(spark):
    rows = spark.range(100).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_change_nothing(sample, sample_labels):
    changed = sample_labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(sample, sample_labels), T.learn(sample, changed)
    assert (a.coordinates == b.coordinates).all() and (a.weights == b.weights).all() and a.bias == b.bias
