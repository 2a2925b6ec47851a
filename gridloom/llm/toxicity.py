"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a whole text are its words, neighbouring pairs and pairs with one word between, hashed to 2**22
coordinates and counted once a document. Training follows the gradients of single documents with a rate for each
coordinate; the L1 term keeps a coordinate at nought until enough documents speak for it, so the weights that go to
every task are a few thousand numbers.

The model is fitted on at most MAX_ROWS labelled rows, chosen by the hash of their id. That bound holds at any size
of the corpus, so one task can train it; every text is scored in whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_sample, own_columns, sealed, table, unsealed
from gridloom.llm.text_arrays import HASH_STEP_BYTES, mixed_bits, steps, word_hashes, words_of

BITS = 22
MAX_ROWS = 16_000
THRESHOLD = 0.3

#: What parts words here: everything in ASCII but letters, digits and the apostrophe.
PARTS = np.array([not (c >= 0x80 or chr(c).isalnum() or c == 0x27) for c in range(256)])


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram and skip-gram of a column, with repeats."""
    w = words_of(pc.utf8_lower(column), PARTS)
    h = word_hashes(w.data, w.starts, w.ends)
    shift = np.uint64(64 - bits)
    docs, coords = [w.doc], [h >> shift]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA5A5F00DCAFE1235)):
        if len(h) > gap:
            same = w.doc[gap:] == w.doc[:-gap]
            docs.append(w.doc[:-gap][same])
            coords.append(mixed_bits(h[:-gap][same] * np.uint64(salt) + h[gap:][same]) >> shift)
    return np.concatenate(docs), np.concatenate(coords).astype(np.int64)


@dataclass
class Model:
    """Sparse weights: coordinates and their values, and the bias."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.coordinates] = self.weights
        return out

    def score(self, column: pa.Array, dense: np.ndarray) -> np.ndarray:
        doc, coordinate = features(column, self.bits)
        hit = np.flatnonzero(dense[coordinate])
        once = np.unique(doc[hit] * (1 << self.bits) + coordinate[hit])  # few are left: most weights are nought
        margin = self.bias + np.bincount(once >> self.bits, weights=dense[once & ((1 << self.bits) - 1)], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, least: int = 2) -> Model:
    """FTRL-proximal over rows of distinct coordinates, in the order given; coordinates of under ``least`` rows are left out.

    The default L1 is a hundredth of the positive rows, within 1 and 8: what few rows say then still counts where
    there are few, and where there are many only what many say does.
    """
    if l1 is None:
        l1 = float(np.clip(labels.sum() / 100, 1, 8))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    seen = np.zeros(1 << bits, np.int32)
    for r in rows:
        seen[r] += 1
    rows = [r[seen[r] >= least] for r in rows]
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for r, y in zip(rows, labels):
            zi, ni = z[r], n[r]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30)))
            g = p - y
            root = np.sqrt(ni)
            z[r] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[r] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    final = weights(z, n)
    kept = np.flatnonzero(final)
    return Model(kept, final[kept].astype(np.float32), float(bias), bits)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that aren't held out. Null ids and labels aren't used; an id that is
    labelled more than once is toxic if any label says so; without rows every score is that of the least bias.

    What reaches the one training task are hashed features, at most three a word of those rows.
    """
    usable = own_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    picked = bounded_sample(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", max_rows)
    as_text = F.col("doc_id").cast("string")  # the two tables' ids may be of different types
    rows = own_columns(documents, "doc_id", "text").withColumn("doc_id", as_text).join(F.broadcast(picked.withColumn("doc_id", as_text)), "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rank"), F.col("toxic").cast("int"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in steps(batch.column(2), HASH_STEP_BYTES):
                doc, coordinate = features(batch.column(2).slice(at, to - at), bits)
                once = np.unique(doc * (1 << bits) + coordinate)
                ends = np.searchsorted(once >> bits, np.arange(to - at + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((once & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), lists], names=["rank", "toxic", "coordinates"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.to_pandas() for b in batches if b.num_rows]
        if not found:
            return
        every = pd.concat(found).sort_values(["rank", "toxic"], kind="stable")
        model = fit(list(every["coordinates"]), every["toxic"].to_numpy(float), bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.coordinates, -1)), pa.array(np.append(model.weights.astype(float), model.bias))], names=["coordinate", "weight"])

    extracted = rows.mapInArrow(extract, "rank long, toxic int, coordinates array<int>")
    trained = extracted.repartition(1).mapInArrow(train, "coordinate long, weight double").toPandas()  # 2**bits rows at most
    if trained.empty:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), -6.0, bits)
    own = trained["coordinate"] >= 0
    return Model(trained.loc[own, "coordinate"].to_numpy(), trained.loc[own, "weight"].to_numpy(np.float32), float(trained.loc[~own, "weight"].iloc[0]), bits)


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``score`` (0 to 1) for every row; null text counts as empty and gets the score of
    the bias, a very long text is a step of its own, repeated rows are scored one by one. Equal texts tie."""
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2**bits sparse weights at most, a few thousand in fact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        dense = own.dense()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for at, to in steps(text, HASH_STEP_BYTES):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), pa.array(own.score(text.slice(at, to - at), dense))], names=[*keep, "score"])

    return own_columns(documents, *dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every row of ``documents``; rows with a null doc_id are scored and never held out."""
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, learn(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of THRESHOLD or more go. Null and empty texts score the bias alone; rows
    without doc_id and extra columns of any name stay as they are."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    own = sealed(docs, "text")
    return unsealed(score(own, model, tuple(own.columns)).where(F.col("score") < THRESHOLD), docs, "text")
