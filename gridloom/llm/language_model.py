"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

The model's units are code points (a run of white space is one space, nothing else is folded), in grams of four. Counts
come from all trusted text, summed in each task first and then by gram; the counts of each order, their contexts'
totals and the lower order meet in joins sharded by gram. The model grows with the trusted text and is never gathered
in one place.

Documents are scored by joins too. A scan deals them into chunks; a chunk asks once for each distinct gram it has, the
distinct grams of all chunks meet the model, and the answers go back to the chunk, where each document's perplexity is
summed from them. A document's perplexity is held against a quantile of the trusted documents of its own language that
the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, stored, table
from gridloom.llm.text_arrays import HASH_STEP_BYTES, column_bytes, steps, text_blocks

ORDER = 4
SPACE = 32
#: Trusted documents that set the thresholds and aren't learnt from: one in so many, by the hash of the id.
HELD_OUT = 8
#: Text of a language with fewer held-out documents is held against the quantile of all held-out documents.
LEAST_TRUSTED = 100
#: Shorter texts say too little for a verdict on their perplexity alone.
LEAST_SYMBOLS = 40
#: Text of one chunk; a longer single text is a chunk of its own.
CHUNK_BYTES = 12_000_000
#: Distinct grams that a task holds before it hands them on; each comes with its count, so that they add up.
HELD_GRAMS = 1_000_000
#: Bits of the filter that keeps unlabelled texts from moving. Beyond it more texts move; the join that follows decides.
FILTER_BITS = 26

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


# --- grams of a column ------------------------------------------------------------------------------------------------


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text column, each text led by ORDER - 1 spaces, and the boundaries of the texts."""
    data, offsets = column_bytes(column)
    places = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no text count as U+FFFD
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    blank = (points == SPACE) | ((points >= 9) & (points <= 13))
    keep = np.ones(len(points), bool)
    if len(points):
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[places[:-1][np.diff(places) > 0]] = True  # the text before has no say
    kept = np.concatenate(([0], np.cumsum(keep)))[places]
    bounds = kept + (ORDER - 1) * np.arange(len(kept))
    out = np.full(int(bounds[-1]), SPACE, np.uint32)
    of = np.repeat(np.arange(len(kept) - 1), np.diff(kept))
    out[np.arange(int(kept[-1])) + (of + 1) * (ORDER - 1)] = np.where(blank, SPACE, points)[keep]
    return out, bounds


def _keys(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit number for the gram that ends at each symbol from the ORDER-th on."""
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out += symbols[k : k + n].astype(np.uint64) * FACTORS[k]
    return out


def _ends(bounds: np.ndarray) -> np.ndarray:
    """Places, in what ``_keys`` gives, of the grams that end within one text."""
    size = max(0, int(bounds[-1]) - ORDER + 1)
    inside = np.ones(size, bool)
    for k in range(1, ORDER):  # grams that begin in one text and end in the lead of the next
        cut = bounds[1:-1] - k
        inside[cut[(cut >= 0) & (cut < size)]] = False
    return np.flatnonzero(inside)


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The key of the gram that ends at each symbol, text after text, and how many each text has."""
    symbols, bounds = code_points(column)
    return _keys(symbols)[_ends(bounds)], np.diff(bounds) - (ORDER - 1)


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a column in order, how often each comes, and its symbols."""
    symbols, bounds = code_points(column)
    at = _ends(bounds)
    keys, first, times = np.unique(_keys(symbols)[at], return_index=True, return_counts=True)
    return keys, times, symbols[at[first][:, None] + np.arange(ORDER)]


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    whole, first, back = np.unique(keys, return_index=True, return_inverse=True)
    times = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(whole)).astype(np.int64)
    return whole, times, np.concatenate([p[2] for p in parts])[first]


def _strings(symbols: np.ndarray) -> pa.Array:
    """Rows of code points as a string column."""
    sizes = (1 + (symbols >= 0x80) + (symbols >= 0x800) + (symbols >= 0x10000)).sum(axis=1)
    data = symbols.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(symbols), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _counted(columns: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, times) of the distinct grams of all columns; a gram comes again only after HELD_GRAMS others."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for column in columns:
        for at, to in steps(column, HASH_STEP_BYTES):
            held.append(_distinct(column.slice(at, to - at)))
            if sum(len(h[0]) for h in held) > HELD_GRAMS:
                held = [_added(held)]
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield held[0][2], held[0][1]
                    held = []
    if held:
        _, times, symbols = _added(held)
        yield symbols, times


# --- counts and weights, in joins ------------------------------------------------------------------------------------


def gram_counts(documents: DataFrame) -> DataFrame:
    """(gram, n) over whole texts: counted in each task first, then summed by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, times in _counted(b.column(0) for b in batches):
            for lo in range(0, len(times), 100_000):
                yield pa.RecordBatch.from_arrays([_strings(symbols[lo : lo + 100_000]), pa.array(times[lo : lo + 100_000])], names=["gram", "n"])

    return own_columns(documents, "text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of one order from its counts of counts (Chen & Goodman 1998)."""
    row = counts.agg(*[F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.05, top)) for d, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95)))


class Model:
    """Tables by order, from 1: the probability of every seen gram (gram, p) and the share that every seen context
    leaves to the lower order (context, rest); and the probability of a symbol never seen."""

    def __init__(self, grams: list[DataFrame], contexts: list[DataFrame], unseen: float):
        self.grams, self.contexts, self.unseen = grams, contexts, unseen

    def probability(self, asked: DataFrame) -> DataFrame:
        """The rows asked, one a gram, and its p: that of its longest seen end, times what the contexts before left."""
        found = asked
        for k in range(ORDER, 0, -1):
            end = F.substring("gram", ORDER - k + 1, k)
            found = found.join(self.grams[k - 1].select(F.col("gram").alias("_key"), F.col("p").alias(f"p{k}")), end == F.col("_key"), "left").drop("_key")
            if k > 1:
                before = F.substring("gram", ORDER - k + 1, k - 1)
                found = found.join(self.contexts[k - 1].select(F.col("context").alias("_key"), F.col("rest").alias(f"rest{k}")), before == F.col("_key"), "left").drop("_key")
        p: Column = F.coalesce(F.col("p1"), F.lit(self.unseen))
        for k in range(2, ORDER + 1):
            p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"rest{k}"), F.lit(1.0)) * p)
        return found.select(*asked.columns, p.alias("p"))


def learn(documents: DataFrame) -> Model:
    """The model of all texts given. Null and empty texts add nothing; without any text all symbols are unseen."""
    counts = stored(gram_counts(documents), "gram-counts")
    by_order = [counts]
    for order in range(ORDER - 1, 0, -1):  # how many symbols come before each shorter gram
        counts = stored(counts.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")), f"gram-counts-{order}")
        by_order.insert(0, counts)
    unseen = 1.0 / (by_order[0].count() + 1)
    grams: list[DataFrame] = []
    contexts: list[DataFrame] = []
    for order, counts in enumerate(by_order, 1):
        one, two, many = _discounts(counts)
        discount = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(many)
        marked = counts.withColumns({"context": F.substring("gram", 1, order - 1) if order > 1 else F.lit(""), "discount": discount})
        totals = stored(marked.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("rest")), f"contexts-{order}")
        own = marked.join(totals, "context").select("gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("own"), "rest")
        if order == 1:
            found = own.select("gram", (F.col("own") + F.col("rest") * unseen).alias("p"))
            first = totals.first()
            unseen = unseen * (first["rest"] if first else 1.0)  # what is left to symbols never seen
        else:  # the end of a seen gram is a seen gram
            lower = grams[-1].select(F.col("gram").alias("end"), F.col("p").alias("lower"))
            found = own.withColumn("end", F.substring("gram", 2, order - 1)).join(lower, "end").select("gram", (F.col("own") + F.col("rest") * F.col("lower")).alias("p"))
        grams.append(stored(found, f"grams-{order}"))
        contexts.append(totals.select("context", "rest"))
    return Model(grams, contexts, float(unseen))


# --- documents in chunks ----------------------------------------------------------------------------------------------


def perplexity(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``keep``, n_symbols and perplexity (a symbol) of every row; null for a text without symbols.

    The rows are scanned twice in one plan, once for what the chunks ask and once for what they hold; should the two
    scans ever deal them differently, a gram is left without an answer, and that raises.
    """
    rows = own_columns(documents, *keep, "text").toDF(*[f"_own_{i}" for i in range(len(keep))], "_text")
    rows = rows.select(F.spark_partition_id().alias("_partition"), *rows.columns)
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_symbols long", "perplexity double"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in text_blocks(batches, chunk_bytes):
            for symbols, _ in _counted(b.column(b.num_columns - 1) for b in held):
                for lo in range(0, len(symbols), 100_000):
                    part = _strings(symbols[lo : lo + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), part], names=["chunk", "gram"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for number, held in text_blocks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
                for b in held:
                    writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "data"])

    asked = rows.mapInArrow(ask, "chunk long, gram string").repartition("gram")
    known = model.probability(asked.select("gram").distinct())
    answers = asked.join(known, "gram").select("chunk", F.lit(0).alias("part"), "gram", F.log("p").cast("float").alias("log_p"), F.lit(None).cast("binary").alias("data"))
    chunks = rows.mapInArrow(hold, "chunk long, data binary").select("chunk", F.lit(1).alias("part"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("float").alias("log_p"), "data")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        keys: list[np.ndarray] = []
        logs: list[np.ndarray] = []
        table_: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            numbers, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if numbers[a] != chunk:
                    chunk, keys, logs, table_ = numbers[a], [], [], None
                if parts[a] == 0:
                    data, _ = column_bytes(batch.column(2).slice(a, b - a))
                    symbols = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
                    keys.append((symbols.astype(np.uint64) * FACTORS[:ORDER]).sum(axis=1, dtype=np.uint64))
                    logs.append(batch.column(3).slice(a, b - a).to_numpy())
                    continue
                if table_ is None:
                    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                    order = np.argsort(every)
                    table_ = every[order], (np.concatenate(logs) if logs else np.empty(0, np.float32))[order]
                    keys, logs = [], []
                for data in batch.column(4).slice(a, b - a):
                    for held in pa.ipc.open_stream(data.as_buffer()):
                        yield from _scored(held, *table_)

    def _scored(held: pa.RecordBatch, keys: np.ndarray, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
        text = held.column(held.num_columns - 1)
        for at, to in steps(text, HASH_STEP_BYTES):
            gram, lengths = grams_of(text.slice(at, to - at))
            place = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
            if len(gram) and not (len(keys) and (keys[place] == gram).all()):
                raise RuntimeError("a gram of this chunk has no answer: the documents were dealt differently in the two scans")
            sums = np.concatenate(([0.0], np.cumsum(logs[place], dtype=np.float64))) if len(gram) else np.zeros(1)
            ends = np.cumsum(lengths)
            with np.errstate(invalid="ignore"):
                found = np.exp(-(sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1))
            own = [held.column(1 + i).slice(at, to - at) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lengths, pa.int64()), pa.array(found, mask=lengths == 0)], names=[*keep, "n_symbols", "perplexity"])

    met = answers.unionByName(chunks).repartition("chunk").sortWithinPartitions("chunk", "part")
    return met.mapInArrow(score, schema)


# --- verdicts ---------------------------------------------------------------------------------------------------------


def _marks(name: str) -> list[Column]:
    """The three bits of the filter that an id sets."""
    mask = (1 << FILTER_BITS) - 1
    one, two = F.xxhash64(F.col(name)), F.xxhash64(F.col(name), F.lit("second"))
    return [one.bitwiseAND(mask), F.shiftrightunsigned(one, 32).bitwiseAND(mask), two.bitwiseAND(mask)]


def labelled(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id (a string here) is in ``ids``.

    A Bloom filter of at most 2**FILTER_BITS bits, which is all that goes to the driver and the tasks, keeps nearly all
    other texts from being moved to the join.
    """
    words = ids.select(F.explode(F.array(*_marks("doc_id"))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = documents.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        found = np.ones(len(a), np.int64)
        for bit in (a.to_numpy(), b.to_numpy(), c.to_numpy()):
            found &= sent.value[bit >> 6] >> (bit & 63)
        return pd.Series((found & 1) == 1)

    return documents.where(maybe(*_marks("doc_id"))).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.998) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept of every row.

    Trusted is what ``labels`` gives quality 1; one in HELD_OUT of it is not learnt from. A document goes if its
    perplexity is over the ``quantile`` of the held-out documents of its language (of all, where there are under
    LEAST_TRUSTED of them), or if it has no symbol at all; a tie stays. Texts of under LEAST_SYMBOLS symbols have no
    verdict but that. Null text counts as empty, null language is a language of its own, repeated rows are judged one
    by one, very long texts are a chunk of their own. Without trusted documents nothing else goes.
    """
    as_text = F.col("doc_id").cast("string")  # the two tables' ids may be of different types
    trusted = own_columns(labels, "doc_id", "quality").where("doc_id is not null").groupBy(as_text.alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    unseen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(HELD_OUT)) == 0
    documents = own_columns(documents, "doc_id", "lang", "text")
    model = learn(labelled(documents.withColumn("doc_id", as_text), trusted.where(~unseen)))
    scored = stored(perplexity(documents, model, ("doc_id", "lang")), "perplexities")
    known = scored.withColumn("doc_id", as_text).join(trusted.where(unseen), "doc_id", "left_semi").where(F.col("n_symbols") >= LEAST_SYMBOLS)
    bar = F.percentile_approx("perplexity", quantile, 100_000)
    bars = known.groupBy("lang").agg(F.count("*").alias("n"), bar.alias("own")).where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("_lang"), "own")
    every = known.agg(bar.alias("all")).first()["all"]
    judged = scored.join(F.broadcast(bars), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # one row a language
    limit = F.coalesce(F.col("own"), F.lit(every).cast("double"))
    kept = (F.col("n_symbols") > 0) & ((F.col("n_symbols") < LEAST_SYMBOLS) | limit.isNull() | (F.col("perplexity") <= limit))
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every row of ``documents``; trusted are the rows that ``labels`` gives quality 1."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
