"""Quality rules: an isolation forest over rule statistics.

Rule statistics of a whole text are counted on flat word arrays. A document fails the base rules if it has under
50 words or if over half of its words repeat; of the rest, an isolation forest finds the anomalous ones: short
average paths over random splits mark a row as easy to isolate. The forest is grown on the statistics as they are, each
tree on its few rows out of all labelled ones, good and bad alike; the score from which a document is rejected comes
from every labelled row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, sealed, stored, table, unsealed
from gridloom.llm.text_arrays import IS_SEPARATOR, steps, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: First bytes of letters; all beyond ASCII counts as one.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[0xC0:] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on: square roots of shares, so that lengths and languages spread alike. No limits are set by hand.
STATISTICS = ("symbols_a_word", "marks_a_word", "duplicate_lines", "repeated_words", "capital_words", "lone_marks", "most_frequent", "word_length", "other_than_letters")



def _counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each document of one step."""
    w = words_of(column)
    n, of = w.n_docs, w.doc
    data = w.data

    def in_doc(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), w.offsets)).astype(np.int64)

    lead = (data & 0xC0) != 0x80
    blank = IS_SEPARATOR[data]
    out = {"n_words": w.per_doc(), "word_chars": in_doc(lead & ~blank), "letters": in_doc(IS_LETTER[data])}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = in_doc(symbol[data])
    mark = np.zeros(256, bool)
    mark[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    mark[list(b".,;:'\"-()=+@/_?")] = False  # usual in prose, addresses and assignments
    out["marks"] = in_doc(mark[data])

    ids = w.values().dictionary_encode()
    word = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(ids.dictionary))
    out["n_repeat_words"] = _repeated(word, of, size, n)

    # the most frequent word's share; equal words lie together once sorted by document and word
    both = np.sort(of * size + word)
    if len(both):
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        times = np.diff(np.append(first, len(both)))
        most = np.zeros(n, np.int64)
        np.maximum.at(most, both[first] // size, times)
        out["most"] = most
    else:
        out["most"] = np.zeros(n, np.int64)

    alpha_upper = np.zeros(256, bool)
    alpha_upper[65:91] = True
    lower = np.zeros(256, bool)
    lower[97:123] = True
    if len(word):
        sums = lambda mask: np.add.reduceat(np.append(mask.astype(np.int64), 0), np.stack([w.starts, w.ends], 1).ravel())[::2]
        ups, downs, marks = sums(alpha_upper[data]), sums(lower[data]), sums(mark[data])
        out["capitals"] = w.per_doc((ups >= 2) & (downs == 0))
        out["lone"] = w.per_doc(marks == (w.ends - w.starts))
    else:
        out["capitals"] = out["lone"] = np.zeros(n, np.int64)
    out |= _duplicate_lines(data, w.offsets, blank)
    return out


def _repeated(word: np.ndarray, doc: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words of each document that lie in a 3-word window which its text has twice or more."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    pair = word[:-1] * size + word[1:]
    _, pair = np.unique(pair, return_inverse=True)  # keeps the next product within 64 bits
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    window = pair[whole] * size + word[whole + 2]
    _, window = np.unique(window, return_inverse=True)
    key = doc[whole] * (int(window.max(initial=0)) + 1) + window
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(word), bool)
    at = whole[twice]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n).astype(np.int64)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line of the same document."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    doc = np.searchsorted(offsets[1:], edges, side="right") if n else np.empty(0, np.int64)
    # a line that starts where a document ends belongs to that document: it has no byte and so no word
    filled = np.concatenate(([0], np.cumsum(~blank)))
    keep = filled[ends] > filled[edges]
    edges, ends, doc = edges[keep], ends[keep], doc[keep]
    lines = np.bincount(doc, minlength=n).astype(np.int64)
    if not len(edges):
        return {"lines": lines, "n_dup_lines": np.zeros(n, np.int64)}
    bounds = np.stack([edges, ends], 1).ravel().astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    ids = both.take(pa.array(np.arange(0, len(bounds) - 1, 2, dtype=np.int32))).dictionary_encode()
    key = doc * max(1, len(ids.dictionary)) + ids.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(key, return_index=True)
    fresh = np.bincount(doc[first], minlength=n)
    return {"lines": lines, "n_dup_lines": lines - fresh}


def _statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    words, lines, chars = (np.maximum(c[k], 1) for k in ("n_words", "lines", "word_chars"))
    per_word = (c[k] / words for k in ("n_symbols", "marks"))
    shares = (*per_word, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["capitals"] / words, c["lone"] / words, c["most"] / words, c["word_chars"] / words / 10, 1 - c["letters"] / chars)
    return np.sqrt(np.maximum(np.stack(shares, axis=1), 0))


# --- the forest ---------------------------------------------------------------------------------------------------


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows (Liu, Ting & Zhou 2008)."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays of a fixed depth: small enough to travel in the closure of a task."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    sample: int = 64
    threshold: float = 1.1

    @classmethod
    def grow(cls, rows: np.ndarray, n_trees: int = 200, sample: int = 64, seed: int = 7) -> Forest:
        """Each tree splits ``sample`` of the rows on a random column with spread, at a random place within it. Rows are
        dealt to the trees without repeats, or each tree draws its own where they don't suffice."""
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        forest = cls([], max(2, size))
        if not size:
            return forest
        depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        dealt = rng.permutation(len(rows))
        for tree in range(n_trees):
            own = dealt[tree * size : (tree + 1) * size] if len(rows) >= n_trees * size else rng.choice(len(rows), size, replace=False)
            n_nodes = 2 ** (depth + 1) - 1
            column, cut, leaf = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
            todo = [(0, rows[own], 0)]
            while todo:
                node, inside, level = todo.pop()
                spread = np.flatnonzero(inside.max(0) > inside.min(0)) if len(inside) > 1 else ()
                if level == depth or not len(spread):
                    leaf[node] = level + _average_path(len(inside))
                    continue
                pick = int(rng.choice(spread))
                low, high = inside[:, pick].min(), inside[:, pick].max()
                at = high - rng.random() * (high - low)  # never the least value, so that no side is empty
                if at <= low:
                    at = high
                column[node], cut[node] = pick, at
                left = inside[:, pick] < at
                todo += [(2 * node + 1, inside[left], level + 1), (2 * node + 2, inside[~left], level + 1)]
            forest.trees.append((column, cut, leaf))
        return forest

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that few splits isolate."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, cut, leaf in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                pick = column[node]
                moving = pick >= 0
                if not moving.any():
                    break
                right = rows[every, np.maximum(pick, 0)] >= cut[node]
                node = np.where(moving, 2 * node + 1 + right, node)
            total += leaf[node]
        return 2.0 ** -(total / len(self.trees) / max(float(_average_path(self.sample)), 1e-9))

    def calibrate(self, scores: np.ndarray, good: np.ndarray, lost: float) -> None:
        """Reject from the score that finds the most bad rows while at most ``lost`` of the good ones go."""
        if not good.any():
            return
        kept = np.sort(scores[good])
        allowed = int(np.floor(lost * len(kept)))
        floor = kept[len(kept) - 1 - allowed]
        if not (~good).any():
            self.threshold = float(floor) + 0.05
            return
        above = np.sort(scores[~good & (scores > floor)])
        # half way to the nearest bad row above the good ones, so that neither side is on the edge
        self.threshold = float((floor + above[0]) / 2) if len(above) else float(floor) + 0.05

    def calibrate_on(self, scores: DataFrame, lost: float) -> Forest:
        """``calibrate`` on a table (good, score) of any size; only two scores come to the driver."""
        n_good = scores.where("good").count()
        if not n_good:
            return self
        allowed = int(np.floor(lost * n_good))
        floor = scores.where("good").orderBy(F.desc("score")).limit(allowed + 1).agg(F.min("score")).first()[0]
        above = scores.where(~F.col("good") & (F.col("score") > floor)).agg(F.min("score")).first()[0]
        # half way to the nearest bad row above the good ones, so that neither side is on the edge
        self.threshold = float(floor) + 0.05 if above is None else float((floor + above) / 2)
        return self


def _measured(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, dict, np.ndarray]]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for at, to in steps(text):
            counts = _counts(text.slice(at, to - at))
            yield batch.slice(at, to - at).select(list(extra)), counts, _statistics(counts)


def learn(documents: DataFrame, labels: DataFrame, n_trees: int = 200, sample: int = 64, lost: float = 0.002, seed: int = 7) -> Forest:
    """Grow a forest from all labelled rows and calibrate it on all of them.

    An isolation forest grows each tree on few rows, here ``sample``: they are drawn by a hash from all labelled rows,
    and each tree has rows of its own as long as they last. The threshold is set on every labelled row, by its score.

    Rows with a null id or label, or without a document, aren't used, nor those that fail the base rules. Of labels
    that an id has more than once, the best counts; documents that share an id all count. Without labelled rows nothing
    is anomalous.
    """
    as_text = F.col("doc_id").cast("string")  # the two tables' ids may be of different types
    marked = own_columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    marked = marked.groupBy(as_text.alias("doc_id")).agg(F.max("quality").alias("quality"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, stats in _measured(batches, ("doc_id",)):
            cols = {"doc_id": pc.cast(ids.column(0), pa.string())} | {k: pa.array(stats[:, i]) for i, k in enumerate(STATISTICS)}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(~_fails(counts)))

    schema = "doc_id string, " + ", ".join(f"{k} double" for k in STATISTICS)
    # statistics meet labels, not texts: a row of numbers moves
    own = own_columns(documents, "doc_id", "text").where("doc_id is not null").withColumn("doc_id", as_text)
    rows = stored(own.mapInArrow(measure, schema).join(marked, "doc_id"), "labelled-statistics")
    drawn = rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), *STATISTICS).limit(n_trees * sample)  # the trees' own rows
    forest = Forest.grow(drawn.select(*STATISTICS).toPandas().to_numpy(float), n_trees, sample, seed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.stack([batch.column(i + 1).to_numpy() for i in range(len(STATISTICS))], axis=1)
            yield pa.RecordBatch.from_arrays([pc.equal(batch.column(0), 1), pa.array(forest.score(stats))], names=["good", "score"])

    marks = stored(rows.select(F.col("quality").cast("int"), *STATISTICS).mapInArrow(scored, "good boolean, score double"), "labelled-scores")
    return forest.calibrate_on(marks, lost)


def _fails(c: dict[str, np.ndarray]) -> np.ndarray:
    """Which documents fail the base rules."""
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def judge(documents: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and verdict of every document, after the columns named in ``keep``.

    Null text counts as empty: no word, so it fails the base rules. Repeated rows are judged one by one, very long
    texts in whole, as a step of their own. A score equal to the threshold is kept.
    """
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{k} long" for k in BASE] + ["base_failed boolean", "anomaly double", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, c, stats in _measured(batches, keep):
            failed = _fails(c)
            score = forest.score(stats)
            cols = [own.column(i) for i in range(own.num_columns)] + [pa.array(c[k], pa.int64()) for k in BASE]
            cols += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *BASE, "base_failed", "anomaly", "kept"])

    return own_columns(documents, *dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``, judged by what ``labels`` says of some of them."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, learn(documents, table(spark, sf_dir, "labels")))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules or the forest reject go. Null and empty texts are among them; rows
    without doc_id and extra columns of any name stay as they are."""
    forest = learn(docs, table(spark, sf_dir, "labels"))
    own = sealed(docs, "text")
    return unsealed(judge(own, forest, tuple(own.columns)).where("kept"), docs, "text")
