"""Packing token ids into training windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest. The rests of some hundred windows at a time form a round:
each rest starts as a partition of one filled and k - 1 empty windows; the two partitions with the largest imbalance
merge, fullest window to emptiest, until one is left, whose windows are nearly equal. Whenever a window exceeds its
capacity, the window count rises and differencing starts anew, up to MOST_RISE of the windows; what some windows then
still hold over their capacity is cut off and goes to windows with room. A round is packed where its texts are
tokenized: nothing is shuffled, and a task holds the ids of one round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.chunk_table import binary_rows, word_ids
from gridloom.llm.common import own_columns, table
from gridloom.llm.text_arrays import steps

WINDOW = 2048
ROUND_WINDOWS = 256
END_ID = 1
#: Share of a round's windows by which their count may rise (one at least) before pieces are cut: it bounds the padding.
MOST_RISE = 0.004


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size: multiway largest differencing, ties by position."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    loads: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, int, np.ndarray]] = []

    def load(node: int) -> np.ndarray:  # descending, least one nought
        if node >= n:
            return loads.pop(node)
        out = np.zeros(k, np.int64)
        out[0] = sizes[node]
        return out

    following = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = load(a) + load(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        loads[following] = both - both[-1]
        merges.append((following, a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(both[0] - both[-1]), following))
        following += 1
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for node, a, b, order in reversed(merges):
        own = places.pop(node)
        for child, slots in ((a, order), (b, k - 1 - order)):
            mine = np.empty(k, np.int64)
            mine[slots] = own
            places[child] = mine
    return np.array([places[i][0] for i in range(n)])


def fill_windows(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, from, to) over items of under ``capacity`` tokens; every token is in one of them."""
    total = sum(lengths)
    if not total:
        return []
    least = -(-total // capacity)
    for k in range(least, least + max(1, round(least * MOST_RISE)) + 1):
        places = differencing(lengths, k)
        if np.bincount(places, weights=lengths, minlength=k).max() <= capacity:
            break
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for item, window in enumerate(places):
        windows[window].append((item, 0, lengths[item]))
    over: list[tuple[int, int, int]] = []
    loads = [sum(to - at for _, at, to in w) for w in windows]
    for i, w in enumerate(windows):
        while loads[i] > capacity:
            j = max(range(len(w)), key=lambda x: w[x][2] - w[x][1])  # the longest piece bears the cut
            item, at, to = w[j]
            cut = min(loads[i] - capacity, to - at)
            over.append((item, to - cut, to))
            loads[i] -= cut
            if to - cut > at:
                w[j] = (item, at, to - cut)
            else:
                w.pop(j)
    room = [i for i in sorted(range(k), key=lambda x: loads[x]) if loads[i] < capacity]
    for item, at, to in over:
        while at < to:
            i = room[0]  # the windows have room for all tokens together
            part = min(capacity - loads[i], to - at)
            windows[i].append((item, at, at + part))
            loads[i] += part
            at += part
            if loads[i] == capacity:
                room.pop(0)
    return [w for w in windows if w]


class _Round:
    """Rests of documents until they are enough for a round of windows."""

    def __init__(self) -> None:
        self.doc: list = []
        self.start: list[int] = []
        self.doc_tokens: list[int] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, round_windows: int = ROUND_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every row, whole texts however long.

    ids are little-endian unsigned 32-bit. Null and empty texts have the end id alone. Repeated rows are packed one
    by one; their pieces look alike but for their place. sequence_id is unique, with the task's number in its upper bits.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 40
        doc_type: pa.DataType | None = None

        def rows(doc: list, start: list, ids: list[np.ndarray], doc_tokens: list, sequence: list, offset: list) -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            whole = binary_rows(flat, np.concatenate(([0], np.cumsum(lengths))))
            numbers = [pa.array(x, pa.int64()) for x in (start, lengths, doc_tokens, sequence, offset)]
            return pa.RecordBatch.from_arrays([pa.array(doc, doc_type), numbers[0], numbers[1], whole, *numbers[2:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close(r: _Round) -> pa.RecordBatch | None:
            nonlocal following
            doc, start, ids, tokens, sequence, offset = [], [], [], [], [], []
            for pieces in fill_windows([len(x) for x in r.ids], window):
                place = 0
                for item, at, to in pieces:
                    doc.append(r.doc[item])
                    start.append(r.start[item] + at)
                    ids.append(r.ids[item][at:to])
                    tokens.append(r.doc_tokens[item])
                    sequence.append(following)
                    offset.append(place)
                    place += to - at
                following += 1
            return rows(doc, start, ids, tokens, sequence, offset) if doc else None

        held = _Round()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for lo, hi in steps(batch.column(1)):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                flat, bounds = word_ids(batch.column(1).slice(lo, hi - lo), tokenizer, end_id)
                doc, start, ids, tokens, sequence = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    whole = (b - a) // window
                    for j in range(whole):
                        doc.append(docs[i])
                        start.append(j * window)
                        ids.append(flat[a + j * window : a + (j + 1) * window])
                        tokens.append(b - a)
                        sequence.append(following)
                        following += 1
                    if a + whole * window < b:
                        held.doc.append(docs[i])
                        held.start.append(whole * window)
                        held.doc_tokens.append(b - a)
                        held.ids.append(flat[a + whole * window : b].copy())
                        held.tokens += b - a - whole * window
                        if held.tokens >= round_windows * window:
                            got = close(held)
                            held = _Round()
                            if got is not None:
                                yield got
                if doc:
                    yield rows(doc, start, ids, tokens, sequence, [0] * len(doc))
        got = close(held)
        if got is not None:
            yield got

    return own_columns(documents, "doc_id", "text").mapInArrow(run, schema)


def _digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents``; null and empty texts are a piece of one end id."""
    return _digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document that is left, packed into windows."""
    return _digest(pack(docs, default_tokenizer()))
