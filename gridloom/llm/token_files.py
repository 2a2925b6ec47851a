"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment is one binary value: the documents' ids and lengths, then blocks of up to BLOCK ids. A block carries its
distinct ids with their counts, a checksum, and range-coded indices into them, one step an id. The coder mixes three
predictions: the block's counts (order 0), and the ids that last followed the same id (order 1) and the same two ids
(order 2), each weighted by how often it has been right in this block at this confidence. Every block starts from
nought, so a damaged block harms no other.

All blocks of a segment are coded side by side: each numpy operation handles the same place of every block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.chunk_table import binary_rows, word_ids
from gridloom.llm.common import own_columns, stored, table
from gridloom.llm.packing import END_ID, default_tokenizer
from gridloom.llm.text_arrays import steps

MAGIC = b"GLT2"
BLOCK = 4096
#: ids of one segment; its blocks are coded side by side.
SEGMENT_IDS = 8_000_000
#: Text that is tokenized at once: the more, the fewer words are looked up again.
TEXT_BYTES = 6_000_000

#: Slots of a block's order-0 counts, and of those times the units of weight that the three predictions share.
SLOTS = 4096
UNIT_BITS = 6
UNITS = 1 << UNIT_BITS
TOTAL_BITS = 12 + UNIT_BITS
TOP, LOWEST, SHIFT = 48, 1 << 24, 24
DIGIT = (1 << SHIFT) - 1
CONTEXTS_2 = 2048
#: A context's guess, by its first slot, and its confidence (0 to 3) share a 16-bit number, guess * 4 + confidence.
#: At first each guess is the last slot, with a chance of nought.
EMPTY = (SLOTS - 1) * 4
#: How often guesses of a confidence are right, in 4096ths, before a block has shown it.
FIRST_CHANCE = np.array([0, 300, 900, 1800], np.int16)
RATE_BITS = 4
#: Places of the blocks whose shares the encoder mixes at once.
SPAN = 32


class _Mixer:
    """Predictions of all blocks: order-0 counts, guesses of both contexts, and how far to trust them. Symbols go by
    their first slot, contexts by index.

    The contexts' arrays are handled as two rows of one, order 1 and order 2. A symbol's share of the 2**18 mixed counts
    is its order-0 count times the units that the guesses leave, and the units of each guess that names it. Order 2 takes
    the units that its chance to be right is worth, order 1 as much of the rest; so at least one unit is left to order 0.
    """

    def __init__(self, counts: list[np.ndarray]):
        lanes = len(counts)
        width = self.width = max(map(len, counts))
        self.sizes = np.zeros((lanes, width), np.int32)
        for i, c in enumerate(counts):
            self.sizes[i, : len(c)] = slots_of(c)
        self.starts = np.cumsum(self.sizes, axis=1, dtype=np.int32) - self.sizes
        #: where an index's slots begin, and how many they are
        self.shares = (self.starts << 13 | self.sizes).reshape(-1)
        lane = np.arange(lanes)
        self.base = lane * width
        self.home = np.stack([lane * width, lanes * width + lane * CONTEXTS_2])
        self.by_lane = np.stack([lane * 8, lane * 8 + 4])
        self.memory = np.full(lanes * (width + CONTEXTS_2), EMPTY, np.int16)
        self.chances = np.tile(FIRST_CHANCE, 2 * lanes)  # by lane, context and confidence
        self.place = np.empty((2, lanes), np.int64)

    @staticmethod
    def second(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The order-2 context of two ids."""
        return (two * 773 ^ one) & (CONTEXTS_2 - 1)

    def look(self, at: np.ndarray, held: np.ndarray, guess: np.ndarray, chance: np.ndarray) -> None:
        """What the contexts at the given places hold: their guesses and the chance of each to be right."""
        self.at, self.held, self.chance = at, held, chance
        self.memory.take(at, out=held, mode="clip")
        np.right_shift(held, 2, out=guess)
        self.sure = held & 3
        np.add(self.by_lane, self.sure, out=self.place)
        self.chances.take(self.place, out=chance, mode="clip")

    def learn(self, symbol: np.ndarray, same: np.ndarray) -> None:
        """A right guess gains confidence, a wrong one loses it and then its place."""
        hit = same.view(np.int8).astype(np.int16)
        step = hit << 12
        step -= self.chance
        step >>= RATE_BITS
        step += self.chance
        self.chances[self.place] = step
        kept = -(same | (self.sure > 1)).view(np.int8).astype(np.int16)  # all bits or none
        hit += hit
        hit -= 1
        hit += self.held
        np.minimum(hit, self.held | 3, out=hit)
        other = (symbol << 2) + 1
        hit ^= other
        hit &= kept
        hit ^= other
        self.memory[self.at] = hit


def _weights(chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts that the guesses of order 1 and 2 add (the first axis but one), and the units left to order 0."""
    units = chance >> (12 - UNIT_BITS)
    one, two = units[..., 0, :], units[..., 1, :]
    left = UNITS - two
    one *= left
    one >>= UNIT_BITS
    left -= one
    bonus = units.astype(np.int32)
    bonus <<= 12
    return bonus, left.astype(np.int32)


def slots_of(counts: np.ndarray) -> np.ndarray:
    """Slots of each symbol: counts that fill a block are taken as they are, others are scaled to SLOTS."""
    n = int(counts.sum())
    if n == SLOTS:
        return counts
    out = counts * SLOTS // n
    out[np.argmax(counts)] += SLOTS - int(out.sum())
    return out


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose in memory of its own, some rows at a time, as single columns are slow to reach."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for i in range(0, len(rows), 32):
        out[:, i : i + 32] = rows[i : i + 32].T
    return out


def code(indices: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
    """Range-coded bytes of each block of indices, given how often each index comes in it. No block is longer than the
    first; what a shorter one lacks is coded as index 0."""
    lanes, most = len(indices), len(indices[0])
    rows = np.zeros((lanes, most + 2), np.int16)  # an index has twelve bits; two of 0 come before each block
    for i, x in enumerate(indices):
        rows[i, 2 : 2 + len(x)] = x
    grid = _turned(rows)
    mixer = _Mixer(counts)
    low, range_ = np.zeros(lanes, np.int64), np.full(lanes, 1 << TOP, np.int64)
    room = most // 2 + 16
    out = np.zeros(lanes * room, np.int32)
    used = np.arange(lanes) * room
    first = used.copy()
    guess, chance = (np.empty((SPAN, 2, lanes), np.int16) for _ in range(2))
    held = np.empty((2, lanes), np.int16)
    same = np.empty((SPAN, 2, lanes), bool)

    def shift(at: np.ndarray) -> None:
        now = low[at]
        place = used[at]
        out[place] = now >> SHIFT  # may exceed a digit by a carry, which is settled at the end
        low[at] = (now & DIGIT) << SHIFT
        range_[at] <<= SHIFT
        used[at] = place + 1

    for begin in range(0, most, SPAN):
        rows = grid[begin : begin + SPAN + 2].astype(np.int64)
        share = mixer.shares.take(mixer.base + rows[2:], mode="clip")
        symbols = (share >> 13).astype(np.int16)
        n = len(symbols)
        at = np.empty((n, 2, lanes), np.int64)
        at[:, 0] = rows[1:-1]
        at[:, 1] = mixer.second(rows[1:-1], rows[:-2])
        at += mixer.home
        for k in range(n):
            mixer.look(at[k], held, guess[k], chance[k])
            np.equal(guess[k], symbols[k], out=same[k])
            mixer.learn(symbols[k], same[k])
        bonus, left = _weights(chance[:n])
        below = symbols * left
        own = (share & 0x1FFF) * left
        less = bonus * (guess[:n] < symbols[:, None])
        bonus *= same[:n]
        below += less[:, 0]
        below += less[:, 1]
        own += bonus[:, 0]
        own += bonus[:, 1]
        if int((used - first).max()) + SPAN + 8 > room:
            wider = np.zeros((lanes, 2 * room), np.int32)
            wider[:, :room] = out.reshape(lanes, room)
            used += np.arange(lanes) * room
            room *= 2
            out, first = wider.reshape(-1), np.arange(lanes) * room
        for k in range(n):
            part = range_ >> TOTAL_BITS
            low += part * below[k]
            np.multiply(part, own[k], out=range_)
            small = np.flatnonzero(range_ < LOWEST)  # one digit is enough: a range is never below 2**6
            if len(small):
                shift(small)
    for _ in range(2):
        shift(np.arange(lanes))
    out = out.reshape(lanes, room)
    while True:
        carry = out >> SHIFT
        if not carry.any():
            break
        out &= DIGIT
        out[:, :-1] += carry[:, 1:]
    used -= first
    return [np.ascontiguousarray(out[i, : used[i]].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes() for i in range(lanes)]


def decode(coded: list[bytes], lengths: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
    """The indices of each block; no block is longer than the first."""
    lanes, most = len(coded), int(lengths[0])
    room = max(map(len, coded)) // 3 + 2
    digits = np.zeros((lanes, room, 4), np.uint8)
    for i, c in enumerate(coded):
        n = len(c) // 3
        digits[i, :n, :3] = np.frombuffer(c, np.uint8, count=3 * n).reshape(-1, 3)
    digits = digits.view("<u4").reshape(-1)
    place = np.arange(lanes) * room
    window = digits[place].astype(np.int64) << SHIFT | digits[place + 1]
    place += 2
    mixer = _Mixer(counts)
    slots = np.empty((lanes, SLOTS), np.int32)  # the first slot and the index of each slot's symbol
    names = np.arange(mixer.width, dtype=np.int32)
    for i, own in enumerate(mixer.sizes):
        slots[i] = np.repeat(mixer.starts[i] << 12 | names, own)
    sizes = mixer.sizes.reshape(-1)
    slots = slots.reshape(-1)
    slot_base = np.arange(lanes) * SLOTS
    grid = np.zeros((most, lanes), np.int16)
    range_ = np.full(lanes, 1 << TOP, np.int64)
    one = two = np.zeros(lanes, np.int64)
    at = np.empty((2, lanes), np.int64)
    held, guess, chance = (np.empty((2, lanes), np.int16) for _ in range(3))
    for t in range(most):
        at[0], at[1] = one, mixer.second(one, two)
        at += mixer.home
        mixer.look(at, held, guess, chance)
        bonus, left = _weights(chance)
        part = range_ >> TOTAL_BITS
        # quotients below 2**18 of numbers below 2**48: their whole part is exact
        value = np.minimum(window / part, (1 << TOTAL_BITS) - 1).astype(np.int32)
        # take the guesses' counts out, the lower first
        start = guess * left
        lower = np.where(start[0] > start[1], bonus[1], bonus[0])
        both = bonus[0] + bonus[1]
        over = value - np.minimum(start[0], start[1])
        value -= np.minimum(np.maximum(over, 0, out=over), lower, out=over)
        over = value - np.maximum(start[0], start[1])
        both -= lower
        value -= np.minimum(np.maximum(over, 0, out=over), both, out=over)
        both = slots.take((value / left).astype(np.int64) + slot_base, mode="clip")
        symbol = (both >> 12).astype(np.int16)
        both &= SLOTS - 1
        grid[t] = both
        index = both.astype(np.int64)
        below = symbol * left
        own = sizes.take(mixer.base + index, mode="clip")
        own *= left
        less = bonus * (guess < symbol)
        same = guess == symbol
        bonus *= same
        below += less[0]
        below += less[1]
        own += bonus[0]
        own += bonus[1]
        window -= part * below
        np.multiply(part, own, out=range_)
        mixer.learn(symbol, same)
        small = np.flatnonzero(range_ < LOWEST)
        if len(small):
            now = place[small]
            window[small] = window[small] << SHIFT | digits.take(now, mode="clip")
            range_[small] <<= SHIFT
            place[small] = now + 1
        one, two = index, one
    return [row[:n] for row, n in zip(_turned(grid), lengths.tolist())]


# --- segments -------------------------------------------------------------------------------------------------------


def _numbers(values: np.ndarray) -> bytes:
    """Unsigned integers in seven-bit groups, least first, the upper bit set on all but a number's last byte."""
    values = np.asarray(values, np.uint64)
    groups = np.maximum(1, -(-(np.frexp(values.astype(np.float64))[1]) // 7))
    total = int(groups.sum())
    of = np.repeat(np.arange(len(values)), groups)
    nth = np.arange(total) - np.repeat(np.cumsum(groups) - groups, groups)
    out = ((values[of] >> (7 * nth).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[nth < groups[of] - 1] |= 128
    return out.tobytes()


def _read_numbers(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    if not n:
        return np.empty(0, np.uint64), at
    raw = np.frombuffer(data, np.uint8, offset=at, count=min(len(data) - at, 10 * n))
    ends = np.flatnonzero(raw < 128)[:n]
    if len(ends) < n:
        raise ValueError("segment cut short")
    starts = np.concatenate(([0], ends[:-1] + 1))
    nth = np.arange(int(ends[-1]) + 1) - np.repeat(starts, ends - starts + 1)
    parts = (raw[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * nth).astype(np.uint64)
    return np.add.reduceat(parts, starts), at + int(ends[-1]) + 1


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of some bytes: all lowest bytes, then all second ones, and so on."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _of_planes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)


def _letters(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its distinct ids, ascending; the index of each of its ids among them; how often each comes."""
    top = int(ids.max()) + 1
    rank = np.empty(top, np.int16) if top <= 1 << 17 else None
    seen = np.zeros(len(rank) if rank is not None else 0, bool)
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK].astype(np.int64)
        if rank is None:
            alphabet, index = np.unique(block, return_inverse=True)
        else:
            seen[block] = True
            alphabet = np.flatnonzero(seen)
            seen[alphabet] = False
            rank[alphabet] = np.arange(len(alphabet))
            index = rank[block]
        yield alphabet, index.astype(np.int16), np.bincount(index, minlength=len(alphabet))


def write_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One segment: documents' ids (zigzag differences; null is flagged) and lengths, then the blocks."""
    known = np.array([d is not None for d in doc_ids], bool)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    steps_ = np.diff(keys, prepend=0)  # wraps like the addition that undoes it
    zigzag = (steps_ << 1) ^ (steps_ >> 63)
    head = _numbers(lengths) + np.packbits(known).tobytes() + zigzag.astype("<i8").tobytes()
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    parts = [MAGIC, struct.pack("<QQQQ", len(doc_ids), len(ids), len(blocks), len(head)), struct.pack("<I", zlib.crc32(head)), head]
    if blocks:
        found = list(_letters(ids))  # only the last block can be shorter than the others
        coded = code([f[1] for f in found], [f[2] for f in found])
        for b, (alphabet, _, counts), c in zip(blocks, found, coded):
            pack = zlib.compressobj(1, zlib.DEFLATED, 12, 5, zlib.Z_RLE)
            letters = pack.compress(_planes(np.diff(alphabet, prepend=0), 4) + _planes(counts, 2)) + pack.flush()
            parts += [struct.pack("<IIIII", len(b), len(alphabet), len(letters), len(c), zlib.crc32(np.ascontiguousarray(b, "<u4").tobytes())), letters, c]
    return b"".join(parts)


def read_segment(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, documents' ids and lengths. Raises ValueError where a checksum doesn't hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_blocks, n_head, check = struct.unpack_from("<QQQQI", data, 4)
    at = 40
    if zlib.crc32(data[at : at + n_head]) != check:
        raise ValueError("the documents' index is damaged")
    lengths, place = _read_numbers(data, n_docs, at)
    known = np.unpackbits(np.frombuffer(data, np.uint8, offset=place, count=-(-n_docs // 8)), count=n_docs).astype(bool)
    zigzag = np.frombuffer(data, "<i8", offset=place + -(-n_docs // 8), count=n_docs).view(np.uint64)
    steps_ = (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
    doc_ids = [k if ok else None for k, ok in zip(np.cumsum(steps_).tolist(), known.tolist())]
    at += n_head
    sizes, checks, alphabets, counts, coded = [], [], [], [], []
    for _ in range(n_blocks):
        n, n_letters, letter_bytes, code_bytes, crc = struct.unpack_from("<IIIII", data, at)
        at += 20
        try:
            letters = zlib.decompress(data[at : at + letter_bytes])
        except zlib.error as e:
            raise ValueError("a block's alphabet is damaged") from e
        if len(letters) != 6 * n_letters:
            raise ValueError("a block's alphabet is damaged")
        alphabets.append(np.cumsum(_of_planes(letters[: 4 * n_letters], 4)).astype(np.uint32))
        counts.append(_of_planes(letters[4 * n_letters :], 2))
        if not 0 < n <= BLOCK or counts[-1].sum() != n or n_letters and counts[-1].min() < 1:
            raise ValueError("a block's counts are damaged")
        at += letter_bytes
        coded.append(data[at : at + code_bytes])
        at += code_bytes
        sizes.append(n)
        checks.append(crc)
    found = decode(coded, np.array(sizes, np.int64), counts) if n_blocks else []
    blocks = [a[i] for a, i in zip(alphabets, found)]
    for k, (b, crc) in enumerate(zip(blocks, checks)):
        if zlib.crc32(np.ascontiguousarray(b, "<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    ids = np.concatenate(blocks) if blocks else np.empty(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("segment cut short")
    return ids, doc_ids, lengths.astype(np.int64)


# --- files ----------------------------------------------------------------------------------------------------------


def segments(documents: DataFrame, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """(part, segment, n_ids, data) over all rows in ascending doc_id order, null first, then by text: parts by
    ranges of doc_id, segments in order within a part. Null text counts as empty."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = own_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = number = 0

        def close() -> pa.RecordBatch:
            data = write_segment(np.concatenate(ids), docs, np.concatenate(lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["part", "segment", "n_ids", "data"])

        for batch in batches:
            for lo, hi in steps(batch.column(1), TEXT_BYTES):
                flat, bounds = word_ids(batch.column(1).slice(lo, hi - lo), tokenizer, end_id)
                docs += batch.column(0).slice(lo, hi - lo).to_pylist()
                ids.append(flat)
                lengths.append(np.diff(bounds))
                held += len(flat)
                if held >= segment_ids:
                    yield close()
                    docs, ids, lengths, held, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return ordered.mapInArrow(run, "part int, segment int, n_ids long, data binary")


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per range of doc_id
    bases, at = [], 0
    for row in sums:
        bases.append((row["part"], at))
        at += row["n"]
    spark = files.sparkSession
    before = spark.createDataFrame(bases, "part int, base long") if bases else spark.createDataFrame([], "part int, base long")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "segment", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    places = places.join(F.broadcast(before), "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("first"))
    placed = files.select("part", "segment", "data").join(places, ["part", "segment"]).select("first", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, docs, lengths = read_segment(data.as_py())
                ends = np.cumsum(lengths)
                for lo in range(0, len(docs), 2000):
                    hi = min(lo + 2000, len(docs))
                    a, b = int(ends[lo] - lengths[lo]), int(ends[hi - 1])
                    bounds = np.concatenate(([0], ends[lo:hi] - a))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(first + ends[lo:hi] - lengths[lo:hi]), binary_rows(ids[a:b], bounds)], names=["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(segments(table(spark, sf_dir, "documents"), default_tokenizer()), "token-files")
    found = documents_of(files)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
