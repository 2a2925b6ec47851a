"""SimHash near-duplicates: segment-popcount embedding, a grid join under Manhattan distance, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments embed it in {0, 1, 2}^32,
where the Manhattan distance of two fingerprints is at most their Hamming distance. The segments are dealt into g
groups. Points within Manhattan distance d differ in at most d groups, so they agree on some g - d whole groups:
the grid has a cell for every choice of g - d groups and every value of their counts, and two fingerprints that
link share a cell. Within a cell the Manhattan distance of the counts decides which pairs are compared exactly. g grows with the number of distinct fingerprints (finer
cells, more of them to a fingerprint); the result is the same for any g.

A cell gives a spanning forest of its links, not all its pairs, so a large group of near copies costs as many rows
as it has members. A cell of more than CELL_ROWS members is dealt into blocks, and every pair of blocks is compared
by a task of its own. Components grow by passing the least label along links and through parents, each round
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, sealed, stored, table, unsealed
from gridloom.llm.text_arrays import HASH_STEP_BYTES, IS_SEPARATOR, column_bytes, mixed_bits, ragged, steps, word_hashes, words_of

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENT_BITS = 2
CELL_ROWS = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprint_column(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as unsigned 64-bit integers; texts without a word get nought."""
    data, offsets = column_bytes(column)
    lowered = LOWER[data]
    words = words_of(pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(lowered)]), IS_SEPARATOR)
    # words joined by one space, in one buffer: a shingle is then a slice of it
    joined_lengths = words.ends - words.starts + 1
    ends = np.cumsum(joined_lengths)
    begins = ends - joined_lengths
    joined = b" ".join(words.values().to_pylist())
    per_doc = words.per_doc()
    first = np.cumsum(per_doc) - per_doc
    out = np.zeros(len(column), np.uint64)
    n_shingles = np.where(per_doc > 0, np.maximum(per_doc - shingle + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(n_shingles) - n_shingles), n_shingles) + np.arange(int(n_shingles.sum()))
    last = np.minimum(at + shingle, np.repeat(first + per_doc, n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[at].tolist(), (ends[last] - 1).tolist())), np.uint64, len(at))
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for i in np.flatnonzero(n_shingles):
        of = bits[bounds[i] : bounds[i + 1]]
        set_bits = 2 * of.sum(axis=0, dtype=np.int64) > len(of)
        out[i] = np.packbits(set_bits).view(">u8")[0]
    return out


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for at, to in steps(text, HASH_STEP_BYTES):
                found = fingerprint_column(text.slice(at, to - at), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return own_columns(documents, "doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


# --- the grid -----------------------------------------------------------------------------------------------------


def groups_for(n: int) -> int:
    """Groups of segments for n distinct fingerprints: cells stay small as n grows."""
    return 6 if n <= 1 << 21 else 7 if n <= 1 << 25 else 8


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one row per fingerprint."""
    pairs = (fp.view(np.uint64)[:, None] >> np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)[None, :]) & np.uint64(3)
    return ((pairs & np.uint64(1)) + (pairs >> np.uint64(1))).astype(np.uint8)


def grid_cells(fp: np.ndarray, groups: int, distance: int = DISTANCE) -> np.ndarray:
    """Cell ids, one row per fingerprint and one column per choice of ``groups - distance`` whole groups."""
    counts = embed(fp).astype(np.int64)
    parts = []
    for members in np.array_split(np.arange(counts.shape[1]), groups):
        value = np.zeros(len(fp), np.int64)
        for m in members:
            value = value * 3 + counts[:, m]
        parts.append(value)
    cells = []
    for k, chosen in enumerate(combinations(range(groups), groups - distance)):
        cell = np.full(len(fp), k, np.uint64)
        for g in chosen:  # a cell id is mixed to 64 bits; should two cells share one, exact comparison sorts it out
            cell = (cell ^ parts[g].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            cell ^= cell >> np.uint64(29)
        cells.append(cell.view(np.int64))
    return np.stack(cells, axis=1)


def cell_rows(distinct: DataFrame, groups: int, distance: int = DISTANCE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                cells = grid_cells(part, groups, distance)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(part, cells.shape[1]))], names=["cell", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding with each count of a two-bit segment in unary (00, 01, 11): the differing bits of two such numbers
    are the Manhattan distance of their counts."""
    x = fp.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    return ((x | x >> np.uint64(1)) & low) | ((x & x >> np.uint64(1)) & low) << np.uint64(1)


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs differ in at most ``distance`` bits: the lower bound first, then whole fingerprints of what it leaves."""
    a, b = np.broadcast_arrays(a.view(np.uint64), b.view(np.uint64))
    out = np.bitwise_count(unary(a) ^ unary(b)) <= distance
    left = np.flatnonzero(out)
    out[left] = np.bitwise_count(a[left] ^ b[left]) <= distance
    return out


def spanning_links(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what lies within ``distance``, as few as the members of the components found."""
    rest = np.sort(fp).view(np.uint64)
    counts = unary(rest)
    links: list[tuple[int, int]] = []
    while len(rest) > 1:
        front = [(rest[0], counts[0])]
        rest, counts = rest[1:], counts[1:]
        while front and len(rest):
            at, own = front.pop()
            near = np.flatnonzero(np.bitwise_count(counts ^ own) <= distance)  # the lower bound, then the bits
            near = near[np.bitwise_count(rest[near] ^ at) <= distance]
            if len(near):
                found = rest[near]
                links += [(int(at), int(x)) for x in found]
                front += zip(found, counts[near])
                rest, counts = np.delete(rest, near), np.delete(counts, near)
    return links


def _links_of_runs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; rows come sorted by key."""
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edges)
    a, b = [], []
    two = edges[:-1][sizes == 2]
    x, y = fp[two], fp[two + 1]
    near = linked(x, y, distance)
    a.append(x[near])
    b.append(y[near])
    for size in (3, 4, 5, 6, 7, 8):  # small cells: all pairs at once, which are few
        at = edges[:-1][sizes == size]
        if len(at):
            for i, j in combinations(range(size), 2):
                x, y = fp[at + i], fp[at + j]
                near = linked(x, y, distance)
                a.append(x[near])
                b.append(y[near])
    for at, size in zip(edges[:-1][sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        own = spanning_links(fp[at : at + size], distance)
        if own:
            both = np.array(own, np.uint64).view(np.int64)
            a.append(both[:, 0])
            b.append(both[:, 1])
    return np.concatenate(a), np.concatenate(b)


def links_in_cells(rows: DataFrame, keys: list[str], distance: int = DISTANCE) -> DataFrame:
    """Links (a, b), a before b, of rows (keys..., fp) that share their keys. Rows of one key must be bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty((0, len(keys)), np.int64), np.empty(0, np.int64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            changed = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
            a, b = _links_of_runs(changed, fp, distance)
            if not len(a):
                return None
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([kept_key, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))], axis=1)])
            fp = np.concatenate([kept_fp, batch.column(len(keys)).to_numpy(zero_copy_only=False)])
            if not len(fp):
                continue
            same = (key == key[-1]).all(axis=1)
            last = len(fp) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last key may go on
            if last:
                got = out(key[:last], fp[:last])
                if got is not None:
                    yield got
            kept_key, kept_fp = key[last:], fp[last:]
        if len(kept_fp):
            got = out(kept_key, kept_fp)
            if got is not None:
                yield got

    return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, groups: int, distance: int = DISTANCE, cell_limit: int = CELL_ROWS) -> DataFrame:
    """Links between distinct fingerprints that connect all that lie within ``distance`` of each other."""
    cells = cell_rows(distinct, groups, distance)
    large = cells.groupBy("cell").count().where(F.col("count") > cell_limit).select("cell", F.ceil(F.col("count") / cell_limit).cast("long").alias("blocks"))
    large = stored(large, "large-cells")
    if large.isEmpty():
        return links_in_cells(cells, ["cell"], distance).distinct()
    dealt = cells.join(large, "cell", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks"))))
    usual = links_in_cells(dealt.where("own is null"), ["cell"], distance)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = dealt.where("own is not null").withColumn("other", other)
    pairs = pairs.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return usual.unionByName(links_in_cells(pairs, ["cell", "low", "high"], distance)).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the least node of the component of every node that has a link.

    Each round hangs the neighbours of a node under its least neighbour, first the larger ones, then all smaller
    ones (alternating large and small stars), until every link is between a node and its root. Chains halve, so
    the rounds grow with the logarithm of the longest chain.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = stored(large, "large-star")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.col("b").alias("x"), "m", "a")
        turned = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        turned = stored(turned, "small-star")
        changed = not turned.exceptAll(current).isEmpty() or not current.exceptAll(turned).isEmpty()
        current = turned
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, groups: int | None = None, cell_limit: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach, for every row.

    Rows without words have fingerprint nought and link like any other. A null doc_id takes part but never names a
    component unless all its members are null. Repeated rows are returned as often as they come.
    """
    marked = stored(fingerprints(documents, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(distinct, groups or groups_for(distinct.count()), distance, cell_limit))
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# --- similar texts beyond the contract's distance --------------------------------------------------------------------

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
BINS = 128
#: A pair with a share s of its shingles in common meets in a band with probability 1 - (1 - s^5)^25 whatever the size of
#: the corpus: 0.99995 at SIMILARITY, 0.9999996 at 0.85.
BAND_ROWS = 5
BANDS = BINS // BAND_ROWS
#: Text of one family that a task holds at most, times two.
FAMILY_BYTES = 8_000_000
#: Standard errors by which a sketch's estimate may fall short of SIMILARITY before a pair is passed over.
SKETCH_ERRORS = 6


def shingle_hashes(column: pa.Array, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and how many each has; a text of fewer words has one."""
    data, offsets = column_bytes(column)
    lowered = LOWER[data]
    w = words_of(pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(lowered)]), IS_SEPARATOR)
    per_doc = w.per_doc()
    first = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc > 0, np.maximum(per_doc - shingle + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = np.minimum(at + shingle, np.repeat(first + per_doc, count))
    word = word_hashes(w.data, w.starts, w.ends)
    mixed = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        inside = at + k < last
        mixed[inside] = mixed_bits(mixed[inside] * np.uint64(0x9E3779B97F4A7C15) + word[at[inside] + k])
    return mixed, count


def sketch_column(column: pa.Array, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (the number of bins with a value of their own, then BANDS band ids), least-value sketches (BINS numbers of
    four bits, two a byte) and whether a text has a word."""
    n = len(column)
    mixed, count = shingle_hashes(column, shingle)
    doc = np.repeat(np.arange(n), count)
    again = mixed_bits(mixed ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * BINS + (again >> np.uint64(57)).astype(np.int64), again & np.uint64((1 << 57) - 1))
    least = least.reshape(n, BINS)
    empty = least == np.iinfo(np.uint64).max
    some = count > 0
    if some.any():  # an empty bin takes the next full one's value, changed by how far that is
        full = np.where(np.concatenate([empty, empty], axis=1), 2 * BINS, np.arange(2 * BINS))
        following = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        following = np.where(some[:, None], following, 0)
        gap = (following - np.arange(BINS)).astype(np.uint64)
        least = mixed_bits(np.take_along_axis(least, following % BINS, axis=1) + gap * np.uint64(0xD6E8FEB86659FD93))
    keys = np.empty((n, 1 + BANDS), np.int64)
    keys[:, 0] = BINS - empty.sum(axis=1)
    for k in range(BANDS):
        band = np.full(n, k + 1, np.uint64)
        for m in range(k * BAND_ROWS, (k + 1) * BAND_ROWS):
            band = mixed_bits(band * np.uint64(0x9E3779B97F4A7C15) + least[:, m])
        keys[:, 1 + k] = band.view(np.int64)
    nibbles = (least & np.uint64(15)).astype(np.uint8)
    return keys, nibbles[:, 0::2] | nibbles[:, 1::2] << 4, some


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles from two sketches; chance agreement of four bits is taken off."""
    differ = a ^ b
    same = ((differ & 15) == 0).sum(axis=-1) + ((differ & 240) == 0).sum(axis=-1)
    return (same / BINS - 1 / 16) / (1 - 1 / 16)


def maybe_alike(full_a: np.ndarray, sketch_a: np.ndarray, full_b: np.ndarray, sketch_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches leave room for ``similarity``; those of short texts, with few full bins, leave more."""
    error = np.sqrt(similarity * (1 - similarity) / np.minimum(full_a, full_b))
    return likeness(sketch_a, sketch_b) >= similarity - SKETCH_ERRORS * error


def _similar_in_run(ids: np.ndarray, full: np.ndarray, sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links within a cell, as few as connect what the sketches take for alike."""
    rest = np.arange(len(ids))
    found: list[tuple[int, int]] = []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.flatnonzero(maybe_alike(full[rest], sketch[rest], full[at], sketch[at], similarity))
            if len(near):
                hit = rest[near]
                rest = np.delete(rest, near)
                found += [(int(ids[at]), int(ids[x])) for x in hit]
                front += hit.tolist()
    return found


def similar_links(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, cell_limit: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) of texts with ``similarity`` or more of their shingles in common, for documents with distinct
    doc_id that aren't null.

    The least values of a text's shingles are cut into bands; texts that agree on a whole band share a cell. Bands
    depend on the similarity alone, so what is found doesn't fall as the texts grow in number. Within a cell sketches
    span families of what may be alike; within a family whole texts decide, each pair that is not yet linked.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in steps(batch.column(1), HASH_STEP_BYTES):
                keys, sketch, some = sketch_column(batch.column(1).slice(at, to - at), shingle)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys[:, 1:].ravel()))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 2), len(keys), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())
                whole = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(keys[:, 0]), packed, bands], names=["id", "full", "sketch", "bands"])
                yield whole.filter(pa.array(some))

    marked = stored(own_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(marks, "id long, full long, sketch binary, bands array<long>"), "sketches")
    cells = marked.select(F.explode("bands").alias("cell"), "id", "full", "sketch")
    sizes = marked.select(F.explode("bands").alias("cell")).groupBy("cell").count()
    large = stored(sizes.where(F.col("count") > cell_limit).select("cell", F.ceil(F.col("count") / cell_limit).cast("long").alias("blocks")), "large-cells")
    keys = ["cell"]
    if not large.isEmpty():  # the same dealing into pairs of blocks as above; a small cell is one block
        dealt = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        paired = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cells = paired.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "full", "sketch")
        keys = ["cell", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def runs(key: np.ndarray, rows: pa.Table) -> pa.RecordBatch | None:
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            ids, full = rows["id"].to_numpy(), rows["full"].to_numpy()
            data, _ = column_bytes(rows["sketch"].combine_chunks())
            sketch = data.reshape(len(ids), BINS // 2)
            two = edges[:-1][np.diff(edges) == 2]  # most cells: all at once
            two = two[maybe_alike(full[two], sketch[two], full[two + 1], sketch[two + 1], similarity)]
            out: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a > 2:
                    out += _similar_in_run(ids[a:b], full[a:b], sketch[a:b], similarity)
            if not out and not len(two):
                return None
            both = np.concatenate([np.stack([ids[two], ids[two + 1]], axis=1), np.array(out, np.int64).reshape(-1, 2)])
            both = np.unique(np.sort(both, axis=1), axis=0)  # a pair meets in many cells
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            key = np.stack([rows[k].to_numpy() for k in keys], axis=1)
            same = (key == key[-1]).all(axis=1)
            cut = 0 if same.all() else len(key) - int(np.argmin(same[::-1]))  # the last key may go on
            if cut:
                got = runs(key[:cut], rows.slice(0, cut))
                if got is not None:
                    yield got
            held = rows.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            got = runs(np.stack([held[k].to_numpy() for k in keys], axis=1), held)
            if got is not None:
                yield got

    candidates = stored(cells.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(compare, "a long, b long").distinct(), "candidates")
    return _verified(components(candidates), documents, similarity, shingle, cell_limit)


def _alike_in_family(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect the sets that share enough, as few as connect them; no pair is passed over."""
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    enough = lambda shared, a, b: (shared >= similarity * (a + b - shared)) & (shared > 0)
    if n == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if enough(shared, *sizes) else []
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(code, kind="stable")]
    held = np.bincount(code)
    starts = np.cumsum(held) - held
    first = np.cumsum(sizes) - sizes
    left = np.ones(n, bool)
    found: list[tuple[int, int]] = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front and left.any():
            at = front.pop()
            own = code[first[at] : first[at] + sizes[at]]
            shared = np.bincount(holders[ragged(starts[own], held[own])], minlength=n)
            hit = np.flatnonzero(left & enough(shared, sizes, sizes[at]))
            left[hit] = False
            found += [(int(ids[at]), int(ids[x])) for x in hit]
            front += hit.tolist()
    return found


def _verified(families: DataFrame, documents: DataFrame, similarity: float, shingle: int, cell_limit: int) -> DataFrame:
    """Links of the texts of a family (node, root) that share enough of their distinct shingles. A large family is
    dealt into blocks, and each pair of blocks is compared by a task of its own."""
    texts = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = stored(texts.join(families.withColumnRenamed("node", "id"), "id").select("root", "id", "text"), "family-texts")
    blocks = F.ceil(F.greatest(F.count("*") / cell_limit, F.sum(F.octet_length("text")) / FAMILY_BYTES)).cast("long")
    large = stored(texts.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1"), "large-families")
    keys = ["root"]
    if not large.isEmpty():
        dealt = texts.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        paired = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        texts = paired.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "text")
        keys = ["root", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = _alike_in_family(np.array(ids), sets, similarity) if len(ids) > 1 else []
            if found:
                both = np.sort(np.array(found, np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            family = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            own, text = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1)
            for at, to in steps(text, HASH_STEP_BYTES):
                mixed, count = shingle_hashes(text.slice(at, to - at), shingle)
                for i, x in zip(range(at, to), np.split(mixed, np.cumsum(count)[:-1])):
                    if family[i] != now:
                        yield from out()
                        now, ids, sets = family[i], [], []
                    ids.append(own[i])
                    sets.append(np.unique(x))
        yield from out()

    return texts.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "a long, b long").distinct()


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; null, empty and wordless texts share fingerprint nought."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = SIMILARITY) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, that with the least doc_id (rows without one come
    last; of rows that share it, the least hash decides). A row is known by its contents, not by its doc_id, so rows
    without doc_id, or with the same one, stay side by side if their texts are no near copies.

    Near copies are what the contract's fingerprints link and texts with SIMILARITY or more of their five-word shingles
    in common (None: only the former); groups are what both kinds of link join.
    """
    own = sealed(docs, "doc_id", "text")
    named = own.select(
        F.struct(*own.columns).alias("row"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"),
        F.xxhash64(*own.columns).alias("h"),
        F.col("doc_id").alias("id"),
    )
    key = F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "t")
    marked = fingerprints(named.select(key.alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "doc_id.t", "fp")
    texts = stored(marked.groupBy("t").agg(F.min("key").alias("key"), F.min("fp").alias("fp")), "texts")
    same = Window.partitionBy("t", "h").orderBy("id")  # rows that are the same in all columns
    rows = named.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    rows = stored(rows.join(texts.select("key.t", "key.h"), ["t", "h"], "left_semi").select("t", "row"), "rows")  # one a text
    first = stored(texts.groupBy("fp").agg(F.min("t").alias("first")), "first")
    near = links(first.select("fp"), groups_for(first.count()))
    for side in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"text_{side}")), side)
    edges = texts.join(first, "fp").where("t <> first").select(F.col("t").alias("a"), F.col("first").alias("b"))
    edges = edges.unionByName(near.select(F.col("text_a").alias("a"), F.col("text_b").alias("b")))
    if similarity is not None:
        edges = edges.unionByName(similar_links(rows.select(F.col("t").alias("doc_id"), F.col("row.text").alias("text")), similarity))
    labelled = texts.join(components(edges).withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    kept = labelled.groupBy("root").agg(F.min("key").alias("key")).select("key.t")
    return unsealed(rows.join(kept, "t", "left_semi").select("row.*"), docs, "doc_id", "text")
