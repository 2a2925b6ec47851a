"""SentencePiece ids and decoded texts through a shared table of distinct marked words.

Holds for models like the one tested here: identity normalisation, a dummy marker before the text, no removal of
extra white space, and no piece with a marker after another character. Then no piece crosses from a character to a
following marker, so a text falls into chunks there, each a run of markers and what follows; a chunk's ids don't
depend on its neighbours. ``crossing_pieces`` names what would break this, and ``encode`` refuses such a model.

Texts are dealt into blocks as they are scanned. A block asks once for each distinct chunk it has. Chunks are dealt
into buckets by hash, so that all blocks ask for a chunk in the same bucket, whose table segments and decodes it once; the
number of buckets grows with the texts, so a table stays small. Questions and answers are packed, one row for a bucket
of a block, and answers come in the order asked; the block joins them to its texts by position. A chunk is asked as often
as there are blocks that have it, not as often as it comes.

The rows are scanned twice in one plan, for what blocks ask and for what they hold, as writing them would take more disk
than all questions and answers. Should the scans ever deal them differently, a chunk has no answer, and that raises.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.chunk_table import ChunkTable
from gridloom.llm.common import own_columns, table
from gridloom.llm.text_arrays import column_bytes, ragged, text_blocks

MARKER = "▁"
MARKER_BYTES = MARKER.encode()
#: Text of one block; a longer single text is a block of its own.
BLOCK_BYTES = 12_000_000
#: Text, repeats included, whose distinct chunks share a bucket and thus a table.
BUCKET_BYTES = 32_000_000


def crossing_pieces(model) -> list[str]:
    """Pieces with a marker after another character, or that a chunk border could part in another way."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i))
    return [p for p in pieces if MARKER in p.lstrip(MARKER)]


_models: dict[str, object] = {}


def model_of(path: str):
    """The worker's model, refused if its pieces can cross markers."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("  a  b", out_type=str) != model.encode("  a", out_type=str) + model.encode(" b", out_type=str) or crossing_pieces(model):
            raise ValueError("this model's pieces can cross white space markers")
        _models[path] = model
    return _models[path]


class PieceTable(ChunkTable):
    """Distinct chunks with their ids, and the decoded text of those that don't decode to themselves, by row."""

    def __init__(self, model):
        self.model = model
        self.lone = [model.piece_to_id(MARKER)]  # an empty chunk is a lone marker
        super().__init__(self._segment, most=sys.maxsize, longest=sys.maxsize)

    def _clear(self) -> None:
        super()._clear()
        self.other: dict[int, bytes] = {}

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        found = [ids if c else self.lone for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]
        self.other.update((self.n + i, d.encode()) for i, (c, d) in enumerate(zip(chunks, self.model.decode(found))) if c != d)
        return found


def chunks_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks without their first marker, the document of each, and whether it is the document's first."""
    data, offsets = column_bytes(column)
    n = len(data)
    space = data == 0x20
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    marked = np.zeros(n, bool)  # positions right after a space or a literal marker
    if n:
        marked[1:] = space[:-1]
        literal = np.zeros(n, bool)
        if n > 3:
            literal[3:] = (data[:-3] == MARKER_BYTES[0]) & (data[1:-2] == MARKER_BYTES[1]) & (data[2:-1] == MARKER_BYTES[2])
        marked |= literal
    # a chunk starts at a space after any other character; the text itself starts with the dummy marker
    inner = np.flatnonzero(space & ~marked & ~begins[:-1])
    full = np.flatnonzero(np.diff(offsets) > 0)
    cuts = np.concatenate([offsets[full], inner])
    is_first = np.concatenate([np.ones(len(full), bool), np.zeros(len(inner), bool)])
    order = np.argsort(cuts, kind="stable")
    cuts, is_first = cuts[order], is_first[order]
    doc = np.searchsorted(offsets, cuts, side="right") - 1
    ends = np.append(cuts[1:], n) if len(cuts) else cuts
    starts = np.where(is_first, cuts, cuts + 1)
    if not len(starts):
        return pa.array([], pa.binary()), doc, is_first
    bounds = np.stack([starts, ends], 1).ravel().astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, len(bounds) - 1, 2, dtype=np.int32))), doc, is_first


@dataclass
class Cut:
    """A text column in chunks: the document of each, whether it is the document's first, and its place among the
    column's distinct chunks."""

    n: int
    doc: np.ndarray
    is_first: np.ndarray
    place: np.ndarray
    distinct: pa.Array


def cut(column: pa.Array) -> Cut:
    chunks, doc, is_first = chunks_of(column)
    coded = chunks.dictionary_encode()
    return Cut(len(column), doc.astype(np.int32), is_first, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


class Answers:
    """Distinct chunks with their ids and decoded bytes in flat arrays, from packed answers in the chunks' order."""

    def __init__(self, chunks: pa.Array, answers: list[bytes]):
        lengths, ids, at, other = [], [], [], []
        begin = 0
        for answer in answers:
            n, i, where, sizes, texts = unpacked(answer)
            lengths.append(np.frombuffer(n, "<i4").astype(np.int64))
            total = int(lengths[-1].sum())
            ids.append(np.frombuffer(i, "<u2" if len(i) == 2 * total else "<u4").astype(np.int32))
            at.append(np.frombuffer(where, "<i4").astype(np.int64) + begin)
            bounds = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i4")))).tolist()
            other += [texts[a:b] for a, b in zip(bounds, bounds[1:])]
            begin += len(lengths[-1])
        if begin != len(chunks):
            raise RuntimeError("a chunk of this block has no answer")
        self.chunks = chunks
        self.id_counts = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.id_starts = np.cumsum(self.id_counts) - self.id_counts
        places = np.full(len(chunks), -1, np.int64)
        if other:
            places[np.concatenate(at)] = np.arange(len(other))
            chunks = pc.coalesce(pa.array(other, pa.binary()).take(pa.array(places, mask=places < 0)), chunks)
        self.text, bounds = column_bytes(chunks)
        self.text_starts, self.text_lengths = bounds[:-1], np.diff(bounds)


def join_back(own: Cut, known: Answers) -> tuple[pa.ListArray, pa.Array]:
    """ids and decoded text of each row, from the answers to its chunks by position."""
    place = pc.index_in(own.distinct, value_set=known.chunks)
    if place.null_count:
        raise RuntimeError("a chunk of this block has no answer")
    row = place.to_numpy(zero_copy_only=False)[own.place]
    lengths = known.id_counts[row]
    ids = known.ids[ragged(known.id_starts[row], lengths)]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(own.doc, weights=lengths, minlength=own.n).astype(np.int64))))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    gap = (~own.is_first).astype(np.int64)  # the marker that the chunk lost
    sizes = known.text_lengths[row] + gap
    text = np.full(int(sizes.sum()), 0x20, np.uint8)
    at = np.cumsum(sizes) - sizes + gap
    text[ragged(at, sizes - gap)] = known.text[ragged(known.text_starts[row], sizes - gap)]
    text_bounds = np.concatenate(([0], np.cumsum(np.bincount(own.doc, weights=sizes, minlength=own.n).astype(np.int64))))
    decoded = pa.Array.from_buffers(pa.string(), own.n, [None, pa.py_buffer(text_bounds.astype(np.int32)), pa.py_buffer(text)])
    return lists, decoded


def encode_column(column: pa.Array, path: str) -> tuple[pa.ListArray, pa.Array]:
    """ids and decoded text of each row of one column, with a table of its own."""
    own = cut(column)
    return join_back(own, Answers(own.distinct, [answer(PieceTable(model_of(path)), own.distinct.to_pylist())]))


# --- the shared table -------------------------------------------------------------------------------------------------


ROW = "block long, bucket long, data binary"


def _row(block: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket]), pa.array([data], pa.binary())], names=["block", "bucket", "data"])


def packed(*parts: bytes | np.ndarray) -> bytes:
    parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return np.array([len(p) for p in parts], "<i8").tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int = 5) -> list[bytes]:
    sizes = np.frombuffer(data, "<i8", n)
    whole = pa.decompress(data[8 * n :], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [whole[e - s : e] for s, e in zip(sizes.tolist(), ends)]


def in_buckets(distinct: list[pa.Array], buckets: int) -> tuple[pa.Array, np.ndarray]:
    """A block's distinct chunks by bucket, and the bucket of each: the same order whenever the block is read."""
    every = pc.unique(pa.chunked_array(distinct, pa.binary()))
    bucket = np.empty(len(every), np.int64)
    for at in range(0, len(every), 100_000):
        part = every.slice(at, 100_000).to_pylist()
        bucket[at : at + len(part)] = np.fromiter(map(zlib.crc32, part), np.int64, len(part)) % buckets
    order = np.argsort(bucket, kind="stable")
    return every.take(pa.array(order)), bucket[order]


def answer(pieces: PieceTable, chunks: list[bytes]) -> bytes:
    """Packed: how many ids each chunk has, the ids, and place, length and bytes of texts that differ from the chunk."""
    rows = pieces.rows(chunks)
    ids, lengths = pieces.join(rows)
    at = np.flatnonzero(np.isin(rows, np.fromiter(pieces.other, np.int64, len(pieces.other)))) if pieces.other else np.empty(0, np.int64)
    other = [pieces.other[r] for r in rows[at].tolist()]
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return packed(lengths.astype("<i4"), ids.astype("<u2" if narrow else "<u4"), at.astype("<i4"), np.array([len(x) for x in other], "<i4"), b"".join(other))


def _asked(block_bytes: int, buckets: int):
    """(block, bucket, data): the distinct chunks of each block, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in text_blocks(batches, block_bytes):
            chunks, bucket = in_buckets([pc.unique(chunks_of(b.column(b.num_columns - 1))[0]) for b in held], buckets)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:]):
                text, bounds = column_bytes(chunks.slice(a, b - a))
                yield _row(block, int(bucket[a]), packed(np.diff(bounds).astype("<i4"), text))

    return run


def _held(block_bytes: int, buckets: int):
    """(block, bucket, data): the rows of each block as a compressed stream, under the bucket after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for block, held in text_blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
                for part in held:
                    writer.write_batch(part)
            yield _row(block, buckets, sink.getvalue().to_pybytes())

    return run


def _answered(path: str):
    """(block, bucket, data): the packed answer to each packed question, sorted by bucket: a chunk is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTable(model_of(path))
        last = None
        for batch in batches:
            for block, bucket, asked in zip(*(batch.column(i) for i in range(3))):
                if bucket != last:
                    pieces._clear()
                    last = bucket
                sizes, text = unpacked(asked.as_py(), 2)
                bounds = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i4")))).tolist()
                yield _row(block.as_py(), bucket.as_py(), answer(pieces, [text[a:b] for a, b in zip(bounds, bounds[1:])]))

    return run


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``keep``, ids and the decoded text of every row; null counts as empty, repeats stay, a very long
    text is a block of its own, and an empty table gives an empty one. Columns besides ``keep`` and the text are never
    read, whatever their names."""
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>", "decoded string"])
    rows = own_columns(documents, *keep, "text").toDF(*[f"_own_{i}" for i in range(len(keep))], "_text")
    rows = rows.select(F.spark_partition_id().alias("_partition"), *rows.columns)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) + 1
    asked = rows.mapInArrow(_asked(block_bytes, buckets), ROW).repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_answered(path), ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        found: list[bytes] = []
        for batch in batches:
            for number, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if number != block:
                    block, found = number, []
                if bucket < buckets:
                    found.append(data.as_py())
                    continue
                cuts, columns = [], []
                for held in pa.ipc.open_stream(data.as_buffer()):
                    cuts.append(cut(held.column(held.num_columns - 1)))
                    columns.append(held.columns[1:-1])
                known = Answers(in_buckets([c.distinct for c in cuts], buckets)[0], found)
                for own, kept in zip(cuts, columns):
                    ids, decoded = join_back(own, known)
                    yield pa.RecordBatch.from_arrays([*kept, ids, decoded], names=[*keep, "ids", "decoded"])

    met = answers.unionByName(rows.mapInArrow(_held(block_bytes, buckets), ROW))
    return met.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    found = encode(table(spark, sf_dir, "documents"), default_model())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
