"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

``parse`` reads the container; ``compose`` applies palettes, frame rectangles, interlacing, transparency and disposal
and gives timed frames. Code streams of one kind (8-bit pixels, one clear code at the front, widths that follow from
the place in the stream) are coded and decoded for thousands of frames at once: every numpy step handles the same
place of all streams. All other streams go through a plain decoder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, stored, table
from gridloom.llm.text_arrays import column_bytes, ragged, steps

SIDE = 24
FRAME = SIDE * SIDE
FILL = 255
DELAY = 10  # hundredths of a second
LANES = 4096
BINS = 16

# Fixed values of the format with 8-bit pixels.
CLEAR, END, FIRST = 256, 257, 258
NARROW = 256  # the clear code and the 255 codes after it have 9 bits: 288 whole bytes; the rest up to 1022 have 10
NARROW_BYTES = NARROW * 9 // 8


# --- many code streams at once --------------------------------------------------------------------------------------


def _codes_of(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LZW codes with clear and end codes, one row per frame of one length, and how many there are."""
    lanes, n = pixels.shape
    lane = np.arange(lanes)
    codes = np.zeros((lanes, n + 2), np.int64)
    codes[:, 0] = CLEAR
    count = np.ones(lanes, np.int64)
    slots = 1 << max(4, int(2 * n - 1).bit_length() - 1)
    hashed = np.zeros(lanes * slots, np.int64)  # (prefix code, pixel) + 1 above 12 bits of code, or nought
    home = lane * slots
    prefix = pixels[:, 0].astype(np.int64)
    for t in range(1, n):
        pixel = pixels[:, t].astype(np.int64)
        key = (prefix << 8 | pixel) + 1
        slot = (key * 0x9E3779B1 >> 12) & (slots - 1)
        seen = hashed[home + slot]
        open_ = np.flatnonzero((seen != 0) & (seen >> 12 != key))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (slots - 1)
            again = hashed[home[open_] + slot[open_]]
            seen[open_] = again
            open_ = open_[(again != 0) & (again >> 12 != key[open_])]
        new = np.flatnonzero(seen == 0)
        at = count[new]
        codes[new, at] = prefix[new]
        hashed[home[new] + slot[new]] = key[new] << 12 | (FIRST - 1 + at)
        count[new] = at + 1
        prefix = seen & 0xFFF
        prefix[new] = pixel[new]
    codes[lane, count] = prefix
    codes[lane, count + 1] = END
    return codes, count + 2


def _packed(codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of code bytes and how many of them count."""
    lanes, n = codes.shape
    wide = max(0, -(-(n - NARROW) // 4)) * 4
    every = np.zeros((lanes, NARROW + wide), np.uint64)
    every[:, :n] = codes
    narrow = every[:, :NARROW].reshape(lanes, -1, 8)
    low = narrow[:, :, 0].copy()
    for i in range(1, 8):
        low |= narrow[:, :, i] << np.uint64(9 * i)  # of the last code, one bit
    nine = np.empty((lanes, NARROW // 8, 9), np.uint8)
    nine[:, :, :8] = low.astype("<u8").view(np.uint8).reshape(lanes, -1, 8)
    nine[:, :, 8] = narrow[:, :, 7] >> np.uint64(1)
    out = [nine.reshape(lanes, -1)]
    if wide:
        rest = every[:, NARROW:].reshape(lanes, -1, 4)
        four = rest[:, :, 0] | rest[:, :, 1] << np.uint64(10) | rest[:, :, 2] << np.uint64(20) | rest[:, :, 3] << np.uint64(30)
        out.append(np.ascontiguousarray(four.astype("<u8").view(np.uint8).reshape(lanes, -1, 8)[:, :, :5]).reshape(lanes, -1))
    bits = 9 * np.minimum(count, NARROW) + 10 * np.maximum(count - NARROW, 0)
    return np.concatenate(out, axis=1), -(-bits // 8)


def _unpacked(data: np.ndarray) -> np.ndarray:
    """Codes of rows of code bytes, NARROW of them and what the other bytes can hold."""
    lanes, n = data.shape
    narrow = np.zeros((lanes, NARROW_BYTES), np.uint8)
    narrow[:, : min(n, NARROW_BYTES)] = data[:, :NARROW_BYTES]
    nine = narrow.reshape(lanes, -1, 9)
    low = np.ascontiguousarray(nine[:, :, :8]).view("<u8")[:, :, 0]
    codes = np.empty((lanes, NARROW // 8, 8), np.int64)
    for i in range(7):
        codes[:, :, i] = (low >> np.uint64(9 * i)) & np.uint64(511)
    codes[:, :, 7] = (low >> np.uint64(63)).astype(np.int64) | nine[:, :, 8].astype(np.int64) << 1
    out = [codes.reshape(lanes, -1)]
    if n > NARROW_BYTES:
        groups = -(-(n - NARROW_BYTES) // 5)
        wide = np.zeros((lanes, groups * 5), np.uint8)
        wide[:, : n - NARROW_BYTES] = data[:, NARROW_BYTES:]
        padded = np.zeros((lanes, groups, 8), np.uint8)
        padded[:, :, :5] = wide.reshape(lanes, groups, 5)
        four = padded.view("<u8")[:, :, 0]
        out.append(np.stack([(four >> np.uint64(10 * i)) & np.uint64(1023) for i in range(4)], axis=2).astype(np.int64).reshape(lanes, -1))
    return np.concatenate(out, axis=1)


def lzw_encode(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bytes of each row of 8-bit pixels and how many of them count; rows have 1 to 766 pixels."""
    return _packed(*_codes_of(pixels))


def lzw_decode(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n pixels, and whether the row was a stream of the kind that is decoded here."""
    codes = _unpacked(data)
    lanes, most = codes.shape
    good = codes[:, 0] == CLEAR
    codes = codes[:, 1 : min(most, n + 2)]
    most = codes.shape[1]
    ended = codes == END
    stop = np.where(ended.any(axis=1), ended.argmax(axis=1), most)
    place = np.arange(most)
    used = place[None, :] < stop[:, None]
    later = codes - FIRST  # the entry made while reading code `later + 1`: the string of code `later` and one more
    good &= ~(used & ((codes == CLEAR) | (later >= place[None, :]))).any(axis=1)
    literal = codes < CLEAR
    later = np.where(literal | ~used | ~good[:, None], 0, later)
    length = np.where(used, 1, 0)
    lane = np.arange(lanes)
    for i in range(1, most):  # a code's length follows from an earlier code's
        longer = np.flatnonzero(~literal[:, i] & used[:, i])
        if len(longer):
            length[longer, i] = length[longer, later[longer, i]] + 1
    ends = np.cumsum(length, axis=1)
    good &= ends[:, -1] == n
    if not good.all():
        length[~good] = 0
        length[~good, 0] = n
        ends = np.cumsum(length, axis=1)
        codes = np.where(good[:, None], codes, 0)
        literal = np.where(good[:, None], literal, True)
        later = np.where(good[:, None], later, 0)
    begins = ends - length
    # each pixel of a longer code copies from where its string first stood; chains of copies end at a literal
    owner = np.repeat(np.arange(lanes * most), length.ravel())  # n places per lane
    row = np.repeat(lane, n)
    offset = np.tile(np.arange(n), lanes) - begins.ravel()[owner]
    from_ = begins[row, later.ravel()[owner]] + offset + row * n
    lit = literal.ravel()[owner]
    source = np.where(lit, np.arange(lanes * n), from_)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    value = codes.ravel()[owner].astype(np.uint8)
    return value[source].reshape(lanes, n), good


# --- the plain decoder and the container ----------------------------------------------------------------------------


def lzw_decode_any(data: bytes, code_size: int, n: int) -> np.ndarray:
    """Pixels of any LZW stream; missing ones are nought, surplus ones are dropped."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    out = bytearray()
    table: list[bytes] = []
    bits = at = held = 0
    width, previous = code_size + 1, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear or not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, previous = code_size + 1, b""
                if code == clear:
                    continue
            if code == end:
                at = n
                break
            if code < len(table):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise ValueError("broken LZW stream")
            out += entry
            if previous and len(table) < 4096:
                table.append(previous + entry[:1])
            previous = entry
            if len(table) == 1 << width and width < 12:
                width += 1
        if at:
            break
    return np.frombuffer(bytes(out[:n]).ljust(n, b"\0"), np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # palette index, or -1
    interlaced: bool
    palette: bytes
    code_size: int
    data: bytes


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: bytes
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (size := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def parse(data: bytes) -> Gif:
    """The container of a GIF87a or GIF89a file; code streams stay as they are."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, b""
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette = data[at : at + size]
        at += size
    gif = Gif(width, height, background, palette)
    delay, disposal, transparent = 0, 0, -1
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else -1
            at = _blocks(data, at + 2)[1]
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if flags & 0x80:
                size = 3 << ((flags & 7) + 1)
                own = data[at : at + size]
                at += size
            code_size = data[at]
            codes, at = _blocks(data, at + 1)
            gif.frames.append(Frame(left, top, w, h, delay, disposal, transparent, bool(flags & 0x40), own, code_size, codes))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("broken GIF container")
    return gif


def pixels_of(frames: list[Frame]) -> list[np.ndarray]:
    """Palette indices of each frame in the order of its rows; frames of one shape are decoded together."""
    out: list[np.ndarray | None] = [None] * len(frames)
    alike: dict[int, list[int]] = {}
    for i, f in enumerate(frames):
        if f.code_size == 8 and 0 < f.width * f.height <= 766:
            alike.setdefault(f.width * f.height, []).append(i)
    for n, members in alike.items():
        for lo in range(0, len(members), LANES):
            part = members[lo : lo + LANES]
            sizes = np.fromiter((len(frames[i].data) for i in part), np.int64, len(part))
            grid = np.zeros((len(part), int(sizes.max(initial=1))), np.uint8)
            grid[np.arange(grid.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(frames[i].data for i in part), np.uint8)
            found, good = lzw_decode(grid, n)
            for i, p, ok in zip(part, found, good):
                if ok:
                    out[i] = p
    for i, f in enumerate(frames):
        if out[i] is None:
            out[i] = lzw_decode_any(f.data, f.code_size, f.width * f.height)
        if f.interlaced:
            rows = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, f.height, step)]
            sorted_ = np.empty((f.height, f.width), np.uint8)
            sorted_[rows] = out[i].reshape(f.height, f.width)
            out[i] = sorted_.ravel()
    return out  # type: ignore[return-value]


def compose(gif: Gif, pixels: list[np.ndarray] | None = None) -> list[tuple[int, int, np.ndarray]]:
    """(start, duration, RGBA canvas) of each frame, in hundredths of a second."""
    pixels = pixels_of(gif.frames) if pixels is None else pixels
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    out, start = [], 0
    for f, indices in zip(gif.frames, pixels):
        before = canvas.copy()
        palette = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        palette[: len(colours), :3] = colours
        palette[:, 3] = 255
        region = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        shown = indices.reshape(f.height, f.width)[: region.shape[0], : region.shape[1]]
        drawn = shown != f.transparent if f.transparent >= 0 else np.ones(shown.shape, bool)
        region[drawn] = palette[shown][drawn]
        out.append((start, f.delay, canvas.copy()))
        start += f.delay
        if f.disposal == 2:
            region[:] = 0
        elif f.disposal == 3:
            canvas = before
    return out


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour: four levels each of red, green and blue, 64 bins."""
    return np.bincount(_bins(canvas[canvas[..., 3] > 0]), minlength=64)


def _bins(colours: np.ndarray) -> np.ndarray:
    return (colours[:, 0] >> 6).astype(np.int64) << 4 | (colours[:, 1] >> 6).astype(np.int64) << 2 | colours[:, 2] >> 6


GREYS = bytes(v for i in range(256) for v in (i, i, i))
HEADER = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GREYS
FRAME_HEAD = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def _framed(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame blocks (head, data blocks of up to 255 bytes, end) one after another, and their lengths."""
    lanes, most = codes.shape
    head = len(FRAME_HEAD)
    blocks = -(-most // 255)
    grid = np.zeros((lanes, head + most + blocks + 1), np.uint8)
    grid[:, :head] = np.frombuffer(FRAME_HEAD, np.uint8)
    for b in range(blocks):
        at, own = head + 256 * b, codes[:, 255 * b : 255 * (b + 1)]
        grid[:, at] = np.clip(sizes - 255 * b, 0, 255)
        grid[:, at + 1 : at + 1 + own.shape[1]] = own
    lengths = head + sizes + -(-sizes // 255)
    grid[np.arange(lanes), lengths] = 0
    lengths = lengths + 1
    return grid[np.arange(grid.shape[1])[None, :] < lengths[:, None]], lengths


def media_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Byte counts and GIFs of a text column: each text's bytes, filled up to whole grey frames of 24 by 24."""
    data, offsets = column_bytes(column)
    sizes = np.diff(offsets)
    frames = np.maximum(1, -(-sizes // FRAME))
    filled = np.full(int(frames.sum()) * FRAME, FILL, np.uint8)
    first = np.cumsum(frames) - frames
    filled[ragged(first * FRAME, sizes)] = data
    pixels = filled.reshape(-1, FRAME)
    parts, lengths = [], []
    for lo in range(0, len(pixels), LANES):
        flat, n = _framed(*lzw_encode(pixels[lo : lo + LANES]))
        parts.append(flat)
        lengths.append(n)
    flat, lengths = np.concatenate(parts) if parts else np.empty(0, np.uint8), np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    raw = flat.tobytes()
    media = [HEADER + raw[ends[a] : ends[a + f]] + b"\x3b" for a, f in zip(first.tolist(), frames.tolist())]
    return sizes, pa.array(media, pa.binary())


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF) of every row; null text counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in steps(batch.column(1), 2_000_000):
                sizes, media = media_of(batch.column(1).slice(at, to - at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return own_columns(documents, "doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _covers(gif: Gif, f: Frame) -> bool:
    """Whether a frame replaces the whole canvas, so that composing it is its palette's colours alone."""
    return f.transparent < 0 and (f.left, f.top, f.width, f.height) == (0, 0, gif.width, gif.height)


@lru_cache(maxsize=64)
def _palette(colours: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Red of each palette entry, and its bin of the colour histogram; entries beyond the palette are black."""
    rgb = np.zeros((256, 3), np.uint8)
    found = np.frombuffer(colours, np.uint8).reshape(-1, 3)
    rgb[: len(found)] = found
    return rgb[:, 0].copy(), _bins(rgb)


def _composed(gif: Gif, pixels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The red plane of all composed frames, and how often each colour bin occurs in them."""
    if not gif.frames:
        return np.empty(0, np.uint8), np.zeros(64, np.int64)
    if all(_covers(gif, f) for f in gif.frames):
        reds, bins = zip(*((red[p], bin_[p]) for (red, bin_), p in zip((_palette(f.palette) for f in gif.frames), pixels)))
        return np.concatenate(reds), np.bincount(np.concatenate(bins), minlength=64)
    canvases = [c for _, _, c in compose(gif, pixels)]
    return np.concatenate([c[..., 0].ravel() for c in canvases]), sum(histogram(c) for c in canvases)


def read_media(stored: DataFrame) -> DataFrame:
    """The columns besides media, then n_frames, duration (hundredths of a second), samples (the red plane of every
    composed frame), grey_histogram (16 bins of them) and colour_histogram (64 bins, opaque pixels of all frames),
    decoded from the stored bytes alone."""
    own = [f for f in stored.schema.fields if f.name != "media"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_frames int, duration int, samples binary, grey_histogram array<long>, colour_histogram array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.schema.get_field_index("media"))
            for at, to in steps(media, 2_000_000):
                part = batch.slice(at, to - at)
                gifs = [parse(m) for m in media.slice(at, to - at).to_pylist()]
                found = pixels_of([f for g in gifs for f in g.frames])
                counts, durations, samples, histograms, colours, k = [], [], [], [], [], 0
                for g in gifs:
                    mine = found[k : k + len(g.frames)]
                    k += len(g.frames)
                    plane, colour = _composed(g, mine)
                    counts.append(len(g.frames))
                    durations.append(sum(f.delay for f in g.frames))
                    samples.append(plane.tobytes())
                    histograms.append(np.bincount(plane >> 4, minlength=BINS))
                    colours.append(colour)
                cols = [part.column(part.schema.get_field_index(f.name)) for f in own]
                cols += [pa.array(counts, pa.int32()), pa.array(durations, pa.int32()), pa.array(samples, pa.binary()), pa.array(histograms, pa.list_(pa.int64())), pa.array(colours, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in own), "n_frames", "duration", "samples", "grey_histogram", "colour_histogram"])

    return stored.mapInArrow(run, schema)


def timed_frames(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame of every GIF in ``media``: its time, size, RGBA bytes and 64-bin colour histogram."""
    schema = f"`{key}` {stored.schema[key].dataType.simpleString()}, frame int, start int, duration int, width int, height int, rgba binary, colour_histogram array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m is None:
                    continue
                rows = [(k, i, s, d, c.shape[1], c.shape[0], c.tobytes(), histogram(c).tolist()) for i, (s, d, c) in enumerate(compose(parse(m)))]
                if rows:
                    names = [key, "frame", "start", "duration", "width", "height", "rgba", "colour_histogram"]
                    types = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)

    return own_columns(stored, key, "media").mapInArrow(run, schema)


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a GIF that is written, read back and composed; null texts count as empty, very
    long ones are GIFs of as many frames as they need. The feature is the grey and the colour histogram."""
    files = stored(to_media(table(spark, sf_dir, "documents")), "media")
    kept = files.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = read_media(kept)
    size = F.length("samples")
    return found.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", F.array_join("grey_histogram", ","), F.array_join("colour_histogram", ",")).alias("feature"),
    )
