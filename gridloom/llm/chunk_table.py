"""Token ids of whole texts through a table of distinct chunks.

Where no token crosses a chunk border, a text's ids are the ids of its chunks one after another. Each distinct
chunk is segmented once by the tokenizer's own library; ids are joined back by position with array gathers. The
table lives in one worker, serves all its tasks, and starts anew once it is full (MOST_CHUNKS, MOST_WORDS), so its memory is
bounded whatever the corpus; a shuffle of all words to a common table would move more bytes than the texts have.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from gridloom.llm.text_arrays import marked, ragged, spans, words_of

MOST_CHUNKS = 250_000
#: Entries of a word table, some 400 bytes each of a worker's memory. With fewer, it starts anew before rare words come back.
MOST_WORDS = 1_000_000
#: Longer chunks are segmented but not kept.
LONGEST_KEPT = 64


class ChunkTable:
    """ids of distinct chunks; ``segment`` turns a list of chunk strings into lists of ids. If it has a method ``flat``,
    that is asked instead: it turns a list of chunks' bytes into all ids one after another and each chunk's number."""

    def __init__(self, segment: Callable[[list[str]], list[list[int]]], most: int = MOST_CHUNKS, longest: int = LONGEST_KEPT):
        self.segment, self.most, self.longest = segment, most, longest
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.lengths = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.n, self.used = 0, 0

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        if hasattr(self.segment, "flat"):
            ids, lengths = self.segment.flat(chunks)
        else:
            ids, lengths = flattened(self.segment([c.decode("utf-8") for c in chunks]))
        total, n = len(ids), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + total] = ids
        rows = np.arange(self.n, self.n + n)
        self.lengths[rows] = lengths
        self.starts[rows] = self.used + np.cumsum(lengths) - lengths
        self.n += n
        self.used += total
        return rows

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """Table rows of the given distinct chunks, which stay valid until the next call."""
        if self.n > self.most:
            self._clear()
        known = self.row
        out = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = [chunks[i] for i in fresh.tolist()]
            rows = self._add(new)
            out[fresh] = rows
            if max(map(len, new)) <= self.longest:
                known.update(zip(new, rows.tolist()))
            else:
                known.update((c, r) for c, r in zip(new, rows.tolist()) if len(c) <= self.longest)
        return out

    def join(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and how many each row has."""
        bounds = np.empty(self.n + 1, np.int64)
        bounds[:-1], bounds[-1] = self.starts[: self.n], self.used
        every = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(bounds * 4), pa.py_buffer(self.flat)])
        _, bounds, data = every.take(pa.array(rows)).buffers()
        lengths = np.diff(np.frombuffer(bounds, np.int64, len(rows) + 1)) >> 2
        return np.frombuffer(data, np.uint32, int(lengths.sum())) if data is not None else np.empty(0, np.uint32), lengths


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists one after another, and each list's length."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths


_tables: dict[tuple, ChunkTable] = {}


#: Cut points inside words: one of these after an ASCII letter always begins a new pre-token.
AFTER_LETTER = np.zeros(256, bool)
AFTER_LETTER[list(b".,;:!?%&*#$@()[]{}=+/~^")] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True


#: Rules under which a word of Latin letters is one pre-token: the bytes of its lower case.
LETTER_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _latin(chunk: str) -> bool:
    """Latin letters only, whose lower case is theirs one by one."""
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250" and "\u0130" not in chunk)


class WordSegmenter:
    """ids of chunks from a tokenizers file that lower-cases, splits letters from the rest, and ends each pre-token
    with a token of its own kind.

    A chunk of Latin letters is one pre-token, so many such chunks go to the library as one text, and the end-of-word
    tokens tell them apart again. The rest goes chunk by chunk. Where the file has LETTER_RULES, such chunks are
    lower-cased here, and go to the library's model with fewer rules: white space and the bytes' own characters.
    """

    def __init__(self, path: str, together: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.together = Tokenizer.from_file(path), together
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = self.library.model.end_of_word_suffix
        if suffix:
            self.is_end[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.letters = None
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        if self.joins and all(rules.get(k) == v for k, v in LETTER_RULES.items()) and not any(_latin(t["content"]) for t in rules.get("added_tokens", [])):
            whole = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, LETTER_RULES["pre_tokenizer"]["pretokenizers"][1]]}
            rules |= {"normalizer": None, "pre_tokenizer": whole, "post_processor": None, "added_tokens": []}
            self.letters = Tokenizer.from_str(json.dumps(rules))

    def flat(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks one after another, and how many each has."""
        texts = [c.decode("utf-8") for c in chunks]
        simple = np.fromiter(map(_latin, texts), bool, len(texts))
        if self.letters is None or not simple.any():
            return flattened(self(texts))
        words = [t for t, ok in zip(texts, simple.tolist()) if ok]
        ids, lengths = [], []
        for at in range(0, len(words), self.together):
            part = words[at : at + self.together]
            own = np.array(self.letters.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[own]) + 1
            if len(ends) == len(part) and ends[-1] == len(own):
                ids.append(own)
                lengths.append(np.diff(ends, prepend=0))
            else:  # never seen; the plain way is always right
                own, each = flattened(self._each(part))
                ids.append(own)
                lengths.append(each)
        if len(words) < len(texts):
            own, each = flattened(self._each([t for t, ok in zip(texts, simple.tolist()) if not ok]))
            ids.append(own)
            lengths.append(each)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        found, each = np.concatenate(ids), np.concatenate(lengths)
        starts = np.empty(len(chunks), np.int64)
        number = np.empty(len(chunks), np.int64)
        starts[order], number[order] = np.cumsum(each) - each, each
        return found[ragged(starts, number)], number

    def _each(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(chunks), 4096):
            out += [e.ids for e in self.library.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)]
        return out

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        simple = [i for i, c in enumerate(chunks) if _latin(c)] if self.joins else []
        if not simple:
            return self._each(chunks)
        out: list[list[int]] = [[]] * len(chunks)
        for at in range(0, len(simple), self.together):
            part = simple[at : at + self.together]
            ids = self.library.encode_batch_fast([" ".join([chunks[i] for i in part])], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # never seen; the plain way is always right
                for i, own in zip(part, self._each([chunks[i] for i in part])):
                    out[i] = own
                continue
            begin = 0
            for i, end in zip(part, ends.tolist()):
                out[i] = ids[begin:end]
                begin = end
        rest = sorted(set(range(len(chunks))).difference(simple))
        for i, own in zip(rest, self._each([chunks[i] for i in rest])):
            out[i] = own
        return out


def word_table(path: str) -> ChunkTable:
    """The worker's table for a tokenizers file whose pre-tokens never contain white space."""
    if ("word", path) not in _tables:
        _tables["word", path] = ChunkTable(WordSegmenter(path), most=MOST_WORDS)
    return _tables["word", path]


def word_ids(column: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids of each text of a column, one text after another, and their boundaries. Null counts as empty.

    Texts are cut at ASCII white space and between a letter and the mark after it; the tokenizer's own rules see what
    lies between. A special token's own string is never cut.
    """
    table = word_table(path)
    w = words_of(column)
    inside = np.zeros(len(w.data) + 1, bool)
    inside[1:-1] = marked(AFTER_LETTER, w.data[1:]) & marked(IS_LETTER, w.data[:-1]) if len(w.data) else False
    inside[w.starts] = False  # a text may begin with a mark right after another's letter
    cuts = np.flatnonzero(inside)
    starts = np.sort(np.concatenate([w.starts, cuts]), kind="stable")
    ends = np.sort(np.concatenate([w.ends, cuts]), kind="stable")
    distinct = spans(w.data, starts, ends).dictionary_encode()
    row = table.rows(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())[distinct.indices.to_numpy(zero_copy_only=False)]
    ids, lengths = table.join(row)
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    per_doc = np.bincount(doc, weights=lengths, minlength=w.n_docs).astype(np.int64)
    if end_id is None:
        return ids, np.concatenate(([0], np.cumsum(per_doc)))
    bounds = np.concatenate(([0], np.cumsum(per_doc + 1)))
    out = np.empty(int(bounds[-1]), np.uint32)
    is_end = np.zeros(len(out), bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = end_id
    out[~is_end] = ids
    return out, bounds


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit ids between the boundaries, as a binary column."""
    data = np.ascontiguousarray(flat, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])
