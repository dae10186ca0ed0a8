"""Token ids of whole texts, by a public tokenizer file.

A text is cut where the tokenizer cuts it in any case: at spaces, and by the byte-level pattern before line breaks
and before punctuation after a letter too, so that a word is the same piece whatever follows it. Arrow finds the different
pieces of a batch; each is encoded once, and numpy puts the ids together. Pieces
seen before are kept per worker process in a table of bounded size, by 96-bit hashes.
"""

from __future__ import annotations

import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from badgewright.llm.words import mixed, run_hashes, text_bytes

KEPT_PIECES = 800_000
TEXT_BYTES = 2 << 20
NEW_PIECES = 20_000

# Libraries differ on whether these are white space: texts that have them are not cut.
_DOUBTFUL = "\x1c\x1d\x1e\x1f"
# White space before a space: there a cut at single spaces would cut a run in two.
_RUN = re.compile(r"\s ")

# Of ASCII. Beyond it, what has the lead byte C3 (but for the signs of times and division) counts as a letter: these
# letters of Latin-1 lower-case to one letter each and have no other normal form.
_LETTER, _PUNCTUATION, _INK = (
    np.array([b < 128 and of(chr(b)) for b in range(256)])
    for of in (str.isalpha, lambda c: "!" <= c <= "~" and not c.isalnum(), lambda c: not c.isspace())
)
_LATIN, _NO_LETTERS = 0xC3, (0x97, 0xB7)

_ENCODERS: dict[tuple, Encoder] = {}
_SECOND = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    end = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


@dataclass
class Segment:
    """Pieces by hash: where their ids stand in ``ids``. ``h1`` ascends."""

    h1: np.ndarray
    h2: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Segment:
        order = np.argsort(h1)
        start = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        return cls(h1[order], h2[order], start[order], size[order], ids)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 for those that are not here."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        place = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[place] == h1) & (self.h2[place] == h2), place, -1)

    def and_also(self, other: Segment) -> Segment:
        size, ids = np.concatenate([self.size, other.size]), np.concatenate([self.ids, other.ids])
        start = np.concatenate([self.start, other.start + np.int32(len(self.ids))])
        h1, h2 = np.concatenate([self.h1, other.h1]), np.concatenate([self.h2, other.h2])
        order = np.argsort(h1, kind="stable")
        return Segment(h1[order], h2[order], start[order], size[order], ids)


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are those of letters of ASCII or Latin-1; some rare ones are left out."""
    found = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == _LATIN)
    lead = lead[~np.isin(data[lead + 1], _NO_LETTERS)]
    found[lead] = found[lead + 1] = True
    return found


@dataclass
class Ids:
    """Ids of all texts one after another; text k has those from ``first[k]`` to ``first[k + 1]``."""

    ids: np.ndarray
    first: np.ndarray

    def of(self, text: int) -> np.ndarray:
        return self.ids[self.first[text] : self.first[text + 1]]


class Encoder:
    """Ids of texts by one tokenizer file.

    ``white_space`` says what the tokenizer does with it: "drop" (with upper case), or "keep" where one space
    belongs to the word after it, as in byte-level patterns. The strings of special tokens are treated as the file says.
    """

    def __init__(self, path: str, white_space: str, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.kept = {"drop": False, "keep": True}[white_space], kept
        tokens = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        marks = (lambda t: t.startswith("Ġ") or t == "Ċ") if self.keep else (lambda t: t.endswith("</w>"))
        self.edge = np.zeros(tokens[-1][1] + 1, dtype=bool)
        self.edge[[k for t, k in tokens if marks(t)]] = True
        self.segments: list[Segment] = []
        split = self.tokenizer.pre_tokenizer
        known = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        # Whether the pattern is the byte-level one, of which more is known than what it does with spaces.
        self.fine = self.keep and known and self.tokenizer.normalizer is None

    def _whole(self, text: str) -> bool:
        """Whether the text must not be cut."""
        return any(s in text for s in (*_DOUBTFUL, *self.special)) or (self.keep and _RUN.search(text) is not None)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after another, of the texts."""
        found = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.frombuffer(b"".join(x.tobytes() for x in found), dtype="<u4")
        return np.fromiter(map(len, found), np.int32, len(found)), ids

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of letters (after a space or line break each, if white space is kept), many to a text.

        Each is a word of its own to the tokenizer, and its first or last id tells where it begins or ends.
        """
        firsts = np.append(np.arange(0, len(words), 2000, dtype=np.int32), np.int32(len(words)))
        runs = pa.ListArray.from_arrays(pa.array(firsts), words.cast(pa.string()))
        texts = pc.binary_join(runs, "" if self.keep else " ").to_pylist()
        sizes, parts = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for text, first, last in zip(texts, firsts.tolist(), firsts[1:].tolist(), strict=False):
            ids = self._plain([text])[1]
            edges = np.flatnonzero(self.edge[ids]) + (not self.keep)
            cuts = np.append(edges, len(ids)) if self.keep else np.append(0, edges)
            size = np.diff(cuts).astype(np.int32)
            if len(size) != last - first or cuts[0] or cuts[-1] != len(ids):
                size, ids = self._plain(words.slice(first, last - first).to_pylist())
            sizes.append(size)
            parts.append(ids)
        return np.concatenate(sizes), np.concatenate(parts)

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after another, of different pieces, each on its own."""
        data, rows = text_bytes(new)
        begin, end = rows[:-1], rows[1:]
        body, held = np.minimum(begin + int(self.keep), end), end > begin
        first, last = np.zeros(len(new), np.uint8), np.zeros(len(new), np.uint8)
        first[held], last[held] = data[begin[held]], data[end[held] - 1]
        # A full stop or comma at the end, after a letter, is a word of its own.
        stopped = (last == ord(".")) | (last == ord(","))
        before = np.concatenate([[0], np.cumsum(letters(data))])
        ink = np.maximum(end - stopped, body)
        whole = (ink > body) & (before[ink] - before[body] == ink - body)
        if self.keep:
            whole &= (first == ord(" ")) | (self.fine & (first == ord("\n")))
        word, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
        word_size, word_ids = self._encode_words(pc.ascii_rtrim(new.take(pa.array(word)), ".,"))
        rest_size, rest_ids = self._plain(new.take(pa.array(rest)).to_pylist())
        size = np.zeros(len(new), np.int32)
        size[word], size[rest] = word_size, rest_size
        stops = [(np.flatnonzero(whole & (last == ord(c))), self._plain([c])[1]) for c in ".,"]
        word_end = size.copy()
        for at, ids in stops:
            size[at] += len(ids)
        start = np.cumsum(size, dtype=np.int64) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        out[spans(start[word], word_size)] = word_ids
        out[spans(start[rest], rest_size)] = rest_ids
        for at, ids in stops:
            out[spans(start[at] + word_end[at], np.full(len(at), len(ids)))] = np.tile(ids, len(at))
        return size, out

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after another, of different pieces."""
        data, rows = text_bytes(pieces)
        h1 = run_hashes(data, rows[:-1], rows[1:], byte_values=True)
        h2 = run_hashes(_SECOND[data], rows[:-1], rows[1:]).astype(np.uint32)
        place, segment = np.full(len(h1), -1), np.full(len(h1), -1)
        for k, known in enumerate(self.segments):
            left = np.flatnonzero(segment < 0)
            found = known.places(h1[left], h2[left])
            place[left], segment[left] = found, np.where(found >= 0, k, -1)
        new = np.flatnonzero(segment < 0)
        sizes, parts = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for first in range(0, len(new), NEW_PIECES):
            size, ids = self._encode_new(pieces.take(pa.array(new[first : first + NEW_PIECES])))
            sizes.append(size)
            parts.append(ids)
        fresh = Segment.of(h1[new], h2[new], np.concatenate(sizes), np.concatenate(parts))
        place[new], segment[new] = fresh.places(h1[new], h2[new]), len(self.segments)
        every = [*self.segments, fresh]
        size = np.zeros(len(h1), dtype=np.int32)
        for k, known in enumerate(every):
            size[segment == k] = known.size[place[segment == k]]
        start = np.cumsum(size, dtype=np.int64) - size
        ids = np.empty(int(size.sum()), dtype=np.uint32)
        for k, known in enumerate(every):
            mine = segment == k
            ids[spans(start[mine], size[mine])] = known.ids[spans(known.start[place[mine]], size[mine])]
        self._keep(fresh)
        return size, ids

    def _keep(self, fresh: Segment) -> None:
        """Segments are merged so that each is at least twice as large as the next."""
        if sum(len(x.h1) for x in self.segments) + len(fresh.h1) > self.kept:
            self.segments = []
        self.segments.append(fresh)
        while len(self.segments) > 1 and len(self.segments[-2].h1) < 2 * len(self.segments[-1].h1):
            last = self.segments.pop()
            self.segments[-1] = self.segments[-1].and_also(last)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and the number of each text's first one (one more than texts)."""
        if not self.keep:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            return lists.flatten(), np.concatenate([[0], np.cumsum(counts)])
        data, rows = text_bytes(texts)
        cut = data == ord(" ")
        if self.fine:
            # The pattern has no word, number or run of signs with a line break in it, and no sign after a letter in one. A
            # line break after white space may be one with it.
            letter, before = letters(data)[:-1], data[:-1]
            cut[1:] |= (data[1:] == ord("\n")) & (_INK[before] | letter)
            cut[1:] |= _PUNCTUATION[data[1:]] & letter
        cut[rows[:-1][rows[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.append(starts, len(data)).astype(kind)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(texts.type, len(starts), buffers), np.searchsorted(starts, rows)

    def encode(self, texts: pa.Array) -> Ids:
        """Ids of every text; nulls are empty. Bytes that are no text are replaced as Python replaces them."""
        texts = texts.fill_null("") if texts.null_count else texts
        whole = {k: t for k, t in enumerate(texts.to_pylist()) if self._whole(t)}
        if whole:
            rest = pa.array(["" if k in whole else t for k, t in enumerate(texts.to_pylist())], texts.type)
        pieces, firsts = self._cut(rest if whole else texts)
        encoded = pieces.dictionary_encode()
        number = encoded.indices.to_numpy(zero_copy_only=False)
        size, table = self._table(encoded.dictionary)
        lengths = size[number]
        ids = table[spans((np.cumsum(size, dtype=np.int64) - size)[number], lengths)]
        first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[firsts]
        if not whole:
            return Ids(ids, first)
        parts = [ids[first[k] : first[k + 1]] for k in range(len(texts))]
        sizes, found = self._plain(list(whole.values()))
        for k, mine in zip(whole, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
            parts[k] = mine
        return Ids(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def encoder(path: str, white_space: str) -> Encoder:
    """The encoder of this worker process; it is kept between tasks."""
    key = (path, white_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, white_space)
    return _ENCODERS[key]
