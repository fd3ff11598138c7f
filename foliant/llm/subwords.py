"""Whole texts to subword ids with a public tokenizer file, a distinct unit at a time."""

from __future__ import annotations

import os

import numpy as np

from foliant.llm.kernels import BLANK, pieces, ragged, span_hashes, spans

#: Units whose ids an encoder remembers (some 30 bytes each).
REMEMBERED = 500_000
#: Bytes encoded at once.
ENCODED = 1 << 21
#: Units in one call of the tokenizer.
CALL = 5_000

#: Kinds of bytes: white space, ASCII letters and those of two-byte Latin letters, digits, other ASCII, all that needs care.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[:128] = MARK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[*range(9), *range(14, 32), 127, 39, 60]] = OTHER  # controls; the apostrophe has rules of its own, < begins special tokens
KIND[BLANK] = SPACE


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: a worker's tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes columns of texts; the ids are those of the tokenizers library for each whole text.

    For word_bpe_49k.json of the public tokenizers: it puts letters in lower case, drops white space, and never joins letters,
    single digits and runs of other characters with each other. So the ids of a text are those of these units, one after the
    other, and each distinct unit of a batch is encoded once. Words with bytes that need care (other than ASCII and the Latin
    letters U+00C0 to U+00FF, or with an apostrophe or <) are units as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.size, dtype=bool)  # ids that end a unit
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.kind = np.uint16 if self.size <= 65536 else np.uint32
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _apart(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts for units that are one each for the tokenizer."""
        flat, sizes = [], []
        for a in range(0, len(texts), CALL):
            part = texts[a : a + CALL]
            ids = np.array(self._apart([" ".join(part)])[0], dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                lists = self._apart(part)
                ids, ends = np.array([i for x in lists for i in x], dtype=self.kind), np.cumsum([len(x) for x in lists])
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate([np.zeros(0, self.kind), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is among those remembered; -1 where it isn't."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, careful: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct units: where their ids start in the array that comes last, and how many they are."""
        at = self._known(keys)
        new = np.flatnonzero(at < 0)
        raw = data.tobytes()
        text = lambda i: raw[starts[i] : ends[i]].decode("utf-8", "replace")
        new = np.concatenate([new[~careful[new]], new[careful[new]]])
        plain = int((~careful[new]).sum())
        flat, sizes = self._together([text(i) for i in new[:plain]])
        lists = self._apart([text(i) for i in new[plain:]])
        flat = np.concatenate([flat, np.array([i for x in lists for i in x], dtype=self.kind)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in lists], dtype=np.int64)])
        begin = np.cumsum(sizes) - sizes + len(self.flat)
        both = np.concatenate([self.flat, flat])
        out_starts, out_sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        had = at >= 0
        out_starts[had], out_sizes[had] = self.starts[at[had]], self.sizes[at[had]]
        out_starts[new], out_sizes[new] = begin, sizes
        if len(self.keys) + len(new) <= REMEMBERED:
            order = np.argsort(keys[new])
            where = np.searchsorted(self.keys, keys[new][order])
            self.keys = np.insert(self.keys, where, keys[new][order])
            self.starts = np.insert(self.starts, where, begin[order])
            self.sizes = np.insert(self.sizes, where, sizes[order])
            self.flat = both
        return out_starts, out_sizes, both

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end`` if given, and where each row's begin."""
        ids, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for _, _, part, at in pieces(data, offsets, ENCODED):
            found, units = [], 0
            for a, _, small, near in pieces(part, at):  # what fits a CPU's cache
                starts, ends, rows, careful = _split(small, near)
                found.append((starts + at[a], ends + at[a], rows[:-1] + units, careful, span_hashes(small, starts, ends)))
                units += len(starts)
            starts, ends, rows, careful, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = np.append(rows, units)
            keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            begin, sizes, flat = self._units(part, starts[first], ends[first], careful[first], keys)
            if end is not None:
                begin, sizes, flat = np.append(begin, len(flat)), np.append(sizes, 1), np.append(flat, self.kind(end))
                which = np.insert(which, rows[1:], len(begin) - 1)
                rows = rows + np.arange(len(rows))
            ids.append(flat[ragged(begin[which], sizes[which])])
            counts.append(np.diff(np.concatenate([[0], np.cumsum(sizes[which])])[rows]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, where each row's begin, and which are words that need care."""
    starts, ends, _ = spans(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    kind = KIND[data]
    lead = data == 0xC3
    if lead.any():
        letter = np.zeros_like(lead)
        letter[1:] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[letter] = LETTER
        lead[:-1] &= letter[1:]
        lead[-1] = False
        kind[lead] = LETTER
    other = kind == OTHER
    careful = np.zeros(len(starts), dtype=bool)
    # within words without care, a unit starts where the kind changes and at each digit
    new = np.zeros(len(data), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new &= kind != SPACE
    if other.any():
        careful[np.searchsorted(starts, np.flatnonzero(other), side="right") - 1] = True
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[starts[careful]] += 1
        inside[ends[careful]] -= 1
        new[np.cumsum(inside[:-1], dtype=np.int8) > 0] = False
    new[starts] = True
    unit = np.flatnonzero(new)
    word = np.searchsorted(starts, unit, side="right") - 1
    unit_ends = np.minimum(np.append(unit[1:], len(data)), ends[word])
    return unit, unit_ends, np.searchsorted(unit, offsets), careful[word]
