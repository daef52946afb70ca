"""Texts cut at plain spaces and line feeds into pieces that a byte-level tokenizer never joins.

The public byte-level pre-tokenizer starts a new pre-token at a space that a word or mark follows,
and on both sides of a single line feed between such characters. So a text's ids are the ids
of its pieces in a row, and a table of pieces does most of the work. Where white space meets
white space, or a piece starts or ends with a character that might count as such, the cut might
not hold: then the whole text is encoded at once.

A group of texts is cut, and its distinct pieces are found, by Arrow; only those are looked up one
by one, and the ids of all texts are gathered by numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks of a piece after a line feed, of the first one, and of the end; a text that holds them is not cut.
AFTER_LF, AT_START, AT_END = "\x01", "\x02", "\x03"
#: Trailing marks are pre-tokens of their own after letters, so a word is encoded once for all of them.
MARKS = "!#$%&*,.:;?|"
#: Pieces that a worker's table holds; when it is full it starts anew.
PIECES = 600_000
#: Letters, numbers and visible ASCII are no white space in any version of Unicode.
_SOLID = r"^[\x01\x02]?(?:[\pL\pN!-~]|[\pL\pN!-~].*[\pL\pN!-~])$"
_LETTERS = r"^[\x01\x02]?\pL+$"
_UNKNOWN, _OPEN = -1, -2


def _flags(x: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


class PieceTable:
    """Pieces and their ids. A piece is a word and the marks behind it: two places in one array of ids.

    ``encode`` gives the ids of some strings in one array with the place and number of each string's;
    strings are free of line feeds but for a leading one, if they are more than one.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], end: int | None = None, size: int = PIECES) -> None:
        self.encode, self.end, self.size = encode, end, size
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}  # piece -> place of its word, and of its marks in the upper half
        self.places: dict[str, int] = {}  # string -> place
        self.used = self.n_ids = 0
        self.at, self.n, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)
        self._put(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64))  # place 0 is empty
        if self.end is not None:
            self._put(np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64))
        self.codes[AT_END] = self.used - 1

    def _put(self, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> int:
        """Append strings; the place of the first."""
        first = self.used
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(n) > len(self.n):
            self.at, self.n = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.n))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[first : first + len(n)], self.n[first : first + len(n)] = at + self.n_ids, n
        self.used, self.n_ids = first + len(n), self.n_ids + len(ids)
        return first

    def _places(self, texts: list[str]) -> np.ndarray:
        """Places of strings; new ones are encoded in one call."""
        known = self.places
        if new := [t for t in dict.fromkeys(texts) if t not in known]:
            known.update(zip(new, range(self._put(*self.encode(new)), self.used)))
        return np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))

    def _learn(self, keys: pa.Array) -> np.ndarray:
        """Codes of new pieces."""
        solid, word = _flags(keys, _SOLID), pc.utf8_rtrim(keys, characters=MARKS)
        marked = solid & _flags(word, _LETTERS) & pc.less(pc.binary_length(word), pc.binary_length(keys)).to_numpy(zero_copy_only=False)
        names = _strings(keys)
        text = pc.replace_substring_regex(pc.if_else(pa.array(marked), word, keys), "^([^\x01\x02])", " \\1")
        text = _strings(pc.replace_substring(pc.replace_substring(text, AT_START, ""), AFTER_LF, "\n"))
        codes = np.full(len(names), _OPEN, np.int64)
        where = np.flatnonzero(solid)
        codes[where] = self._places([text[k] for k in where])
        where, words = np.flatnonzero(marked), _strings(word)
        codes[where] |= self._places([names[k][len(words[k]) :] for k in where]) << 32
        self.codes.update(zip(names, codes.tolist()))
        return codes

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (each with the end id, if there is one), and their number in each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.codes) > self.size:
            self._clear()
        column = pa.array(texts, pa.large_string())
        mark = lambda x: pa.scalar(x, pa.large_string())
        whole = _flags(column, "[\x01-\x03]")
        keyed = pc.binary_join_element_wise(mark(AT_START), pc.replace_substring(column, "\n", " " + AFTER_LF), mark(" " + AT_END), mark(""))
        lists = pc.split_pattern(keyed, " ")
        offsets = lists.offsets.to_numpy()
        found = lists.flatten().dictionary_encode()
        codes = np.fromiter(map(self.codes.get, _strings(found.dictionary), repeat(_UNKNOWN)), np.int64, len(found.dictionary))
        if len(new := np.flatnonzero(codes == _UNKNOWN)):
            codes[new] = self._learn(found.dictionary.take(pa.array(new)))
        codes = codes[found.indices.to_numpy()]
        whole[np.searchsorted(offsets, np.flatnonzero(codes == _OPEN), "right") - 1] = True
        before = self.used, self.n_ids
        for k in np.flatnonzero(whole):
            codes[offsets[k] : offsets[k + 1] - 1] = 0
            if texts[k]:
                codes[offsets[k]] = self._put(*self.encode([texts[k]]))
        places = np.empty(2 * len(codes), np.int64)
        places[0::2], places[1::2] = codes & 0xFFFFFFFF, codes >> 32
        n = self.n[places]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[places] - (ends - n), n) + np.arange(ends[-1])]
        self.used, self.n_ids = before  # whole texts are not kept
        return ids, np.add.reduceat(n, 2 * offsets[:-1])
