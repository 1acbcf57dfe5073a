"""Cut texts at single spaces into pieces that tokenize independently, and keep the ids of pieces seen before.

With the usual byte-level pattern (optional space, then letters, numbers or other marks; white-space runs give
their last character to what follows) no token holds a space after another character, so a text may be cut before
each space as long as no run of three white-space characters occurs, nor one of two at the end: there, and around
special tokens, the run itself is one token and the whole text goes to the tokenizer instead.

Texts are cut as byte arrays. A piece of at most SHORT bytes is its own key (two 64-bit numbers), so those seen before
are found by whole arrays; longer ones are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hostlens.llm._common import ragged, strings
from hostlens.llm._tables import Memory

#: All characters that any of the libraries takes for white space; a run of three, or of two at the end.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUN = f"[{SPACE}]{{3}}|[{SPACE}]{{2}}\\z"
#: A space, then text without white space at its ends: such pieces can stand in a row and don't affect each other.
CLEAN = rf"\A [^{SPACE}]\z|\A [^{SPACE}](?s:.*)[^{SPACE}]\z"
SHORT = 15  #: bytes, without the space at the beginning
SLOTS = 19  #: bits: so many short pieces are remembered
MOST_IDS, MOST_LONG = 2_000_000, 4 << 20  #: ids, and bytes of long pieces, from which on all pieces are forgotten
CALL = 65_536  #: pieces that are encoded at a time

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  #: ids, and where each piece's run of them starts and how long it is


def runs(ids: list[list[int]]) -> Runs:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes


def column_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column of the given runs of UTF-8 bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[ragged(starts, lengths)])])


def clean_rows(texts: pa.Array, special: tuple[str, ...]) -> np.ndarray:
    """Which texts are CLEAN and hold no special token."""
    clean = pc.match_substring_regex(texts, CLEAN)
    for s in special:
        clean = pc.and_(clean, pc.invert(pc.match_substring(texts, s)))
    return clean.to_numpy(zero_copy_only=False)


class PieceEncoder:
    """Ids of texts by way of ``encode_many`` (a string column to Runs) for unseen pieces."""

    def __init__(self, encode_many: Callable[[pa.Array], Runs], special: tuple[str, ...] = (), bits: int = SLOTS, most: int = MOST_IDS):
        self.encode_many, self.special, self.bits, self.most = encode_many, special, bits, most
        self._forget()

    def _forget(self) -> None:
        self.seen = Memory(self.bits, 2, np.int64)  # a value is start << 32 | length of a run of ids
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.ids = [np.empty(0, np.int32)]
        self.n = 0

    def _added(self, column: pa.Array) -> np.ndarray:
        """Encode the pieces of a column; where their ids are."""
        values = np.empty(len(column), np.int64)
        for i in range(0, len(column), CALL):
            ids, starts, lengths = self.encode_many(column.slice(i, CALL))
            values[i : i + CALL] = (starts + self.n) << 32 | lengths
            self.ids.append(ids)
            self.n += len(ids)
        return values

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and the number of ids of each."""
        if self.n > self.most or self.long_bytes > MOST_LONG:
            self._forget()
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, RUN)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        data, offsets = strings(texts)
        start, length, counts = self._cut(data, offsets, whole)
        values = np.empty(len(start), np.int64)
        spaced = np.zeros(len(start), np.int64)
        spaced[length > 0] = data[start[length > 0]] == 32
        bare = length - spaced
        self._short(data, start, spaced, bare, values, np.flatnonzero(bare <= SHORT))
        first = np.cumsum(counts) - counts  # a text that goes as a whole is one piece
        of_whole = np.zeros(len(start), bool)
        of_whole[first[whole]] = True
        self._long(data, start, length, values, np.flatnonzero((bare > SHORT) & ~of_whole))
        if len(whole):
            values[first[whole]] = self._added(texts.take(pa.array(whole)))
        ids, sizes = self.ids[0] if len(self.ids) == 1 else np.concatenate(self.ids), values & 0xFFFFFFFF
        self.ids = [ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids[ragged(values >> 32, sizes)], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each piece, and the number of pieces of each text: cut before each space."""
        cut = data == 32
        for k in whole:
            cut[offsets[k] : offsets[k + 1]] = False
        inner = np.flatnonzero(cut)
        text = np.searchsorted(offsets, inner, "right") - 1
        heads = offsets[:-1]
        new = np.ones(len(inner), bool) if not len(inner) else inner != heads[text]
        inner, text = inner[new], text[new]  # a text that begins with a space begins with that piece
        counts = np.bincount(text, minlength=len(heads)) + 1
        start = np.empty(len(inner) + len(heads), np.int64)
        at = np.cumsum(counts) - counts
        head = np.zeros(len(start), bool)
        head[at] = True
        start[head], start[~head] = heads, inner
        length = np.diff(np.append(start, len(data)))
        return start, length, counts

    def _short(self, data: np.ndarray, start: np.ndarray, spaced: np.ndarray, bare: np.ndarray, values: np.ndarray, pick: np.ndarray) -> None:
        words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        begin, size = (start + spaced)[pick], bare[pick]
        low = words[begin] & MASK[np.minimum(size, 8)]
        high = np.where(size > 8, words[np.minimum(begin + 8, len(data))], 0) & MASK[np.clip(size - 8, 0, 8)]
        high |= (size + 16 * spaced[pick]).astype(np.uint64) << np.uint64(56)
        slot = self.seen.slots(low, high)
        known = self.seen.known(slot, low, high)
        found = self.seen.values[slot]
        new = np.flatnonzero(~known)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            head = np.ones(len(order), bool)
            head[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[head]
            made = self._added(column_of(data, start[pick][one], (bare + spaced)[pick][one]))
            found[order] = made[np.cumsum(head) - 1]
            self.seen.put(slot[one], made, low[one], high[one])
        values[pick] = found

    def _long(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, values: np.ndarray, pick: np.ndarray) -> None:
        raw = [data[s : s + n].tobytes() for s, n in zip(start[pick], length[pick], strict=True)]
        new = list(dict.fromkeys(x for x in raw if x not in self.long))
        if new:
            self.long_bytes += sum(map(len, new))
            self.long.update(zip(new, self._added(pa.array(new, pa.large_binary()).cast(pa.large_string())).tolist(), strict=True))
        values[pick] = np.fromiter(map(self.long.__getitem__, raw), np.int64, len(raw))


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
