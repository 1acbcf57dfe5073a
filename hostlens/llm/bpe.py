"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word one token only can come last in the prefix's encoding. Candidates are the vocabulary's
tokens that are suffixes of the prefix (found by an automaton in one pass over the word); the right one is the token
that is compatible with the last token of the prefix before it. Following these back-pointers from the whole word
gives exactly the ids that applying all merges in rank order gives.

Null and empty texts have no ids; special tokens in a text become their own ids, as the tokenizer file says.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostlens.llm._common import mapped, ragged, slices, strings, trim
from hostlens.llm._tables import Memory, Table
from hostlens.llm.pieces import PieceEncoder, Runs, clean_rows

TOKENIZER = "byte_bpe_50k.json"
#: The pattern of the byte-level pre-tokenizer; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LARGE = 1 << 60
FITS = 20  #: bits: so many answers whether a token can follow another are remembered
TABLE = 1 << 20  #: prefixes of words that are worked on at a time


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizer files write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Suffixes:
    """The automaton of the tokens: its state after some bytes stands for their longest suffix that begins a token.

    Arrays step many words at a time. ``longest[state]`` is the longest token that the bytes end with, ``shorter[token]``
    the next longest.
    """

    def __init__(self, tokens: dict[bytes, int], size: int):
        found: dict[bytes, int] = {b"": 0}
        for token in tokens:
            for end in range(1, len(token) + 1):
                found.setdefault(token[:end], len(found))
        self.fail, self.longest = np.zeros(len(found), np.int64), np.full(len(found), -1, np.int64)
        self.shorter = np.full(size, -1, np.int64)
        edges = np.array([(found[x[:-1]] << 8 | x[-1], state) for x, state in found.items() if x], np.int64).reshape(-1, 2)
        self.edges = Table(edges[:, 0].astype(np.uint64), edges[:, 1])
        for x, state in sorted(found.items(), key=lambda e: len(e[0])):
            if not x:
                continue
            self.fail[state] = next(found[x[i:]] for i in range(1, len(x) + 1) if x[i:] in found)
            below = self.longest[self.fail[state]]
            if x in tokens:
                self.longest[state], self.shorter[tokens[x]] = tokens[x], below
            else:
                self.longest[state] = below

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        after = self.edges.get((state << 8 | byte).astype(np.uint64)).astype(np.int64)
        lost = np.flatnonzero(after < 0)
        state = state[lost]
        while len(lost):
            deeper = state > 0
            after[lost[~deeper]] = 0  # no token begins with the byte
            lost, state = lost[deeper], self.fail[state[deeper]]
            after[lost] = self.edges.get((state << 8 | byte[lost]).astype(np.uint64))
            still = after[lost] < 0
            lost, state = lost[still], state[still]
        return after


class PrefixEncoder:
    """Encoder and decoder of one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {token: bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            bytes_of[i] = raw.get(token, b"")
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.sizes = np.fromiter(map(len, bytes_of), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.left, self.right, self.born = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs = np.empty(len(spec["model"]["merges"]), np.uint64)
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            pairs[rank] = a << 32 | b
            if self.born[whole] < 0:
                self.left[whole], self.right[whole], self.born[whole] = a, b, rank
        _, first = np.unique(pairs[::-1], return_index=True)  # of a pair that is listed again the last rank holds
        last = len(pairs) - 1 - first
        self.rank = Table(pairs[last], last)
        self.suffixes = Suffixes({b: vocab[token] for token, b in raw.items() if len(b) == 1 or self.born[vocab[token]] >= 0}, size)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits = Memory(FITS)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b can follow its a: no pair of tokens that meet at the seam while both are built merges.

        The tokens at the seam are a and its right parts, b and its left parts, each until the rank at which it is
        absorbed. A pair of equal rank on the left goes first, one on the right goes after.
        """
        good = np.ones(len(a), bool)
        row, x, x_until = np.arange(len(a)), a, np.full(len(a), LARGE)
        while len(row):
            at, left, y, y_until = row, x, b[row], np.full(len(row), LARGE)
            x_end = x_until
            while len(at):
                rank = self.rank.get((left << 32 | y).astype(np.uint64)).astype(np.int64)
                good[at[(rank >= 0) & (rank < x_end) & (rank <= y_until)]] = False
                more = good[at] & (self.born[y] >= 0)
                at, left, x_end, y = at[more], left[more], x_end[more], y[more]
                y_until, y = self.born[y], self.left[y]
            more = good[row] & (self.born[x] >= 0)
            row, x = row[more], x[more]
            x_until, x = self.born[x], self.right[x]
        return good

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible``, remembered."""
        key = (a << 32 | b).astype(np.uint64)
        slot = self.fits.slots(key)
        new = np.flatnonzero(~self.fits.known(slot, key))
        found = self.fits.values[slot].astype(bool)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[first]
            good = self.compatible(a[one], b[one])
            found[new] = good[back]
            self.fits.put(slot[one], good, key[one])
        return found

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Runs:
        """Ids of pre-tokens, given as runs of bytes."""
        counts, where = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        out, total = [np.empty(0, np.int32)], 0
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            # Words of like lengths go together; the table of last tokens stays below TABLE numbers.
            some = order[at : at + max(1, TABLE // int(lengths[order[at]] + 1))]
            ids, counts[some] = self._chunk(data, starts[some], lengths[some])
            where[some] = total + np.cumsum(counts[some]) - counts[some]
            out.append(ids)
            total += len(ids)
            at += len(some)
        return np.concatenate(out), where, counts

    def _chunk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in order of length, longest first: the last token of every prefix, then the way back from the ends."""
        n, most = len(starts), int(lengths[0]) if len(lengths) else 0
        last = np.full((most + 1, n), -1, np.int32)
        state = np.zeros(n, np.int64)
        longer = n - np.searchsorted(lengths[::-1], np.arange(most), "right")  # words that have a byte at each place
        shorter, longest, sizes = self.suffixes.shorter, self.suffixes.longest, self.sizes
        for place in range(most):
            m = longer[place]
            state[:m] = self.suffixes.step(state[:m], data[starts[:m] + place])
            word, token = np.arange(m), longest[state[:m]]
            while len(word):
                begin = place + 1 - sizes[token]
                before = last[begin, word]
                good = begin == 0
                ask = np.flatnonzero(before >= 0)
                good[ask] = self._fit(before[ask].astype(np.int64), token[ask])
                last[place + 1, word[good]] = token[good]
                word, token = word[~good], shorter[token[~good]]
                word, token = word[token >= 0], token[token >= 0]
        back: list[tuple[np.ndarray, np.ndarray]] = []
        word, at = np.arange(n), lengths.copy()
        while True:
            word, at = word[at > 0], at[at > 0]
            if not len(word):
                break
            token = last[at, word]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            back.append((word, token))
            at = at - sizes[token]
        counts = np.zeros(n, np.int64)
        for word, _ in back:
            counts[word] += 1
        ids, ends = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for turn, (word, token) in enumerate(back):
            ids[ends[word] - 1 - turn] = token
        return ids, counts

    def _found(self, words: list[str]) -> Runs:
        """Ids of pre-tokens and special tokens; repeated ones are worked out once."""
        table = pa.array(words, pa.large_string()).dictionary_encode()
        data, offsets = strings(table.dictionary)
        ids, starts, counts = self.words(data, offsets[:-1], np.diff(offsets))
        for token, i in self.special.items():  # the pattern never takes one for a pre-token
            k = pc.index(table.dictionary, pa.scalar(token, pa.large_string())).as_py()
            if k >= 0:
                starts[k], counts[k], ids = len(ids), 1, np.append(ids, np.int32(i))
        at = table.indices.to_numpy()
        return ids, starts[at], counts[at]

    def split(self, text: str) -> list[str]:
        """A text's pre-tokens and special tokens."""
        if not any(s in text for s in self.special):
            return self.find(text)
        return [word for part in self.cut.split(text) for word in ([part] if part in self.special else self.find(part))]

    def encode(self, text: str) -> list[int]:
        ids, starts, counts = self._found(self.split(text))
        return ids[ragged(starts, counts)].tolist()

    def encode_many(self, texts: pa.Array) -> Runs:
        """Clean pieces are split into pre-tokens in one row, as they don't affect each other; others one by one."""
        clean = clean_rows(texts, tuple(self.special))
        data, offsets = strings(texts.filter(pa.array(clean)))
        words = self.find(data.tobytes().decode())
        ends = np.cumsum(pc.binary_length(pa.array(words, pa.large_string())).to_numpy())
        last = np.searchsorted(ends, offsets[1:])
        if (ends[last] != offsets[1:]).any():
            raise ValueError("a pre-token reaches over the end of a piece")
        times = np.zeros(len(texts), np.int64)
        times[clean] = np.diff(last, prepend=-1)
        first = np.zeros(len(texts), np.int64)
        first[clean] = np.cumsum(times[clean]) - times[clean]
        for k in np.flatnonzero(~clean):
            some = self.split(texts[k].as_py())
            first[k], times[k] = len(words), len(some)
            words += some
        ids, begins, sizes = self._found(words)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids[ragged(begins, sizes)], upto[first], upto[first + times] - upto[first]

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids, one after another. Bytes that aren't UTF-8 become U+FFFD, as in the library."""
        sizes = self.sizes[ids]
        data = self.bytes[ragged(self.starts[ids], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = upto[np.concatenate([[0], np.cumsum(counts)])]
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


@cache
def prefix_encoder(path: str) -> tuple[PrefixEncoder, PieceEncoder]:
    """One encoder for each worker process, with its piece cache."""
    encoder = PrefixEncoder(path)
    trim()  # reading the file takes more memory than what is kept of it
    return encoder, PieceEncoder(encoder.encode_many, tuple(encoder.special))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None, keep_text: bool = False) -> DataFrame:
    """Add the binary column ``out``: the text's ids as little-endian 32-bit integers, and ``n_tokens``.

    Other columns pass unchanged (one named like an output is replaced).
    """
    path = tokenizer_path(path)
    kept = [f for f in df.schema.fields if f.name not in (out, "n_tokens") and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = prefix_encoder(path)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                ids, counts = pieces(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), packed_ids(ids, counts), pa.array(counts, pa.int64())], [*names, out, "n_tokens"])

    return df.select(*names, df[text_col].alias("__text")).transform(mapped, run, schema)


def packed_ids(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts * 4)])
    data = ids.astype("<u4")
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    edges = offsets // 4
    return pa.array([data[edges[i] : edges[i + 1]].tobytes() for i in range(len(counts))], pa.binary())


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the string column ``out``: the text that a column of packed ids stands for (null ids: null)."""
    path = tokenizer_path(path)
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = prefix_encoder(path)
        for batch in batches:
            for part in slices(batch, ids_col, 1 << 20):
                packed = part.column(ids_col).cast(pa.large_binary())
                counts = pc.fill_null(pc.binary_length(packed), 0).to_numpy().astype(np.int64) // 4
                ids = np.frombuffer(b"".join(x.as_buffer() for x in packed if x.is_valid), "<u4").astype(np.int64)
                texts = pc.if_else(packed.is_valid(), encoder.decode_many(ids, counts), pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), texts.cast(pa.string())], [*names, out])

    return df.select(*names).transform(mapped, run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
