"""Media columns: PNG files in binary columns, read back with checks, and perceptual hashes of them.

``with_png`` stores a text as an 8-bit RGB picture 64 pixels wide, each row by the filter that suits it; ``read_png``
reads pictures back (any of the five row filters, any split of the data into chunks, every checksum tested) and adds a
low-frequency cosine-transform hash. A picture that fails a test raises in strict mode and gives nulls otherwise.
Null texts count as empty; equal texts give equal pictures; other columns are kept untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostlens.llm._common import mapped, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 192  #: bytes of a picture row: 64 pixels of three samples
CHUNK = 1 << 20  #: most bytes in a data chunk
LEVEL = 1
SIDE, LOW = 32, 8  #: the hash shrinks a picture to SIDE x SIDE and keeps LOW x LOW coefficients


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes, to: int = ROW) -> bytes:
    """raw with bytes 32 appended up to a positive multiple of ``to``."""
    return raw + b" " * (-len(raw) % to or (0 if raw else to))


def _guesses(rows: np.ndarray, first: np.ndarray, pixel_bytes: int) -> Iterator[np.ndarray]:
    """What each of the five filters expects of all rows. ``first``: rows at the top of a picture."""
    yield np.zeros_like(rows)
    left = np.zeros_like(rows)
    left[:, pixel_bytes:] = rows[:, :-pixel_bytes]
    yield left
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    above[first] = 0
    yield above
    yield ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[:, pixel_bytes:] = above[:, :-pixel_bytes]
    yield _paeth(left, above, corner)


def filtered(rows: np.ndarray, first: np.ndarray, pixel_bytes: int, row_filter: int | None = None) -> np.ndarray:
    """Rows of one or more pictures as filtered lines. Of the filters a row takes the one (the first of equal ones) whose
    differences, as signed bytes, have the smallest sum; or all rows take ``row_filter``."""
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    for kind, guess in enumerate(_guesses(rows, first, pixel_bytes)):
        if row_filter in (None, kind):
            rest = rows - guess
            cost = np.minimum(rest, 0 - rest).sum(axis=1, dtype=np.int64)
            better = np.flatnonzero(cost < least)
            least[better] = cost[better]
            lines[better, 0], lines[better, 1:] = kind, rest[better]
    return lines


def png(lines: np.ndarray, pixel_bytes: int) -> bytes:
    """The file of a picture's filtered lines."""
    packed = zlib.compress(np.ascontiguousarray(lines), LEVEL)
    head = struct.pack(">IIBBBBB", (lines.shape[1] - 1) // pixel_bytes, len(lines), 8, 2 if pixel_bytes == 3 else 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def encode_png(payload: bytes, pixel_bytes: int = 3, row: int = ROW, row_filter: int | None = None) -> bytes:
    """A PNG of 8-bit samples (3: RGB, 1: grey) whose rows are ``payload`` cut into runs of ``row`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    return png(filtered(rows, np.arange(len(rows)) == 0, pixel_bytes, row_filter), pixel_bytes)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner; the first of equally near ones."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    to_a, to_b = b - c, a - c
    to_c = np.abs(to_a + to_b)
    to_a, to_b = np.abs(to_a), np.abs(to_b)
    return np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c)).astype(np.uint8)


def unfiltered(lines: np.ndarray, pixel_bytes: int, heights: np.ndarray | None = None) -> np.ndarray:
    """Undo the row filters of pictures that stand one below the other (``heights``: their rows; by default it is one).

    A pixel needs those on its left, above and between. All pixels of all pictures for which column + row is the same
    are undone at once.
    """
    kinds = lines[:, 0]
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    heights = np.array([len(lines)]) if heights is None else heights
    n, width = len(lines), (lines.shape[1] - 1) // pixel_bytes
    row = np.arange(n) - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(row, kind="stable")
    row, kinds = row[order], kinds[order]
    # One column and one row of zeros more, for the pixels beside and above a picture.
    out = np.zeros((n + 1, width + 1, pixel_bytes), np.uint8)
    out[:n, 1:] = lines[:, 1:].reshape(n, width, pixel_bytes)
    out = out.reshape(-1, pixel_bytes)
    above = np.where(row > 0, order - 1, n) * (width + 1)
    mine = order * (width + 1)
    begins = np.searchsorted(row, np.arange(int(heights.max(initial=0)) + width))
    for step in range(int(heights.max(initial=0)) + width - 1):
        low, high = begins[max(0, step - width + 1)], begins[step + 1] if step + 1 < len(begins) else n
        x = step - row[low:high] + 1
        at, up = mine[low:high] + x, above[low:high] + x
        kind = kinds[low:high]
        guess = np.zeros((high - low, pixel_bytes), np.uint8)
        for k in (1, 2, 3, 4):
            some = np.flatnonzero(kind == k)
            if len(some):
                a = out[at[some] - 1] if k != 2 else None
                b = out[up[some]] if k != 1 else None
                guess[some] = a if k == 1 else b if k == 2 else ((a.astype(np.uint16) + b) >> 1).astype(np.uint8) if k == 3 else _paeth(a, b, out[up[some] - 1])
        out[at] += guess
    return np.ascontiguousarray(out.reshape(n + 1, width + 1, pixel_bytes)[:n, 1:]).reshape(n, -1)


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """The picture's rows of samples and the samples of a pixel; ValueError if a test fails."""
    lines, pixel_bytes = lines_of(data)
    return unfiltered(lines, pixel_bytes), pixel_bytes


def lines_of(data: bytes) -> tuple[np.ndarray, int]:
    """The filtered lines of a PNG and the samples of a pixel; ValueError if a test fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise ValueError("cut off")
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or end")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in (0, 2) or interlace:
        raise ValueError("only 8-bit grey or RGB without interlacing")
    pixel_bytes = 3 if colour == 2 else 1
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width * pixel_bytes + 1):
        raise ValueError("wrong size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * pixel_bytes + 1)
    if (lines[:, 0] > 4).any():
        raise ValueError("unknown row filter")
    return lines, pixel_bytes


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


COSINES = _cosines()


def _shrunk(grid: np.ndarray) -> np.ndarray:
    """Rows averaged over SIDE equal bands (repeated where there are fewer)."""
    n = len(grid)
    edges = np.arange(SIDE + 1) * n // SIDE
    if n < SIDE:
        return grid[edges[:-1]]
    return np.add.reduceat(grid, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(rows: np.ndarray, pixel_bytes: int) -> str:
    """16 hex digits: which of the 64 low-frequency coefficients exceed the median of those but the first."""
    grey = rows.reshape(len(rows), -1, pixel_bytes).sum(axis=2, dtype=np.float64)
    small = _shrunk(_shrunk(grey).T).T
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def with_png(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Add column ``out`` (binary): the text's UTF-8 bytes, padded, as a PNG; drop the text, add ``n_bytes``."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out, "n_bytes")]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])
    names = [f.name for f in kept]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                raw = [(x or "").encode() for x in part.column("__text").to_pylist()]
                rows = [padded(x) for x in raw]
                ends = np.cumsum([len(x) // ROW for x in rows])
                first = np.zeros(ends[-1], bool)
                first[np.append(0, ends[:-1])] = True
                lines = filtered(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, ROW), first, 3)
                made = [pa.array([len(x) for x in raw], pa.int64()), pa.array([png(x, 3) for x in np.split(lines, ends[:-1])], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, "n_bytes", out])

    return df.select(*names, df[text_col].alias("__text")).transform(mapped, encode, schema)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_png(df: DataFrame, media_col: str = "media", strict: bool = True) -> DataFrame:
    """Read the pictures of a binary column back: sizes, digests and hash of each; the column itself is dropped.

    Columns named like one that is added are replaced by it.
    """
    added = T._parse_datatype_string(READ).fields
    kept = [f for f in df.schema.fields if f.name not in {media_col, *(f.name for f in added)}]
    names = [f.name for f in kept]

    def lines(data: bytes | None) -> tuple[np.ndarray, int] | None:
        try:
            if data is None:
                raise ValueError("no picture")
            return lines_of(data)
        except (ValueError, zlib.error, struct.error):
            if strict:
                raise
            return None

    def one(data: bytes, rows: np.ndarray, pixel_bytes: int) -> tuple:
        payload = rows.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(rows, pixel_bytes)

    def several(pictures: list[bytes | None]) -> list[tuple]:
        found: list[tuple] = [(None,) * 6] * len(pictures)
        alike: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for k, data in enumerate(pictures):
            if (got := lines(data)) is not None:
                alike.setdefault((got[0].shape[1], got[1]), []).append((k, got[0]))
        for (_, pixel_bytes), group in alike.items():
            heights = np.array([len(x) for _, x in group])
            rows = unfiltered(np.concatenate([x for _, x in group]), pixel_bytes, heights)
            for (k, _), x in zip(group, np.split(rows, np.cumsum(heights)[:-1]), strict=True):
                found[k] = one(pictures[k], x, pixel_bytes)
        return found

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for part in slices(batch, media_col, 1 << 20):
                columns = zip(*several(part.column(media_col).to_pylist()), strict=True)
                made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *(f.name for f in added)])

    return df.select(*names, media_col).transform(mapped, decode, T.StructType([*kept, *added]))
