"""Token ids in a binary file format of patched frame-of-reference blocks, written in document order and read back.

A shard image holds the ids of some documents in a row:

    magic "TFR1", u32: block size, ids, documents, blocks, packed bytes, exceptions
    i64 doc_id of each document, a bit for each that says whether the doc_id is null, u32 number of ids of each
    u32 minimum of each block, u8 bit width of each block
    u32 byte offset of each block and one more for the end, u32 first exception of each block and one more
    packed words of 64 bits, u8 positions of the exceptions in their blocks, u32 values of the exceptions

A block stores its ids less the block's minimum. The width is what a percentile of the block's values needs (so that
a few large ids don't widen all); larger values are outliers, stored whole in the exception list. Block starts let a
reader decode any run of ids alone. Integers are little-endian; the last block is filled up with its minimum.

A store is a table of shard images under the shared folder, written by Spark's committer, so a lost executor's shard
is simply written again. Documents are in ascending doc_id order across shards: null first, equal ids by a hash of
their texts, so that a store is the same each time and an id of very many rows is spread over tasks. Null texts are
empty, so they hold the end id only; other columns don't get into a store. A document has less than 2^29 ids, as a
binary value of Spark holds 2 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm._common import mapped, partitions, ragged, saved, shared_dir, slices, small, strings
from hostlens.llm.bpe import LARGE, byte_letters, tokenizer_path
from hostlens.llm.pieces import PieceEncoder, Runs, clean_rows, runs

MAGIC = b"TFR1"
BLOCK = 256
PERCENTILE = 92  #: of a block's values that the packed width must hold
SHARD_IDS = 1 << 20  #: a shard image is closed when it has so many ids
END = 2  #: id appended to each document
SHARDS = "shard_part int, shard_seq long, before long, n_docs long, n_ids long, image binary"


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 k numbers below 2^width as rows of k * width little-endian 64-bit words, lowest bits first.

    Numbers at one place of their group of 64 have the same words and shifts, so 64 steps do for any number of rows.
    """
    rows = len(values)
    places = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, places.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= places[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= places[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(rows, -1)


def unpacked_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The numbers of ``packed_bits``."""
    rows = len(words)
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    places, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[word + 1] << np.uint64(64 - shift)
        places[i] = x & mask
    return np.ascontiguousarray(places.T).reshape(rows, -1)


def encode_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A shard image of documents (masked doc_ids are null) with ``counts`` ids each."""
    if block % 64 or not 0 < block <= 256:
        raise ValueError("a block holds 64, 128, 192 or 256 ids")
    n = len(ids)
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    used = np.minimum(block, n - np.arange(blocks) * block)
    if blocks:
        grid[-1, used[-1] :] = grid[-1, : used[-1]].min()
    least = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = grid - least[:, None]
    k = min(block - 1, block * percentile // 100)
    at = np.partition(rest, k, axis=1)[:, k] if blocks else np.empty(0, np.uint32)
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    large = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    sizes = width.astype(np.int64) * block // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(starts[-1]) // 8, "<u8")
    row, position = np.nonzero(large)
    value = rest[large]
    rest[large] = 0
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed[ragged(starts[rows] // 8, sizes[rows] // 8)] = packed_bits(rest[rows], int(w)).ravel()
    exceptions = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))]) if blocks else np.zeros(1)
    missing = np.packbits(np.ma.getmaskarray(doc_ids), bitorder="little")
    doc_ids = np.ma.filled(doc_ids, 0)
    head = MAGIC + struct.pack("<6I", block, n, len(doc_ids), blocks, packed.nbytes, len(row))
    columns = (doc_ids, "<i8"), (missing, "u1"), (counts, "<u4"), (least, "<u4"), (width, "u1"), (starts, "<u4"), (exceptions, "<u4"), (packed, "<u8"), (position, "u1"), (value, "<u4")
    return head + b"".join(np.asarray(x).astype(kind).tobytes() for x, kind in columns)


def _sections(image: bytes) -> dict[str, np.ndarray | int]:
    if bytes(image[:4]) != MAGIC:
        raise ValueError("not a shard image")
    block, n, docs, blocks, packed, large = struct.unpack_from("<6I", image, 4)
    out: dict = {"block": block, "n": n}
    at = 28
    sizes = (("doc_ids", "<i8", docs), ("missing", "u1", -(-docs // 8)), ("counts", "<u4", docs), ("least", "<u4", blocks), ("width", "u1", blocks), ("starts", "<u4", blocks + 1), ("exceptions", "<u4", blocks + 1), ("packed", "<u8", packed // 8), ("position", "u1", large), ("value", "<u4", large))
    for name, kind, count in sizes:
        out[name] = np.frombuffer(image, kind, count, at)
        at += out[name].nbytes
    if at != len(image):
        raise ValueError("wrong size of a shard image")
    return out


def decode_image(image: bytes, first_block: int = 0, end_block: int | None = None) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """doc ids (masked: null), numbers of ids, and the ids of the blocks asked for (all by default)."""
    s = _sections(image)
    block, blocks = s["block"], len(s["least"])
    stop = blocks if end_block is None else min(end_block, blocks)
    pick = np.arange(first_block, stop)
    grid = np.zeros((len(pick), block), np.uint32)
    width, starts = s["width"][pick], s["starts"].astype(np.int64)[pick] // 8
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        size = int(w) * block // 64
        grid[rows] = unpacked_bits(s["packed"][ragged(starts[rows], np.full(len(rows), size))].reshape(len(rows), -1), int(w))
    lists = s["exceptions"].astype(np.int64)
    if len(pick):
        a, z = lists[pick[0]], lists[pick[-1] + 1]
        row = np.repeat(np.arange(len(pick)), np.diff(lists[pick[0] : pick[-1] + 2]))
        grid[row, s["position"][a:z]] = s["value"][a:z]
    ids = (grid + s["least"][pick][:, None]).ravel()
    null = np.unpackbits(s["missing"], count=len(s["doc_ids"]), bitorder="little").astype(bool)
    return np.ma.masked_array(s["doc_ids"], null), s["counts"].astype(np.int64), ids[: max(0, s["n"] - first_block * block)]


@cache
def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library behind a cache of pieces; one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    letters = byte_letters()
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token) if all(c in letters for c in token) else LARGE

    def encode_many(texts: pa.Array) -> Runs:
        """Clean pieces go in rows of many to save calls; token sizes tell where each ends. The others go one by one."""
        clean = clean_rows(texts, special)
        starts, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        flat, total = [np.empty(0, np.int32)], 0
        at = np.flatnonzero(clean)
        rows = [at[i : i + 2000] for i in range(0, len(at), 2000)]
        cuts = [strings(texts.take(pa.array(row))) for row in rows]
        for row, (_, offsets), x in zip(rows, cuts, tokenizer.encode_batch_fast([data.tobytes().decode() for data, _ in cuts], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.int32)
            ends = np.cumsum(sizes[ids])
            last = np.searchsorted(ends, offsets[1:])
            if ends[-1] != offsets[-1] or (ends[last] != offsets[1:]).any():
                clean[row] = False
                continue
            counts[row] = np.diff(last, prepend=-1)
            starts[row] = total + np.cumsum(counts[row]) - counts[row]
            flat.append(ids)
            total += len(ids)
        alone = np.flatnonzero(~clean)
        for i in range(0, len(alone), 2000):
            some = alone[i : i + 2000]
            ids, begins, counts[some] = runs([x.ids for x in tokenizer.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False)])
            starts[some] = total + begins
            flat.append(ids)
            total += len(ids)
        return np.concatenate(flat), starts, counts

    return PieceEncoder(encode_many, special, 20)


def write_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END, path: str | None = None, tokenizer: str | None = None) -> str:
    """Encode texts (null: empty), each with the id ``end`` after it, and write the store; returns its folder."""
    spark = docs.sparkSession
    tokenizer = tokenizer_path(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs), "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, encoder = TaskContext.get().partitionId(), 0, 0, library_encoder(tokenizer)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                ids, counts = encoder(piece.column("text"))
                spots = np.cumsum(counts)
                names = piece.column("id")
                held.append((np.ma.masked_array(names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)), counts + 1, np.insert(ids, spots, end)))
                if sum(len(x[2]) for x in held) >= SHARD_IDS:
                    yield shard(part, seq, before, held)
                    seq, before, held = seq + 1, before + sum(len(x[2]) for x in held), []
        if held:
            yield shard(part, seq, before, held)

    def shard(part: int, seq: int, before: int, held: list) -> pa.RecordBatch:
        doc_ids, counts, ids = (join(x) for join, x in zip((np.ma.concatenate, np.concatenate, np.concatenate), zip(*held, strict=True), strict=True))
        row = [[part], [seq], [before], [len(doc_ids)], [len(ids)], [encode_image(doc_ids, counts, ids)]]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["shard_part", "shard_seq", "before", "n_docs", "n_ids", "image"])

    path = path or f"{shared_dir(spark)}/tokens"
    ordered.transform(mapped, run, SHARDS).write.option("compression", "none").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("shard_part").agg(F.sum("n_ids").alias("n"))
    # One row per task of the writing job, whatever the corpus holds.
    base = small(saved(parts.select("shard_part", (F.sum("n").over(W.orderBy("shard_part")) - F.col("n")).alias("base")), "bases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, ids = decode_image(batch.column("image")[k].as_buffer())
                ends = np.cumsum(counts)
                data, starts = ids.astype("<u4"), ends - counts
                offsets = np.concatenate([[0], ends]) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                part = pa.array(np.full(len(counts), batch.column("shard_part")[k].as_py()), pa.int32())
                starts = starts + batch.column("before")[k].as_py()
                yield pa.RecordBatch.from_arrays([part, pa.array(doc_ids.data, pa.int64(), mask=doc_ids.mask), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), packed], ["shard_part", "doc_id", "start", "n_tokens", "ids"])

    rows = shards.select("shard_part", "before", "image").transform(mapped, run, "shard_part int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(base, "shard_part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
