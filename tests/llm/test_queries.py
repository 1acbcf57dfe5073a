"""The registered queries on a small folder of tables: every column that their contracts name, against plain code."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import bpe, media, quality, queries

tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "cat", "naïve", "BUY!!", "x1", "mats.", "é", "|", "\n", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    out = [(i * 7 % 997, t, rng.choice(["a", "b", "c", "", None])) for i, t in enumerate(texts)]
    return [*out, (2000, None, "a"), (2001, "", "b"), (2002, "long " * 40_000, "c"), (2003, "  \t ", None), (2004, out[0][1], "a"), (2005, "ends  ", "a")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    # Columns named like ones that the operators make.
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("lang", "media", "ids", "size", "taken", "feature", "key", "n_removed", "score"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.repartition(5).write.parquet(f"{to}/documents.parquet")
    labels = [(i, int("cat" in (t or ""))) for i, t, _ in rows]
    spark.createDataFrame([*labels, *labels[:20], (5000, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{to}/labels.parquet")
    return to


@pytest.fixture(scope="module")
def encoded(rows):
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    return ids, {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def test_op2(spark, folder, encoded):
    ids, texts = encoded
    got = {tuple(r) for r in queries.op2_bpe_round_trip(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}


def test_op3(spark, folder, encoded):
    want, start = set(), 0
    for i, x in sorted(encoded[0].items()):
        want.add((i, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        start += len(x) + 1
    assert {tuple(r) for r in queries.op3_token_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op6(spark, folder, rows):
    got = queries.op6_source_mix(spark, folder).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in {x for *_, x in rows}}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    # The level at which the sources' capped shares add up, by bisection.
    goal, low, high = min(1.5, 2) * sum(total.values()), 0.0, 10.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], weight[s] * level) for s in total) < goal else (low, level)
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == sizes[r.doc_id] and r.source_size == total[s] and abs(r.target - min(2 * total[s], weight[s] * level)) < 1e-3 and 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    targets = {source[r.doc_id]: r.target for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 0.51 for s in total)
    assert sorted(map(repr, got)) == sorted(map(repr, queries.op6_source_mix(spark, folder).collect()))
    # What is taken goes to one shard, and shards get nearly equal numbers of blocks' documents.
    assert all((r.shard is None) == (r.taken == 0) and (r.place is None) == (r.taken == 0) for r in got)


def plain_picture(raw: bytes) -> tuple[bytes, bytes, np.ndarray]:
    """A PNG read by the letter of its definition: payload, file, and samples as rows of pixels."""
    at, packed, head = 8, b"", b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        head, packed = (body, packed) if kind == b"IHDR" else (head, packed + body if kind == b"IDAT" else packed)
        at += 12 + n
    width, height = struct.unpack(">II", head[:8])
    lines, above, out = zlib.decompress(packed), bytes(3 * width), []
    for y in range(height):
        kind, line = lines[y * (3 * width + 1)], bytearray(lines[y * (3 * width + 1) + 1 : (y + 1) * (3 * width + 1)])
        for x in range(3 * width):
            a, b, c = line[x - 3] if x > 2 else 0, above[x], above[x - 3] if x > 2 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        out.append(bytes(line))
        above = bytes(line)
    return b"".join(out), raw, np.frombuffer(b"".join(out), np.uint8).reshape(height, width, 3)


def plain_hash(pixels: np.ndarray) -> str:
    grey = pixels.astype(float).sum(axis=2)

    def shrink(x):
        edges = [k * len(x) // 32 for k in range(33)]
        return np.array([x[a:b].mean(axis=0) if len(x) >= 32 else x[a] for a, b in zip(edges[:-1], edges[1:], strict=True)])

    small = shrink(shrink(grey).T).T
    wave = [[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    low = np.array([round(sum(small[y, x] * wave[u][y] * wave[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)])
    return f"{int(''.join('01'[int(v > np.median(low[1:]))] for v in low), 2):016x}"


def test_op9(spark, folder, rows):
    made = {r.doc_id: bytes(r.media) for r in media.with_png(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    kinds, want = set(), {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        if len(raw) < 5000:
            got, file, pixels = plain_picture(made[i])
            assert got == payload
            want[i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), plain_hash(pixels))
        kinds |= set(media.lines_of(made[i])[0][:, 0].tolist())
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    found = {r.doc_id: tuple(r[c] for c in columns) for r in queries.op9_media_columns(spark, folder).collect()}
    assert {i: found[i] for i in want} == want and len(found) == len(rows) and found[2004] == found[rows[0][0]]
    assert len(kinds) > 2  # rows take different filters
    # A column named like one that is made doesn't disturb.
    assert media.read_png(media.with_png(spark.read.parquet(f"{folder}/documents.parquet"))).columns.count("feature") == 1


def test_op10(spark, folder, rows):
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, folder).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= quality.THRESHOLD)
    assert got[2000].score == got[2001].score and got[2004].score == got[rows[0][0]].score
    # Labels of the held-out rows, lang and source have no say.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("quality", F.when(quality.fold("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality.fit_on_labels(docs.select("doc_id", "text"), labels)
    assert {r.doc_id: r.score for r in quality.scored(docs.select("doc_id", "text").repartition(3), model).collect()} == {i: r.score for i, r in got.items()}
