"""Importance resampling: checksums, selection and the registered query against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hostlens.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(rows, target):
    """The contract's definition, one document after another."""

    def found(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [(i, *found(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in found(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], -math.inf if x[0] is None else x[0], x[1]))
    drawn = fit[: 5 * len(fit) // 100]
    return Counter((*x[:4], None) for x in out) - Counter((*x[:4], None) for x in drawn) + Counter((*x[:4], r) for r, x in enumerate(drawn, 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "Cat", "naïve", "BUY!!", "x1", "mats.", "é", "|", "\n", "don't", "9" * 70, "中文", "\x00", "a-b"]
    out = [(i * 7 % 997 - 20, " ".join(rng.choice(words) for _ in range(rng.randrange(70)))) for i in range(400)]
    again = [(7, "same words " * 20)] * 30  # rows alike, and one id on several texts
    return [*out, *again, *[(9, "target words here " * n) for n in range(5, 12)], (None, None), (None, "target words here " * 20), (3000, ""), (3001, "words " * 40_000), (3002, "?! " * 9)]


TARGET = ["target words here now", "the cat", None, ""]


def test_query(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "n_words", "score", "rank", "a", "weight", "salt", "counts"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in TARGET], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_importance_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, TARGET)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.importance_sample(docs, none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["rank"] for r in importance.importance_sample(one, none).collect()] == [None]
    assert [r["rank"] for r in importance.importance_sample(one, none, num=1, den=1, min_words=1).collect()] == [1]


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_long_texts_in_parts(rows, most):
    texts = [t for _, t in rows if len(t or "") < 5000]
    got: Counter = Counter()
    for at, found, owner, _ in importance.taken_apart(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 3, most):
        got.update(zip(at[owner].tolist(), found.tolist(), strict=True))
    want: Counter = Counter()
    for i, t in enumerate(texts):
        w = [x.encode() for x in WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))]
        want.update((i, zlib.crc32(b" ".join(w[j : j + n]))) for n in (1, 2, 3) for j in range(len(w) - n + 1))
    assert got == want


@pytest.mark.parametrize("part", [3, 1000])
def test_cutoff_key(spark, part):
    rng = random.Random(3)
    keys = sorted((rng.choice([rng.randrange(-9, 9), 5, -(2**63), 2**63 - 1]), rng.randrange(4)) for _ in range(200))
    df = spark.createDataFrame(keys, "a long, b long").repartition(6).cache()
    for k in (1, 2, 77, 150, 200):
        assert importance.cutoff_key(df, k, part) == keys[k - 1]


def test_ranked_splits_equal_rows(spark):
    df = spark.createDataFrame([(1, 2)] * 500 + [(i, i) for i in range(100)], "a long, b long").repartition(4)
    got = importance.ranked(df, ["a", "b"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 601))
    ordered = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert ordered == sorted(ordered)


def test_gains_follow_target():
    corpus, target = np.array([90, 10]), np.array([1, 9])
    assert importance.gains_of(corpus, target)[1] > 0 > importance.gains_of(corpus, target)[0]
