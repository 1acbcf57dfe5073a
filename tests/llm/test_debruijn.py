"""Removal of repeated windows of words: brute force, split keys, chance agreements, paths."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import debruijn, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    times = Counter(tuple(w[p : p + length]) for _, w in words for p in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if times[tuple(w[p : p + length])] > 1:
                gone.update(range(p, p + length))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def texts(seed, n=150, alphabet=60, most=90):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(alphabet)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(most))]
        if rng.random() < 0.5:
            w[rng.randrange(len(w) + 1) : 0] = rng.choice(passages)
        out.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(w)))
    return out


ODD = [(None, None), (None, "a b c " * 30), (7, ""), (7, " \t\n "), (7, "same again " * 60), (900, "same again " * 60), (901, "x " * 500), (902, "x"), (903, "one word here")]


@pytest.mark.parametrize(("length", "gram"), [(35, 6), (5, 2), (3, 3), (1, 1)])
def test_against_brute_force(spark, length, gram):
    rows = [*texts(1), *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(tuple(r) for r in debruijn.remove_repeated_windows(df, length=length, gram=gram).collect()) == plain(rows, length)


def test_query(spark, tmp_path):
    rows = [*texts(2), *ODD, (5000, "very " * 60_000), (5001, " ".join(f"u{i}" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "key", "unit", "marks", "n_words", "kind"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in queries.op12_debruijn_dedup(spark, str(tmp_path)).collect()) == plain(rows, 35)


def test_frequent_keys_are_split(spark):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(12)]
    rows = [(i, " ".join([*(f"a{rng.randrange(9)}" for _ in range(rng.randrange(12))), *shared, *(f"b{rng.randrange(9)}" for _ in range(rng.randrange(12)))])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    units = debruijn._units(df.select(F.col("doc_id").alias("id"), "text"), 8, 8, 3).cache()
    assert len(debruijn._hot(units, 8)) > 0
    assert Counter(tuple(r) for r in debruijn.remove_repeated_windows(df, length=8, gram=3).collect()) == plain(rows, 8)


def test_chance_agreements_do_not_count(spark):
    """With every window flagged, as if hashes agreed by chance, only words that do stand elsewhere go."""
    rows = texts(5, n=60)
    none = np.empty(0, np.uint64)
    units = debruijn._units(spark.createDataFrame(rows, "id long, text string").repartition(3), 8, 10, 3).cache()
    sent = debruijn._sent(units, none, 10, 3)
    marks = sent.select(F.shiftright("at", 27).alias("unit"), F.shiftright("at", 1).bitwiseAND((1 << 26) - 1).cast("int").alias("kind"), F.unhex(F.expr("repeat('01', octet_length(edges) div 6 - 2)")).alias("flags"))
    marked = units.join(marks.groupBy("unit").agg(F.collect_list(F.struct("kind", "flags")).alias("marks")), "unit").cache()
    chance = debruijn._chance(marked, none, 10, 3)
    assert chance.count() > 0
    got = debruijn._cut(marked.join(chance.groupBy("unit").agg(F.collect_list("digest").alias("chance")), "unit", "left"), none, 10, 3, False)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 10)


def test_paths_are_compact(spark):
    """A passage in many texts is one path, whatever stands round it."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(str(rng.random()) for _ in range(15))} {passage} {' '.join(str(rng.random()) for _ in range(15))}") for i in range(30)]
    none = np.empty(0, np.uint64)
    units = debruijn._units(spark.createDataFrame(rows, "id long, text string").coalesce(1), 8, 10, 3).cache()
    marks = debruijn._met(debruijn._sent(units, none, 10, 3).repartition(2, "key").sortWithinPartitions("key"))
    batch = units.join(marks.groupBy("unit").agg(F.collect_list(F.struct("kind", "flags")).alias("marks")), "unit").toArrow().to_batches()[0]
    _, first, count, number, digests = debruijn._paths(batch, 0, none, 10, 3)
    assert (len(first), set(count.tolist()), len(digests)) == (30, {41}, 1)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "a b c d"), (2, "x b c d y"), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = debruijn.remove_repeated_windows(df, length=3, gram=2, keep_text=True)
    assert {(r["doc_id"], r["kept"]) for r in got.collect()} == {(1, "a"), (2, "x y"), (3, "q")}
    assert debruijn.remove_repeated_windows(df.limit(0)).collect() == []


def test_saved_tables_are_dropped(spark, tmp_path, monkeypatch):
    """Inside ``tables_dropped`` nothing stays in the shared folder but what the caller wrote."""
    from pathlib import Path
    from uuid import uuid4

    from hostlens.llm import _common, mixing, suffix_dedup

    monkeypatch.setattr(_common, "shared_dir", lambda _: f"{tmp_path}/shared/{uuid4().hex}")
    df = spark.createDataFrame([(i, t, "a") for i, t in texts(9, 40)], "doc_id long, text string, source string")
    with _common.tables_dropped(spark):
        debruijn.remove_repeated_windows(df, length=10, gram=3).write.parquet(f"{tmp_path}/op12")
        suffix_dedup.remove_repeats(df.select("doc_id", "text")).write.parquet(f"{tmp_path}/op7")
        mixing.mix(df).write.parquet(f"{tmp_path}/op6")
        assert list(Path(f"{tmp_path}/shared").rglob("*.parquet"))
    assert list(Path(f"{tmp_path}/shared").rglob("*.parquet")) == []
    assert all(spark.read.parquet(f"{tmp_path}/{op}").count() == 40 for op in ("op12", "op7", "op6"))
