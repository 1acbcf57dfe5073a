"""The filter audit: plain counting, smaller ids that come later, batches that run again."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from hostlens.llm import filter_audit, queries


def masks(rows, labels):
    first: dict = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    for i, t, part in rows:
        t = t or ""
        w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in t).split(" ") if x]
        upper = sum("A" <= c <= "Z" for c in t)
        mask = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * upper > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        yield part or "", {k for k, v in mask.items() if v}, i in good, i in toxic


def plain(rows, labels):
    found = list(masks(rows, labels))
    out = Counter()
    for part in {p for p, *_ in found}:
        mine = [x[1:] for x in found if x[0] == part]
        removed_by = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in mine if f in x[0] and not x[0] & before]
                removed_by[f] += len(gone)
                lines.append((part, "".join(order), k + 1, sum(not x[0] & (before | {f}) for x in mine), len(gone), sum(f in x[0] and bool(x[0] & before) for x in mine), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out.update((*x[:-1], removed_by[x[-1]]) for x in lines)
    return out


def documents(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "Cat", "SAT", "naïve", "5%", "mat", " x", "a|b"]
    texts = [rng.choice([" ", "\n", "\t"]).join(rng.choice(words[: rng.randrange(1, 9)] + [f"w{j}" for j in range(60)]) for _ in range(rng.randrange(90))) for _ in range(n // 3)]
    rows = [(rng.randrange(n), rng.choice([*texts, "", None]), rng.choice(["a", "b", "c", "", None])) for _ in range(n)]
    return [*rows, (None, texts[0], "a"), (None, texts[0], "a"), (5, "copy " * 70, "b"), (5, "copy " * 70, "b"), (5, "copy " * 70, "c"), (-7, "copy " * 70, None), (9, "long words " * 40_000, "a")]


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]


def columns(df):
    return Counter(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, seed):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("id", "part", "mask", "digest", "n", "good"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert columns(queries.op13_filter_audit(spark, str(tmp_path))) == plain(rows, LABELS)


def test_smaller_ids_that_come_later_take_masks_back(spark, tmp_path):
    """Files one after another, ids from large to small; then new files go on from the state; a batch runs again."""
    rows = sorted(documents(3, 120), key=lambda r: -(r[0] or 0))
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/audit"
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    done = []
    for part in (rows[:40], rows[40:80], rows[80:]):
        spark.createDataFrame(part, "doc_id long, text string, source string").repartition(3).write.mode("append").parquet(path)
        done += part
        got = filter_audit.audit(spark, path, labels, batches=4, folder=folder)
        assert columns(got) == plain(done, LABELS)
    negative = spark.read.parquet(f"{folder}/counters").where("n < 0").count()
    assert negative > 0
    state = filter_audit.Audit(None, folder)
    last = max(r["batch"] for r in spark.read.parquet(f"{folder}/counters").select("batch").distinct().collect())
    assert len(filter_audit.segments(last + 1)) <= (last + 1).bit_length()
    before = columns(filter_audit.audited(state.counters(spark)))
    again = filter_audit.Audit(None, f"{tmp_path}/again")
    docs = spark.createDataFrame([(i, p or "", t) for i, t, p in done], "id long, part string, text string")
    for k, part in enumerate(docs.repartition(3, "id").randomSplit([1.0, 1.0, 1.0], 5)):
        part = part.cache()
        for _ in range(2):
            again.on_batch(part, k)
    assert {x[:7] for x in columns(filter_audit.audited(again.counters(spark)))} == {x[:7] for x in before}


def test_segments():
    assert filter_audit.segments(0) == [] and filter_audit.segments(6) == [(4, 5), (0, 3)] and filter_audit.segments(7) == [(6, 6), (4, 5), (0, 3)]


def test_long_text_as_short_text():
    text = (" ".join(f"w{i % 700}" for i in range(900_000))).encode()
    assert len(text) > filter_audit.LONG and filter_audit.alone(text, len(text)) == 0b0010


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    assert filter_audit.audit(spark, f"{tmp_path}/docs").collect() == []
