"""Traces without arrays, selected quantiles, interval joins, merges and expiry by partitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.operators import baseline as B
from hostlens.operators import history as H
from hostlens.operators import retention as R
from hostlens.operators import trace as T
from hostlens.sources import sinks


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(3)
    out = []
    for key, n in (("hot", 900), ("a", 60), ("b", 1), ("c", 2), (None, 30)):
        out += [(key, i, rng.choice("xxxyz")) for i in range(n)]
    return [*out, ("a", 61, None), ("d", 1, None)]


def by_key(tokens):
    out: dict = {}
    for k, i, t in sorted(tokens, key=lambda r: r[1]):
        if t is not None:
            out.setdefault(k, []).append(t)
    return out


@pytest.mark.parametrize("width", [1, 2, 7, 10_000])
def test_features_do_not_depend_on_cuts(spark, tokens, width):
    df = spark.createDataFrame(tokens, "k string, i int, t string").repartition(5)
    links = T.linked(df, "k", ["i"], "t", F.floor(F.col("i") / width)).cache()
    want = by_key(tokens)
    for kind, n in (("token", 1), ("bigram", 2), ("trigram", 3)):
        got = {(r.k, r.gram): r.n for r in T.grams(links, kind, ["k"]).collect()}
        assert got == Counter((k, " ".join(x[j : j + n])) for k, x in want.items() for j in range(len(x) - n + 1))
    keyed = links.where("k is not null")
    stats, runs = ({r.k: r for r in f.collect()} for f in (T.stats(keyed, "k"), T.runs(keyed, "k", ["i"])))
    for k, x in want.items():
        if k is None:
            continue
        sizes, at = [], 0
        while at < len(x):
            end = at
            while end < len(x) and x[end] == x[at]:
                end += 1
            sizes.append(end - at)
            at = end
        assert (runs[k].longest, runs[k].n_runs) == (max(sizes), sum(s > 1 for s in sizes))
        c = Counter(x)
        assert (stats[k].length, stats[k].n_distinct, stats[k].repeats) == (len(x), len(c), sum(a == b for a, b in zip(x, x[1:], strict=False)))
        assert math.isclose(stats[k].entropy, -sum(v / len(x) * math.log2(v / len(x)) for v in c.values()), abs_tol=1e-9)


def test_trace_of_two_million_tokens(spark):
    """The longest known trace has 2,000,005 calls. No step gathers it."""
    n = 2_000_005
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 1000 < 10, "r").otherwise(F.concat(F.lit("t"), F.col("id") % 3)).alias("t"))
    links = T.linked(df, "k", ["i"], "t", F.floor(F.col("i") / 50_000))
    runs = T.runs(links, "k", ["i"])
    assert tuple(runs.first())[1:] == (10, n // 1000 + 1)
    assert "collect_list" not in plan(runs) and "collect_list" not in plan(T.stats(links, "k")) and "collect_list" not in plan(T.gram_schema(links))
    top = {r.gram: r.n for r in T.grams(links, "bigram").collect()}
    assert sum(top.values()) == n - 1 and top["r r"] == 9 * (n // 1000) + 4
    pieces = T.pieces(df, "k", ["i"], "t", F.floor(F.col("i") / 50_000)).agg(F.count("*").alias("pieces"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert tuple(pieces) == (41, 50_000, n)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_whole_traces(spark, tokens, width):
    got = T.traces(spark.createDataFrame(tokens, "k string, i int, t string"), "k", ["i"], "t", F.floor(F.col("i") / width))
    assert {r.k: r.trace for r in got.collect()} == {k: " ".join(x) for k, x in by_key(tokens).items()} and got.count() == 5


@pytest.mark.parametrize("digits", [16, 1024])
def test_selected_quantiles(spark, digits):
    rng = random.Random(8)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 1e300 * rng.random(), -5.0, 0.0, rng.random() * 1e-300])) for _ in range(500)]
    rows += [("same", 7.0)] * 50 + [("one", 3.5)] + [("two", 1.0), ("two", 2.0)] + [(None, float(i)) for i in range(9)] + [("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r for r in B.exact_quantiles(df, ["k"], "v", digits=digits).collect()}
    want: dict = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v) and np.allclose(got[k].p, np.quantile(v, B.PERCENTILES), rtol=1e-12)


def test_quantiles_of_large_groups_hold_no_buffer(spark):
    df = spark.range(300_000).select((F.col("id") % 3 == 0).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    rows = B.median_and_mad(df, ["k"], "v")
    want = df.groupBy("k").agg(F.median("v").alias("m"))
    assert {(r.k, round(r.median)) for r in rows.collect()} == {(r.k, round(r.m)) for r in want.collect()}
    assert "percentile" not in plan(rows) and "median(" not in plan(rows)


def test_merged_sketches_are_near_the_median(spark):
    df = spark.range(60_000).select(F.lit("p").alias("k"), (F.xxhash64("id") % 100_000).cast("double").alias("value"), (F.col("id") < 20_000).alias("first"))
    old = B.new_moments(df.where("first"), ["k"]).withColumns({"median": F.lit(0.0), "noise_floor": F.lit(1.0)})
    r = B.updated_baseline(old, B.new_moments(df.where("not first"), ["k"]), ["k"]).first()
    share = df.where(F.col("value") <= r.median).count() / 60_000
    assert r.n == 60_000 and abs(share - 0.5) < 0.02


def test_interval_join(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), s, None if rng.random() < 0.05 else s + rng.choice([0, 1, 2, 30, 700, 5000]), i) for i, s in enumerate(rng.randrange(-3000, 3000) for _ in range(200))]
    events = [(rng.choice("abc"), rng.randrange(-3500, 9000), i) for i in range(300)]
    got = H.interval_join(spark.createDataFrame(events, "k string, at long, e int"), spark.createDataFrame(spans, "k string, s long, t long, i int"), ["k"], "at", "s", "t")
    want = Counter((e, i) for k, at, e in events for h, s, t, i in spans if k == h and s <= at and (t is None or at < t))
    assert Counter((r.e, r.i) for r in got.collect()) == want


def test_interval_join_of_a_key_that_is_used_again_and_again(spark):
    """10,000 lifetimes of one pid and 20,000 events meet in about as many rows as there are events, not in 200 million."""
    spans = spark.range(10_000).select(F.lit(7).alias("pid"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 90).alias("t"), F.col("id").alias("i"))
    events = spark.range(20_000).select(F.lit(7).alias("pid"), (F.col("id") * 50 + 3).alias("at"))
    rows = H.interval_join(events, spans, ["pid"], "at", "s", "t")
    assert rows.count() == 20_000
    rows.write.format("noop").mode("overwrite").save()
    wide = spans.select("s", F.ceil(F.log2((F.col("t") - F.col("s")).cast("double"))).alias("n")).select("n").distinct().collect()
    assert [r.n for r in wide] == [7]  # one width: an event looks into one bin, which at most three of these spans touch


def test_interval_join_of_keys_with_few_spans_and_with_many(spark):
    """An event of a key with few spans travels once; all keys together give what comparing all rows gives."""
    rng = random.Random(5)
    spans = [(k, s, None if rng.random() < 0.1 else s + rng.choice([0, -3, 1, 40, 900]), i) for i, (k, s) in enumerate((k, rng.randrange(-2000, 2000)) for k, n in (("few", 20), ("many", 150), (None, 3)) for _ in range(n))]
    events = [(rng.choice(["few", "many", "none", None]), rng.choice([None, *range(-2500, 2500, 7)]), i) for i in range(400)]
    e, s = spark.createDataFrame(events, "k string, at long, e int"), spark.createDataFrame(spans, "k string, s long, t long, i int")
    want = Counter((e, i) for k, at, e in events for h, s, t, i in spans if k is not None and k == h and at is not None and s <= at and (t is None or at < t))
    got = H.interval_join(e, s, ["k"], "at", "s", "t")
    assert Counter((r.e, r.i) for r in got.collect()) == want and got.columns == ["k", "at", "e", "s", "t", "i"]
    few = H.interval_join(e, s.where("k = 'few'"), ["k"], "at", "s", "t")
    assert "Generate" not in plan(few) and Counter((r.e, r.i) for r in few.collect()) == Counter({(e, i): 1 for e, i in want if spans[i][0] == "few"})


def test_connections(spark):
    rows = [(1, "a", s) for s in (1, 2, 3, 9, 9)] + [(1, "b", 4), (2, "a", 2)]
    df = spark.createDataFrame(rows, "pid int, peer string, snap int")
    got = {(r.pid, r.peer, r.snap): r.change for r in H.connection_events(df, ["pid", "peer"], "snap").collect()}
    assert got == {(1, "a", 1): "CONNECT", (1, "a", 2): "STATUS", (1, "a", 3): "STATUS", (1, "a", 9): "STATUS", (1, "b", 4): "CONNECT", (2, "a", 2): "CONNECT"}
    again = {(r.pid, r.peer, r.snap): r.change for r in H.connection_events(df, ["pid", "peer"], "snap", forget=3).collect()}
    assert again == got | {(1, "a", 9): "CONNECT"}


def files(spark, path):
    names = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f for r in names}


def test_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    row = lambda i, v: (i, v, {"by": "old", "i": str(i)})
    kind = "id long, v string, m map<string,string>"
    sinks.merge_into(path, spark.createDataFrame([row(i, "a") for i in range(200)], kind), ["id"], 16, fill=["v"], merge_maps=["m"])
    before = files(spark, path)
    new = spark.createDataFrame([(5, None, {"by": "new"}), (900, "z", None)], kind)
    touched = sinks.merge_into(path, new, ["id"], 16, fill=["v"], merge_maps=["m"])
    after = files(spark, path)
    assert 1 <= len(touched) <= 2
    same = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert same <= after and len(same) >= 14
    got = {r.id: (r.v, r.m) for r in spark.read.parquet(path).collect()}
    assert len(got) == 201 and got[5] == ("a", {"by": "new", "i": "5"}) and got[900] == ("z", None) and got[7] == ("a", {"by": "old", "i": "7"})
    sinks.merge_into(path, new, ["id"], 16, fill=["v"], merge_maps=["m"])
    assert {r.id: (r.v, r.m) for r in spark.read.parquet(path).collect()} == got
    assert sinks.merge_into(path, new.limit(0), ["id"], 16, fill=["v"], merge_maps=["m"]) == []


def test_expiry_reads_and_writes_old_partitions_only(spark, tmp_path):
    path, day = f"{tmp_path}/t", 86_400
    rows = [(i, i * day // 4, f"x{i % 3}") for i in range(80)] + [(3, 3 * day // 4, "x0")] * 2
    sinks.append(spark.createDataFrame(rows, "id int, end_s long, name string").withColumn("ts", F.timestamp_seconds("end_s")), path, "ts")
    cutoff = 10 * day + day // 2
    plans = []

    def expired(old):
        gone = old.where((F.col("end_s") < cutoff) & ((F.col("name") != "x1") | (F.col("end_s") < 4 * day)))
        plans.append(plan(gone))
        return gone

    before = files(spark, path)
    dry = R.expire_table(spark, path, cutoff, expired, dry_run=True)
    assert files(spark, path) == before
    counts = {str(r.date): (r.n_rows, r.n_expired) for r in R.expire_table(spark, path, cutoff, expired).collect()}
    assert counts == {str(r.date): (r.n_rows, r.n_expired) for r in dry.collect()} and len(counts) == 11
    want = Counter((i, s, n) for i, s, n in rows if s >= cutoff or (n == "x1" and s >= 4 * day))
    assert Counter((r.id, r.end_s, r.name) for r in spark.read.parquet(path).collect()) == want
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ <= ", plans[0])
    late = {f for f in before if f.split("date=")[1][:10] > "1970-01-11"}
    assert late and late <= files(spark, path)
