"""Operators on literal rows, and properties that hold between them."""

import math

import pytest
from pyspark.sql import functions as F

from hostlens.operators import baseline as B
from hostlens.operators import deviation as D
from hostlens.operators import history as H
from hostlens.operators import ml as M
from hostlens.operators import retention as Rt
from hostlens.operators import risk as R
from hostlens.operators import sequence as S
from hostlens.operators import windows as W
from hostlens.sources import sinks
from hostlens.streaming import jobs as J


def test_running_moments(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (10, 12, 14, 16, 18)], "k string, v double")
    r = B.moments(df, ["k"], "v").first()
    assert (r.n, r.mean, r.variance) == (5, 14.0, 10.0)
    one = B.moments(df.limit(1), ["k"], "v").first()
    assert one.variance == 0.0


def test_burst_stands_out(spark):
    rows = [("p", i, 1.5, 42.0, 320.0) for i in range(30)] + [("p", 30, 1.6, 43.0, 325.0), ("p", 31, 15.0, 250.0, 5000.0)]
    df = W.live_deviation(spark.createDataFrame(rows, "k string, t int, cpu double, mem double, syscalls double"), ["k"], ["t"])
    z = {r.t: r.max_z for r in df.collect()}
    assert z[0] == z[2] == 0.0 and z[30] <= 1.5 and z[31] > 3


def test_row_compares_with_all_before(spark):
    df = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate([3, 5, 9, 9])], "k string, t int, v double")
    rows = W.compare_then_update(df, ["k"], ["t"], "v").orderBy("t").collect()
    assert [r.n_before for r in rows] == [0, 1, 2, 3] and rows[0].deviation == 3 and rows[0].ratio == 0 and rows[1].z == 0
    assert math.isclose(rows[2].z, (9 - 4) / math.sqrt(2))


def test_a_score_of_just_the_threshold_is_exact(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([24, 24, 18, 18, 24, 24, 18, 24, 24, 28])], "k string, t int, v int")
    last = W.compare_then_update(df, ["k"], ["t"], "v").orderBy("t").collect()[-1]
    assert (last.mean_before, last.std_before, last.z) == (22.0, 3.0, 2.0)


def test_rows_without_a_time_come_last(spark):
    df = spark.createDataFrame([("p", None, 100.0), ("p", 1, 3.0), ("p", 2, 5.0)], "k string, t int, v double")
    for cut in (None, F.col("t") - 1):
        rows = {r.t: r for r in W.compare_then_update(df, ["k"], ["t"], "v", cut).collect()}
        assert (rows[1].n_before, rows[2].n_before, rows[None].n_before) == (0, 1, 2) and (rows[2].mean_before, rows[None].mean_before) == (3.0, 4.0)


def test_combined_moments_equal_those_of_the_union(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"), (F.col("id") < 60).alias("first"))
    m = lambda x: x.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = {r.k: r for r in m(df).collect()}
    for r in B.combined(m(df.where("first")), m(df.where("not first")), ["k"]).collect():
        assert r.n == whole[r.k].n and math.isclose(r.mean, whole[r.k].mean) and math.isclose(r.m2, whole[r.k].m2) and (r.low, r.high) == (whole[r.k].low, whole[r.k].high)


def test_profiles_leave_attacks_out(spark):
    rows = [("p", f"i{i}", i, 10.0 + 2 * i, 25.0, 0) for i in range(8)] + [("p", "x", 9, 1000.0, 25.0, 1)]
    df = spark.createDataFrame(rows, "profile_id string, instance_id string, start int, cpu_usage double, memory_usage double, label_binary int")
    r = {x.feature: x for x in B.build_profiles(df, B.registry(spark)).collect()}
    assert r["memory_usage"].mean == 25.0 and r["cpu_usage"].high == 24.0 and r["cpu_usage"].observations == 8 and r["cpu_usage"].maturity == "LEARNING"
    assert B.build_profiles(df.limit(4), B.registry(spark)).count() == 0
    assert B.build_profiles(df, B.registry(spark), max_windows=5).first().observations == 5


@pytest.mark.parametrize(("n", "k", "level", "confidence"), [(0, 1, "COLD_START", 0.10), (4, 1, "COLD_START", 0.32), (5, 1, "LEARNING", 0.45), (29, 9, "LEARNING", 0.79), (30, 1, "MATURE", 0.80), (500, 50, "MATURE", 1.0)])
def test_maturity(spark, n, k, level, confidence):
    a, b = spark.range(1).select(*B.maturity(F.lit(n), F.lit(k))).first()
    assert a == level and math.isclose(b, confidence)


def event(spark, **changes):
    row = {"cpu_z": 0.0, "mem_z": 0.0, "syscalls_z": 0.0, "flags": [], "ml_available": True, "if_pred": 1, "if_score": 0.1, "xgb_prob": 0.0, "xgb_attack": False} | changes
    kinds = "cpu_z double, mem_z double, syscalls_z double, flags array<string>, ml_available boolean, if_pred int, if_score double, xgb_prob double, xgb_attack boolean"
    return R.score_events(spark.createDataFrame([tuple(row.values())], kinds)).first()


def test_scores(spark):
    assert event(spark).risk_score == 0 and event(spark).eval_status == "evaluated"
    assert event(spark, cpu_z=2.5).risk_score == 15 and event(spark, cpu_z=9.0, mem_z=9.0).risk_score == 35
    assert event(spark, flags=["crypto_mining", "crypto_mining", "unknown"]).risk_score == 70
    r = event(spark, flags=["crypto_mining"], if_pred=-1, if_score=-0.2, xgb_attack=True, xgb_prob=1.0)
    assert (r.risk_score, r.detection_source, r.risk_category, r.status) == (99, "both", "Critical", "ANOMALOUS")
    assert event(spark, cpu_z=float("nan"), mem_z=4.0).eval_status == "insufficient_data" and event(spark, cpu_z=None).risk_score == 0
    assert event(spark, ml_available=False, if_score=None).eval_status == "insufficient_data"


def test_sequences(spark):
    df = spark.createDataFrame([(1, list("aabbbc")), (2, ["x"]), (3, [])], "id int, tokens array<string>")
    r = {x.id: x for x in df.select("id", S.run_features("tokens").alias("r"), *[c.alias(n) for n, c in S.sequence_stats("tokens").items()]).collect()}
    assert (r[1].r.longest, r[1].r.n_runs, r[1].repeats, r[1].n_distinct) == (3, 2, 3, 3)
    assert (r[2].r.longest, r[2].r.n_runs, r[2].length) == (1, 0, 1) and (r[3].r.longest, r[3].length) == (0, 0)
    e = {x.id: x.entropy for x in S.entropy(df, "id").collect()}
    assert math.isclose(e[1], -(2 / 6 * math.log2(2 / 6) + 3 / 6 * math.log2(3 / 6) + 1 / 6 * math.log2(1 / 6))) and e[2] == 0
    assert {(x.kind, x.gram, x.n) for x in S.feature_schema(df, bigrams=1, trigrams=0).collect()} == {("token", "a", 2), ("token", "b", 3), ("token", "c", 1), ("token", "x", 1), ("bigram", "b b", 2)}


def test_label_in_force(spark):
    rows = spark.createDataFrame([("h", 1, "r1"), ("h", 5, "r5"), ("g", 5, "g5")], "h string, ts int, id string")
    marks = spark.createDataFrame([("h", 2, "x"), ("h", 5, "y")], "h string, ts int, label string")
    assert {r.id: r.label_in_force for r in W.label_in_force(rows, marks, ["h"], "ts").collect()} == {"r1": None, "r5": "y", "g5": None}


def test_snapshot_changes(spark):
    seen = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (1, 3), (2, 2), (2, 3)], "pid int, snap int")
    got = {(r.pid, r.snap, r.change) for r in H.snapshot_changes(seen, "pid", "snap").collect()}
    assert got == {(1, 0, "START"), (1, 2, "EXIT"), (1, 3, "START"), (2, 1, "START")}


def test_retention_with_null_keys(spark):
    ev = spark.createDataFrame([(1, 0), (None, 0), (2, 0), (3, 10**9)], "instance_id int, end_s long")
    det = spark.createDataFrame([(1, True, 10**9), (None, True, 10**9), (2, False, 10**9)], "instance_id int, is_anomaly boolean, end_s long")
    got = Rt.expired_events(ev, det, Rt.Policy(), 10**9).select("instance_id").collect()
    assert sorted(str(r[0]) for r in got) == ["2", "None"]
    assert Rt.Policy.days("none", 3) is None and Rt.Policy.days("-4", 3) == 1 and Rt.Policy.days("x", 3) == 3


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5, {"k": "1", "j": "2"}), (2, "b", 6, None)], "id int, exe string, n int, m map<string,string>")
    new = spark.createDataFrame([(1, None, None, {"k": "9"}), (3, "c", 7, {"z": "1"})], "id int, exe string, n int, m map<string,string>")
    up = lambda o: sinks.upsert(o, new, ["id"], overwrite=["n"], fill=["exe"], merge_maps=["m"])
    once = {r.id: (r.exe, r.n, r.m) for r in up(old).collect()}
    assert once == {1: ("a", None, {"j": "2", "k": "9"}), 2: ("b", 6, None), 3: ("c", 7, {"z": "1"})}
    assert {r.id: (r.exe, r.n, r.m) for r in up(up(old)).collect()} == once


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    a = {r.id: r.is_train for r in M.stratified_split(df, "id", "label").collect()}
    assert sum(v for i, v in a.items() if i % 10 == 0) == 80 and sum(v for i, v in a.items() if i % 10) == 720
    assert a == {r.id: r.is_train for r in M.stratified_split(df.repartition(7), "id", "label").collect()}


def test_forest_finds_planted_outliers(spark):
    rows = [(i, [math.sin(i * k) for k in (1, 2, 3)]) for i in range(300)] + [(1000 + i, [9.0, -9.0, 9.0 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    nodes = M.isolation_forest(df.where("id < 1000"), "id", "v", trees=40)
    s = M.with_anomaly(M.forest_scores(df, "id", "v", nodes), 0.05)
    top = [r.id for r in s.orderBy(F.desc("score")).limit(5).collect()]
    assert sorted(top) == [1000, 1001, 1002, 1003, 1004] and abs(s.where("is_anomaly").count() - 15) <= 2


def test_validation_counts(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0), (float("inf"), 2), (1.0, 1)], "a double, label int")
    r = M.validate(df, ["a", "b"]).first()
    assert (r.rows, r.missing_features, r.bad_labels, r.nulls, r.not_finite) == (4, 1, 1, 1, 1)
    assert M.validate(df.limit(0), ["a"]).first().rows == 0


def test_stream_equals_batch(spark, tmp_path):
    # Not from 1970-01-01T00:00:00 on: a watermark begins there, and a row of that very time is late for it.
    e = spark.range(60).select("id", F.timestamp_seconds(F.col("id") * 30 + 1).alias("ts"), (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    for i in range(3):
        e.where(F.col("id").between(i * 20, i * 20 + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    J.run(J.running_stats(J.read_events(spark, f"{tmp_path}/in"), "k", "v", "id"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r.id: (r.n_before, round(r.mean_before, 9), round(r.std_before, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.id: (r.n_before, round(r.mean_before, 9), round(r.std_before, 9)) for r in W.compare_then_update(e, ["k"], ["ts"], "v").collect()}
    assert got == want


def test_earlier_moments_by_cuts_equal_one_window(spark):
    """A hot program's rows in order within days only give what one window over all of them gives."""
    import random

    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", f"2024-01-{i // 40 + 1:02d}", i, None if i % 11 == 0 else 1e6 + rng.random(), 20.0 + rng.random(), 100.0 * rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, day string, t int, cpu double, mem double, syscalls double").repartition(5)
    for f in (lambda cut: W.compare_then_update(df, ["k"], ["t"], "cpu", cut), lambda cut: W.live_deviation(df, ["k"], ["t"], cut=cut)):
        one, other = ({r.t: r for r in f(cut).collect()} for cut in (None, F.col("day")))
        assert len(one) == len(other) == 400
        for t, r in one.items():
            for c, x in r.asDict().items():
                y = other[t][c]
                assert x == y or abs(x - y) < 1e-6 * max(1, abs(x)), (t, c, x, y)


def test_wide_baseline_equals_long(spark):
    rows = [(p, i, float((i * 7 + p) % 13), None if i == 3 else float(i % 5)) for p in range(4) for i in range(30)]
    w = spark.createDataFrame(rows, "profile_id int, i int, syscall_count double, cpu_usage double")
    names = ["syscall_count", "cpu_usage"]
    columns = ["profile_id", "feature", "n", "mean", "std", "low", "high", "p25", "p99", "median", "mad", "nmad", "iqr", "noise_floor", "effective_scale"]
    wide = B.wide_baseline(w, ["profile_id"], names, B.registry(spark)).select(columns)
    long = B.feature_baseline(B.long_form(w, ["profile_id"], names), ["profile_id"], B.registry(spark)).select(columns)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, long.collect())) and wide.count() == 8
    rough = {(r.profile_id, r.feature): r for r in B.wide_baseline(w, ["profile_id"], names, B.registry(spark), exact=False).collect()}
    assert all(abs(rough[r.profile_id, r.feature].median - r.median) <= 1 for r in long.collect())


def test_window_deviations_equal_long_ones(spark):
    rows = [(p, i, float((i * 7 + p) % 13), float(i % 5) if p else None, f"i{i}", int(i == 9)) for p in range(3) for i in range(30)]
    w = spark.createDataFrame([*rows, (9, 0, 1.0, 1.0, "x", 0)], "profile_id int, start int, syscalls_sensitive double, cpu_usage double, instance_id string, label_binary int")
    names, keys, reg = ["syscalls_sensitive", "cpu_usage"], ["profile_id", "start"], B.registry(spark)
    base = B.build_profiles(w, reg)
    long = D.robust_deviation(B.long_form(w, keys, names), base, reg)
    wide = D.window_deviations(w, keys, names, base, reg)
    columns = [*keys, "feature", "value", "median", "robust_score", "z_classic", "is_deviant", "feature_risk", "maturity"]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 80
    assert same(long.select(columns), D.taken_apart(wide))
    assert same(D.category_risk(long, keys), D.window_category_risk(wide))
    assert same(D.deviation_vector(long, keys, names), D.window_deviation_vector(wide, keys, names))


def test_counted_baseline_equals_wide(spark):
    rows = [(p, float((i * 7 + p) % 13), None if i == 3 else 0.5 * (i % 5)) for p in range(4) for i in range(30 + p)]
    w = spark.createDataFrame(rows, "profile_id int, syscall_count double, cpu_usage double")
    names = ["syscall_count", "cpu_usage"]
    wide, counted = ({(r.profile_id, r.feature): r for r in f(w, ["profile_id"], names, B.registry(spark)).collect()} for f in (B.wide_baseline, B.counted_baseline))
    assert set(wide) == set(counted) and len(wide) == 8
    for k, r in wide.items():
        assert all(math.isclose(r[c], counted[k][c], rel_tol=1e-12, abs_tol=1e-12) for c in r.asDict() if c not in ("profile_id", "feature"))


def test_saved_windows_are_not_sent_to_all(spark):
    """Files of windows that repeat are small, however many there are; neither they nor baselines go through the driver."""
    w = spark.range(0, 3000, 1, 2).selectExpr("id % 50 AS profile_id", "cast(id as int) AS start", "cast(id % 3 as double) AS syscalls_sensitive", "1.0D AS cpu_usage", "cast(id as string) AS instance_id", "0 AS label_binary")
    w = sinks.stored(w)
    base = B.build_profiles(w, B.registry(spark))
    for rows in (base, D.window_deviations(w, ["profile_id", "start"], ["syscalls_sensitive", "cpu_usage"], base, B.registry(spark))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and not any("BroadcastHashJoin" in line and "profile_id" in line for line in plan.splitlines())
    assert rows.count() == 3000


def test_retraining_gates_and_promotes(spark, tmp_path):
    from hostlens.operators import ml

    rows = [(i, int(i % 4 == 0), float(i % 4 == 0) + (i * 37 % 100) / 400, float(i * 13 % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    first = ml.retrain(df, ["a", "b"], "id", "label", str(tmp_path), "d", trees=2, depth=2)
    bad = ml.retrain(df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), ["a", "b"], "id", "label", str(tmp_path), "d", trees=2, depth=2)
    strict = ml.retrain(df, ["b"], "id", "label", str(tmp_path), "d", trees=2, depth=2)
    assert (first["status"], bad["status"], strict["status"]) == ("ACCEPTED", "INVALID", "REJECTED") and strict["reasons"]
    ledger = [(r.run_no, r.action, r.status) for r in spark.read.parquet(f"{tmp_path}/ledger").orderBy("run_no", F.desc("action")).collect()]
    assert ledger == [(1, "train", "ACCEPTED"), (1, "promote", "ACCEPTED"), (2, "train", "INVALID"), (3, "train", "REJECTED")]


def counted_rows(spark, rows, schema):
    """The rows, and how many were worked out in all."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), seen


def test_boosted_trees_learn_in_many_tasks_from_one_file(spark, monkeypatch):
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: df)
    rows = spark.range(0, 25_000, 1, 1).select((F.col("id") % 5 == 0).cast("int").alias("label"), F.lit(1.0).alias("a"))
    sizes = [r["count"] for r in M.train_boosted(rows, ["a"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 9_000 and sum(sizes) == 25_000


def test_transfer_works_features_out_once(spark, monkeypatch):
    from hostlens.plans import jobs

    names = list(S.SHARED)
    schema = "label int, " + ", ".join(f"{n} double" for n in names)
    made = [counted_rows(spark, [(i % 2, *[float(i % 2 + i * k % 7) for k in range(1, len(names) + 1)]) for i in range(n)], schema) for n in (60, 40)]
    train = M.train_boosted
    monkeypatch.setattr(jobs, "shared_features", lambda s, d: [df for df, _ in made])
    monkeypatch.setattr(jobs.M, "train_boosted", lambda df, f: train(df, f, trees=2, depth=2))
    found = {r.direction: r.tp + r.fp + r.tn + r.fn for r in jobs.m19(spark, "").collect()}
    assert found == {"users to documents": 40, "documents to users": 60} and [seen.value for _, seen in made] == [60, 40]


def test_retraining_deals_its_rows_once(spark, tmp_path):
    df, seen = counted_rows(spark, [(i, int(i % 4 == 0), float(i % 4 == 0) + i * 37 % 100 / 400) for i in range(300)], "id long, label int, a double")
    assert M.retrain(df, ["a"], "id", "label", str(tmp_path), "d", trees=2, depth=2)["n_train"] == 240
    assert seen.value <= 4 * 300  # to be counted by prefix, and to be dealt: those of the prefix of the cut and the others
