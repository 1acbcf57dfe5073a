"""Streams against batch jobs, what state they keep, and batches that run again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import risk, windows
from hostlens.sources import sinks
from hostlens.streaming import jobs as J
from hostlens.streaming.scoring import LiveScoring

START = dt.datetime(2024, 3, 1)


def write_feed(spark, path, rows, schema, parts=4):
    """Rows in order of time, as files that come one after another."""
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users with pauses of days, one with a third of all events, and one who exits early."""
    rng = random.Random(2)
    rows, at = [], START
    for i in range(900):
        at += dt.timedelta(minutes=rng.choice([1, 5, 30]))
        user = "early" if i < 30 else rng.choice(["hot", "a", f"u{i // 90}"])
        kind = "exit" if i == 29 or rng.random() < 0.02 else rng.choice(["open", "read"])
        rows.append((i, at, user, kind, rng.random() * 100))
    path = str(tmp_path_factory.mktemp("feed"))
    write_feed(spark, path, rows, "event_id long, ts timestamp, user string, kind string, value double", 6)
    return path, rows


def streamed(spark, df, folder):
    query = J.run(df, f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out"), query


IDLE = 6 * 3600 * 1000


def lives(rows, closes=None):
    """(user, life, row) where a life ends after six hours without an event or with the event that closes it."""
    last, life = {}, {}
    for r in rows:
        if r[2] not in last or (r[1] - last[r[2]]).total_seconds() * 1000 > IDLE:
            life[r[2]] = life.get(r[2], 0) + 1
        last[r[2]] = r[1]
        yield r[2], life[r[2]], r
        if r[3] == closes:
            life[r[2]] += 1


def test_running_stats_and_state_that_goes(spark, events, tmp_path):
    path, rows = events
    got, query = streamed(spark, J.running_stats(J.read_events(spark, path), "user", "value", "event_id", IDLE), tmp_path)
    want, seen = {}, {}
    for user, life, r in lives(rows):
        x = seen.setdefault((user, life), [])
        want[r[0]] = (len(x), sum(x) / len(x) if x else 0.0)
        x.append(r[4])
    found = {r.event_id: r for r in got.collect()}
    assert len(found) == len(rows)
    assert all(found[i].n_before == n and abs(found[i].mean_before - m) < 1e-9 for i, (n, m) in want.items())
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) > kept[-1]  # users that went quiet are forgotten


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_share_buckets(spark, events, tmp_path, buckets):
    path, rows = events
    feed = J.read_events(spark, path).withColumn("user", F.when(F.col("user") != "hot", F.col("user")))  # one key is null
    got, _ = streamed(spark, J.running_stats(feed, "user", "value", "event_id", IDLE, buckets=buckets), tmp_path)
    n, seen = {}, {}
    for user, life, r in lives(rows):
        n[r[0]] = (None if user == "hot" else user, seen.get((user, life), 0))
        seen[user, life] = n[r[0]][1] + 1
    assert {r.event_id: (r.user, r.n_before) for r in got.collect()} == n


def test_last_tokens_close_and_state_that_goes(spark, events, tmp_path):
    path, rows = events
    got, query = streamed(spark, J.last_tokens(J.read_events(spark, path), "user", "kind", "event_id", 5, "exit", IDLE), tmp_path)
    want, seen = {}, {}
    for user, life, r in lives(rows, "exit"):
        x = seen.setdefault((user, life), [])
        x.append(r[3])
        want[r[0]] = " ".join(x[-5:])
    assert {r.event_id: r.recent for r in got.collect()} == want
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) > kept[-1]


def test_streamed_windows_equal_those_of_a_batch(spark, events, tmp_path):
    path, rows = events
    shape = lambda df: df.select("event_id", "ts", "user", F.when(F.col("kind") == "exit", "net_connect").otherwise("syscall").alias("kind"), F.col("kind").alias("syscall"), (F.col("event_id") % 7).alias("dest_ip"), F.col("value").alias("cpu_usage"), (F.col("kind") == "exit").alias("exited"))
    got, _ = streamed(spark, windows.process_windows(shape(J.read_events(spark, path)), ["user"], "ts", "1 hour", J.WATERMARK), tmp_path)
    batch = windows.process_windows(shape(spark.read.parquet(path)), ["user"], "ts", "1 hour")
    last = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    closed = batch.where(F.col("end_time") <= F.lit(last))
    assert got.count() == closed.count() > 100
    assert got.select(batch.columns).exceptAll(closed).count() == 0


def live_rows(n=400):
    rng = random.Random(7)
    out = []
    for i in range(n):
        value = rng.choice([5.0, 6.0, 7.0, 90.0 if rng.random() < 0.1 else 6.5])
        flags = ["crypto_mining"] if rng.random() < 0.05 else []
        out.append((i, START + dt.timedelta(seconds=7 * i), i % 3, rng.choice(["nginx", "bash"]), value, value * 3, value * 40, flags))
    return out


LIVE = "event_id long, ts timestamp, pid long, comm string, cpu double, mem double, syscalls double, flags array<string>"


def test_scoring_stores_what_a_batch_gives_and_replays_change_nothing(spark, tmp_path):
    rows, path = live_rows(), f"{tmp_path}/feed"
    write_feed(spark, path, rows, LIVE, 5)
    store = LiveScoring(f"{tmp_path}/store")
    batches = []

    def each(batch, k):
        batches.append((k, batch.collect()))
        store.on_batch(batch, k)

    J.run_batches(J.read_events(spark, path), each, f"{tmp_path}/check")
    assert len(batches) == 5
    z = windows.live_deviation(spark.createDataFrame(rows, LIVE), ["comm"], ["ts", "event_id"])
    z = z.withColumns({"ml_available": F.lit(False), "if_pred": F.lit(1), "if_score": F.lit(0.0), "xgb_prob": F.lit(0.0), "xgb_attack": F.lit(False)})
    scored = risk.with_floor(risk.score_events(z))
    want = risk.suppress(risk.alerts(scored.withColumn("epoch", F.unix_seconds("ts"))), ["ts", "event_id"])
    pick = lambda df: sorted((r.event_id, r.dedup_key, r.alert_id, r.risk_score) for r in df.select("event_id", "dedup_key", "alert_id", "risk_score").collect())
    assert pick(store.alerts(spark)) == pick(want) and len(pick(want)) > 5
    both = store.scored(spark).select("event_id", "risk_score").exceptAll(scored.select("event_id", "risk_score"))
    assert both.count() == 0 and store.scored(spark).count() == len(rows)
    profiles = lambda: sorted((r.comm, r.metric, r.n, round(r.mean, 9), round(r.m2, 3), r.low, r.high) for r in store.profiles(spark, 5).collect())
    before = pick(store.alerts(spark)), profiles()
    for k, batch in batches[3:]:
        store.on_batch(spark.createDataFrame(batch, LIVE), k)
    assert (pick(store.alerts(spark)), profiles()) == before


def test_alerts_once_for_a_key(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=10 * i), f"DK-{i // 6}") for i in range(120)]
    write_feed(spark, f"{tmp_path}/feed", rows, "event_id long, ts timestamp, dedup_key string", 7)
    got, _ = streamed(spark, J.first_alerts(J.read_events(spark, f"{tmp_path}/feed"), ["dedup_key"]), tmp_path)
    assert sorted(r.dedup_key for r in got.collect()) == sorted({r[2] for r in rows})


def test_counters_count_each_row_once(spark, events, tmp_path):
    path, rows = events
    seen = []

    def each(batch, k):
        seen.append(batch.count())
        assert batch.count() == seen[-1]  # read as often as it likes

    counts = J.run_counted(J.read_events(spark, path), {"received": F.count("*"), "lost": F.count_if(F.col("kind") == "exit"), "failed": F.count_if(F.col("value") > 90)}, each, f"{tmp_path}/check", "counted-test")
    assert counts == {"received": len(rows), "lost": sum(r[3] == "exit" for r in rows), "failed": sum(r[4] > 90 for r in rows)}
    assert sum(seen) == len(rows)


def test_newest_keeps_no_more_than_its_size(spark, events, tmp_path):
    path, rows = events
    newest, sizes = J.Newest(f"{tmp_path}/newest", 50, ["ts", "event_id"]), []

    def each(batch, k):
        newest.on_batch(batch.select("event_id", "ts"), k)
        newest.on_batch(batch.select("event_id", "ts"), k)  # a batch that runs again
        sizes.append(newest.rows(spark, k).count())

    J.run_batches(J.read_events(spark, path), each, f"{tmp_path}/check")
    assert max(sizes) == 50
    assert {r.event_id for r in newest.rows(spark, newest.latest).collect()} == set(range(len(rows) - 50, len(rows)))


def test_the_session_keeps_its_state_store(spark, events, tmp_path):
    before = spark.conf.get(J.STORE, None)
    streamed(spark, J.read_events(spark, events[0]).select("event_id"), tmp_path)
    assert spark.conf.get(J.STORE, None) == before
    assert sinks.scratch(spark) != sinks.scratch(spark)
