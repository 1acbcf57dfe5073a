"""Collector files, trace collections, ingest and nested redaction on small files."""

from pyspark.sql import functions as F

from hostlens.functions.privacy import redact_nested
from hostlens.operators import baseline
from hostlens.sources import layouts, scans, sinks
from hostlens.sources.ingest import ingest_experiment


def test_layouts_have_all_columns():
    assert [len(x) for x in (layouts.PROCESS_INSTANCES, layouts.TELEMETRY_EVENTS, layouts.BEHAVIOUR_WINDOWS, layouts.SYSTEM_METRICS)] == [14, 9, 57, 40]
    # The metric file has 51 columns: the stored ones but raw_metrics, and those left out.
    assert len(layouts.SYSTEM_METRICS) - 1 + len(layouts.SYSTEM_METRICS_MORE) == 51 and len(layouts.EVENT_FIELDS) == 55


def test_columns_are_found_by_name_and_get_defaults(spark, tmp_path):
    (tmp_path / "w.csv").write_text("profile_id,extra,syscall_count,cpu_usage,instance_id,label_binary,pid,start_time\np1,x,7,bad,,normal,12,2024-01-01T00:00:00Z\np1,x,,1.5,i2,,x,\n")
    a, b = scans.table_csv(spark, str(tmp_path / "w.csv"), layouts.BEHAVIOUR_WINDOWS).orderBy(F.desc("syscall_count")).collect()
    assert (a.profile_id, a.syscall_count, a.cpu_usage, a.instance_id, a.label_binary, a.pid) == ("p1", 7, 0.0, None, 0, 12)
    assert (b.syscall_count, b.instance_id, b.label_binary, b.pid, b.start_time) == (0, "i2", None, 0, None)
    assert (a.alive_at_end, a.label, a.scenario, a.window_id, a.bytes_read) == (1, "unlabeled", "ambient", None, 0)


def test_ingest(spark, tmp_path):
    run, out = tmp_path / "run", str(tmp_path / "out")
    run.mkdir()
    (run / "process_instances.csv").write_text("instance_id,profile_id,pid,start_time,exit_code\n" + "".join(f"i{k},p{k % 2},{k},{k},\n" for k in range(4)))
    (run / "behaviour_windows.csv").write_text("instance_id,profile_id,start_time,syscall_count,file_open_count,label_binary\n" + "".join(f"i{k % 4},p{k % 2},{k},{k},1,{'1' if k == 9 else ''}\n" for k in range(14)) + "i9,p9,1,1,1,\n")
    got = {r.name: r.rows for r in ingest_experiment(spark, str(run), out, profiles=True).collect()}
    assert got == {"process_instances": 4, "telemetry_events": 0, "behaviour_windows": 15, "system_metrics": 0, "profiles_updated": 2}
    p = {(r.profile_id, r.feature): r for r in spark.read.parquet(f"{out}/process_profiles").collect()}
    assert p["p1", "syscall_count"].observations == 6 and p["p0", "syscall_count"].observations == 7 and p["p0", "syscall_count"].typical == ["file_open"] and len(p) == 2 * 42


def test_ingest_counts_all_windows_of_a_program(spark, tmp_path):
    """No window is left out: 6,000 of one program, the last of which change all statistics."""
    run, out = tmp_path / "run", str(tmp_path / "out")
    run.mkdir()
    (run / "behaviour_windows.csv").write_text("instance_id,profile_id,start_time,syscall_count,cpu_usage,label_binary\n" + "".join(f"i{k},p,{k},{k},{'' if k < 5000 else 7.5},\n" for k in range(6000)))
    ingest_experiment(spark, str(run), out, profiles=True).collect()
    p = {r.feature: r for r in spark.read.parquet(f"{out}/process_profiles").collect()}
    r = p["syscall_count"]
    assert (r.observations, r.instances, r.n, r.mean, r.low, r.high, r.median, r.mad, len(p)) == (6000, 6000, 6000, 2999.5, 0.0, 5999.0, 2999.5, 1500.0, 42)
    assert abs(r.std - (6000**2 / 12 - 1 / 12) ** 0.5) < 1e-6 and abs(r.p90 - 5399.1) < 1e-6 and p["cpu_usage"].high == 7.5 and p["cpu_usage"].median == 0.0


def test_trace_collections(spark, tmp_path):
    for path, text in {
        "adfa/Training_Data_Master/UTD-1.txt": "1 2 3", "adfa/Training_Data_Master/ADFA-LD+Syscall+List.txt": "no trace", "adfa/Training_Data_Master/bad.txt": "1 x", "adfa/Validation_Data_Master/UVD 2.txt": "4",
        "adfa/Attack_Data_Master/Hydra_SSH_7/a.txt": "5 6", "adfa/Attack_Data_Master/Meterpreter_1/empty.txt": " ", "adfa/Attack_Data_Master/New_1/n.txt": "9", "adfa/Attack_Data_Master/.x/h.txt": "1", "adfa/other/o.txt": "1",
        "plaid/attack/ssh_1/10.txt": "open read(3)", "plaid/attack/odd/11.txt": "close", "plaid/baseline/run/12.txt": "read", "plaid/baseline/run/13.txt": " ", "plaid/baseline/.git/14.txt": "read", "plaid/baseline/idle/15.txt": "write",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    good, bad = scans.int_trace_directory(spark, str(tmp_path / "adfa"))
    assert sorted((r.file_name, list(r.tokens), r.label, r.category, r.source_split) for r in good.collect()) == [("UTD-1", [1, 2, 3], 0, "normal", "training"), ("UVD 2", [4], 0, "normal", "validation"), ("a", [5, 6], 1, "Hydra_SSH", "attack"), ("n", [9], 1, "New_1", "attack")]
    assert sorted((r.file_name, r.n_bad) for r in bad.collect()) == [("bad", 1), ("empty", 0)]
    good, bad = scans.named_trace_directory(spark, str(tmp_path / "plaid"))
    assert sorted((r.pid, list(r.tokens), r.label, r.category, r.subcategory) for r in good.collect()) == [("10", ["open", "read"], 1, "ssh", "ssh_1"), ("11", ["close"], 1, "odd", "odd"), ("12", ["read"], 0, "normal", "run"), ("15", ["write"], 0, "normal", "idle")]
    assert [r.pid for r in bad.collect()] == ["13"]
    some, _ = scans.named_trace_directory(spark, str(tmp_path / "plaid"), max_baseline=1)
    assert some.where("label = 1").count() == 2 and some.where("label = 0").count() <= 1


def test_nested_redaction(spark):
    kind = "struct<api_key: string, deep: map<string, struct<note: string, auth: array<int>>>, items: array<string>, n: int>"
    df = spark.createDataFrame([(({"api_key": "k", "deep": {"a": {"note": "password=x1", "auth": [1]}, "secret_b": {"note": "n", "auth": [2]}}, "items": ["token=abc", None, "ok"], "n": 3}),), (None,)], f"v {kind}")
    a, b = (r.v for r in df.select(redact_nested("v", df.schema["v"].dataType).alias("v")).collect())
    assert (a.api_key, a.deep["a"].note, a.deep["a"].auth, a.deep["secret_b"], a["items"], a.n) == ("[REDACTED_CREDENTIAL]", "[REDACTED]", None, None, ["[REDACTED]", None, "ok"], 3) and b is None


def test_feature_files_name_their_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.1, 3.0)], "id int, b double, a double")
    schema = sinks.write_features(df, str(tmp_path), ["a", "b"], ["id"])
    assert [tuple(r) for r in schema.orderBy("position").collect()] == [(0, "a", "feature"), (1, "b", "feature"), (2, "id", "meta")]


def test_a_file_for_each_row(spark, tmp_path):
    rows = spark.range(7).selectExpr("concat('t ', id) AS value").coalesce(1)
    sinks.file_for_each(rows, f"{tmp_path}/t", at_once=2)
    assert sorted(f.read_text() for f in (tmp_path / "t").glob("*.txt")) == [f"t {i}\n" for i in range(7)]
    assert len({f.name.split("-")[1] for f in (tmp_path / "t").glob("*.txt")}) > 1  # tasks


def test_partitions_are_replaced_from_their_own_table_in_one_write(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(9).selectExpr("id", "id % 3 AS p").write.partitionBy("p").parquet(path)
    monkeypatch.setattr(sinks, "scratch", None)  # no copy elsewhere
    sinks.replace_partitions(spark.read.parquet(path).where("p < 2 and id > 2"), path, "p")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_oldest_windows_by_counting(spark):
    rows = [(k, at) for k in ("a", "b", None) for at in [*range(20), None]] + [("c", 1)]
    df = spark.createDataFrame(rows, "k string, at int").repartition(3)
    for most in (1, 5, 100):
        got = sorted(map(str, baseline.oldest_counted(df, "k", "at", most).collect()))
        assert got == sorted(map(str, baseline.oldest(df, "k", "at", most).collect()))
