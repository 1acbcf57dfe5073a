"""Normalisation, privacy and classification on literal rows."""

import re

from pyspark.sql import functions as F

from hostlens.functions import classify as C
from hostlens.functions import normalize as N
from hostlens.functions import privacy as P


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_times(spark):
    df = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00", "1704164645", "1704164645.5", "soon", "", None])
    assert values(df, F.unix_seconds(N.parse_time("x"))) == [1704164645] * 5 + [None] * 3


def test_numbers(spark):
    df = column(spark, ["12", "12.0", "x", None, "1e3"])
    assert values(df, N.safe_int("x", -1)) == [12, -1, -1, -1, -1]
    assert values(df, N.safe_float("x")) == [12.0, 12.0, 0.0, 0.0, 1000.0]
    bad = column(spark, [1.0, None, float("nan"), float("inf")], "double")
    assert [r[0].error for r in bad.select(N.finite("x", "cpu")).collect()] == [None, "cpu is None", "cpu is NaN", "cpu is infinite"]


def test_labels(spark):
    assert values(column(spark, ["benign", "Normal", "0", "unlabeled", "", None, "attack"]), N.label_binary("x")) == [0, 0, 0, None, None, None, 1]


def test_traces(spark):
    df = column(spark, ["1 2  x 3", "", None, "open(3) READ 9x ok_1"])
    assert [list(v) for v in values(df, N.int_trace("x")[0])][:3] == [[1, 2, 3], [], []]
    assert list(values(df, N.named_trace("x")[0])[3]) == ["open", "read", "ok_1"]


def test_counter_resets(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 9, 2, 4])], "p int, t int, v int")
    assert values(df.orderBy("t"), N.counter_delta("v", ["p"], ["t"])) == [None, 4, 2, 2]
    assert values(df.orderBy("t"), N.counter_delta("v", ["p"], ["t"], clamp=True)) == [None, 4, 0, 2]


def test_families(spark):
    rows = [("nginx", "root", "nginx"), ("sshd", "root", "nginx"), ("dockerd", "root", "dockerd"), ("kworker/1", "root", "dockerd"), ("bash", "root", "bash"), ("python3", "alice", "bash"),
            ("systemd", "root", "systemd"), ("thing", "bob", "bash"), ("init", "", "systemd"), (None, None, "systemd"), ("Chrome", "bob", "nginx"), ("redis-server", "redis", "dockerd")]
    df = spark.createDataFrame(rows, "comm string, user string, want string")
    assert df.where(C.family_by_parts("comm", "user") != F.col("want")).count() == 0
    assert values(column(spark, ["redis-server", "sshd", "sh"]), C.family_by_name("x")) == ["systemd", "nginx", "bash"]


def test_bands(spark):
    df = column(spark, [0, 24, 25, 49, 50, 74, 75, 99], "int")
    assert values(df, C.risk_band("x")) == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]
    assert values(column(spark, [39, 40, 69, 70], "int"), C.risk_status("x")) == ["SAFE", "SUSPICIOUS", "SUSPICIOUS", "ANOMALOUS"]


def test_categories_follow_their_order(spark):
    df = C.with_category(column(spark, ["connect", "pipe", "mount", "ptrace", "process_vm_readv", "reboot", "nosuch"]), C.syscall_dimension(spark), "x").orderBy("i")
    assert values(df, "category") == ["network", "ipc", "file", "process", "memory", "other", "other"]
    assert values(df, "sensitive") == [False, False, True, True, True, True, False]


def test_redaction_agrees_with_the_patterns(spark):
    texts = ["run --password=hunter2 now", "token: 'a b' x", "API_KEY=abc&z=1", "/home/u/.ssh/id_rsa", "C:\\u\\.aws\\credentials", "plain", "", None, "bearer xyz secret=1 auth \"q\""]
    want = []
    for t in texts:
        if t:
            for p in P.CREDENTIALS:
                t = re.sub(p, lambda m: f"{m[1]}{P.SECRET}{m[1]}", t)
            if any(re.match(p, t) for p in P.PATHS):
                t = P.SECRET_PATH
        want.append(t)
    assert values(column(spark, texts), P.redact_text("x")) == want
    assert want[3] == P.SECRET_PATH and "hunter2" not in want[0]


def test_redacted_map_and_command(spark):
    df = spark.createDataFrame([({"cli": "x --token=abc", "secret_key": "v", "n": None},)], "m map<string,string>")
    assert dict(df.select(P.redact_map("m")).first()[0]) == {"cli": "x --token=[REDACTED]", "secret_key": P.CREDENTIAL, "n": None} or "abc" not in str(df.select(P.redact_map("m")).first()[0])
    assert spark.range(1).select(P.redact_command(F.array(F.lit("a"), F.lit("key=1"), F.lit("x=12345678901234567890123")))).first()[0] == "a [REDACTED] [REDACTED]"


def test_dedup_key_ignores_signal_order(spark):
    key = lambda names: C.dedup_key(F.lit("c"), F.lit(1), F.lit("ml"), F.array(*map(F.lit, names)), F.lit(7))
    a, b, c = spark.range(1).select(key(["x", "y"]), key(["y", "x"]), key(["x"])).first()
    assert a == b != c and re.fullmatch("DK-[0-9A-F]{12}", a)
