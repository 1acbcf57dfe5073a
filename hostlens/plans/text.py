"""Queries of normalisation, privacy, classification and sequences over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions import classify as C
from hostlens.functions import normalize as N
from hostlens.functions import privacy as Pv
from hostlens.operators import sequence as S
from hostlens.operators import trace as Tr
from hostlens.operators import windows as Wn
from hostlens.plans._bind import Query, secs, t
from hostlens.plans.behaviour import rounded
from hostlens.sources import scans

Q: dict[str, Query] = {}
q = lambda s: "'" + s.replace("'", "''") + "'"

# Normalisation ------------------------------------------------------------------------------------------------------
STAMP = F"CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN floor(epoch(ts))::BIGINT::VARCHAR WHEN 3 THEN 'yesterday' ELSE NULL END"


def stamps(spark, d):
    e = t(spark, d, "events")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, secs("ts").cast("string")).when(k == 3, "yesterday")
    return e.select("event_id", text.alias("stamp"))


Q["F1_parse_time"] = Query(lambda s, d: stamps(s, d).select("event_id", F.unix_seconds(N.parse_time("stamp")).alias("at")), "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN floor(epoch(ts))::BIGINT END AS at FROM events")
Q["F2_iso_text"] = Query(lambda s, d: t(s, d, "events").select("event_id", N.to_iso(F.col("ts").cast("timestamp")).alias("iso")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
Q["F3_safe_numbers"] = Query(lambda s, d: t(s, d, "part").select("p_partkey", N.safe_int(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("x"))), -1).alias("i"), N.safe_float(F.col("p_retailprice").cast("string")).alias("f")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS i, p_retailprice AS f FROM part")


def f4(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.when(F.col("label") == 1, F.lit(None).cast("double")).when(F.col("label") == 2, F.lit(float("nan"))).when(F.col("label") == 3, F.lit(float("inf"))).otherwise(F.col("label").cast("double")).alias("x"))
    return e.select("vec_id", N.finite("x", "x").alias("r")).select("vec_id", "r.value", "r.error")


Q["F4_finite_guard"] = Query(f4, "SELECT vec_id, CASE WHEN label IN (1, 2, 3) THEN 0.0 ELSE label::DOUBLE END AS value, CASE label WHEN 1 THEN 'x is None' WHEN 2 THEN 'x is NaN' WHEN 3 THEN 'x is infinite' END AS error FROM embeddings")

# System calls are named by position in the dimension, so that the join has known and unknown names.
NAMES = sorted({n for names in C.CATEGORIES.values() for n in names.split()}) + ["nosuchcall", "reboot"]
CATEGORY_OF = {n: next((c for c, names in C.CATEGORIES.items() if n in names.split()), "other") for n in NAMES}
NAME_SQL = f"(SELECT *, [{', '.join(map(q, NAMES))}][event_id % {len(NAMES)} + 1] AS syscall FROM events)"


def calls(spark, d):
    return named_calls(t(spark, d, "events"))


def named_calls(e):
    return e.withColumn("syscall", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int")))


Q["F5_syscall_category"] = Query(lambda s, d: C.with_category(calls(s, d), C.syscall_dimension(s)).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("syscall").alias("names")), f"SELECT CASE {' '.join(f'WHEN syscall = {q(n)} THEN {q(c)}' for n, c in CATEGORY_OF.items())} END AS category, count(*) AS n, count(DISTINCT syscall) AS names FROM {NAME_SQL} GROUP BY 1")
# W1 and W2: events as what a collector reports of processes and of names.
KIND_OF = {"click": "syscall", "view": "file_open", "purchase": "net_connect", "signup": "child_process", "error": "exec"}
W1_COUNTS = ["syscall_count", *[f"syscalls_{c}" for c in Wn.CATEGORIES], "syscalls_sensitive", "distinct_syscalls", "file_read_count", "file_write_count", *Wn.KINDS, "unique_files", "unique_dest_ips", "unique_dest_ports", *Wn.SUMMED, "network_count", "alive_at_end", "events_received"]
W1_FLOATS = [*Wn.GAUGES, "memory_usage", "duration_s"]


def process_events(spark, events):
    e = C.with_category(named_calls(events), C.syscall_dimension(spark))
    kind = F.lit(None).cast("string")
    for k, v in KIND_OF.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return e.select(
        "event_id", "user_id", "ts", kind.alias("kind"), "syscall", "category", "sensitive", "is_read", "is_write", F.regexp_extract("props", "[0-9]+", 0).alias("path"), F.concat(F.lit("10.0.0."), F.col("event_id") % 9).alias("dest_ip"), (F.col("event_id") % 5).alias("dest_port"),
        F.floor("value").alias("bytes_read"), (F.col("event_id") % 7).alias("tcp_tx_bytes"), (F.col("value") / 10).alias("cpu_usage"), (F.col("event_id") * 4096).alias("memory_rss_bytes"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 8).alias("num_threads"),
        ((F.col("event_type") == "error") & (F.col("value") > 150)).alias("exited"), F.col("event_type").alias("label"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) - F.col("event_id") % 7).alias("process_start"),
    )


def w1(spark, d):
    out = None
    for length in ("5 seconds", "1 day"):
        w = Wn.process_windows(process_events(spark, t(spark, d, "events")), ["user_id"], "ts", length)
        w = rounded(w.select("user_id", F.unix_seconds("start_time").alias("start_s"), *W1_COUNTS, *W1_FLOATS, "label"), *W1_FLOATS, digits=4)
        out = w if out is None else out.unionByName(w)
    return out


def w1_parts():
    """What W1's SQL selects from, and its statement for a length of windows and a condition on a window's number ``b``."""
    category = " ".join(f"WHEN syscall = {q(n)} THEN {q(c)}" for n, c in CATEGORY_OF.items())
    flag = lambda names: f"syscall IN ({INL(names)})"
    fields = f"""pe AS (SELECT *, CASE event_type {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in KIND_OF.items())} END AS kind, CASE {category} END AS category, regexp_extract(props, '[0-9]+') AS path, '10.0.0.' || (event_id % 9) AS ip, event_id % 5 AS port FROM {NAME_SQL})"""
    call = "kind = 'syscall'"
    n = lambda cond: f"count(*) FILTER ({cond})"
    last = lambda x, cond="true": f"arg_max({x}, (ts, event_id)) FILTER ({cond})"
    columns = {"syscall_count": n(call), **{f"syscalls_{c}": n(f"{call} AND category = {q(c)}") for c in Wn.CATEGORIES}, "syscalls_sensitive": n(f"{call} AND {flag(C.SENSITIVE)}"), "distinct_syscalls": f"count(DISTINCT syscall) FILTER ({call})",
               "file_read_count": n(f"{call} AND {flag(C.READS)}"), "file_write_count": n(f"{call} AND {flag(C.WRITES)}"), **{c: n(f"kind = {q(k)}") for c, k in Wn.KINDS.items()}, "unique_files": "count(DISTINCT path) FILTER (starts_with(kind, 'file_'))",
               "unique_dest_ips": "count(DISTINCT ip) FILTER (starts_with(kind, 'net_'))", "unique_dest_ports": "count(DISTINCT port) FILTER (starts_with(kind, 'net_'))", **dict.fromkeys(Wn.SUMMED, "0::BIGINT"), "bytes_read": "sum(floor(value))::BIGINT", "tcp_tx_bytes": "sum(event_id % 7)::BIGINT",
               "network_count": n("kind IN ('net_connect', 'net_accept')"), "alive_at_end": "1 - max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END)::INT", "events_received": "count(*)", "label": last("event_type")}
    floats = {**dict.fromkeys(Wn.GAUGES, "0.0"), "cpu_usage": last("value / 10"), "memory_rss_bytes": last("event_id * 4096.0"), "num_threads": f"coalesce({last('(event_id % 8)::DOUBLE', 'event_id % 2 = 0')}, 0)", "memory_usage": f"round({last('event_id * 4096.0::DOUBLE')} / 1048576, 3)"}
    one = lambda sec, when="true": f"SELECT user_id, greatest(b * {sec}, min(floor(epoch(ts))::BIGINT - event_id % 7)) AS start_s, {', '.join(f'{x} AS {c}' for c, x in columns.items())}, {', '.join(f'round(({x})::DOUBLE + 1e-9, 4) AS {c}' for c, x in floats.items())}, {sec}.0::DOUBLE AS duration_s FROM (SELECT *, floor(epoch(ts) / {sec})::BIGINT AS b FROM pe) WHERE {when} GROUP BY user_id, b"
    return fields, one


def w1_sql():
    fields, one = w1_parts()
    return f"WITH {fields} {one(5)} UNION ALL BY NAME {one(86400)}"


FLAT = {"click": "SYSCALL", "view": "FILE_OPEN", "purchase": "NETWORK_CONNECT", "signup": "PROCESS_START", "error": "PROCESS_METRIC"}
W2_COLUMNS = ("syscall_count", "file_event_count", "network_connection_count", "child_process_count", "disk_read_bytes", "disk_write_bytes", "network_bytes_sent", "network_bytes_received", "unique_destinations", "unique_ports", "unique_files")


def flat_events(events):
    kind = F.lit(None).cast("string")
    for k, v in FLAT.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), "NETWORK_STATUS_BYTES").otherwise(kind)
    return events.select("ts", F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("p"), F.col("user_id") % 20)).alias("process_name"), kind.alias("event_type"), F.concat(F.lit("10.0.0."), F.col("event_id") % 9).alias("dst_ip"), (F.col("event_id") % 5).alias("dst_port"), F.regexp_extract("props", "[0-9]+", 0).alias("file_path"), (F.col("value") / 10).alias("cpu_percent"), (F.col("value") / 20).alias("memory_percent"), F.floor("value").alias("network_bytes_sent"), (F.col("event_id") % 100).alias("network_bytes_received"))


def w2(spark, d):
    e = flat_events(t(spark, d, "events"))
    w = Wn.feature_windows(e, length="60 minutes").unionByName(Wn.feature_windows(e))
    return rounded(w.select("process_name", F.unix_seconds("start_time").alias("start_s"), (F.unix_seconds("end_time") - F.unix_seconds("start_time")).alias("length"), *W2_COLUMNS, "cpu_mean", "memory_mean"), "cpu_mean", "memory_mean")


def w2_parts():
    kind = f"CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'NETWORK_STATUS_BYTES' {' '.join(f'WHEN event_type = {q(k)} THEN {q(v)}' for k, v in FLAT.items())} END"
    net = "kind = 'NETWORK_CONNECT'"
    one = lambda sec, when="true": f"""SELECT name AS process_name, b * {sec} AS start_s, {sec}::BIGINT AS length, count(*) FILTER (kind = 'SYSCALL') AS syscall_count, count(*) FILTER (kind = 'FILE_OPEN') AS file_event_count, count(*) FILTER ({net}) AS network_connection_count, count(*) FILTER (kind = 'PROCESS_START') AS child_process_count, 0 AS disk_read_bytes, 0 AS disk_write_bytes,
coalesce(sum(floor(value)) FILTER (kind = 'NETWORK_STATUS_BYTES'), 0)::BIGINT AS network_bytes_sent, coalesce(sum(event_id % 100) FILTER (kind = 'NETWORK_STATUS_BYTES'), 0)::BIGINT AS network_bytes_received, count(DISTINCT event_id % 9) FILTER ({net}) AS unique_destinations, count(DISTINCT event_id % 5) FILTER ({net}) AS unique_ports, count(DISTINCT regexp_extract(props, '[0-9]+')) FILTER (kind = 'FILE_OPEN') AS unique_files,
round(coalesce(avg(value / 10) FILTER (kind = 'PROCESS_METRIC'), 0) + 1e-9, 6) AS cpu_mean, round(coalesce(avg(value / 20) FILTER (kind = 'PROCESS_METRIC'), 0) + 1e-9, 6) AS memory_mean FROM (SELECT *, floor(epoch(ts) / {sec})::BIGINT AS b FROM fe) WHERE {when} GROUP BY 1, b"""  # noqa: E731
    return f"fe AS (SELECT *, {kind} AS kind, 'p' || (user_id % 20) AS name FROM events WHERE user_id % 10 <> 0)", one


def w2_sql():
    fields, one = w2_parts()
    return f"WITH {fields} {one(3600)} UNION ALL {one(60)}"


Q["W1_behaviour_windows"] = Query(w1, w1_sql)
Q["W2_feature_windows"] = Query(w2, w2_sql)
INL = lambda names: ", ".join(map(q, names.split()))
Q["F6_syscall_flags"] = Query(lambda s, d: C.with_category(calls(s, d), C.syscall_dimension(s)).agg(F.count_if("sensitive").alias("sensitive"), F.count_if("is_read").alias("reads"), F.count_if("is_write").alias("writes")), f"SELECT count(*) FILTER (syscall IN ({INL(C.SENSITIVE)})) AS sensitive, count(*) FILTER (syscall IN ({INL(C.READS)})) AS reads, count(*) FILTER (syscall IN ({INL(C.WRITES)})) AS writes FROM {NAME_SQL}")
COMMS = ["nginx", "sshd", "dockerd", "kworker/0:1", "python3", "bash", "systemd", "init", "redis-server", "chrome", "Xorg", "caddy", ""]
USERS = ["root", "alice", "", "system"]
COMM_SQL = f"(SELECT event_id, [{', '.join(map(q, COMMS))}][event_id % {len(COMMS)} + 1] AS comm, [{', '.join(map(q, USERS))}][event_id % {len(USERS)} + 1] AS usr FROM events)"


def comms(spark, d):
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    return t(spark, d, "events").select("event_id", at(COMMS).alias("comm"), at(USERS).alias("usr"))


HAS = {k: " OR ".join(f"contains(lower(comm), {q(p)})" for p in v.split()) for k, v in C.FAMILY_PARTS.items()}
Q["F7_family_by_parts"] = Query(lambda s, d: comms(s, d).select("event_id", C.family_by_parts("comm", "usr").alias("family")), f"SELECT event_id, CASE WHEN {HAS['nginx']} THEN 'nginx' WHEN {HAS['dockerd']} THEN 'dockerd' WHEN {HAS['bash']} OR (usr <> '' AND usr NOT IN ({INL(C.SYSTEM_USERS)})) THEN 'bash' ELSE 'systemd' END AS family FROM {COMM_SQL}")
Q["F8_family_by_name"] = Query(lambda s, d: comms(s, d).select("event_id", C.family_by_name("comm").alias("family")), f"SELECT event_id, CASE {' '.join(f'WHEN comm IN ({INL(v)}) THEN {q(k)}' for k, v in C.FAMILY_NAMES.items())} ELSE 'systemd' END AS family FROM {COMM_SQL}")
Q["F9_program_id"] = Query(lambda s, d: t(s, d, "customer").select("c_custkey", Pv.program_id(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), "c_mktsegment").alias("program")), "SELECT c_custkey, left(sha1(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END), 12) AS program FROM customer")
Q["F10_path_pseudonym"] = Query(lambda s, d: t(s, d, "pages").select("page_id", Pv.path_pseudonym("url", "salt").alias("path")), r"SELECT page_id, left(sha256('salt' || url), 16) || regexp_extract(regexp_extract(url, '[^/]*$'), '[^.](\.[A-Za-z0-9]{1,7})$', 1) AS path FROM pages")
Q["F11_address_pseudonym"] = Query(lambda s, d: t(s, d, "customer").select("c_custkey", Pv.hashed("c_name", 16).alias("ip")), "SELECT c_custkey, 'h_' || left(sha256(c_name), 16) AS ip FROM customer")
TOKEN_SQL = " OR ".join(f"contains(lower(x), {q(w)})" for w in Pv.TOKEN_WORDS)
Q["F12_redact_command"] = Query(lambda s, d: t(s, d, "pages").select("page_id", Pv.redact_command(F.split(F.concat(F.lit("curl --token=abc "), F.col("url"), F.lit("?averylongparameter=1")), " ")).alias("command")), f"SELECT page_id, left(array_to_string(list_transform(string_split('curl --token=abc ' || url || '?averylongparameter=1', ' '), lambda x: CASE WHEN {TOKEN_SQL} OR (contains(x, '=') AND length(x) > 20) THEN '[REDACTED]' ELSE x END), ' '), 512) AS command FROM pages")
Q["F13_redact_text"] = Query(lambda s, d: t(s, d, "documents").select("doc_id", F.md5(Pv.redact_text("text")).alias("redacted"), (Pv.redact_text("text") != F.col("text")).alias("changed")), None)


def f14(spark, d):
    c = t(spark, d, "customer")
    text = F.concat(F.lit("run password="), F.col("c_mktsegment"))
    inner = F.create_map(F.lit("Auth_Token"), F.col("c_name"), F.lit("note"), text)
    v = F.struct(F.struct(F.col("c_name").alias("api_key"), text.alias("cli"), F.col("c_nationkey").alias("n")).alias("top"), F.create_map(F.lit("in"), inner, F.lit("my_secret"), inner).alias("maps"), F.array(text, F.col("c_mktsegment")).alias("items"), F.array(F.struct(text.alias("line"), F.lit(3).alias("passwd_len"))).alias("rows"))
    rows = c.select("c_custkey", v.alias("v"))
    return rows.select("c_custkey", Pv.redact_nested("v", rows.schema["v"].dataType).alias("v")).select(
        "c_custkey", "v.top.api_key", "v.top.cli", "v.top.n", F.col("v.maps")["in"]["Auth_Token"].alias("token"), F.col("v.maps")["in"]["note"].alias("note"), F.col("v.maps")["my_secret"].isNull().alias("hidden"),
        F.array_join("v.items", "|").alias("items"), F.col("v.rows")[0]["line"].alias("line"), F.col("v.rows")[0]["passwd_len"].alias("len"),
    )


RED = "'run [REDACTED]'"
Q["F14_redact_map"] = Query(f14, f"SELECT c_custkey, '[REDACTED_CREDENTIAL]' AS api_key, {RED} AS cli, c_nationkey AS n, '[REDACTED_CREDENTIAL]' AS token, {RED} AS note, true AS hidden, {RED} || '|' || c_mktsegment AS items, {RED} AS line, NULL::INT AS len FROM customer")
LABELS = ["benign", "Normal", "0", "unlabeled", "", "attack:ssh", "malicious"]


def f15(spark, d):
    e = t(spark, d, "events").withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % len(LABELS) + 1).cast("int")))
    name, scenario = N.split_label("label")
    return e.select("event_id", N.label_binary(name).alias("label_binary"), scenario.alias("scenario"))


Q["F15_label_binary"] = Query(f15, f"SELECT event_id, CASE event_id % {len(LABELS)} WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS label_binary, CASE event_id % {len(LABELS)} WHEN 5 THEN 'ssh' ELSE '' END AS scenario FROM events")
SESSION = {"dataset_session_id": "s1", "session_label": "benign", "host_os": "linux"}


def f16(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pid"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("session_label"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("host_os"), F.lit("x").alias("other"))
    rows = scans.session_rows(o, SESSION)
    return rows.select("pid", "session_label", "host_os", "dataset_session_id", "kernel_version", "command_line", F.lit(len(rows.columns)).alias("n_columns"))


Q["F16_fill_columns"] = Query(f16, "SELECT o_orderkey::VARCHAR AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'benign' ELSE o_orderpriority END AS session_label, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'linux' END AS host_os, 's1' AS dataset_session_id, NULL::VARCHAR AS kernel_version, NULL::VARCHAR AS command_line, 55 AS n_columns FROM orders")


def f17(spark, d):
    good, bad = N.int_trace(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_name"), F.lit(" 12  x7")))
    return t(spark, d, "part").select("p_partkey", F.size(good).alias("valid"), F.size(bad).alias("invalid"), F.aggregate(good, F.lit(0), lambda a, x: a + x).alias("total"))


Q["F17_int_trace"] = Query(f17, "SELECT p_partkey, len(list_filter(x, lambda v: regexp_full_match(v, '[+-]?[0-9]{1,9}')))::INT AS valid, len(list_filter(x, lambda v: NOT regexp_full_match(v, '[+-]?[0-9]{1,9}')))::INT AS invalid, list_sum(list_transform(list_filter(x, lambda v: regexp_full_match(v, '[+-]?[0-9]{1,9}')), lambda v: v::INT))::INT AS total FROM (SELECT p_partkey, list_filter(regexp_split_to_array(p_size || ' ' || p_name || '  12  x7', '\\s+'), lambda v: v <> '') AS x FROM part)".replace("\\\\s", "\\s"))


def f18(spark, d):
    good, bad = N.named_trace(F.concat(F.col("text"), F.lit(" OPEN(3) 9x")))
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(good).alias("valid"), F.size(bad).alias("invalid"))


TOK = "list_transform(list_filter(regexp_split_to_array(text || ' OPEN(3) 9x', '\\s+'), lambda v: v <> ''), lambda v: lower(split_part(v, '(', 1)))"
Q["F18_named_trace"] = Query(f18, f"SELECT conv_id, turn, len(list_filter(x, lambda v: regexp_full_match(v, '[a-z][a-z0-9_]*')))::INT AS valid, len(list_filter(x, lambda v: NOT regexp_full_match(v, '[a-z][a-z0-9_]*')))::INT AS invalid FROM (SELECT conv_id, turn, {TOK} AS x FROM conversations)")
Q["F19_trace_problems"] = Query(lambda s, d: t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", F.array_join(N.trace_problems(F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))), F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")), F.when(F.col("lang") == "en", F.col("lang"))), ",").alias("problems")),
                                "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'empty sequence' END, CASE WHEN toxic = 1 THEN 'bad label' END, CASE WHEN lang <> 'en' THEN 'no category' END], lambda x: x IS NOT NULL), ',') AS problems FROM labels JOIN documents USING (doc_id)")


def f20(spark, d):
    r = N.open_flags((F.col("event_id") * 37 % 2048).cast("int"))
    return t(spark, d, "events").select("event_id", r.alias("r")).select("event_id", F.array_join("r.ops", ",").alias("ops"), "r.writes", "r.creates")


Q["F20_open_flags"] = Query(f20, "SELECT event_id, array_to_string(list_filter([CASE f & 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'readwrite' END, CASE WHEN f & 64 <> 0 THEN 'create' END, CASE WHEN f & 512 <> 0 THEN 'truncate' END, CASE WHEN f & 1024 <> 0 THEN 'append' END], lambda x: x IS NOT NULL), ',') AS ops, (f & 3) IN (1, 2) AS writes, f & 64 <> 0 AS creates FROM (SELECT event_id, (event_id * 37 % 2048)::INT AS f FROM events)")
Q["F21_syscall_name"] = Query(lambda s, d: t(s, d, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("nr")).join(F.broadcast(s.createDataFrame([(0, "read"), (1, "write"), (2, "open")], "nr int, name string")), "nr", "left").select("event_id", F.coalesce("name", F.concat(F.lit("sys_"), "nr")).alias("name")), "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'open' ELSE 'sys_' || event_id % 6 END AS name FROM events")


def counters(spark, d):
    return t(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.floor(F.col("value")) + F.col("event_id")).alias("counter"))


CNT_SQL = "(SELECT *, c - lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dlt, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS el FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN 0 ELSE floor(value)::BIGINT + event_id END AS c FROM events))"
Q["F22_counter_delta"] = Query(lambda s, d: counters(s, d).select("event_id", N.counter_delta("counter", ["user_id"], ["ts", "event_id"]).alias("delta")), f"SELECT event_id, CASE WHEN dlt < 0 THEN c ELSE dlt END AS delta FROM {CNT_SQL}")
Q["F23_clamped_delta"] = Query(lambda s, d: rounded(counters(s, d).select("event_id", N.counter_delta("counter", ["user_id"], ["ts", "event_id"], clamp=True).alias("delta"), N.counter_rate("counter", secs("ts"), ["user_id"], ["ts", "event_id"]).alias("rate")), "rate"), f"SELECT event_id, greatest(dlt, CASE WHEN dlt IS NULL THEN NULL ELSE 0 END) AS delta, CASE WHEN dlt IS NOT NULL THEN round(greatest(dlt, 0) / greatest(fl, 1e-6) + 1e-9, 6) END AS rate FROM (SELECT *, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fl FROM {CNT_SQL})")
Q["F24_endpoint"] = Query(lambda s, d: t(s, d, "supplier").select("s_suppkey", N.endpoint(F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string"))), F.col("s_nationkey")).alias("endpoint")), "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN '10.0.0.' || s_suppkey || ':' || s_nationkey END AS endpoint FROM supplier")
SCORE = "(SELECT event_id, least(99, floor(value / 3))::INT AS score FROM events)"


def scores(spark, d):
    return t(spark, d, "events").select("event_id", "event_type", F.least(F.lit(99), F.floor(F.col("value") / 3)).cast("int").alias("score"))


Q["F25_risk_band"] = Query(lambda s, d: scores(s, d).select("event_id", C.risk_band("score").alias("band")), f"SELECT event_id, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS band FROM {SCORE}")
Q["F26_risk_status"] = Query(lambda s, d: scores(s, d).select("event_id", C.risk_status("score").alias("status")), f"SELECT event_id, CASE WHEN score >= 70 THEN 'ANOMALOUS' WHEN score >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS status FROM {SCORE}")
REASONS = ["crypto burst", "odd Socket", "file sweep", "root shell", "isolation forest", "rolling mean", "other"]
Q["F27_activity"] = Query(lambda s, d: t(s, d, "events").select("event_id", C.activity(F.array(F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 7 + 1).cast("int")))).alias("activity")), "SELECT event_id, ['RESOURCE_HIJACK', 'COMMAND_AND_CONTROL', 'IMPACT', 'PRIVILEGE_ESCALATION', 'SUSPICIOUS_ML_ANOMALY', 'RESOURCE_DRIFT', 'EXECUTION'][event_id % 7 + 1] AS activity FROM events")
Q["F28_explanation"] = Query(lambda s, d: t(s, d, "events").select("event_id", F.array_join(F.array_compact(F.array(F.when(F.col("value") > 50, F.format_string("value %d is high", F.floor("value"))), F.when(F.col("event_type") == "error", "error seen"))), " • ").alias("explanation")), "SELECT event_id, array_to_string(list_filter([CASE WHEN value > 50 THEN 'value ' || floor(value)::BIGINT || ' is high' END, CASE WHEN event_type = 'error' THEN 'error seen' END], lambda x: x IS NOT NULL), ' • ') AS explanation FROM (SELECT event_id, event_type, value FROM events)")
FLAGS = [*C.RULES, "unknown"]
Q["F32_attack_technique"] = Query(lambda s, d: C.with_technique(t(s, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("event_id") % len(FLAGS) + 1).cast("int")).alias("flag")), C.rule_dimension(s)), f"SELECT event_id, flag, CASE flag {' '.join(f'WHEN {q(k)} THEN {q(v[1])}' for k, v in C.RULES.items())} END AS technique FROM (SELECT event_id, [{', '.join(map(q, FLAGS))}][event_id % {len(FLAGS)} + 1] AS flag FROM events)")


# Sequences ----------------------------------------------------------------------------------------------------------
ORDER = ["ts", "event_id"]


def tr(spark, d):
    """Whole traces as arrays: what files of one trace each are written from."""
    return S.traces(t(spark, d, "events"), ["user_id"], ORDER, "event_type")


def tok(spark, d, where="true"):
    """Traces in cuts of a week, with links from token to token."""
    return Tr.linked(t(spark, d, "events").where(where), "user_id", ORDER, "event_type", F.floor(secs("ts") / (7 * 86400)))


TR_SQL = "tok AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
GRAM_SQL = TR_SQL + """, bi AS (SELECT a || ' ' || b AS gram, count(*) AS n FROM tok WHERE b IS NOT NULL GROUP BY 1 ORDER BY n DESC, gram LIMIT 50), tri AS (SELECT a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM tok WHERE c IS NOT NULL GROUP BY 1 ORDER BY n DESC, gram LIMIT 30),
sch AS (SELECT 'token' AS kind, (row_number() OVER (ORDER BY gram) - 1)::INT AS position, gram, n FROM (SELECT a AS gram, count(*) AS n FROM tok GROUP BY 1) UNION ALL SELECT 'bigram', (row_number() OVER (ORDER BY n DESC, gram) - 1)::INT, gram, n FROM bi UNION ALL SELECT 'trigram', (row_number() OVER (ORDER BY n DESC, gram) - 1)::INT, gram, n FROM tri)"""
Q["M1_vocabulary_and_ngrams"] = Query(lambda s, d: Tr.gram_schema(tok(s, d)), f"WITH {GRAM_SQL} SELECT kind, position, gram, n FROM sch")
STATS = ("diversity", "repetition_ratio")
Q["M2_sequence_stats"] = Query(lambda s, d: rounded(Tr.stats(tok(s, d), "user_id").drop("entropy"), *STATS), f"WITH {TR_SQL} SELECT user_id, count(*) AS length, count(DISTINCT a) AS n_distinct, round(count(DISTINCT a) / count(*) + 1e-9, 6) AS diversity, count(*) FILTER (a = b) AS repeats, round(1 - count(DISTINCT a) / count(*) + 1e-9, 6) AS repetition_ratio FROM tok GROUP BY 1")
Q["M3_int_trace_stats"] = Query(lambda s, d: rounded(Tr.number_stats(t(s, d, "lineitem"), "l_orderkey", "l_partkey"), "mean", "std"), "SELECT l_orderkey, round(avg(l_partkey) + 1e-9, 6) AS mean, round(stddev_pop(l_partkey) + 1e-9, 6) AS std, min(l_partkey)::DOUBLE AS low, max(l_partkey)::DOUBLE AS high FROM lineitem GROUP BY 1")
Q["M4_run_features"] = Query(lambda s, d: Tr.runs(tok(s, d), "user_id", ORDER), f"WITH {TR_SQL}, g AS (SELECT *, sum(CASE WHEN p = a THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM tok), r AS (SELECT user_id, run, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n) AS longest, count(*) FILTER (n > 1) AS n_runs FROM r GROUP BY 1")
Q["M5_token_entropy"] = Query(lambda s, d: rounded(Tr.stats(tok(s, d), "user_id").select("user_id", "entropy"), "entropy"), f"WITH {TR_SQL}, n AS (SELECT user_id, a, count(*) AS n FROM tok GROUP BY 1, 2), s AS (SELECT user_id, sum(n) AS total FROM n GROUP BY 1) SELECT user_id, round(-sum(n / total * log2(n / total)) + 1e-9, 6) AS entropy FROM n JOIN s USING (user_id) GROUP BY 1")
MAT_SQL = GRAM_SQL + """, cnt AS (SELECT user_id, 'token' AS kind, a AS gram, count(*) AS count FROM tok GROUP BY ALL UNION ALL SELECT user_id, 'bigram', a || ' ' || b, count(*) FROM tok WHERE b IS NOT NULL GROUP BY ALL UNION ALL SELECT user_id, 'trigram', a || ' ' || b || ' ' || c, count(*) FROM tok WHERE c IS NOT NULL GROUP BY ALL)"""
Q["M6_gram_counts"] = Query(lambda s, d: Tr.gram_counts(tok(s, d), "user_id", Tr.gram_schema(tok(s, d))), f"WITH {MAT_SQL} SELECT user_id, kind, position, gram, count FROM cnt JOIN sch USING (kind, gram)")
Q["J8_grams_with_schema"] = Query(lambda s, d: Tr.gram_counts(tok(s, d), "user_id", Tr.gram_schema(tok(s, d), bigrams=10, trigrams=0)).groupBy("kind", "gram").agg(F.sum("count").alias("n")), f"WITH {GRAM_SQL} SELECT kind, gram, n FROM sch WHERE kind = 'token' OR kind = 'bigram' AND position < 10".replace(" OR kind = 'bigram' AND position < 10", " OR (kind = 'bigram' AND position < 10)"))
TYPES = ("click", "error", "purchase", "signup", "view")
#: All grams that traces of these tokens can have: the schema's columns.
NAMED = [("token", a) for a in TYPES] + [("bigram", f"{a} {b}") for a in TYPES for b in TYPES] + [("trigram", f"{a} {b} {c}") for a in TYPES for b in TYPES for c in TYPES]
COUNT_SQL = ", ".join(f"count(*) FILTER ({' AND '.join(f'{x} = {q(v)}' for x, v in zip('abc', g.split(), strict=False))}) AS {g.replace(' ', '_')}" for _, g in NAMED)


def m7(spark, d):
    links = tok(spark, d)
    rows = Tr.feature_matrix(links, "user_id", ORDER, Tr.gram_schema(links, bigrams=1000, trigrams=1000), NAMED)
    return rounded(rows.select("user_id", "length", "longest", "entropy", *[F.col(f"{k}:{g}").alias(g.replace(" ", "_")) for k, g in NAMED]), "entropy")


Q["M7_feature_matrix"] = Query(m7, f"WITH {TR_SQL}, n AS (SELECT user_id, a, count(*) AS n FROM tok GROUP BY 1, 2), s AS (SELECT user_id, sum(n) AS total FROM n GROUP BY 1), en AS (SELECT user_id, -sum(n / total * log2(n / total)) AS entropy FROM n JOIN s USING (user_id) GROUP BY 1), g AS (SELECT *, sum(CASE WHEN p = a THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM tok), r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1) SELECT user_id, count(*) AS length, any_value(longest) AS longest, round(any_value(entropy) + 1e-9, 6) AS entropy, {COUNT_SQL} FROM tok JOIN en USING (user_id) JOIN r USING (user_id) GROUP BY user_id")
Q["M8_schema_round_trip"] = Query(lambda s, d: S.schema_from_names(S.schema_names(Tr.gram_schema(tok(s, d)))), f"WITH {GRAM_SQL} SELECT kind, gram, position FROM sch")
DOC_SQL = "dt AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"


def dtok(spark, d):
    return t(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("w"))


Q["A21_class_balance"] = Query(lambda s, d: t(s, d, "labels").join(t(s, d, "documents"), "doc_id").groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("n_distinct")), "SELECT lang, toxic, count(*) AS n, count(DISTINCT text) AS n_distinct FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
Q["A22_sequence_lengths"] = Query(lambda s, d: rounded(dtok(s, d).agg(F.min(F.size("w")).alias("low"), F.max(F.size("w")).alias("high"), F.avg(F.size("w")).alias("mean"), F.count("*").alias("n")), "mean"), f"WITH {DOC_SQL} SELECT min(len(w))::INT AS low, max(len(w))::INT AS high, round(avg(len(w)) + 1e-9, 6) AS mean, count(*) AS n FROM dt")
Q["A22_top_tokens"] = Query(lambda s, d: S.counts(dtok(s, d), "w").orderBy(F.desc("n"), "gram").limit(10), f"WITH {DOC_SQL} SELECT gram, count(*) AS n FROM (SELECT unnest(w) AS gram FROM dt) GROUP BY 1 ORDER BY n DESC, gram LIMIT 10")
Q["S6_ordered_traces"] = Query(lambda s, d: Tr.traces(t(s, d, "events"), "user_id", ORDER, "event_type", F.floor(secs("ts") / (7 * 86400))), "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS trace FROM events GROUP BY 1")
