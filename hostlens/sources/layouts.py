"""Column layouts of collector files, as (name, kind); the kinds are those of ``scans.coerced``.

A kind with a question mark is null where the field is empty; ``=value`` is the default of a column that a file lacks.
"""

from __future__ import annotations


def _columns(text: str) -> dict[str, str]:
    out = {}
    for part in text.split(";"):
        kind, names = part.split(":")
        out |= {name: kind.strip() for name in names.split()}
    return out


# The formats of the files.
PROCESS_INSTANCES = _columns("""plain: instance_id profile_id; int: pid; int?: ppid; text: parent_instance_id; plain: comm; text: executable executable_hash;
    int?: uid; time: start_time end_time; int?: exit_code; flag: preexisting; int: windows_written""")
TELEMETRY_EVENTS = _columns("""long?: event_id; text: instance_id; int?: pid; time: timestamp; plain: event_type; text: syscall_category file_identifier network_identifier; json: metadata""")
BEHAVIOUR_WINDOWS = _columns("""long?: window_id; int: window_index; text: instance_id; plain: profile_id; int?: pid ppid; plain: comm executable; time: start_time end_time; double: duration_s;
    long: syscall_count syscalls_file syscalls_network syscalls_process syscalls_memory syscalls_ipc syscalls_other syscalls_sensitive distinct_syscalls
    file_read_count file_write_count file_open_count file_open_write_count file_create_count file_delete_count file_rename_count unique_files bytes_read bytes_written
    network_count net_connect_count net_accept_count unique_dest_ips unique_dest_ports tcp_tx_bytes tcp_rx_bytes udp_tx_bytes child_process_count thread_create_count exec_count;
    double: cpu_usage memory_usage; long: memory_rss_bytes memory_vms_bytes; double: memory_percent; long: num_threads num_fds disk_read_bytes disk_write_bytes ctx_switches_voluntary ctx_switches_involuntary;
    int=1: alive_at_end; plain=unlabeled: label; label: label_binary; plain=ambient: scenario; plain: experiment_id""")
SYSTEM_METRICS = _columns("""int: window_index; time: start_time end_time; double: duration_s cpu_percent_total cpu_user cpu_system cpu_idle cpu_iowait cpu_steal cpu_core_max load_1m load_5m load_15m;
    long: mem_total mem_used mem_available; double: mem_percent; long: swap_used; double: swap_percent disk_root_percent disk_used_percent_max;
    long: disk_read_bytes disk_write_bytes net_bytes_sent net_bytes_recv net_packets_sent net_packets_recv conn_established conn_listen conn_total process_count tracked_instances events_received events_lost;
    plain=unlabeled: label; label: label_binary; plain=ambient: scenario; plain: experiment_id; json: raw_metrics""")
#: Columns of the system metric files that the stored table leaves out.
SYSTEM_METRICS_MORE = """ctx_switches_delta interrupts_delta mem_buffers mem_cached disk_read_count disk_write_count disk_read_time_ms disk_write_time_ms
    net_errin net_errout net_dropin net_dropout""".split()
SYSCALL_HISTOGRAM = _columns("long: window_id; text: instance_id; int: pid; plain: syscall; long: count")
SYSCALL_TRACE = _columns("double: ts_epoch; int: pid tid; plain: syscall")
#: The flat event file.
EVENT_FIELDS = """timestamp host_id event_type dataset_session_id session_label attack_scenario attack_id pid ppid process_name executable username uid gid
    syscall syscall_category syscall_result file_operation file_path protocol src_ip src_port dst_ip dst_port connection_status
    cpu_percent memory_percent memory_rss memory_vms threads system_cpu_percent system_memory_percent swap_percent disk_read_bytes disk_write_bytes
    network_bytes_sent network_bytes_received network_packets_sent network_packets_received window_duration
    syscall_count file_event_count network_connection_count child_process_count unique_files unique_destinations unique_ports
    historical_mean historical_std deviation historical_ratio z_score host_os kernel_version command_line""".split()
SESSION_FIELDS = ("dataset_session_id", "session_label", "attack_scenario", "attack_id", "host_os", "kernel_version")
#: Files of an experiment in the order in which their keys refer to each other.
EXPERIMENT = {"process_instances": PROCESS_INSTANCES, "telemetry_events": TELEMETRY_EVENTS, "behaviour_windows": BEHAVIOUR_WINDOWS, "system_metrics": SYSTEM_METRICS}
# Attack categories of the two trace collections, and a file of one that isn't a trace.
INT_CATEGORIES = ("Adduser", "Hydra_FTP", "Hydra_SSH", "Java_Meterpreter", "Meterpreter", "Web_Shell")
NAMED_CATEGORIES = ("cowroot", "ftp", "nginx", "privesc", "redis", "ssh")
NOT_TRACES = ("ADFA-LD+Syscall+List.txt",)
