"""Dimensions and ordered rules that name things: system calls, program families, risk bands, activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# System calls of each category. Where a name is in several, the first category in this order counts.
CATEGORIES = {
    "network": """socket connect accept accept4 bind listen sendto recvfrom sendmsg recvmsg sendmmsg recvmmsg shutdown getsockname getpeername
        setsockopt getsockopt""",
    "ipc": """pipe pipe2 socketpair shmget shmat shmdt shmctl semget semop semctl semtimedop msgget msgsnd msgrcv msgctl mq_open mq_unlink
        mq_timedsend mq_timedreceive mq_notify mq_getsetattr eventfd eventfd2 futex futex_waitv signalfd signalfd4 timerfd_create
        timerfd_settime timerfd_gettime""",
    "file": """open openat openat2 creat close close_range read write pread64 pwrite64 readv writev preadv pwritev preadv2 pwritev2 stat fstat
        lstat newfstatat statx stat64 fstat64 lstat64 lseek llseek access faccessat faccessat2 unlink unlinkat rename renameat renameat2 mkdir
        mkdirat rmdir chmod fchmod fchmodat chown fchown lchown fchownat truncate ftruncate getdents getdents64 readlink readlinkat link linkat
        symlink symlinkat fsync fdatasync sync syncfs sendfile copy_file_range splice tee vmsplice fcntl dup dup2 dup3 chdir fchdir getcwd mount
        umount2 flock utimensat utime utimes futimesat fallocate statfs fstatfs setxattr getxattr listxattr removexattr fsetxattr fgetxattr
        inotify_init inotify_init1 inotify_add_watch inotify_rm_watch fanotify_init fanotify_mark chroot pivot_root name_to_handle_at
        open_by_handle_at fadvise64 readahead sync_file_range ioctl""",
    "process": """fork vfork clone clone3 execve execveat exit exit_group wait4 waitid kill tkill tgkill getpid getppid gettid setuid setgid
        setreuid setregid setresuid setresgid setfsuid setfsgid getuid getgid geteuid getegid prctl arch_prctl ptrace setsid setpgid getpgid
        getpgrp getsid sched_yield sched_setaffinity sched_getaffinity sched_setscheduler sched_getscheduler sched_setparam sched_getparam
        sched_get_priority_max sched_get_priority_min set_tid_address setpriority getpriority nice rt_sigaction rt_sigprocmask rt_sigreturn
        rt_sigsuspend rt_sigpending rt_sigtimedwait rt_sigqueueinfo sigaltstack signal unshare setns capget capset seccomp personality rseq
        getrlimit setrlimit prlimit64 getrusage times set_robust_list get_robust_list pidfd_open pidfd_send_signal pidfd_getfd restart_syscall""",
    "memory": """mmap mmap2 munmap mprotect mremap brk madvise mlock mlock2 munlock mlockall munlockall msync mincore process_vm_readv
        process_vm_writev memfd_create userfaultfd remap_file_pages mbind set_mempolicy get_mempolicy migrate_pages move_pages pkey_mprotect
        pkey_alloc pkey_free membarrier""",
}
# Calls that ordinary programs rarely need, and plain reads and writes.
SENSITIVE = """ptrace setuid setgid setreuid setregid setresuid setresgid chroot mount umount2 init_module finit_module delete_module kexec_load
    kexec_file_load capset unshare setns bpf personality process_vm_writev process_vm_readv memfd_create pivot_root reboot swapon swapoff iopl
    ioperm seccomp userfaultfd"""
READS, WRITES = "read pread64 readv preadv preadv2", "write pwrite64 writev pwritev pwritev2"

# Program families by parts of the lower-case name, first match wins; any named ordinary user counts as the third.
FAMILY_PARTS = {
    "nginx": "nginx apache http ssh dns rsyslog curl wget socket net chrome firefox safari browser discord slack mail fetch cloud sync mdns bluetooth wifi network tcp udp router",
    "dockerd": "docker container runc kswapd worker celery redis postgres mysql mongo daemon db engine service core",
    "bash": "bash zsh sh fish python node npm ruby perl git code electron antigravity vim nano cat grep sudo cargo rust go java terminal iterm alacritty sublime cursor idea pycharm",
}
SYSTEM_USERS = "root system _spotlight windowserver _coreaudiod _locationd _distnote"
OTHER_FAMILY = "systemd"
# Program families by exact name.
FAMILY_NAMES = {
    "systemd": "systemd systemd-udevd journald init kthreadd",
    "nginx": "nginx apache2 sshd caddy envoy",
    "bash": "bash sh zsh python3 python node ruby",
    "dockerd": "dockerd containerd docker podman kubelet",
}
# Lower bounds of risk bands and of statuses.
BANDS = {"Critical": 75, "High": 50, "Medium": 25}
STATUSES = {"ANOMALOUS": 70, "SUSPICIOUS": 40}
# Activity by words in the joined reasons, first match wins.
ACTIVITIES = {
    "RESOURCE_HIJACK": ("crypto",),
    "COMMAND_AND_CONTROL": ("socket", "network"),
    "IMPACT": ("file", "traversal"),
    "PRIVILEGE_ESCALATION": ("privilege", "shell"),
    "SUSPICIOUS_ML_ANOMALY": ("xgboost", "isolation forest"),
    "RESOURCE_DRIFT": ("baseline", "envelope", "rolling mean"),
}
# Weight and attack technique of each rule flag.
RULES = {
    "interactive_shell_from_daemon": (75.0, "T1059.004"),
    "crypto_mining": (70.0, "T1496"),
    "mass_file_traversal": (75.0, "T1485"),
    "reverse_shell_socket": (75.0, "T1071"),
    "privilege_escalation": (70.0, "T1548"),
}


def syscall_dimension(spark: SparkSession) -> DataFrame:
    """(syscall, category, sensitive, is_read, is_write): one row per known call; a table, so new calls are a data change."""
    category: dict[str, str] = {}
    for kind, names in CATEGORIES.items():
        for name in names.split():
            category.setdefault(name, kind)
    for name in SENSITIVE.split():
        category.setdefault(name, "other")
    rows = [(n, c, n in SENSITIVE.split(), n in READS.split(), n in WRITES.split()) for n, c in category.items()]
    return spark.createDataFrame(rows, "syscall string, category string, sensitive boolean, is_read boolean, is_write boolean")


def with_category(df: DataFrame, dimension: DataFrame, syscall_col: str = "syscall") -> DataFrame:
    """Add category, sensitive, is_read, is_write; calls that the dimension lacks are ``other`` and nothing else."""
    found = df.join(dimension.withColumnRenamed("syscall", "__name"), F.col(syscall_col) == F.col("__name"), "left").drop("__name")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("sensitive", "is_read", "is_write")}
    return found.withColumns({"category": F.coalesce("category", F.lit("other")), **flags})


def _ladder(pairs: list[tuple[Column, str]], otherwise: str | None) -> Column:
    return reduce(lambda c, p: c.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(F.lit(otherwise))


def family_by_parts(comm: str | Column, user: str | Column) -> Column:
    c, u = (F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (comm, user))
    has = lambda parts: reduce(lambda a, b: a | b, [c.contains(p) for p in parts.split()])
    ordinary = (u != "") & ~u.isin(*SYSTEM_USERS.split())
    rules = [(has(parts) | ordinary if name == "bash" else has(parts), name) for name, parts in FAMILY_PARTS.items()]
    return _ladder(rules, OTHER_FAMILY)


def family_by_name(comm: str | Column) -> Column:
    c = F.col(comm) if isinstance(comm, str) else comm
    return _ladder([(c.isin(*names.split()), name) for name, names in FAMILY_NAMES.items()], OTHER_FAMILY)


def risk_band(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return _ladder([(s >= low, name) for name, low in BANDS.items()], "Low")


def risk_status(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return _ladder([(s >= low, name) for name, low in STATUSES.items()], "SAFE")


def activity(reasons: str | Column) -> Column:
    joined = F.lower(F.array_join(F.col(reasons) if isinstance(reasons, str) else reasons, " "))
    return _ladder([(reduce(lambda a, b: a | b, [joined.contains(w) for w in words]), name) for name, words in ACTIVITIES.items()], "EXECUTION")


def rule_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RULES.items()], "flag string, weight double, technique string")


def with_technique(df: DataFrame, rules: DataFrame, flag_col: str = "flag") -> DataFrame:
    return df.join(rules.select(F.col("flag").alias("__flag"), "technique"), F.col(flag_col) == F.col("__flag"), "left").drop("__flag")


def lifecycle(end: Column, exit_code: Column) -> Column:
    return F.when(end.isNull(), "RUNNING").when(F.coalesce(exit_code, F.lit(0)) != 0, "CRASHED").otherwise("TERMINATED")


def dedup_key(comm: Column, pid: Column, source: Column, names: Column, bucket: Column) -> Column:
    """Of what makes alerts the same: program, process, detectors, sorted signal names, time bucket."""
    raw = F.concat_ws(":", comm, pid.cast("string"), source, F.array_join(F.sort_array(names), ","), bucket.cast("string"))
    return F.concat(F.lit("DK-"), F.upper(F.substring(F.sha2(raw, 256), 1, 12)))


def activity_floor(score: Column, cpu: Column, max_z: Column, syscalls: Column, enabled: bool = True) -> Column:
    """4 to 24 points by activity where the score is 0."""
    points = F.greatest(F.lit(4), F.least(F.lit(24), (4 + 1.5 * cpu + 6 * max_z + F.least(F.lit(600), syscalls) / 80).cast("int")))
    return F.when((score == 0) & F.lit(enabled), points).otherwise(score.cast("int"))
